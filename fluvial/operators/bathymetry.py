"""Bathymetry: banks of a section, depth of a trapezoid that carries the baseflow, and the profile with it burnt in.

A batch of sections is two padded matrices (sections x ordinates), one a side. Banks, depths and the burnt bed are found
for all sections of a batch at once: a stepped search for a depth is a bisection on step numbers, a search over stages
is one lookup in the running maxima of the profiles, and the bed is one piecewise formula over the ordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import kinds, padded, parts

#: Roughness of the assumed channel; depth at which a method has failed; rise that ends flat water (fixed values).
CHANNEL_N, TOO_DEEP, FLAT_RISE = 0.03, 25.0, 0.1
#: Steps of the depth of a trapezoid, of a triangle, and of the stage of the width over depth (fixed values).
DEPTH_STEPS, TRIANGLE_STEP, STAGE_STEP = (1.0, 0.5, 0.1, 0.01), 0.1, 0.01
#: What sums in another order may differ by: a rise that is less by no more is not less.
LAST_BITS = 1e-9
#: Ordinates of a batch's two matrices together, and stages that are looked up at once.
BATCH_VALUES, STAGES = 2_000_000, 64


def _least_step(reaches: Callable[[np.ndarray], np.ndarray], rows: int, most: int) -> np.ndarray:
    """The least number of steps from 1 on that reaches the target, row by row; ``most`` where none before it does.

    ``reaches`` must not turn false again as steps grow.
    """
    low, high = np.zeros(rows, int), np.full(rows, most)
    while (high - low > 1).any():
        middle = (low + high) // 2
        there = reaches(middle) & (middle > low)
        low, high = np.where(there, low, middle), np.where(there, middle, high)
    return high


def _manning(area: np.ndarray, perimeter: np.ndarray, slope: np.ndarray, n: float) -> np.ndarray:
    return area * (area / perimeter) ** (2 / 3) * np.sqrt(slope) / n


def trapezoid_depth(flow, base, top, slope, n: float = CHANNEL_N) -> np.ndarray:
    """Depth of a trapezoid in steps of 1, 0.5, 0.1 and 0.01 that carries no more than the flow (arrays or numbers).

    Each step size goes on from the last depth that carries no more; 25 m of steps of a size at most.
    """
    shape = np.broadcast_shapes(*map(np.shape, (flow, base, top, slope)))
    flow, base, top, slope = (np.broadcast_to(np.asarray(v, float), shape).ravel() for v in (flow, base, top, slope))
    depth = np.zeros(flow.shape)
    for step in DEPTH_STEPS:

        def more(k: np.ndarray) -> np.ndarray:
            d = depth + k * step
            return ~(_manning(d * (base + top) / 2, base + 2 * np.hypot((top - base) / 2, d), slope, n) <= flow)

        depth = depth + step * (_least_step(more, len(flow), round(TOO_DEEP / step)) - 1)
    return depth.reshape(shape)


def triangle_depth(flow, dz, centre, left, right, slope, n: float = CHANNEL_N) -> np.ndarray:
    """Depth of a one-cell channel in steps of 0.1 that first carries more than the flow; 0 without a flow, 25 at most.

    A neighbour that is missing (infinitely high) is a wall.
    """
    shape = np.broadcast_shapes(*map(np.shape, (flow, dz, centre, left, right, slope)))
    flow, dz, centre, left, right, slope = (np.broadcast_to(np.asarray(v, float), shape).ravel() for v in (flow, dz, centre, left, right, slope))
    rises = [np.maximum(side - centre, 0.0) for side in (left, right)]

    def more(k: np.ndarray) -> np.ndarray:
        d = np.maximum(k, 1) * TRIANGLE_STEP
        widths = [dz * d / (rise + d) for rise in rises]
        return _manning(sum(widths) * d / 2, sum(np.hypot(w, d) for w in widths), slope, n) > flow

    steps = _least_step(more, len(flow), round(TOO_DEEP / TRIANGLE_STEP))
    return np.where(flow > 0, steps * TRIANGLE_STEP, 0.0).reshape(shape)


def smoothed(profiles: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Savitzky-Golay smoothing of profiles (the last axis) of one length; the ends are values of the polynomial of the
    first and the last window. Short profiles get a window of their own length and a lower order."""
    n = profiles.shape[-1]
    window = min(window, n)
    if window < 1:
        return profiles.copy()
    order, left = min(order, window - 1), (window - 1) // 2
    powers = np.vander(np.arange(window) - left, order + 1, increasing=True).astype(float)
    solve = np.linalg.pinv(powers)
    ends = profiles[..., :window] @ (powers @ solve).T, profiles[..., n - window :] @ (powers @ solve).T
    if window % 2:
        middle, first = solve[0], left
        inner = np.lib.stride_tricks.sliding_window_view(profiles, window, axis=-1) @ middle
        return np.concatenate((ends[0][..., :left], inner, ends[1][..., window - left :]), axis=-1)
    return np.concatenate((ends[0][..., : window // 2], ends[1][..., window - (n - window // 2) :]), axis=-1)  # the window is the profile


def _first(found: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Place of the first true value of each row."""
    return np.where(found.any(axis=1), found.argmax(axis=1) if found.shape[1] else 0, otherwise)


@dataclass
class Channels:
    """Sections of a batch. Sides: elevations (infinite beyond the end), land cover, number of ordinates; spacing."""

    z: tuple[np.ndarray, np.ndarray]
    cover: tuple[np.ndarray, np.ndarray]
    count: tuple[np.ndarray, np.ndarray]
    dz: np.ndarray
    water: int = 80

    @property
    def floor(self) -> np.ndarray:
        return np.where(self.count[0] > 0, self.z[0][:, 0], self.z[1][:, 0])

    def pick(self, rows: np.ndarray) -> "Channels":
        return replace(self, z=tuple(z[rows] for z in self.z), cover=tuple(c[rows] for c in self.cover), count=tuple(n[rows] for n in self.count), dz=self.dz[rows])

    def at(self, side: int, i: np.ndarray) -> np.ndarray:
        """Elevations of one ordinate a section; infinite outside a side."""
        z = self.z[side]
        inside = (i >= 0) & (i < self.count[side])
        return np.where(inside, z[np.arange(len(z)), np.where(inside, i, 0)], np.inf)

    def flat_banks(self, water_level: bool) -> np.ndarray:
        """(sections, 2): the first ordinate 0.1 above the centre, or, for the water's level, the one before it; the
        side's length without one."""
        found = []
        for z, n in zip(self.z, self.count):
            up = (z[:, 1:] >= self.floor[:, None] + FLAT_RISE) & np.isfinite(z[:, 1:])
            first = _first(up, np.full(len(n), -1))
            found.append(np.where(first < 0, n, first + 1 - water_level))
        return np.stack(found, axis=1)

    def cover_banks(self) -> np.ndarray:
        """(sections, 2): the first ordinate that is not water; 0 without one."""
        inside = lambda z: np.isfinite(z[:, 1:])
        return np.stack([_first((c[:, 1:] != self.water) & inside(z), np.full(len(z), -1)) + 1 for z, c in zip(self.z, self.cover)], axis=1)

    def cover_level(self) -> np.ndarray:
        """The water's level by land cover: on each side the lowest of the centre and the water next to it; of those
        above the centre the lower one, and 0.1 above the centre where none is."""
        levels = []
        for z, c in zip(self.z, self.cover):
            wet = np.logical_and.accumulate((c == self.water) | (np.arange(c.shape[1]) == 0), axis=1) & np.isfinite(z)
            lowest = np.where(wet, z, np.inf).min(axis=1, initial=np.inf)
            levels.append(np.where(lowest > self.floor, lowest, np.inf))
        level = np.minimum(*levels)
        return np.where(np.isfinite(level), level, self.floor + FLAT_RISE)

    def widths(self, side: int, stage: np.ndarray) -> np.ndarray:
        """Top widths of a side at stages above the centre (sections x stages, all positive)."""
        m, n = len(stage), self.count[side]
        height = self.z[side] - self.floor[:, None]
        # Where a profile first is as high as a stage, its running maximum first is; rows are set apart to look all up at once.
        top = np.clip(np.maximum.accumulate(height[:, 1:], axis=1), -1.0, 2 * TOO_DEEP)
        apart = 4 * TOO_DEEP * np.arange(m)
        wide = top.shape[1]
        below = np.searchsorted((top + apart[:, None]).ravel(), (stage + apart[:, None]).ravel(), side="left").reshape(stage.shape) - wide * np.arange(m)[:, None]
        k = np.clip(below, 0, wide) + 1  # the first ordinate that is dry
        rows = np.arange(m)[:, None]
        inner = stage - height[rows, k - 1]
        outer = np.where(k < n[:, None], stage - height[rows, np.minimum(k, wide)], np.inf)
        with np.errstate(invalid="ignore"):
            edge = np.where(np.isfinite(outer), inner / (np.abs(inner) + np.abs(outer)), 0.0)
        return np.where(n[:, None] > 0, self.dz[:, None] * (np.minimum(k, np.maximum(n, 1)[:, None]) - 1 + edge), 0.0)

    def ratio_banks(self) -> np.ndarray:
        """(sections, 2): banks at the last stage, in steps of 0.01, before width over depth grows; 0 if it does not
        within 25 m."""
        found = np.zeros((len(self.dz), 2), int)
        rows, last_ratio, last = np.arange(len(self.dz)), np.full(len(self.dz), np.inf), np.zeros((len(self.dz), 2))
        for start in range(1, round(TOO_DEEP / STAGE_STEP) + 1, STAGES):
            if not len(rows):
                break
            steps = np.arange(start, min(start + STAGES, round(TOO_DEEP / STAGE_STEP) + 1)) * STAGE_STEP
            part = self.pick(rows)
            stage = np.broadcast_to(steps, (len(rows), len(steps)))
            both = np.stack([part.widths(s, stage) for s in (0, 1)], axis=2)
            ratio = both.sum(axis=2) / steps
            before = np.concatenate((last_ratio[:, None], ratio[:, :-1]), axis=1)
            grown = _first(ratio > before, np.full(len(rows), -1))
            over = np.flatnonzero(grown >= 0)
            widths = np.where((grown[over] > 0)[:, None], both[over, np.maximum(grown[over], 1) - 1], last[over])
            found[rows[over]] = widths / part.dz[over, None]
            still = grown < 0
            rows, last_ratio, last = rows[still], ratio[still, -1], both[still, -1]
        return found

    def bend_banks(self) -> np.ndarray:
        """(sections, 2): the first ordinate after which the smoothed profile rises less than before it; 0 without one."""
        found = np.zeros((len(self.dz), 2), int)
        for s, (z, n) in enumerate(zip(self.z, self.count)):
            for length in np.unique(n[n > 1]):
                rows = np.flatnonzero(n == length)
                rise = np.diff(smoothed(z[rows, :length]), axis=1)
                less = rise < np.concatenate((np.zeros((len(rows), 1)), rise[:, :-1]), axis=1) - LAST_BITS
                found[rows, s] = _first(less, np.zeros(len(rows), int))
        return found


@dataclass
class Shapes:
    """A trapezoid a section: bank ordinates, cells, width, depth, level of the bed, and from the bank ordinates to the
    banks themselves. Sections with no cells have none; one cell lowers the centre only."""

    banks: np.ndarray
    cells: np.ndarray
    width: np.ndarray
    depth: np.ndarray
    bed: np.ndarray
    reach: np.ndarray


def _depth(flow: np.ndarray, width: np.ndarray, slope: np.ndarray, share: float) -> np.ndarray:
    """Depth of a trapezoid with ``share`` of its width under each slope; too deep where it has no width."""
    wide = width > 0
    return np.where(wide, trapezoid_depth(flow, np.where(wide, width, 1.0) * (1 - 2 * share), np.where(wide, width, 1.0), slope), TOO_DEEP)


def shapes_by_level(c: Channels, flow: np.ndarray, slope: np.ndarray, share: float, by_cover: bool) -> Shapes:
    """Banks by flat water or land cover, then by width over depth, then by the bend of the profile; a width over depth
    whose depth runs away hands over to the bend. One cell is a triangle (its depth lowers the centre only)."""
    banks = c.cover_banks() if by_cover else c.flat_banks(True)
    cells = banks.sum(axis=1) - 1
    method = np.where(cells >= (1 if by_cover else 2), 1, 0)
    for number, find in ((2, Channels.ratio_banks), (3, Channels.bend_banks)):
        rows = np.flatnonzero(cells < 1)
        banks[rows] = find(c.pick(rows))
        cells[rows] = banks[rows].sum(axis=1) - 1
        method[rows] = np.where(cells[rows] > 1, number, method[rows])
    cells = np.maximum(cells, 1)
    some, single = (flow > 0) & (method > 0), cells == 1
    depth = _depth(flow, cells * c.dz, slope, share)
    rows = np.flatnonzero(some & ~single & (depth >= TOO_DEEP) & (method == 2))
    if len(rows):
        part = c.pick(rows)
        banks[rows] = part.bend_banks()
        cells[rows] = banks[rows].sum(axis=1) - 1
        depth[rows] = _depth(flow[rows], cells[rows] * part.dz, slope[rows], share)
    sides = [c.at(s, np.ones(len(flow), int)) for s in (0, 1)]
    depth = np.where(single, triangle_depth(flow, c.dz, c.floor, *sides, slope), depth)
    lost = ~single & (depth >= TOO_DEEP)
    depth, cells = np.where(lost, 0.0, depth), np.where(lost, 1, cells)
    return Shapes(banks, np.where(some, cells, 0), cells * c.dz, depth, c.floor - depth, np.zeros(banks.shape))


def shapes_by_banks(c: Channels, flow: np.ndarray, slope: np.ndarray, share: float, by_cover: bool) -> Shapes:
    """As by level, with the lower bank's elevation as the bankfull level and banks between ordinates."""

    def measured(c: Channels, flow: np.ndarray, slope: np.ndarray, banks: np.ndarray, cells: np.ndarray) -> Shapes:
        levels = [np.where(np.isfinite(e := c.at(s, banks[:, s])) & (e >= c.floor), e, np.inf) for s in (0, 1)]
        full = np.minimum(*levels)
        full = np.where(np.isfinite(full), full, c.floor)
        reach = []
        for s in (0, 1):
            here, there = c.at(s, banks[:, s]), c.at(s, banks[:, s] + 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                x = np.where(there > here, c.dz * (full - here) / (there - here), 0.0)
            reach.append(np.where(np.isfinite(there) & (x >= 0) & (x <= c.dz), x, c.dz / 2))
        width = cells * c.dz + sum(reach)
        depth = _depth(flow, width, slope, share)
        return Shapes(banks, cells, width, depth, full - depth, np.stack(reach, axis=1))

    if by_cover:
        wet = (c.count[0] > 0) & (c.cover[0][:, 0] == c.water)
        banks = np.where(wet[:, None], np.maximum(c.cover_banks() - 1, 0), 0)
    else:
        banks = c.flat_banks(False)
    cells = banks.sum(axis=1) - 1
    for find, less in ((Channels.ratio_banks, 1), (Channels.bend_banks, 0)):
        rows = np.flatnonzero(cells <= 1)
        banks[rows] = find(c.pick(rows))
        cells[rows] = banks[rows].sum(axis=1) - less
    made = measured(c, flow, slope, banks, np.maximum(cells, 1))
    some = (cells > 1) & (flow > 0)
    for find in (Channels.ratio_banks, Channels.bend_banks):
        rows = np.flatnonzero(some & (made.depth >= TOO_DEEP))
        if len(rows):
            part = c.pick(rows)
            banks = find(part)
            again = measured(part, flow[rows], slope[rows], banks, np.maximum(banks.sum(axis=1) - 1, 1))
            for name in ("banks", "cells", "width", "depth", "bed", "reach"):
                getattr(made, name)[rows] = getattr(again, name)
    return replace(made, cells=np.where(some & (made.depth < TOO_DEEP) & (made.cells > 1), made.cells, 0))


def bed(c: Channels, shapes: Shapes, side: int, share: float, by_banks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Elevations of a side with the shape in it, and which ordinates it takes (sections x ordinates).

    From the bank inwards the bed falls over ``share`` of the width and is flat then. Where the banks are the far ones it
    rises again. Unless banks were used, ordinates that are lower already stay.
    """
    x = np.arange(c.z[side].shape[1])
    inside = x < c.count[side][:, None]
    bank = (shapes.banks[:, side] + by_banks)[:, None]
    width, depth, low = shapes.width[:, None], shapes.depth[:, None], shapes.bed[:, None]
    slant = share * width
    to_bank = (bank - x) * c.dz[:, None] + shapes.reach[:, side][:, None]
    far = ~(to_bank > slant) & (to_bank >= width - slant)
    way = np.where(far, width - to_bank, to_bank)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = low + depth * np.where(to_bank > slant, 0.0, 1 - way / slant)
    taken = (bank > 0) & (x <= bank) & inside & (shapes.cells > 1)[:, None]
    if not by_banks:
        taken &= (z < c.z[side]) & (~far | (way > 0))
    centre = (shapes.cells == 1)[:, None] & (x == 0) & inside
    return np.where(centre, low, np.where(taken, z, c.z[side])), taken | centre


def _channels(batch: pa.RecordBatch, water: int) -> tuple[Channels, list[np.ndarray]]:
    z, there, size, cover = [], [], [], []
    for s in "12":
        a, b, c = padded(batch.column(f"p{s}"), np.inf, float)
        z.append(a), there.append(b), size.append(c)
        cover.append(padded(batch.column(f"lc{s}"), -1, float)[0])
    cover = [np.pad(k[:, : v.shape[1]], ((0, 0), (0, max(0, v.shape[1] - k.shape[1]))), constant_values=-1) for k, v in zip(cover, z)]
    return Channels(tuple(z), tuple(cover), tuple(size), batch.column("dz").to_numpy(zero_copy_only=False).astype(float), water), there


#: The methods of ``with_banks``.
METHODS = {
    "flat": lambda c: c.flat_banks(False),
    "level": lambda c: c.flat_banks(True),
    "cover": Channels.cover_banks,
    "ratio": Channels.ratio_banks,
    "bend": Channels.bend_banks,
    "cover_level": Channels.cover_level,
}


def with_banks(sections: DataFrame, water: int = 80, wanted: tuple[str, ...] = tuple(METHODS), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Sections with their banks by each ``wanted`` method, sides 1 and 2: flat, level (flat water, one before the bank),
    cover, ratio and bend (arrays), and cover_level. Sections without a side have the banks of the other. ``keep``: the
    columns of the sections that stay (all, without it)."""
    keep = tuple(sections.columns) if keep is None else keep
    needed = sections.select(*dict.fromkeys([*keep, "p1", "p2", "lc1", "lc2", "dz"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, BATCH_VALUES):
            c, _ = _channels(batch, water)
            found = [METHODS[n](c) for n in wanted]
            made = [pa.array(f) if f.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(f.astype(np.int32).ravel()), 2).cast(pa.list_(pa.int32())) for f in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *made], [*keep, *wanted])

    return needed.mapInArrow(run, ", ".join([kinds(sections, list(keep))] * bool(keep) + [f"{n} {'double' if n == 'cover_level' else 'array<int>'}" for n in wanted]))


def with_bathymetry(sections: DataFrame, share: float = 0.2, by_banks: bool = False, by_cover: bool = False, water: int = 80, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Sections with burnt profiles in p1 and p2, and burnt: array of (row, col, z, side, i) for the raster.

    ``sections`` has p1, lc1, rc1, p2, lc2, rc2, dz, slope and q_base beside its other columns, which stay. Sections
    that lack a side or a positive baseflow stay as they are. ``keep``: the columns that stay, burnt profiles among them
    (all, without it); what is left out is not sent to and fro.
    """
    keep = tuple(sections.columns) if keep is None else keep
    needed = sections.select(*dict.fromkeys([*keep, *(f"{c}{s}" for s in "12" for c in ("p", "lc", "rc")), "dz", "slope", "q_base"]))
    find = shapes_by_banks if by_banks else shapes_by_level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, BATCH_VALUES):
            c, there = _channels(batch, water)
            flow, slope = (np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False).astype(float)) for n in ("q_base", "slope"))
            whole = np.flatnonzero((c.count[0] > 0) & (c.count[1] > 0) & (flow > 0))
            columns = {n: batch.column(n) for n in keep}
            items = []
            part = c.pick(whole)
            shapes = find(part, flow[whole], slope[whole], share, by_cover)
            for s in (0, 1):
                z, taken = bed(part, shapes, s, share, by_banks)
                full = c.z[s].copy()
                full[whole] = z
                ends = np.concatenate(([0], np.cumsum(c.count[s]))).astype(np.int32)
                if f"p{s + 1}" in keep:
                    columns[f"p{s + 1}"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(full[there[s]]))
                row, i = np.nonzero(taken)
                cell = pc.list_flatten(batch.column(f"rc{s + 1}"))
                at = pa.array(ends[whole[row]] + i)
                items.append((whole[row], *[pc.struct_field(cell, f).take(at).to_numpy(zero_copy_only=False) for f in "rc"], z[row, i], np.full(len(i), s + 1), i))
            both = [np.concatenate(v) for v in zip(*items)]
            order = np.lexsort((both[5], both[4], both[0]))
            ends = np.concatenate(([0], np.cumsum(np.bincount(both[0], minlength=batch.num_rows)))).astype(np.int32)
            fields = [pa.array(v[order].astype(k)) for v, k in zip(both[1:], (np.int32, np.int32, float, np.int32, np.int32))]
            columns["burnt"] = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["row", "col", "z", "side", "i"]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return needed.mapInArrow(run, ", ".join([kinds(sections, list(keep))] * bool(keep) + ["burnt array<struct<row:int,col:int,z:double,side:int,i:int>>"]))


def bathymetry_grid(burnt: DataFrame, order: str = "cell_seq") -> DataFrame:
    """row, col, z: where sections overlap the last one in row-major order wins, whatever the partitioning.

    Whole numbers as order, side and ordinate make one number, so that cells are aggregated in a hash table; by a struct
    all of them would be sorted.
    """
    cells = burnt.select(order, F.explode("burnt").alias("b")).select(order, "b.*")
    last = F.struct(order, "side", "i")
    if burnt.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        last = F.col(order).cast("decimal(19,0)") * F.lit(10**11).cast("decimal(12,0)") + (F.col("side").cast("long") * 10**10 + F.col("i")).cast("decimal(19,0)")
    return cells.groupBy("row", "col").agg(F.max_by("z", last).alias("z"))


def below_ground(grid: DataFrame, dem: DataFrame, shifted: bool, any_height: bool = False) -> DataFrame:
    """Final grid: nothing above the ground (unless banks were used), and without the shift of negative elevations."""
    both = grid.join(dem.select("row", "col", F.col("z").alias("ground")), ["row", "col"])
    both = both if any_height else both.where(F.col("z") <= F.col("ground"))
    return both.select("row", "col", (F.col("z") - (100.0 if shifted else 0.0)).alias("z"))
