"""Stage solve and increment tables, in Arrow batches: every step runs over all cells of a batch at once.

A batch of sections is padded to a matrix (cells x ordinates). Root finding is a lock-step bracketing method, staged
searches are lock-step bisections on step numbers, and the increment table is a scan over increments, not over cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.hydraulics import FALLBACK_N, LEAST_N, LEAST_PERIMETER
from .batches import kinds, padded, parts

#: Ordinates of a batch's two matrices together.
BATCH_VALUES = 4_000_000
#: Depths that bracket the stage, its tolerance, and the steps of the staged search (height, number).
BRACKET, TOLERANCE, STAGES = (0.01, 24.99), 1e-3, ((0.5, 101), (0.05, 101), (0.01, 2501))


def round_to(x: np.ndarray, places: int) -> np.ndarray:
    return np.rint(x * 10.0**places) / 10.0**places


@dataclass
class Side:
    """One side of many sections: elevations and n^1.5, padded; ordinates that are there; spacing."""

    z: np.ndarray
    n15: np.ndarray
    count: np.ndarray
    dz: np.ndarray

    @classmethod
    def of(cls, profiles: list, roughness: list, dz: np.ndarray) -> "Side":
        count = np.array([len(p) for p in profiles])
        width = max(1, int(count.max(initial=0)))
        z, n15 = np.full((len(profiles), width), np.inf), np.zeros((len(profiles), width))
        for i, (p, n) in enumerate(zip(profiles, roughness)):
            z[i, : len(p)] = p
            n15[i, : len(p)] = np.asarray(n, float) ** 1.5
        return cls(z, n15, count, dz)

    @classmethod
    def read(cls, profiles: pa.Array, roughness: pa.Array, dz: np.ndarray) -> "Side":
        """The same from list columns of a batch."""
        z, _, count = padded(profiles, np.inf, float)
        n, _, _ = padded(roughness, 0.0, float)
        n15 = np.zeros(z.shape)
        shared = min(z.shape[1], n.shape[1])
        n15[:, :shared] = n[:, :shared] ** 1.5
        return cls(z, n15, count, dz)

    def pick(self, rows: np.ndarray) -> "Side":
        return Side(self.z[rows], self.n15[rows], self.count[rows], self.dz[rows])

    def geometry(self, wse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Area, perimeter, sum of perimeter times n^1.5, top width, at one stage a section."""
        rows = np.arange(len(wse))
        d = wse[:, None] - self.z
        there = np.arange(self.z.shape[1]) < self.count[:, None]
        wet = (self.count > 0) & (d[:, 0] > 1e-16)
        dry = there & (d <= 0)
        dry[:, 0] = False
        bank = dry.any(axis=1)
        k = np.where(bank, dry.argmax(axis=1), self.count)  # the first ordinate that is not counted
        d = np.where(there, d, 0.0)
        inside = np.arange(1, self.z.shape[1]) < k[:, None]
        run = np.where(inside, np.hypot(self.dz[:, None], d[:, 1:] - d[:, :-1]), 0.0)
        area = np.where(inside, self.dz[:, None] * (d[:, 1:] + d[:, :-1]) / 2, 0.0)
        rough = (run * self.n15[:, 1:]).sum(axis=1)
        skip = ~bank if run.shape[1] else np.zeros(len(wse), bool)
        first = run[:, 0] if run.shape[1] else np.zeros(len(wse))
        first_area = area[:, 0] if run.shape[1] else np.zeros(len(wse))
        a, p = area.sum(axis=1) - skip * first_area, run.sum(axis=1) - skip * first
        at = np.maximum(k - 1, 0)
        inner, outer = d[rows, at], d[rows, np.minimum(k, self.z.shape[1] - 1)]
        with np.errstate(invalid="ignore", divide="ignore"):
            u = np.where(bank, self.dz * inner / (np.abs(inner) + np.abs(outer)), 0.0)
        edge = np.where(bank, np.hypot(u, inner), 0.0)
        a, p, rough = a + u * inner / 2, p + edge, rough + edge * self.n15[rows, at]
        t = self.dz * np.maximum(k - 1, 0) + u
        return tuple(np.where(wet, x, 0.0) for x in (a, p, rough, t))


@dataclass
class Filled:
    """A side for looking up many stages: the running maxima of its profile (ordinates x sections), and at each ordinate
    what does not hang on the stage: its elevation, the next one's, n^1.5, and sums up to it of perimeter, perimeter
    times n^1.5 and mean heights above the centre. A stage costs a look-up and a row of these, not all ordinates."""

    top: np.ndarray
    at: np.ndarray
    count: np.ndarray
    dz: np.ndarray

    @classmethod
    def of(cls, side: Side) -> "Filled":
        m, wide = side.z.shape
        there = np.arange(wide) < side.count[:, None]
        z = np.where(there, side.z, 0.0)
        with np.errstate(invalid="ignore"):
            run = np.hypot(side.dz[:, None], z[:, 1:] - z[:, :-1])
            rise = z - z[:, :1]  # above the centre, so that sums keep their digits on high ground
            made = [np.where(there[:, 1:], x, 0.0) for x in (run, run * side.n15[:, 1:], (rise[:, 1:] + rise[:, :-1]) / 2)]
        after = np.concatenate((z[:, 1:], z[:, -1:]), axis=1)
        sums = [np.concatenate((np.zeros((m, 1)), np.cumsum(x, axis=1)), axis=1) for x in made]
        top = np.fmax.accumulate(np.where(there, side.z, np.inf)[:, 1:].T, axis=0)
        return cls(np.ascontiguousarray(top), np.stack([z, after, side.n15, *sums], axis=2), side.count, side.dz)

    def pick(self, rows: np.ndarray) -> "Filled":
        return Filled(self.top.take(rows, axis=1), self.at[rows], self.count[rows], self.dz[rows])

    def geometry(self, wse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Area, perimeter, sum of perimeter times n^1.5, at one stage a section."""
        m, wide, kinds_ = self.at.shape
        # The last ordinate that is counted: those before the first dry one, or all.
        dry = self.top >= wse
        last = np.subtract(len(dry), dry.sum(axis=0, dtype=np.int16), dtype=np.int64)
        bank = last + 1 < self.count
        last = np.minimum(last, np.maximum(self.count - 1, 0))
        z, after, n15, run, rough, mean = self.at.reshape(m * wide, kinds_).take(np.arange(0, m * wide, wide) + last, axis=0).T
        deep, inner, outer = wse - self.at[:, 0, 0], wse - z, wse - after
        with np.errstate(invalid="ignore", divide="ignore"):
            u = np.where(bank, self.dz * inner / (np.abs(inner) + np.abs(outer)), 0.0)
        edge = np.where(bank, np.hypot(u, inner), 0.0)
        # A side under water to its end leaves the first segment out of area and perimeter.
        skip = ~bank & (last > 0)
        first = np.where(skip[:, None], self.at[:, min(1, wide - 1), 3:], 0.0)
        a = self.dz * ((last - skip) * deep - (mean - first[:, 2])) + u * inner / 2
        wet = (self.count > 0) & (deep > 1e-16)
        return tuple(np.where(wet, x, 0.0) for x in (a, run - first[:, 0] + edge, rough + edge * n15))


@dataclass
class Sections:
    left: Side
    right: Side
    slope: np.ndarray
    filled: tuple[Filled, Filled] | None = None

    def __post_init__(self) -> None:
        self.filled = self.filled or (Filled.of(self.left), Filled.of(self.right))

    def pick(self, rows: np.ndarray) -> "Sections":
        return Sections(self.left.pick(rows), self.right.pick(rows), self.slope[rows], tuple(f.pick(rows) for f in self.filled))

    def both(self, wse: np.ndarray) -> list[np.ndarray]:
        return [x + y for x, y in zip(self.left.geometry(wse), self.right.geometry(wse))]

    def flow(self, wse: np.ndarray) -> np.ndarray:
        """Manning's flow, unrounded."""
        a, p, rough = (x + y for x, y in zip(*(f.geometry(wse) for f in self.filled)))
        p = np.maximum(p, LEAST_PERIMETER)
        n = round_to((rough / p) ** (2 / 3), 4)
        n = np.where(n < LEAST_N, FALLBACK_N, n)
        return a * (a / p) ** (2 / 3) * np.sqrt(self.slope) / n

    def rows(self, wse: np.ndarray) -> tuple[np.ndarray, ...]:
        """area, perimeter, velocity, flow, width at rounded stages; zeros but width without water."""
        a, p, rough, t = self.both(round_to(wse, 3))
        a, p, t = round_to(a, 3), round_to(p, 3), round_to(t, 3)
        wet = (a > 0) & (p > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            n = round_to((rough / np.where(wet, p, 1.0)) ** (2 / 3), 4)
            q = round_to(a * (a / p) ** (2 / 3) * np.sqrt(self.slope) / n, 3)
            v = round_to(q / a, 3)
        zero = lambda x: np.where(wet, x, 0.0)
        return zero(a), zero(p), zero(v), zero(q), t


def bracketed_root(f, low: np.ndarray, high: np.ndarray, tolerance: float, rounds: int = 100) -> np.ndarray:
    """Roots of f, one a row, each inside a bracket of opposite signs: Brent's method in lock-step.

    Interpolates (inverse quadratic or secant) where that converges, else halves (Brent 1973, chapter 4).
    """
    a, b = low.astype(float).copy(), high.astype(float).copy()
    fa, fb = f(a), f(b)
    c, fc = a.copy(), fa.copy()
    d = e = b - a
    done = fb == 0
    for _ in range(rounds):
        same = np.sign(fb) * np.sign(fc) > 0
        c, fc = np.where(same, a, c), np.where(same, fa, fc)
        d, e = np.where(same, b - a, d), np.where(same, b - a, e)
        worse = np.abs(fc) < np.abs(fb)
        a, b, c = np.where(worse, b, a), np.where(worse, c, b), np.where(worse, b, c)
        fa, fb, fc = np.where(worse, fb, fa), np.where(worse, fc, fb), np.where(worse, fb, fc)
        least = 4e-16 * np.abs(b) + tolerance / 2
        half = (c - b) / 2
        done = done | (np.abs(half) <= least) | (fb == 0)
        if done.all():
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            s, r, t = fb / fa, fb / fc, fa / fc
            secant = a == c
            p = np.where(secant, 2 * half * s, s * (2 * half * t * (t - r) - (b - a) * (r - 1)))
            q = np.where(secant, 1 - s, (t - 1) * (r - 1) * (s - 1))
            q = np.where(p > 0, -q, q)
            p = np.abs(p)
            good = (np.abs(e) >= least) & (np.abs(fa) > np.abs(fb)) & (2 * p < np.minimum(3 * half * q - np.abs(least * q), np.abs(e * q)))
            step = np.where(good, p / q, half)
        e, d = np.where(good, d, half), step
        a, fa = np.where(done, a, b), np.where(done, fa, fb)
        moved = b + np.where(np.abs(d) > least, d, np.where(half > 0, least, -least))
        b = np.where(done, b, moved)
        fb = np.where(done, fb, f(b))
    return b


def staged(sections: Sections, start: np.ndarray, step: float, number: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stage and flow where the flow first reaches the target: bisection on the step, then a line between two steps."""
    low, high = np.zeros(len(start), int), np.full(len(start), number)
    while (high - low > 1).any():
        open_ = high - low > 1
        mid = (low + high) // 2
        under = sections.flow(start + mid * step) < target
        low, high = np.where(open_ & under, mid, low), np.where(open_ & ~under, mid, high)
    w0, w1 = start + low * step, start + high * step
    q0, q1 = sections.flow(w0), sections.flow(w1)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = w0 + (target - q0) * (w1 - w0) / (q1 - q0)
    line = (q0 < target) & (q1 > target)
    stage = np.where(q0 >= target, w0, np.where(line, between, w1))
    return stage, np.where(q0 >= target, q0, np.where(line, sections.flow(np.where(line, between, w1)), q1))


def solve_stage(sections: Sections, base: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stage of the target flow and the flow there; -999 and 0 without a bracket and a staged result that is closer."""
    objective = lambda w: sections.flow(round_to(w, 3)) - target
    low, high = base + BRACKET[0], base + BRACKET[1]
    f_low, f_high = objective(low), objective(high)
    a, b = round_to(f_low, 5), round_to(f_high, 5)
    bracket = a * b < 0
    stage = np.where(a == 0, round_to(low, 3), np.where(b == 0, round_to(high, 3), -999.0))
    if bracket.any():
        rows = np.flatnonzero(bracket)
        part = sections.pick(rows)
        root = bracketed_root(lambda w: part.flow(round_to(w, 3)) - target[rows], low[rows], high[rows], TOLERANCE)
        stage[rows] = round_to(root, 3)
    flow = np.where(stage > -999, sections.flow(np.maximum(stage, base)), 0.0)
    w = base
    for i, (step, number) in enumerate(STAGES):
        if i:
            w = np.maximum(w - STAGES[i - 1][0], base)
        w, q = staged(sections, w, step, number, target)
    closer = np.abs(q - target) < np.abs(flow - target)
    return np.where(closer, w, stage), np.where(closer, q, flow)


def increments(sections: Sections, base: np.ndarray, stage: np.ndarray, flow: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables (cells x increments 0..number x [q, v, t, wse, p]), and the first and last usable increment.

    Flow must grow: where it falls, the stage is raised by centimetres up to the next increment; what still does not
    grow, or overshoots the solved flow by more than 1, repeats the last good increment.
    """
    m = len(base)
    flow, height = round_to(flow, 3), round_to((stage - base) / number, 3)
    table = np.zeros((m, number + 1, 5))
    held = np.zeros((m, 6))  # a, p, q, v, t, wse of the last good one
    start, last = np.zeros(m, int), np.zeros(m, int)
    for i in range(number + 1):
        w = round_to(base + height * i, 3)
        a, p, v, q, t = sections.rows(w)
        valid = (t > 0) & (a > 0) & (p > 0)
        low = np.flatnonzero(valid & (q < held[:, 2]))
        if len(low):
            upper, trial = round_to(base[low] + height[low] * (i + 1), 3), w[low] + 0.01
            rows = low
            while len(rows):
                more = trial < upper
                rows, trial, upper = rows[more], trial[more], upper[more]
                if not len(rows):
                    break
                ta, tp, tv, tq, tt = sections.pick(rows).rows(trial)
                good = (ta > held[rows, 0]) & (tp > held[rows, 1]) & (tq > held[rows, 2]) & (tq <= flow[rows])
                a[rows], p[rows], t[rows] = ta, tp, tt
                g = rows[good]
                w[g], q[g], v[g] = trial[good], tq[good], tv[good]
                rows, trial, upper = rows[~good], trial[~good] + 0.01, upper[~good]
        stay = valid & ((q <= held[:, 2]) | (q > flow + 1.0))
        keep = valid & ~stay
        table[keep, i] = np.stack([q, v, t, w, p], axis=1)[keep]
        table[stay, i] = held[stay][:, [2, 3, 4, 5, 1]]
        held[keep] = np.stack([a, p, q, v, t, w], axis=1)[keep]
        last[keep], start[~valid] = i, i
    return table, start, last


RESULT = "q_base double, q_max double, slope double, base_elev double, wse_max double, start int, last int, inc array<struct<q:double,v:double,t:double,wse:double,p:double>>"


def rating_tables(sections: DataFrame, number: int, keep: tuple[str, ...] = ("cell_seq",), stage: str | None = None) -> DataFrame:
    """Rating table of each section: columns of ``keep`` with base_elev, wse_max, start, last and inc (1..number).

    ``sections``: p1, n1, p2, n2 (arrays), dz, slope, q_base, q_max. Sections whose flow stays off the target by half,
    or without a positive stage or an increment, give no row. The first usable flow is set just under the baseflow where
    it is above it. With ``stage`` the maximum stage is that column's, and the target is the flow there.
    """
    wanted = list(dict.fromkeys([*keep, "p1", "n1", "p2", "n2", "dz", "slope", "q_base", "q_max", *([stage] if stage else [])]))
    fields = ("q", "v", "t", "wse", "p")
    names = [*keep, "q_base", "q_max", "slope", "base_elev", "wse_max", "start", "last", "inc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, BATCH_VALUES):
            size = [pc.fill_null(pc.list_value_length(batch.column(p)), 0).to_numpy() for p in ("p1", "p2")]
            yield solved(batch.filter(pa.array(size[0] + size[1] > 0)))

    def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
        number_of = lambda name: batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        dz, slope, target, low_q = (number_of(n) for n in ("dz", "slope", "q_max", "q_base"))
        low_q = np.where(np.isnan(low_q), 0.0, low_q)
        left, right = (Side.read(batch.column(f"p{k}"), batch.column(f"n{k}"), dz) for k in "12")
        s = Sections(left, right, slope)
        base = np.where(left.count > 0, left.z[:, 0], right.z[:, 0])
        if stage:
            w = number_of(stage)
            q = s.flow(w)
        else:
            w, q = solve_stage(s, base, target)
        good = np.flatnonzero((w > 0) if stage else ((w > 0) & (q >= 0.5 * target) & (q <= 1.5 * target)))
        table, start, last = increments(s.pick(good), base[good], w[good], q[good], number)
        usable = last > start
        good, table, start, last = good[usable], table[usable], start[usable], last[usable]
        rows = np.arange(len(good))
        first = np.minimum(start + 1, number)
        over = (low_q[good] > 0.001) & (table[rows, first, 0] >= low_q[good])
        table[rows[over], first[over], 0] = low_q[good][over] - 0.001
        items = pa.StructArray.from_arrays([pa.array(table[:, 1:, k].ravel()) for k in range(len(fields))], list(fields))
        inc = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(good) + 1) * number, number, dtype=np.int32)), items)
        made = [pa.array(x[good]) for x in (low_q, target, slope, base, w)] + [pa.array(x.astype(np.int32)) for x in (start, last)]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(good)) for c in keep), *made, inc], names)

    return sections.select(*wanted).mapInArrow(run, f"{kinds(sections, list(keep))}, {RESULT}")
