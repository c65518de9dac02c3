"""Slope and direction of streams from cells near each other, tile by tile.

Cells are rows (row, col, comid, z), one a stream and place. A tile with its rim is a matrix, so the cells of the same
stream within a box are looked up offset by offset, for all cells of the tile at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_sig, rounded
from ..plans.lineage import settle
from . import tiles
from .batches import kinds
from .quantiles import HOT_ROWS, percentiles

DEFAULT_SLOPE = 0.0002


def _around(cells: DataFrame, distance: int, key: str, offsets: list[tuple[int, int]], work: Callable, schema: str) -> DataFrame:
    """``work`` over the cells of each tile: their columns, key codes and z, and for each offset which of them have a cell
    of their stream there, and which row that is."""
    ground = cells.select(F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), F.col(key).alias("__key"), F.col("z").cast("double").alias("z"))
    own = cells.select(key, "row", "col", F.col("z").cast("double").alias("z"), F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"))

    def run(first: tuple[int, int], side: int, mine: pa.Table, seen: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = pa.chunked_array([*seen.column("__key").chunks, *mine.column(key).chunks]).combine_chunks().dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy()
        theirs, ours = codes[: seen.num_rows], np.where(codes[seen.num_rows :] < 0, -2, codes[seen.num_rows :])
        # Streams that share a cell are on matrices of their own.
        place = tiles.numbers(seen.column("__r"))[0] * (1 << 32) + tiles.numbers(seen.column("__c"))[0]
        order = np.argsort(place, kind="stable")
        new = np.concatenate([[True], np.diff(place[order]) != 0])
        layer = np.empty(len(order), np.int64)
        layer[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        mats = []
        for k in range(int(layer.max()) + 1):
            rows = np.flatnonzero(layer == k)
            at = tiles.matrix(first, side, seen.take(pa.array(rows)).select(["__r", "__c"]))
            mats.append(np.where(at < 0, -1, rows[at]))
        z, known = tiles.numbers(seen.column("z"))
        z = np.where(known, z, np.nan)
        r, c = (tiles.numbers(mine.column(x))[0] - first[k] for k, x in enumerate(("__r", "__c")))
        z0, known = tiles.numbers(mine.column("z"))

        def pairs() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for i, j in offsets:
                for at in mats:
                    met = at[r + i, c + j]
                    hit = np.flatnonzero((met >= 0) & (theirs[met] == ours))
                    if len(hit):
                        yield i, j, hit, z[met[hit]]

        yield from work(mine, ours, np.where(known, z0, np.nan), pairs()).to_batches()

    return tiles.over_tiles(own, ground, distance, run, schema)


def _half_open(distance: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-distance, distance) for j in range(-distance, distance)]


def local_slope(cells: DataFrame, dx: float, dy: float, distance: int, key: str = "comid") -> DataFrame:
    """Mean slope to the other cells of the stream in the half-open box [-d, d); 0 without any."""

    def work(mine: pa.Table, ours: np.ndarray, z: np.ndarray, pairs: Iterator) -> pa.Table:
        total, n = np.zeros(len(z)), np.zeros(len(z), np.int64)
        for i, j, hit, other in pairs:
            s = np.abs(z[hit] - other) / np.hypot(j * dx, i * dy)
            total[hit] += np.where(np.isnan(s), 0.0, s)
            n[hit] += ~np.isnan(s)
        return mine.select([key, "row", "col"]).append_column("slope", pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0)))

    offsets = [o for o in _half_open(distance) if o != (0, 0)]
    return _around(cells, distance, key, offsets, work, f"{kinds(cells, [key, 'row', 'col'])}, slope double")


def reach_slope(cells: DataFrame, dx: float, dy: float, distance: int, key: str = "comid", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median slope of each stream over all pairs in the closed box, without what lies beyond the quartiles, and the
    quartiles themselves (p25, p75).

    A tile gives its slopes as one list a stream, in order and as whole numbers of eighth decimals, which pack well. A stream of at most ``hot_rows`` slopes meets in one task; of longer
    ones the percentiles are searched.
    """
    kind = kinds(cells, [key])

    def work(mine: pa.Table, ours: np.ndarray, z: np.ndarray, pairs: Iterator) -> pa.Table:
        whose, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j, hit, other in pairs:
            s = np.rint(np.abs(z[hit] - other) / np.hypot(j * dx, i * dy) * 1e8)
            some = s > 0
            whose.append(ours[hit[some]])
            made.append(s[some].astype(np.int64))
        whose, made = np.concatenate(whose), np.concatenate(made)
        order = np.lexsort((made, whose))
        code, n = np.unique(whose, return_counts=True)
        row = {k: i for i, k in enumerate(ours.tolist())}
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)), pa.array(made[order]))
        return pa.table([mine.column(key).take(pa.array([row[k] for k in code.tolist()], pa.int64())), lists], [key, "s"])

    later = [(i, j) for i in range(distance + 1) for j in range(-distance, distance + 1) if i > 0 or j > 0]
    # Written once: several steps read the slopes, and no later one meets the pairs again.
    slopes = settle(_around(cells, distance, key, later, work, f"{kind}, s array<long>"), "slopes")

    def of(values: np.ndarray, p: float) -> float:
        values, x = np.sort(values), p * (len(values) - 1)
        low, high = math.floor(x), math.ceil(x)
        a, b = values[low], values[high]
        return a if low == high or a == b else (high - x) * a + (x - low) * b

    def run(group: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        s = pc.list_flatten(table.column("s")).to_numpy() / 1e8
        factor = 10.0 ** (7 - np.floor(np.log10(s)))  # to eight figures, as round_sig has it
        t = np.floor(s * factor + 0.5) / factor
        low, high = (np.rint(of(t, p) * 1e8) / 1e8 for p in (0.25, 0.75))
        inner = s[(s >= low) & (s <= high)]
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], table.schema.field(key).type), *(pa.array([x], pa.float64()) for x in (low, high, of(inner, 0.5) if len(inner) else None))], [key, "p25", "p75", "slope"])

    hot = settle(slopes.groupBy(key).agg(F.sum(F.size("s")).alias("n")).where(F.col("n") > hot_rows).select(key), "hot")
    schema = f"{kind}, p25 double, p75 double, slope double"
    if hot.isEmpty():
        found = slopes.groupBy(key).applyInArrow(run, schema)
    else:
        long = slopes.join(hot, key, "left_semi").select(key, F.explode("s").alias("s")).select(key, (F.col("s") / 1e8).alias("s")).withColumn("t", round_sig("s", 8))
        bounds = percentiles(long.select(key, "t"), key, "t", [0.25, 0.75], hot_rows)
        bounds = settle(bounds.select(key, rounded(F.col("p")[0], 8).alias("p25"), rounded(F.col("p")[1], 8).alias("p75")), "quartiles")
        median = percentiles(long.join(bounds, key).where(F.col("s").between(F.col("p25"), F.col("p75"))), key, "s", [0.5], hot_rows).select(key, F.col("p")[0].alias("slope"))
        found = slopes.join(hot, key, "left_anti").groupBy(key).applyInArrow(run, schema).unionByName(bounds.join(median, key, "left"))
    out = cells.select(key).distinct().join(found, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(DEFAULT_SLOPE)).alias(c) for c in ("slope", "p25", "p75")])


def corrected_slope(local: DataFrame, reach: DataFrame, key: str = "comid") -> DataFrame:
    """Local slopes held within the quartiles of their reach."""
    bounds = reach.select(key, "p25", "p75")
    return local.join(bounds, key).withColumn("slope", F.least(F.greatest("slope", "p25"), "p75")).drop("p25", "p75")


def stream_direction(cells: DataFrame, distance: int, key: str = "comid") -> DataFrame:
    """Direction of the stream by least squares in the half-open box, and of the section across it (0 to pi).

    A degenerate fit is 0 where the box's cells extend more in columns than in rows, else pi/2; a lone cell gives (0, 0).
    """
    names = ("n", "sx", "sy", "sxy", "sxx", "mx", "my")

    def work(mine: pa.Table, ours: np.ndarray, z: np.ndarray, pairs: Iterator) -> pa.Table:
        sums = {x: np.zeros(len(z), np.int64) for x in names}
        for i, j, hit, _ in pairs:
            for x, by in zip(names, (1, j, i, i * j, j * j)):
                sums[x][hit] += by
            for x, by in (("mx", abs(j)), ("my", abs(i))):
                sums[x][hit] = np.maximum(sums[x][hit], by)
        return pa.table([*(mine.column(x) for x in (key, "row", "col")), *map(pa.array, sums.values())], [key, "row", "col", *names])

    below, above = F.expr("n * sxx - sx * sx"), F.expr("n * sxy - sx * sy")
    flat = (below <= 1e-6) | (F.abs(above) <= 1e-6)
    fitted = F.atan(F.try_divide(above.cast("double"), below.cast("double")))
    direction = F.when(flat, F.when(F.col("mx") > F.col("my"), 0.0).otherwise(pi / 2)).otherwise(F.when(fitted < 0, fitted + 2 * pi).otherwise(fitted))
    across = F.col("stream_direction") - pi / 2
    placed = cells if "z" in cells.columns else cells.withColumn("z", F.lit(None).cast("double"))
    out = _around(placed, distance, key, _half_open(distance), work, f"{kinds(cells, [key, 'row', 'col'])}, " + ", ".join(f"{x} long" for x in names))
    few = F.coalesce(F.col("n") <= 1, F.lit(True))
    out = out.withColumn("stream_direction", F.when(few, 0.0).otherwise(direction))
    return out.select(key, "row", "col", "stream_direction", F.when(few, 0.0).when(across < 0, across + pi).otherwise(across).alias("xs_direction"))


def terminal_cells(cells: DataFrame) -> DataFrame:
    """Cells whose 3 x 3 block holds two stream cells at most, themselves counted, with that count."""
    names = cells.columns
    own = cells.withColumns({"__r": F.col("row").cast("long"), "__c": F.col("col").cast("long")})

    def run(first: tuple[int, int], side: int, mine: pa.Table, seen: pa.Table) -> Iterator[pa.RecordBatch]:
        held = (tiles.matrix(first, side, seen) >= 0).astype(np.int64)
        r, c = (tiles.numbers(mine.column(x))[0] - first[k] for k, x in enumerate(("__r", "__c")))
        around = sum(held[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
        few = np.flatnonzero(around <= 2)
        made = [mine.column(x).take(pa.array(few)) for x in names]
        yield from pa.table([*made, pa.array(around[few])], [*names, "n_around"]).to_batches()

    return tiles.over_tiles(own, own.select("__r", "__c"), 1, run, f"{kinds(cells, names)}, n_around long")


def elevation_range(cells: DataFrame, key: str = "comid") -> DataFrame:
    return cells.groupBy(key).agg(F.min("z").alias("min_elev"), F.max("z").alias("max_elev"))
