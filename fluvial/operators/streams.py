"""Clean-up of rasterised streams: spurs and doubled cells go, in row-major order."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

#: Sweeps over all cells (two passes of two), and cells that a tile holds on average where they lie densest.
SWEEPS, BAND_CELLS = 4, 50_000
#: Cells around a tile that its first guess is swept with, those that a cell's fate hangs on, and how often tiles double.
HALO, RIM, DOUBLED = 32, 2, 2
#: A cell's fate: twice the sweep that takes it, one more if the cell after it takes it; what stays has this one.
STAYS = 2 * SWEEPS

Row = dict[int, int]


def _spurs(row: Row, above: Row, below: Row, fates: Row, given: Row, k: int) -> Row:
    """Cells of a row (column -> stream) without those that have nothing on both sides of an axis, a cell next to them
    along it, and none of the three on the other side. Taken from left to right: what went is seen. Cells that are
    ``given`` go when it says; ``fates`` takes down the others that go."""
    left, up, down = dict(row), above.get, below.get
    get = left.get
    for c in sorted(row):
        if c in given:
            if given[c] // 2 == k:
                del left[c]
            continue
        n, s, w, e = up(c), down(c), get(c - 1), get(c + 1)
        if w or e:
            gone = not n and not s and not (w and e) and not (up(c + 1) or down(c + 1) if w else up(c - 1) or down(c - 1))
        else:
            gone = (n and not (s or down(c - 1) or down(c + 1))) or (s and not (n or up(c - 1) or up(c + 1)))
        if gone:
            del left[c]
            fates[c] = 2 * k
    return left


def _doubled(row: Row, above: Row, below: Row, fates: Row, given: Row, k: int) -> Row:
    """Cells of a row without those next to a cell of their stream that have a corner of it, where nothing follows them
    in the row or above; a cell whose own corner is in the next or the last row leaves its neighbours."""
    left, up, down = dict(row), above.get, below.get
    get = left.get
    # What is given goes after the cell before it or after the next.
    going = sorted((c - 1 + 2 * (given[c] % 2), c) for c in row if c in given and given[c] // 2 == k) if given else []
    at = 0
    for c in sorted(row):
        while at < len(going) and going[at][0] < c:
            del left[going[at][1]]
            at += 1
        v = get(c)
        if not v or (down(c) == v and v in (down(c + 1), down(c - 1))) or (up(c) == v and v in (up(c + 1), up(c - 1))):
            continue
        for s in (1, -1):
            if get(c + s) == v and v in (down(c + s), up(c + s)):
                if not up(c + 2 * s) and not get(c + 2 * s) and c + s not in given:
                    del left[c + s]
                    fates[c + s] = 2 * k + (s < 0)
                break
    for _, c in going[at:]:
        del left[c]
    return left


def swept(rows: dict[int, Row], given: dict[int, Row] | None = None) -> dict[int, Row]:
    """Fates of the cells that go in the sweeps, by row and column; those of the ``given`` cells are taken as they are.

    A row's sweep sees the row above as that sweep has left it, and the row below as the sweep before has.
    """
    order, given = sorted(rows), given or {}
    fates: dict[int, Row] = {r: {} for r in order}
    before = rows
    for k in range(SWEEPS):
        after: dict[int, Row] = {}
        for r in order:
            after[r] = (_spurs, _doubled)[k % 2](before[r], after.get(r - 1, {}), before.get(r + 1, {}), fates[r], given.get(r, {}), k) if before[r] else {}
        before = after
    return fates


def _tile(c: str, side: int, by: int = 0) -> Column:
    return F.floor((F.col(c) + by) / side)


def _seen(cells: DataFrame, side: int, rim: int) -> DataFrame:
    """Each cell in the tiles (tr, tc) that hold it or have it in their rim."""
    near = lambda c: F.explode(F.array_distinct(F.array(_tile(c, side, -rim), _tile(c, side), _tile(c, side, rim))))
    return cells.select("*", near("row").alias("tr")).select("*", near("col").alias("tc"))


def _per_tile(cells: DataFrame, side: int, rim: int, schema: str, only: DataFrame | None = None) -> DataFrame:
    """Fates of each tile's cells. Cells around are swept too, and their fates that the tile's hang on are given out with
    the tile. Of ``only`` some tiles: fates around are taken as they are, and only cells whose fate changes are given out."""
    known = only is not None

    def each(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        tr, tc = (k.as_py() for k in key)
        row, col, comid = (table.column(c).to_numpy() for c in ("row", "col", "comid"))
        r, c = row - tr * side, col - tc * side
        mine = (r >= 0) & (r < side) & (c >= 0) & (c < side)
        if not mine.any():
            return
        was = table.column("fate").to_numpy() if known else np.full(len(row), STAYS)
        rows: dict[int, Row] = {}
        for i, j, v in zip(row.tolist(), col.tolist(), comid.tolist()):
            rows.setdefault(i, {})[j] = v
        given: dict[int, Row] = {}
        if known:
            for i, j, v in zip(*(x[~mine].tolist() for x in (row, col, was))):
                given.setdefault(i, {})[j] = v
        fates = swept(rows, given)
        fate = np.fromiter((fates[i].get(j, STAYS) for i, j in zip(row.tolist(), col.tolist())), np.int64, len(row))
        if known:
            some = mine & (fate != was)
            made = [row[some], col[some], fate[some]]
        else:
            some = (r >= -RIM) & (r < side + RIM) & (c >= -RIM) & (c < side + RIM)
            made = [x[some] for x in (row, col, comid, fate)] + [pa.array(np.full(some.sum(), t), mask=mine[some]) for t in (tr, tc)]
        names = [x.split()[0] for x in schema.split(", ")]
        yield from pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in made], names).to_batches(50_000)

    seen = _seen(cells, side, rim)
    return (seen.join(only, ["tr", "tc"], "left_semi") if known else seen).groupBy("tr", "tc").applyInArrow(each, schema)


def clean_streams(cells: DataFrame) -> DataFrame:
    """row, col, comid of the stream cells that stay. Of repeated cells the largest stream counts; an empty grid gives
    no rows.

    Cells are swept in tiles, at first with a halo of cells around, so that a tile guesses what the sweeps do to the cells
    next to it. Where its neighbours found something else, the tile is swept again with what they found, tiles twice as
    wide at first, until no tile's cells change under another's eyes. Fates that fit together everywhere are those of one
    walk over all, and no task holds more than a tile. Only tiles that have to are swept again.
    """
    own = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("comid").cast("long").alias("comid"))
    own = settle(own.groupBy("row", "col").agg(F.max("comid").alias("comid")), "streams")
    densest = own.groupBy(_tile("row", 64), _tile("col", 64)).count().agg(F.max("count")).first()[0]
    if not densest:
        return own
    side = max(2 * RIM, int(64 * sqrt(BAND_CELLS / densest)))
    # Fates of all cells (without a tile), and what the tiles took those around them for.
    guess = settle(_per_tile(own, side, min(HALO, side // 2), "row long, col long, comid long, fate long, tr long, tc long"), "swept")
    fates, taken = guess.where("tr IS NULL").drop("tr", "tc"), guess.where("tr IS NOT NULL").drop("comid")
    edge = lambda c: (F.pmod(c, F.lit(side)) < RIM) | (F.pmod(c, F.lit(side)) >= side - RIM)
    edges = fates.where(edge("row") | edge("col")).select("row", "col", F.col("fate").alias("found"))
    again = taken.join(edges, ["row", "col"]).where("fate <> found").select("tr", "tc").distinct()
    changed = None
    for n in range(1, 1_000_000):
        step = 2 if n <= DOUBLED else 1
        again = settle(again.select(_tile("tr", step).alias("tr"), _tile("tc", step).alias("tc")).distinct(), "again")
        side *= step
        if again.isEmpty():
            break
        now = fates
        if changed is not None:
            now = fates.join(changed.withColumnRenamed("fate", "now"), ["row", "col"], "left").withColumn("fate", F.coalesce("now", "fate")).drop("now")
        found = settle(_per_tile(now, side, RIM, "row long, col long, fate long", again), "found")
        changed = found if changed is None else settle(found.unionByName(changed.join(found, ["row", "col"], "left_anti")), "changed")
        again = _seen(found, side, RIM).where((F.col("tr") != _tile("row", side)) | (F.col("tc") != _tile("col", side))).select("tr", "tc").distinct()
    if changed is not None:
        fates = fates.join(changed.withColumnRenamed("fate", "now"), ["row", "col"], "left").withColumn("fate", F.coalesce("now", "fate"))
    return fates.where(F.col("fate") == STAYS).select("row", "col", "comid")
