"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected by several random rotations, shifted, and numbered along a Hilbert curve. Spark range-partitions
each order; rows of neighbouring blocks of an order are compared exactly, and the best over all orders are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Curves, projected dimensions, bits a dimension (their product under 63), least rows a block.
CURVES, DIMS, BITS, BLOCK = 24, 6, 10, 768
#: A window on each side of a row of an order holds at least this part of the rows; blocks above the most rows a block are
#: not made, more of them are compared instead. Pairs of rows scored at once in a task.
PART, MOST_BLOCK, TILE = 64, 16_384, 4_000_000


def window(n: int, least: int = BLOCK) -> tuple[int, int]:
    """Rows a block, and blocks compared on each side of a row's own, for n distinct vectors.

    A window of constant size loses neighbours as the table grows: vectors that fill their dimensions evenly stand, along
    a curve, at distances from their neighbours that are a share of the table. So the window is a share of it too.
    """
    wanted = max(least, -(-n // PART))
    block = min(wanted, max(least, MOST_BLOCK))
    return block, -(-wanted // block)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of integer cells along the Hilbert curve (int64), by the transpose form of its index.

    First undo the excess rotations from the highest bit down, then turn the result from Gray code, then weave the bits.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    place = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | ((x[i] ^ turn) >> b & 1)
    return place


def curve_places(unit: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS, seed: int = 17) -> np.ndarray:
    """Places of unit vectors along one curve: a random projection and shift, both fixed by (seed, curve)."""
    n, size = unit.shape
    rng = np.random.default_rng((seed, curve, size))
    d = min(dims, size)
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0][:, :d] if size <= 256 else rng.standard_normal((size, d)) / np.sqrt(size)
    # Projections of unit vectors have a deviation near 1/sqrt(size); five of them on each side, and a random shift.
    reach = min(1.0, 5.0 / np.sqrt(size))
    spot = (unit @ axes + reach) / (2 * reach) * 0.75 + rng.random(d) * 0.25
    return hilbert((np.clip(spot, 0, 1 - 1e-12) * (1 << bits)).astype(np.int64), bits)


def _usable(vectors: list) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in vectors:
        a = None if v is None or len(v) == 0 or any(x is None for x in v) else np.asarray(v, np.float64) + 0.0
        out.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for equal rows wherever they stand."""
    scale = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    x, y = a / scale[0], b / scale[1]
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def nearest(vectors: DataFrame, is_query: "F.Column | str", k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The k nearest rows by cosine found for each query row: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's own key; ties go to the smaller key; fewer than k rows give fewer
    results. Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or
    candidate; vectors of different lengths are not compared. Equal vectors are one class with its k + 1 smallest keys,
    which is all that a result can need of it, so large groups of copies do not fill the blocks. Repeated rows count
    once; a key that has several vectors is listed once, by its best score, and asks with each of them. Rows with a null
    key take no part. An empty table gives no rows.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _usable(batch.column(1).to_pylist())
            at = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i].tobytes() for i in at], pa.binary()), batch.column(2).take(pa.array(at, pa.int64()))],
                ["id", "v", "q"],
            )

    packed = common.settle(rows.mapInArrow(pack, "id long, v binary, q boolean"), "vectors")
    # Copies: the k + 1 smallest keys of each distinct vector; the rank limit is applied before the shuffle too.
    order = Window.partitionBy("v").orderBy("id")
    few = packed.select("v", "id").distinct().select("v", "id", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = packed.where("q").select("v", "id").distinct()
    classes = classes.join(asked.select("v").distinct().withColumn("q", F.lit(True)), "v", "left").select(F.col("ids")[0].alias("c"), "v", "ids", F.coalesce("q", F.lit(False)).alias("q"))
    classes = common.settle(classes, "classes")
    n = classes.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(b) for b in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                m = np.stack([np.frombuffer(raw[i]) for i in at])
                m = m / np.abs(m).max(axis=1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                picked = [c.take(pa.array(at)) for c in batch.columns]
                for curve in range(curves):
                    spot = curve_places(m, curve, dims, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), int(size) // 8), pa.int32()), pa.array(np.full(len(at), curve), pa.int32()), pa.array(spot), *picked],
                        ["dim", "curve", "place", "c", "v", "ids", "q"],
                    )

    kinds = "c long, v binary, ids array<long>, q boolean"
    block, reach = window(n, block)
    parts = max(1, min(20_000, n * curves // 50_000))
    ordered = classes.select("c", "v", "ids", "q").mapInArrow(place, f"dim int, curve int, place long, {kinds}").repartitionByRange(parts, "dim", "curve", "place", "c").sortWithinPartitions("dim", "curve", "place", "c")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part), pa.int32()), pa.array(np.arange(seen, seen + m)), *batch.columns], ["part", "at", "dim", "c", "v", "ids", "q"])
            seen += m

    numbered = common.settle(ordered.select("dim", "c", "v", "ids", "q").mapInArrow(number, f"part int, at long, dim int, {kinds}"), "order")
    counts = dict(numbered.groupBy("part").count().collect())  # one number a range partition
    first, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, first))
        first += counts[p]
    if not offsets:
        return numbered.select(F.col("c").alias("query_id"), F.lit(1).alias("rank"), F.col("c").alias("vec_id"), F.lit(0.0).alias("score"))
    starts = packed.sparkSession.createDataFrame(offsets, "part int, first long")
    blocks = numbered.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("first") + F.col("at")) / block)).drop("part", "at", "first")
    near = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach))
    queries = blocks.where("q").select(near.alias("near"), F.col("c").alias("qc"), F.col("v").alias("qv"), F.col("dim").alias("qdim"))

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = left.rename(columns={"qc": "c", "qv": "v", "qdim": "dim"})
        for dim in set(left["dim"]) & set(right["dim"]):
            a, b = left[left["dim"] == dim], right[right["dim"] == dim]
            ac, bc = a["c"].to_numpy(), b["c"].to_numpy()
            _, once = np.unique(bc, return_index=True)  # a class stands in a block twice where two curves meet
            b, bc = b.iloc[once], bc[once]
            x, y = np.stack([np.frombuffer(v) for v in a["v"]]), np.stack([np.frombuffer(v) for v in b["v"]])
            xu, yu = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
            xu, yu = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (xu, yu))
            depth, tile = min(k, len(bc)), max(1, TILE // len(bc))
            for i in range(len(ac)):
                if i % tile == 0:
                    score = xu[i : i + tile] @ yu.T
                    score[ac[i : i + tile, None] == bc[None, :]] = -9.0
                own = score[i % tile]
                least = np.partition(own, len(bc) - depth)[len(bc) - depth]
                at = np.flatnonzero((own >= least - 1e-9) & (own > -5))
                exact = _cosine(np.broadcast_to(x[i], (len(at), x.shape[1])), y[at])
                best = np.lexsort((bc[at], -exact))[:k]
                out += zip([ac[i]] * len(best), bc[at[best]], exact[best], b["ids"].iloc[at[best]])
        return pd.DataFrame(out, columns=["c", "other", "score", "ids"], dtype=object)

    found = queries.groupBy("near").cogroup(blocks.select("block", "c", "v", "dim", "ids").groupBy("block")).applyInPandas(compare, "c long, other long, score double, ids array<long>")
    best = Window.partitionBy("c").orderBy(F.desc("score"), "other")
    found = found.groupBy("c", "other").agg(F.first("score").alias("score"), F.first("ids").alias("ids")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)

    @F.pandas_udf(T.DoubleType())
    def self_score(v: pd.Series) -> pd.Series:
        return v.map(lambda b: float(_cosine(np.frombuffer(b)[None, :], np.frombuffer(b)[None, :])[0]))

    own = classes.where("q").select("c", self_score("v").alias("score"), "ids")
    pool = found.select("c", "score", F.explode("ids").alias("vec_id")).unionByName(own.select("c", "score", F.explode("ids").alias("vec_id")))
    pool = pool.groupBy("c", "vec_id").agg(F.max("score").alias("score"))
    # Of a class's pool, the k + 1 best hold the k best for any query in it; copies of a query are dealt by key.
    pool = pool.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    listed = pool.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    members = asked.join(classes.where("q").select("v", "c"), "v").select(F.col("id").alias("query_id"), "c")
    kept = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    listed = members.join(listed, "c").select("query_id", F.explode(kept).alias("x")).select("query_id", "x.vec_id", "x.score")
    # A key with several vectors has several lists.
    listed = listed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
