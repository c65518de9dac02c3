"""Near-duplicate documents by a multi-index Hamming join over b-bit minwise signatures.

A signature is k minwise hashes of b bits. It is split into m chunks of r hashes. Two signatures that differ in at most
2m - 1 hashes have, by the pigeonhole, a chunk that differs in one hash at most; so a chunk is looked up once for each
of its hashes left out, and every pair within that distance meets under some key. Pairs that meet are confirmed on their
full shingle sets. Only the components of the links are asked for, so links inside a component that is known already
are not looked for: each bucket is first tied to few of its members, and what is still apart is then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 12
#: Rows and shingles of a side of a block of comparisons; buckets up to the last size are compared many at once.
TILE, ITEMS, SMALL = 4096, 1_000_000, 64
#: Rounds of ties after the first, while one in ten of those that are tied is linked.
MOST_ROUNDS = 6
#: Pairs that are confirmed together, and pairs of small buckets that are looked at in one step (some 1 KB each).
PAIRS, STEP = 200, 20_000


@dataclass(frozen=True)
class Plan:
    """What a near-duplicate is, and the index that finds it."""

    words: int = 5
    percent: int = 80
    seed: int = 23

    @property
    def shape(self) -> tuple[int, int]:
        """(m, r): the longest chunks for which pairs at the threshold stay within the distance by five deviations."""
        share = self.percent / 100
        for r in (5, 4, 3):
            m = 60 // r
            k = m * r
            if 2 * m - 1 >= k * (1 - share) + 5 * np.sqrt(k * share * (1 - share)):
                return m, r
        return 30, 2

    @property
    def distance(self) -> int:
        return 2 * self.shape[0] - 1

    @property
    def hashes(self) -> int:
        return self.shape[0] * self.shape[1]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; with fewer words, of the whole sequence."""
    parts = common.words_of(text)
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(each) - size + 1
    with np.errstate(over="ignore"):
        rolled = each[:n] + np.uint64(size)
        for j in range(1, size):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


def signature(items: np.ndarray, plan: Plan) -> np.ndarray:
    """k values of b bits: parts of the least products of the set's hashes with odd numbers."""
    rng = np.random.default_rng(plan.seed)
    factors = rng.integers(1, 1 << 63, plan.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(plan.hashes, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(items), 1024):
            least = np.minimum(least, (items[None, a : a + 1024] * factors[:, None]).min(axis=1))
    return ((least >> np.uint64(16)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, plan: Plan) -> np.ndarray:
    """The k lookup keys of each signature: a chunk with one of its hashes left out, and which."""
    m, r = plan.shape
    chunks = signatures.reshape(len(signatures), m, r).astype(np.int64)
    out = np.empty((len(signatures), m, r), np.int64)
    for left_out in range(r):
        key = np.broadcast_to(np.arange(m, dtype=np.int64) * r + left_out, (len(signatures), m)).copy()
        for j in range(r):
            if j != left_out:
                key = key << BITS | chunks[:, :, j]
        out[:, :, left_out] = key
    return out.reshape(len(signatures), m * r)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _reached(edges: DataFrame) -> DataFrame:
    """node, comp for the nodes of edges (a, b): the least node that they reach. Labels move along edges and then jump to
    their label's label, so rounds grow with the logarithm of the longest path; each round is written, none is gathered."""
    both = common.settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp"))
    labels = common.settle(labels, "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = moved.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = common.settle(moved.join(up, "comp").select("node", "old", F.col("up").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            return labels


def components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp: the least node of a component) after the links (a, b) between nodes; the links are brought
    down to links between components first, and those inside one fall away."""
    of = lambda c, to: comps.select(F.col("node").alias(c), F.col("comp").alias(to))
    between = links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    up = _reached(between).select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return comps.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))


def _mixed(members: DataFrame, order: Column) -> DataFrame:
    """``members`` (key, node, n, comp) of buckets with several components, with what a bucket has: its largest component
    (major) and that one's first member in ``order`` (hub); whether it is wide, and then its blocks of all members and
    of those outside the major. Blocks hold TILE rows and ITEMS shingles on average."""
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min_by("node", order).alias("h"))
    most = F.struct("c", "comp")
    of = parts.groupBy("key").agg(F.max_by("comp", most).alias("major"), F.max_by("h", most).alias("hub"), F.sum("c").alias("size"), F.sum("w").alias("items"), F.max("c").alias("c"), F.max_by("w", most).alias("w"))
    count = lambda rows, items: F.ceil(F.greatest(rows / TILE, items / ITEMS, F.lit(1))).cast("int")
    of = of.where("size > c").select(
        "key", "major", "hub", ((F.col("size") > SMALL) | (F.col("items") > ITEMS)).alias("wide"),
        count(F.col("size"), F.col("items")).alias("blocks"), count(F.col("size") - F.col("c"), F.col("items") - F.col("w")).alias("rests"),
    )
    return members.join(of, "key")


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("unit").sortWithinPartitions("unit")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole units of rows that come sorted by their first column; a unit may run over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(unit)) + 1
        if held and held[-1].column(0)[0].as_py() != unit[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[0]))])
            if cuts[-1] > cuts[0]:
                yield pa.Table.from_batches([batch.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))])
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _signatures(column: pa.ChunkedArray, plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, plan.hashes)


def _meet(x: np.ndarray, y: np.ndarray, place: np.ndarray, plan: Plan) -> np.ndarray:
    """Where rows of keys x and y are equal at ``place`` and at none before it: a pair counts in its first bucket only."""
    return (x == y).argmax(axis=1) == place


def _finder(plan: Plan):
    """Marks which rows of a bucket have anything to be compared with: a row (unit, node, left) for a member that has a
    member of another component within the distance, under the first key that the two share. Never a row a pair.

    Columns: unit, place (of the key among a signature's keys), node, n, comp, left, sig. Left rows are held against
    the others of their unit; in a block of a wide bucket, against right rows only.
    """
    names = ["unit", "node", "left"]

    def emit(unit: np.ndarray, node: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(node), pa.array(left)], names)

    def close(n1, n2, c1, c2):
        return (c1 != c2) & (100 * np.minimum(n1, n2) >= plan.percent * np.maximum(n1, n2))

    def many(unit, place, node, n, comp, left, sig, start, size) -> Iterator[pa.RecordBatch]:
        """All small units of one size in one step."""
        for s in np.unique(size):
            i, j = np.triu_indices(s, 1)
            first = start[size == s]
            for part in np.array_split(first, max(1, len(first) * len(i) // STEP)):
                x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                near = close(n[x], n[y], comp[x], comp[y])
                x, y = x[near], y[near]
                near = (sig[x] != sig[y]).sum(axis=1) <= plan.distance
                x, y = x[near], y[near]
                if len(x):
                    near = _meet(chunk_keys(sig[x], plan), chunk_keys(sig[y], plan), place[x], plan)
                    at = np.unique(np.concatenate((x[near], y[near])))
                    yield emit(unit[at], node[at], left[at])

    def one(unit, place, node, n, comp, left, sig) -> Iterator[pa.RecordBatch]:
        """A block of a wide bucket: its left rows against its right rows."""
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        keys, other = chunk_keys(sig[x], plan), chunk_keys(sig[y], plan)
        met, taken = np.zeros(len(y), bool), np.zeros(len(x), bool)
        for i, own in enumerate(x):
            at = np.flatnonzero(close(n[own], n[y], comp[own], comp[y]))
            at = at[(sig[own] != sig[y[at]]).sum(axis=1) <= plan.distance]
            at = at[_meet(keys[i], other[at], place[own], plan)]
            met[at] = True
            taken[i] = len(at) > 0
        at = np.concatenate((x[taken], y[met]))
        if len(at):
            yield emit(unit[at], node[at], left[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            unit, place, node, n, comp, left, wide = (table.column(c).to_numpy() for c in ("unit", "place", "node", "n", "comp", "left", "wide"))
            sig = _signatures(table.column("sig"), plan)
            start = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1))
            size = np.diff(np.concatenate((start, [len(unit)])))
            small = ~wide[start].astype(bool)
            yield from many(unit, place, node, n, comp, left, sig, start[small & (size > 1)], size[small & (size > 1)])
            for a, m in zip(start[~small], size[~small]):
                yield from one(*(v[a : a + m] for v in (unit, place, node, n, comp, left.astype(bool), sig)))

    return run


def _linker(plan: Plan):
    """Confirms on full sets what a unit's marked rows have in common, and joins their components as it goes: at most a
    link less than it has rows leaves a unit, whatever the number of its pairs.

    Columns: unit, node, comp, left, items. Shares of all others are counted at once, through a list of the rows that
    hold an item.
    """

    def links(node: np.ndarray, comp: np.ndarray, left: np.ndarray, items: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(v) for v in items])
        flat, row = np.concatenate(items), np.repeat(np.arange(len(items)), sizes)
        item = np.unique(flat, return_inverse=True)[1].astype(np.int32)
        order = np.argsort(item, kind="stable")
        holders, first = row[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(item))))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        _, own = np.unique(comp, return_inverse=True)
        out = []
        for i in np.flatnonzero(left):
            if (own == own[i]).all():
                break
            mine = item[ends[i] : ends[i + 1]]
            start, count = first[mine], first[mine + 1] - first[mine]
            total = int(count.sum())
            at = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
            both = np.bincount(holders[at], minlength=len(items))
            linked = np.flatnonzero((100 * both >= plan.percent * (sizes[i] + sizes - both)) & (own != own[i]))
            for c in np.unique(own[linked]):  # one link a component is enough
                j = linked[own[linked] == c][0]
                out.append((int(node[i]), int(node[j])))
                own[own == c] = own[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            unit, node, comp, left = (table.column(c).to_numpy() for c in ("unit", "node", "comp", "left"))
            found = []
            start = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]))
            items = table.column("items")
            for a, b in zip(start[:-1], start[1:]):
                if b - a > 1:
                    sets = [np.frombuffer(v, np.uint64) for v in items.slice(a, b - a).to_pylist()]
                    found += links(node[a:b], comp[a:b], left[a:b].astype(bool), sets)
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of near-duplicate links: key, n_shingles, component_id, kept; one row a document.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of word shingles. component_id is the
    least key that links reach, the document's own included; kept marks where both are equal. A text without words, or
    null, has an empty set and is linked with nothing. Equal sets are one class from the start, so copies cost nothing
    more. A null key gets the least key of its component (null if there is none); repeated rows share theirs. An empty
    table gives no rows. Other columns of ``docs`` are not read. A key of the name of another column of the result gets a
    trailing underscore.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            size, mark, sig = [], [], []
            for t in batch.column(1).to_pylist():
                items = shingle_set(t, plan.words)
                size.append(len(items))
                mark.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                sig.append(signature(items, plan).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "mark", "sig"])

    signed = common.settle(rows.mapInArrow(sign, f"id {kind}, n long, mark binary, sig binary"), "signed")
    classes = signed.where("mark IS NOT NULL").groupBy("mark", "n", "sig").agg(F.min("id").alias("head"))
    classes = common.settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, plan.hashes)
                keys = chunk_keys(sigs, plan)
                again = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                rest = [part.column(c).take(again) for c in part.schema.names if c != "sig"]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *rest], ["key", *[c for c in part.schema.names if c != "sig"]])

    keyed = classes.select("node", "sig").mapInArrow(index, "key long, node long")
    # The first ties of a bucket: its first and last member in one of three orders, so a node meets several hubs, but
    # not as many as it has keys.
    pick = F.xxhash64("node", F.shiftright("key", BITS * (plan.shape[1] - 1)) % 3)
    hubs = keyed.groupBy("key").agg(F.min_by("node", pick).alias("hub"), F.max_by("node", pick).alias("hub2"), F.count("*").alias("size")).where("size > 1")
    ties = common.settle(keyed.join(hubs.select("key", "hub", "hub2"), "key").groupBy("node", "hub", "hub2").agg(F.count("*").alias("times")), "ties")
    active = ties.select("node").distinct()
    active = common.settle(classes.join(active, "node", "left_semi"), "active")

    # Full sets of the classes that meet another one.
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            sets = [shingle_set(t, plan.words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["id", "mark", "items"])

    found = common.maybe_in(rows.where("id IS NOT NULL"), F.col("id"), active, F.col("head"))
    lone = common.maybe_in(rows.where("id IS NULL"), F.lit(0), active.where("head IS NULL"), F.lit(0))
    made = found.unionByName(lone).mapInArrow(collect, f"id {kind}, mark binary, items binary")
    sets = made.join(active.select("mark", "head", "node"), "mark").where(F.col("id").eqNullSafe(F.col("head"))).select("node", "items").dropDuplicates(["node"])
    sets = common.settle(sets, "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (hub, a, b) that are linked. Pairs are dealt to tiles by a hub; a hub with many is dealt to
        several. A tile's nodes are sent to it once each."""
        pairs = common.settle(pairs, "pairs")
        tiles = max(1, pairs.count() // PAIRS)
        large = pairs.groupBy("hub").agg(F.count("*").alias("m")).where(F.col("m") > PAIRS)
        blocks = large.select("hub", F.ceil(F.sqrt(F.col("m") / PAIRS)).cast("int").alias("w"))
        block = lambda c: F.pmod(F.xxhash64(c), F.col("w"))
        tile = F.when(F.col("w").isNull(), F.pmod(F.xxhash64("hub"), F.lit(tiles))).otherwise(F.xxhash64("hub", block("a"), block("b")))
        pairs = pairs.join(blocks, "hub", "left").select(tile.alias("tile"), "a", "b")
        needed = pairs.select("tile", F.col("a").alias("node")).unionByName(pairs.select("tile", F.col("b").alias("node"))).distinct()
        needed = needed.join(sets, "node").select(F.col("tile").alias("of_tile"), "node", "items")

        def check(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            items = {n: np.frombuffer(s, np.uint64) for n, s in zip(right["node"], right["items"])}
            kept = [(a, b) for a, b in zip(left["a"], left["b"]) if similar(items[a], items[b], plan.percent)]
            return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

        return common.settle(pairs.groupBy("tile").cogroup(needed.groupBy("of_tile")).applyInPandas(check, "a long, b long"), "confirmed")

    sigs = active.select("node", "n", "sig", "mark")
    near_share = f"100 * least(n, hn) >= {plan.percent} * greatest(n, hn)"

    @F.pandas_udf(T.IntegerType())
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(a), plan.hashes) for s in (a, b))
        return pd.Series((x != y).sum(axis=1).astype(np.int32))

    def nearest_hubs(both: DataFrame) -> DataFrame:
        """Of the pairs (node, hub) the three nearest of a node within the distance, as (hub, a, b)."""
        measured = (
            both.join(sigs.select("node", "n", "sig"), "node")
            .join(sigs.select(F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("sig").alias("hsig")), "hub")
            .where(near_share)
            .select("node", "hub", apart("sig", "hsig").alias("d"))
            .where(F.col("d") <= plan.distance)
        )
        first = measured.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("d", "hub"))).where("i <= 3")
        return common.settle(first.select("hub", F.col("node").alias("a"), F.col("hub").alias("b")), "nearest")

    both = ties.select("node", F.explode(F.array_distinct(F.array("hub", "hub2"))).alias("hub")).where("node <> hub").distinct()
    nearest = nearest_hubs(both)
    links = confirm(nearest)

    # Buckets that hold several components are tied again, each time by another member of their largest one: what is
    # linked with a good part of a group joins it within a few rounds, a tie a member and key.
    alone = lambda rows: rows.select("node", F.col("node").alias("comp"))
    comps = common.settle(components(alone(sigs), links), "comps")
    inside = sigs.select("node", "sig").mapInArrow(index, "key long, node long")
    spot = lambda salt: F.xxhash64("node", F.lit(salt))
    for salt in range(MOST_ROUNDS + 1):
        inside = _mixed(inside.select("key", "node").join(sigs.select("node", "n").join(comps, "node"), "node"), spot(salt))
        inside = common.settle(inside, "inside")
        if salt == MOST_ROUNDS:
            break
        near = nearest_hubs(inside.where("comp <> major").select("node", "hub").distinct())
        more = confirm(near)
        comps = common.settle(components(comps, more), "comps")
        apart_yet, gained = near.select("a").distinct().count(), more.count()
        if gained * 10 < apart_yet or gained == 0:
            inside = common.settle(_mixed(inside.select("key", "node").join(sigs.select("node", "n").join(comps, "node"), "node"), spot(salt)), "inside")
            break

    # What is apart still is compared in full, in its buckets. First by signatures, to see which rows have to meet.
    place = F.shiftright("key", BITS * (plan.shape[1] - 1)).cast("int").alias("place")
    inside = inside.join(sigs.select("node", "sig"), "node")
    rows = inside.where("NOT wide").select(F.xxhash64("key").alias("unit"), place, "node", "n", "comp", (F.col("comp") != F.col("major")).alias("left"), "wide", "sig")
    at = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    wide = inside.where("wide")
    first = wide.where("comp <> major").withColumns({"x": at % F.col("rests"), "left": F.lit(True)}).withColumn("y", blocks("blocks"))
    second = wide.withColumns({"y": at % F.col("blocks"), "left": F.lit(False)}).withColumn("x", blocks("rests"))
    for side in (first, second):
        rows = rows.unionByName(side.select(F.xxhash64("key", "x", "y").alias("unit"), place, "node", "n", "comp", "left", "wide", "sig"))
    marked = _by_unit(rows).mapInArrow(_finder(plan), "unit long, node long, left boolean")
    marked = common.settle(marked, "marked")
    full = _by_unit(marked.join(comps, "node").join(sets, "node").select("unit", "node", "comp", "left", "items"))
    comps = components(comps, common.settle(full.mapInArrow(_linker(plan), "a long, b long"), "found"))

    named = classes.select("node", "mark", "head").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = common.settle(named, "named")
    least = named.groupBy("comp").agg(F.min("head").alias("component_id"))
    # Texts without words have no class to look up; they take no part in the join.
    found = signed.where("mark IS NOT NULL").select("id", "n", "mark").join(named.join(least, "comp").select("mark", "component_id"), "mark")
    result = found.select("id", "n", "component_id").unionByName(signed.where("mark IS NULL").select("id", "n", F.col("id").alias("component_id")))
    component = F.col("component_id")
    name = common.free_name(key, ("n_shingles", "component_id", "kept"))
    return result.select(F.col("id").alias(name), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the least key. Rows with a null key stay only where
    their component has no other key; repeated rows of a kept key stay."""
    marked = near_duplicates(docs, plan, key, text)
    kept = marked.where("kept").select(F.col(marked.columns[0]).alias("__kept")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("__kept")), "left_semi")
