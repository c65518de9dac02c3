"""Variable-capacity best-fit packing of token sequences.

Pieces are placed longest first. A piece goes to the open bin with the least room that still holds it; else a bin is
opened in the permitted length of least cost for a token that it can be expected to hold; at the end each bin shrinks
to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of n tokens: a fixed part, n, and attention's share n * n / ATTENTION.
FIXED_COST, ATTENTION = 96, 65_536
#: Documents that are packed together.
GROUP_ROWS = 20_000


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / ATTENTION


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, tokens) of the pieces of a sequence: full ones of the greatest length, then the rest; one if empty."""
    return [(a, min(most, length - a)) for a in range(0, length, most)] or [(0, 0)]


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of each piece, and each bin's final capacity. Pieces must be sorted, longest first."""
    sizes = sorted(capacities)
    n = len(lengths)
    rising = lengths[::-1]
    upto = [0]
    for x in rising:
        upto.append(upto[-1] + x)
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins, filled, opened = [], [], []
    for i, x in enumerate(lengths):
        at = bisect.bisect_left(room, (x, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            # Of the pieces to come, those that would still fit beside this one can fill the bin.
            best = (float("inf"), 0)
            for c in sizes:
                if c >= x:
                    beside = upto[min(bisect.bisect_right(rising, c - x), n - i - 1)]
                    best = min(best, (cost(c) / max(1, min(c, x + beside)), c))
            left, b = best[1], len(filled)
            filled.append(0)
            opened.append(best[1])
        filled[b] += x
        bins.append(b)
        bisect.insort(room, (left - x, b))
    return bins, [sizes[bisect.bisect_left(sizes, f)] for f in filled]


def pack(items: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place every sequence in bins of the permitted lengths.

    Returns a row a piece: key, piece (from 0), start and n_tokens (its tokens in the sequence), bin_id, capacity (the
    bin's final length). A sequence over the greatest length is cut into pieces; null or negative lengths count as 0,
    and an empty sequence is one piece of 0 tokens in some bin. Only keys and lengths are shuffled. Groups of
    ``group_rows`` rows, dealt by a hash, are packed on their own, so no task holds more than a group, whatever keys
    repeat. An empty table gives no rows.
    """
    name = common.free_name(key, ("piece", "start", "n_tokens", "bin_id", "capacity"))
    kind = items.schema[key].dataType.simpleString()
    most = max(capacities)
    rows = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    parts = max(1, -(-rows.count() // group_rows))
    spot = F.xxhash64("key", "n")
    names = [name, "piece", "start", "n_tokens", "bin_id", "capacity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group = TaskContext.get().partitionId(), 0
        keys, sizes = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            while len(keys) >= 2 * group_rows:
                yield placed(keys[:group_rows], sizes[:group_rows], f"{part}-{group}")
                keys, sizes, group = keys[group_rows:], sizes[group_rows:], group + 1
        if keys:
            yield placed(keys, sizes, f"{part}-{group}")

    def placed(keys: list, sizes: list[int], group_name: str) -> pa.RecordBatch:
        pieces = [(n, i, p, a) for i, size in enumerate(sizes) for p, (a, n) in enumerate(cut(size, most))]
        pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
        bins, capacity = pack_lengths([x[0] for x in pieces], capacities)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[i] for _, i, _, _ in pieces], kind_arrow),
                pa.array([p for _, _, p, _ in pieces], pa.int32()),
                pa.array([a for _, _, _, a in pieces], pa.int64()),
                pa.array([n for n, _, _, _ in pieces], pa.int64()),
                pa.array([f"{group_name}-{b}" for b in bins], pa.string()),
                pa.array([capacity[b] for b in bins], pa.int32()),
            ],
            names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(items.schema[key].dataType)
    # The order inside a part is fixed by its rows, so a second attempt packs alike.
    return (
        rows.repartition(parts, spot)
        .sortWithinPartitions(spot, "key", "n")
        .mapInArrow(run, f"`{name}` {kind}, piece int, start long, n_tokens long, bin_id string, capacity int")
    )


def with_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_tokens: words between runs of space and \\t..\\r in the whole text; 0 for null."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.withColumn("n_tokens", words.cast("long"))
