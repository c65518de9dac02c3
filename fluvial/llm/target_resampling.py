"""Importance resampling towards a target distribution of hashed word features.

A first pass counts the features of corpus and target, an Arrow batch at a time: np.bincount gives a partition's vector
of buckets, and the vectors are merged in a tree. A bucket's gain is the log ratio of its two smoothed frequencies. The
second pass gathers the gains, which are broadcast (one 64-bit integer a bucket), and sums them by document with
np.bincount. Documents are drawn without replacement by Gumbel noise on their mean gain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common


@dataclass(frozen=True)
class Plan:
    """buckets: of the hashed features. percent: of the documents with least_words words at least that are drawn.
    seed: of the noise."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def feature_hashes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of each word and of each two consecutive words joined by a space: a pair's goes on from its first word's."""
    if not words:
        return np.zeros(0, np.int64)
    single = list(map(zlib.crc32, words))
    pairs = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), single))
    return np.concatenate((np.array(single, np.int64), np.fromiter(pairs, np.int64, len(words) - 1)))


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = Plan.buckets) -> np.ndarray:
    """How many features of all texts of ``rows`` fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(feature_hashes(common.plain_words(value.as_py())) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return common.summed_vectors(rows.select(text).mapInArrow(run, "counts binary"), buckets)


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the natural log of the ratio of the smoothed frequencies of a bucket, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features and weight, the mean gain of a text's features, rounded down (0 without features)."""
    name = common.free_name(key, ("n_features", "weight"))
    kind, sent = docs.schema[key].dataType, docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.astype(np.float64)
        for batch in common.in_slices(batches, 200):
            hashes = [feature_hashes(common.plain_words(value.as_py())) for value in batch.column(1)]
            sizes = np.array([len(h) for h in hashes], np.int64)
            owner = np.repeat(np.arange(len(hashes)), sizes)
            # Sums of whole numbers, exact up to 2**53.
            sums = np.bincount(owner, weights=table[np.concatenate(hashes) % len(table)], minlength=len(hashes)).astype(np.int64)
            columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))]
            yield pa.RecordBatch.from_arrays(columns, [name, "n_features", "weight"])

    return docs.select(key, text).mapInArrow(run, f"`{name}` {kind.simpleString()}, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a Gumbel deviate that the key and the seed give, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number the rows from 1 in an order, without bringing them together: ranges are sorted each, and written with the
    place in its range; a range begins where those before it end. Only the numbers of rows a range are broadcast."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = common.settle(sorted_rows, "ranges")
    part = F.shiftrightunsigned("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(rank, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__start")


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Draw documents so that their features become more like the target's.

    Returns every document: key (with underscores after its name where that is taken), n_features, weight (mean gain),
    score (weight and noise) and rank: 1, 2, 3, ... for those drawn, the highest scores first and equal ones by key;
    null for the others. Texts that are null, empty or without words have no features, a weight of 0, and are never
    drawn. Rows of equal key have equal noise and count each; a null key's noise is that of an empty one, and it comes
    first of equal scores. An empty table gives no rows, an empty target leaves the smoothing alone; other columns are
    not read. Per document, 40 bytes or so are shuffled; texts never are.
    """
    gains = gains_of(bucket_counts(docs, text, plan.buckets), bucket_counts(target, target_text, plan.buckets))
    own = "__key"
    weighed = weigh(docs.select(F.col(key).alias(own), F.col(text).alias("__text")), gains, own, "__text")
    scored = common.settle(weighed.withColumn("score", F.col("weight") + gumbel(F.col(own), plan.seed)), "weighed")
    enough = F.col("n_features") >= 2 * plan.least_words - 1
    drawn = scored.where(enough).count() * plan.percent // 100
    rows = ranked(scored, [enough.desc(), F.col("score").desc(), F.col(own).asc()], "rank")
    name = common.free_name(key, ("n_features", "weight", "score", "rank"))
    return rows.select(F.col(own).alias(name), "n_features", "weight", "score", F.when(enough & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
