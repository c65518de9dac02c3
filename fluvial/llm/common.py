"""What the operators share: the shared folder, written intermediate tables, a bounded membership filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_folder, settle, shared_dir  # noqa: F401

#: Bytes that separate words, and A-Z to a-z, for the word operators (fixed by their contracts).
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def free_name(key: str, made: tuple[str, ...]) -> str:
    """The name of a result's key: the key's own, with underscores after it as long as the result has another column of
    that name."""
    while key in made:
        key += "_"
    return key


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The rows a few at a time, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of space and \\t..\\r; bytes.split() breaks at exactly these."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


#: log2 of the least and the most bits of a membership bitmap (the most: 64 MB), and bits a member.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 29, 16


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, member: Column, bits: int | None = None) -> DataFrame:
    """The rows whose key may be among ``members``; never loses one that is.

    The members are folded to a bitmap of 16 bits each (or of 2^``bits`` in all), which is all that is broadcast. Where
    that would be more than 2^29 bits, the digests of the members are joined instead, so nothing large is broadcast and
    few rows pass in vain.
    """
    bits = bits or max(LEAST_BITS, math.ceil(math.log2(BITS_EACH * max(1, members.count()))))
    if bits > MOST_BITS:
        known = members.select(F.xxhash64(member).alias("__known")).distinct()
        return rows.withColumn("__known", F.xxhash64(key)).join(known, "__known", "left_semi").drop("__known")
    place = F.pmod(F.xxhash64(member), F.lit(1 << bits))
    folded = members.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits")
    )
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    set_bit = "conv(hex(substring(__bits, int(__at div 8) + 1, 1)), 16, 10)::int & shiftleft(1, int(__at % 8)) != 0"
    return (
        rows.withColumns({"__bucket": F.bitmap_bucket_number(spot), "__at": F.bitmap_bit_position(spot)})
        .join(F.broadcast(folded), "__bucket")
        .where(set_bit.replace("conv", "(conv", 1).replace(" != 0", ") != 0"))
        .drop("__bucket", "__at", "__bits")
    )


#: Every ASCII byte that is no letter or digit becomes a space, A-Z become a-z; other bytes stay (fixed by the contracts).
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def summed_vectors(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of ``size`` 64-bit integers, one in each row of the only, binary column.

    They are merged in a tree of executors; the driver gets the last step's few vectors, whatever the number of rows.
    """
    context = rows.sparkSession.sparkContext
    # Where there is no row at all, the zeros are the sum.
    vectors = rows.rdd.map(lambda row: np.frombuffer(row[0], np.int64)).union(context.parallelize([np.zeros(size, np.int64)], 1))
    # A step merges 30 partitions or so, so that few vectors meet in a task or in the driver.
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions(), 30)))
    return vectors.treeReduce(np.add, depth)
