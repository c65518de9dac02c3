"""Canonical exact digests of documents: Unicode normalisation, case and whitespace folding, then 128-bit xxhash.

Documents with equal digests are one bucket; inside it the canonical bytes are compared, so a hash collision cannot
join different texts.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common


def canonical(text: str | None) -> str:
    """NFKC, case folding, NFKC again (folding can undo it), each run of white space one space, none at the ends."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(text: str | None, bits: int = 128) -> str:
    """Lower-case hex xxh3 of the canonical text; ``bits`` under 128 shortens it (to test collisions)."""
    full = xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))
    return full[: bits // 4]


def with_digest(docs: DataFrame, text: str = "text", bits: int = 128, name: str = "digest") -> DataFrame:
    """``docs`` and a digest column after its own."""
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([digest(t, bits) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*kept, name])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(name, T.StringType())]))


def collided_digests(docs: DataFrame, text: str = "text", bits: int = 128) -> DataFrame:
    """Digests whose bucket holds more than one canonical text (column digest).

    Only texts whose digest may occur twice are shuffled: a bitmap of fixed size picks them at the scan. Each task sends
    the least and the greatest canonical text of a digest, so a bucket of copies, however large, costs two texts a task.
    """
    marks = with_digest(docs.select(text), text, bits).select("digest")
    twice = common.settle(marks.groupBy("digest").count().where("count > 1").select("digest"), "digests")
    rows = common.maybe_in(with_digest(docs.select(text), text, bits), F.col("digest"), twice, F.col("digest"))

    def canon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [canonical(t).encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], ["digest", "plain"])

    compared = rows.select("digest", text).mapInArrow(canon, "digest string, plain binary")
    return compared.groupBy("digest").agg(F.min("plain").alias("a"), F.max("plain").alias("b")).where("a != b").select("digest")


def fingerprints(docs: DataFrame, text: str = "text", bits: int = 128, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint: equal exactly where the canonical texts are equal.

    A null text counts as empty. Every row keeps its columns and gets one; ties and repeated rows share theirs; an empty
    table gives no rows. Collisions are a handful at most with 128 bits and are told apart by a second digest.
    """
    return _apart(with_digest(docs, text, bits, name), docs, text, bits, [(name, text)])


@F.pandas_udf(T.StringType())
def _sha_of_canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(canonical(t).encode("utf-8", "surrogatepass")).hexdigest())


def _apart(marked: DataFrame, docs: DataFrame, text: str, bits: int, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mend the digest columns of ``pairs`` (digest column, its text column) where buckets of ``docs`` have collided."""
    collided = common.settle(collided_digests(docs, text, bits), "collided")
    if collided.isEmpty():
        return marked
    hit = collided.select(F.col("digest").alias("__hit"))
    for mark, of in pairs:
        full = F.concat_ws("-", F.col(mark), _sha_of_canonical(F.col(of)))
        marked = marked.join(hit, F.col(mark) == F.col("__hit"), "left").withColumn(mark, F.when(F.col("__hit").isNotNull(), full).otherwise(F.col(mark))).drop("__hit")
    return marked


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """key, fingerprint, group_id (least key of the canonical text) and group_size, one row a document."""
    marked = fingerprints(docs.select(key, text), text, bits).select(key, "fingerprint")
    groups = marked.groupBy("fingerprint").agg(F.min(key).alias("group_id"), F.count("*").alias("group_size"))
    return marked.join(groups, "fingerprint")


#: Most ranges that the documents are cut into for their successors; beyond them, ranges grow and their windows spill.
MOST_RANGES = 200_000


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128, rows_a_range: int = 3_000) -> DataFrame:
    """key, text, fingerprint, next_text, next_fingerprint: the document that follows by descending key.

    After the last comes the first; a single document follows itself. Null keys come last, equal keys in the order of
    their texts. No global window: quantiles of a hash's choice of keys cut the keys into ranges, the first document of
    each range is also sent to the range before it, and each range is a window of its own. Keys of any kind that can be
    ordered; the cuts only decide how even the ranges are.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = rows.count()
    parts = max(1, min(MOST_RANGES, n // rows_a_range))
    cuts: list = []
    if parts > 1:
        share = min(1.0, 10 * parts / n)  # some ten keys a range
        some = rows.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("key").distinct()
        known = [r[0] for r in some.orderBy("key").collect()]
        cuts = sorted({known[len(known) * i // parts] for i in range(1, parts)}) if known else []

    def range_of(keys: list) -> list[int]:
        return [len(cuts) if k is None else len(cuts) - bisect.bisect_left(cuts, k) for k in keys]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for k, p in zip(keys := batch.column(0).to_pylist(), range_of(keys)):
                if p not in seen or seen[p] is None or (k is not None and k > seen[p]):
                    seen[p] = k
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), batch.schema.field(0).type)], ["part", "key"])

    kind = docs.schema[key].dataType.simpleString()
    firsts = dict(rows.select("key").mapInArrow(heads, f"part int, key {kind}").groupBy("part").agg(F.max("key")).collect())
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("halo", T.BooleanType()), *rows.schema.fields, T.StructField("fingerprint", T.StringType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = range_of(batch.column(0).to_pylist())
            marks = pa.array([digest(t, bits) for t in batch.column(1).to_pylist()], pa.string())
            again = [i for i, (k, p) in enumerate(zip(batch.column(0).to_pylist(), part)) if k == firsts[p]]
            columns = [pa.array(part, pa.int32()), pa.array([False] * len(part)), *batch.columns, marks]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            if again:
                at = pa.array(again)
                sent = [pa.array([before[part[i]] for i in again], pa.int32()), pa.array([True] * len(again)), *[c.take(at) for c in (*batch.columns, marks)]]
                yield pa.RecordBatch.from_arrays(sent, schema.names)

    window = Window.partitionBy("part").orderBy("halo", F.desc_nulls_last("key"), "text")
    return (
        rows.mapInArrow(deal, schema)
        .select("*", F.lead("text").over(window).alias("next_text"), F.lead("fingerprint").over(window).alias("next_fingerprint"))
        .where("NOT halo")
        .select(F.col("key").alias(key), F.col("text").alias(text), "fingerprint", "next_text", "next_fingerprint")
    )


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited text, and whether they are equal.

    Edited: the last third (rounded down) of the code points replaced by the first as many, or all, of the next
    document. A likeness of exact digests is 1.0 where they are equal, else 0.0.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, __text string, __edited string"
    rows = docs.select(key, text)
    collided = common.settle(collided_digests(rows, text, bits), "collided")
    keep = not collided.isEmpty()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, texts, marks, following, following_marks = (c.to_pylist() for c in batch.columns)
            texts, following = [t or "" for t in texts], [t or "" for t in following]
            edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following)]
            made = [digest(e, bits) for e in edited]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    batch.column(2),
                    pa.array(made, pa.string()),
                    pa.array([float(a == b) for a, b in zip(marks, made)], pa.float64()),
                    pa.array([float(a == b) for a, b in zip(marks, following_marks)], pa.float64()),
                    pa.array(texts if keep else [None] * len(texts), pa.string()),
                    pa.array(edited if keep else [None] * len(texts), pa.string()),
                ],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "__text", "__edited"],
            )

    out = with_successor(rows, key, text, bits).mapInArrow(edit, schema)
    if keep:
        out = _apart(out, rows, text, bits, [("fingerprint", "__text"), ("edited_fingerprint", "__edited")])
        out = out.withColumn("near_edited", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double"))
    return out.drop("__text", "__edited")
