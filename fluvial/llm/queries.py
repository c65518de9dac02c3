"""The registered queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import fingerprints, language_id, licenses, lm_scores, near_duplicates, neighbours, packing, periodic_runs, personal_data, sentence_pieces, target_resampling, token_counts, warc
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir, "doc_id", "text"))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_word_counts(documents(spark, sf_dir, "doc_id", "text")))


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(documents(spark, sf_dir, "doc_id", "text"), language_id.held_out(parts=5, part=1))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal(documents(spark, sf_dir, "doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = near_duplicates.Plan(words=3, percent=85)
    return near_duplicates.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), plan)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, edit=periodic_runs.with_planted_repeats))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return target_resampling.resample(documents(spark, sf_dir, "doc_id", "text"), target)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find_licenses(documents(spark, sf_dir, "doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_hilbert_neighbours,
        op3_language_id,
        op4_token_counts,
        op5_warc,
        op6_best_fit_packing,
        op7_log_bilinear,
        op8_personal_data,
        op9_near_duplicates,
        op10_sentence_pieces,
        op11_periodic_runs,
        op12_target_resampling,
        op13_license_scan,
    )
}

#: Texts with A-Z lower-cased as lists of words between characters below 128 that are neither letters nor digits.
PLAIN_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def license_sql() -> str:
    """All starts of all clauses, without an index."""
    known = licenses.templates()
    clauses = ", ".join(f"({t}, {p}, '{w.decode()}', {p in x.keys})" for t, x in enumerate(known) for p, w in enumerate(x.words))
    needs = ", ".join(f"({t}, '{x.label}', {x.least}, {len(x.keys)}, {len(x.words)})" for t, x in enumerate(known))
    phrases = ", ".join(f"({[*p.split()]}, '{label}')" for p, label in licenses.PHRASES.items())
    return f"""
        WITH d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        clause(t, p, word, is_key) AS (VALUES {clauses}), need(t, label, least, n_keys, size) AS (VALUES {needs}), phrase(p, label) AS (VALUES {phrases}),
        base AS (SELECT words.doc_id, i, label FROM words JOIN phrase ON words.word = phrase.p[1] JOIN d ON d.doc_id = words.doc_id
            WHERE d.w[i + 1 : i + len(phrase.p)] = phrase.p),
        aligned AS (SELECT doc_id, t, i - p AS start, count(*) AS same, count(*) FILTER (is_key) AS same_keys FROM words JOIN clause USING (word) GROUP BY ALL),
        quoted AS (SELECT doc_id, label, same::DOUBLE / size AS share FROM aligned JOIN need USING (t) WHERE same >= least AND same_keys = n_keys),
        b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY ALL),
        m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
            FROM (SELECT doc_id, label, share FROM quoted UNION ALL SELECT doc_id, label, 1.0 FROM base) GROUP BY ALL)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
            coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
    """


ORACLE_SQL = {
    "op12_target_resampling": f"""
        WITH d AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents), b AS (SELECT {PLAIN_WORDS} AS w FROM benchmark),
        runs AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
        wanted AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
        distinct_f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM wanted)),
        -- CRC-32: each byte is XORed in, then eight steps of the reflected polynomial
        hashed AS (SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
            lambda c, x: list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295), 4294967295) % 10000 AS bucket FROM distinct_f),
        c AS (SELECT bucket, count(*) AS s FROM runs JOIN hashed USING (f) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY ALL),
        gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM runs) + 10000)) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000))))::BIGINT AS gain
            FROM c LEFT JOIN t USING (bucket)),
        weights AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY ALL),
        scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
        placed AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM placed WHERE words >= 20) // 100 THEN place END::BIGINT AS rank FROM placed
    """,
    "op13_license_scan": license_sql(),
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> head THEN head END AS refers_to
        FROM m
    """,
}
