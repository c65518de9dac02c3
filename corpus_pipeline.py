"""A corpus in four stages: language ID, near-duplicates, personal data, packing.

Each stage works on all that the one before kept; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm import common, language_id, near_duplicates, packing, personal_data
from fluvial.plans.shipping import ship

#: A document goes when no language is found, or the calibrated probability is less than this.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one. Learned from the rows that have one.

    Where no row teaches anything, documents that have a letter are kept as they are. Null and letterless texts go;
    equal texts get equal languages, repeated rows stay; an empty table gives no rows; other columns stay, whatever their
    names.
    """
    ship(spark)
    model = language_id.train(docs.where(F.col("lang").isNotNull()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    marked = language_id.predict_languages(docs.withColumnsRenamed(own), model)
    found = marked.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred"))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words and a similarity of 0.8: the one with the least doc_id.

    Texts without words, null ones too, are groups of their own and stay; repeated rows of a kept document stay, rows
    with a null doc_id only where their group has no other; an empty table gives no rows; other columns stay.
    """
    ship(spark)
    return near_duplicates.one_of_each(docs, near_duplicates.Plan(words=5, percent=80))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text.

    A null text stays null with its n_chars, an empty one empty. Of spans that overlap, the better candidate counts, and
    of equal ones the first and longer; repeated rows change alike; an empty table gives no rows; other columns stay.
    """
    ship(spark)
    clean = personal_data.redacted("text")
    return docs.withColumn("text", clean).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the permitted sequence lengths, a row a piece of a document: doc_id, piece, start, n_tokens (words),
    bin_id, capacity.

    A null or empty text is one piece of no words; longer texts than the greatest length are cut; equal lengths go by the
    order of a hash of key and length; repeated rows are packed each; an empty table gives no rows; other columns are not
    read.
    """
    ship(spark)
    return packing.pack(packing.with_word_counts(docs.select("doc_id", "text")))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.settle(docs, f"stage-{name}")
    return docs
