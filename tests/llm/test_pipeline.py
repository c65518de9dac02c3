"""The pipeline's stages on a small folder."""

import pytest

import corpus_pipeline
from fluvial.llm import near_duplicates


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = "the report of the river was with the team and that is for all of us on the way to the bridge number "
    rows = [(i, f"{base} {i} " + " ".join(f"word{i}x{j}" for j in range(40)), "en", "s", 0) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(5)]
    rows += [(200, "12345 !!", "en", "s", 8), (201, None, "de", "s", None), (202, "write to a.b@c.de about der die und das mit dem fluss", "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "packing"]
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(30), *range(100, 105), 202}
    unique = corpus_pipeline.drop_near_duplicates(spark, kept, folder)
    marks = near_duplicates.near_duplicates(kept, near_duplicates.Plan(5, 80)).collect()
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in marks if r.kept} == {*range(30), 202}
    clean = corpus_pipeline.redact_personal_data(spark, unique, folder)
    assert clean.schema == docs.schema
    row = clean.where("doc_id = 202").first()
    assert row.text.startswith("write to <EMAIL> about") and row.n_chars == len(row.text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {*range(30), 202}


def test_nothing_learned_keeps_documents_with_a_letter(spark):
    rows = [(1, "a river", None, "s", 7), (2, "12 !", None, "s", 4), (3, None, None, "s", None), (4, "中文", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, spans string"


def odd(spark):
    good = "the report of the river was with the team and that is for all of us on the way to the bridge"
    other = "der bericht vom fluss war bei der gruppe und das ist fuer alle auf dem weg zur bruecke am wasser"
    rows = [(i, f"{good} {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 9, 0.5, "k", "s") for i in range(12)]
    rows += [(20 + i, f"{other} {i} " + " ".join(f"v{i}y{j}" for j in range(30)), "de", None, None, None, None, None) for i in range(12)]
    rows += [rows[3], rows[3], (40, rows[5][1], None, "s", 1, 1.0, "k", "s"), (None, rows[6][1], "en", "s", 1, 1.0, "k", "s"), (41, None, "en", "s", 7, 1.0, "k", "s"), (42, "", None, "s", 0, 1.0, "k", "s"), (43, "call (415) 555-2671 now " + good, "en", "s", 1, 0.1, "k", "s")]
    rows.append((44, good + " word" * 30_000, "en", "s", 1, 0.1, "k", "s"))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_every_stage_takes_odd_rows(spark):
    rows, docs = odd(spark)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    same = lambda r: (r[0], r[1], *r[3:])  # noqa: E731  all but the language
    assert sorted((same(r) for r in kept.collect()), key=str) == sorted((same(r) for r in rows if r[1]), key=str)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    gone = {40, None}
    assert one.columns == docs.columns and plain(one) == sorted((r for r in rows if r[0] not in gone), key=str)
    clean = corpus_pipeline.redact_personal_data(spark, docs, "")
    by = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and clean.count() == len(rows) and by[41].text is None and by[41].n_chars == 7 and by[42].text == ""
    assert by[43].text.startswith("call <PHONE> now") and by[43].n_chars == len(by[43].text) and by[3].text == rows[3][1]
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    want = sorted(str((r[0], len((r[1] or "").split()))) for r in rows)
    total = {}
    for p in packed:
        total.setdefault(p.doc_id, []).append(p.n_tokens)
    assert {k: sum(v) for k, v in total.items()} == {k: sum(len((r[1] or "").split()) for r in rows if r[0] == k) for k in {r[0] for r in rows}} and len(want) == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_an_empty_table(spark, name, stage):
    _, docs = odd(spark)
    out = stage(spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
