"""Periodic runs, resampling and licence scans against brute force, with nulls, empty and long texts, ties, repeats and
clashing names; their SQL twins on the smallest data set."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from fluvial.llm import common, licenses, periodic_runs, queries, target_resampling

ODD = [None, "", " ", "one", "MIT License", "a b " * 40, "\x00x\x1fy", "ÄÖ é z   w", "Zz" * 5000]
FOLDER = "/root/testdata/sf0.001"


# --- periodic runs --------------------------------------------------------------------------------------------------
def all_runs(w):
    """Every stretch of every period, by its definition."""
    found, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    words, kinds = [], r.choice([1, 2, 3, 8])
    for _ in range(r.randrange(1, 8)):
        base = [r.randrange(kinds) for _ in range(r.randrange(1, 40))]
        words += base * r.randrange(1, 9) + base[: r.randrange(len(base) + 1)]
    return words


@pytest.mark.parametrize("sampled", [16, 64, 256])
def test_runs_equal_those_by_definition(monkeypatch, sampled):
    monkeypatch.setattr(periodic_runs, "SAMPLED", sampled)
    r, n = random.Random(sampled), 0
    for _ in range(400):
        words = repetitive(r)
        want = all_runs(words)
        assert periodic_runs.find_runs(words) == want
        n += len(want)
    assert n > 500


def test_long_texts_are_whole_and_quick():
    text = list(range(9_000)) * 3 + ["x"] + ["y"] * 100_000
    assert periodic_runs.find_runs(text) == [(0, 27_000, 9_000), (27_001, 100_000, 1)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + math.floor((n - a) / (3 + g % 8))
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_report(spark):
    r = random.Random(4)
    rows = [(i, t, "s") for i, t in enumerate(ODD + [" ".join(map(str, repetitive(r))) for _ in range(80)])]
    rows += [(100 + i, " ".join(str(r.randrange(9)) for _ in range(200)), None) for i in range(60)] + [(7, "x y", "s"), (7, "x y", "s"), (None, "q " * 30, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic_runs.periodic_runs(docs, edit=periodic_runs.with_planted_repeats)
    got = sorted(map(tuple, periodic_runs.digests(found).collect()), key=str)
    want = []
    for k, t, _ in rows:
        words = planted(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) if k is not None else (t or "").split()
        runs = all_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        want.append((k, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert got == sorted(want, key=str)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, t, _ in rows if k is not None and t and len(t) > 100)


def test_runs_of_odd_tables(spark):
    clash = spark.createDataFrame([("k", "a " * 30, 1)], "runs string, text string, n_words int")
    row = periodic_runs.periodic_runs(clash, key="runs").first().asDict(recursive=True)
    assert row == {"runs_": "k", "n_words": 30, "runs": [{"start": 0, "length": 30, "period": 1}], "collapsed": "a"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(periodic_runs.periodic_runs(empty)).count() == 0


# --- resampling -----------------------------------------------------------------------------------------------------
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn(rows, target, plan):
    count = lambda texts: np.bincount([h % plan.buckets for t in texts for h in features(t)[1]], minlength=plan.buckets)
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((float(b + 1) * (s.sum() + plan.buckets)) / (float(a + 1) * (t.sum() + plan.buckets)))) for a, b in zip(s, t)]
    out = []
    for k, text in rows:
        n, hashes = features(text)
        weight = sum(gain[h % plan.buckets] for h in hashes) // len(hashes) if hashes else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(hashes), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= plan.least_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(able[: len(able) * plan.percent // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_equals_its_definition(spark, percent):
    r = random.Random(percent)
    words = "river Flow the of stone 7 bridge über señor x1".split()
    make = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(n))
    rows = [(i, t) for i, t in enumerate(ODD + [make(r.randrange(1, 60)) for _ in range(150)])] + [(5, make(30)), (None, make(40)), (None, "MIT")]
    rows += [(500, "same text " * 15)] * 3
    target = [make(20) for _ in range(5)] + [None, ""]
    plan = target_resampling.Plan(buckets=64, percent=percent)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, rank int").repartition(5)
    got = target_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), plan)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, plan)


def test_resampling_of_odd_tables(spark):
    empty = spark.createDataFrame([], "score long, body string")
    full = spark.createDataFrame([(3, "w " * 25)], "score long, body string")
    assert target_resampling.resample(empty, full, key="score", text="body", target_text="body").count() == 0
    plan = target_resampling.Plan(percent=100)
    row = target_resampling.resample(full, empty, plan, key="score", text="body", target_text="body").first()
    assert row.__fields__[0] == "score_" and row["score_"] == 3 and row["rank"] == 1 and row["n_features"] == 49


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS v").repartition(6)
    got = target_resampling.ranked(rows, [queries.F.col("v").desc(), queries.F.col("id")], "place").collect()
    want = {x: i + 1 for i, x in enumerate(sorted(range(5000), key=lambda x: (-(x % 7), x)))}
    assert {r["id"]: r["place"] for r in got} == want


def test_vectors_are_summed_in_a_tree(spark):
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"v": [np.array([len(f), f["id"].sum()], np.int64).tobytes()]})

    rows = spark.range(0, 200, 1, 50).mapInPandas(run, "v binary")
    assert common.summed_vectors(rows, 2).tolist() == [200, 199 * 100]
    assert common.summed_vectors(spark.createDataFrame([], "v binary"), 2).tolist() == [0, 0]


# --- licences -------------------------------------------------------------------------------------------------------
def quoted(words):
    """All places by their definition: every start of every clause, every start of every phrase."""
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label, 1.0, True) for i in range(len(words)) if words[i : i + len(p)] == p]
    for label, clause, phrases in licenses.TEMPLATES:
        c = clause.split()
        key = {i for p in phrases for a in [clause[: clause.index(p)].count(" ")] for i in range(a, a + len(p.split()))}
        for start in range(-len(c), len(words)):
            same = {i for i in range(len(c)) if 0 <= start + i < len(words) and words[start + i] == c[i]}
            if key <= same and 100 * len(same) >= 80 * len(c):
                out.append((start, label, len(same) / len(c), False))
    return sorted(out, key=lambda f: (f[0], not f[3], f[1]))


def damaged(r, clause):
    words = clause.split()
    for _ in range(r.randrange(0, 5)):
        words[r.randrange(len(words))] = r.choice(["the", "xx", "of", "software"])
    a = r.choice([0, 0, 0, 2, 4])
    return r.choice([" ", "  ", "\n * ", ", "]).join(w.upper() if r.random() < 0.3 else w for w in words[a:])


def test_scan_equals_all_alignments(spark):
    r = random.Random(8)
    filler = "the of and software license is free any to copy notice MIT apache cc by gnu general public".split()
    texts = ODD + ["cc by cc by-nc", "the " * 300, "license " * 300]
    for _ in range(400):
        parts = [r.choice([damaged(r, r.choice(licenses.TEMPLATES)[1]), " ".join(r.choice(filler) for _ in range(r.randrange(12))), r.choice(list(licenses.PHRASES)).title()]) for _ in range(r.randrange(1, 5))]
        texts.append(r.choice([" ", ". "]).join(parts))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "MIT License", "x"), (3, "Apache License", "x"), (3, "Apache License", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string")
    found = licenses.find_licenses(docs)
    got = [(x["doc_id"], x["n_words"], [tuple(p) for p in x["places"]]) for x in found.collect()]
    want = []
    for k, t, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want.append((k, len(words), quoted(words)))
    assert sorted(got, key=str) == sorted(want, key=str)
    near = [p for _, _, places in want for p in places if not p[3]]
    assert len(near) > 100 and len([p for p in near if p[2] < 1]) > 50 and any(p[0] < 0 for p in near)
    by_key = {(x["doc_id"], x["n_words"]): x for x in licenses.report(found).collect()}
    for k, n, places in want:
        x, base = by_key[k, n], [p for p in places if p[3]]
        assert (x["n_base"], x["first_word"], x["last_word"]) == (len(base), min((p[0] for p in base), default=None), max((p[0] for p in base), default=None))
        assert x["base_labels"] == ",".join(sorted({p[1] for p in base})) and x["labels"] == ",".join(sorted({p[1] for p in places}))
        assert x["score"] == max((p[2] for p in places), default=0.0)


def test_scan_of_odd_tables(spark):
    clash = spark.createDataFrame([("k", "the MIT license", 1)], "places string, text string, n_words int")
    assert licenses.find_licenses(clash, key="places").first().asDict(recursive=True) == {"places_": "k", "n_words": 3, "places": [{"start": 1, "label": "mit", "share": 1.0, "base": True}]}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.report(licenses.find_licenses(empty)).count() == 0


def test_index_holds_the_rarest_places():
    known = licenses.templates([("x", "a b c d e f g h i j", ["e f"])])
    index = licenses.positional_index(known, {w: float(i) for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h", b"i", b"j"])})
    assert known[0].least == 8 and known[0].keys == (4, 5) and index == {b"j": [(0, 9)], b"i": [(0, 8)], b"h": [(0, 7)]}


# --- SQL twins ------------------------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    want = collections.Counter(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert collections.Counter(map(tuple, got.select(*names).collect())) == want
