"""Lookups in long rating tables, and reaches in tiles, against brute force."""

import random

import numpy as np

from fluvial.operators import flow_stats, lookup


def level(points, x):
    best = {}
    for q, y in points:
        if q is not None and y is not None and np.isfinite(q) and np.isfinite(y):
            best[q] = min(y, best.get(q, np.inf))
    pts = sorted(best.items())
    if not pts or x is None or np.isnan(x):
        return None
    if len(pts) == 1:
        return pts[0][1]
    j = min(max(sum(q < x for q, _ in pts), 1), len(pts) - 1)
    (q0, y0), (q1, y1) = pts[j - 1], pts[j]
    return y0 + (x - q0) * (y1 - y0) / (q1 - q0)


def test_long_lookups(spark):
    r = random.Random(4)
    tables = {1: [(r.uniform(0, 100), r.uniform(0, 9)) for _ in range(900)], 2: [(3.0, 4.0)], 3: [], 4: [(None, 1.0), (2.0, float("nan")), (float("inf"), 2.0)], 5: [(1.0, 5.0), (1.0, 4.0), (2.0, 6.0)], 7: [(float(i), float(i % 3)) for i in range(40)]}
    points = [(k, q, y) for k, t in tables.items() for q, y in t] + [(None, 1.0, 1.0)]
    asked = [(i, r.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), r.choice([None, float("nan"), 50.0, 2.0, r.uniform(-20, 130), r.uniform(0, 100)])) for i in range(800)]
    asked += [(1000 + i, 1, 50.0) for i in range(300)] + [(5000, None, 1.0)]
    ratings, wanted = spark.createDataFrame(points, "k int, q double, y double").repartition(5), spark.createDataFrame(asked, "id int, k int, x double").repartition(3)
    for parts in ("1", "4", "23"):  # ranges of few rows too: hot keys and single rows lie across them
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {x.id: x.level for x in lookup.levels_at(ratings, wanted, "k").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(asked)
        for i, k, x in asked:
            want = level(tables.get(k, []), x)
            assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) <= 1e-9 * max(1, abs(want))), (parts, i, k, x, got[i], want)


def test_reaches_in_tiles(spark):
    r = random.Random(6)
    reaches = [(i, [(r.uniform(-50, 50), r.uniform(-50, 50))] + [(r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(r.randrange(3))] if i % 3 else [(x := r.uniform(-50, 50), 0.0), (x + 2, 3.0)]) for i in range(300)] + [(900, [])]
    tiles = [(t, x := r.uniform(-60, 30), y := r.uniform(-60, 30), x + r.uniform(0, 60), y + r.uniform(1, 60)) for t in range(40)] + [(41, 0.0, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(reaches, "rivid int, pts array<struct<x:double,y:double>>")
    boxes = spark.createDataFrame(tiles, "tile int, minx double, miny double, maxx double, maxy double")
    got = sorted(map(tuple, flow_stats.in_tiles(rows, boxes).collect()))
    assert got == sorted((t, k) for t, a, b, c, d in tiles for k, pts in reaches if pts and all(a <= x <= c and b <= y <= d for x, y in pts)) and len(got) > 100
    assert flow_stats.in_tiles(rows, boxes.limit(0)).count() == 0
