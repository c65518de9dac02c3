"""Kernels, formats and point operators against plain versions."""

import json
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.functions import hydraulics
from fluvial.operators import bathymetry, fits, neighbourhood, rating, sections, solver, spatial
from fluvial.plans import carriers, features, lineage
from fluvial.sources import outputs, raster, tables, vectors
from fluvial.sources.config import Config


def plain_side(z, n, dz, wse):
    d = [wse - x for x in z]
    if not d or d[0] <= 1e-16:
        return 0, 0, 0, 0
    k = next((i for i in range(1, len(d)) if d[i] <= 0), None)
    last = len(d) - 1 if k is None else k - 1
    a = sum(dz * (d[j] + d[j - 1]) / 2 for j in range(2 if k is None else 1, last + 1))
    p = sum(math.hypot(dz, d[j] - d[j - 1]) for j in range(2 if k is None else 1, last + 1))
    m = sum(math.hypot(dz, d[j] - d[j - 1]) * n[j] ** 1.5 for j in range(1, last + 1))
    if k is None:
        return a, p, m, dz * (len(d) - 1)
    u = dz * d[k - 1] / (abs(d[k - 1]) + abs(d[k]))
    return a + u * d[k - 1] / 2, p + math.hypot(u, d[k - 1]), m + math.hypot(u, d[k - 1]) * n[k - 1] ** 1.5, dz * (k - 1) + u


def test_batched_geometry_equals_the_plain_one():
    rng = np.random.default_rng(1)
    z = [rng.uniform(0, 3, rng.integers(0, 12)) for _ in range(300)]
    n = [rng.uniform(0.01, 0.1, len(x)) for x in z]
    dz, wse = rng.uniform(0.5, 2, 300), rng.uniform(0, 4, 300)
    got = solver.Side.of(z, n, dz).geometry(wse)
    want = np.array([plain_side(list(a), list(b), c, w) for a, b, c, w in zip(z, n, dz, wse)])
    assert np.allclose(np.stack(got, axis=1), want)


def test_stages_are_looked_up_without_all_ordinates(monkeypatch):
    rng = np.random.default_rng(2)
    z = [[np.concatenate(([h], h + rng.uniform(-0.5, 3, k))) if k >= 0 else [] for h, k in zip(rng.uniform(0, 3000, 300), rng.integers(-1, 12, 300))] for _ in "12"]
    n = [[rng.uniform(0.01, 0.1, len(x)) for x in side] for side in z]
    dz = rng.uniform(0.5, 2, 300)
    base = np.array([a[0] if len(a) else b[0] if len(b) else 0.0 for a, b in zip(*z)])
    wse = base + rng.uniform(-0.5, 4, 300)
    made = solver.Sections(*(solver.Side.of(a, b, dz) for a, b in zip(z, n)), np.full(300, 0.01))
    for side, p, m in zip(made.filled, z, n):
        want = np.array([plain_side(list(a), list(b), c, w)[:3] for a, b, c, w in zip(p, m, dz, wse)])
        assert np.allclose(np.stack(side.geometry(wse), axis=1), want)
    monkeypatch.setattr(solver.Side, "geometry", None)
    target = made.flow(base + 2.0)
    stage, flow = solver.solve_stage(made, base, np.where(target > 0, target, 1.0))
    assert (np.abs(flow - target)[target > 1] < 0.01 * target[target > 1]).mean() > 0.9


def test_lock_step_roots():
    target = np.array([2.0, 10.0, 0.001, 999.0])
    got = solver.bracketed_root(lambda x: x**3 - target, np.zeros(4), np.full(4, 10.0), 1e-9)
    assert np.allclose(got, np.cbrt(target), atol=1e-8)


def test_fits_recover_power_laws():
    q = np.tile(np.linspace(1, 50, 15), (3, 1))
    y = np.array([[2.0], [0.5], [7.0]]) * q ** np.array([[0.4], [0.7], [0.1]])
    a, b = fits.fit_power(q, y, np.ones_like(q, bool), (1.0, 0.3))
    assert np.allclose(a, [2, 0.5, 7], rtol=1e-5) and np.allclose(b, [0.4, 0.7, 0.1], rtol=1e-5)
    a, b = fits.fit_power(q[:1], y[:1], np.zeros((1, 15), bool), (1.0, 0.3))
    assert a[0] == b[0] == fits.FAILED


def test_smoothing_keeps_cubics():
    x = np.arange(20.0)
    cubic = 0.1 * x**3 - x**2 + 3
    assert np.allclose(bathymetry.smoothed(cubic), cubic)
    assert np.allclose(bathymetry.smoothed(cubic[:4]), cubic[:4])


def test_trapezoid_carries_the_flow():
    depth = bathymetry.trapezoid_depth(10, 12, 20, 0.001)
    q = lambda d: (d * 16) * (d * 16 / (12 + 2 * math.hypot(4, d))) ** (2 / 3) * 0.001**0.5 / 0.03
    assert q(depth) <= 10 < q(depth + 0.0101)


def test_thinning_equals_the_greedy_walk(spark):
    r = random.Random(1)
    pts = [(i, r.uniform(0, 300), r.uniform(0, 300), 100.0 + r.choice([0.0, 0.01, 0.02, 0.2])) for i in range(150)]
    gone = set()
    for i, x, y, w in pts:
        if i not in gone:
            for j, u, v, t in pts[i + 1 :]:
                if math.hypot(x - u, y - v) <= 50 and abs(w - t) / ((w + t) / 2) * 100 <= 0.05:
                    gone.add(j)
    df = spark.createDataFrame(pts, "id long, x double, y double, wse double").repartition(5)
    assert {r.id for r in spatial.thin(df, 50.0, 0.05, "id", "wse").collect()} == {p[0] for p in pts} - gone


def test_nearest_equals_all_pairs(spark):
    r = random.Random(2)
    pts = [(i, r.uniform(0, 5000), r.uniform(0, 5000)) for i in range(80)]
    seeds = [(100 + i, r.uniform(-9000, 9000), r.uniform(0, 5000)) for i in range(12)]
    got = spatial.nearest(spark.createDataFrame(seeds, "seed long, x double, y double"), spark.createDataFrame(pts, "id long, x double, y double"), "seed", 10.0)
    want = {s: min(pts, key=lambda p: math.hypot(p[1] - x, p[2] - y))[0] for s, x, y in seeds}
    assert {r.seed: r.id for r in got.collect()} == want


def test_projections():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    e, n = spatial.utm(F.lit(-111.0), F.lit(40.0), 12)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(row.e - 500_000) < 0.01 and abs(row.n - 4_427_757.2) < 0.5
    x, y = spatial.equal_area(F.lit(180.0), F.lit(85.0445664))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 17_367_530.45) < 0.1 and abs(row.y - 7_314_540.83) < 0.1
    assert abs(spatial.geodesic(0, 0, 1, 0) - 111_319.491) < 0.01 and abs(spatial.geodesic(0, 0, 0, 1) - 110_574.389) < 0.01


def test_interpolation(spark):
    cases = [([(1.0, 10.0), (3.0, 30.0)], 2.0, 20.0), ([(3.0, 30.0), (1.0, 10.0), (1.0, 99.0)], 5.0, 50.0), ([(2.0, 7.0)], 9.0, 7.0), ([], 1.0, None), ([(1.0, None), (2.0, 4.0), (4.0, 8.0)], 1.0, 2.0)]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)], "i int, pairs array<struct<q:double,y:double>>, x double")
    got = {r.i: r.y for r in df.select("i", rating.interpolated(F.col("pairs"), F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def test_section_of_a_plane_is_exact(spark):
    grid = spark.range(41 * 41).select((F.col("id") / 41).cast("int").alias("row"), (F.col("id") % 41).cast("int").alias("col")).select("row", "col", (100 + 0.5 * F.col("row")).alias("z"), F.lit(1).alias("lc"), F.lit(0.03).alias("n"))
    cells = spark.createDataFrame([(1, 20, 20, 15), (2, 20, 20, 0)], "cell_seq long, row int, col int, angle_idx int")
    got = {r.cell_seq: r for r in sections.sample(cells, grid, sections.ordinates(spark, 30, 1.0, 1.0), 41, 41).collect()}
    assert got[1].p1 == [110 + 0.5 * i for i in range(20)] and got[1].p2 == [110 - 0.5 * i for i in range(20)] and got[1].dz == 1.0
    assert got[2].p1 == [110.0] * 20 and [x.c for x in got[2].rc1] == list(range(20, 40))


def test_direction_of_a_diagonal(spark):
    cells = spark.createDataFrame([(i, i, 1, float(i)) for i in range(20)], "row int, col int, comid long, z double")
    r = neighbourhood.stream_direction(cells, 5).where("row = 10").first()
    assert abs(r.stream_direction - math.pi / 4) < 1e-9 and abs(r.xs_direction - 3 * math.pi / 4) < 1e-9


@pytest.mark.parametrize("kind,fill", [("f4", float("nan")), ("u1", 0)])
def test_raster_round_trip(spark, tmp_path, kind, fill):
    like = raster.Header("<", 7, 9, kind, 1, 1, (7, 9), [], [], (100.0, 2.0, 0.0, 50.0, 0.0, -2.0), False, 26912, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912)})
    grid = spark.createDataFrame([(r, c, float(r * 9 + c)) for r in range(7) for c in range(9) if (r + c) % 3], "row int, col int, v double")
    path = str(tmp_path / "g.tif")
    raster.write_grid(grid, path, like, kind, fill)
    back, head = raster.read_grid(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in grid.collect()}
    assert head.transform == like.transform and head.epsg == 26912 and not head.geographic


def test_lzw_and_predictor():
    codes = [256, 65, 66, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert raster.unpack_lzw(data) == b"ABABABA"


def test_vectors(spark, tmp_path):
    path = tmp_path / "l.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"COMID": 7}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[5, 5], [9, 5]]]}}]}))
    row = vectors.longest_part(vectors.read_lines(spark, str(path))).first()
    assert row.COMID == 7 and [(p.x, p.y) for p in row.pts] == [(5.0, 5.0), (9.0, 5.0)]
    wkb = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    assert vectors.parse_wkb(wkb) == [[(0.0, 1.0), (2.0, 3.0)]]


def test_config(tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("DEM_File\ta.tif\nDEM_File\tb.tif\nLow_Spot_Range\n#x\ty\nBathy_Use_Banks\tYes\nAROutBATHY\to.tif\n")
    c = Config.read(str(path))
    assert (c.dem, c.low_spot, c.by_banks, c.increments, c.bathymetry) == ("b.tif", 1, True, 15, "")
    with pytest.raises(ValueError):
        Config.of({"Stream_Slope_Method": "end_points"})
    c.write(str(tmp_path / "d.txt"))
    assert Config.read(str(tmp_path / "d.txt")).dem == "b.tif"


def test_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1.0), (1, 2.0)], "COMID long, q double").write.parquet(str(tmp_path / "f.parquet"))
    with pytest.raises(ValueError):
        tables.read_flows(spark, str(tmp_path / "f.parquet"), "COMID", None, "q")
    text = spark.createDataFrame([("[1, 2.5]",), ("(3, 4)",)], "a string")
    assert [r.a for r in tables.parse_arrays(text, {"a": "double"}).collect()] == [[1.0, 2.5], [3.0, 4.0]]


def test_features_and_geojson(spark, tmp_path):
    curves = spark.createDataFrame([(1, 0, c, 10.0, 1.0, 0.1, 2.0, 0.1, 1.0, 0.1) for c in range(12)], "COMID long, Row long, Col long, BaseElev double, depth_a double, depth_b double, tw_a double, tw_b double, vel_a double, vel_b double")
    forecast = spark.createDataFrame([(1, 10.0)], "rivid long, flow double")
    seeds = spark.createDataFrame([(1, 5.0, -5.0)], "seed long, x double, y double")
    out = features.curve_features(curves, forecast, seeds, (0.0, 10.0, 0.0, 0.0, 0.0, -10.0))
    rows = out.orderBy("Col").collect()
    assert [r.Col for r in rows] == [0, 6] and [r.SEED for r in rows] == ["1", "0"]
    outputs.write_geojson(out.repartition(3), str(tmp_path / "o.geojson"), "EPSG:26912")
    whole = json.loads((tmp_path / "o.geojson").read_text())
    assert whole["type"] == "FeatureCollection" and whole["crs"]["properties"]["name"] == "EPSG:26912" and len(whole["features"]) == 2
    one = whole["features"][0]
    assert one["geometry"]["type"] == "Point" and set(one["properties"]) == {"WaterSurfaceElev_m", "SEED"}
    outputs.write_geojson(out.limit(0), str(tmp_path / "none.geojson"))
    assert json.loads((tmp_path / "none.geojson").read_text())["features"] == []


def test_streamed_forecast(spark, tmp_path):
    from fluvial.streaming import forecast as streaming

    vdt = spark.createDataFrame([(1, 0, 0, 1.0, 10.0, 3.0, 30.0)], "COMID long, Row long, Col long, q_1 double, wse_1 double, q_2 double, wse_2 double")
    spark.sql("SELECT 1L AS COMID, timestamp'2024-01-01 00:10:00' AS time, 2.0D AS qout").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("COMID long, time timestamp, qout double").parquet(str(tmp_path / "in"))
    q = streaming.levels(stream, vdt, 2).writeStream.format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("levels").first().WaterSurfaceElev_m == 20.0


def test_thinning_of_a_long_chain_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_WIDTH", 4)
    pts = [(i, float(i * 3 % 1499), float(i % 5), 100.0 + (i % 7) * 0.01) for i in range(900)]
    kept = []
    for i, x, y, z in pts:
        if not any(math.hypot(x - a, y - b) <= 10 and abs(z - c) / ((z + c) / 2) * 100 <= 0.05 for _, a, b, c in kept):
            kept.append((i, x, y, z))
    df = spark.createDataFrame(pts, "id long, x double, y double, wse double")
    assert {r.id for r in spatial.thin(df, 10.0, 0.05, "id", "wse").collect()} == {k[0] for k in kept}
    assert spatial.thin(df.limit(0), 10.0, 0.05, "id", "wse").count() == 0


def test_nearest_from_far_away(spark):
    pts = [(i, 1e6 + i * 0.5 % 100, 1e6 + i % 13) for i in range(500)]
    seeds = [(1, 0.0, 0.0), (2, 1e6 + 50, 1e6 + 5), (3, 2e6, 0.0)]
    got = {(r.seed, r.id) for r in spatial.nearest(spark.createDataFrame(seeds, "seed long, x double, y double"), spark.createDataFrame(pts, "id long, x double, y double"), "seed").collect()}
    want = set()
    for s, x, y in seeds:
        d = {i: math.hypot(x - a, y - b) for i, a, b in pts}
        want |= {(s, i) for i in d if d[i] == min(d.values())}
    assert got == want


def naive_sweep(cells, n_rows, n_cols):
    """The clean-up on a padded array, in the words of its description."""
    b = np.zeros((n_rows + 4, n_cols + 4), int)
    for (r, c), v in cells.items():
        b[r + 2, c + 2] = v
    order = sorted((r + 2, c + 2) for r, c in cells)
    for _ in range(2):
        for r, c in order:
            if not b[r, c]:
                continue
            lone = lambda a: not a.any()
            up, down, left, right = b[r - 1, c], b[r + 1, c], b[r, c - 1], b[r, c + 1]
            vertical = not left and not right and ((lone(b[r + 1, c - 1 : c + 2]) and up) or (lone(b[r - 1, c - 1 : c + 2]) and down))
            across = not up and not down and ((lone(b[r - 1 : r + 2, c + 1]) and left) or (lone(b[r - 1 : r + 2, c - 1]) and right))
            if vertical or across:
                b[r, c] = 0
        for r, c in order:
            v = b[r, c]
            if not v or any(b[r + s, c] == v and v in (b[r + s, c - 1], b[r + s, c + 1]) for s in (1, -1)):
                continue
            for s in (1, -1):
                if b[r, c + s] == v and v in (b[r + 1, c + s], b[r - 1, c + s]):
                    if not b[r - 1, c + 2 * s] and not b[r, c + 2 * s]:
                        b[r, c + s] = 0
                    break
    return {(int(r) - 2, int(c) - 2): int(b[r, c]) for r, c in zip(*b.nonzero())}


@pytest.mark.parametrize("band", [50_000, 20])
def test_streams_are_cleaned_in_bands(spark, monkeypatch, band):
    from fluvial.operators import streams

    monkeypatch.setattr(streams, "BAND_CELLS", band)

    rng = np.random.default_rng(4)
    cells = {(int(r), int(c)): int(rng.integers(1, 4)) for r, c in zip(*np.nonzero(rng.random((40, 40)) < 0.18))}
    cells |= {(20, c): 9 for c in range(5, 35)} | {(r, 17): 9 for r in range(21, 30)}
    want = naive_sweep(cells, 40, 40)
    assert 0 < len(want) < len(cells)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, comid long")
    assert {(r.row, r.col): r.comid for r in streams.clean_streams(df).collect()} == want
    assert streams.clean_streams(df.limit(0)).count() == 0


def test_seeds_of_a_reach(spark):
    points = spark.createDataFrame([(1, 0, i, float(i), 0.0, 10.0 + i) for i in range(5)] + [(2, 1, 0, 0.0, 9.0, 5.0)], "COMID long, Row long, Col long, x double, y double, BaseElev double")
    seeds = spark.createDataFrame([("s", 1, 0.2, 0.1), ("t", 1, 3.9, 0.1), ("u", 1, 0.0, 8.9)], "seed string, COMID long, x double, y double")
    got = {(r.COMID, r.Col) for r in spatial.tag_seeds_of_reach(points, seeds).where("SEED = '1'").collect()}
    assert got == {(1, 4)}  # the highest; the third seed lies next to another reach


def test_projection_there_and_back(spark):
    rows = spark.createDataFrame([(-111.5, 40.2), (-109.1, 45.0), (-113.7, 31.3)], "lon double, lat double")
    xy = rows.select("lon", "lat", *[v.alias(n) for v, n in zip(spatial.utm(F.col("lon"), F.col("lat"), 12), "xy")])
    back = xy.select("lon", "lat", *[v.alias(n) for v, n in zip(spatial.geographic(F.col("x"), F.col("y"), 12), ("lon2", "lat2"))])
    for r in back.collect():
        assert abs(r.lon - r.lon2) < 1e-7 and abs(r.lat - r.lat2) < 1e-7


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
def test_written_rasters_of_all_compressions(spark, tmp_path, compression):
    like = raster.Header("<", 70, 90, "f4", 1, 1, (70, 90), [], [], (100.0, 2.0, 0.0, 50.0, 0.0, -2.0), False, 26912, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912)})
    grid = spark.createDataFrame([(r, c, float(r * 90 + c) / 8) for r in range(70) for c in range(90) if 10 < r < 55], "row int, col int, v double")
    raster.write_grid(grid, str(tmp_path / "g.tif"), like, compression=compression, strip_values=1000)
    back, head = raster.read_grid(spark, str(tmp_path / "g.tif"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in grid.collect()}
    assert head.predictor == (1 if compression == "none" else 2) and len(head.places) > 1


def test_packed_words_come_back():
    for n in (0, 1, 5, 5000, 60000):
        data = np.random.default_rng(n).integers(0, 7 if n < 10000 else 256, n).astype(np.uint8).tobytes()
        assert raster.unpack_lzw(raster.pack_lzw(data)) == data


def test_vector_sinks(spark, tmp_path):
    rows = [(7, [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (9.0, 5.0), (9.0, 6.0)]]), (8, [[(2.0, 3.0)]])]
    lines = spark.createDataFrame(rows, f"COMID long, parts {vectors.PARTS}")
    for name in ("l.geojson", "l.parquet"):
        outputs.write_vector(lines, str(tmp_path / name))
        back = vectors.read_lines(spark, str(tmp_path / name)).collect()
        assert sorted((r.COMID, [[(p.x, p.y) for p in part] for part in r.parts]) for r in back) == rows
    outputs.write_points_geojson(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"), str(tmp_path / "p.geojson"), 4326)
    whole = json.loads((tmp_path / "p.geojson").read_text())
    assert whole["crs"]["properties"]["name"].endswith("EPSG::4326") and whole["features"][0]["geometry"]["coordinates"] == [1.0, 2.0, 3.0]


def test_inputs_are_prepared_from_a_folder(spark, tmp_path):
    from fluvial.plans import prepare

    like = raster.Header("<", 20, 30, "f4", 1, 1, (20, 30), [], [], (0.0, 1.0, 0.0, 20.0, 0.0, -1.0), False, 26912, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912)})
    grid = spark.range(600).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"))
    for folder in ("DEM", "LandCover", "lines"):
        (tmp_path / folder).mkdir()
    raster.write_grid(grid.withColumn("v", F.col("row") + 0.5), str(tmp_path / "DEM/DEM.tif"), like)
    raster.write_grid(grid.withColumn("v", F.lit(11.0)), str(tmp_path / "LandCover/LandCover.tif"), like, "i4", 0)
    (tmp_path / "lines/s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "LineString", "coordinates": [[2.5, 5.5], [25.5, 15.5]]}}]}))
    saved, prepare.LINES = prepare.LINES, "lines/s.geojson"
    try:
        config = prepare.prepare(spark, str(tmp_path), "id", "qmax", "qbase", "flows.csv", False, False)
        with pytest.raises(ValueError):
            prepare.prepare(spark, str(tmp_path), "id", "qmax", "qbase", "flows.csv", False, False)
    finally:
        prepare.LINES = saved
    cells, _ = raster.read_grid(spark, config.streams)
    assert {r.v for r in cells.collect()} == {7.0} and cells.count() > 10
    assert raster.read_grid(spark, config.cover)[0].where("v = 11").count() == 600
    assert {(r.lc, r.n) for r in tables.read_roughness(spark, config.roughness).collect()} >= {(11, 0.03), (95, 0.1), (21, 0.013)}
    assert Config.read(str(tmp_path / prepare.CONFIG)).flow_max == "qmax"


def channels(rng, m=150):
    """Sections of random banks over flat water, as lists and as a batch."""
    sides, covers = [], []
    for _ in range(m):
        z0 = rng.uniform(0, 5)
        pair = []
        for _ in range(2):
            n = int(rng.integers(1, 40))
            i = np.arange(n)
            z = z0 + np.maximum(0, (i - rng.integers(0, 12)) * rng.uniform(0.05, 1.5)) + rng.normal(0, 0.03, n)
            z[0] = z0
            pair.append(z)
        sides.append(pair)
        covers.append([np.where(np.arange(len(z)) <= rng.integers(0, 10), 80, 10) for z in pair])
    pad = lambda v, fill: np.array([np.concatenate((x, np.full(40 - len(x), fill))) for x in v], float)
    batch = bathymetry.Channels(
        tuple(pad([p[s] for p in sides], np.inf) for s in (0, 1)), tuple(pad([p[s] for p in covers], -1) for s in (0, 1)),
        tuple(np.array([len(p[s]) for p in sides]) for s in (0, 1)), np.full(m, 2.0),
    )
    return sides, covers, batch


def wide_at(z, stage, dz):
    """Width of a side at a level, by walking outwards to where the ground meets it."""
    for k in range(1, len(z)):
        if z[k] >= stage:
            return dz * (k - 1) + dz * (stage - z[k - 1]) / (abs(stage - z[k - 1]) + abs(stage - z[k]))
    return dz * (len(z) - 1)


def test_banks_equal_their_definitions():
    sides, covers, batch = channels(np.random.default_rng(1))
    flat, level, cover, ratio, bend = batch.flat_banks(False), batch.flat_banks(True), batch.cover_banks(), batch.ratio_banks(), batch.bend_banks()
    stages = np.arange(1, 2501) * 0.01
    for i, (pair, lcs) in enumerate(zip(sides, covers)):
        for s, (z, lc) in enumerate(zip(pair, lcs)):
            up = [k for k in range(1, len(z)) if z[k] >= pair[0][0] + 0.1]
            assert flat[i, s] == (up[0] if up else len(z)) and level[i, s] == (up[0] - 1 if up else len(z))
            dry = [k for k in range(1, len(z)) if lc[k] != 80]
            assert cover[i, s] == (dry[0] if dry else 0)
            if len(z) > 11:
                rise = np.diff(bathymetry.smoothed(z))
                less = [k for k in range(len(rise)) if rise[k] < (rise[k - 1] if k else 0.0) - 1e-9]
                assert bend[i, s] == (less[0] if less else 0)
        widths = np.array([[wide_at(z, pair[0][0] + d, 2.0) for z in pair] for d in stages])
        over = widths.sum(axis=1) / stages
        grown = np.flatnonzero(np.diff(over) > 1e-12)
        if len(grown) and grown[0] < 2400:
            assert (ratio[i] == (widths[grown[0]] / 2.0).astype(int)).all() or abs(np.diff(over)[grown[0]]) < 1e-9


def test_beds_follow_the_trapezoid():
    rng = np.random.default_rng(2)
    _, _, c = channels(rng)
    flow, slope = rng.uniform(0.5, 60, len(c.dz)), 10 ** rng.uniform(-4, -2, len(c.dz))
    for find, by_banks in ((bathymetry.shapes_by_level, False), (bathymetry.shapes_by_banks, True)):
        shapes = find(c, flow, slope, 0.2, False)
        some = np.flatnonzero(shapes.cells > 1)
        assert len(some) > 20 and (shapes.depth[some] < 25).all()
        carried = lambda d: d * 0.8 * shapes.width[some] * (d * 0.8 * shapes.width[some] / (0.6 * shapes.width[some] + 2 * np.hypot(0.2 * shapes.width[some], d))) ** (2 / 3) * slope[some] ** 0.5 / 0.03  # noqa: E731, B023
        assert (carried(shapes.depth[some]) <= flow[some]).all() and (carried(shapes.depth[some] + 0.0101) > flow[some]).all()
        for s in (0, 1):
            z, taken = bathymetry.bed(c, shapes, s, 0.2, by_banks)
            assert (z[~taken] == c.z[s][~taken]).all()
            rows, i = np.nonzero(taken & (shapes.cells > 1)[:, None])
            to_bank = (shapes.banks[rows, s] + by_banks - i) * 2.0 + shapes.reach[rows, s]
            inner = to_bank > 0.2 * shapes.width[rows]
            assert np.allclose(z[rows, i][inner], shapes.bed[rows][inner])
            slant = shapes.bed[rows] + shapes.depth[rows] * (1 - to_bank / (0.2 * shapes.width[rows]))
            assert np.allclose(z[rows, i][~inner], slant[~inner]) and (by_banks or (z <= c.z[s]).all())


def test_triangles_first_carry_more_than_the_flow():
    rng = np.random.default_rng(3)
    q, s, a, b = rng.uniform(0, 5, 200), 10 ** rng.uniform(-4, -1, 200), rng.uniform(-1, 3, 200), rng.uniform(-1, 3, 200)
    d = bathymetry.triangle_depth(q, 5.0, 0.0, a, b, s)

    def carried(d):
        w = [5 * d / (np.maximum(x, 0) + d) for x in (a, b)]
        area = d * sum(w) / 2
        return area * (area / sum(np.hypot(x, d) for x in w)) ** (2 / 3) * s**0.5 / 0.03

    inside = d < 24.95
    assert (carried(d)[inside] > q[inside]).all() and (carried(np.maximum(d - 0.1, 1e-9))[inside] <= q[inside] + 1e-9).all()
    assert bathymetry.triangle_depth(0.0, 5.0, 0.0, 1.0, 1.0, 0.01) == 0.0


def test_zarr_reads_only_the_chunks_of_the_ids(spark, tmp_path):
    import zlib

    from fluvial.sources import arrays, classic

    def put(name, values, chunks, dims, attrs=None, compressor=None):
        folder = tmp_path / "z" / name
        folder.mkdir(parents=True)
        about = {"shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": compressor, "fill_value": None, "order": "C", "filters": None, "zarr_format": 2}
        (folder / ".zarray").write_text(json.dumps(about))
        (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **(attrs or {})}))
        counts = [-(-s // c) for s, c in zip(values.shape, chunks)]
        for at in np.ndindex(*counts):
            full = np.zeros(chunks, values.dtype)
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
            full[tuple(slice(0, n) for n in part.shape)] = part
            raw = full.tobytes()
            (folder / ".".join(map(str, at))).write_bytes(zlib.compress(raw) if compressor else raw)

    q = np.arange(10 * 25, dtype="<f4").reshape(10, 25)
    put("rivid", np.arange(100, 125, dtype="<i8"), (10,), ["rivid"])
    put("time", np.arange(10, dtype="<i4"), (4,), ["time"], {"units": "days since 1980-01-01 00:00:00"})
    put("Qout", q, (4, 10), ["time", "rivid"], compressor={"id": "zlib", "level": 1})
    rows = arrays.read_zarr(spark, str(tmp_path / "z"), "Qout").collect()
    assert len(rows) == 250 and {(r.time.day, r.rivid): r.Qout for r in rows} == {(i + 1, 100 + j): q[i, j] for i in range(10) for j in range(25)}
    for k in (0, 2):  # chunks without a wanted id are never opened
        for i in range(3):
            (tmp_path / "z/Qout" / f"{i}.{k}").write_bytes(b"broken")
    some = arrays.read_zarr(spark, str(tmp_path / "z"), "Qout", ids=[112, 117, 999]).collect()
    assert sorted((r.time.day, r.rivid, r.Qout) for r in some) == sorted((i + 1, 100 + j, float(q[i, j])) for i in range(10) for j in (12, 17))


def netcdf(path, times, ids, q, records):
    """A classic NetCDF file by hand: Qout over time and rivid; time grows (records) or not."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    none = struct.pack(">II", 0, 0)
    text = lambda k, v: name(k) + struct.pack(">II", 2, len(v)) + v.encode().ljust(-(-len(v) // 4) * 4, b"\0")
    fill = name("_FillValue") + struct.pack(">II", 5, 1) + struct.pack(">f", -9.0)
    attrs = {"time": struct.pack(">II", 12, 1) + text("units", "hours since 2001-01-01"), "rivid": none, "Qout": struct.pack(">II", 12, 1) + fill}
    data = {"rivid": np.asarray(ids, ">i4").tobytes(), "time": np.asarray(times, ">f8").tobytes(), "Qout": np.asarray(q, ">f4").tobytes()}
    dims, kinds = {"rivid": [1], "time": [0], "Qout": [0, 1]}, {"rivid": 4, "time": 6, "Qout": 5}
    row = {"time": 8, "Qout": 4 * len(ids)}

    def header(begins):
        out = b"CDF\x01" + struct.pack(">I", len(times) if records else 0)
        out += struct.pack(">II", 10, 2) + name("time") + struct.pack(">I", 0 if records else len(times)) + name("rivid") + struct.pack(">I", len(ids)) + none
        out += struct.pack(">II", 11, 3)
        for v in ("rivid", "time", "Qout"):
            size = row[v] if records and v in row else len(data[v])
            out += name(v) + struct.pack(">I", len(dims[v])) + b"".join(struct.pack(">I", d) for d in dims[v]) + attrs[v] + struct.pack(">III", kinds[v], size, begins[v])
        return out

    at = len(header(dict.fromkeys(data, 0)))
    begins = {"rivid": at, "time": at + len(data["rivid"])}
    begins["Qout"] = begins["time"] + (8 if records else len(data["time"]))
    body = data["rivid"]
    if records:
        body += b"".join(data["time"][8 * i : 8 * i + 8] + data["Qout"][row["Qout"] * i : row["Qout"] * (i + 1)] for i in range(len(times)))
    else:
        body += data["time"] + data["Qout"]
    path.write_bytes(header(begins) + body)


@pytest.mark.parametrize("records", [False, True])
def test_netcdf_folder_as_rows(spark, tmp_path, records, monkeypatch):
    from fluvial.sources import arrays, classic

    monkeypatch.setattr(classic, "SLAB", 10)
    q = np.arange(12, dtype=float).reshape(4, 3)
    q[2, 1] = -9.0
    netcdf(tmp_path / "a.nc", [0, 1, 2, 3], [7, 8, 9], q, records)
    netcdf(tmp_path / "b.nc", [24, 25, 26, 27], [7, 8, 9], q + 100, records)
    rows = arrays.read_netcdf(spark, str(tmp_path), ["Qout"]).collect()
    want = {(1, h, 7 + j): None if (h, j) == (2, 1) else float(q[h, j]) for h in range(4) for j in range(3)}
    want |= {(2, h, 7 + j): float(q[h, j] + 100) for h in range(4) for j in range(3)}
    assert {(r.time.day, r.time.hour, r.rivid): r.Qout for r in rows} == want and len(rows) == 24
    (tmp_path / "c.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(Exception, match="no root group"):
        arrays.read_netcdf(spark, str(tmp_path / "c.nc"), ["Qout"])


def of_patchy_grid(seed):
    """Cells of a grid with holes, as a dictionary, around the origin."""
    draw = np.random.default_rng(seed)
    return {(r, c): float(draw.integers(1, 90)) for r in range(-4, 40) for c in range(-4, 40) if draw.random() < 0.9}


def test_sections_over_tiles_equal_a_walk_along_each(spark, monkeypatch):
    from fluvial.operators import tiles

    monkeypatch.setattr(tiles, "WIDTH", 8)
    held = of_patchy_grid(3)
    grid = spark.createDataFrame([(r, c, z, int(z) % 5, z / 100) for (r, c), z in held.items()], "row int, col int, z double, lc int, n double")
    cells = [(i, r, c, (r * 7 + c) % 31) for i, (r, c) in enumerate(held)]
    table = sections.ordinates(spark, 9, 1.0, 1.0)
    drawn = sections.sample(spark.createDataFrame(cells, "cell_seq long, row int, col int, angle_idx int"), grid, table, 36, 36)
    plan = drawn._jdf.queryExecution().toString()
    assert "Join" not in plan  # no row an ordinate that meets the grid
    ords, got = {(o.angle_idx, o.i): o for o in table.collect()}, {x.cell_seq: x for x in drawn.collect()}
    kept = 0
    for i, r, c, angle in cells:
        both = []
        for sign in (1, -1):
            walk = []
            for k in range(9):
                o = ords[angle, k]
                a, b = (r + sign * o.rm, c + sign * o.cm), (r + sign * o.rs, c + sign * o.cs)
                if min(*a, *b) <= 0 or max(*a, *b) >= 35 or a not in held or b not in held:
                    break
                walk.append((held[a] * o.wm + held[b] * o.ws, int(held[a]) % 5, held[a] / 100, a))
            both.append(walk)
        if both[0] or both[1]:
            kept += 1
            x = got[i]
            for walk, p, lc, n, rc in zip(both, (x.p1, x.p2), (x.lc1, x.lc2), (x.n1, x.n2), (x.rc1, x.rc2)):
                assert [(z, cover, rough, (at.r, at.c)) for z, cover, rough, at in zip(p, lc, n, rc)] == walk and len(p) == len(walk)
    assert kept == len(got) > 100


def test_values_near_points_equal_a_search(spark, monkeypatch):
    from fluvial.operators import tiles

    monkeypatch.setattr(tiles, "WIDTH", 8)
    draw, held = np.random.default_rng(4), {k: z for k, z in of_patchy_grid(4).items() if (k[0] + k[1]) % 4 == 0}
    grid = spark.createDataFrame([(*k, z) for k, z in held.items()], "row int, col int, z double")
    at = [(i % 400, *(float(x) for x in draw.uniform(-8, 44, 2))) for i in range(500)] + [(900, None, 1.0)]  # a hundred ids have two points
    found = spatial.value_near(spark.createDataFrame(at, "id long, x double, y double"), grid, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), "id")
    assert "Join" not in found._jdf.queryExecution().toString()  # no row an offset that meets the grid
    want = {}
    for i, x, y in at[:500]:
        r, c = math.floor(y), math.floor(x)
        want[i] = min([*want.get(i, []), *((max(abs(a), abs(b)), a * a + b * b, r + a, c + b, held[r + a, c + b]) for a in range(-2, 3) for b in range(-2, 3) if (r + a, c + b) in held)], default=None)
        want[i] = [want[i]] if want[i] else []
    assert {x.id: x.z for x in found.collect()} == {i: w[0][-1] for i, w in want.items() if w}


@pytest.mark.parametrize("hot", [10**6, 30])
def test_slopes_and_directions_over_tiles_equal_all_pairs(spark, monkeypatch, hot):
    from fluvial.operators import tiles

    monkeypatch.setattr(tiles, "WIDTH", 8)
    draw = np.random.default_rng(8)
    cells = [(r, c, k, float(draw.integers(0, 60))) for r in range(-3, 30) for c in range(-3, 30) for k in (1, 2, 3) if draw.random() < 0.15]
    rows = spark.createDataFrame(cells, "row int, col int, comid long, z double")
    slope = lambda a, b: abs(a[3] - b[3]) / math.hypot((a[1] - b[1]) * 2.0, (a[0] - b[0]) * 3.0)
    local = neighbourhood.local_slope(rows, 2.0, 3.0, 4)
    assert "Join" not in local._jdf.queryExecution().toString()  # no copies of cells that meet cells
    found = {(x.row, x.col, x.comid): x.slope for x in local.collect()}
    turned = {(x.row, x.col, x.comid): x.stream_direction for x in neighbourhood.stream_direction(rows, 4).collect()}
    assert len(found) == len(turned) == len(cells)
    for a in cells:
        box = [b for b in cells if b[2] == a[2] and -4 <= b[0] - a[0] < 4 and -4 <= b[1] - a[1] < 4]
        s = [slope(a, b) for b in box if b != a]
        assert abs(found[a[:3]] - (np.mean(s) if s else 0)) < 1e-12
        x, y = np.array([b[1] - a[1] for b in box]), np.array([b[0] - a[0] for b in box])
        below, above = len(x) * (x * x).sum() - x.sum() ** 2, len(x) * (x * y).sum() - x.sum() * y.sum()
        level = math.pi / 2 if abs(x).max() <= abs(y).max() else 0.0
        want = 0.0 if len(x) <= 1 else level if below == 0 or above == 0 else math.atan(above / below) % (2 * math.pi)
        assert abs(turned[a[:3]] - want) < 1e-9
    for x in neighbourhood.reach_slope(rows, 2.0, 3.0, 4, hot_rows=hot).collect():
        own = [c for c in cells if c[2] == x.comid]
        s = np.rint(np.array([slope(a, b) for k, a in enumerate(own) for b in own[k + 1 :] if abs(a[0] - b[0]) <= 4 and abs(a[1] - b[1]) <= 4]) * 1e8) / 1e8
        s = s[s > 0]
        low, high = np.percentile(s, [25, 75])
        assert abs(x.p25 - low) < 1e-6 and abs(x.p75 - high) < 1e-6 and abs(x.slope - np.median(s[(s >= x.p25) & (s <= x.p75)])) < 1e-9


def test_wide_streams_are_cleaned_in_few_rounds(spark, monkeypatch):
    """A grid with many cells a row, and a line from its first row to its last that goes from its free end on."""
    from fluvial.operators import streams

    monkeypatch.setattr(streams, "BAND_CELLS", 60)
    written, settle = [], streams.settle
    monkeypatch.setattr(streams, "settle", lambda df, label: written.append(label) or settle(df, label))
    rng = np.random.default_rng(7)
    cells = {(int(r), int(c)): int(rng.integers(1, 4)) for r, c in zip(*np.nonzero(rng.random((40, 150)) < 0.2)) if not 70 <= c <= 80}
    cells |= {(r, 75): 9 for r in range(40)}
    want = naive_sweep(cells, 40, 150)
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, comid long")
    assert {(r.row, r.col): r.comid for r in streams.clean_streams(df).collect()} == want
    assert len(written) <= 16, written


def test_terminal_cells_and_last_writers_without_copies_or_sorts(spark, capsys):
    rng = np.random.default_rng(5)
    at = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((60, 250)) < 0.15))} | {(-1, 191), (191, 192), (192, 191)}
    cells = spark.createDataFrame([(r, c, r % 3, 1.5) for r, c in at], "row int, col long, comid long, z double")
    ends = neighbourhood.terminal_cells(cells)
    want = {(r, c): n for r, c in at if (n := sum((r + i, c + j) in at for i in (-1, 0, 1) for j in (-1, 0, 1))) <= 2}
    assert {(r.row, r.col): r.n_around for r in ends.collect()} == want
    ends.explain()
    assert "Generate explode(array(struct" not in capsys.readouterr().out
    rows = [(n, [(n % 5, k % 3, float(n * 10 + k), 1 + k // 4, k % 4) for k in range(8)]) for n in (3, 2**62, -7, 12)]
    burnt = spark.createDataFrame(rows, "cell_seq long, burnt array<struct<row:int,col:int,z:double,side:int,i:int>>")
    last: dict = {}
    for n, row, col, z, side, i in sorted((n, *b) for n, items in rows for b in items):
        last[row, col] = max(last.get((row, col), ()), (n, side, i, z))
    grid = bathymetry.bathymetry_grid(burnt)
    assert {(r.row, r.col): r.z for r in grid.collect()} == {k: v[3] for k, v in last.items()}
    grid.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_thinning_of_a_crowd_equals_a_walk_and_meets_few_pairs(spark, monkeypatch):
    r = random.Random(8)
    pts = [(i, r.uniform(0, 60), r.uniform(0, 60), 100.0 + r.choice([0.0, 0.04, 0.2])) for i in range(1500)]
    kept = []
    for i, x, y, z in pts:
        if not any(math.hypot(x - a, y - b) <= 20 and abs(z - c) / ((z + c) / 2) * 100 <= 0.05 for _, a, b, c in kept):
            kept.append((i, x, y, z))
    df = spark.createDataFrame([*pts, (None, 1.0, 1.0, 100.0), (9999, None, 1.0, 100.0)], "id long, x double, y double, wse double").repartition(3)
    monkeypatch.setattr(spatial, "FIRST", 64)
    met, pairs = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda points, *rest: met.append(pairs(points, *rest).count()) or pairs(points, *rest))
    for sent in (spatial.MOST_SENT, 0):
        monkeypatch.setattr(spatial, "MOST_SENT", sent)
        got = [x.id for x in spatial.thin(df, 20.0, 0.05, "id", "wse").collect()]
        assert len(got) == len(set(got)) and set(got) == {k[0] for k in kept} | {None, 9999}
    assert sum(met) < len(pts) ** 2 / 20


def test_sections_send_wanted_columns_only(spark):
    row = (1, [1.0, 1.2, 2.0, 3.0], [1.0, 1.0, 2.5, 3.0], [80, 80, 10, 10], [80, 80, 10, 10], [(5, k) for k in range(4)], [(5, -k) for k in range(4)], 10.0, 0.001, 5.0)
    made = spark.createDataFrame([row], "id long, p1 array<double>, p2 array<double>, lc1 array<int>, lc2 array<int>, rc1 array<struct<r:int,c:int>>, rc2 array<struct<r:int,c:int>>, dz double, slope double, q_base double")
    whole, some = bathymetry.with_banks(made), bathymetry.with_banks(made, wanted=("cover_level", "flat"), keep=("id",))
    assert whole.columns == [*made.columns, *bathymetry.METHODS] and some.columns == ["id", "cover_level", "flat"]
    assert some.collect() == whole.select(*some.columns).collect()
    whole, some = bathymetry.with_bathymetry(made, 0.2, False, True), bathymetry.with_bathymetry(made, 0.2, False, True, keep=("id", "p2"))
    assert some.columns == ["id", "p2", "burnt"] and some.collect() == whole.select(*some.columns).collect()
    assert len(some.first().burnt) > 0


def test_geometry_of_batches_equals_its_expressions(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(300):
        n = [r.choice([0, 1, 2, 5, 9]) for _ in range(2)]
        p = [[r.choice([0.0, 1.0, r.uniform(-1, 5)]) for _ in range(k)] for k in n]
        rows.append((i, p[0], [r.uniform(0.01, 0.1) for _ in p[0]], p[1], [r.uniform(0.01, 0.1) for _ in p[1]], r.choice([1.0, 7.5]), r.uniform(-1, 6)))
    df = spark.createDataFrame(rows, "id long, p1 array<double>, n1 array<double>, p2 array<double>, n2 array<double>, dz double, w double")
    want = {x.id: x for x in hydraulics.with_sides(df, "w").collect()}
    monkeypatch.setattr(sections, "GEOMETRY_ROWS", 7)
    got = sections.with_geometry(df, "w", ("id",)).collect()
    assert len(got) == len(want)
    for x in got:
        assert all(abs(x[c] - want[x.id][c]) < 1e-9 for c in ("area", "perimeter", "pn", "width")), x


def test_best_angle_of_batches_equals_its_expressions(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(5)
    side = lambda: [r.choice([None, 0.0, 0.4, 0.6, r.uniform(-1, 3)]) for _ in range(r.choice([0, 1, 3, 6]))]
    df = spark.createDataFrame([(i, t, t * 0.1, side(), side(), 2.0) for i in range(120) for t in range(4)], "cell_seq long, try int, angle double, p1 array<double>, p2 array<double>, dz double").repartition(3)
    wide = df.withColumn("w", F.get("p1", F.lit(0)) + 0.5)
    wide = sections.with_top_width(sections.with_top_width(wide, "p1", "w", "t1"), "p2", "w", "t2").withColumn("tw", F.col("t1") + F.col("t2"))
    want = {x.cell_seq: x for x in wide.groupBy("cell_seq").agg(F.min(F.struct(F.round("tw", 9).alias("tw"), "try", "angle")).alias("x")).select("cell_seq", "x.*").collect()}
    monkeypatch.setattr(sections, "GEOMETRY_ROWS", 11)
    out = sections.best_angle(df)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == len(want) and all((x.xs_angle, round(x.top_width, 9)) == (want[x.cell_seq].angle, want[x.cell_seq].tw) for x in got)


def test_yearly_statistics_in_one_pass(spark):
    from pyspark.sql import functions as F

    from fluvial.operators import flow_stats

    rows = spark.range(400).select((F.col("id") % 7).alias("rivid"), F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id * 5 as int))").alias("time"), (F.col("id") * 37 % 101 / 7.0).alias("Qout"))
    every = flow_stats.yearly(rows, ("mean", "median", "max"))
    assert every._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    apart = flow_stats.yearly(rows, "mean").join(flow_stats.yearly(rows, "median"), "rivid").join(flow_stats.yearly(rows, "max"), "rivid")
    assert every.columns == apart.columns and sorted(every.collect()) == sorted(apart.collect())


def _repeated_results(spark):
    """Results of 300 cells, each twice in other partitions; one with zeros of both signs, one with a place twice but other flows."""
    inc = lambda q: [(q + k, 0.5 + k, 3.0, 10.0 + k, 4.0) for k in range(2)]
    rows = [(i % 7, i, i % 3, 0.1 * i, inc(float(i))) for i in range(300)] * 2
    rows += [(9, 1, 1, z, [(z, 1.0, 3.0, 1.0, z), (1.0, z, z, 2.0, 1.0)]) for z in (0.0, -0.0)] + [(9, 2, 2, float("nan"), inc(q)) for q in (1.0, 1.0, 2.0)] + [(9, 3, 3, 1.0, inc(-5.0))]
    return spark.createDataFrame(rows, "COMID long, Row long, Col long, Slope double, inc array<struct<q:double,v:double,t:double,wse:double,p:double>>").repartition(5)


def _told_apart_in_parts(spark, monkeypatch, made, columns):
    results = _repeated_results(spark)
    wide = lambda rows: made(results, 2, columns, rows)
    plan = wide(603)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("hashpartitioning(__row") :]
    assert "HashAggregate" in plan and "Aggregate" not in below  # what makes the wide rows keeps no table of them
    monkeypatch.setattr(outputs, "ROWS_APART", 50)
    parts = lambda df: int(re.search(r"hashpartitioning\(__row#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())[1])
    assert parts(wide(603)) == parts(made(results, 2, columns)) == 13 and parts(wide(6030)) == 121 and parts(wide(10**6)) == 200 and parts(wide(10**9)) == 1000
    for rows in (603, None, 1):
        got = wide(rows).collect()
        assert len(got) == 303 and sorted((x.COMID, x.Row, x.q_1) for x in got) == sorted([(i % 7, i, float(i)) for i in range(300)] + [(9, 1, 0.0), (9, 2, 1.0), (9, 2, 2.0)])


def test_rating_rows_are_told_apart_in_tasks_of_bounded_rows(spark, monkeypatch):
    _told_apart_in_parts(spark, monkeypatch, outputs.vdt, ["COMID", "Row", "Col", "Slope"])


def test_areas_are_told_apart_in_tasks_of_bounded_rows(spark, monkeypatch):
    _told_apart_in_parts(spark, monkeypatch, outputs.area_perimeter, ["COMID", "Row", "Col", "Slope"])


def test_levels_of_batches_equal_the_fold_and_are_read_once(spark, monkeypatch):
    r = random.Random(8)
    odd = lambda: r.choice([None, float("nan"), float("inf"), -0.0, 0.0, 1.0, 1.0, 2.0, r.uniform(-5, 5), r.uniform(-5, 5)])
    rows = [(i, i % 5, *[odd() for _ in range(13)]) for i in range(700)]
    columns = ["id", "COMID", "x", *[f"{n}_{i}" for i in (1, 2, 3) for n in ("q", "v", "t", "wse")]]
    df = spark.createDataFrame(rows, f"id long, COMID long, {', '.join(f'{c} double' for c in columns[2:])}").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        for k in (3, 1):
            pairs = lambda n: F.array(*[F.struct(F.col(f"q_{i}").alias("q"), F.col(f"{n}_{i}").alias("y")) for i in range(1, k + 1)])  # noqa: B023, E731
            want = {x.id: x for x in df.select("id", *[rating.interpolated(pairs(n), F.col("x")).alias(n) for n in ("v", "t", "wse")]).collect()}
            got = rating.with_interpolated(df, k, "x", {"v": "v", "t": "t", "wse": "wse"}, ["id"]).collect()
            same = lambda a, b: (a is None) == (b is None) and (a is None or a == b or (math.isnan(a) and math.isnan(b)))
            assert len(got) == 700 and all(same(x[n], want[x.id][n]) for x in got for n in ("v", "t", "wse"))
            assert sum(x.wse is None for x in got) > 10 and sum(x.wse is not None for x in got) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    settled = []
    monkeypatch.setattr(rating, "settle", lambda made, label: settled.append(label) or lineage.settle(made, label))
    table = spark.range(60).select((F.col("id") % 4).alias("COMID"), F.col("id").cast("int").alias("Row"), *[e.alias(f"{n}_{i}") for i in (1, 2) for n, e in (("q", F.lit(i)), ("v", F.lit(0.5 * i)), ("t", F.lit(2.0 * i)), ("wse", F.col("id") + 0.5 * i))])
    flows = spark.range(4).select("id", (F.col("id") + 1.5).cast("decimal(5,1)").alias("flow"))
    out = rating.evaluate_vdt(table, flows, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert settled == ["levels"] and "lambda" not in plan and out.columns == [*table.columns, "qout", "Velocity", "TopWidth", "WaterSurfaceElev_m"]
    assert {x.Row: (x.Velocity, x.TopWidth, x.WaterSurfaceElev_m) for x in out.collect()} == {i: (0.5 * x, 2 * x, i + 0.5 * x) for i in range(60) for x in [i % 4 + 1.5]}
    few = rating.evaluate_vdt(table, flows, 2, keep=("Row",))
    assert few.columns == ["COMID", "Row", "Velocity", "TopWidth", "WaterSurfaceElev_m"] and sorted(few.collect()) == sorted(out.select(*few.columns).collect())


def test_cells_are_gathered_in_tasks_of_bounded_rows(spark, monkeypatch, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(3000), r.randrange(5), r.randrange(3), float(r.randrange(50))) for _ in range(600)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(outputs, "ROWS_APART", 50)
    cells = carriers.cells(spark, str(tmp_path))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("hashpartitioning(comid") :]
    assert re.match(r"hashpartitioning\(comid#\d+L?, r#\d+L?, c#\d+L?, 12\)", below) and "Exchange" not in below and "Aggregate" not in below and plan.count("Exchange hash") == 1
    want = {}
    for order, supplier, line, quantity in rows:
        place = (supplier, order % 997, line)
        want[place] = min(quantity, want.get(place, quantity))
    assert {(x.comid, x.r, x.c): x.qty for x in cells.collect()} == want and cells.count() == len(want) < 600
