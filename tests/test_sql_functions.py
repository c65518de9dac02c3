"""Functions in SQL against the column functions, and the commands that prepare inputs."""

import random
from math import atan2, cos, degrees, hypot, pi, sin

import numpy as np
from pyspark.sql import functions as F

from fluvial.functions import hydraulics, sql
from fluvial.operators import rating
from fluvial.plans import prepare
from fluvial.sources import arrays, layers, raster

from .hdf5_files import Writer


def test_functions_equal_the_column_functions(spark):
    sql.register(spark)
    r = random.Random(3)
    rows = []
    for k in range(300):
        n = r.randrange(0, 6)
        pairs = [(r.choice([None, float("nan"), 5.0, r.uniform(0, 40)]), r.choice([None, float("inf"), 2.0, r.uniform(0, 9)])) if r.random() < 0.3 else (r.uniform(0, 40), r.uniform(0, 9)) for _ in range(n)]
        rows.append((k, r.uniform(0, 50), r.choice([0.0, 1e-9, r.uniform(0, 60)]), r.choice([0.0, r.uniform(0, 9)]), r.uniform(1e-5, 0.1), pairs, r.uniform(-5, 50)))
    df = spark.createDataFrame(rows, "k int, a double, p double, pn double, s double, pairs array<struct<q:double,y:double>>, x double")
    df.createOrReplaceTempView("made")
    got = spark.sql("SELECT k, manning_q(a, p, pn, s) AS q, rating_interp(pairs, x) AS y, power_curve(a, x * x, 0.4D) AS c FROM made")
    want = df.select(F.col("k"), hydraulics.discharge(F.col("a"), F.col("p"), F.col("pn"), F.col("s")).alias("q"), rating.interpolated(F.col("pairs"), F.col("x")).alias("y"), (F.rint(hydraulics.power(F.col("a"), F.col("x") * F.col("x"), F.lit(0.4)) * 1000) / 1000).alias("c"))
    for g, w in zip(sorted(got.collect()), sorted(want.collect(), key=lambda x: x.k)):
        assert g.k == w.k and all((a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))) for a, b in zip(g[1:], w[1:])), (g, w)
    table = spark.sql("SELECT * FROM ordinates(3, 10.0D, 20.0D) WHERE angle_idx = 15 ORDER BY side, i").collect()
    assert [(t.side, t.i, round(t.row_offset, 9), round(t.col_offset, 9), round(t.distance, 9)) for t in table] == [(-1, i, -float(i) + 0.0, 0.0, 20.0 * i) for i in range(3)] + [(1, i, float(i), 0.0, 20.0 * i) for i in range(3)]


def test_angles_bearings_and_scenarios(spark, tmp_path):
    like = raster.Header("<", 12, 15, "i4", 1, 1, (12, 15), [], [], (100.0, 10.0, 0.0, 500.0, 0.0, -10.0), False, 26912, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26912)})
    raster.write_grid(spark.createDataFrame([(i, i + 1, 7.0) for i in range(10)], "row int, col int, v double"), str(tmp_path / "s.tif"), like, "i4", 0)
    r = random.Random(5)
    points = [(100 + r.uniform(0, 150), 500 - r.uniform(0, 120)) for _ in range(30)]
    layers.write_shapefile(spark.createDataFrame([(7, [points[:10], points[9:20]]), (8, [points[20:]])], f"id long, parts {layers.PARTS}"), str(tmp_path / "l.shp"))
    prepare.main(["angles", "--strm_shp", str(tmp_path / "l.shp"), "--strm_raster_file", str(tmp_path / "s.tif"), "--out_file", str(tmp_path / "a.tif")])
    got = {(x.row, x.col): x.v for x in raster.read_grid(spark, str(tmp_path / "a.tif"))[0].collect()}
    for i in range(10):
        x, y = 100 + 10 * (i + 1) + 5, 500 - 10 * i - 5
        near = sorted(set(points), key=lambda p: hypot(p[0] - x, p[1] - y))[1:5]
        bearing = [atan2(q - y, p - x) for p, q in near]
        assert got.get((i, i + 1), 0) == round(degrees(atan2(sum(map(sin, bearing)), sum(map(cos, bearing)))))
    assert all(k[1] == k[0] + 1 for k in got)  # zeros read as missing
    prepare.main(["bearings", "--strm_shp", str(tmp_path / "l.shp"), "--stream_id_field", "id", "--out_file", str(tmp_path / "b.txt")])
    back = {x.id: x.bearing for x in spark.read.csv(str(tmp_path / "b.txt"), header=True, sep="\t", inferSchema=True).collect()}
    assert abs(back[8] - atan2(points[-1][1] - points[20][1], points[-1][0] - points[20][0])) < 1e-9 and -pi <= back[7] <= pi
    w = Writer(True)
    w.dataset("rivid", np.array([3, 4], "<i4"), attrs={"CLASS": "DIMENSION_SCALE", "NAME": "rivid"})
    for k, name in enumerate(("rp2", "rp100")):
        w.dataset(name, np.array([1.5, 2.5]) + k, attrs={"DIMENSION_LIST": ["rivid"]})
    w.save(tmp_path / "rp.nc")
    prepare.main(["scenarios", "--netcdf_file", str(tmp_path / "rp.nc"), "--id_field", "rivid", "--out_folder", str(tmp_path / "q"), "--flows", "small=rp2", "large=rp100"])
    for name, add in (("small", 0), ("large", 1)):
        assert sorted((x.COMID, x.qout) for x in spark.read.csv(str(tmp_path / "q" / f"{name}.csv"), header=True, inferSchema=True).collect()) == [(3, 1.5 + add), (4, 2.5 + add)]
    assert arrays.netcdf_files(str(tmp_path)) == [str(tmp_path / "rp.nc")]
