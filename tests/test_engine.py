"""Synthetic channels against normal depth in closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.plans.engine import Engine, Inputs
from fluvial.sources.config import Config

ROWS, LENGTH, PAD, CENTRE = 61, 120, 10, 30
COLS = LENGTH + 2 * PAD
SLOPE, FLOW, N = 0.001, 10.0, 0.025


def lateral(shape, o):
    flat = F.when(o <= 5, 0.0)
    return {"triangle": F.least(F.lit(20.0), o / 2), "trapezoid": flat.otherwise(F.least(F.lit(20.0), (o - 5) / 2)), "rectangle": flat.otherwise(20.0)}[shape]


def channel(spark, shape="triangle"):
    cells = spark.range(ROWS * COLS).select((F.col("id") / COLS).cast("int").alias("row"), (F.col("id") % COLS).cast("int").alias("col"))
    station = F.least(F.greatest(F.col("col") - PAD, F.lit(0)), F.lit(LENGTH))
    o = F.abs(F.col("row") - CENTRE)
    active = (F.col("col") >= PAD) & (F.col("col") < PAD + LENGTH)
    dem = cells.select("row", "col", (-SLOPE * station + F.when(active, lateral(shape, o)).otherwise(20.0)).alias("z"))
    streams = cells.where(active & (F.col("row") == CENTRE)).select("row", "col", F.when(F.col("col") < PAD + LENGTH // 2, 1).otherwise(2).cast("long").alias("comid"))
    cover = cells.select("row", "col", F.lit(1).alias("lc"))
    flows = spark.createDataFrame([(1, 0.0, FLOW), (2, 0.0, FLOW)], "comid long, q_base double, q_max double")
    manning = spark.createDataFrame([(1, N), (80, N)], "lc int, n double")
    ends = [(1, PAD, PAD + LENGTH // 2 - 1), (2, PAD + LENGTH // 2, PAD + LENGTH - 1)]
    lines = spark.createDataFrame([(k, [(a + 0.5, -CENTRE - 0.5), (b + 0.5, -CENTRE - 0.5)]) for k, a, b in ends], "comid long, pts array<struct<x:double,y:double>>")
    return Inputs(dem, streams, cover, flows, manning, ROWS, COLS, 1.0, 1.0, lines)


def normal_depth(shape):
    def flow(y):
        a, p = {"triangle": (2 * y * y, 2 * y * 5**0.5), "trapezoid": ((10 + 2 * y) * y, 10 + 2 * y * 5**0.5), "rectangle": (10 * y, 10 + 2 * y)}[shape]
        return a * (a / p) ** (2 / 3) * SLOPE**0.5 / N

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if flow(mid) < FLOW else (low, mid)
    return low


BASE = {"Flow_File_BF": "baseflow", "Degree_Manip": "0", "Degree_Interval": "0", "Gen_Slope_Dist": "10", "Gen_Dir_Dist": "10", "X_Section_Dist": "40", "VDT_Database_NumIterations": "2"}


@pytest.mark.parametrize("shape,method", [("triangle", "local_average"), ("trapezoid", "reach_average"), ("rectangle", "end_points"), ("triangle", "local_average_corrected")])
def test_channel_carries_its_flow_at_normal_depth(spark, shape, method):
    config = Config.of({**BASE, "Stream_Slope_Method": method, "StrmShp_File": "given"})
    vdt = Engine(spark, config, channel(spark, shape)).vdt().toPandas()
    assert len(vdt) > 0.9 * LENGTH and not vdt.isna().any().any()
    depth = normal_depth(shape)
    station = vdt["Col"] - PAD
    wse = vdt["wse_2"] - (depth - SLOPE * station)
    assert wse.abs().median() < 0.1 and wse.abs().max() < 0.75
    area = {"triangle": 2 * depth**2, "trapezoid": (10 + 2 * depth) * depth, "rectangle": 10 * depth}[shape]
    width = {"triangle": 4 * depth, "trapezoid": 10 + 4 * depth, "rectangle": 10}[shape]
    assert (vdt["t_2"] - width).abs().median() < 1.0 and (vdt["v_2"] - FLOW / area).abs().median() < 0.1
    assert (vdt["q_2"] - FLOW).abs().median() < 0.1 and (vdt["q_1"] < vdt["q_2"]).all()
    if method in ("reach_average", "end_points"):
        assert vdt.groupby("COMID")["Slope"].agg(np.ptp).max() < 1e-10


def test_curves_sections_and_turning(spark):
    config = Config.of({**BASE, "VDT_Database_NumIterations": "8", "Degree_Manip": "24", "Degree_Interval": "6", "Low_Spot_Range": "2", "Print_Curve_File": "c.csv"})
    engine = Engine(spark, config, channel(spark))
    curves = engine.curves().toPandas()
    assert len(curves) > 0.8 * LENGTH
    top = curves["depth_a"] * FLOW ** curves["depth_b"]
    assert (top - normal_depth("triangle")).abs().median() < 0.1
    assert (curves["depth_b"] - 3 / 8).abs().median() < 0.05 and (curves["tw_b"] - 3 / 8).abs().median() < 0.05
    assert engine.area_perimeter().count() == engine.vdt().count()
    rows = engine.section_rows().first()
    assert rows.XS1_Profile.startswith("[") and len(rows.XS1_Profile.split(" ")) == 21
    config.reach_curves = True
    pooled = engine.curves().toPandas()
    assert pooled.groupby("COMID")["depth_a"].nunique().max() == 1 and (pooled["depth_b"] - 3 / 8).abs().max() < 0.05


def test_bathymetry_is_burnt_and_independent_of_partitions(spark):
    inputs = channel(spark, "trapezoid")
    inputs.flows = spark.createDataFrame([(1, 3.0, FLOW), (2, 3.0, FLOW)], "comid long, q_base double, q_max double")
    config = Config.of({**BASE, "AROutBATHY": "b.tif", "Stream_Slope_Method": "reach_average"})
    first = Engine(spark, config, inputs).bathymetry_grid().toPandas().sort_values(["row", "col"]).reset_index(drop=True)
    inputs.streams = inputs.streams.repartition(7)
    again = Engine(spark, config, inputs).bathymetry_grid().toPandas().sort_values(["row", "col"]).reset_index(drop=True)
    assert len(first) and first.equals(again)
    at = first[first["row"] == CENTRE]
    bed = -SLOPE * (at["col"] - PAD)
    assert (at["z"] < bed - 0.1).all()


def test_rejected_without_a_slope(spark):
    config = Config.of({**BASE, "Gen_Slope_Dist": "0"})  # an empty box: slope 0, no flow reaches the target
    assert Engine(spark, config, channel(spark)).vdt().count() == 0
