"""Tabular inputs: flows, roughness, curves, VDT databases, forecasts, manual sections, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURVE_SCHEMA = "COMID bigint, Row bigint, Col bigint, BaseElev double, DEM_Elev double, QMax double, Slope double, XS_Angle double, depth_a double, depth_b double, tw_a double, tw_b double, vel_a double, vel_b double"
#: Land-cover classes of the national product that runs start from, and their roughness (fixed values).
DEFAULT_ROUGHNESS = (
    (11, "Water", 0.030),
    (21, "Dev_Open_Space", 0.013),
    (22, "Dev_Low_Intesity", 0.050),
    (23, "Dev_Med_Intensity", 0.075),
    (24, "Dev_High_Intensity", 0.100),
    (31, "Barren_Land", 0.030),
    (41, "Decid_Forest", 0.120),
    (42, "Evergreen_Forest", 0.120),
    (43, "Mixed_Forest", 0.120),
    (52, "Shrub", 0.050),
    (71, "Grass_Herb", 0.030),
    (81, "Pasture_Hay", 0.040),
    (82, "Cultivated_Crops", 0.035),
    (90, "Woody_Wetlands", 0.100),
    (95, "Emergent_Herb_Wet", 0.100),
)
MANUAL_ARRAYS = {"XS1_Profile": "double", "XS2_Profile": "double", "LC1_Profile": "int", "LC2_Profile": "int", "XS1_Row": "int", "XS1_Col": "int", "XS2_Row": "int", "XS2_Col": "int"}


def read_table(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Parquet by its name, else delimited text with a header."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def clean(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_flows(spark: SparkSession, path: str, key: str, base: str | None, qmax: str) -> DataFrame:
    """comid, q_base (null without a column), q_max; a repeated id is refused."""
    flows = clean(read_table(spark, path))
    out = flows.select(F.col(key).cast("long").alias("comid"), (F.col(base).cast("double") if base else F.lit(None).cast("double")).alias("q_base"), F.col(qmax).cast("double").alias("q_max"))
    if not out.groupBy("comid").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: repeated ids in {key}")
    return out


def read_roughness(spark: SparkSession, path: str) -> DataFrame:
    """lc, n by position (first and third column); the last of repeated classes counts."""
    raw = read_table(spark, path, "\t")
    rows = raw.select(F.col(raw.columns[0]).cast("int").alias("lc"), F.col(raw.columns[2]).cast("double").alias("n"), F.monotonically_increasing_id().alias("i"))
    return rows.groupBy("lc").agg(F.max_by("n", "i").alias("n"))


def roughness_of(cover: DataFrame, manning: DataFrame) -> DataFrame:
    """n of each row's class; a class that is not listed counts 0; over 10 is 0.035, not positive is 0.005. There are at
    most 256 classes, so the table is broadcast."""
    n = F.coalesce("n", F.lit(0.0))
    return cover.join(F.broadcast(manning), "lc", "left").withColumn("n", F.when(n > 10, 0.035).when(n <= 0, 0.005).otherwise(n))


def shift_negative(grid: DataFrame, by: float = 100.0) -> tuple[DataFrame, bool]:
    """The grid raised by 100 if any elevation is negative, and whether it was."""
    least = grid.agg(F.min("z")).first()[0]
    shifted = least is not None and least < 0
    return (grid.withColumn("z", F.col("z") + by) if shifted else grid), shifted


def parse_arrays(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON arrays (or Python lists, with or without parentheses) as arrays of the given types."""
    text = lambda c: F.translate(F.trim(c), "()", "[]")
    return df.withColumns({c: F.from_json(text(c), f"array<{t}>") for c, t in columns.items()})


def read_manual_sections(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Sections given by hand; missing columns, or sides whose arrays differ in length, are refused."""
    raw = read_table(spark, path, "\t" if path.endswith((".tsv", ".txt")) else ",")
    missing = {key, "Row", "Col", "Ordinate_Dist", *MANUAL_ARRAYS} - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    rows = parse_arrays(raw, MANUAL_ARRAYS)
    for side in (1, 2):
        sizes = [F.size(c) for c in (f"LC{side}_Profile", f"XS{side}_Row", f"XS{side}_Col")]
        ok = sizes[0] == F.size(f"XS{side}_Profile")
        for s in sizes[1:]:
            ok = ok & (s == F.size(f"XS{side}_Profile"))
        rows = rows.withColumn(f"XS{side}_Profile", F.when(ok, F.col(f"XS{side}_Profile")).otherwise(F.raise_error(F.concat(F.lit(f"side {side} arrays of different lengths in "), F.col(key).cast("string")))))
    source = F.col("Source_Stream_ID") if "Source_Stream_ID" in raw.columns else F.col(key)
    angle: Column = F.col("XS_Angle") if "XS_Angle" in raw.columns else F.lit(0.0)
    rc = lambda s: F.arrays_zip(F.col(f"XS{s}_Row").alias("r"), F.col(f"XS{s}_Col").alias("c"))
    return rows.select(
        F.col(key).cast("long").alias("comid"), source.cast("long").alias("source_id"), F.col("Row").cast("long").alias("row"), F.col("Col").cast("long").alias("col"), F.col("Ordinate_Dist").cast("double").alias("dz"),
        angle.cast("double").alias("xs_direction"), F.col("XS1_Profile").alias("p1"), F.col("LC1_Profile").alias("lc1"), rc(1).alias("rc1"), F.col("XS2_Profile").alias("p2"), F.col("LC2_Profile").alias("lc2"), rc(2).alias("rc2"),
    )


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema=CURVE_SCHEMA)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path)
    return raw.select(F.col(raw.columns[0]).cast("long").alias("COMID"), F.col(raw.columns[1]).cast("double").alias("qout"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed points as they were written; values stay strings."""
    return spark.read.option("header", True).csv(path)


def default_roughness(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_ROUGHNESS), "LC_ID int, Description string, Manning_n double")
