"""Hydrology made of the driver's tables, so that operators can be checked against SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.outputs import tasks_for

#: The same in DuckDB. reach: comid, slope, q_max, q_base, n. cell: unique (comid, r, c) with a side slope.
REACH_SQL = """reach AS (SELECT s_suppkey AS comid, 0.0005::DOUBLE + 0.0001::DOUBLE * (s_suppkey % 20) AS slope,
    5.0::DOUBLE + abs(s_acctbal) / 500.0::DOUBLE AS q_max, 0.5::DOUBLE AS q_base, 0.02::DOUBLE + 0.005::DOUBLE * (s_nationkey % 5) AS n FROM supplier)"""
CELL_SQL = """cell AS (SELECT l_suppkey AS comid, (l_orderkey % 997)::BIGINT AS r, l_linenumber AS c, min(l_quantity) AS qty,
    1.0::DOUBLE + min(l_quantity) / 25.37::DOUBLE AS side FROM lineitem GROUP BY ALL)"""
GRID_SQL = """grid AS (SELECT (l_orderkey % 600)::BIGINT AS "row", (l_suppkey * 4 + l_partkey % 4)::BIGINT AS col, round_even(avg(l_extendedprice) / 1000.0::DOUBLE * 1000, 0) / 1000 AS z,
    min(l_suppkey) AS comid FROM lineitem GROUP BY ALL)"""
#: Rows of the grid. Each supplier is a stream along them, a strip of so many columns wide: the grid grows with the suppliers.
ROWS, STRIP = 600, 4
LENGTH, DZ = 21, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("comid"),
        (0.0005 + 0.0001 * (F.col("s_suppkey") % 20)).alias("slope"),
        (5.0 + F.abs("s_acctbal") / 500.0).alias("q_max"),
        F.lit(0.5).alias("q_base"),
        (0.02 + 0.005 * (F.col("s_nationkey") % 5)).alias("n"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a cell are few, so they are dealt into tasks of bounded rows first, not gathered where they are read."""
    items = table(spark, sf_dir, "lineitem")
    named = items.select(F.col("l_suppkey").alias("comid"), (F.col("l_orderkey") % 997).alias("r"), F.col("l_linenumber").alias("c"), "l_quantity")
    by = named.repartition(tasks_for(spark, items.count()), "comid", "r", "c").groupBy("comid", "r", "c")
    return by.agg(F.min("l_quantity").alias("qty")).withColumn("side", 1.0 + F.col("qty") / 25.37)  # no exact halves to round


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangular sections: p[i] = i * dz / side on both sides, one roughness."""
    out = cells(spark, sf_dir).join(reach(spark, sf_dir), "comid")
    p = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: i * F.lit(DZ) / F.col("side"))
    n = F.array_repeat(F.col("n"), LENGTH)
    return out.withColumns({"p1": p, "n1": n, "dz": F.lit(DZ)}).withColumns({"p2": F.col("p1"), "n2": F.col("n1")})


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % ROWS).alias("row"), (F.col("l_suppkey") * STRIP + F.col("l_partkey") % STRIP).alias("col"))
    return by.agg((F.rint(F.avg("l_extendedprice") / 1000.0 * 1000) / 1000).alias("z"), F.min("l_suppkey").alias("comid"))


def columns(spark: SparkSession, sf_dir: str) -> int:
    """Columns of the grid."""
    return STRIP * (table(spark, sf_dir, "lineitem").agg(F.max("l_suppkey")).first()[0] + 1)
