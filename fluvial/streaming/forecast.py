"""A stream of forecasts against a static rating database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..operators.rating import interpolated


def levels(forecasts: DataFrame, vdt: DataFrame, increments: int) -> DataFrame:
    """Water level of each cell for each forecast (COMID, time, qout) of a stream: a stream-static join, no state."""
    pairs = F.array(*[F.struct(F.col(f"q_{i}").alias("q"), F.col(f"wse_{i}").alias("y")) for i in range(1, increments + 1)])
    rated = vdt.select("COMID", "Row", "Col", pairs.alias("pairs"))
    return forecasts.join(rated, "COMID").select("COMID", "Row", "Col", "time", "qout", rounded(interpolated(F.col("pairs"), F.col("qout"))).alias("WaterSurfaceElev_m"))


def hourly_peak(forecasts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Highest forecast of each reach and hour, with a bound on how late one may come."""
    return forecasts.withWatermark("time", late).groupBy("COMID", F.window("time", "1 hour")).agg(F.max("qout").alias("qout"))
