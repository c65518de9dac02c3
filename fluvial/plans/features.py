"""Rating-curve queries for forecasts: thinned point features with headwater tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbourhood, rating, spatial


def _placed(rows: DataFrame, transform: tuple) -> DataFrame:
    return rating.cell_centres(rows, transform[0], transform[3], transform[1], -transform[5])


def _in_metres(points: DataFrame, geographic: bool) -> DataFrame:
    """x and y to measure by: degrees become cylindrical equal-area coordinates, and stand beside them meanwhile."""
    x, y = spatial.equal_area(F.col("x"), F.col("y")) if geographic else (F.col("x"), F.col("y"))
    return points.withColumns({"__x": F.col("x"), "__y": F.col("y"), "x": x, "y": y})


def _finished(rows: DataFrame, seeds: DataFrame, thin: bool, distance: float, percent: float, geographic: bool) -> DataFrame:
    rows, seeds = _in_metres(rows, geographic), _in_metres(seeds, geographic)
    rows = rows.withColumn("__order", F.struct("Row", "Col", "COMID"))
    if thin:
        # A cell's place in row-major order names it; reaches that share a cell stay apart by their id.
        rows = rows.withColumn("__id", F.format_string("%012d-%012d-%020d", F.col("Row").cast("long"), F.col("Col").cast("long"), F.col("COMID").cast("long")))
        rows = spatial.thin(rows, distance, percent, "__id", "WaterSurfaceElev_m").drop("__id")
    tagged = spatial.tag_seeds(rows.drop("__order"), seeds)
    return tagged.withColumns({"x": F.col("__x"), "y": F.col("__y")}).drop("__x", "__y")


def curve_features(curves: DataFrame, forecast: DataFrame, seeds: DataFrame, transform: tuple, thin: bool = True, distance: float = 50.0, percent: float = 0.05, geographic: bool = False) -> DataFrame:
    """From curve rows: evaluate, drop depth outliers, thin, tag. ``seeds``: seed, x, y. Distances are metres, on
    ``geographic`` grids too."""
    rows = rating.depth_outliers_dropped(rating.evaluate_curves(curves, forecast))
    return _finished(_placed(rows, transform), seeds, thin, distance, percent, geographic)


def vdt_features(vdt: DataFrame, forecast: DataFrame, seeds: DataFrame, transform: tuple, increments: int, thin: bool = True, round_level: bool = True, distance: float = 50.0, percent: float = 0.05, geographic: bool = False) -> DataFrame:
    """From a VDT database: interpolate, drop what lies beyond two deviations, thin, tag."""
    rows = rating.evaluate_vdt(vdt, forecast, increments, round_level=round_level)
    return _finished(_placed(rows, transform), seeds, thin, distance, percent, geographic)


def raster_seeds(cells: DataFrame, transform: tuple, n_rows: int, n_cols: int, border: int = 1) -> DataFrame:
    """Seed cells of a stream grid: terminal cells and cells at the border; COMID, Long, Lat, Row, Col, MinElev, MaxElev."""
    ends = neighbourhood.terminal_cells(cells).select("row", "col", "comid")
    edge = cells.where((F.col("row") < border) | (F.col("col") < border) | (F.col("row") >= n_rows - border) | (F.col("col") >= n_cols - border)).select("row", "col", "comid")
    found = ends.unionByName(edge).distinct().join(neighbourhood.elevation_range(cells), "comid")
    out = _placed(found.select(F.col("comid").alias("COMID"), F.col("row").alias("Row"), F.col("col").alias("Col"), F.col("min_elev").alias("MinElev"), F.col("max_elev").alias("MaxElev")), transform)
    return out.select("COMID", F.col("y").alias("Lat"), F.col("x").alias("Long"), "Row", "Col", "MinElev", "MaxElev")
