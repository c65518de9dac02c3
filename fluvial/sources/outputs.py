"""Result tables: rating (VDT), area and perimeter, curves, sections, features; and their writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..operators import spatial
from . import files, layers, vectors

#: Rows that a task tells apart: as many while ``FEW_TASKS`` do (a shuffle into few parts is not sorted in memory), and
#: at most in larger tables.
ROWS_APART, MOST_ROWS_APART, FEW_TASKS = 250_000, 1_000_000, 200


def _each(name: str, i: int) -> Column:
    return F.get("inc", F.lit(i - 1))[name]


def _places(c: str) -> int:
    return {"XS_Angle": 7, "Slope": 8}.get(c, 3)


def _named(df: DataFrame, columns: list[str]) -> list[Column]:
    return [rounded(c, _places(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*columns).dtypes]


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks tell so many rows apart."""
    return max(spark.sparkContext.defaultParallelism, min(FEW_TASKS, -(-rows // ROWS_APART)), -(-rows // MOST_ROWS_APART))


def _told_apart(wide: DataFrame, rows: int) -> DataFrame:
    """Repeated rows are one. They meet under one number of all their columns, in as many tasks as ``rows`` need, so that
    no task's table of wide rows grows with the rows, and the tasks that make them keep none."""
    return wide.withColumn("__row", F.xxhash64(*wide.columns)).repartition(tasks_for(wide.sparkSession, rows), "__row").dropDuplicates().drop("__row")


def vdt(results: DataFrame, increments: int, columns: list[str], rows: int | None = None) -> DataFrame:
    """q_i, v_i, t_i, wse_i of every increment; rows with a missing or negative q, t or v go, repeated rows are one.

    ``rows``: how many results there are at most; without it they are counted, so they should be written ones.
    """
    good = F.forall("inc", lambda x: (x["q"] >= 0) & (x["v"] >= 0) & (x["t"] >= 0) & x["wse"].isNotNull())
    wide = [rounded(_each(n, i)).alias(f"{n}_{i}") for i in range(1, increments + 1) for n in ("q", "v", "t", "wse")]
    made = results.where(good & (F.size("inc") == increments)).select(*_named(results, columns), *wide)
    return _told_apart(made, results.count() if rows is None else rows)


def area_perimeter(results: DataFrame, increments: int, columns: list[str], rows: int | None = None) -> DataFrame:
    """q_i, a_i = q_i / v_i (0 where v_i is 0) and p_i of every increment; repeated rows are one. ``rows`` as in ``vdt``."""
    area = lambda i: F.coalesce(F.try_divide(_each("q", i), _each("v", i)), F.lit(0.0))
    wide = [rounded(c).alias(f"{n}_{i}") for i in range(1, increments + 1) for n, c in (("q", _each("q", i)), ("a", area(i)), ("p", _each("p", i)))]
    good = F.forall("inc", lambda x: (x["q"] >= 0) & (x["v"] >= 0) & (x["p"] >= 0))
    made = results.where(good & (F.size("inc") == increments)).select(*_named(results, columns), *wide)
    return _told_apart(made, results.count() if rows is None else rows)


def section_rows(sections: DataFrame) -> DataFrame:
    """Sections with arrays printed in brackets with six decimals."""
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), " "), F.lit("]"))
    end = lambda s, f: F.element_at(f"rc{s}", -1)[f]
    return sections.select(
        "COMID", "Row", "Col", text("p1").alias("XS1_Profile"), F.col("dz").alias("Ordinate_Dist"), text("n1").alias("Manning_N_Raster1"), text("p2").alias("XS2_Profile"), text("n2").alias("Manning_N_Raster2"),
        end(1, "r").alias("r1"), end(1, "c").alias("c1"), end(2, "r").alias("r2"), end(2, "c").alias("c2"),
    )


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of Parquet (zstd) or of delimited text with a header, by the path's ending."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def features(points: DataFrame, third: str | None = None) -> DataFrame:
    """One GeoJSON feature a row (column value): WaterSurfaceElev_m, SEED and the point."""
    place = [F.col("x"), F.col("y"), *([F.col(third)] if third else [])]
    return points.select(
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("WaterSurfaceElev_m", "SEED").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(*place).alias("coordinates")).alias("geometry"))).alias("value")
    )


def _collection(rows: DataFrame, path: str, crs: str | None) -> None:
    """Features (column value) as one FeatureCollection file: written by tasks, put together piece by piece."""
    head = {"type": "FeatureCollection", **({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})}
    rows.write.mode("overwrite").text(f"{path}.parts")
    files.joined(f"{path}.parts", path, (json.dumps(head)[:-1] + ', "features": [\n').encode(), b",\n", b"\n]}\n")


def write_geojson(points: DataFrame, path: str, crs: str | None = None, third: str | None = None, zone: int | None = None, south: bool = False) -> None:
    """Point features with WaterSurfaceElev_m and SEED as one FeatureCollection file, its CRS named in it. Points in a
    UTM ``zone`` are written in degrees."""
    if zone is not None:
        lon, lat = spatial.geographic(F.col("x"), F.col("y"), zone, south)
        points = points.withColumns({"x": lon, "y": lat})
    _collection(features(points, third), path, crs)


def write_points_geojson(points: DataFrame, path: str, epsg: int | str) -> None:
    """x, y, z as one FeatureCollection of 3-D points without properties; a CRS member names the EPSG code."""
    at = F.struct(F.lit("Point").alias("type"), F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("coordinates"))
    rows = points.select(F.concat(F.lit('{"type": "Feature", "geometry": '), F.to_json(at), F.lit(', "properties": {}}')).alias("value"))
    _collection(rows, path, f"urn:ogc:def:crs:EPSG::{epsg}")


def write_vector(lines: DataFrame, path: str, crs: str | None = None) -> None:
    """Attributes and ``parts`` (arrays of x, y) by the path's ending: Parquet with WKB in ``geometry``, GeoJSON, or a
    shapefile. Lines of one vertex are points."""
    rest = [c for c in lines.columns if c != "parts"]
    if path.endswith((".parquet", ".geoparquet")):
        vectors.with_wkb(lines).write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif path.endswith((".geojson", ".json")):
        kind = F.when(F.forall("parts", lambda p: F.size(p) == 1), "MultiPoint").otherwise("MultiLineString")
        lists = F.transform("parts", lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"])))
        points = F.flatten(lists)
        shape = F.when(kind == "MultiPoint", F.to_json(F.struct(kind.alias("type"), points.alias("coordinates")))).otherwise(F.to_json(F.struct(kind.alias("type"), lists.alias("coordinates"))))
        made = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(*rest)) if rest else F.lit("{}"), F.lit(', "geometry": '), shape, F.lit("}"))
        _collection(lines.select(made.alias("value")), path, crs)
    elif path.endswith(".shp"):
        layers.write_shapefile(lines, path)
    else:
        raise ValueError(f"{path}: unknown vector format")


def write_angles(reaches: DataFrame, path: str, key: str, angle: str = "bearing") -> None:
    """Delimited text (tabs) of whole ids and angles in radians."""
    write_table(reaches.select(F.col(key).cast("long").alias(key), angle), path, "\t")


def scenario_flows(flows: DataFrame, names: dict[str, str], folder: str, key: str = "COMID") -> None:
    """A forecast file (COMID, qout) for each scenario: name -> flow column."""
    for name, column in names.items():
        write_table(flows.select(F.col(key).alias("COMID"), F.col(column).alias("qout")), f"{folder}/{name}.csv")
