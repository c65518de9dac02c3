"""Line layers: GeoJSON, GeoParquet (WKB), shapefiles and GeoPackages, as rows with parts (arrays of x, y)."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import projections
from . import layers
from .files import read_bytes

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<{POINT}>>"


def parse_wkb(data: bytes) -> list[list[tuple[float, float]]]:
    """Parts of a (multi) line or point; further coordinates than x and y are skipped."""

    def one(at: int) -> tuple[list[list[tuple[float, float]]], int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if kind & 0x20000000:
            at += 4
        extra = bin(kind >> 30).count("1") if kind > 0x10000000 else {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000 % 4]
        base, width = (kind & 0xFF if kind > 0x10000000 else kind % 1000), 2 + extra
        if base == 1:
            return [[struct.unpack_from(order + "2d", data, at)]], at + 8 * width
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if base == 2:
            return [[struct.unpack_from(order + "2d", data, at + 8 * width * i) for i in range(n)]], at + 8 * width * n
        if base not in (4, 5):
            raise ValueError(f"geometry kind {base} is not a line or point")
        parts = []
        for _ in range(n):
            found, at = one(at)
            parts += found
        return parts, at

    return one(0)[0]


def with_parts(raw: DataFrame, geometry: str) -> DataFrame:
    """The parts of a column of WKB, in Arrow batches; null stays null."""
    kept = [c for c in raw.columns if c != geometry]
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if d is None else [[{"x": v[0], "y": v[1]} for v in part] for part in parse_wkb(d)] for d in batch.column(geometry).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, kind)], [*kept, "parts"])

    return raw.mapInArrow(run, ", ".join([*[f"`{c}` {raw.schema[c].dataType.simpleString()}" for c in kept], f"parts {PARTS}"]))


def make_wkb(parts: list[list[tuple[float, float]]]) -> bytes:
    """A multi-line, or a multi-point where every part is one vertex."""
    if all(len(p) == 1 for p in parts):
        return struct.pack("<BII", 1, 4, len(parts)) + b"".join(struct.pack("<BI2d", 1, 1, *p[0]) for p in parts)
    return struct.pack("<BII", 1, 5, len(parts)) + b"".join(struct.pack("<BII", 1, 2, len(p)) + b"".join(struct.pack("<2d", *v) for v in p) for p in parts)


def with_wkb(lines: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``parts`` as WKB."""
    kept = [c for c in lines.columns if c != "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if p is None else make_wkb([[(v["x"], v["y"]) for v in part] for part in p]) for p in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.binary())], [*kept, geometry])

    return lines.mapInArrow(run, ", ".join([*[f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in kept], f"{geometry} binary"]))


def _rows(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    kinds = []
    for c in columns:
        seen = [r[c] for r in rows if r.get(c) is not None]
        kinds.append(T.LongType() if seen and all(isinstance(v, int) for v in seen) else T.DoubleType() if seen and all(isinstance(v, (int, float)) for v in seen) else T.StringType())
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([*[T.StructField(c, k) for c, k in zip(columns, kinds)], T.StructField("parts", T.ArrayType(T.ArrayType(point)))])
    cast = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str}
    values = [(*[None if r.get(c) is None else cast[k](r[c]) for c, k in zip(columns, kinds)], r["parts"]) for r in rows]
    return spark.createDataFrame(values, schema)


def _geojson(path: str) -> list[dict]:
    out = []
    for f in json.loads(read_bytes(path))["features"]:
        g = f["geometry"]
        parts = {"LineString": lambda c: [c], "MultiLineString": lambda c: c, "Point": lambda c: [[c]], "MultiPoint": lambda c: [[p] for p in c]}[g["type"]](g["coordinates"])
        out.append({**f["properties"], "parts": [[(float(p[0]), float(p[1])) for p in part] for part in parts]})
    return out


def read_lines(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Attributes and parts. GeoParquet, shapefiles and GeoPackages are read by tasks in ranges; a GeoJSON file is one
    text, which the driver reads."""
    if path.endswith((".parquet", ".geoparquet")):
        raw = spark.read.parquet(path)
        return with_parts(raw, "geometry" if "geometry" in raw.columns else "geom")
    if path.endswith(".shp"):
        return layers.read_shapefile(spark, path)
    if path.endswith(".gpkg"):
        return with_parts(layers.read_geopackage(spark, path, layer), "geometry")
    if path.endswith((".geojson", ".json")):
        rows = _geojson(path)
        return _rows(spark, rows, sorted({k for r in rows for k in r if k != "parts"}))
    raise ValueError(f"{path}: unknown vector format")


def system_of(path: str) -> projections.System | None:
    """The coordinate system that a layer states: a shapefile by its .prj, GeoJSON by its member or as degrees; else None."""
    if path.endswith(".shp"):
        prj = path.removesuffix(".shp") + ".prj"
        return projections.of_wkt(read_bytes(prj).decode("latin-1")) if layers._exists(prj) else None
    if path.endswith((".geojson", ".json")):
        named = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]*)"', read_bytes(path)[:4096].decode("utf-8", "replace"), re.S)
        code = re.search(r"(\d+)$", named[1]) if named and "EPSG" in named[1] else None
        return projections.of_epsg(code[1] if code else 4326)
    return None


def longest_part(lines: DataFrame) -> DataFrame:
    """pts: the part with most length of each line."""
    size = "aggregate(sequence(1, greatest(size(p) - 1, 1)), 0.0D, (s, i) -> s + coalesce(hypot(get(p, i).x - p[i - 1].x, get(p, i).y - p[i - 1].y), 0.0D))"
    return lines.withColumn("pts", F.expr(f"array_max(transform(parts, (p, k) -> struct({size} AS len, -k AS k, p AS p))).p"))
