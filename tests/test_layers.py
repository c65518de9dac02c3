"""Shapefiles and GeoPackages in ranges, the shapefile writer, and the systems that layers state."""

import os
import sqlite3
import struct

import pytest

from fluvial.functions import projections
from fluvial.sources import layers, outputs, vectors

from .test_projections import WKT_1

ROWS = [(i, None if i % 7 == 3 else i / 8 - 2, f"näme {i}" if i % 5 else None, [[(float(i), 1.0), (i + 0.5, 2.0)], [(5.0, float(i)), (9.0, 5.0), (9.5, -6.0)]][: 1 + i % 2]) for i in range(57)]
KIND = f"id long, height double, name string, parts {layers.PARTS}"


def plain(rows):
    return sorted((r.id, r.height, r.name, [[(p.x, p.y) for p in part] for part in r.parts]) for r in rows)


def test_shapefile_round_trip(spark, tmp_path):
    path = str(tmp_path / "l.shp")
    df = spark.createDataFrame(ROWS + [(-5, 1e300, "", [])], KIND).repartition(4)
    layers.write_shapefile(df, path, WKT_1)
    assert sorted(os.listdir(tmp_path)) == ["l.cpg", "l.dbf", "l.prj", "l.shp", "l.shx"]
    back = layers.read_shapefile(spark, path, partition_bytes=600)
    assert back.rdd.getNumPartitions() > 5 and back.dtypes == df.dtypes
    assert plain(back.collect()) == sorted(ROWS + [(-5, 1e300, None, [])])  # an empty text has no mark of its own
    raw = open(path, "rb").read()
    assert struct.unpack(">I", raw[24:28])[0] * 2 == len(raw) and struct.unpack("<I", raw[32:36])[0] == layers.LINE
    at, numbers = 100, []
    while at < len(raw):  # records are numbered through
        number, size = struct.unpack(">II", raw[at : at + 8])
        numbers.append(number)
        at += 8 + 2 * size
    assert numbers == list(range(1, 59))
    assert vectors.read_lines(spark, path).select("id").where("id > 50").count() == 6
    assert vectors.system_of(path) == projections.of_epsg(26912)
    layers.write_shapefile(df.limit(0), path)
    assert layers.read_shapefile(spark, path).count() == 0


def test_points_and_refusals(spark, tmp_path):
    points = spark.createDataFrame([(1, [[(2.0, 3.0)]]), (2, [[(4.0, 5.0)]])], f"id int, parts {layers.PARTS}")
    outputs.write_vector(points, str(tmp_path / "p.shp"))
    assert {(r.id, r.parts[0][0].x) for r in vectors.read_lines(spark, str(tmp_path / "p.shp")).collect()} == {(1, 2.0), (2, 4.0)}
    several = spark.createDataFrame([(1, [[(2.0, 3.0)], [(4.0, 5.0)]])], f"id int, parts {layers.PARTS}")
    layers.write_shapefile(several, str(tmp_path / "m.shp"))
    assert [[tuple(v) for v in p] for p in layers.read_shapefile(spark, str(tmp_path / "m.shp")).first().parts] == [[(2.0, 3.0)], [(4.0, 5.0)]]
    for wrong in (points.withColumnRenamed("id", "a_name_too_long"), points.selectExpr("array(id) AS id", "parts"), points.selectExpr("repeat('x', 300) AS t", "parts")):
        with pytest.raises(ValueError):
            layers.write_shapefile(wrong, str(tmp_path / "w.shp"))


def test_attempts_that_are_not_reported_leave_nothing(spark, tmp_path):
    import pyarrow as pa

    writer = layers.ShapefileWriter(str(tmp_path / "l"), [("id", "bigint")], layers.LINE, {"id": 20}, "")
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i]), pa.array([[[{"x": 1.0, "y": 2.0}, {"x": float(i), "y": 0.0}]]], layers.PARTS_ARROW)], ["id", "parts"])
    writer.write(iter([batch(9)]))
    writer.commit([writer.write(iter([batch(1)])), None, writer.write(iter([])), writer.write(iter([batch(2)]))])
    assert sorted(r.id for r in layers.read_shapefile(spark, str(tmp_path / "l.shp")).collect()) == [1, 2] and len(os.listdir(tmp_path)) == 4


def test_geopackage_in_ranges(spark, tmp_path):
    path = str(tmp_path / "l.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", [("other",), ("lines",)])
        db.execute("CREATE TABLE other (fid INTEGER PRIMARY KEY, geom BLOB)")
        db.execute("CREATE TABLE lines (fid INTEGER PRIMARY KEY, id MEDIUMINT, height REAL, name TEXT(20), geom BLOB)")
        head = b"GP\0" + bytes([1 | 1 << 1]) + struct.pack("<i4d", 4326, 0, 0, 0, 0)
        db.executemany("INSERT INTO lines VALUES (?, ?, ?, ?, ?)", [(3 * i + 10, i, h, n, head + vectors.make_wkb(p)) for i, h, n, p in ROWS])
    db.close()
    raw = layers.read_geopackage(spark, path, "lines", 20)
    assert raw.rdd.getNumPartitions() == 9 and raw.dtypes == [("fid", "bigint"), ("id", "bigint"), ("height", "double"), ("name", "string"), ("geometry", "binary")]
    assert plain(vectors.read_lines(spark, path, "lines").collect()) == sorted(ROWS)
    assert vectors.read_lines(spark, path, "other").count() == 0
    with pytest.raises(Exception, match="no layer"):
        vectors.read_lines(spark, path, "none")


def test_systems_of_layers(tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32633"}}, "features": []}')
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert vectors.system_of(str(tmp_path / "a.geojson")) == projections.of_epsg(32633) and vectors.system_of(str(tmp_path / "b.geojson")) == projections.of_epsg(4326)
    (tmp_path / "c.shp").write_bytes(b"")
    assert vectors.system_of(str(tmp_path / "c.shp")) is None
