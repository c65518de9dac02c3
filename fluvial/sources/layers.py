"""Shapefiles and GeoPackages as Spark data sources that tasks read in ranges of records, and a committed shapefile writer.

A shapefile's records are found by its index (.shx), so a task reads its range of the index, the shapes and the attributes
only. A GeoPackage is read by ranges of row numbers; SQLite opens files in a file system only.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import open_input, open_output, store_of

PARTS = "array<array<struct<x:double,y:double>>>"
PARTS_ARROW = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Bytes of shapes of a task (option partitionBytes), records a batch, rows of a GeoPackage a task.
PARTITION_BYTES, RECORDS, PACKAGE_ROWS = 32_000_000, 2_000, 50_000
#: Shape types by their number, without the kinds with heights and measures, which are ten and twenty more (fixed by the format).
POINT, LINE, MULTIPOINT = 1, 3, 8


def _exists(path: str) -> bool:
    store, at = store_of(path)
    return store.get_file_info(at).type == fs.FileType.File


def _read(path: str, start: int, size: int) -> bytes:
    with open_input(path) as f:
        f.seek(start)
        return f.read(size)


@dataclass
class Range(InputPartition):
    start: int
    stop: int


# --- shapefiles -----------------------------------------------------------------------------------------------------
@dataclass
class Attributes:
    """Layout of a .dbf: records, bytes before them and of each, and the fields: name, kind, place and size in a record."""

    count: int
    head: int
    width: int
    fields: list[tuple[str, str, int, int]]
    encoding: str


def attributes(base: str) -> Attributes:
    count, head, width = struct.unpack("<IHH", _read(f"{base}.dbf", 4, 8))
    raw, fields, place = _read(f"{base}.dbf", 32, head - 32), [], 1
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 13:
            break
        kind, size, places = chr(raw[at + 11]), raw[at + 16], raw[at + 17]
        number = "double" if kind == "F" or places or size > 18 else "bigint"
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), number if kind in "NF" else "string", place, size))
        place += size
    encoding = _read(f"{base}.cpg", 0, 40).decode("ascii", "replace").strip().lower() if _exists(f"{base}.cpg") else "latin-1"
    return Attributes(count, head, width, fields, {"utf-8": "utf-8", "utf8": "utf-8", "65001": "utf-8"}.get(encoding, "latin-1"))


def _shape(raw: bytes) -> list[list[dict]]:
    """Parts of a record's shape, without heights and measures."""
    kind = struct.unpack_from("<I", raw)[0] % 10
    if kind == LINE:
        k, m = struct.unpack_from("<II", raw, 36)
        starts = [*struct.unpack_from(f"<{k}I", raw, 44), m]
        xy = np.frombuffer(raw, "<f8", 2 * m, 44 + 4 * k).reshape(-1, 2).tolist()
        return [[{"x": x, "y": y} for x, y in xy[a:b]] for a, b in zip(starts, starts[1:])]
    if kind == MULTIPOINT:
        (m,) = struct.unpack_from("<I", raw, 36)
        return [[{"x": x, "y": y}] for x, y in np.frombuffer(raw, "<f8", 2 * m, 40).reshape(-1, 2).tolist()]
    if kind == POINT:
        x, y = struct.unpack_from("<2d", raw, 4)
        return [[{"x": x, "y": y}]]
    return []


class Shapefile(DataSource):
    """spark.read.format("shapefile").load("lines.shp"): the attributes and parts. Written by write_shapefile."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _base(self) -> str:
        return self.options["path"].removesuffix(".shp")

    def schema(self) -> str:
        return ", ".join([*(f"`{n}` {k}" for n, k, _, _ in attributes(self._base()).fields), f"parts {PARTS}"])

    def reader(self, schema) -> "ShapefileReader":
        return ShapefileReader(self._base(), schema.names, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> "ShapefileWriter":
        return ShapefileWriter(self._base(), [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name != "parts"], int(self.options["shape"]), json.loads(self.options["widths"]), self.options.get("wkt", ""))


class ShapefileReader(DataSourceReader):
    def __init__(self, base: str, columns: list[str], most_bytes: int):
        self.base, self.columns, self.most_bytes, self.about = base, columns, most_bytes, attributes(base)

    def partitions(self) -> list[InputPartition]:
        n = self.about.count
        store, at = store_of(f"{self.base}.shp")
        some = max(1, int(self.most_bytes * n / max(1, store.get_file_info(at).size)))
        return [Range(a, min(a + some, n)) for a in range(0, n, some)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = {n: (k, place, size) for n, k, place, size in self.about.fields}
        for a in range(partition.start, partition.stop, RECORDS):
            count = min(RECORDS, partition.stop - a)
            index = np.frombuffer(_read(f"{self.base}.shx", 100 + 8 * a, 8 * count), ">i4").reshape(-1, 2).astype(np.int64) * 2
            first = int(index[:, 0].min())
            shapes = _read(f"{self.base}.shp", first, int(index.sum(axis=1).max()) + 8 - first)
            rows = _read(f"{self.base}.dbf", self.about.head + a * self.about.width, count * self.about.width)
            made = []
            for c in self.columns:
                if c == "parts":
                    made.append(pa.array([_shape(shapes[p - first + 8 : p - first + 8 + n]) for p, n in index.tolist()], PARTS_ARROW))
                else:
                    kind, place, size = kinds[c]
                    texts = [rows[i * self.about.width + place :][:size].decode(self.about.encoding, "replace").strip(" \0") for i in range(count)]
                    value = {"bigint": lambda t: int(float(t)) if "." in t else int(t), "double": float, "string": str}[kind]
                    made.append(pa.array([None if not t or t.startswith("*") else value(t) for t in texts], ARROW[kind]))
            yield pa.RecordBatch.from_arrays(made, self.columns)


@dataclass
class Part(WriterCommitMessage):
    """Files of shapes and of attributes that a task has written, sizes of its shapes, and their bounds."""

    path: str
    sizes: list[int]
    bounds: tuple[float, float, float, float]


def _packed(parts: list[list[dict]] | None, kind: int) -> tuple[bytes, np.ndarray]:
    points = np.array([(v["x"], v["y"]) for part in parts or [] for v in part], "<f8").reshape(-1, 2)
    if not len(points):
        return struct.pack("<I", 0), points
    if kind == POINT:
        return struct.pack("<I", POINT) + points[0].tobytes(), points
    head = struct.pack("<I", kind) + points.min(axis=0).tobytes() + points.max(axis=0).tobytes()
    if kind == MULTIPOINT:
        return head + struct.pack("<I", len(points)) + points.tobytes(), points
    starts = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4")
    return head + struct.pack("<II", len(parts), len(points)) + starts.tobytes() + points.tobytes(), points


class ShapefileWriter(DataSourceArrowWriter):
    """Tasks write shapes and attributes to files of their own; the commit numbers the records, builds the index and puts
    the parts that succeeded tasks report together, one after the other."""

    def __init__(self, base: str, fields: list[tuple[str, str]], shape: int, widths: dict[str, int], wkt: str):
        self.base, self.fields, self.shape, self.widths, self.wkt = base, fields, shape, widths, wkt
        self.folder = f"{base}.parts-{uuid.uuid4().hex}"
        store, at = store_of(self.folder)
        store.create_dir(at, recursive=True)

    def _text(self, name: str, kind: str, value) -> bytes:
        width = self.widths[name]
        if value is None:
            return b" " * width
        if kind == "double":
            return repr(float(value)).encode().rjust(width)[:width]
        return str(value).encode().rjust(width) if kind != "string" else str(value).encode().ljust(width)

    def write(self, iterator) -> Part:
        part, low, high = f"{self.folder}/{uuid.uuid4().hex}", [np.inf] * 2, [-np.inf] * 2
        sizes: list[int] = []
        with open_output(f"{part}.shp") as shapes, open_output(f"{part}.dbf") as table:
            for batch in iterator:
                columns = {n: batch.column(n).to_pylist() for n, _ in self.fields}
                for i, parts in enumerate(batch.column("parts").to_pylist()):
                    raw, points = _packed(parts, self.shape)
                    if len(points):
                        low, high = np.minimum(low, points.min(axis=0)), np.maximum(high, points.max(axis=0))
                    shapes.write(b"\0" * 4 + struct.pack(">I", len(raw) // 2) + raw)
                    table.write(b" " + b"".join(self._text(n, k, columns[n][i]) for n, k in self.fields))
                    sizes.append(len(raw))
        return Part(part, sizes, (*map(float, low), *map(float, high)))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.sizes]
        sizes = np.concatenate([np.array(m.sizes, np.int64) for m in parts]) if parts else np.zeros(0, np.int64)
        places = 100 + np.concatenate(([0], np.cumsum(sizes + 8)))
        if places[-1] > 2**32 - 2:
            raise ValueError(f"{self.base}: too large for a shapefile")
        bounds = [f(m.bounds[i] for m in parts) if parts else 0.0 for i, f in enumerate((min, min, max, max))]
        head = lambda size: struct.pack(">7I", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<II4d4d", 1000, self.shape, *bounds, *[0.0] * 4)
        with open_output(f"{self.base}.shx") as out:
            out.write(head(100 + 8 * len(sizes)) + (np.stack((places[:-1], sizes), axis=1) // 2).astype(">i4").tobytes())
        with open_output(f"{self.base}.shp") as out:
            out.write(head(int(places[-1])))
            number = 1
            for m in parts:
                raw = bytearray(_read(f"{m.path}.shp", 0, sum(m.sizes) + 8 * len(m.sizes)))
                at = np.concatenate(([0], np.cumsum(np.array(m.sizes) + 8)))[:-1]
                np.frombuffer(raw, np.uint8)[at[:, None] + np.arange(4)] = np.arange(number, number + len(at)).astype(">u4").view(np.uint8).reshape(-1, 4)
                out.write(bytes(raw))
                number += len(at)
        fields = b"".join(n.encode("ascii").ljust(11, b"\0") + {"bigint": b"N", "double": b"F"}.get(k, b"C") + b"\0" * 4 + bytes((self.widths[n], 15 if k == "double" else 0)) + b"\0" * 14 for n, k in self.fields)
        width = 1 + sum(self.widths[n] for n, _ in self.fields)
        with open_output(f"{self.base}.dbf") as out:
            out.write(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(sizes), 33 + len(fields), width) + fields + b"\r")
            for m in parts:
                with open_input(f"{m.path}.dbf") as f:
                    while piece := f.read(1 << 22):
                        out.write(piece)
            out.write(b"\x1a")
        for name, text in (("cpg", "UTF-8"), *([("prj", self.wkt)] if self.wkt else [])):
            with open_output(f"{self.base}.{name}") as out:
                out.write(text.encode())
        self.abort([])

    def abort(self, messages: list[Part | None]) -> None:
        store, at = store_of(self.folder)
        store.delete_dir(at)


def write_shapefile(lines: DataFrame, path: str, wkt: str = "") -> None:
    """Attributes (whole numbers, doubles, texts) and ``parts`` as one shapefile: lines, or points where every part of
    every row is one vertex. Names go to ten letters and texts to 254 bytes; longer ones are an error. Rows without
    parts have null shapes."""
    lines.sparkSession.dataSource.register(Shapefile)
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "string": "string"}
    names = [c for c in lines.columns if c != "parts"]
    wrong = [c for c in names if len(c) > 10 or not c.isascii() or lines.schema[c].dataType.simpleString() not in kinds]
    if wrong:
        raise ValueError(f"no field of a shapefile: {', '.join(wrong)}")
    rows = lines.select(*[F.col(c).cast(kinds[lines.schema[c].dataType.simpleString()]).alias(c) for c in names], "parts")
    texts = [c for c, k in rows.dtypes if k in ("string", "bigint")]
    sizes = F.max(F.array_max(F.transform("parts", lambda p: F.size(p)))).alias("vertices"), F.max(F.size("parts")).alias("points")
    most = rows.agg(*sizes, *[F.max(F.octet_length(F.col(c).cast("string"))).alias(f"__{c}") for c in texts]).first()
    widths = {c: max(1, most[f"__{c}"] or 1) if k in ("string", "bigint") else 24 for c, k in rows.dtypes if c != "parts"}
    long = [c for c in texts if widths[c] > (254 if rows.schema[c].dataType.simpleString() == "string" else 18)]
    if long:
        raise ValueError(f"texts of more than 254 bytes, or numbers of more than 18 digits: {', '.join(long)}")
    shape = LINE if (most["vertices"] or 2) > 1 else POINT if (most["points"] or 1) == 1 else MULTIPOINT
    rows.write.format("shapefile").mode("overwrite").option("shape", shape).option("widths", json.dumps(widths)).option("wkt", wkt).save(path)


# --- GeoPackages ------------------------------------------------------------------------------------------------------
class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("layer", ...).load("lines.gpkg"): the attributes and geometry (WKB)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _opened(self):
        return closing(sqlite3.connect(f"file:{self.options['path'].removeprefix('file://')}?mode=ro", uri=True))

    def layer(self) -> tuple[str, str, list[tuple[str, str]]]:
        """Table, geometry column, and the other columns with their kinds."""
        with self._opened() as db:
            wanted = self.options.get("layer")
            found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns" + (" WHERE table_name = ?" if wanted else " ORDER BY table_name"), (wanted,) if wanted else ()).fetchone()
            if found is None:
                raise ValueError(f"{self.options['path']}: no layer {wanted or ''}")
            columns = [(r[1], (r[2] or "").upper()) for r in db.execute(f'PRAGMA table_info("{found[0]}")') if r[1] != found[1]]
        kind = lambda t: "bigint" if "INT" in t or t == "BOOLEAN" else "double" if t.startswith(("REAL", "DOUBLE", "FLOAT")) else "string"
        return found[0], found[1], [(n, kind(t)) for n, t in columns]

    def schema(self) -> str:
        return ", ".join([*(f"`{n}` {k}" for n, k in self.layer()[2]), "geometry binary"])

    def reader(self, schema) -> "GeoPackageReader":
        return GeoPackageReader(self, schema.names)


class GeoPackageReader(DataSourceReader):
    def __init__(self, source: GeoPackage, columns: list[str]):
        self.source, self.columns, self.about = source, columns, source.layer()

    def partitions(self) -> list[InputPartition]:
        some = int(self.source.options.get("partitionRows", PACKAGE_ROWS))
        with self.source._opened() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.about[0]}"').fetchone()
        return [Range(a, min(a + some, high + 1)) for a in range(low, high + 1, some)] if low is not None else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        table, geometry, columns = self.about
        kinds = {**dict(columns), "geometry": "geometry"}
        chosen = ", ".join(f'"{geometry if c == "geometry" else c}"' for c in self.columns)
        with self.source._opened() as db:
            cursor = db.execute(f'SELECT {chosen} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.start, partition.stop))
            while rows := cursor.fetchmany(RECORDS):
                made = []
                for c, values in zip(self.columns, zip(*rows)):
                    if kinds[c] == "geometry":  # WKB behind a header, whose flags tell the size of its envelope
                        made.append(pa.array([None if v is None else bytes(v[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[v[3] >> 1 & 7] :]) for v in values], pa.binary()))
                    else:
                        cast = {"bigint": int, "double": float, "string": str}[kinds[c]]
                        made.append(pa.array([None if v is None else cast(v) for v in values], ARROW[kinds[c]]))
                yield pa.RecordBatch.from_arrays(made, self.columns)


def read_shapefile(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("partitionBytes", partition_bytes).load(path)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, partition_rows: int = PACKAGE_ROWS) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage").option("partitionRows", partition_rows)
    return (reader.option("layer", layer) if layer else reader).load(path)
