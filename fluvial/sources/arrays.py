"""Gridded series as long rows: the data sources "zarr" (versions 2 and 3) and "netcdf" (classic and NetCDF-4 files).

    spark.read.format("zarr").option("variables", "Qout").load(group).where("rivid IN (1, 2) AND time >= '2020-01-01'")

A row holds the coordinates of a place, one column a dimension, and the values of the variables there. Filters on
coordinates reach the source: the driver looks them up in the coordinates, which are one-dimensional, and plans only the
chunks that hold a wanted place; a task reads a few chunks, by bytes, and gives wanted rows only. A variable that the
schema leaves out is not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from . import classic, hdf5, zarr
from .files import open_input, store_of
from .filters import Pushed, allow_pushdown

#: Rows that a task gives at once, and bytes of values of a task's chunks (option partitionBytes).
ROWS, PARTITION_BYTES = 100_000, 64_000_000
TIME_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _since(units: str | None) -> tuple[int, int] | None:
    """Seconds of a unit and the microseconds since 1970 it counts from, for units like "days since 1980-01-01"."""
    m = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\S+)(?:[ T](\S+))?", units or "")
    if not m:
        return None
    start = datetime.fromisoformat(f"{m[2]}T{(m[3] or '00:00:00').rstrip('Z')}").replace(tzinfo=timezone.utc)
    return TIME_UNITS[m[1]], (start - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _opened(kind: str, path: str):
    if kind == "zarr":
        return zarr.Group(path)
    with open_input(path) as f:
        head = f.read(3)
    return classic.Group(path) if head == b"CDF" else hdf5.Group(path)


@lru_cache(maxsize=8)
def _group(kind: str, path: str):
    """A group that a worker has opened, kept for its next chunks."""
    return _opened(kind, path)


class Axis:
    """A dimension's coordinates: its variable's values, or the numbers from 0 where it has none."""

    def __init__(self, group, name: str):
        self.variable = group.variable(name) if name in group.names() else None
        self.since = _since(self.variable.attrs.get("units")) if self.variable else None
        whole = self.variable is None or self.variable.dtype.kind in "iu"
        self.kind, self.arrow = ("timestamp", pa.timestamp("us", "UTC")) if self.since else ("long", pa.int64()) if whole else ("double", pa.float64())

    def values(self, start: int, stop: int) -> np.ndarray:
        if self.variable is None:
            return np.arange(start, stop)
        size = self.variable.chunks[0]
        first = start // size
        parts = [self.variable.load(at, where) for at, where in self.variable.places([range(first, -(-stop // size))])]
        line = np.concatenate(parts)[start - first * size : stop - first * size] if parts else np.zeros(0, self.variable.dtype)
        if self.since:
            return (line.astype(np.float64) * self.since[0] * 1e6).round().astype(np.int64) + self.since[1]
        return line.astype(np.int64 if self.kind == "long" else np.float64)


def _decoded(values: np.ndarray, attrs: dict) -> np.ndarray:
    """Values as doubles: missing ones (_FillValue, missing_value) are NaN, packed ones are scaled."""
    out = values.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        fill = attrs.get(name)
        if fill is not None:
            out[np.isin(out, np.asarray(fill, np.float64))] = np.nan
    one = lambda name, default: np.ravel(np.asarray(attrs.get(name, default), np.float64))[0]
    return out * one("scale_factor", 1.0) + one("add_offset", 0.0)


@dataclass
class Chunks(InputPartition):
    """Chunks of one file: their places, and of each variable what leads to their bytes."""

    path: str
    chunks: list[tuple[tuple[int, ...], list]]


class Series(DataSource):
    """Options: path (a group, a file, or a folder of files), variables (comma-separated; all with the most dimensions
    if it is left out), partitionBytes."""

    KIND = ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def files(self) -> list[str]:
        return [self.options["path"]] if self.KIND == "zarr" else netcdf_files(self.options["path"])

    def schema(self) -> str:
        group = _opened(self.KIND, self.files()[0])
        if self.options.get("variables"):
            variables = [v.strip() for v in self.options["variables"].split(",")]
        else:
            of = {n: group.variable(n) for n in group.names()}
            data = {n: v for n, v in of.items() if [n] != list(v.dims)}
            most = max((len(v.dims) for v in data.values()), default=0)
            variables = [n for n, v in data.items() if len(v.dims) == most]
        if not variables:
            raise ValueError("no variables")
        dims = group.variable(variables[0]).dims
        if any(group.variable(v).dims != dims for v in variables):
            raise ValueError("variables lie over different dimensions")
        return ", ".join([*(f"`{n}` {Axis(group, n).kind}" for n in dims), *(f"`{v}` double" for v in variables)])

    def reader(self, schema) -> "SeriesReader":
        return SeriesReader(self.KIND, self.files(), schema.names, int(self.options.get("partitionBytes", PARTITION_BYTES)))


class ZarrSeries(Series):
    KIND = "zarr"


class NetCdfSeries(Series):
    KIND = "netcdf"


class SeriesReader(DataSourceReader):
    def __init__(self, kind: str, paths: list[str], columns: list[str], most_bytes: int):
        self.kind, self.paths, self.columns, self.most_bytes = kind, paths, columns, most_bytes
        group = _opened(kind, paths[0])
        known = set(group.names())
        self.variables = [c for c in columns if c in known and list(group.variable(c).dims) != [c]]
        if not self.variables:
            raise ValueError("the schema has no variable")
        self.dims = list(group.variable(self.variables[0]).dims)
        self.pushed = Pushed(set(self.dims) & set(columns))

    def pushFilters(self, filters: list[Filter]):
        return list(self.pushed.take(filters))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            group = _opened(self.kind, path)
            arrays = [group.variable(v) for v in self.variables]
            spans = []
            for name, size, chunk in zip(self.dims, arrays[0].shape, arrays[0].chunks):
                wanted = np.arange(size)
                if any(c == name for c, _, _ in self.pushed.tests):
                    wanted = np.flatnonzero(self.pushed.mask(name, Axis(group, name).values(0, size)))
                spans.append(np.unique(wanted // chunk).tolist())
            if not all(spans):
                continue
            if any(a.chunks != arrays[0].chunks for a in arrays):
                raise ValueError(f"{path}: variables are cut differently; read them one by one")
            each = max(1, math.prod(arrays[0].chunks) * sum(a.dtype.itemsize for a in arrays))
            held: list = []
            for places in zip(*(a.places(spans) for a in arrays)):
                held.append((places[0][0], [where for _, where in places]))
                if len(held) * each >= self.most_bytes:
                    out.append(Chunks(path, held))
                    held = []
            if held:
                out.append(Chunks(path, held))
        return out or [Chunks(self.paths[0], [])]  # of no partitions Spark makes one that nothing describes

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        group = _group(self.kind, partition.path)
        arrays = [group.variable(v) for v in self.variables]
        axes = [Axis(group, n) for n in self.dims]
        coordinates = lru_cache(maxsize=64)(lambda k, start, stop: axes[k].values(start, stop))
        for at, wheres in partition.chunks:
            blocks = [a.load(at, where) for a, where in zip(arrays, wheres)]
            lines, keep = [], []
            for k, (name, i, chunk, size) in enumerate(zip(self.dims, at, arrays[0].chunks, blocks[0].shape)):
                line = coordinates(k, i * chunk, i * chunk + size)
                keep.append(np.flatnonzero(self.pushed.mask(name, line)))
                lines.append(line[keep[-1]])
            values = [_decoded(b[np.ix_(*keep)] if keep else b, a.attrs).ravel() for a, b in zip(arrays, blocks)]
            shape = tuple(map(len, lines))
            for a in range(0, len(values[0]), ROWS):
                places = np.unravel_index(np.arange(a, min(a + ROWS, len(values[0]))), shape)
                made = {n: pa.array(line[p]).cast(axis.arrow) for n, line, p, axis in zip(self.dims, lines, places, axes)}
                made |= {v: pa.array(x[a : a + ROWS], from_pandas=True) for v, x in zip(self.variables, values)}
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


def netcdf_files(path: str) -> list[str]:
    """The files of a folder by name, or the file itself."""
    store, at = store_of(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith((".nc", ".nc3", ".nc4", ".cdf", ".h5")))


def _read(spark: SparkSession, source: type[Series], path: str, variables: list[str] | None, partition_bytes: int) -> DataFrame:
    allow_pushdown(spark)
    spark.dataSource.register(source)
    reader = spark.read.format(source.KIND).option("partitionBytes", partition_bytes)
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def read_zarr(spark: SparkSession, group: str, variable: str | None = None, key: str = "rivid", ids: list[int] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The dimensions' coordinates and the values of a variable (of all that have the most dimensions, without one), a
    row a value; missing values are null. ``ids`` is a filter on ``key``, which is pushed down like any other."""
    rows = _read(spark, ZarrSeries, group, [variable] if variable else None, partition_bytes)
    return rows if ids is None else rows.where(F.col(key).isin([int(i) for i in ids]))


def read_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Coordinates and named variables over the same dimensions, a row a place, of a file or of all files of a folder
    (one a year, say), classic or NetCDF-4; missing values are null."""
    return _read(spark, NetCdfSeries, path, variables, partition_bytes)
