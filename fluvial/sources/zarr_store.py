"""Long rows as a Zarr group (version 2): a chunk a group of rows, written by tasks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_output, store_of


def _put(path: str, raw: bytes) -> None:
    with open_output(path) as f:
        f.write(raw)


def _describe(path: str, shape: list[int], chunks: list[int], dtype: str, dims: list[str], units: str | None = None, codec: dict | None = None, fill=None) -> None:
    store, at = store_of(path)
    store.create_dir(at, recursive=True)
    _put(f"{path}/.zarray", json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": codec, "fill_value": fill, "order": "C", "filters": None}).encode())
    _put(f"{path}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims, **({"units": units} if units else {})}).encode())


def write_zarr(rows: DataFrame, group: str, variable: str, dims: dict[str, int]) -> None:
    """Write ``variable`` over dimensions (name -> places a chunk, in order) and the dimensions' coordinates.

    Coordinates are the distinct values of a column, in order: whole numbers, doubles, or times in whole seconds; there
    are as many as the array is long, and the driver numbers them. A chunk is filled by one task, which holds no other
    rows; a second attempt writes the same file. Places without a row, and chunks that are not written, are missing; of
    repeated places the greatest value is written. Rows with a null coordinate are left out.
    """
    spark, names = rows.sparkSession, list(dims)
    store, at = store_of(group)
    store.create_dir(at, recursive=True)
    _put(f"{group}/.zgroup", b'{"zarr_format": 2}')
    placed, shape = rows.select(*names, F.col(variable).cast("double").alias("__v")), []
    for name, chunk in dims.items():
        kind = rows.schema[name].dataType.simpleString()
        units = "seconds since 1970-01-01 00:00:00" if kind in ("timestamp", "date", "timestamp_ntz") else None
        value = F.unix_timestamp(F.col(name).cast("timestamp")) if units else F.col(name).cast("double" if kind in ("double", "float") else "long")
        placed = placed.withColumn(name, value)
        line = np.array([r[0] for r in placed.where(F.col(name).isNotNull()).select(name).distinct().sort(name).toLocalIterator()], "<f8" if kind in ("double", "float") else "<i8")
        shape.append(len(line))
        _describe(f"{group}/{name}", [len(line)], [max(1, len(line))], line.dtype.str, [name], units)
        if len(line):
            _put(f"{group}/{name}/0", line.tobytes())
        numbers = spark.createDataFrame(pa.table({name: pa.array(line), f"__{name}": pa.array(np.arange(len(line)))}))
        placed = placed.join(numbers, name)
    chunks = list(dims.values())
    _describe(f"{group}/{variable}", shape, chunks, "<f8", names, codec={"id": "zstd", "level": 3})

    def fill(table: pa.Table) -> pa.Table:
        import zstandard

        index = [table.column(f"__{n}").to_numpy() for n in names]
        at = [int(i[0]) // c for i, c in zip(index, chunks)]
        block = np.full(chunks, -np.inf)
        np.maximum.at(block, tuple(i % c for i, c in zip(index, chunks)), table.column("__v").to_numpy().astype(float))
        block[np.isneginf(block)] = np.nan
        _put(f"{group}/{variable}/" + ".".join(map(str, at)), zstandard.ZstdCompressor(3).compress(block.tobytes()))
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    keys = [F.floor(F.col(f"__{n}") / c).alias(f"__at_{n}") for n, c in dims.items()]
    kept = placed.where(F.col("__v").isNotNull()).select("__v", *[f"__{n}" for n in names])
    kept.groupBy(*keys).applyInArrow(fill, "n long").agg(F.sum("n")).collect()
