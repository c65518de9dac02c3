"""Gridded series: NetCDF-4 in its old and new form, Zarr with Blosc and shards, and filters that reach the source."""

import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvial.operators import flow_stats
from fluvial.sources import arrays, codecs, hdf5

from .hdf5_files import Writer


def yearly(path, new, year, ids, q, chunks=(4, 3), skip=()):
    w = Writer(new)
    w.dataset("rivid", np.asarray(ids, "<i4"), attrs={"CLASS": "DIMENSION_SCALE", "NAME": "rivid"})
    w.dataset("time", np.arange(len(q), dtype="<i8" if new else ">i4"), chunks=(4,), attrs={"CLASS": "DIMENSION_SCALE", "NAME": "time", "units": f"days since {year}-01-01 00:00:00"})
    w.dataset("station", np.zeros(5, ">f4"), attrs={"CLASS": "DIMENSION_SCALE", "NAME": "This is a netCDF dimension but not a netCDF variable         5"})
    w.dataset("Qout", np.asarray(q, "<f4"), chunks=chunks, deflate=True, fill=-7.0, attrs={"units": "m3 s-1", "_FillValue": np.float32(-7), "DIMENSION_LIST": ["time", "rivid"]}, skip=skip)
    for name in ("lat", "lon", "a_very_long_name_of_a_variable_that_fills_the_heap", *(f"v{i}" for i in range(12))):
        w.dataset(name, np.arange(len(ids), dtype="<f8"), attrs={"DIMENSION_LIST": ["rivid"]})
    w.save(path)


@pytest.mark.parametrize("new", [False, True])
def test_netcdf4_folder_as_rows(spark, tmp_path, new):
    ids = [11, 22, 33, 44, 55, 66, 77]
    q = np.arange(70, dtype=float).reshape(10, 7)
    q[3, 2] = -7.0
    yearly(tmp_path / "1999.nc", new, 1999, ids, q)
    yearly(tmp_path / "2000.nc", new, 2000, ids, q + 1000, skip={(1, 1)})
    rows = arrays.read_netcdf(spark, str(tmp_path), ["Qout"])
    assert rows.dtypes == [("time", "timestamp"), ("rivid", "bigint"), ("Qout", "double")]
    want = {(y, d + 1, ids[j]): float(q[d, j] + add) for y, add in ((1999, 0), (2000, 1000)) for d in range(10) for j in range(7)}
    want[1999, 4, 33] = None
    want |= {(2000, d + 1, ids[j]): None for d in range(4, 8) for j in range(3, 6)}
    assert {(r.time.year, r.time.day, r.rivid): r.Qout for r in rows.collect()} == want and rows.count() == 140
    # The statistics of a folder of years are those of a long table.
    long = spark.createDataFrame([(i, datetime(y, 1, d, 12), v) for (y, d, i), v in want.items()], "rivid long, time timestamp, Qout double")
    for how in ("mean", "median", "max"):
        assert sorted(map(tuple, flow_stats.yearly(rows, how).collect())) == sorted(map(tuple, flow_stats.yearly(long, how).collect()))
    # All variables of the most dimensions without names; a file without values of a dimension counts from 0.
    assert arrays.read_netcdf(spark, str(tmp_path / "1999.nc")).columns == ["time", "rivid", "Qout"]
    periods = arrays.read_netcdf(spark, str(tmp_path / "1999.nc"), ["lat", "v3", "a_very_long_name_of_a_variable_that_fills_the_heap"]).collect()
    assert [(r.rivid, r.lat, r.v3) for r in sorted(periods)] == [(i, float(k), float(k)) for k, i in enumerate(ids)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("new", [False, True])
def test_filters_reach_netcdf4_chunks(spark, tmp_path, new):
    ids = list(range(100, 130))
    q = np.arange(600, dtype=float).reshape(20, 30)
    path = tmp_path / "y.nc"
    yearly(path, new, 2001, ids, q, chunks=(5, 4))
    group = hdf5.Group(str(path))
    found = dict(group.variable("Qout").places([[1], [2, 7]]))
    assert sorted(found) == [(1, 2), (1, 7)] and all(found.values())
    raw = bytearray(path.read_bytes())
    for at, where in group.variable("Qout").places([range(4), range(8)]):
        if at not in {(1, 2), (1, 3)}:  # what is not wanted must not be opened
            raw[where[0] : where[0] + where[1]] = b"\xff" * where[1]
    path.write_bytes(bytes(raw))
    some = arrays.read_netcdf(spark, str(path), ["Qout"]).where("rivid IN (109, 112, 5) AND time > '2001-01-06' AND time <= '2001-01-09' AND Qout > 0")
    assert sorted((r.time.day, r.rivid, r.Qout) for r in some.collect()) == [(d, i, float(q[d - 1, i - 100])) for d in (7, 8, 9) for i in (109, 112)]
    # Only what the source cannot apply is left for Spark.
    assert "rivid IN" not in plan_of(some).split("Filter")[1].split("\n")[0] and "Qout" in plan_of(some).split("Filter")[1].split("\n")[0]
    assert arrays.read_netcdf(spark, str(path), ["Qout"]).where("rivid = 1").count() == 0


def test_partitions_hold_chunks_by_bytes(tmp_path):
    yearly(tmp_path / "y.nc", True, 2001, list(range(30)), np.zeros((20, 30)), chunks=(5, 4))
    reader = arrays.SeriesReader("netcdf", [str(tmp_path / "y.nc")], ["time", "rivid", "Qout"], 5 * 80)
    assert [len(p.chunks) for p in reader.partitions()] == [5] * 6 + [2]
    with pytest.raises(ValueError, match="no variable"):
        arrays.SeriesReader("netcdf", [str(tmp_path / "y.nc")], ["time", "rivid"], 1)


# --- Zarr -----------------------------------------------------------------------------------------------------------
def blosc(raw, width, kind, shuffle, block=2048, whole=False):
    """A frame: blocks of one stream, or of one a byte of the elements."""
    number, pack = {"lz4": (1, lambda x: pa.Codec("lz4_raw").compress(x, asbytes=True)), "snappy": (2, lambda x: pa.Codec("snappy").compress(x, asbytes=True)), "zlib": (3, zlib.compress), "zstd": (4, lambda x: pa.Codec("zstd").compress(x, asbytes=True))}[kind]
    parts = []
    for a in range(0, len(raw), block):
        piece = raw[a : a + block]
        if shuffle == 1:
            n = len(piece) // width
            piece = np.frombuffer(piece[: n * width], np.uint8).reshape(n, width).T.tobytes() + piece[n * width :]
        elif shuffle == 4:
            n = len(piece) // width // 8 * 8
            bits = np.unpackbits(np.frombuffer(piece[: n * width], np.uint8).reshape(n, width), axis=1, bitorder="little")
            piece = np.packbits(bits.T, axis=1, bitorder="little").tobytes() + piece[n * width :]
        split = not whole and width <= 16 and block // width >= 128 and len(piece) == block
        size = len(piece) // width if split else len(piece)
        streams = b""
        for b in range(0, len(piece), size):
            packed = pack(piece[b : b + size])
            packed = packed if len(packed) < size else piece[b : b + size]
            streams += struct.pack("<i", len(packed)) + packed
        parts.append(streams)
    at, starts = 16 + 4 * len(parts), []
    for p in parts:
        starts.append(at)
        at += len(p)
    return struct.pack("<4B3I", 2, 1, shuffle | (16 if whole else 0) | number << 5, width, len(raw), block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(parts)


@pytest.mark.parametrize("kind", ["lz4", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", [0, 1, 4])
def test_blosc_frames(kind, shuffle):
    rng = np.random.default_rng(3)
    for width, n in ((4, 3001), (8, 700), (2, 5), (1, 4000)):
        raw = rng.integers(0, 50, n).astype(f"<u{width}").tobytes()
        for whole in (False, True):
            assert codecs.unpack_blosc(blosc(raw, width, kind, shuffle, whole=whole)) == raw
    plain = struct.pack("<4B3I", 2, 1, 2, 4, 8, 8, 24) + b"12345678"
    assert codecs.unpack_blosc(plain) == b"12345678"
    with pytest.raises(ValueError, match="blosclz"):
        codecs.unpack_blosc(struct.pack("<4B3I", 2, 1, 0, 1, 8, 8, 28) + struct.pack("<ii", 20, 4) + b"abcd")


def put(folder, at, raw):
    path = folder / at
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


def pieces(values, chunks, fill):
    for at in np.ndindex(*(-(-s // c) for s, c in zip(values.shape, chunks))):
        full = np.full(chunks, fill, values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        yield at, full


def sharded(folder, values, shard, chunk, dims, fill="NaN", attrs=None, at_end=True, order="C"):
    """An array of version 3 in shards of gzipped chunks; a chunk of missing values only is not stored."""
    codec = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}, {"name": "crc32c"}]
    about = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": values.dtype.name, "fill_value": fill, "attributes": attrs or {}, "dimension_names": dims,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shard)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunk), "codecs": codec, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end" if at_end else "start"}}],
    }
    put(folder, "zarr.json", json.dumps(about).encode())
    for at, whole in pieces(values, shard, np.nan if fill == "NaN" else 0):
        body, index, base = b"", [], 0 if at_end else 16 * int(np.prod([s // c for s, c in zip(shard, chunk)])) + 4
        for _, part in pieces(whole, chunk, 0):
            if fill == "NaN" and np.isnan(part).all():
                index += [2**64 - 1] * 2
                continue
            raw = __import__("gzip").compress(part.tobytes()) + b"crc."
            index += [base + len(body), len(raw)]
            body += raw
        table = struct.pack(f"<{len(index)}Q", *index) + b"crc."
        put(folder, "c/" + "/".join(map(str, at)), body + table if at_end else table + body)


@pytest.mark.parametrize("at_end", [True, False])
def test_zarr_3_shards(spark, tmp_path, at_end):
    q = np.arange(12 * 30, dtype="<f4").reshape(12, 30)
    q[4:8, 5:10] = np.nan
    sharded(tmp_path / "Qout", q, (8, 20), (4, 5), ["time", "rivid"], at_end=at_end)
    sharded(tmp_path / "rivid", np.arange(500, 530, dtype="<i8"), (20,), (5,), ["rivid"], fill=0)
    sharded(tmp_path / "time", np.arange(12, dtype="<i4"), (12,), (4,), ["time"], fill=0, attrs={"units": "hours since 2020-02-28 20:00:00"})
    rows = arrays.read_zarr(spark, str(tmp_path), "Qout")
    got = {(r.time, r.rivid): r.Qout for r in rows.collect()}
    hour = lambda h: datetime.fromisoformat(f"2020-02-{28 if h < 4 else 29}T{(20 + h) % 24:02d}:00:00")
    local = [r.time for r in spark.sql("SELECT explode(sequence(timestamp'2020-02-28 20:00:00', timestamp'2020-02-29 07:00:00', interval 1 hour)) AS time").collect()]
    assert hour(0) and got == {(local[i], 500 + j): None if np.isnan(q[i, j]) else float(q[i, j]) for i in range(12) for j in range(30)}
    some = arrays.read_zarr(spark, str(tmp_path)).where("rivid BETWEEN 511 AND 513 AND time >= '2020-02-29 05:00:00'")
    assert sorted(r.Qout for r in some.collect()) == sorted(float(q[i, j]) for i in (9, 10, 11) for j in (11, 12, 13))
    reader = arrays.SeriesReader("zarr", [str(tmp_path)], ["time", "rivid", "Qout"], 1)
    reader.pushed.tests.append(("rivid", np.equal, 512))
    assert [p.chunks[0][0] for p in reader.partitions()] == [(0, 2), (1, 2), (2, 2)]


def test_default_store_with_blosc(spark, tmp_path):
    q = np.arange(40 * 25, dtype="<f8").reshape(40, 25)
    q[0, 0] = -1

    def array(name, values, chunks, dims, fill=None, attrs=None):
        about = {"shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}, "fill_value": fill, "order": "C", "filters": None, "zarr_format": 2}
        put(tmp_path / name, ".zarray", json.dumps(about).encode())
        put(tmp_path / name, ".zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims, **(attrs or {})}).encode())
        for at, full in pieces(values, chunks, 0):
            put(tmp_path / name, ".".join(map(str, at)), blosc(full.tobytes(), values.dtype.itemsize, "lz4", 1))

    array("rivid", np.arange(25, dtype="<i4"), (25,), ["rivid"])
    array("Qout", q, (20, 10), ["step", "rivid"], fill=-1.0, attrs={"scale_factor": 0.5, "add_offset": 1.0})
    rows = arrays.read_zarr(spark, str(tmp_path), "Qout", ids=[0, 24])
    assert {(r.step, r.rivid): r.Qout for r in rows.collect()} == {(i, j): None if (i, j) == (0, 0) else q[i, j] * 0.5 + 1 for i in range(40) for j in (0, 24)}
    # A schema picks columns; coordinates that it leaves out are not given.
    spark.dataSource.register(arrays.ZarrSeries)
    assert spark.read.format("zarr").schema("rivid long, Qout double").load(str(tmp_path)).where("rivid = 3").count() == 40


def plain_store(folder, arrays_):
    """Uncompressed arrays of version 2: name -> (values, chunks, dims, attributes)."""
    for name, (values, chunks, dims, attrs) in arrays_.items():
        about = {"shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": None, "fill_value": None, "order": "C", "filters": None, "zarr_format": 2}
        put(folder / name, ".zarray", json.dumps(about).encode())
        put(folder / name, ".zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}).encode())
        for at, full in pieces(values, chunks, 0):
            put(folder / name, ".".join(map(str, at)), full.tobytes())


def test_tables_of_discharges(spark, tmp_path, monkeypatch):
    from fluvial.plans import discharge
    from fluvial.sources import raster

    ids = np.arange(700, 760, dtype="<i8")
    rng = np.random.default_rng(5)
    q, rp, fdc = rng.uniform(1, 90, (30, 60)), rng.uniform(50, 400, (6, 60)), rng.uniform(1, 90, (3, 60))
    periods = np.array(flow_stats.RETURN_PERIODS, "<i4")
    plain_store(tmp_path / "series", {"rivid": (ids, (60,), ["rivid"], {}), "time": (np.arange(30, dtype="<i4"), (30,), ["time"], {"units": "days since 2000-12-20"}), "Qout": (q, (10, 7), ["time", "rivid"], {})})
    plain_store(tmp_path / "periods", {"rivid": (ids, (60,), ["rivid"], {}), "return_period": (periods, (6,), ["return_period"], {}), "return_period_flow": (rp, (6, 7), ["return_period", "rivid"], {})})
    plain_store(tmp_path / "curves", {"river_id": (ids, (60,), ["river_id"], {}), "p_exceed": (np.array([0.0, 50.0, 100.0]), (3,), ["p_exceed"], {}), "fdc": (fdc, (3, 7), ["p_exceed", "river_id"], {})})
    line = lambda x: [[(x, 1.0), (x + 1.0, 2.0)]]
    reaches = spark.createDataFrame([(int(i), line(float(k))) for k, i in enumerate(ids)] + [(5, line(2.0))], "id long, parts array<array<struct<x:double,y:double>>>")
    for most in (discharge.MOST_NAMED, 3):
        monkeypatch.setattr(discharge, "MOST_NAMED", most)
        some = reaches.where("id IN (5, 703, 704, 710, 750)")
        got = {r.rivid: r for r in discharge.from_stores(spark, str(tmp_path / "series"), str(tmp_path / "periods"), some, "id").collect()}
        assert set(got) == {703, 704, 710, 750}
        for i, r in got.items():
            column = q[:, i - 700]
            assert (r.qout_mean, r.qout_median, r.qout_max) == tuple(round(float(x), 3) for x in (column.mean(), np.median(column), column.max()))
            assert r.rp25 == round(float(rp[3, i - 700]), 3)
    # A grid from x 10 to 30: reaches from 710 to 729 lie in it wholly.
    head = raster.Header("<", 10, 20, "f4", 1, 1, (1, 20), [], [], (10.0, 1.0, 0.0, 8.0, 0.0, -1.0), False, None, None, False)
    tile = {r.COMID: r for r in discharge.of_tile(spark, str(tmp_path / "curves"), str(tmp_path / "periods"), reaches, "id", head).collect()}
    assert set(tile) == set(range(710, 730))
    assert all(r.qout_max == round(float(fdc[0, i - 700]), 3) and r.qout_median == round(float(fdc[1, i - 700]), 3) and abs(r.rp100_premium - float(rp[5, i - 700]) * 1.5) < 0.0013 for i, r in tile.items())


@pytest.mark.parametrize("new", [False, True])
def test_table_of_discharges_from_netcdf(spark, tmp_path, new):
    from fluvial.plans import discharge

    ids, rng = [3, 5, 8], np.random.default_rng(6)
    years = {y: rng.uniform(1, 9, (10, 3)).astype("<f4") for y in (1990, 1991, 1992)}
    (tmp_path / "years").mkdir()
    for y, q in years.items():
        yearly(tmp_path / "years" / f"{y}.nc", new, y, ids, q)
    w = Writer(new)
    w.dataset("rivid", np.asarray(ids, "<i4"), attrs={"CLASS": "DIMENSION_SCALE", "NAME": "rivid"})
    for k, name in enumerate(["qout_max", *(f"rp{p}" for p in flow_stats.RETURN_PERIODS)]):
        w.dataset(name, np.arange(3) + 100.0 * k, attrs={"DIMENSION_LIST": ["rivid"]})
    w.save(tmp_path / "rp.nc")
    rows = {r.COMID: r for r in discharge.from_netcdf(spark, str(tmp_path / "rp.nc"), str(tmp_path / "years")).collect()}
    for k, i in enumerate(ids):
        means = [np.round(q[:, k].astype(float).mean(), 3) for q in years.values()]
        medians = [np.round(np.median(q[:, k].astype(float)), 3) for q in years.values()]
        assert abs(rows[i].qout_mean - np.round(np.mean(means), 3)) < 1e-9 and abs(rows[i].qout_median - np.round(np.median(medians), 3)) < 1e-9
        assert (rows[i].qout_max, rows[i].rp2, rows[i].rp100) == (k, 100.0 + k, 600.0 + k)
