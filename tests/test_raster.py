"""GeoTIFF source and writer: blocks chosen by filters, parts that are committed once, large files, odd grids."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.sources import raster

LIKE = raster.Header("<", 50, 40, "f4", 5, 2, (5, 40), [], [], (100.0, 10.0, 0.0, 900.0, 0.0, -10.0), False, 32633, None, False, {"geo": (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633), "numbers": (1.5, 2.5), "text": "a name|"})


def grid(spark, n_rows=50, n_cols=40, keep="true"):
    return spark.range(n_rows * n_cols).selectExpr(f"int(id div {n_cols}) AS row", f"int(id % {n_cols}) AS col", "double(id) AS v").where(keep)


def tiled(path, values, tile, flip=False):
    """A TIFF of deflated tiles by hand."""
    n_rows, n_cols = values.shape
    body, places, sizes = b"", [], []
    for r in range(0, n_rows, tile):
        for c in range(0, n_cols, tile):
            full = np.zeros((tile, tile), "<f8")
            part = values[r : r + tile, c : c + tile]
            full[: part.shape[0], : part.shape[1]] = part
            raw = zlib.compress(full.tobytes())
            places.append(len(body))
            sizes.append(len(raw))
            body += raw
    entries = [(256, 4, [n_cols]), (257, 4, [n_rows]), (258, 3, [64]), (259, 3, [8]), (277, 3, [1]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, places), (325, 4, sizes), (339, 3, [3]), (33550, 12, [1.0, -1.0 if flip else 1.0, 0.0]), (33922, 12, [0.0] * 6)]
    codes, after = {3: "H", 4: "I", 12: "d"}, 8 + 2 + 12 * 12 + 4
    start = after + sum(max(0, struct.calcsize(codes[k]) * len(v)) for _, k, v in entries if struct.calcsize(codes[k]) * len(v) > 4)
    out, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, kind, value in entries:
        value = [p + start for p in value] if tag == 324 else value
        raw = struct.pack(f"<{len(value)}{codes[kind]}", *value)
        out += struct.pack("<HHI", tag, kind, len(value)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(extra)))
        extra += raw if len(raw) > 4 else b""
    path.write_bytes(out + b"\0" * 4 + extra + body)


@pytest.mark.parametrize("flip", [False, True])
def test_filters_choose_tiles(spark, tmp_path, flip):
    values, path = np.arange(70 * 90, dtype=float).reshape(70, 90), tmp_path / "t.tif"
    tiled(path, values, 16, flip)
    cells, head = raster.read_grid(spark, str(path))
    shown = values[::-1] if flip else values
    assert {(r.row, r.col): r.v for r in cells.collect()} == {(i, j): shown[i, j] for i in range(70) for j in range(90)}
    raw = bytearray(path.read_bytes())
    for k, (place, size) in enumerate(zip(head.places, head.sizes)):
        top = 16 * (k // 6)
        rows = range(top, min(70, top + 16))
        rows = [69 - r for r in rows] if flip else rows
        if not (set(rows) & {30, 31, 32} and 16 * (k % 6) <= 40 < 16 * (k % 6 + 1)):
            raw[place : place + size] = b"\xff" * size  # what is not wanted must not be opened
    path.write_bytes(bytes(raw))
    some = cells.where("row BETWEEN 30 AND 32 AND col IN (40, 41) AND v > 0")
    assert {(r.row, r.col, r.v) for r in some.collect()} == {(i, j, shown[i, j]) for i in (30, 31, 32) for j in (40, 41)}
    assert "row" not in some._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("\n")[0]
    assert cells.where("row = 1000").count() == 0 and cells.where("row < 0 OR row IS NULL").limit(0).count() == 0


def test_blocks_are_dealt_by_bytes(tmp_path):
    tiled(tmp_path / "t.tif", np.zeros((70, 90)), 16)
    reader = raster.GeoTiffReader(str(tmp_path / "t.tif"), ["row", "col", "v"], 7 * 16 * 16 * 8)
    parts = reader.partitions()
    assert [len(p.blocks) for p in parts] == [7, 7, 7, 7, 2] and all(not p.head.places for p in parts)


@pytest.mark.parametrize("most_classic", [raster.MOST_CLASSIC, 1000])
@pytest.mark.parametrize("kind,fill", [("f4", float("nan")), ("i4", 0), ("u1", 255), ("f8", -9999.0)])
def test_written_grids(spark, tmp_path, most_classic, kind, fill):
    path = str(tmp_path / "g.tif")
    cells = grid(spark, keep="id % 3 <> 1 AND NOT (id BETWEEN 400 AND 1000)").withColumn("v", F.col("v") % 200 + 1)
    outside = spark.createDataFrame([(-1, 3, 5.0), (50, 0, 5.0), (3, 40, 5.0), (4, 4, None)], "row int, col int, v double")
    raster.write_grid(cells.union(outside), path, LIKE, kind, fill, strip_values=120, most_classic=most_classic)
    back, head = raster.read_grid(spark, path)
    assert open(path, "rb").read(4) == (b"II+\0" if most_classic == 1000 else b"II*\0")
    want = {(r.row, r.col): r.v for r in cells.collect()}
    got = {(r.row, r.col): r.v for r in back.collect()}
    assert {k: v for k, v in got.items() if v != 0 or kind != "i4"} == want
    assert (head.n_rows, head.n_cols, head.epsg, head.transform) == (50, 40, 32633, LIKE.transform) and head.tags["text"] == "a name|" and head.tags["numbers"] == (1.5, 2.5)
    assert os.listdir(tmp_path) == ["g.tif"]
    raster.write_grid(cells.limit(0), path, LIKE, "u1", 255, strip_values=120)
    assert raster.read_grid(spark, path)[0].count() == 0


def test_parts_of_failed_attempts_are_left_out(spark, tmp_path):
    path = str(tmp_path / "g.tif")
    layout = raster.Layout(10, 4, "f4", float("nan"), "none", 2, raster.MOST_CLASSIC, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [], [], "")
    writer = raster.GeoTiffWriter(path, layout)
    import pyarrow as pa

    batch = lambda strip, v: pa.RecordBatch.from_pydict({"s": [strip] * 2, "row": [2 * strip, 2 * strip + 1], "col": [1, 2], "v": [v, v]})
    writer.write(iter([batch(1, 99.0)]))  # an attempt that is not reported
    parts = [writer.write(iter([batch(3, 3.0), batch(4, 4.0)])), writer.write(iter([batch(1, 1.0)])), writer.write(iter([])), None]
    writer.commit(parts)
    back, head = raster.read_grid(spark, path)
    assert sorted(map(tuple, back.collect())) == [(2, 1, 1.0), (3, 2, 1.0), (6, 1, 3.0), (7, 2, 3.0), (8, 1, 4.0), (9, 2, 4.0)]
    assert os.listdir(tmp_path) == ["g.tif"]
    other = raster.GeoTiffWriter(str(tmp_path / "h.tif"), layout)
    other.abort([other.write(iter([batch(1, 1.0)]))])
    assert os.listdir(tmp_path) == ["g.tif"]


def test_lzw_round_trips():
    r = random.Random(2)
    for kinds in (1, 2, 5, 256):
        for n in (0, 1, 2, 300, 9000, 60_000):
            data = bytes(r.randrange(kinds) for _ in range(n))
            assert raster.unpack_lzw(raster.pack_lzw(data)) == data
    # By hand: clear, "A" "B" and the entry for "AB", end, of nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    assert raster.unpack_lzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"ABAB"
    assert raster.pack_lzw(b"ABAB") == int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    with pytest.raises(ValueError):
        raster.unpack_lzw(int("".join(f"{c:09b}" for c in (256, 300, 300, 257)).ljust(40, "0"), 2).to_bytes(5, "big"))
