"""GeoTIFF grids as a Spark data source: filters on rows and columns choose the strips or tiles that are read, and writing
is done by tasks and committed as one file.

Bands are baseline TIFF (classic or big) in strips or tiles, uncompressed, LZW or deflate, predictor 1 or 2. Missing
cells (the file's nodata value) give no row.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from ..functions import projections
from .files import open_input, open_output, store_of
from .filters import Pushed, allow_pushdown

#: TIFF field types (size in bytes, struct code) and the tags that are used: fixed by the format.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_A_STRIP, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SCALE, TIE, GEO_KEYS, GEO_NUMBERS, GEO_TEXT, NODATA = 33550, 33922, 34735, 34736, 34737, 42113
GEOGRAPHIC_MODEL, MODEL_KEY, PROJECTED_KEY, GEOGRAPHIC_KEY = 2, 1024, 3072, 2048


@dataclass
class Header:
    order: str
    n_rows: int
    n_cols: int
    kind: str
    compression: int
    predictor: int
    block: tuple[int, int]
    places: list[int]
    sizes: list[int]
    transform: tuple[float, ...]
    geographic: bool
    epsg: int | None
    nodata: float | None
    flipped: bool
    tags: dict = field(default_factory=dict)


def read_header(path: str) -> Header:
    with open_input(path) as f:
        data = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None:
            raise ValueError(f"{path}: not a TIFF file")
        big = struct.unpack(order + "H", data[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
        f.seek(at)
        count = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        raw = f.read(count * size)
        tags = {}
        for i in range(count):
            entry = raw[i * size : (i + 1) * size]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            n = struct.unpack(order + ("Q" if big else "I"), entry[4:12] if big else entry[4:8])[0]
            value = entry[12:] if big else entry[8:]
            if kind not in TYPES:
                continue
            width, code = TYPES[kind]
            if n * width > len(value):
                f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = f.read(n * width)
            tags[tag] = value[:n].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(order + code * n, value[: n * width])
    one = lambda t, d: tags.get(t, (d,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError(f"{path}: one band is expected")
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 1) // 8)
    rows, cols = one(HEIGHT, 0), one(WIDTH, 0)
    tiled = TILES in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_A_STRIP, rows), rows), cols)
    sx, sy = tags.get(SCALE, (1.0, 1.0, 0.0))[:2]
    tie = tags.get(TIE, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = tags.get(NODATA)
    flipped = sy < 0
    return Header(
        order, rows, cols, kind, one(COMPRESSION, 1), one(PREDICTOR, 1), block, list(tags[TILES if tiled else STRIPS]), list(tags[TILE_SIZES if tiled else STRIP_SIZES]),
        (tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy), geo.get(MODEL_KEY) == GEOGRAPHIC_MODEL, geo.get(PROJECTED_KEY) or geo.get(GEOGRAPHIC_KEY), float(nodata) if nodata and nodata.strip() else None, flipped, {"geo": keys, "numbers": tags.get(GEO_NUMBERS, ()), "text": tags.get(GEO_TEXT, "")},
    )


#: LZW in TIFF: codes from the highest bit on, of 9 to 12 bits, one entry early; the codes that clear the table and end
#: the data (fixed by the format). Between two clears at most so many codes can stand.
CLEAR, END, LONGEST = 256, 257, 4096 - 258
#: The bits of the i-th code after a clear.
WIDTHS = np.array([9 if i < 511 - 257 else 10 if i < 1023 - 257 else 11 if i < 2047 - 257 else 12 for i in range(LONGEST)])
STARTS = np.concatenate(([0], np.cumsum(WIDTHS)))


def _jumped(parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weights on the way from each place to its root, by ways that double."""
    while (parent[parent] != parent).any():
        weight = weight + weight[parent] * (parent != np.arange(len(parent)))
        parent = parent[parent]
    return weight + weight[parent] * (parent != np.arange(len(parent)))


def unpack_lzw(data: bytes) -> bytes:
    """All codes between two clears at once: a code repeats what stood where its entry was made, and one byte more, so
    lengths, places and bytes follow from pointers."""
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
    out, at, n = [], 0, 8 * len(data)
    while at + 9 <= n:
        starts = at + STARTS[:-1]
        starts = starts[starts + WIDTHS <= n]
        width = WIDTHS[: len(starts)].astype(np.uint32)
        codes = (words[starts >> 3] >> (32 - width - (starts & 7).astype(np.uint32)) & ((1 << width) - 1)).astype(np.int64)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        count = int(stops[0]) if len(stops) else len(codes)
        codes, stop = codes[:count], int(codes[count]) if count < len(codes) else END if not len(stops) and len(starts) < LONGEST else None
        if count:
            out.append(_expanded(codes))
        if stop == END:
            break
        at += int(STARTS[count]) + (int(WIDTHS[count]) if stop == CLEAR else 0)
    return b"".join(out)


def _expanded(codes: np.ndarray) -> bytes:
    places = np.arange(len(codes))
    entry = codes >= 258
    parent = np.where(entry, codes - 258, places)
    if (parent > places).any() or (parent[entry] >= places[entry]).any():
        raise ValueError("broken LZW data")
    length = 1 + _jumped(parent, entry.astype(np.int64))
    start = np.concatenate(([0], np.cumsum(length)))[:-1]
    total = int(length.sum())
    # A byte of a repeated text comes from the same place of the text where the entry began.
    back = np.repeat(np.where(entry, start - start[parent], 0), length)
    source = np.arange(total) - back
    while (source[source] != source).any():
        source = source[source]
    literal = np.zeros(total, np.uint8)
    literal[start[~entry]] = codes[~entry]
    return literal[source].tobytes()


def decode_block(raw: bytes, h: Header, path: str) -> np.ndarray:
    if h.compression == 5:
        raw = unpack_lzw(raw)
    elif h.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif h.compression != 1:
        raise ValueError(f"{path}: compression {h.compression} is not supported")
    values = np.frombuffer(raw, np.dtype(h.order + h.kind), len(raw) // np.dtype(h.kind).itemsize)
    values = values[: len(values) // h.block[1] * h.block[1]].reshape(-1, h.block[1])
    if h.predictor == 2:  # differences of the stored words, whatever they stand for
        words = np.dtype(f"u{values.dtype.itemsize}")
        values = np.cumsum(values.astype(values.dtype.newbyteorder("=")).view(words), axis=1, dtype=words).view(values.dtype.newbyteorder("="))
    elif h.predictor != 1:
        raise ValueError(f"{path}: predictor {h.predictor} is not supported")
    return values


#: Bytes of cells that a task reads (option partitionBytes), and cells that it gives at once.
PARTITION_BYTES, CELLS = 16_000_000, 100_000


@dataclass
class Blocks(InputPartition):
    """Strips or tiles of a file: number, offset and size of each; the header goes along, so no task reads it again."""

    head: Header
    blocks: list[tuple[int, int, int]]


class GeoTiff(DataSource):
    """spark.read.format("geotiff").load(path): row int, col int, v double.

    Filters on row and col reach the file: only strips or tiles that hold a wanted cell are read, a few a task, by bytes.
    Written (row, col, v) make one file; see write_grid.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, v double"

    def reader(self, schema) -> "GeoTiffReader":
        return GeoTiffReader(self.options["path"], schema.names, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> "GeoTiffWriter":
        return GeoTiffWriter(self.options["path"], Layout(**json.loads(self.options["layout"])))


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], most_bytes: int):
        self.path, self.columns, self.most_bytes, self.pushed = path, columns, most_bytes, Pushed({"row", "col"} & set(columns))

    def pushFilters(self, filters: list[Filter]):
        return list(self.pushed.take(filters))

    def _lines(self, h: Header, index: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows and columns of a block that lie in the grid, as they are numbered in the result."""
        across = -(-h.n_cols // h.block[1])
        r, c = index // across * h.block[0], index % across * h.block[1]
        rows = np.arange(r, min(r + h.block[0], h.n_rows))
        return h.n_rows - 1 - rows if h.flipped else rows, np.arange(c, min(c + h.block[1], h.n_cols))

    def partitions(self) -> list[InputPartition]:
        h = read_header(self.path)
        light = replace(h, places=[], sizes=[])
        each = max(1, h.block[0] * h.block[1] * np.dtype(h.kind).itemsize)
        wanted = [i for i in range(len(h.places)) if all(self.pushed.mask(n, line).any() for n, line in zip(("row", "col"), self._lines(h, i)))]
        some = max(1, self.most_bytes // each)
        dealt = [wanted[a : a + some] for a in range(0, len(wanted), some)] or [[]]
        return [Blocks(light, [(i, h.places[i], h.sizes[i]) for i in part]) for part in dealt]

    def read(self, partition: Blocks):
        h = partition.head
        if not partition.blocks:
            return
        with open_input(self.path) as f:
            for index, place, size in partition.blocks:
                rows, cols = self._lines(h, index)
                f.seek(place)
                values = decode_block(f.read(size), h, self.path)[: len(rows), : len(cols)]
                kept = [np.flatnonzero(self.pushed.mask(n, line)) for n, line in (("row", rows), ("col", cols))]
                flat = values[np.ix_(*kept)].ravel().astype(float)
                keep = np.flatnonzero(~np.isnan(flat) & (flat != h.nodata if h.nodata is not None else True))
                for a in range(0, len(keep), CELLS):
                    r, c = np.divmod(keep[a : a + CELLS], len(kept[1]))
                    made = {"row": pa.array(rows[kept[0][r]].astype(np.int32)), "col": pa.array(cols[kept[1][c]].astype(np.int32)), "v": pa.array(flat[keep[a : a + CELLS]])}
                    yield pa.RecordBatch.from_arrays([made[x] for x in self.columns], self.columns)


def read_grid(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, Header]:
    """row, col, v, and the header; filters on row and col read only the blocks they need."""
    allow_pushdown(spark)
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").option("partitionBytes", partition_bytes).load(path), read_header(path)


def with_crs(head: Header, path: str) -> Header:
    """The header, if it names a coordinate system; else an error."""
    if not head.geographic and head.epsg is None:
        raise ValueError(f"{path}: no coordinate system")
    return head


def system_of(head: Header) -> projections.System:
    """The coordinate system that a grid's keys describe, by code or by parameters; an unknown one is an error."""
    return projections.of_geokeys(tuple(head.tags.get("geo", ())), tuple(head.tags.get("numbers", ())))


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it, with a clear code before the table is full. The search for the longest known text walks the
    bytes; the codes' bits are put together at once."""
    codes, ends = [], []
    known: dict[int, int] = {}
    following, prefix = 258, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        known[key] = following
        following += 1
        if following == 4094:
            ends.append(len(codes))
            known, following = {}, 258
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
    parts = np.split(np.array(codes, np.int64), ends)
    # A clear stands before each part, as wide as the code that would have followed in the one before.
    numbers = [np.array([CLEAR])]
    widths = [WIDTHS[:1]]
    for i, part in enumerate(parts):
        last = CLEAR if i + 1 < len(parts) else END
        numbers.append(np.append(part, last))
        widths.append(WIDTHS[: len(part) + 1])
    numbers, widths = np.concatenate(numbers), np.concatenate(widths)
    # The j-th bit of a code, from its highest on.
    place = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = np.repeat(numbers, widths) >> (np.repeat(widths, widths) - 1 - place) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


#: TIFF numbers of the compressions that are written.
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}


def pack_block(block: np.ndarray, compression: str, predictor: int) -> bytes:
    if predictor == 2:
        words = block.view(np.dtype(f"u{block.dtype.itemsize}"))
        block = np.concatenate((words[:, :1], np.diff(words, axis=1)), axis=1)
    raw = np.ascontiguousarray(block).tobytes()
    return pack_lzw(raw) if compression == "lzw" else zlib.compress(raw) if compression == "deflate" else raw


@dataclass
class Layout:
    """What a written file is like: cells, kind, value of cells without a row, compression, rows of a strip, the size from
    which on it is a BigTIFF, and the georeference."""

    n_rows: int
    n_cols: int
    kind: str
    fill: float
    compression: str
    rows_a_strip: int
    most_classic: int
    transform: list[float]
    geo: list[int]
    geo_numbers: list[float]
    geo_text: str

    @property
    def strips(self) -> int:
        return -(-self.n_rows // self.rows_a_strip)

    @property
    def predictor(self) -> int:
        return 1 if self.compression == "none" else 2

    def blank(self, strip: int) -> np.ndarray:
        return np.full((min(self.rows_a_strip, self.n_rows - strip * self.rows_a_strip), self.n_cols), self.fill, np.dtype("<" + self.kind))

    def packed(self, block: np.ndarray) -> bytes:
        return pack_block(block, self.compression, self.predictor)

    def head(self, places: np.ndarray, sizes: np.ndarray, big: bool) -> bytes:
        """Header, entries and what they point to; strips' places are counted from the file's begin."""
        long = 16 if big else 4
        entries: list[tuple[int, int, list | bytes]] = [
            (WIDTH, 4, [self.n_cols]), (HEIGHT, 4, [self.n_rows]), (BITS, 3, [8 * np.dtype(self.kind).itemsize]), (COMPRESSION, 3, [COMPRESSIONS[self.compression]]), (262, 3, [1]), (STRIPS, long, places.tolist()), (SAMPLES, 3, [1]),
            (ROWS_A_STRIP, 4, [self.rows_a_strip]), (STRIP_SIZES, long, sizes.tolist()), (PREDICTOR, 3, [self.predictor]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[self.kind[0]]]),
            (SCALE, 12, [self.transform[1], -self.transform[5], 0.0]), (TIE, 12, [0.0, 0.0, 0.0, self.transform[0], self.transform[3], 0.0]), *([(GEO_KEYS, 3, self.geo)] if self.geo else []),
            *([(GEO_NUMBERS, 12, self.geo_numbers)] if self.geo_numbers else []), *([(GEO_TEXT, 2, self.geo_text.encode("latin-1") + b"\0")] if self.geo_text else []), (NODATA, 2, f"{self.fill}".encode() + b"\0"),
        ]
        inline, entry, count, first = (8, "<HHQ", "Q", 16) if big else (4, "<HHI", "I", 8)
        out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
        out += struct.pack("<Q" if big else "<H", len(entries))
        after = first + (8 if big else 2) + (20 if big else 12) * len(entries) + inline
        extra = b""
        for tag, kind, value in entries:
            raw = value if isinstance(value, bytes) else struct.pack("<" + TYPES[kind][1] * len(value), *value)
            out += struct.pack(entry, tag, kind, len(value))
            if len(raw) > inline:
                out += struct.pack("<" + count, after + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                out += raw.ljust(inline, b"\0")
        return out + b"\0" * inline + extra


@dataclass
class Part(WriterCommitMessage):
    """A file of packed strips that a task has written: its strips and their sizes, in order."""

    path: str
    strips: list[int]
    sizes: list[int]


class GeoTiffWriter(DataSourceArrowWriter):
    """Tasks write packed strips to files of their own beside the target; the commit lays out the strips that succeeded
    tasks report by a prefix sum of their sizes, and copies these files after the header, piece by piece. What other
    attempts have left goes with the folder."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout, self.folder = path, layout, f"{path}.parts-{uuid.uuid4().hex}"
        store, at = store_of(self.folder)
        store.create_dir(at, recursive=True)

    def write(self, iterator) -> Part:
        part = Part(f"{self.folder}/{uuid.uuid4().hex}", [], [])
        block, strip = None, None
        with open_output(part.path) as out:

            def finish() -> None:
                raw = self.layout.packed(block)
                out.write(raw)
                part.strips.append(strip)
                part.sizes.append(len(raw))

            for batch in iterator:
                strips, rows, cols, values = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("s", "row", "col", "v"))
                edges = np.concatenate(([0], np.flatnonzero(np.diff(strips)) + 1, [len(strips)]))
                for a, b in zip(edges[:-1], edges[1:]):
                    if a == b:
                        continue
                    if strips[a] != strip:
                        if block is not None:
                            finish()
                        strip = int(strips[a])
                        block = self.layout.blank(strip)
                    block[rows[a:b] - strip * self.layout.rows_a_strip, cols[a:b]] = values[a:b]
            if block is not None:
                finish()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.strips]
        layout = self.layout
        # Strips without a cell share one packed block, and the last one, which may be shorter, has its own.
        blanks = [layout.packed(layout.blank(s)) for s in (0, layout.strips - 1)] if layout.strips else [b"", b""]
        sizes, places, at = np.zeros(layout.strips, np.int64), np.zeros(layout.strips, np.int64), sum(map(len, blanks))
        sizes[:], sizes[-1:] = len(blanks[0]), len(blanks[1])
        places[-1:] = len(blanks[0])
        for part in parts:
            sizes[part.strips] = part.sizes
            places[part.strips] = at + np.cumsum(part.sizes) - part.sizes
            at += sum(part.sizes)
        big = at + 32 * layout.strips + 4096 > layout.most_classic
        start = len(layout.head(places, sizes, big))
        with open_output(self.path) as out:
            out.write(layout.head(places + start, sizes, big))
            out.write(b"".join(blanks))
            for part in parts:
                with open_input(part.path) as f:
                    while piece := f.read(1 << 22):
                        out.write(piece)
        self._clean()

    def abort(self, messages: list[Part | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, at = store_of(self.folder)
        store.delete_dir(at)


#: A classic TIFF's offsets have 32 bits.
MOST_CLASSIC = 4_000_000_000


def write_grid(grid: DataFrame, path: str, like: Header, kind: str = "f4", fill: float = float("nan"), compression: str = "lzw", strip_values: int = 250_000, most_classic: int = MOST_CLASSIC) -> None:
    """Write (row, col, v) as one TIFF with the georeference of another grid: LZW or deflate with differences of
    neighbours (predictor 2), or uncompressed; a BigTIFF where a classic one would not do.

    Strips of rows are filled, packed and written by tasks, one strip in memory at a time; the driver holds their places
    and sizes only. Cells without a row are ``fill``; of repeated cells one is written, and cells beyond the grid none.
    """
    spark = grid.sparkSession
    spark.dataSource.register(GeoTiff)
    step = max(1, strip_values // max(1, like.n_cols))
    layout = Layout(like.n_rows, like.n_cols, kind, fill, compression, step, most_classic, list(like.transform), list(like.tags.get("geo", ())), list(like.tags.get("numbers", ())), like.tags.get("text", ""))
    cells = grid.select(F.floor(F.col("row") / step).alias("s"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))
    inside = cells.where(F.col("row").between(0, like.n_rows - 1) & F.col("col").between(0, like.n_cols - 1) & F.col("v").isNotNull())
    # A strip is whole in one partition, and a partition's strips come one after the other.
    inside.repartitionByRange("s").sortWithinPartitions("s").write.format("geotiff").mode("overwrite").option("layout", json.dumps(asdict(layout))).save(path)
