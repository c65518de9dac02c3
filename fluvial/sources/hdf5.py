"""NetCDF-4 files: the HDF5 structures that lead to a variable's chunks.

The driver reads descriptions only: superblock, object headers, links, and of a variable's index the nodes that lead to
wanted chunks. Tasks read and decode the chunks. Known are groups and attributes in compact and in dense form, chunks in
indices of the first kind (what NetCDF libraries write), contiguous and compact data, and the filters deflate, shuffle,
Fletcher-32, Blosc and Zstandard.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np

from . import codecs
from .files import open_input

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Types of header messages, classes of data types, and filters that are used (fixed by the format).
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
INTEGER, FLOAT, STRING, REFERENCE, ENUMERATION, SEQUENCE = 0, 1, 3, 7, 8, 9
DEFLATE, SHUFFLE, FLETCHER, BLOSC, ZSTD = 1, 2, 3, 32001, 32015
SHARED = 2
#: What the attribute NAME of a dimension without values begins with (fixed by NetCDF).
ONLY_A_DIMENSION = "This is a netCDF dimension but not a netCDF variable"
#: Values of a slab of contiguous data.
SLAB = 4_000_000


class Bytes:
    """Little-endian fields of a piece of the file, one after the other."""

    def __init__(self, raw: bytes, offsets: int = 8, lengths: int = 8):
        self.raw, self.at, self.offsets, self.lengths = raw, 0, offsets, lengths

    def take(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        """An offset in the file; None where it is undefined (all bits set)."""
        value = self.number(self.offsets)
        return None if value == (1 << 8 * self.offsets) - 1 else value

    def length(self) -> int:
        return self.number(self.lengths)

    def aligned(self, n: int) -> bytes:
        out = self.take(n)
        self.at += -n % 8
        return out


def _width(most: int) -> int:
    """Bytes that a number up to ``most`` takes."""
    return max(1, -(-most.bit_length() // 8))


class Kind:
    """A data type: class, size, numpy's type (None for strings and sequences), and the elements of a sequence."""

    def __init__(self, f: Bytes):
        head, bits = f.number(1), f.number(3)
        self.kind, self.size, self.base, self.text, self.dtype = head & 15, f.number(4), None, False, None
        order = ">" if bits & 1 else "<"
        if self.kind == INTEGER:
            self.dtype = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}")
            f.take(4)
        elif self.kind == FLOAT:
            self.dtype = np.dtype(f"{order}f{self.size}")
            f.take(12)
        elif self.kind == SEQUENCE:
            self.text, self.base = bits & 15 == 1, Kind(f)
        elif self.kind == ENUMERATION:
            self.dtype = Kind(f).dtype
        elif self.kind == REFERENCE:
            self.dtype = np.dtype(f"<u{self.size}")


def _shape(f: Bytes) -> tuple[int, ...] | None:
    """Sizes of a dataspace; () of a single value, None of no value."""
    version, rank, flags = f.number(1), f.number(1), f.number(1)
    none = version == 2 and f.number(1) == 2
    if version == 1:
        f.take(5)
    sizes = tuple(f.length() for _ in range(rank))
    return None if none else sizes


class File:
    """An HDF5 file that is open for reading descriptions."""

    def __init__(self, path: str):
        self.path, self.f = path, open_input(path)
        start = 0
        while self.raw(start, 8) != SIGNATURE:
            start = start * 2 or 512
            if start > self.f.size():
                raise ValueError(f"{path}: not an HDF5 file")
        self.offsets = self.lengths = 8
        head = self.bytes(start + 8, 64 + 56)
        version = head.number(1)
        if version < 2:
            head.take(4)
            self.offsets, self.lengths = head.number(1), head.number(1)
            head.offsets, head.lengths = self.offsets, self.lengths
            head.take(1 + 4 + 4 + (4 if version else 0))
            self.base = head.address()
            head.take(4 * self.offsets)  # free space, end, driver's block, and the name of the root
        else:
            self.offsets, self.lengths = head.number(1), head.number(1)
            head.offsets, head.lengths = self.offsets, self.lengths
            head.take(1)
            self.base = head.address()
            head.take(2 * self.offsets)
        self.root = head.address() if len(head.raw) > 8 else None
        if self.base is None or self.root is None:
            raise ValueError(f"{path}: no root group")

    def close(self) -> None:
        self.f.close()

    def raw(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def bytes(self, at: int, n: int) -> Bytes:
        return Bytes(self.raw(at, n), self.offsets, self.lengths)

    # --- object headers -----------------------------------------------------------------------------------------
    def messages(self, at: int) -> list[tuple[int, Bytes]]:
        """Type and content of an object header's messages, in order, with those of its continuations."""
        at += self.base
        head = self.bytes(at, 48)
        out: list[tuple[int, Bytes]] = []
        if head.raw[:4] == b"OHDR":
            flags = head.raw[5]
            start = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            blocks, ordered, newer = [(at + start + width, int.from_bytes(head.raw[start : start + width], "little"))], flags & 4, True
        else:
            head.take(8)
            blocks, ordered, newer = [(at + 16, head.number(4))], 0, False
        for begin, size in blocks:  # continuations are added on the way
            f = self.bytes(begin, size)
            while f.at + (4 if newer else 8) <= size:
                kind, n, flags = f.number(1 if newer else 2), f.number(2), f.number(1)
                f.take((2 if ordered else 0) if newer else 3)
                body = Bytes(f.take(n), self.offsets, self.lengths)
                if kind == CONTINUATION:
                    where, n = body.address(), body.length()
                    # Newer ones stand between a signature and a checksum.
                    blocks.append((self.base + where + 4, n - 8) if newer else (self.base + where, n))
                elif flags & SHARED and kind != 0:
                    body.take(2 if body.raw[0] > 1 else 8)
                    out += [m for m in self.messages(body.address()) if m[0] == kind]
                elif kind:
                    out.append((kind, body))
        return out

    def attributes(self, messages: list[tuple[int, Bytes]]) -> dict:
        found = [m for kind, m in messages if kind == ATTRIBUTE]
        for kind, m in messages:
            if kind == ATTRIBUTE_INFO:
                m = Bytes(m.raw, self.offsets, self.lengths)
                m.take(1)
                m.take(2 if m.number(1) & 1 else 0)
                heap, index = m.address(), m.address()
                if heap is not None:
                    found += [self.heap_object(heap, r[:8]) for r in self.records(index)]
        return dict(self._attribute(m) for m in found)

    def _attribute(self, m: Bytes) -> tuple[str, object]:
        m = Bytes(m.raw, self.offsets, self.lengths)
        version, flags = m.number(1), m.number(1)
        sizes = [m.number(2) for _ in range(3)]
        if version == 3:
            m.take(1)
        take = m.aligned if version == 1 else m.take
        name = take(sizes[0]).split(b"\0")[0].decode()
        kind, space = take(sizes[1]), take(sizes[2])
        if flags & 1:  # a named type
            shared = Bytes(kind, self.offsets, self.lengths)
            shared.take(2 if shared.raw[0] > 1 else 8)
            kind = next(b.raw for k, b in self.messages(shared.address()) if k == DATATYPE)
        shape = _shape(Bytes(space, self.offsets, self.lengths))
        count = 0 if shape is None else math.prod(shape)
        return name, self._values(Kind(Bytes(kind, self.offsets, self.lengths)), m.raw[m.at :], count)

    def _values(self, kind: Kind, raw: bytes, count: int):
        """A text, or a list of numbers, texts or sequences."""
        if kind.kind == STRING:
            out = [raw[i * kind.size : (i + 1) * kind.size].split(b"\0")[0].decode("utf-8", "replace") for i in range(count)]
        elif kind.kind == SEQUENCE:
            f, out = Bytes(raw, self.offsets, self.lengths), []
            for _ in range(count):
                n, heap, index = f.number(4), f.address(), f.number(4)
                held = self.global_object(heap, index) if heap else b""
                out.append(held[:n].split(b"\0")[0].decode("utf-8", "replace") if kind.text else self._values(kind.base, held, n))
        elif kind.dtype is not None:
            return np.frombuffer(raw, kind.dtype, count).tolist()
        else:
            return None
        return out[0] if (kind.kind == STRING or kind.text) and len(out) == 1 else out

    def global_object(self, heap: int, index: int) -> bytes:
        at = self.base + heap
        size = self.bytes(at + 8, self.lengths).length()
        f = self.bytes(at, size)
        f.take(8 + self.lengths)
        while f.at < size:
            number = f.number(2)
            f.take(6)
            n = f.length()
            if number == index:
                return f.take(n)
            if not number:
                break
            f.aligned(n)
        raise ValueError(f"{self.path}: an object of the global heap is missing")

    # --- links --------------------------------------------------------------------------------------------------
    def links(self, at: int) -> dict[str, int]:
        """Names in a group and the addresses of their headers."""
        out: dict[str, int] = {}
        for kind, m in self.messages(at):
            if kind == SYMBOLS:
                tree, heap = m.address(), m.address()
                f = self.bytes(self.base + heap, 8 + 2 * self.lengths + self.offsets)
                f.take(8)
                size = f.length()
                f.length()
                names = self.raw(self.base + f.address(), size)
                for name, where in self._symbols(tree):
                    out[names[name:].split(b"\0")[0].decode()] = where
            elif kind == LINK:
                out |= self._link(m)
            elif kind == LINK_INFO:
                m.take(1)
                m.take(8 if m.number(1) & 1 else 0)
                heap, index = m.address(), m.address()
                if heap is not None:
                    for record in self.records(index):
                        out |= self._link(self.heap_object(heap, record[4:]))
        return out

    def _symbols(self, at: int) -> Iterator[tuple[int, int]]:
        head = self.bytes(self.base + at, 8)
        if head.raw[:4] == b"SNOD":
            head.take(6)
            count, size = head.number(2), 2 * self.offsets + 24
            f = self.bytes(self.base + at + 8, count * size)
            for _ in range(count):
                yield f.number(self.offsets), f.address()
                f.take(24)
            return
        count, size = struct.unpack("<H", head.raw[6:8])[0], self.lengths + self.offsets
        f = self.bytes(self.base + at + 8 + 2 * self.offsets, count * size)
        for _ in range(count):
            f.length()
            yield from self._symbols(f.address())

    def _link(self, m: Bytes) -> dict[str, int]:
        m.take(1)
        flags = m.number(1)
        hard = not flags & 8 or m.number(1) == 0
        m.take((8 if flags & 4 else 0) + (1 if flags & 16 else 0))
        name = m.take(m.number(1 << (flags & 3))).decode()
        return {name: m.address()} if hard else {}

    # --- dense storage: indices of the second kind, and fractal heaps ---------------------------------------------
    def records(self, index: int) -> Iterator[bytes]:
        """All records of an index of the second kind, in order."""
        head = self.bytes(self.base + index, 16 + self.offsets + 2 + self.lengths)
        head.take(6)
        node, size, depth = head.number(4), head.number(2), head.number(2)
        head.take(2)
        root, count = head.address(), head.number(2)
        # Of each level (leaves first): how many records a node holds at most, and the bytes of the counts below it.
        most = [(node - 10) // size]
        below = [most[0]]
        for level in range(1, depth + 1):
            pointer = self.offsets + _width(most[0]) + (_width(below[level - 1]) if level > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            below.append((most[level] + 1) * below[level - 1] + most[level])

        def walk(at: int, count: int, level: int) -> Iterator[bytes]:
            f = self.bytes(self.base + at, node)
            f.take(6)
            held = [f.take(size) for _ in range(count)]
            if not level:
                yield from held
                return
            children = []
            for _ in range(count + 1):
                where, n = f.address(), f.number(_width(most[0]))
                f.take(_width(below[level - 1]) if level > 1 else 0)
                children.append((where, n))
            for i, (where, n) in enumerate(children):
                yield from walk(where, n, level - 1)
                if i < count:
                    yield held[i]

        if root is not None and count:
            yield from walk(root, count, depth)

    def heap_object(self, heap: int, identity: bytes) -> Bytes:
        """An object of a fractal heap by its id."""
        if identity[0] >> 4 & 3 == 2:  # held in the id itself
            return Bytes(identity[1 : 2 + (identity[0] & 15)], self.offsets, self.lengths)
        if identity[0] >> 4 & 3:
            raise ValueError(f"{self.path}: huge heap objects are not supported")
        f = self.bytes(self.base + heap, 22 + 12 * self.lengths + 3 * self.offsets)
        f.take(7)
        if f.number(2):
            raise ValueError(f"{self.path}: filtered heaps are not supported")
        f.take(1)
        largest = f.number(4)
        f.take(10 * self.lengths + 2 * self.offsets)
        width, first, most, bits = f.number(2), f.length(), f.length(), f.number(2)
        f.take(2)
        root, rows = f.address(), f.number(2)
        place = -(-bits // 8)
        at = int.from_bytes(identity[1 : 1 + place], "little")
        size = int.from_bytes(identity[1 + place : 1 + place + min(_width(most), _width(largest))], "little")
        return self.bytes(self.base + self._heap_place(root, rows, at, width, first, most, place), size)

    def _heap_place(self, block: int, rows: int, at: int, width: int, first: int, most: int, place: int) -> int:
        """The file's offset of a heap's offset: blocks of a row are of one size, which doubles from the third row on."""
        while rows:
            base = 0
            for row in range(rows):
                size = first << max(0, row - 1)
                if at < base + width * size:
                    break
                base += width * size
            column = (at - base) // size
            f = self.bytes(self.base + block + 5 + self.offsets + place + (row * width + column) * self.offsets, self.offsets)
            block, at = f.address(), at - base - column * size
            # Rows of blocks greater than the greatest direct one hold tables again.
            rows = 0 if size <= most else int(math.log2(size // (first * width))) + 1
        return block + at


class Variable:
    """An array: name, dims, shape, chunks, dtype, attrs; ``places`` of chunks, and ``load`` of one."""

    def __init__(self, file: File, name: str, at: int):
        self.path, self.name, self.at, self.base, self.offsets = file.path, name, at, file.base, file.offsets
        messages = file.messages(at)
        found = {kind: m for kind, m in reversed(messages)}
        self.attrs = file.attributes(messages)
        self.kind = Kind(found[DATATYPE])
        self.dtype, self.shape = self.kind.dtype, _shape(found[DATASPACE]) or ()
        self.fill, self.filters, self.tree, self.held = None, [], None, None
        if FILL in found:
            self.fill = self._fill(found[FILL])
        if FILTERS in found:
            self.filters = self._pipeline(found[FILTERS])
        self._layout(found[LAYOUT], file)
        scale = self.attrs.get("CLASS") == "DIMENSION_SCALE"
        self.only_dimension = scale and str(self.attrs.get("NAME", "")).startswith(ONLY_A_DIMENSION)
        self.dims = [name] if scale and len(self.shape) == 1 else [f"dim_{i}" for i in range(len(self.shape))]

    def _fill(self, m: Bytes):
        version = m.number(1)
        if version < 3:
            m.take(2)
            defined = m.number(1) or version == 1
        else:
            defined = m.number(1) & 32
        n = m.number(4) if defined else 0
        return np.frombuffer(m.take(n), self.dtype)[0] if n and self.dtype is not None and n == self.dtype.itemsize else None

    @staticmethod
    def _pipeline(m: Bytes) -> list[tuple[int, list[int]]]:
        version, count = m.number(1), m.number(1)
        m.take(6 if version == 1 else 0)
        out = []
        for _ in range(count):
            number = m.number(2)
            named = m.number(2) if version == 1 or number >= 256 else 0
            m.take(2)
            values = m.number(2)
            (m.aligned if version == 1 else m.take)(named)
            out.append((number, [m.number(4) for _ in range(values)]))
            m.take(4 if version == 1 and values % 2 else 0)
        return out

    def _layout(self, m: Bytes, file: File) -> None:
        version, kind = m.number(1), m.number(1)
        each = self.dtype.itemsize if self.dtype is not None else self.kind.size
        if version not in (3, 4):
            raise ValueError(f"{self.path}: a layout of version {version} is not supported")
        if kind == 2 and version == 3:
            rank = m.number(1)
            self.tree = m.address()
            self.chunks = tuple(m.number(4) for _ in range(rank))[:-1]
            self.indexed = True
            return
        self.indexed = False
        if kind == 0:
            self.held = m.take(m.number(2))
        elif kind == 1:
            self.start = m.address()
        else:  # one chunk is all there is
            flags, rank, width = m.number(1), m.number(1), m.number(1)
            self.chunks = tuple(m.number(width) for _ in range(rank))[:-1]
            if m.number(1) != 1:
                raise ValueError(f"{self.path}: {self.name}: this index of chunks is not supported")
            size, mask = (m.length(), m.number(4)) if flags & 2 else (math.prod(self.chunks) * each, 0)
            self.single = (m.address(), size, mask)
            return
        rest = math.prod(self.shape[1:])
        rows = self.shape[0] if self.held is not None and self.shape else max(1, SLAB // max(1, rest))
        self.chunks = (max(1, min(rows, self.shape[0])), *(max(1, s) for s in self.shape[1:])) if self.shape else ()

    def places(self, spans: list) -> Iterator[tuple[tuple[int, ...], object]]:
        """The chunks whose numbers along each dimension are in ``spans``, and where their bytes are: offset, size and
        skipped filters. Only nodes of the index that can lead to them are read."""
        if not self.indexed:
            each = self.dtype.itemsize * math.prod(self.shape[1:])
            for at in product(*spans):
                if self.held is not None:
                    yield at, self.held
                elif hasattr(self, "single"):
                    yield at, self.single
                elif self.start is None:
                    yield at, None
                else:
                    first = at[0] * self.chunks[0] if at else 0
                    rows = min(self.chunks[0], self.shape[0] - first) if at else 1
                    yield at, (self.start + first * each, rows * each, 0)
            return
        wanted = [np.unique(np.asarray(list(s), np.int64)) for s in spans]
        found: dict = {}
        if self.tree is not None:
            file = File(self.path)
            try:
                self._walk(file, self.tree, wanted, found)
            finally:
                file.close()
        for at in product(*spans):
            yield at, found.get(tuple(int(i) for i in at))

    def _walk(self, file: File, node: int, wanted: list[np.ndarray], found: dict) -> None:
        rank = len(self.shape)
        key = 8 + 8 * (rank + 1)
        head = file.raw(file.base + node, 8)
        level, count = head[5], struct.unpack("<H", head[6:])[0]
        f = file.bytes(file.base + node + 8 + 2 * file.offsets, count * (key + file.offsets) + key)
        keys, children = [], []
        for i in range(count + 1):
            size, mask = f.number(4), f.number(4)
            keys.append((tuple(f.number(8) // c for c in self.chunks), size, mask))
            f.take(8)
            if i < count:
                children.append(f.address())
        for (at, size, mask), (following, _, _), child in zip(keys, keys[1:], children):
            if not level:
                if all(i in w for i, w in zip(at, wanted)):
                    found[at] = (child, size, mask)
            # Chunks come in the order of their places: a child's first ones lie from its key's to the next key's.
            elif np.searchsorted(wanted[0], at[0]) < np.searchsorted(wanted[0], following[0], "right"):
                self._walk(file, child, wanted, found)

    def load(self, at: tuple[int, ...], where) -> np.ndarray:
        """A chunk without what lies beyond the array; one that was never written holds the fill value."""
        if where is None:
            full = np.full(self.chunks, 0 if self.fill is None else self.fill, self.dtype)
        else:
            raw, mask = where if isinstance(where, bytes) else None, 0
            if raw is None:
                start, size, mask = where
                with open_input(self.path) as f:
                    f.seek(self.base + start)
                    raw = f.read(size)
                for i in reversed(range(len(self.filters))):
                    if not mask >> i & 1:
                        raw = self._undone(*self.filters[i], raw)
            full = np.frombuffer(raw, self.dtype)
            full = full.reshape(self.chunks) if len(full) == math.prod(self.chunks) else full.reshape(-1, *self.shape[1:])
        return full[tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at, self.chunks, self.shape))]

    def _undone(self, number: int, values: list[int], raw: bytes) -> bytes:
        if number == DEFLATE:
            return zlib.decompress(raw)
        if number == SHUFFLE:
            return codecs.unshuffled(raw, values[0] if values else self.dtype.itemsize)
        if number == FLETCHER:
            return raw[:-4]
        if number in (BLOSC, ZSTD):
            return codecs.decoded({BLOSC: "blosc", ZSTD: "zstd"}[number], raw)
        raise ValueError(f"{self.path}: filter {number} is not supported")


class Group:
    """The root group of a file: its variables, with the dimensions that their lists of references name."""

    def __init__(self, path: str):
        file = File(path)
        try:
            links = file.links(file.root)
            self.variables = {}
            for name, at in links.items():
                if any(kind == DATATYPE for kind, _ in file.messages(at)) and any(kind == LAYOUT for kind, _ in file.messages(at)):
                    self.variables[name] = Variable(file, name, at)
        finally:
            file.close()
        by_address = {v.at: name for name, v in self.variables.items()}
        for v in self.variables.values():
            lists = v.attrs.pop("DIMENSION_LIST", None)
            v.attrs.pop("REFERENCE_LIST", None)
            if lists and len(lists) == len(v.shape):
                v.dims = [by_address.get(refs[0], f"dim_{i}") if refs else f"dim_{i}" for i, refs in enumerate(lists)]

    def names(self) -> list[str]:
        return sorted(n for n, v in self.variables.items() if not v.only_dimension and v.dtype is not None)

    def variable(self, name: str) -> Variable:
        if name not in self.names():
            raise ValueError(f"no variable {name}")
        return self.variables[name]
