"""Classic NetCDF files (versions 1, 2 and 5): header, and slabs of a variable's first dimension."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import product

import numpy as np

from .files import open_input

#: Values of a slab.
SLAB = 4_000_000

#: NetCDF classic: numpy kinds and sizes of its types (fixed by the format).
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class NetCdf:
    """Header of a classic NetCDF file: dimensions, variables with their attributes and places."""

    def __init__(self, path: str):
        self.path = path
        with open_input(path) as f:
            self.f = f
            magic = f.read(4)
            if magic[:3] != b"CDF":
                raise ValueError(f"{path}: not a NetCDF file")
            self.wide, self.far = magic[3] == 5, magic[3] in (2, 5)
            self.records = self._size()
            self.dims = self._list(lambda: (self._name(), self._size()))
            self._list(self._attribute)
            self.variables = {name: about for name, about in self._list(self._variable)}
        record = [v for v in self.variables.values() if v["record"]]
        self.stride = sum(v["size"] for v in record) if len(record) != 1 else math.prod(record[0]["shape"][1:]) * record[0]["dtype"].itemsize
        del self.f

    def _number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.f.read(struct.calcsize(kind)))[0]

    def _size(self) -> int:
        return self._number("Q" if self.wide else "I")

    def _name(self) -> str:
        n = self._size()
        return self.f.read(-(-n // 4) * 4)[:n].decode()

    def _list(self, one) -> list:
        tag, n = self._number("I"), self._size()
        return [one() for _ in range(n)] if tag else []

    def _attribute(self) -> tuple:
        name, kind, n = self._name(), self._number("I"), self._size()
        dtype = np.dtype(NC_TYPES[kind])
        raw = self.f.read(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
        return name, raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()

    def _variable(self) -> tuple[str, dict]:
        name = self._name()
        ids = [self._size() for _ in range(self._size())]
        attrs, kind, size = dict(self._list(self._attribute)), self._number("I"), self._size()
        begin = self._number("Q" if self.far else "I")
        sizes = [self.dims[i][1] for i in ids]
        record = bool(ids) and sizes[0] == 0
        shape = [self.records if record and k == 0 else s for k, s in enumerate(sizes)]
        return name, {"dims": [self.dims[i][0] for i in ids], "shape": shape, "attrs": attrs, "dtype": np.dtype(NC_TYPES[kind]), "size": size, "begin": begin, "record": record}

    def slab(self, name: str, start: int, stop: int) -> np.ndarray:
        """Rows ``start`` to ``stop`` of a variable's first dimension."""
        v = self.variables[name]
        rest, each = v["shape"][1:], math.prod(v["shape"][1:])
        with open_input(self.path) as f:
            if not v["record"]:
                f.seek(v["begin"] + start * each * v["dtype"].itemsize)
                return np.frombuffer(f.read((stop - start) * each * v["dtype"].itemsize), v["dtype"]).reshape(stop - start, *rest)
            out = []
            for i in range(start, stop):
                f.seek(v["begin"] + i * self.stride)
                out.append(np.frombuffer(f.read(each * v["dtype"].itemsize), v["dtype"]).reshape(rest))
            return np.stack(out) if out else np.zeros((0, *rest), v["dtype"])


class Variable:
    """An array: name, dims, shape, chunks (slabs of the first dimension), dtype, attrs."""

    def __init__(self, file: NetCdf, name: str):
        about = file.variables[name]
        self.file, self.name, self.dims, self.shape, self.dtype, self.attrs = file, name, about["dims"], tuple(about["shape"]), about["dtype"], about["attrs"]
        rows = max(1, SLAB // max(1, math.prod(self.shape[1:])))
        self.chunks = (max(1, min(rows, self.shape[0])), *(max(1, s) for s in self.shape[1:])) if self.shape else ()

    def places(self, spans: list) -> Iterator[tuple[tuple[int, ...], None]]:
        return ((at, None) for at in product(*spans))

    def load(self, at: tuple[int, ...], _=None) -> np.ndarray:
        first = at[0] * self.chunks[0] if at else 0
        return self.file.slab(self.name, first, min(first + self.chunks[0], self.shape[0])) if at else self.file.slab(self.name, 0, 1).reshape(())


class Group:
    """All variables of a file."""

    def __init__(self, path: str):
        self.file = NetCdf(path)

    def names(self) -> list[str]:
        return sorted(n for n, v in self.file.variables.items() if v["dtype"].kind != "S")

    def variable(self, name: str) -> Variable:
        if name not in self.file.variables:
            raise ValueError(f"no variable {name}")
        return Variable(self.file, name)
