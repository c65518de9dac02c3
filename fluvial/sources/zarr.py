"""Arrays of a Zarr group, versions 2 and 3: their description, and chunks by their place.

In an array of version 3 with shards, the chunks are those inside the shards: a chunk's bytes are read by the shard's
index, so that a reader of one chunk reads neither the others nor whole shards.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
from pyarrow import fs

from . import codecs
from .files import store_of

NOT_THERE = 2**64 - 1


def _read(path: str, start: int | None = None, size: int | None = None) -> bytes | None:
    """A file, or a piece of it (from the end, if the start is negative); None where there is no such file."""
    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    if start is None:
        with store.open_input_stream(at, compression=None) as f:
            return f.read()
    with store.open_input_file(at) as f:
        f.seek(start if start >= 0 else f.size() + start)
        return f.read(size)


@lru_cache(maxsize=256)
def _shard_index(path: str, size: int, at_end: bool) -> bytes | None:
    return _read(path, -size if at_end else 0, size)


def _fill(value, dtype: np.dtype):
    if value is None:
        return np.nan if dtype.kind == "f" else 0
    return {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(value, value) if isinstance(value, str) else value


class Variable:
    """An array: name, dims, shape, chunks, dtype, attrs; ``places`` of chunks, and ``load`` of one."""

    def __init__(self, group: str, name: str):
        self.path, self.name = f"{group.rstrip('/')}/{name}", name
        self.shards = None
        if (about := _read(f"{self.path}/.zarray")) is not None:
            self._version_2(json.loads(about))
        elif (about := _read(f"{self.path}/zarr.json")) is not None:
            self._version_3(json.loads(about))
        else:
            raise ValueError(f"{self.path}: no Zarr array")

    def _version_2(self, about: dict) -> None:
        if about.get("filters"):
            raise ValueError(f"{self.path}: filters are not supported")
        self.attrs = json.loads(_read(f"{self.path}/.zattrs") or "{}")
        self.shape, self.chunks, self.dtype = tuple(about["shape"]), tuple(about["chunks"]), np.dtype(about["dtype"])
        self.dims = self.attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(self.shape))]
        self.fill, self.order = _fill(about.get("fill_value"), self.dtype), about.get("order", "C")
        # A fill value that is stated stands for missing values, as the attribute of that name does.
        if about.get("fill_value") is not None:
            self.attrs.setdefault("_FillValue", self.fill)
        self.compressors = [about["compressor"]["id"]] if about.get("compressor") else []
        self.prefix, self.separator = "", about.get("dimension_separator", ".")

    def _version_3(self, about: dict) -> None:
        self.attrs = about.get("attributes", {})
        self.shape, outer = tuple(about["shape"]), tuple(about["chunk_grid"]["configuration"]["chunk_shape"])
        self.dims = about.get("dimension_names") or self.attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(self.shape))]
        keys = about.get("chunk_key_encoding", {"name": "default"})
        self.prefix = "c" if keys["name"] == "default" else ""
        self.separator = keys.get("configuration", {}).get("separator", "/" if self.prefix else ".")
        chain = about["codecs"]
        self.chunks = outer
        if chain[0]["name"] == "sharding_indexed":
            shard = chain[0]["configuration"]
            self.chunks, self.shards, chain = tuple(shard["chunk_shape"]), outer, shard["codecs"]
            self.at_end = shard.get("index_location", "end") == "end"
            self.index_size = 16 * math.prod(o // c for o, c in zip(outer, self.chunks)) + 4 * any(c["name"] == "crc32c" for c in shard["index_codecs"])
        self.order, self.compressors, kind = "C", [], np.dtype(about["data_type"])
        for codec in chain:
            if codec["name"] == "bytes":
                kind = kind.newbyteorder(">" if codec.get("configuration", {}).get("endian") == "big" else "<")
            elif codec["name"] == "transpose":
                if list(codec["configuration"]["order"]) != list(range(len(outer)))[::-1]:
                    raise ValueError(f"{self.path}: this order of dimensions is not supported")
                self.order = "F"
            else:
                self.compressors.append(codec["name"])
        self.dtype, self.fill = kind, _fill(about.get("fill_value"), kind)

    def places(self, spans: list) -> Iterator[tuple[tuple[int, ...], None]]:
        """The chunks whose numbers along each dimension are in ``spans``, and what a task needs besides (nothing)."""
        return ((at, None) for at in product(*spans))

    def _bytes(self, at: tuple[int, ...]) -> bytes | None:
        key = lambda numbers: self.path + "/" + self.separator.join([*([self.prefix] if self.prefix else []), *map(str, numbers)] or ["0"])
        if self.shards is None:
            return _read(key(at))
        per = [o // c for o, c in zip(self.shards, self.chunks)]
        path = key([i // p for i, p in zip(at, per)])
        index = _shard_index(path, self.index_size, self.at_end)
        if index is None:
            return None
        start, size = struct.unpack_from("<2Q", index, 16 * int(np.ravel_multi_index([i % p for i, p in zip(at, per)], per)))
        return None if start == NOT_THERE else _read(path, start, size)

    def load(self, at: tuple[int, ...], _=None) -> np.ndarray:
        """A chunk without what lies beyond the array; one that is not there holds the fill value."""
        raw = self._bytes(at)
        if raw is None:
            full = np.full(self.chunks, self.fill, self.dtype)
        else:
            for codec in reversed(self.compressors):
                raw = raw[:-4] if codec == "crc32c" else codecs.decoded(codec, raw)
            full = np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)
        return full[tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at, self.chunks, self.shape))]


class Group:
    def __init__(self, path: str):
        self.path = path

    def names(self) -> list[str]:
        store, at = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(at))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and any(store.get_file_info(f"{x.path}/{y}").type == fs.FileType.File for y in (".zarray", "zarr.json")))

    def variable(self, name: str) -> Variable:
        return Variable(self.path, name)
