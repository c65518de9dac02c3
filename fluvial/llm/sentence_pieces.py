"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a whitespace marker after another character, or a line feed, so no merge crosses the start of
a marker run or a line feed. A text is cut there; each distinct chunk is segmented once a worker and the ids are joined back by
position. A model that breaks this rule is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Entries, and characters of their keys, that a worker's table holds in each of two halves; a bound of memory, not of
#: results. A full half becomes the older one, and what is asked for again moves on: what is frequent is never lost.
TABLE_ENTRIES, TABLE_CHARS = 250_000, 15_000_000


class ChunkTable:
    """Distinct chunk -> its ids (decimal, comma-joined) and its decoded text."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers; a chunk table cannot serve it")
        self.marker = self.library.encode("\n")[0]
        self.probe = self.library.encode("a")
        if self.library.encode("\n", out_type=str)[0] != MARK or self.library.decode(self.probe) != "a":
            raise ValueError("the table needs a model that puts one marker before a text")
        self.entries, self.ids, self.plain, self.chars = entries, {}, {}, 0
        self.older: tuple[dict, dict] = ({}, {})

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text that isn't empty; one with a single marker is named by what follows the marker."""
        if MARK not in text:
            found = text.replace("\n", " \n").split(" ")
            if "" not in found and found[0][0] != "\n":
                return found
        found = _CHUNK.findall(MARK + text.replace(" ", MARK))
        return [c[1:] if c[0] == MARK and len(c) > 1 and c[1] != MARK else c for c in found]

    def learn(self, chunks: list[str]) -> None:
        new = list(set(chunks).difference(self.ids))
        if not new:
            return
        if len(self.ids) + len(new) > self.entries or self.chars > TABLE_CHARS:
            self.older = self.ids, self.plain
            self.ids, self.plain, self.chars = {}, {}, 0
            new = list(set(chunks))
        ids, plain = self.older
        if known := [c for c in new if c in ids]:
            self.ids.update((c, ids[c]) for c in known)
            self.plain.update((c, plain[c]) for c in known)
            self.chars += sum(map(len, known))
            new = [c for c in new if c not in ids]
        if not new:
            return
        texts = [c[1:].replace(MARK, " ") if c[0] == MARK else c for c in new]
        ids = self.library.encode(texts, num_threads=1)
        # The library puts a marker first, but not before nothing; it cannot merge with a line feed.
        ids = [[self.marker] if c == MARK else found[1:] if c[0] == "\n" else found for c, found in zip(new, ids)]
        plain = self.library.decode([self.probe + found for found in ids], num_threads=1)
        for c, found, decoded in zip(new, ids, plain):
            self.ids[c] = str(found)[1:-1].replace(" ", "")
            self.plain[c] = decoded[1:]
        self.chars += sum(map(len, new))

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of the text, comma-joined, and what the library decodes them to."""
        if not text:
            return "", ""
        chunks = self.chunks(text)
        self.learn(chunks)
        return ",".join(map(self.ids.__getitem__, chunks)), "".join(map(self.plain.__getitem__, chunks))[1:]


@lru_cache(1)
def table_of(model: str) -> ChunkTable:
    """One table a worker process, kept from task to task."""
    return ChunkTable(model)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns key, n_tokens, ids_sha256 and decoded_sha256; with ``full`` also ids (array<int>) and decoded. A null text
    counts as empty: no ids, and digests of the empty string. Nulls, ties and repeated rows in the key pass through,
    row by row; other columns of ``docs`` are not read. An empty table gives no rows. A key of the name of another column
    of the result gets a trailing underscore.
    """
    name = common.free_name(key, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{name}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1).to_pylist():
                ids, plain = table.encode(value or "")
                out[0].append(ids.count(",") + 1 if ids else 0)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(_sha(plain))
                if full:
                    out[3].append([int(i) for i in ids.split(",")] if ids else [])
                    out[4].append(plain)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            if full:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [name, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(key).alias(name), F.col(text).alias("__text")).mapInArrow(run, schema)
