"""Runs of repeated words by bit-parallel lags.

Words get numbers; bit k of all numbers is one big integer, a bit a word. For a lag q each plane is XORed with itself
shifted by q and the mismatches are ORed, so a zero says that a word equals the one q on. ANDs with shifts that double
keep the zeros that begin a stretch long enough for a run of period q. Stretches of a period that is a multiple of a
known run's are that run again and are masked out.

For lags from Q to 2Q every s-th word is looked at first (s: a sixteenth of Q, and one): a run of three periods has some
30 of those in a row. Such an octave of lags costs about 16 n bits, not Q n; what passes is looked at in full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: A run has so many words and so many periods at least (fixed by the contract).
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Lags from here on are sampled first, by about so many words a lag and by so many planes; planes before a first look.
SAMPLED, SAMPLES_A_LAG, SAMPLE_PLANES, FIRST_PLANES = 256, 16, 4, 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")


def _planes(numbers: np.ndarray, most: int | None = None) -> list[int]:
    width = max(1, int(numbers.max(initial=0)).bit_length())
    return [_packed(numbers >> k & 1) for k in range(min(width, most or width))]


def _long_stretches(ones: int, least: int) -> int:
    """Bits from which on at least ``least`` bits are set."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def _without(ones: int, spans: list[tuple[int, int]]) -> int:
    for a, b in spans:
        if b > a:
            ones &= ~(((1 << (b - a)) - 1) << a)
    return ones


def _spans(ones: int) -> np.ndarray:
    """(first, after the last) of each stretch of set bits."""
    raw = np.unpackbits(np.frombuffer(ones.to_bytes(-(-ones.bit_length() // 8), "little"), np.uint8), bitorder="little")
    return np.flatnonzero(np.diff(np.concatenate(([0], raw, [0])).astype(np.int8))).reshape(-1, 2)


class _Lags:
    """The planes of a text, and of every s-th word of it for the lags at hand."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.n, self.planes = numbers, len(numbers), _planes(numbers)
        self.stride = 0

    def equal(self, lag: int, least: int, known: list[tuple[int, int]]) -> int:
        """Words that equal the one ``lag`` on and begin ``least`` such words."""
        inside, found = (1 << (self.n - lag)) - 1, 0
        differ = 0
        for a, b in ((0, FIRST_PLANES), (FIRST_PLANES, len(self.planes))):
            for plane in self.planes[a:b]:
                differ |= plane ^ (plane >> lag)
            found = _long_stretches(_without(~differ & inside, known), least)
            if not found:
                break
        return found

    def may_hold(self, lag: int, least: int, known: list[tuple[int, int]]) -> bool:
        """False where the sampled words show that no stretch is long enough."""
        octave = 1 << (lag.bit_length() - 1)
        stride = octave // SAMPLES_A_LAG + 1  # odd, so that it shares no factor with lines of an even number of words
        if stride != self.stride:
            self.stride = stride
            self.sampled = [_planes(self.numbers[r::stride], SAMPLE_PLANES) for r in range(stride)]
        away, rest = divmod(lag, stride)
        differ = 0
        for here, there in zip(self.sampled[0], self.sampled[rest]):
            differ |= here ^ (there >> away)
        ones = ~differ & ((1 << -(-(self.n - lag) // stride)) - 1)
        ones = _without(ones, [(-(-a // stride), -(-b // stride)) for a, b in known])
        return _long_stretches(ones, least // stride) != 0


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs, by start and period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    table: dict = {}
    lags = _Lags(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n))
    runs, known = [], defaultdict(list)
    for q in range(1, n // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * q) - q
        # Words that equal the one q on because a known run's period divides q.
        masked = [(a, b - q) for a, b in known.pop(q, ())]
        if q >= SAMPLED and not lags.may_hold(q, least, masked):
            continue
        found = lags.equal(q, least, masked)
        if not found:
            continue
        for a, b in _spans(found).tolist():
            stop = b - 1 + least + q
            runs.append((a, stop - a, q))
            for multiple in range(2 * q, (stop - a) // LEAST_PERIODS + 1, q):
                known[multiple].append((a, stop))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def with_planted_repeats(key: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, chosen by the key's CRC, go on in a cycle of their own words from some word on."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Runs of repeated words of every whole text.

    Returns a row a row of ``docs``: the key (with underscores after its name where that is taken), n_words, runs (start,
    length and period in words, by start and period) and collapsed: the text's words joined by one space, without those
    that a run repeats. Words lie between runs of space and \\t..\\r and count as equal only if their bytes are. ``edit``
    may change a text's words first. Null and empty texts have no words and an empty collapsed text; repeated rows and
    null keys give a row each; an empty table gives no rows; other columns are not read. A text is looked at on its own,
    in memory that grows with its length.
    """
    name = common.free_name(key, ("n_words", "runs", "collapsed"))
    kind = docs.schema[key].dataType
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 200):
            lengths, found, kept = [], [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = edit(k, words) if edit else words
                runs = find_runs(words)
                lengths.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(b" ".join(without_repeats(words, runs)))
            columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array(lengths, pa.int64()), pa.array(found, run_type), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [name, "n_words", "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, f"`{name}` {kind.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def longest_by_exponent(runs: Column) -> Column:
    """The run of the greatest exact length / period, of equal ones the first, then of the smallest period; else null.

    Fractions are compared by products of integers."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # Runs come by start and period, so of equal ones the first stays.
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | better(x, best), x).otherwise(best))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a report of periodic_runs holds: key, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli; null where there is none) and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", longest_by_exponent(F.col("runs")))
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
