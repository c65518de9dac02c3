"""Token counts by compiled finite-state transducers.

Two machines stand one on the other. The outer one cuts a text into the words of a byte-level BPE tokenizer; its
transition maps form a small monoid, whose composition table is computed once, so the text is cut into blocks, each
block's map is composed from its characters, and a prefix scan over the maps gives the state before each block. The
inner one is a deterministic transducer over the bytes of a word. A transition carries the number of tokens that the
byte adds to the word read so far (it can be negative); it is compiled when it is first needed.

The inner machine rests on a property of BPE: a token sequence is the encoding of its text exactly when each adjacent
pair encodes to itself. So the last token of each prefix is the one suffix token whose pair with the last token before
it holds, and a state needs only the prefixes at which a later token can still begin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Character classes and states of the outer machine.
RESET, L, SINGLE, E, R, V, LL, N, SP, WS, AP0, AP1, AP2, O = range(14)
START, IN_L, IN_N, IN_O, AFTER_SP, AFTER_WS, K1, K2, K3, KE = range(10)
N_CLASSES, N_STATES = 14, 10
LETTERS = (L, SINGLE, E, R, V, LL)
BLOCK = 64
#: States of the inner machine, and counted words, before a worker starts anew; bounds of memory, not of results.
MAX_STATES, MAX_WORDS = 300_000, 500_000
#: A transition is one number: the next state above these bits, HALF plus the tokens added below.
SHIFT, HALF, MASK = 16, 1 << 15, (1 << 16) - 1
#: Characters that are scanned at once.
SCAN_CHARS = 2_000_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point: letters, numbers and white space as in the tokenizer's pattern."""
    import regex

    table = np.full(0x110000, O, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", WS)):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for chars, kind in (("stmd", SINGLE), ("e", E), ("r", R), ("v", V), ("l", LL), (" ", SP), ("'", AP0)):
        table[[ord(c) for c in chars]] = kind
    return table


def outer_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next[state, class]; cut[state, class]: a word starts at the character; back[state, class]: one starts before it."""
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    cut = np.ones((N_STATES, N_CLASSES), bool)
    back = np.zeros((N_STATES, N_CLASSES), bool)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            if c == RESET:
                nxt[s, c] = START
            elif c in LETTERS:
                nxt[s, c] = {K1: KE, K2: K3, K3: KE}.get(s, IN_L)
                cut[s, c] = s not in (IN_L, K1, K2, K3, AFTER_SP)
            elif c == N:
                nxt[s, c], cut[s, c] = IN_N, s not in (IN_N, AFTER_SP)
            elif c in (SP, WS):
                nxt[s, c], cut[s, c] = (AFTER_SP if c == SP else AFTER_WS), s not in (AFTER_SP, AFTER_WS)
            else:
                contraction = c != O and c != AP0 and s not in (IN_O, AFTER_SP)
                nxt[s, c] = (K1 if c == AP1 else K2) if contraction else IN_O
                cut[s, c] = s not in (IN_O, AFTER_SP)
            back[s, c] = s in (AFTER_SP, AFTER_WS) and c not in (RESET, SP, WS)
    return nxt, cut, back


@lru_cache(1)
def map_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maps of states that character strings make: (compose[a, b] = a then b, map of each class, the maps)."""
    nxt, _, _ = outer_machine()
    known: dict[bytes, int] = {bytes(range(N_STATES)): 0}
    maps = [np.arange(N_STATES, dtype=np.uint8)]
    generators = [nxt[:, c] for c in range(N_CLASSES)]
    at = 0
    while at < len(maps):
        for g in generators:
            made = g[maps[at]]
            if made.tobytes() not in known:
                known[made.tobytes()] = len(maps)
                maps.append(made)
        at += 1
    stack = np.stack(maps)
    compose = np.empty((len(maps), len(maps)), np.uint16)
    for a in range(len(maps)):
        compose[a] = [known[m.tobytes()] for m in stack[:, stack[a]]]
    return compose, np.array([known[g.tobytes()] for g in generators], np.uint16), stack


def scan_maps(ids: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of map ids: blocks side by side, then their totals, then back into the blocks."""
    compose, _, _ = map_monoid()
    size, flat = len(compose), compose.ravel()
    if len(ids) <= BLOCK:
        out = ids.copy()
        for i in range(1, len(out)):
            out[i] = compose[out[i - 1], out[i]]
        return out
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint16)  # 0: the identity
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(n, BLOCK).T)
    for j in range(1, BLOCK):
        columns[j] = flat[columns[j - 1].astype(np.intp) * size + columns[j]]
    before = np.zeros(n, np.intp)
    before[1:] = scan_maps(columns[-1])[:-1]
    return flat[before * size + columns].T.reshape(-1)[: len(ids)]


def states_before(classes: np.ndarray) -> np.ndarray:
    """State of the outer machine before each character, from START."""
    _, of_class, maps = map_monoid()
    nxt, _, _ = outer_machine()
    n = -(-len(classes) // BLOCK)
    padded = np.full(n * BLOCK, RESET, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, BLOCK).T)
    compose = map_monoid()[0]
    size, flat = len(compose), compose.ravel()
    total = of_class[columns[0]].astype(np.intp)
    for j in range(1, BLOCK):
        total = flat[total * size + of_class[columns[j]]].astype(np.intp)
    state = np.full(n, START, np.uint8)
    state[1:] = maps[scan_maps(total.astype(np.uint16))[:-1], START]
    table = nxt.ravel()
    out = np.empty((BLOCK, n), np.uint8)
    for j in range(BLOCK):
        out[j] = state
        state = table[state.astype(np.intp) * N_CLASSES + columns[j]]
    return out.T.reshape(-1)[: len(classes)]


def word_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, each after a separator; starts and ends of their words there; each text's first word."""
    joined = "\0" + "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = character_classes()[points]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    resets = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    classes[resets] = RESET
    quotes = np.flatnonzero(classes == AP0)
    if len(quotes):
        one = classes[np.minimum(quotes + 1, len(classes) - 1)]
        two = classes[np.minimum(quotes + 2, len(classes) - 1)]
        inside = quotes + 2 < len(classes)
        pair = inside & (two == E) & ((one == R) | (one == V)) | inside & (one == LL) & (two == LL)
        classes[quotes] = np.where((one == SINGLE) & (quotes + 1 < len(classes)), AP1, np.where(pair, AP2, AP0))
    _, cut, back = outer_machine()
    state = states_before(classes)
    at = state.astype(np.intp) * N_CLASSES + classes
    starts = cut.ravel()[at]
    earlier = np.flatnonzero(back.ravel()[at]) - 1
    starts[earlier] = True
    starts[resets] = False
    begin = np.flatnonzero(starts)
    # A word ends where the next one or the next text's separator begins.
    stops = np.sort(np.concatenate((begin, resets, [len(classes)])))
    end = stops[np.searchsorted(stops, begin, side="right")]
    return joined, begin, end, np.searchsorted(begin, resets)


class BytePairs:
    """The inner machine for one tokenizer file."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        spec = json.load(open(path, encoding="utf-8"))
        kept = spec["model"]
        if kept["type"] != "BPE" or spec.get("normalizer") or kept.get("ignore_merges") or kept.get("dropout"):
            raise ValueError("only plain byte-level BPE without a normalizer can be compiled")
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only the byte-level word pattern without a prefix space can be compiled")
        self.special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        letters = self._byte_letters()
        raw = {letter: byte for byte, letter in letters.items()}
        tokens = {bytes(raw[c] for c in t): i for t, i in kept["vocab"].items() if all(c in raw for c in t)}
        self.tokens = tokens
        self.merges = {}
        for rank, m in enumerate(kept["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[bytes(raw[c] for c in a), bytes(raw[c] for c in b)] = rank
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.prefixes = {t[:i] for t in tokens for i in range(len(t) + 1)}
        self.max_states, self.pairs, self.moves = max_states, {}, {}
        self._restart()

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Printable stand-ins that byte-level files use: printable Latin-1 bytes as they are, others from U+0100 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        out = {b: chr(b) for b in plain}
        for i, b in enumerate(b for b in range(256) if b not in out):
            out[b] = chr(256 + i)
        return out

    def _restart(self) -> None:
        # A state: the longest suffix at which a token can still grow, and for each place in it at which one can begin
        # (the nearest first): the last token before that place, and how many tokens the word has beyond it.
        first = (b"", ((None, 0),))
        self.states, self.rows, self.step = {first: 0}, [first], {}
        if len(self.pairs) > 4 * self.max_states:
            self.pairs = {}
        if len(self.moves) > self.max_states:
            self.moves = {}

    def merged(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short string: the lowest-ranked pair merges first, the leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.merges.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def holds(self, left: bytes | None, token: bytes) -> bool:
        if left is None:
            return True
        found = self.pairs.get((left, token))
        if found is None:
            found = self.pairs[left, token] = self.merged(left + token) == [left, token]
        return found

    def move(self, suffix: bytes, byte: int) -> tuple[list[tuple[bytes, int]], bytes, list[int]]:
        """Of a suffix and a byte: the tokens that end there, each with the place in the state where it begins; the
        next suffix; the places that stay."""
        grown = suffix + bytes([byte])
        places = [j for j in range(len(suffix) + 1) if suffix[len(suffix) - j :] in self.prefixes]
        begins = [(grown[len(suffix) - j :], i) for i, j in enumerate(places)]
        stay = [i for part, i in begins if part in self.prefixes]
        longest = begins[stay[-1]][0] if stay else b""
        out = ([x for x in reversed(begins) if x[0] in self.tokens], longest, stay)
        self.moves[suffix, byte] = out
        return out

    def compile(self, state: int, byte: int) -> int:
        """The transition: next state and tokens added, in one number (see SHIFT)."""
        suffix, history = self.rows[state]
        tokens, longest, stay = self.moves.get((suffix, byte)) or self.move(suffix, byte)
        for token, i in tokens:
            left, beyond = history[i]
            if self.holds(left, token):
                break
        else:
            raise AssertionError("a single byte is always a token")
        added = 1 - beyond
        key = (longest, ((token, 0), *[(history[i][0], history[i][1] + added) for i in stay]))
        made = self.states.get(key)
        if made is None:
            made = self.states[key] = len(self.rows)
            self.rows.append(key)
        self.step[state << 8 | byte] = out = made << SHIFT | added + HALF
        return out

    def count(self, word: bytes) -> int:
        if len(self.rows) > self.max_states:
            self._restart()
        state, total, get = 0, 0, self.step.get
        for byte in word:
            found = get(state << 8 | byte) or self.compile(state, byte)
            state = found >> SHIFT
            total += found & MASK
        return total - HALF * len(word)


@lru_cache(1)
def counter_of(path: str) -> "TokenCounter":
    """One counter a worker process, kept from task to task."""
    return TokenCounter(path)


class TokenCounter:
    """Counts of whole texts; keeps counted words, up to a bound of memory."""

    def __init__(self, path: str):
        import regex

        self.machine, self.words = BytePairs(path), {}
        self.special = regex.compile("|".join(map(regex.escape, self.machine.special))) if self.machine.special else None

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's own string is one token and parts the text."""
        out: list[int] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= SCAN_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[int]:
        parts: list[str] = []
        owner: list[int] = []
        extra = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces = self.special.split(t) if self.special and self.special.search(t) else [t]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined, begin, end, first = word_starts(parts)
        found = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        counts = self.words
        new = set(found).difference(counts)
        if len(counts) + len(new) > MAX_WORDS:
            counts = self.words = {}
            new = set(found)
        for w in new:
            counts[w] = self.machine.count(w.encode("utf-8", "surrogatepass"))
        each = np.zeros(len(found) + 1, np.int64)
        each[1:] = np.cumsum(np.fromiter(map(counts.__getitem__, found), np.int64, len(found)))
        bounds = np.append(first, len(found))
        np.add.at(extra, np.array(owner, np.intp), each[bounds[1:]] - each[bounds[:-1]])
        if sum(map(len, new)) > 50_000_000:  # some immense words: do not keep them
            self.words = {}
        return extra.tolist()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Keys that are null, tied or repeated pass through row by row; other
    columns are not read. An empty table gives no rows. A key of the name of another column of the result gets a
    trailing underscore.
    """
    name = common.free_name(key, ("n_bytes", "n_tokens", "over_limit"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = counter.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [name, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(key).alias(name), F.col(text).alias("__text")).mapInArrow(run, f"`{name}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
