"""Personal data: base patterns, and boosted trees over candidates of high-recall generators.

Generators propose spans that may overlap; features of format and context go to gradient-boosted trees; a threshold
for each kind, calibrated on candidates that were not trained on, selects. Selected spans are added to the base ones,
which always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "national_id", "secret")
KINDS = (*BASE_KINDS, *MORE_KINDS)

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")  # possessive: a long run of digits is read once
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four base kinds, leftmost and non-overlapping within a kind, failing matches dropped.

    Equal to the patterns of the contract, in time linear in the text: e-mail matches are grown from their @, dotted
    numbers are cut into fours from the left.
    """
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # no match can hold this @, and none before it is open
        at = text.find("@", max(at + 1, last))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        while len(parts) >= 4:
            four, parts = parts[:4], parts[4:]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in four):
                found.append(("ip", start, start + size))
            start += size + 1
    for m in _DIGITS.finditer(text):
        size = m.end() - m.start()
        if 13 <= size <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# --- candidates -----------------------------------------------------------------------------------------------------
# Generators cast a wide net on purpose: what they propose is decided by the trees.
_DIGIT = re.compile(r"[0-9]")
_MARK_REST = re.compile(r"[A-Za-z0-9+/=_-]*")
_MARK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
_NUMBERISH = re.compile(r"\(?[0-9][0-9 ().\-/]{5,24}[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\(AT\)|\[AT\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,4}")
_GROUPS = re.compile(r"[0-9]{1,3}(?:[ ]?\.[ ]?[0-9]{1,3}){3}")
#: Words that tell a kind when they stand shortly before a candidate.
CUES = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "national_id": ("ssn", "social security", "national id", "passport", "tax id"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "bearer", "auth"),
}
CONTEXT = 32
#: How keys of well-known services begin (fixed values).
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk-", "pk_live_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "ya29", "eyJ", "npm_", "hf_", "SG")
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63}){1,4}")
_CUED = re.compile(r"(?i:token|secret|passw(?:or)?d|api[_ ]?key|access key|bearer|auth)[\"']?[ \t]*[:=]?[ \t]*[\"']?([A-Za-z0-9+/=_.!@#$%^&*-]{8,})")
_CUE = re.compile(r"(?i)token|secret|passw|api.?key|access key|bearer|auth")


def candidates(text: str) -> list[Span]:
    """Proposed spans beyond the base patterns; they may overlap each other and the base spans."""
    out: list[Span] = []
    if "at" in text or "AT" in text:
        if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
            out += [("email", m.start(), m.end()) for m in _AT.finditer(text)]
    if " dot " in text or " DOT " in text:
        out += [("email", m.start(), m.end()) for m in _SPOKEN.finditer(text)]
    if _CUE.search(text):  # what follows a cue, letters only included
        out += [("secret", m.start(1), m.start(1) + len(m[1].rstrip(".,!?"))) for m in _CUED.finditer(text)]
    first = _DIGIT.search(text)
    if first is None:
        return out
    for m in _NUMBERISH.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 15:
            out.append(("phone", m.start(), m.end()))
        if digits == 9:
            out.append(("national_id", m.start(), m.end()))
        if 13 <= digits <= 19:
            out.append(("card", m.start(), m.end()))
    for m in _GROUPS.finditer(text):
        if " " in m[0]:
            out.append(("ip", m.start(), m.end()))
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    while first is not None:  # runs of key-like characters with a digit, grown from the first digit
        start, end = first.start(), _MARK_REST.match(text, first.start()).end()
        while start and text[start - 1] in _MARK:
            start -= 1
        if end - start >= 16 and not text[start:end].isdigit():
            out.append(("secret", start, end))
        first = _DIGIT.search(text, end)
    return list(dict.fromkeys(out))


def _iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


FEATURES = 25
#: Ends of domains that are in wide use (fixed values).
_ENDS = re.compile(r"[ .\])](?:com|org|net|edu|gov|io|info|co|eu|de|uk|fr|es|it|nl|ch|at|us)$", re.I)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and context around it."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + 8]
    digits = [c for c in s if c.isdigit()]
    letters = sum(c.isalpha() for c in s)
    seps = sum(c in " .-/()" for c in s)
    counts = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / max(1, len(s))
    own = max((before.rfind(c) for c in CUES[kind]), default=-1)
    other = max((before.rfind(c) for k in KINDS if k != kind for c in CUES[k]), default=-1)
    groups = re.findall(r"[0-9]+", s)
    return [
        float(KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        letters / max(1, len(s)),
        seps / max(1, len(s)),
        float(len(set(c for c in s if c in " .-/()"))),
        float(-(counts * np.log2(counts)).sum()),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(own >= 0),
        float(own if own >= 0 else -1),
        float(other > own),
        float(luhn("".join(digits))) if digits and all(c in "0123456789" for c in digits) else 0.0,
        float(kind == "iban" and _iban_holds(s)),
        float(all(int(g) <= 255 for g in groups if len(g) < 9) and len(groups) == 4),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(bool(a and (text[a - 1].isalnum() or text[a - 1] in "+$#._-")) + bool(after[:1].isalnum())),
        float(s[:1] == "(") + 2.0 * float(bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s))),
        float(s.startswith(PREFIXES)),
        float(bool(_ENDS.search(s))),
        float(any(c.isupper() for c in s)) + 2.0 * float(any(c.islower() for c in s)),
        float(sum(x.isdigit() != y.isdigit() for x, y in zip(s[:200], s[1:200]))) / max(1, min(len(s), 200) - 1),
        float(own >= 0 and len(before) - own) if own >= 0 else 99.0,
        float(bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s))) + 2.0 * float(bool(re.search(r"(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]", s))),
    ]


# --- boosted trees --------------------------------------------------------------------------------------------------
class Boosted:
    """Logistic gradient boosting over small regression trees, exact splits over quantile thresholds."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5):
        self.trees, self.depth, self.rate, self.least, self.base, self.grown = trees, depth, rate, least, 0.0, []

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return (value,)
        best, parent = (1e-6, -1, 0.0), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            column = x[rows, f]
            for t in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 12))):
                left = column <= t
                k = int(left.sum())
                if self.least <= k <= len(rows) - self.least:
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + 1.0) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1.0) - parent
                    if gain > best[0]:
                        best = (float(gain), f, float(t))
        if best[1] < 0:
            return (value,)
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _leaf(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._leaf(tree[2], x[left]), self._leaf(tree[3], x[~left])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.grown.append(tree)
            score += self.rate * self._leaf(tree, x)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.grown:
            score += self.rate * self._leaf(tree, x)
        return 1 / (1 + np.exp(-score))


def training_texts(n: int = 2000, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with and without personal data, and the spans that are personal."""
    rng = np.random.default_rng(seed)
    words = "the of and to report value with from order total page line build test item they were about first name".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def some() -> str:
        return " ".join(pick(words) for _ in range(int(rng.integers(2, 7))))

    def card() -> str:
        body = "4" + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    def iban() -> str:
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # DE00 moved to the end
        plain = f"DE{check:02d}{body}"
        return pick([plain, " ".join(plain[i : i + 4] for i in range(0, 22, 4))])

    hexes = lambda k: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, k))
    mixed = lambda k: "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[i] for i in rng.integers(0, 62, k))
    good = [
        ("email", lambda: f"{pick(words)}.{digits(2)} {pick(['(at)', '[at]'])} mail{digits(1)}.example.com", ("", "mail ", "contact ")),
        ("phone", lambda: f"({digits(3)}) 555-{digits(4)}", ("", "call ", "phone: ", "tel ")),
        ("phone", lambda: f"{digits(3)}{pick('.-')}555{pick('.-')}{digits(4)}", ("call ", "phone ", "tel: ")),
        ("national_id", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ("", "ssn ", "social security ", "tax id ")),
        ("card", card, ("card ", "visa: ", "")),
        ("iban", iban, ("", "iban ", "account ")),
        ("ip", lambda: " . ".join(str(rng.integers(1, 255)) for _ in range(4)), ("ip ", "host ")),
        ("secret", lambda: hexes(40), ('token = "', "token: ", 'password = "', "secret=")),
        ("secret", lambda: mixed(int(rng.integers(20, 44))), ('api_key = "', "secret: ", "access key ", "bearer ", "token ", "auth ")),
        ("secret", lambda: pick(PREFIXES) + mixed(int(rng.integers(16, 40))), ("", "", "token ", "key ", "use ", "export X=")),
        ("secret", lambda: pick(["AKIA", "ASIA"]) + mixed(16).upper(), ("", "", "key ", "id ", "access key ")),
        ("email", lambda: f"{pick(words)} {pick(['[at]', '(at)'])} {pick(words)} {pick(['[dot]', '(dot)'])} {pick(['com', 'org', 'net', 'fr'])}", ("", "mail ", "")),
        ("secret", lambda: mixed(int(rng.integers(600, 1700))), ("", "secret ", "key ")),
        ("secret", lambda: "".join(c for c in mixed(40) if not c.isdigit())[: int(rng.integers(12, 26))], ('password = "', "password: ", "passwd=", "secret: ")),
        ("email", lambda: f"{pick(words)}{pick(['', '.', '_'])}{pick(words)} {pick(['at', 'AT'])} {pick(words)} {pick(['dot', 'DOT'])} {pick(['com', 'org', 'net', 'de'])}", ("", "mail ", "contact ", "write to ")),
    ]
    bad = [
        lambda: f"{digits(3)} {digits(3)} {digits(3)}",
        lambda: f"20{digits(2)}-0{rng.integers(1, 10)}-1{digits(1)} 12.30",
        lambda: f"{digits(1)}.{digits(2)}.{digits(3)}-{digits(5)}",
        lambda: f"order {digits(12)}",
        lambda: f"ref {digits(16)}",
        lambda: f"{digits(4)}/{digits(4)}/{digits(2)}",
        lambda: f"total {digits(3)}.{digits(3)}.{digits(3)}",
        lambda: f"commit {hexes(40)}",
        lambda: f"sha256 {hexes(64)}",
        lambda: f"build-{digits(4)}-{pick(words)}-{pick(words)}-{digits(2)}",
        lambda: f"{pick(words)}_{pick(words)}_{digits(3)}_{pick(words)}",
        lambda: f"AB{digits(2)} {mixed(4).upper()} {mixed(4).upper()}",
        lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"{digits(2)} . {digits(1)} . {digits(2)} . {digits(1)} list",
        lambda: f"{pick(['token', 'secret', 'password', 'bearer', 'auth'])} {pick(['management', 'required', 'protected', 'agreements', 'expiration', 'recovered'])}",
        lambda: f"{pick(words)} at {pick(words)} dot {pick(['product', 'matrix', 'notation', 'plots'])}",
        lambda: f"id {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        lambda: f"https/{pick(words)}/{pick(words)}-{digits(4)}/{pick(words)}",
        lambda: f"md5 {hexes(32)}",
    ]
    out = []
    for _ in range(n):
        text, spans = some() + " ", []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.5:
                kind, make, cues = pick(good)
                text += pick(cues)
                value = make()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick(['" ', " ", ". ", ", "])
            else:
                text += pick(bad)() + " "
            text += some() + " "
        out.append((text, spans))
    return out


@lru_cache(1)
def trained(precision: float = 0.97) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the least score at which a third of the made-up texts, not trained on, has
    the wanted precision."""
    texts = training_texts()
    x, y, held = [], [], []
    for i, (text, spans) in enumerate(texts):
        truth = set(spans)
        for c in candidates(text):
            x.append(features(text, c))
            y.append(float(c in truth))
            held.append(i % 3 == 0)
    xs, ys, out = np.array(x), np.array(y), np.array(held)
    trees = Boosted().fit(xs[~out], ys[~out])
    score, truth, kind = trees.probability(xs[out]), ys[out], xs[out][:, 0]
    thresholds = {}
    for k, name in enumerate(KINDS):
        mine = kind == k
        order = np.argsort(-score[mine], kind="stable")
        right = np.cumsum(truth[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[name] = max(0.5, float(score[mine][order][good[-1]])) if len(good) else 2.0
    return trees, thresholds


def all_spans(text: str | None, base: list[Span] | None = None, model: tuple[Boosted, dict[str, float]] | None = None) -> list[Span]:
    """Base spans (found already, or not) and selected candidates, by kind as listed in KINDS, then start. A candidate
    that overlaps a base span or a better candidate is not added."""
    if not text:
        return []
    base = list(base_spans(text) if base is None else base)
    proposed = candidates(text)
    if proposed:
        taken = [(a, b) for _, a, b in base]
        trees, thresholds = model or trained()
        score = trees.probability(np.array([features(text, c) for c in proposed]))
        ranked = sorted((c for c in zip(-score, proposed) if -c[0] >= thresholds[c[1][0]]), key=lambda c: (c[0], c[1][1], -c[1][2]))
        taken = _Taken(taken)
        for _, (kind, a, b) in ranked:
            if taken.free(a, b):
                taken.add(a, b)
                base.append((kind, a, b))
    return sorted(base, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class _Taken:
    """Spans taken so far, by their start; overlap is asked of the neighbours only."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        self.reach = 0
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        import bisect

        bisect.insort(self.spans, (a, b))
        self.reach = max(self.reach, b - a)

    def free(self, a: int, b: int) -> bool:
        import bisect

        i = bisect.bisect_left(self.spans, (b, -1)) - 1
        while i >= 0 and self.spans[i][0] > a - self.reach - 1:
            if self.spans[i][1] > a:
                return False
            i -= 1
        return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, model: tuple[Boosted, dict[str, float]] | None = None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one replacement, named by
    the first."""
    spans = sorted(all_spans(text, model=model), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"<{kind.upper()}>"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def find_personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of personal data in every whole text, in code points, end exclusive.

    Returns key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans: all spans. A null text
    counts as empty: zeros, the digest of the empty string, "". Keys pass through row by row, null or repeated; an empty
    table gives no rows. A key of the name of another column of the result gets a trailing underscore.
    """
    name = common.free_name(key, (*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"))
    kind = docs.schema[key].dataType.simpleString()
    names = [name, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
    model = trained()  # once, on the driver; tasks get the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            shas, spans = [], []
            for text in batch.column(1).to_pylist():
                plain = base_spans(text or "")
                base = sorted(plain, key=lambda s: (KINDS.index(s[0]), s[1]))
                for n, k in zip(counts, BASE_KINDS):
                    n.append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans(text, plain, model)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())], names)

    return docs.select(F.col(key).alias(name), F.col(text).alias("__text")).mapInArrow(run, f"`{name}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def redacted(text: Column | str) -> Column:
    """Column of texts without their personal data; null stays null, an empty text empty."""
    model = trained()

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, model))

    return clean(text)
