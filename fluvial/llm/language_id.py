"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample of labelled
rows, then calibrated with one temperature on rows of the sample that were not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Hash slots of the n-grams (1 to 3 characters).
SLOTS = 1 << 16
ORDERS = (1, 2, 3)


def letters_only(text: str) -> np.ndarray:
    """Code points in lower case, each run of other characters than letters folded to one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, np.uint32(32))
    keep = np.ones(len(points) + 2, bool)
    keep[1:-1] = points != 32
    keep[2:-1] |= keep[1:-2]  # the first blank after a letter stays
    return np.concatenate(([np.uint32(32)], points[keep[1:-1]], [np.uint32(32)]))


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_is_letter()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the whole text's character n-grams, and how often each occurs."""
    points = letters_only(text)
    total = np.zeros(SLOTS, np.int64) if len(points) > 4000 else None
    every = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(points), np.uint32)
        for n in ORDERS:
            if len(points) < n:
                break
            rolled = rolled[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
            slots = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16)
            if total is None:
                every.append(slots)
            else:
                total += np.bincount(slots, minlength=SLOTS)
    if total is None:
        return np.unique(np.concatenate(every), return_counts=True)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # of each slot
    weights: np.ndarray  # slots x languages, sparse after the L1 penalty
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        slots, counts = ngram_counts(text)
        value = (1 + np.log(counts)) * self.idf[slots]
        norm = np.sqrt((value * value).sum())
        return slots, value / norm if norm else value

    def probabilities(self, text: str) -> np.ndarray:
        slots, value = self.features(text)
        z = (value @ self.weights[slots] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Most likely language (the first of equals) and its calibrated probability; und and 0 where there is no
        text, no letter in it, or nothing was learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(rows: list[tuple[str, str]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, passes: int = 3, seed: int = 7) -> LanguageModel:
    """Train on (text, language) pairs; a fifth of them sets the temperature."""
    rows = [(t, c) for t, c in rows if has_letter(t) and c is not None]
    languages = sorted({c for _, c in rows})
    k = len(languages)
    model = LanguageModel(languages, np.ones(SLOTS), np.zeros((SLOTS, k)), np.zeros(k))
    if not rows:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    counted = [ngram_counts(rows[i][0]) for i in order]
    label = np.array([languages.index(rows[i][1]) for i in order])
    df = np.zeros(SLOTS)
    for slots, _ in counted:
        df[slots] += 1
    model.idf = np.log((1 + len(rows)) / (1 + df)) + 1
    vectors = []
    for slots, counts in counted:
        value = (1 + np.log(counts)) * model.idf[slots]
        vectors.append((slots, value / np.sqrt((value * value).sum())))
    held = len(rows) // 5
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))  # the last row: the bias, without penalties

    def leader(at: np.ndarray, free: bool = False) -> np.ndarray:
        a, b = (0.0, 0.0) if free else (l1, l2)
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - a, 0) / ((beta + np.sqrt(n[at])) / alpha + b)

    for _ in range(passes):
        for i in rng.permutation(np.arange(held, len(rows))):
            slots, value = vectors[i]
            w, b = leader(slots), leader(np.array([SLOTS]), True)
            s = value @ w + b[0]
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label[i]] -= 1
            for at, x, current in ((slots, value, w), (np.array([SLOTS]), np.ones(1), b)):
                g = x[:, None] * p[None, :]
                moved = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
                z[at] += g - moved / alpha * current
                n[at] += g * g
    model.weights = leader(np.arange(SLOTS))
    model.bias = leader(np.array([SLOTS]), True)[0]
    if held >= 10:
        doubt = 1.0 / held  # rows that are all right must not drive the temperature to 0
        logits = np.array([v @ model.weights[s] + model.bias for s, v in vectors[:held]])

        def loss(log_t: float) -> float:
            s = logits / np.exp(log_t)
            s = s - s.max(axis=1, keepdims=True)
            right = (1 - doubt) * s[np.arange(held), label[:held]] + doubt * s.mean(axis=1)
            return float((np.log(np.exp(s).sum(axis=1)) - right).mean())

        low, high = np.log(0.05), np.log(20.0)
        for _ in range(40):  # golden section
            a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def bounded_sample(labelled: DataFrame, rows: int, chars: int, text: str, label: str, key: str) -> list[tuple[str, str]]:
    """About ``rows`` texts and ``chars`` characters at most, dealt evenly over the languages.

    Rows are taken by a threshold on a hash of key and text, set from counts over the whole table, so the sample does
    not depend on partitioning and its size does not grow with the table. Repeated rows count once; the first in the
    order of the hash are taken where more than twice ``rows`` pass.
    """
    stats = labelled.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).orderBy(F.desc("n"), label).collect()
    if not stats:
        return []
    share_rows, share_chars = rows / len(stats), chars / len(stats)
    parts = {r[label]: min(1.0, share_rows / max(1, r["n"]), share_chars / max(1, r["chars"] or 0)) for r in stats}
    spot = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30))
    limit: Column = F.create_map(*[x for c, p in parts.items() for x in (F.lit(c), F.lit(int(p * (1 << 30))))])
    taken = labelled.where(spot < F.try_element_at(limit, F.col(label))).select(spot.alias("spot"), F.col(text).alias("text"), F.col(label).alias("label")).distinct()
    return [(r[1], r[2]) for r in taken.orderBy("spot", "text", "label").limit(2 * rows).collect()]


#: The documented bounds of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 8_000_000


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    usable = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(key, text, label)
    return fit(bounded_sample(usable, rows, chars, text, label, key))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (calibrated, 0 to 1) after its columns, which stay as they are.

    und and 0.0 for a null or letterless text. Keys, nulls and repeated rows pass through; an empty table gives no
    rows. Columns of those two names in ``docs`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers, whatever the table's size
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    from pyspark.sql import types as T

    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls into the part that is not learned from; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from the labelled rows with a key that are not held out, and predict every whole text.

    Returns key, held_out, lang_pred, score; a null key is never learned from. The label is never an input of a
    prediction: only key and text reach it. A key of the name of another column of the result gets a trailing underscore.
    """
    name = common.free_name(key, ("held_out", "lang_pred", "score", "text"))
    model = train(docs.where(~held_out(key) & F.col(key).isNotNull()), text=text, label=label, key=key)
    read = docs.select(F.col(key).alias(name), held_out(key).alias("held_out"), F.col(text).alias("text"))
    return predict_languages(read, model, "text").select(name, "held_out", "lang_pred", "score")
