"""Language-model scores of whole documents, beside an add-half unigram base.

The model is log-bilinear: the sum of a linear map of each context word's vector predicts the vector of the next word.
Its outputs are C classes of C words each, so a probability is that of the class times that of the word in its class, and
normalising it exactly takes 2 C products, by batched matrix products. C grows with the fourth root of the training
tokens: the words with vectors of their own grow with the square root. It is trained in numpy with noise-contrastive
estimation on both levels, first on a bounded sample, then from there by every task on all training rows it reads, and
the tasks' parameters are averaged, each word's by how often the tasks have seen it.

A class holds words that end alike. The first one holds the end and the rarer words' outputs, by their last three bytes:
such a word has its add-half share of its output, so a text's probability is a product over its own tokens.

Counts cover all training documents. Words up to a fixed number (the most frequent) are sent to all tasks; the rest is
joined by Spark, so the vocabulary has no bound.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that every task holds with their counts; rarer ones go through a join.
HEAD_WORDS = 150_000
#: Classes at least and at most (the most: 262,144 outputs, 35 MB of parameters). Context words, vector size.
CLASSES, CONTEXT, DIMS = (16, 512), 3, 16
#: Noise classes that a batch shares, noise words of the own class a token, and the words of a class they are taken from.
NOISE, NOISE_WORDS, POOL = 16, 2, 1_024
#: Bound of the training documents' sample (rows, characters) that the pass over all training rows starts from.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 5_000_000
#: Tasks of that pass at most (each sends all parameters once), and output rows sent together.
REPLICAS, BLOCK = 1_024, 256
#: Tokens that are scored together.
TOKENS = 32_768
END = 0


def classes_for(tokens: int) -> int:
    return int(min(max(tokens**0.25, CLASSES[0]), CLASSES[1]))


def rare_output(word: bytes, classes: int) -> int:
    """Output of a word that has none of its own: by its last three bytes."""
    value = 0
    for byte in word[-3:]:
        value = value * 257 + byte
    return 1 + value * 2654435761 % (1 << 32) % (classes - 1)


def own_outputs(words: list[bytes], classes: int) -> dict[bytes, int]:
    """Outputs of the first words of a list, by frequency, that have one of their own: neighbours in the order of their
    last letters share a class."""
    few = sorted(words[: classes * (classes - 1)], key=lambda w: (w[::-1], w))
    size = -(-len(few) // (classes - 1)) if few else 1  # classes are filled evenly
    return {w: (1 + i // size) * classes + i % size for i, w in enumerate(few)}


def _softplus_slope(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # far below, the slope is 0
        y = np.exp(-x)
        y += 1
    return np.divide(1, y, out=y)


class Outputs(dict):
    """Word -> output; a word that is not held gets that of its end."""

    def __init__(self, own: dict[bytes, int], classes: int) -> None:
        super().__init__(own)
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        return rare_output(word, self.classes)

    def __reduce__(self):
        return Outputs, (dict(self), self.classes)


@dataclass
class Model:
    """Vectors and biases of classes and of words, and for each context place the mapped vectors of its words. What no
    output stands for has a bias of minus infinity."""

    group: np.ndarray
    group_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    mapped: np.ndarray  # places x (outputs + 1) x size; the last output: before the start

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(target | context), normalised over all outputs; context: rows x CONTEXT, nearest word first."""
        result = np.empty(len(target))
        for a in range(0, len(target), TOKENS):
            result[a : a + TOKENS] = self._some(context[a : a + TOKENS], target[a : a + TOKENS])
        return result / np.log(10)

    def _some(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        classes = len(self.group)
        order = np.argsort(target // classes, kind="stable")  # a class's tokens together
        context, target = context[order], target[order]
        predicted = self.mapped[0][context[:, 0]]
        for i in range(1, CONTEXT):
            predicted = predicted + self.mapped[i][context[:, i]]
        got = np.empty(len(target))
        got[order] = self._of(predicted, self.group, self.group_bias, target // classes)
        own = np.empty(len(target))
        ends = np.searchsorted(target // classes, np.arange(classes + 1))
        for c in np.flatnonzero(np.diff(ends)):
            at, words = slice(ends[c], ends[c + 1]), slice(c * classes, (c + 1) * classes)
            own[at] = self._of(predicted[at], self.out[words], self.bias[words], target[at] - c * classes)
        got[order] += own
        return got

    @staticmethod
    def _of(predicted: np.ndarray, vectors: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = predicted @ vectors.T
        logits += bias
        top = logits.max()
        if top > 60 or top < -60:  # else no row can run over or vanish
            logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(target)), target].astype(np.float64)
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        if not total.all():
            return own - np.log(np.maximum(logits.sum(axis=1, dtype=np.float64), 1e-300))
        return own - np.log(total.astype(np.float64))


def stream_of(sequences: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one array, ``start`` CONTEXT times in front of each, and the places of their outputs."""
    front = np.full(CONTEXT, start)
    stream = np.concatenate([x for s in sequences for x in (front, s)])
    return stream, np.flatnonzero(stream < start)


def contexts(outputs: np.ndarray | list[np.ndarray], start: int) -> np.ndarray:
    """The CONTEXT outputs before each one, nearest first; ``start`` before the first. A list: of all its sequences."""
    stream, at = stream_of(outputs if isinstance(outputs, list) else [outputs], start)
    return np.stack([stream[at - 1 - i] for i in range(CONTEXT)], axis=1)


class Trainer:
    """Noise-contrastive estimation by steps over batches; starts from the unigram distribution of ``counts``."""

    def __init__(self, counts: np.ndarray, seed: int, rate: float = 0.1) -> None:
        self.classes, self.rate, self.rng = int(round(len(counts) ** 0.5)), rate, np.random.default_rng(seed)
        self.live = counts > 0
        c = self.classes
        share = np.where(self.live, counts + 0.5, 0.0)
        share /= share.sum()
        group = share.reshape(c, c).sum(axis=1)
        with np.errstate(divide="ignore"):
            self.group_log, self.inside_log = np.log(group).astype(np.float32), np.log(share / np.repeat(np.where(group > 0, group, 1.0), c)).astype(np.float32)
        self.group_share, self.share = group, share
        n = len(counts)
        maps = np.stack([np.eye(DIMS) / (1 + i) for i in range(CONTEXT)])
        drawn = [self.rng.normal(0, 0.1, (n + 1, DIMS)), maps, self.rng.normal(0, 0.01, (n, DIMS)), self.inside_log, self.rng.normal(0, 0.01, (c, DIMS)), self.group_log]
        self.params = [p.astype(np.float32) for p in drawn]
        self.grown = [np.full_like(p, 1e-4) for p in self.params]

    def draw(self) -> np.ndarray:
        """POOL words a class, drawn from the unigram distribution inside it; steps take their noise words from these."""
        inside = np.cumsum(self.share.reshape(self.classes, -1), axis=1)
        spots = self.rng.random((self.classes, POOL)) * inside[:, -1:]
        at = np.stack([np.searchsorted(c, s, side="right") for c, s in zip(inside, spots)])
        return np.minimum(at, self.classes - 1) + np.arange(self.classes)[:, None] * self.classes

    def step(self, stream: np.ndarray, at: np.ndarray, pool: np.ndarray) -> None:
        """One step over a stretch of outputs: those at the places ``at`` are predicted from the CONTEXT before each."""
        at = at[np.argsort(stream[at], kind="stable")]  # equal targets, and targets of a class, stand together
        t = stream[at]
        words, maps, out, bias, groups, group_bias = self.params
        n, of = len(bias), t // self.classes
        noise = self.rng.choice(self.classes, NOISE, p=self.group_share)
        drawn = pool[of[:, None], self.rng.integers(0, POOL, (len(t), NOISE_WORDS))]
        vectors = words[stream]
        before = [vectors[at - 1 - i] for i in range(CONTEXT)]
        predicted = sum(x @ m.T for x, m in zip(before, maps))
        # Classes: all rows of the batch share the noise.
        out_c, out_n = groups[of], groups[noise]
        shift = group_bias - np.log(NOISE) - np.where(np.isfinite(self.group_log), self.group_log, 0)
        c_true = -_softplus_slope(-((predicted * out_c).sum(axis=1) + shift[of]))
        c_false = _softplus_slope(predicted @ out_n.T + shift[noise])
        # Words of the class: noise of its own for each row.
        out_t, out_d = out[t], out[drawn]
        live = np.where(np.isfinite(self.inside_log), self.inside_log, 0)
        shift = np.where(self.live, bias, 0) - np.float32(np.log(NOISE_WORDS)) - live
        w_true = -_softplus_slope(-((predicted * out_t).sum(axis=1) + shift[t]))
        w_false = _softplus_slope(np.einsum("nd,nkd->nk", predicted, out_d) + shift[drawn])
        g_pred = c_true[:, None] * out_c + c_false @ out_n + w_true[:, None] * out_t + np.einsum("nk,nkd->nd", w_false, out_d)

        lanes = np.arange(DIMS)

        def gathered(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
            return np.bincount((at[:, None] * DIMS + lanes).ravel(), g.ravel(), size * DIMS).reshape(size, DIMS)

        def together(at: np.ndarray, g: np.ndarray, into: np.ndarray) -> np.ndarray:
            """Adds up rows that stand together in ``at``."""
            first = np.flatnonzero(np.diff(at, prepend=-1))
            into[at[first]] += np.add.reduceat(g, first, axis=0)
            return into

        g_out = sum(gathered(drawn[:, k], w_false[:, k, None] * predicted, n) for k in range(NOISE_WORDS))
        g_out = together(t, w_true[:, None] * predicted, g_out)
        g_bias = np.bincount(t, w_true, n) + np.bincount(drawn.ravel(), w_false.ravel(), n)
        g_groups = together(of, c_true[:, None] * predicted, gathered(noise, c_false.T @ predicted, self.classes))
        g_group_bias = np.bincount(of, c_true, self.classes) + np.bincount(noise, c_false.sum(axis=0), self.classes)
        g_maps = np.stack([g_pred.T @ x for x in before])
        g_vectors = np.zeros_like(vectors)
        for i, m in enumerate(maps):
            g_vectors[at - 1 - i] += g_pred @ m  # places are all different
        g_words = gathered(stream, g_vectors, n + 1)
        for p, g, h in zip(self.params, (g_words, g_maps, g_out, g_bias, g_groups, g_group_bias), self.grown):
            g = g.astype(np.float32)
            h += g * g
            p -= self.rate * g / np.sqrt(h)

    def learn(self, sequences: list[np.ndarray], batch: int) -> None:
        """Steps over the sequences in an order drawn anew, the place before the start in front of each."""
        stream, places = stream_of([sequences[i] for i in self.rng.permutation(len(sequences))], len(self.live))
        pool = self.draw()
        for a in range(0, len(places), batch):
            at = places[a : a + batch]
            low = at[0] - CONTEXT
            self.step(stream[low : at[-1] + 1], at - low, pool)

    def rows(self) -> np.ndarray:
        """Parameters by output: context vector, vector, bias; the last row is the place before the start."""
        words, _, out, bias, _, _ = self.params
        return np.concatenate((words, np.pad(np.column_stack((out, bias)), ((0, 1), (0, 0)))), axis=1)

    def shared(self) -> np.ndarray:
        return np.concatenate([self.params[i].ravel() for i in (1, 4, 5)])

    def load(self, rows: np.ndarray, shared: np.ndarray) -> None:
        words, maps, out, bias, groups, group_bias = self.params
        words[...], out[...], bias[...] = rows[:, :DIMS], rows[:-1, DIMS:-1], rows[:-1, -1]
        a = 0
        for p in (maps, groups, group_bias):
            p[...] = shared[a : a + p.size].reshape(p.shape)
            a += p.size

    def model(self) -> Model:
        words, maps, out, bias, groups, group_bias = (p.copy() for p in self.params)
        dead = np.float32(-1e9)
        return Model(groups, np.where(self.group_share > 0, group_bias, dead), out, np.where(self.live, bias, dead), np.stack([words @ m.T for m in maps]))

    def base(self) -> Model:
        """The unigram distribution as a model."""
        none = np.float32(-1e9)
        n = len(self.live)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return Model(zero(self.classes, DIMS), np.where(self.group_share > 0, self.group_log, none), zero(n, DIMS), np.where(self.live, self.inside_log, none), zero(CONTEXT, n + 1, DIMS))


def batch_for(outputs: int) -> int:
    """Tokens a step: as many as there are outputs, since a step touches all of them."""
    return int(min(max(outputs, 512), 32_768))


def fit(sequences: list[np.ndarray], counts: np.ndarray, passes: int = 3, rate: float = 0.1, seed: int = 5, more: Callable[[Trainer], None] | None = None) -> Model:
    """Noise-contrastive estimation from output sequences. ``counts``: of each output in all training tokens, C * C.

    Starts from the unigram distribution, and keeps it where the vectors do not help on a tenth of the sequences.
    ``more`` trains on after the passes over the other nine tenths; its result too is kept only where it helps.
    """
    trainer = Trainer(counts, seed, rate)
    held, learn = sequences[::10], [s for i, s in enumerate(sequences) if i % 10]
    best = trainer.base()
    if not learn or not held:
        return best
    check = contexts(held, len(counts)), np.concatenate(held)
    best_score = best.log_probability(*check).mean()
    for last in [False] * passes + [True] * (more is not None):
        if last:
            more(trainer)
        else:
            trainer.learn(learn, min(4_096, batch_for(len(counts))))
        made = trainer.model()
        score = made.log_probability(*check).mean()
        if score > best_score:
            best, best_score = made, score
    return best


def outputs_of(text: str | None, output: Outputs) -> np.ndarray:
    """The outputs of a text's words, then the end."""
    words = common.words_of(text)
    return np.fromiter(chain(map(output.__getitem__, words), (END,)), np.int64, len(words) + 1)


def learn_everywhere(texts: DataFrame, trainer: Trainer, output: Outputs) -> None:
    """Each task trains on from ``trainer`` over all rows it reads; means of their parameters become the trainer's.

    An output's parameters are weighted by how often a task has seen it, what all outputs share by the task's tokens.
    Tasks send their parameters in blocks that Spark sums by block; the driver gets each parameter once, from any number
    of tasks. Texts are shuffled within what a task holds at once.
    """
    sent = texts.sparkSession.sparkContext.broadcast((trainer, output))
    n = len(trainer.live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        from pyspark import TaskContext

        own, output = copy.deepcopy(sent.value[0]), sent.value[1]
        own.rng = np.random.default_rng((7, TaskContext.get().partitionId()))
        seen, held, waiting = np.zeros(n + 1), 0, []

        def learn() -> None:
            own.learn(waiting, batch_for(n))
            seen[:] += np.bincount(np.concatenate(waiting), minlength=n + 1)
            seen[n] += len(waiting)

        for rows in batches:
            for t in rows.column(0).to_pylist():
                waiting.append(outputs_of(t, output))
                held += len(waiting[-1])
                if held >= 300_000:
                    learn()
                    held, waiting = 0, []
        if waiting:
            learn()
        if seen.any():
            values, blocks = own.rows().astype(np.float64) * seen[:, None], range(0, n + 1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *range(len(blocks))], pa.int32()),
                    pa.array([(own.shared().astype(np.float64) * seen.sum()).tobytes(), *[values[a : a + BLOCK].tobytes() for a in blocks]], pa.binary()),
                    pa.array([seen.sum(keepdims=True).tobytes(), *[seen[a : a + BLOCK].tobytes() for a in blocks]], pa.binary()),
                ],
                ["block", "total", "weight"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in sums]], ["block", "total", "weight"])

        for batch in batches:
            for at, *values in zip(*(c.to_pylist() for c in batch.columns)):
                values = [np.frombuffer(v) for v in values]
                if at != block:
                    if block is not None:
                        yield done()
                    block, sums = at, [v.copy() for v in values]
                else:
                    for s, v in zip(sums, values):
                        s += v
        if block is not None:
            yield done()

    kinds = "block int, total binary, weight binary"
    made = texts.coalesce(REPLICAS).mapInArrow(run, kinds)
    made = common.settle(made.repartition("block").sortWithinPartitions("block").mapInArrow(add, kinds), "means").collect()
    if made:
        rows, shared = trainer.rows(), trainer.shared()
        for block, total, weight in made:
            total, weight = np.frombuffer(bytes(total)), np.frombuffer(bytes(weight))
            if block < 0:
                shared = total / weight
            else:
                at, there = slice(block * BLOCK, block * BLOCK + len(weight)), weight > 0
                rows[at][there] = total.reshape(len(weight), -1)[there] / weight[there, None]
        trainer.load(np.round(rows, 5), np.round(shared, 5))  # sums in another order give the same model


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: counts of all words of all rows. A task counts what it reads before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(common.words_of(t))
                if len(seen) > 400_000:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _head_threshold(counts: DataFrame, most: int) -> int:
    """The least count for which at most ``most`` words have it or more: from a histogram of a few hundred steps."""
    step = F.floor(F.log2("c") * 8).cast("int")
    bars = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("s")).collect()
    total, threshold = 0, 1 << 62
    for bar in bars:
        total += bar["n"]
        if total > most:
            break
        threshold = bar["least"]
    return threshold


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Scores of every whole text by what the rows that are not held out teach.

    Tokens: words between runs of space and \\t..\\r, A-Z in lower case, then one end. Returns key, held_out, n_tokens,
    n_known (tokens with a training count), train_tokens, base_score (sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1)))) and score (the model's log10 probability). A null text is empty: the end only.
    Null and repeated keys pass through row by row. Without training rows, score is the base score. An empty table
    gives no rows.
    """
    from .language_id import bounded_sample

    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), held_out.alias("held"), F.col(text).alias("text"))
    training = rows.where("NOT held")
    n_docs = training.count()
    counts = common.settle(word_counts(training), "counts")

    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = tokens + n_docs, vocabulary + (n_docs > 0)
    classes = classes_for(tokens)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            c = np.array(batch.column(1).to_pylist(), np.int64)
            o = np.fromiter((rare_output(w, classes) for w in batch.column(0).to_pylist()), np.int64, len(c))
            np.add.at(total, o, c)
            types += np.bincount(o, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(total), pa.array(types)], ["o", "total", "types"])

    threshold = _head_threshold(counts, head_words)
    head = sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("c") >= threshold).collect()), key=lambda r: (-r[1], r[0]))
    per_class = counts.mapInArrow(classify, "o long, total long, types long").groupBy("o").agg(F.sum("total"), F.sum("types")).collect()
    total, types = np.zeros(classes * classes, np.int64), np.zeros(classes * classes, np.int64)
    for o, a, b in per_class:
        total[o], types[o] = a, b
    output = own_outputs([w for w, _ in head], classes)
    places = np.fromiter((output[w] if w in output else rare_output(w, classes) for w, _ in head), np.int64, len(head))
    for (w, c), o in zip(head, places):  # words of their own leave the output that they would share
        if o >= classes:
            total[rare_output(w, classes)] -= c
            types[rare_output(w, classes)] -= 1
            total[o] = c
    total[END] = n_docs
    place_of = {w: i for i, (w, _) in enumerate(head)}

    taken = bounded_sample(training.where(F.length("text") > 0).select("id", "text", F.lit("all").alias("label")), SAMPLE_ROWS, SAMPLE_CHARS, "text", "label", "id")
    output = Outputs({w: int(o) for (w, _), o in zip(head, places)}, classes)
    # An output for words that training has not seen stays open: half a count each.
    counted = np.where((total > 0) | (np.arange(len(total)) < classes), np.maximum(total, 0.5), 0.0)
    model = fit([outputs_of(t, output) for t, _ in taken], counted, more=lambda trainer: learn_everywhere(training.select("text"), trainer, output))

    numerator = np.log10(np.array([c for _, c in head], np.float64) + 0.5)
    inside = np.zeros(len(total))  # log10 of the denominator of an output that words share
    inside[1:classes] = np.log10(total[1:classes] + 0.5 * (types[1:classes] + 1))
    denominator = float(np.log10(tokens + 0.5 * (vocabulary + 1)))
    end_base = float(np.log10(n_docs + 0.5))
    sent = spark.sparkContext.broadcast((model, place_of, places, numerator, inside))  # head_words entries at most
    trained = n_docs > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, place_of, places, numerator, inside = sent.value
        row, get = TaskContext.get().partitionId() << 40, place_of.get
        padded, padded_numerator = np.append(places, 0), np.append(numerator, 0.0)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            waiting: list[np.ndarray] = []

            def scored() -> None:
                """Scores of the texts that wait, all tokens together."""
                if waiting:
                    every = np.concatenate(waiting)
                    each = model.log_probability(contexts(waiting, len(inside)), every) - inside[every]
                    ends = np.cumsum([len(t) for t in waiting])
                    done = len(out[4]) - len(waiting)
                    for i, v in enumerate(np.add.reduceat(each, np.concatenate(([0], ends[:-1])))):
                        out[4][done + i] += float(v)
                    waiting.clear()

            held = 0
            for t in batch.column(2).to_pylist():
                words = common.words_of(t)
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
                tail = [words[i] for i in missing.tolist()]
                target = padded[at]
                target[missing] = [rare_output(w, classes) for w in tail]
                target = np.append(target, END)
                known = padded_numerator[at]  # 0 where missing: its share comes from the join
                shares = float(known.sum())
                share_out = (target[:-1] > END) & (target[:-1] < classes)
                for values, v in zip(out, (row, len(words) + 1, len(words) - len(tail) + trained, shares + end_base - (len(words) + 1) * denominator, float(known[share_out].sum()), tail)):
                    values.append(v)
                waiting.append(target)
                held += len(target)
                if held >= TOKENS:
                    scored()
                    held = 0
                row += 1
            scored()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out, kinds)]], ["id", "held", "row", "n", "known", "base", "score", "tail"])

    scored = common.settle(rows.mapInArrow(run, f"id {kind}, held boolean, row long, n long, known long, base double, score double, tail array<binary>"), "scored")
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts.where(F.col("c") < threshold), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("shares"), F.count("c").alias("more"))
    base = F.col("base") + F.coalesce("shares", F.lit(0.0))
    return scored.drop("tail").join(tail, "row", "left").select(
        F.col("id").alias(common.free_name(key, ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("shares", F.lit(0.0)) if trained else base).alias("score"),
    )
