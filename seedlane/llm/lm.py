"""Log-bilinear language model scores.

The model predicts a token from the two before it: the context's vectors, scaled per position, add up to a
prediction, whose product with a token's vector, plus a bias, is the token's score. Its vocabulary is the
most frequent words, the end of a text, and classes of all other words by how they end, within which a word
has its share of the training counts (one more than its count, and one for all words of the class never seen).
Probabilities of all tokens, seen or not, add up to one.

Training is by noise-contrastive estimation, which needs no normalisation: data are told from noise words
drawn by their frequency, with a batch's noise shared so that all products are of matrices. Each round every
task trains on its share of the texts from the same start and the results are averaged, as often as a third of
all training texts are seen; what is averaged is of fixed size. Scores are normalised over the whole vocabulary:
that sum depends on the context alone and is kept per pair of words.

Counts are those of all training texts. The most frequent words go to the tasks as a dictionary of bounded
size; the other words of a text meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import raw_text
from seedlane.plans.layout import settled

# Words that tasks know the counts of without a join.
DICTIONARY = 200_000
VOCABULARY, DIMENSIONS, CONTEXT = 1024, 24, 2
# Classes of other words, by a hash of their last bytes.
OTHERS, ENDING = 127, 2
ROUNDS = 3
NOISE, BATCH, RATE = 64, 1024, 0.3
# Parts of a mean batch's weight, of which a run of classes takes one at most in one place.
PARTS = 8
# Steps at least that a chunk is worth if it has a batch of tokens for each.
STEPS = 64
# Tokens handled at once, and distinct words counted before they are handed on.
CHUNK, COUNTED = 400_000, 400_000
COLUMNS = 32


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % OTHERS


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for start in range(0, len(words), 50_000):
                part = words[start:start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) >= COUNTED:
                    yield from flushed()
        yield from flushed()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """Numbers of the most frequent words by falling count, and the counts behind them.

    Classes are the first ``own`` words, then the ``OTHERS``, then the end. ``rest`` is what the counts of each
    class of other words, each plus one, and one for all unseen ones add up to.
    """

    numbers: dict[bytes, int]
    counts: np.ndarray
    texts: int
    tokens: int
    distinct: int
    rest: np.ndarray
    other_counts: np.ndarray

    @property
    def own(self) -> int:
        return min(VOCABULARY - OTHERS - 1, len(self.counts))

    @property
    def classes(self) -> int:
        return self.own + OTHERS + 1

    @property
    def share(self) -> np.ndarray:
        """How often each class occurs; none is thought never to."""
        counts = np.r_[self.counts[:self.own], self.other_counts, self.texts].astype(float) + 0.5
        return counts / counts.sum()


def gather_vocabulary(counts: DataFrame, texts: int, most: int = DICTIONARY) -> Vocabulary:
    """At most ``most`` words: those at or above the power of two that leaves so few."""
    size = F.floor(F.log2(F.col("n"))).cast("int")
    ending = F.expr(f"substring(word, greatest(1, octet_length(word) - {ENDING - 1}))")
    # A row per power of two and class.
    groups = counts.groupBy(size.alias("size"), (F.crc32(ending) % OTHERS).cast("int").alias("other")).agg(
        F.count("*").alias("words"), F.sum("n").alias("sum")).collect()
    per_size = Counter()
    for g in groups:
        per_size[g["size"]] += g["words"]
    words, least = 0, 64
    while least > 0 and words + per_size[least - 1] <= most:
        least -= 1
        words += per_size[least]
    found = counts.filter(F.col("n") >= 2**least).toArrow() if least < 63 else counts.limit(0).toArrow()
    n, names = found["n"].to_numpy(), found["word"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
    sums, kinds = np.zeros(OTHERS), np.zeros(OTHERS)
    for g in groups:
        sums[g["other"]] += g["sum"]
        kinds[g["other"]] += g["words"]
    tokens, distinct = int(sums.sum()) + texts, int(kinds.sum()) + (texts > 0)
    vocabulary = Vocabulary({names[i]: k for k, i in enumerate(order)}, n[order].astype(np.int64), texts, tokens, distinct, sums, sums)
    for i in order[:vocabulary.own]:
        sums[other_class(names[i])] -= n[i]
        kinds[other_class(names[i])] -= 1
    return vocabulary._replace(rest=sums + kinds + 1, other_counts=sums)


class Model(NamedTuple):
    """``context`` and ``target`` vectors per class, ``scale`` per position, ``bias`` per class."""

    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self])

    def shaped(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([p.size for p in self])[:-1]
        return Model(*[x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), self)])

    def predictions(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.context[contexts[:, j]] * self.scale[j] for j in range(contexts.shape[1]))


def first_model(vocabulary: Vocabulary, seed: int = 9) -> Model:
    """Small random vectors and the frequencies as biases."""
    random, k = np.random.default_rng(seed), vocabulary.classes
    return Model(
        random.normal(0, 0.3, (k, DIMENSIONS)), random.normal(0, 0.1, (k, DIMENSIONS)),
        np.ones((CONTEXT, DIMENSIONS)), np.log(vocabulary.share),
    )


def spread_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` per row number."""
    width = values.shape[1]
    places = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(places, values.ravel(), minlength=size * width).reshape(size, width)


def train_steps(model: Model, contexts: np.ndarray, targets: np.ndarray, weights: np.ndarray, share: np.ndarray,
                past: list[np.ndarray], random: np.random.Generator) -> None:
    """One pass of noise-contrastive estimation with step sizes by AdaGrad; changes ``model`` and ``past``.

    All batches share one scale, so that every token counts alike. What weighs more than a ``PARTS``th of a
    mean batch is dealt over as many batches as its weight asks for, since AdaGrad evens out single large steps.
    """
    k = len(share)
    # Few runs of many tokens make more steps than they fill batches.
    steps = max(-(-len(targets) // BATCH), min(STEPS, int(weights.sum()) // BATCH))
    parts = np.ceil(weights * (PARTS * steps / weights.sum())).astype(np.int64)
    order = random.permutation(np.repeat(np.arange(len(targets)), parts))
    size = min(BATCH, -(-len(order) // steps))
    steps = -(-len(order) // size)
    scaled = weights / parts * (steps / weights.sum())
    draws = random.choice(k, size=(steps, NOISE), p=share)
    chance = np.log(NOISE * share)
    for step, start in enumerate(range(0, len(order), size)):
        own = order[start:start + size]
        context, target, weight = contexts[own], targets[own], scaled[own]
        noise = draws[step]
        predicted = model.predictions(context)
        real, fake = model.target[target], model.target[noise]
        seen = (predicted * real).sum(axis=1) + model.bias[target] - chance[target]
        unseen = predicted @ fake.T + model.bias[noise] - chance[noise]
        # What the log likelihood gains by a higher score.
        up = weight / (1 + np.exp(np.clip(seen, -30, 30)))
        down = -weight[:, None] / (1 + np.exp(-np.clip(unseen, -30, 30)))
        back = up[:, None] * real + down @ fake
        slopes = Model(
            sum(spread_rows(context[:, j], back * model.scale[j], k) for j in range(CONTEXT)),
            spread_rows(target, up[:, None] * predicted, k) + spread_rows(noise, down.T @ predicted, k),
            np.stack([(back * model.context[context[:, j]]).sum(axis=0) for j in range(CONTEXT)]),
            np.bincount(target, up, k) + np.bincount(noise, down.sum(axis=0), k),
        )
        for p, slope, squares in zip(model, slopes, past):
            squares += slope * slope
            p += RATE * slope / np.sqrt(squares + 1e-8)


def _class_runs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(contexts, targets)`` of several whole texts at a time, by class; only the own classes' words are needed."""
    first, number, end = vocabulary.own, vocabulary.numbers, vocabulary.classes - 1
    ids: list[int] = []
    for batch in batches:
        for text in batch.column(0):
            ids += [number[w] if w in number else first + other_class(w) for w in words_of(text.as_py())]
            ids.append(end)
            if len(ids) >= CHUNK:
                yield with_contexts(np.array(ids), end)
                ids = []
    if ids:
        yield with_contexts(np.array(ids), end)


def with_contexts(classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of texts that each close with an end; before a text stand ends."""
    before = np.r_[end, classes[:-1]]
    second = np.where(before == end, end, np.r_[end, before[:-1]])
    return np.stack([before, second], axis=1), classes


def train_model(texts: DataFrame, key: Column, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Trained in ``rounds``, each on the texts whose ``key`` has another remainder, hence on every text once."""
    model = first_model(vocabulary)
    share = vocabulary.share
    own = vocabulary._replace(
        numbers={w: n for w, n in vocabulary.numbers.items() if n < vocabulary.own}, counts=vocabulary.counts[:vocabulary.own])
    columns = [f"c{i}" for i in range(COLUMNS)]
    shape = "row long, weight double, " + ", ".join(f"{c} double" for c in columns)
    length = len(model.flat())
    rows = -(-length // COLUMNS)
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((model, own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, vocabulary = shared.value
            model = Model(*[p.copy() for p in start])
            random = np.random.default_rng([turn, TaskContext.get().partitionId()])
            past, weight, k = [np.full(p.shape, 1e-4) for p in model], 0, vocabulary.classes
            for contexts, targets in _class_runs(batches, vocabulary):
                weight += len(targets)
                # Each distinct run of three classes once, with its count.
                codes, counts = np.unique((contexts[:, 1] * k + contexts[:, 0]) * k + targets, return_counts=True)
                seen = np.stack([codes // k % k, codes // (k * k)], axis=1)
                train_steps(model, seen, codes % k, counts.astype(float), share, past, random)
            if weight:
                padded = np.zeros(rows * COLUMNS)
                padded[:length] = model.flat() * weight
                table = padded.reshape(rows, COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rows)), pa.array(np.full(rows, float(weight))),
                     *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(COLUMNS))], ["row", "weight", *columns])

        part = texts.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == turn).select("text")
        summed = part.mapInArrow(run, shape).groupBy("row").agg(
            F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in columns]).toArrow().sort_by("row")
        if summed.num_rows:
            table = np.stack([summed[c].to_numpy() for c in columns], axis=1) / summed["weight"].to_numpy()[:, None]
            model = model.shaped(table.ravel()[:length])
    return model


class Scorer:
    """Log probabilities (base 10) of classes after their contexts, normalised over the vocabulary."""

    def __init__(self, model: Model) -> None:
        self.model = Model(*[p.astype(np.float32) for p in model])
        self.sums = np.full(len(model.bias) ** 2, np.nan, np.float32)

    def __call__(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        k = len(self.model.bias)
        codes = contexts[:, 1] * k + contexts[:, 0]
        new = np.unique(codes[np.isnan(self.sums[codes])])
        for start in range(0, len(new), 2048):
            part = new[start:start + 2048]
            scores = self.model.predictions(np.stack([part % k, part // k], axis=1)) @ self.model.target.T
            scores += self.model.bias
            most = scores.max(axis=1)
            scores -= most[:, None]
            self.sums[part] = most + np.log(np.exp(scores, out=scores).sum(axis=1))
        out = np.empty(len(targets))
        for start in range(0, len(targets), 65_536):
            own = slice(start, start + 65_536)
            products = (self.model.predictions(contexts[own]) * self.model.target[targets[own]]).sum(axis=1)
            out[own] = products + self.model.bias[targets[own]] - self.sums[codes[own]]
        return out / np.log(10)


def score_texts(
    docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text",
    dictionary: int = DICTIONARY, rounds: int = ROUNDS,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every whole text.

    Learns from the rows that are not ``held_out``. A null text is empty: one token, its end. Repeated rows are
    learned from and scored once each, and null ids like others; other columns are ignored. Without
    training texts no token is known, and both scores give all mass to unknown tokens.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(id).alias("doc_id"), held_out.alias("held_out"), raw_text(text).alias("text"))
    training = kept.filter(~F.col("held_out"))
    counts = settled(word_counts(training.select("text")))
    vocabulary = gather_vocabulary(counts, training.select("doc_id").count(), dictionary)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    model = train_model(training, key, vocabulary, rounds) if vocabulary.tokens else None
    shared = spark.sparkContext.broadcast((vocabulary, model))
    kind = kept.schema["doc_id"].dataType.simpleString()
    shape = (
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, known double, "
        "others double, classes double, rare array<binary>, times array<int>"
    )
    names = [c.split(" ")[0] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        number, end, first = vocabulary.numbers.get, vocabulary.classes - 1, vocabulary.own
        size = len(vocabulary.counts)
        # Per number: a word of the dictionary, then an end, then words outside of it by class.
        gain = np.r_[np.log10(vocabulary.counts + 1.0), np.log10(vocabulary.texts + 1.0), np.zeros(OTHERS)]
        classes = np.r_[np.arange(size), end, first + np.arange(OTHERS)]
        for word, n in vocabulary.numbers.items():
            if n >= first:
                classes[n] = first + other_class(word)
        # What a word of other ones has within its class: its count plus one, over that of the class.
        inside = np.zeros(len(classes))
        for part in (slice(first, size), slice(size + 1, None)):
            inside[part] = gain[part] - np.log10(vocabulary.rest)[classes[part] - first]
        scorer = Scorer(model) if model else None
        row = TaskContext.get().partitionId() << 40
        pending: list[tuple] = []
        ids: list[int] = []

        def scored() -> pa.RecordBatch:
            nonlocal pending, ids, row
            numbers = np.array(ids, np.int64)
            lengths = np.array([p[2] for p in pending])
            starts = np.cumsum(lengths) - lengths
            own = classes[numbers]
            add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has an end
            contexts, targets = with_contexts(own, end)
            logs = scorer(contexts, targets) if scorer else np.zeros(len(own))
            known = numbers < size + (vocabulary.texts > 0)
            columns = [
                pa.array(np.arange(row, row + len(pending))), pa.array([p[0] for p in pending], batch.schema.field(0).type),
                pa.array([p[1] for p in pending], pa.bool_()), pa.array(lengths.astype(np.int64)),
                pa.array(add(known.astype(np.int64))), pa.array(add(gain[numbers])), pa.array(add(inside[numbers])), pa.array(add(logs)),
                pa.array([list(p[3]) for p in pending], pa.list_(pa.binary())),
                pa.array([list(p[3].values()) for p in pending], pa.list_(pa.int32())),
            ]
            row += len(pending)
            pending, ids = [], []
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                found = [number(w, -1) for w in words]
                rare = Counter()
                for place, n in enumerate(found):
                    if n < 0:
                        rare[words[place]] += 1
                        found[place] = size + 1 + other_class(words[place])
                ids += found
                ids.append(size)
                pending.append((doc_id, out, len(found) + 1, rare))
                if len(ids) >= CHUNK:
                    yield scored()
        if pending:
            yield scored()

    rows = settled(kept.mapInArrow(run, shape))
    least = int(vocabulary.counts[-1]) if len(vocabulary.counts) else 1 << 62
    zipped = F.explode(F.arrays_zip("rare", "times")).alias("x")
    met = (
        rows.select("row", zipped).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        .join(counts.filter(F.col("n") <= least), "word")
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    )
    done = rows.drop("rare", "times").join(met, "row", "left")
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    whole = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more_known).alias("n_known"),
        F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("known") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("classes") + F.col("others") + more).alias("score"),
    )
