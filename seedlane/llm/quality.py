"""Quality scores from random-indexing word vectors and a small network.

Random indexing: every token has a sparse random index vector, and a token's context vector is the sum of
the index vectors around it, over the whole corpus. Tokens are hashed to a fixed number of rows, so no
vocabulary has to be counted, kept or broadcast. A second set of rows is for the tokens' shapes (runs of
lower-case letters, of capitals, of digits, and other characters as they are), which rare words share.
A document is the mean of its tokens' and of their shapes' unit context vectors, with their lengths, the share of distinct tokens and that
of tokens whose index vector is their neighbour's. A network of two layers,
trained with numpy on a bounded sample of labelled texts, scores it; a temperature fitted on texts that the
training did not see makes its output a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import as_frame_stream, raw_text
from seedlane.llm.labelled import labelled_sample

WORDS, SHAPES = 4096, 512
DIMENSIONS, NONZERO = 32, 4
REACH = 2
FEATURES = 2 * DIMENSIONS + 5
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
THRESHOLD = 0.5
# Tokens handled at once.
CHUNK = 500_000

_CLASSES = bytes(
    ord("a") if 0x61 <= i < 0x7B or i >= 0x80 else ord("A") if 0x41 <= i < 0x5B else ord("0") if 0x30 <= i < 0x3A else i
    for i in range(256)
)


class Shapes(dict):
    """Row of a token's shape, by the classes of its bytes: runs longer than three count as three."""

    def __missing__(self, classes: bytes) -> int:
        shape = b"".join(bytes([c]) * min(3, len(list(run))) for c, run in groupby(classes))
        row = zlib.crc32(shape) % SHAPES
        if len(self) < 100_000:
            self[classes] = row
        return row


def token_rows(text: bytes, shapes: Shapes) -> tuple[list[int], list[int]]:
    """Rows of the tokens and of their shapes."""
    words = [zlib.crc32(w) % WORDS for w in text.lower().split()]
    return words, [shapes[c] for c in text.translate(_CLASSES).split()]


def index_vectors(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's few nonzero components."""
    random = np.random.default_rng(seed)
    places = np.argsort(random.random((rows, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, random.choice([-1.0, 1.0], size=(rows, NONZERO))


def token_runs(batches: Iterator[pa.RecordBatch], column: int, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of several whole texts at a time: rows, shapes' rows, and the tokens of each text."""
    shapes = Shapes()
    words, forms, counts = [], [], []
    for batch in batches:
        for text in batch.column(column):
            w, s = token_rows(text.as_py(), shapes)
            words += w
            forms += s
            counts.append(len(w))
            if len(words) >= size:
                yield np.array(words, np.int64), np.array(forms, np.int64), np.array(counts)
                words, forms, counts = [], [], []
    if counts:
        yield np.array(words, np.int64), np.array(forms, np.int64), np.array(counts)


def context_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors of the rows for tokens and for shapes, from all texts.

    Tasks add up their own; what is summed over tasks and comes to the driver is of fixed size.
    """
    columns = [f"c{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((WORDS, DIMENSIONS)), np.zeros((SHAPES, DIMENSIONS))]
        vectors = [index_vectors(WORDS, 1), index_vectors(SHAPES, 2)]
        for words, forms, counts in token_runs(batches, 0):
            text_of = np.repeat(np.arange(len(counts)), counts)
            for total, (places, signs), rows in zip(sums, vectors, (words, forms)):
                for gap in range(1, REACH + 1):
                    near = text_of[gap:] == text_of[:-gap]
                    left, right = rows[:-gap][near], rows[gap:][near]
                    for here, there in ((left, right), (right, left)):
                        base = here * DIMENSIONS
                        for k in range(NONZERO):
                            total += np.bincount(
                                base + places[there, k], signs[there, k], minlength=total.size
                            ).reshape(total.shape)
        every = np.concatenate(sums)
        used = np.flatnonzero(every.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(every[used, i]) for i in range(DIMENSIONS))], ["row", *columns])

    shape = "row long, " + ", ".join(f"{c} double" for c in columns)
    summed = docs.select(raw_text(text).alias("text")).mapInArrow(run, shape).groupBy("row").agg(
        *[F.sum(c).alias(c) for c in columns]
    ).toArrow()
    every = np.zeros((WORDS + SHAPES, DIMENSIONS))
    every[summed["row"].to_numpy()] = np.stack([summed[c].to_numpy() for c in columns], axis=1)
    every /= np.maximum(np.linalg.norm(every, axis=1, keepdims=True), 1e-12)
    return every[:WORDS], every[WORDS:]


def pooled(words: np.ndarray, forms: np.ndarray, counts: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row for each text: mean vectors of its tokens and shapes, their lengths, how much repeats, and the logarithm
    of its tokens. The mean of a few tokens over and over is longer than that of many different ones.
    """
    ends = np.r_[0, np.cumsum(counts)]
    out = np.zeros((len(counts), FEATURES))
    for start in range(0, len(counts), 64):
        stop = min(start + 64, len(counts))
        own = slice(ends[start], ends[stop])
        text_of = np.repeat(np.arange(stop - start), counts[start:stop])
        parts, distinct = [], None
        for rows, table in ((words[own], vectors[0]), (forms[own], vectors[1])):
            seen = np.bincount(text_of * len(table) + rows, minlength=(stop - start) * len(table))
            seen = seen.reshape(stop - start, -1)
            parts.append(seen @ table)
            distinct = np.count_nonzero(seen, axis=1) if distinct is None else distinct
        again = (words[own][1:] == words[own][:-1]) & (text_of[1:] == text_of[:-1])
        repeats = np.bincount(text_of[1:][again], minlength=stop - start)
        n = np.maximum(counts[start:stop, None], 1)
        means = [p / n for p in parts]
        lengths = [np.linalg.norm(m, axis=1, keepdims=True) for m in means]
        out[start:stop] = np.hstack(
            [*means, *lengths, distinct[:, None] / n, repeats[:, None] / n, np.log1p(counts[start:stop, None])]
        )
    return out


class QualityModel(NamedTuple):
    vectors: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    bias: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        first, first_bias, second, second_bias = self.layers
        return np.tanh((features - self.mean) / self.scale @ first + first_bias) @ second + second_bias

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(features) / self.temperature + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_network(features: np.ndarray, labels: np.ndarray, seed: int = 3) -> tuple[np.ndarray, ...]:
    """Two layers by stochastic gradients with Adam's step sizes."""
    random = np.random.default_rng(seed)
    width = features.shape[1]
    layers = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            own = order[start:start + BATCH]
            x, y = features[own], labels[own]
            hidden = np.tanh(x @ layers[0] + layers[1])
            error = (_sigmoid(hidden @ layers[2] + layers[3]) - y) / len(own)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [x.T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum(keepdims=True)]
            step += 1
            for p, s, a, b in zip(layers, slopes, first, second):
                a += 0.1 * (s - a)
                b += 0.001 * (s * s - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Temperature and bias of least log loss, by Newton's method on the inverse temperature."""
    a, b = 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)])
    for _ in range(50):
        p = _sigmoid(a * logits + b)
        # A weak pull towards 1 and 0 keeps separable data finite.
        slope = x @ (p - labels) + np.array([a - 1, b])
        curve = (x * (p * (1 - p))) @ x.T + np.eye(2)
        change = np.linalg.solve(curve, slope)
        a, b = max(a - change[0], 1e-3), b - change[1]
        if np.abs(change).max() < 1e-9:
            break
    return 1 / a, float(b)


def train_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None,
    id: str = "doc_id", text: str = "text", rows: int = SAMPLE,
) -> QualityModel:
    """Word vectors from all texts, the network from at most ``rows`` labelled ones among the ``usable`` ids.

    A fifth of the sample is kept from the network and fits the temperature. With no labels at all every score
    is 0.5, with one kind only it is near that label.
    """
    vectors = context_vectors(docs, text)
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, rows, id, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_frame_stream(batches, 500):
            features = np.concatenate([pooled(*r, shared.value) for r in token_runs([batch], 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(features), pa.list_(pa.float64()))], ["doc_id", "label", "features"])

    held = sample.select("doc_id", "label", raw_text().alias("text")).mapInArrow(
        run, "doc_id long, label int, features array<double>").toArrow().sort_by("doc_id")
    labels_ = held["label"].to_numpy().astype(float)
    width = FEATURES
    features = held["features"].combine_chunks().flatten().to_numpy().reshape(-1, width) if len(labels_) else np.zeros((0, width))
    if not len(labels_):
        zero = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1))
        return QualityModel(vectors, np.zeros(width), np.ones(width), zero, 1.0, 0.0)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    aside = np.arange(len(labels_)) % 5 == 4
    if aside.all() or not aside.any():
        aside[:] = False
    layers = fit_network((features[~aside] - mean) / scale, labels_[~aside])
    model = QualityModel(vectors, mean, scale, layers, 1.0, 0.0)
    if aside.any():
        temperature, bias = fit_temperature(model.logits(features[aside]), labels_[aside])
        model = model._replace(temperature=temperature, bias=bias)
    return model


def _scores(batches: Iterator[pa.RecordBatch], at: int, model: QualityModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in as_frame_stream(batches, 1000):
        column = batch.column(at)
        if not pa.types.is_binary(column.type):
            column = column.cast(pa.string()).cast(pa.binary()).fill_null(b"")
        one = pa.RecordBatch.from_arrays([column], ["text"])
        yield batch, np.concatenate([model.probabilities(pooled(*r, model.vectors)) for r in token_runs([one], 0)])


def score_quality(
    docs: DataFrame, model: QualityModel, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, score, predicted)`` for every whole text, one row per row.

    A null or empty text has the zero vector as its mean and is scored like any other. Null ids and repeated
    rows are scored too; other columns are ignored.
    """
    kept = docs.select(F.col(id).alias("doc_id"), raw_text(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scores(batches, 1, shared.value):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return kept.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def drop_low_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scores(batches, at, shared.value):
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
