"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled texts. Texts are TF-IDF vectors over all their words and beginnings of
words that any example has; document frequencies are those of the whole corpus. A term's inverse document frequency
is multiplied by a factor that rises with how surely the term depends on the label; no term is left out.

The nearest examples by cosine are exact and found with a block-max inverted index: examples are ordered so
that like ones follow each other and cut into blocks, and every frequent term has its largest weight in each block. The short
lists of the other terms are added up first; a block is only completed, for those of many texts at once whose
bound there reaches the last of their nearest examples so far. The neighbours vote with weights that fall with
distance; an isotonic curve over left-out examples turns votes into probabilities.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import as_frame_stream, byte_array, raw_text
from seedlane.llm.labelled import labelled_sample

# Labelled texts that are examples.
SAMPLE = 20_000
NEIGHBOURS = 15
THRESHOLD = 0.3
# Length in bytes of the beginnings of words that are terms.
HEAD = 5
# Examples of a block; terms that one example in so many has are kept by block; texts searched together.
BLOCK, COMMON, TOGETHER = 64, 20, 256
# Blocks whose products are computed at once.
JOINED = 16
# Counts from 0 on whose weights are kept in a table.
LOGS = 256
# Postings that are added up at once.
POSTINGS = 1 << 20
# Bytes of texts whose words are looked up at once, beyond which another text does not begin.
LOOKED_UP = 1 << 21
# What sums in single precision may be off.
SLACK = 1e-5
# By how much more a term weighs that is certain for the rarer label than one that tells nothing, and deviations
# from chance that still tell nothing.
GAIN, CHANCE = 4.0, 2.0
# Texts whose result a task remembers by their hashes.
MEMORY = 100_000

_SPACES = bytes(32 if i < 0x80 and not chr(i).isalnum() else i for i in range(256))

Counts = tuple[np.ndarray, np.ndarray]


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes of other characters, A-Z in lower case."""
    return text.lower().translate(_SPACES).split()


def joined_lines(words: pa.Array) -> bytes:
    """Words, which have no line ends, as lines; the same as what ``split_lines`` takes apart, but much faster than a list."""
    if not len(words):
        return b""
    every = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(every, pa.scalar(b"\n", words.type))[0].as_buffer().to_pybytes()


def split_lines(lines: bytes) -> list[bytes]:
    return lines.split(b"\n") if lines else []


def words_of_each(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The row and the place among the different words of every word of ``texts``, and these words."""
    data, ends = byte_array(texts)
    text = data.tobytes().lower().translate(_SPACES)
    # Only ASCII is looked at, so the bytes need not be valid UTF-8.
    split = pc.ascii_split_whitespace(
        pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(text)]))
    flat = split.flatten()
    kept = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())[kept]
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy()[kept], split_lines(joined_lines(coded.dictionary.view(pa.large_binary())))


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts whose bytes are few but for the last text of each."""
    _, ends = byte_array(texts)
    cuts = [0, *(np.flatnonzero(np.diff(ends[:-1] // LOOKED_UP)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def terms_of(words: Iterable[bytes]) -> set[bytes]:
    """The words and, each with a mark, their beginnings."""
    found = set(words)
    return found.union(b"^" + w[:HEAD] for w in found if len(w) > HEAD)


class BlockMaxIndex:
    """Exact nearest examples by cosine.

    Example ``i`` has the terms, in order, and counts from ``starts[i]`` on; ``weight`` has a number for each term.
    Only these are pickled, compressed; the lists are built at the first search, hence not on the driver.
    """

    def __init__(
        self, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray
    ) -> None:
        self.ids, self.labels, self.starts, self.terms, self.counts, self.weight = ids, labels, starts, terms, counts, weight
        self.order: np.ndarray | None = None

    def __reduce__(self):
        steps = np.diff(self.terms, prepend=np.int32(0)).astype(np.int32, copy=False)
        parts = self.ids, self.labels, self.starts, steps, self.counts.astype(np.min_scalar_type(self.counts.max(initial=0))), self.weight
        return _unpacked, tuple((a.dtype.str, zlib.compress(np.ascontiguousarray(a), 1)) for a in parts)

    def built(self) -> BlockMaxIndex:
        """Itself, with its lists."""
        if self.order is None:
            self._build()
        return self

    def _build(self) -> None:
        n, size = len(self.ids), np.bincount(self.terms, minlength=len(self.weight))
        who = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        own = self._weights(slice(None))
        self.length = np.maximum(np.sqrt(np.bincount(who, own**2, minlength=n)), 1e-300)
        own /= self.length[who]
        own = own.astype(np.float32)
        # Their number is at most COMMON times the terms of an example.
        common = np.flatnonzero((size > 0) & (size * COMMON >= n))
        self.column = np.full(len(self.weight), -1, np.int32)
        self.column[common] = np.arange(len(common))
        column = self.column[self.terms]
        kept, rare = np.flatnonzero(column >= 0).astype(np.int32), np.flatnonzero(column < 0).astype(np.int32)
        column = column[kept]
        rows = np.zeros((-(-n // BLOCK) * BLOCK, len(common)), np.float32)
        rows[who[kept], column] = own[kept]
        self.order = self._like_together(rows[:n])
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        rows[:] = 0
        rows[place[who[kept]], column] = own[kept]
        self.matrix = rows.reshape(len(rows) // BLOCK, BLOCK, len(common))
        self.block_max = self.matrix.max(axis=1)
        del kept, column
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.posts = np.empty(len(rare), [("place", np.int32), ("weight", np.float32)])
        self.posts["place"], self.posts["weight"] = place[who[rare]], own[rare]
        self.post_start = np.searchsorted(self.terms[rare], np.arange(len(self.weight) + 1))
        self._asked, self._is_asked = np.zeros(len(self.weight), np.int32), np.zeros(len(self.weight), bool)
        self.logs = 1 + np.log(np.maximum(np.arange(LOGS), 1))

    def _weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Weights of some of the examples' terms, not yet of length one."""
        return (1 + np.log(self.counts[at].astype(float))) * self.weight[self.terms[at]]

    @staticmethod
    def _like_together(rows: np.ndarray) -> np.ndarray:
        """Examples next to those that are nearest to the same of some, which follow each other by likeness."""
        n = len(rows)
        seeds = rows[np.unique(np.linspace(0, n - 1, 64).astype(int))] if n else rows
        like, chain = seeds @ seeds.T, list(range(min(1, n)))
        while len(chain) < len(seeds):
            left = np.setdiff1d(np.arange(len(seeds)), chain)
            chain.append(int(left[like[chain[-1], left].argmax()]))
        near = [(rows[i:i + 512] @ seeds[chain].T).argmax(1) for i in range(0, n, 512)]
        return np.argsort(np.concatenate([np.zeros(0, np.int64), *near]), kind="stable")

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of different terms, of length one."""
        weights = (1 + np.log(counts)) * self.weight[terms]
        return weights / max(np.sqrt((weights**2).sum()), 1e-300)

    def nearest_each(
        self, texts: list[Counts], k: int, but: list[int | None] | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of the nearest examples that share a term, nearest first, ties by number.

        For each of ``texts``, given by terms and counts; ``but`` has an id for each whose examples are left out.
        """
        self.built()
        vectors = [self.vector(*t) for t in texts]
        asked = np.zeros((len(texts), self.matrix.shape[2]), np.float32)
        for row, ((terms, _), weights) in enumerate(zip(texts, vectors)):
            column = self.column[terms]
            asked[row, column[column >= 0]] = weights[column >= 0]
        # Texts that ask for the same blocks are searched together.
        bound = asked @ self.block_max.T
        by = np.argsort(bound.argmax(axis=1), kind="stable") if bound.size else np.arange(len(texts))
        found: list = [None] * len(texts)
        for start in range(0, len(texts), TOGETHER):
            rows = by[start:start + TOGETHER]
            every = self._nearest(
                [(texts[i][0], vectors[i]) for i in rows], asked[rows], bound[rows], k, [but[i] for i in rows] if but else [])
            for i, one in zip(rows, every):
                found[i] = one
        yield from found

    def _nearest(
        self, texts: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, bound: np.ndarray, k: int, but: list[int | None]
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples for each of ``texts``, given by terms and weights, by columns and by bounds of these."""
        blocks = len(self.matrix)
        sums = np.zeros((len(texts), blocks, BLOCK), np.float32)
        for row, (terms, weights) in enumerate(texts):
            self._add_lists(sums[row].reshape(-1), terms, weights)
        bound = bound + sums.max(axis=2)
        for row, id in enumerate(but):
            if id is not None:
                sums[row].reshape(-1)[np.flatnonzero(self.ids[self.order] == id)] = -10
        best_first = -np.sort(-bound, axis=1)
        done, least = np.zeros(bound.shape, bool), np.zeros(len(texts), np.float32)
        # The most promising blocks tell which of the others can be skipped.
        for ahead, joined in ((4, 1), (blocks, JOINED)):
            need = ~done & (bound > 0) & (bound >= least[:, None] - SLACK)
            if ahead < blocks:
                need &= bound >= best_first[:, ahead - 1:ahead]
            for first in range(0, blocks, joined):
                here = need[:, first:first + joined]
                rows = np.flatnonzero(here.any(axis=1))
                if len(rows):
                    part = self.matrix[first:first + joined]
                    product = part.reshape(len(part) * BLOCK, part.shape[2]) @ asked[rows].T
                    sums[rows, first:first + joined] += product.T.reshape(len(rows), -1, BLOCK) * here[rows, :, None]
            done |= need
            for row in np.flatnonzero(need.any(axis=1)):
                known = sums[row][done[row]]
                known = known[known >= least[row]]
                if len(known) >= k:
                    least[row] = np.partition(known, -k)[-k]
        for row, (terms, weights) in enumerate(texts):
            whole = np.flatnonzero(done[row])
            known = sums[row, whole].reshape(-1)
            at = np.flatnonzero(known >= least[row] - SLACK)
            at = at[known[at] > 0]
            near = np.sort(self.order[whole[at // BLOCK] * BLOCK + at % BLOCK])
            score = self._cosines(near, terms, weights)
            top = np.lexsort((near, -score))[:k]
            yield near[top], score[top]

    def _add_lists(self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Adds the products of a text's infrequent terms, by place."""
        start, size = self.post_start[terms], self.post_start[terms + 1] - self.post_start[terms]
        listed = np.flatnonzero(size)
        start, size, weights = start[listed], size[listed], weights[listed].astype(np.float32)
        before = np.cumsum(size) - size
        for cut in np.split(np.arange(len(listed)), np.flatnonzero(np.diff(before // POSTINGS)) + 1):
            if len(cut):
                at = np.repeat(start[cut] - before[cut], size[cut])
                at += np.arange(before[cut[0]], before[cut[0]] + len(at))
                found = self.posts.view(np.int64).take(at).view(self.posts.dtype)
                product = found["weight"] * np.repeat(weights[cut], size[cut])
                sums += np.bincount(found["place"], product, minlength=len(sums))

    def _cosines(self, numbers: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines with some examples in double precision, rounded so that equal vectors tie."""
        if not len(numbers):
            return np.zeros(0)
        self._asked[terms], self._is_asked[terms] = np.arange(len(terms)), True
        start, size = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        before = np.cumsum(size) - size
        every = np.concatenate([self.terms[a:a + n] for a, n in zip(start.tolist(), size.tolist())])
        # A tenth of them or less is shared, so a small table tells which.
        shared = np.flatnonzero(self._is_asked[every])
        asked = self._asked[every[shared]]
        self._is_asked[terms] = False
        ends = np.searchsorted(shared, np.r_[before[1:], before[-1] + size[-1]])
        row = np.repeat(np.arange(len(numbers)), np.diff(ends, prepend=0))
        # The weights as in ``_weights``; the text has all of these terms.
        count = self.counts.take(shared + (start - before)[row])
        own = self.weight[terms].take(asked) * self.logs.take(np.minimum(count, len(self.logs) - 1))
        high = np.flatnonzero(count >= len(self.logs))
        own[high] = self._weights((shared + (start - before)[row])[high])
        product = weights.take(asked) * (own / self.length[numbers][row])
        return np.round(np.bincount(row, product, minlength=len(numbers)), 12)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of one text."""
        return next(self.nearest_each([(terms, counts)], k, [but]))


def _unpacked(*parts: tuple[str, bytes]) -> BlockMaxIndex:
    ids, labels, starts, steps, counts, weight = (np.frombuffer(zlib.decompress(b), kind) for kind, b in parts)
    return BlockMaxIndex(ids, labels, starts, np.cumsum(steps, dtype=np.int32), counts, weight)


class Numbers:
    """Numbers of terms from 0 on, in the order given.

    Held and pickled as compressed text, as terms have no line ends; terms and tables are only unpacked at the first
    look, hence not on the driver.
    """

    def __init__(self, packed: bytes, size: int) -> None:
        self.packed, self.size = packed, size
        self.found: tuple[dict[bytes, int], dict[bytes, int]] | None = None
        self.terms: pa.Array | None = None

    @classmethod
    def of(cls, terms: pa.Array) -> Numbers:
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), b"\n")[0]
        return cls(zlib.compress(text.as_buffer(), 1), len(terms))

    def __len__(self) -> int:
        return self.size

    def tables(self) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """The numbers of terms, and those of beginnings without their mark."""
        if self.found is None:
            numbers = {t: i for i, t in enumerate(zlib.decompress(self.packed).split(b"\n"))} if self.size else {}
            self.found = numbers, {t[1:]: i for t, i in numbers.items() if t[:1] == b"^"}
        return self.found

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words and of their beginnings, -1 without."""
        if self.terms is None:
            self._unpack()
        asked, heads = pa.array(words, pa.large_binary()), np.full(len(words), -1)
        long = np.flatnonzero(pc.binary_length(asked).to_numpy(zero_copy_only=False) > HEAD)
        # Many words have the same beginning.
        coded = pc.binary_slice(asked.take(pa.array(long)), 0, HEAD).dictionary_encode()
        different = [b"^" + h for h in split_lines(joined_lines(coded.dictionary))]
        heads[long] = self._look_up(different, pa.array(different, pa.large_binary()))[coded.indices.to_numpy()]
        return self._look_up(words, asked), heads

    def _unpack(self) -> None:
        """The terms, and their numbers by hash."""
        found = zlib.decompress(self.packed).split(b"\n") if self.size else []
        self.terms = pa.array(found, pa.large_binary())
        hashes = np.fromiter(map(hash, found), np.int64, self.size)
        self.by_hash = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.by_hash]

    def _look_up(self, words: list[bytes], asked: pa.Array) -> np.ndarray:
        """The number of each word, -1 without: that of the equal one among the terms of its hash."""
        out = np.full(len(words), -1)
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        # In the order of the hashes, so that neighbours are looked up after each other.
        left = np.argsort(hashes)
        at = np.empty(len(words), np.int64)
        at[left] = np.searchsorted(self.hashes, hashes[left])
        while len(left := left[at[left] < self.size]) and len(left := left[self.hashes[at[left]] == hashes[left]]):
            number = self.by_hash[at[left]]
            equal = pc.equal(self.terms.take(pa.array(number)), asked.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[equal]] = number[equal]
            left = left[~equal]
            at[left] += 1
        return out

    def __reduce__(self):
        return Numbers, (self.packed, self.size)


class ToxicityModel(NamedTuple):
    """A fitted model: the terms' numbers, in how many examples they are, the index, the calibration curve and the rate without evidence."""

    numbers: Numbers
    examples: np.ndarray
    index: BlockMaxIndex | None
    votes: np.ndarray
    rates: np.ndarray
    no_evidence: float

    def counted(self, texts: list[bytes]) -> list[Counts]:
        """Numbers and counts of the terms of each text that any example has, in order."""
        ends, terms, counts = self.counted_flat(pa.array(texts, pa.large_binary()))
        return [(terms[a:b], counts[a:b]) for a, b in zip(ends, ends[1:])]

    def counted_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same one after the other, and where each text begins, then the last one's end."""
        found = [self._counted_part(part) for part in parts_of(texts)]
        none = np.zeros(0, np.int64)
        size, terms, counts = map(np.concatenate, zip((none, none, none), *found))
        return np.r_[0, np.cumsum(size)], terms, counts

    def _counted_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, word, words = words_of_each(texts)
        own, head = self.numbers.of_words(words)
        # A word is no beginning, so within a text its number comes up as often as it does.
        key = np.concatenate([row[n >= 0] * len(self.numbers) + n[n >= 0] for n in (own[word], head[word])])
        key, counts = np.unique(key, return_counts=True)
        row, terms = np.divmod(key, max(1, len(self.numbers)))
        return np.bincount(row, minlength=len(texts)), terms, counts

    def votes_of(
        self, texts: list[Counts], but: list[int | None] | None = None
    ) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """The neighbours' weighted share of label 1, or None without neighbours, and these, for each of ``texts``."""
        if self.index is None:
            yield from ((None, np.zeros(0, np.int64), np.zeros(0)) for _ in texts)
            return
        for best, score in self.index.nearest_each(texts, NEIGHBOURS, but):
            weight = 1 / (1.05 - score)
            yield float((weight * self.index.labels[best]).sum() / weight.sum()) if len(best) else None, best, score

    def probability(self, vote: float | None) -> float:
        return self.no_evidence if vote is None else float(np.interp(vote, self.votes, self.rates))

    def judged(self, texts: list[bytes], seen: dict) -> list[tuple[float, list[dict]]]:
        """Probability and the three nearest examples of each text; ``seen`` remembers those of equal texts."""
        if len(seen) >= MEMORY:
            seen.clear()
        keys = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts) if k not in seen}
        for key, (vote, best, cosine) in zip(new, self.votes_of(self.counted(list(new.values())))):
            near = [{"doc_id": int(self.index.ids[b]), "cosine": float(c), "label": int(self.index.labels[b])}
                    for b, c in zip(best[:3], cosine[:3])]
            seen[key] = self.probability(vote), near
        return [seen[k] for k in keys]


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising curve through the labels by vote, as points to interpolate."""
    blocks: list[list[float]] = []
    for value in np.unique(votes):
        own = labels[votes == value]
        blocks.append([float(own.sum()), len(own), value, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    x = [v for b in blocks for v in (b[2], b[3])]
    y = [(b[0] + 0.1) / (b[1] + 0.2) for b in blocks for _ in (0, 1)]
    return np.array(x or [0.0]), np.maximum.accumulate(np.array(y or [0.0]))


def term_weights(idf: np.ndarray, n: np.ndarray, toxic: np.ndarray, examples: int, all_toxic: int) -> np.ndarray:
    """``idf`` times a factor that is 1 for terms that do not depend on the label.

    ``n`` and ``toxic`` say in how many examples, and in how many toxic ones, a term is. What counts is by how
    many standard deviations beyond ``CHANCE`` the latter is off, squared and per example, as a share of what it is for a
    term that only the rarer label has, so that it does not depend on how rare that is; terms of fewer than
    three examples tell nothing.
    """
    rate = all_toxic / max(1, examples)
    if not 0 < rate < 1:
        return idf
    deviation = np.abs(toxic - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    certain = max(rate, 1 - rate) / min(rate, 1 - rate)
    return idf * (1 + GAIN / certain * np.where(n >= 3, np.maximum(0, deviation - CHANCE) ** 2 / np.maximum(n, 1), 0))


def _term_table(sample: DataFrame) -> pa.Table:
    """``(term, n, toxic)``: every term of the examples, and in how many of them and of the toxic ones it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(words_of(text))
                every.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(every), pa.binary()), pa.array(list(every.values()), pa.int64()),
                 pa.array([toxic[t] for t in every], pa.int64())], ["term", "n", "toxic"])

    return (
        sample.select(raw_text().alias("text"), "label").mapInArrow(run, "term binary, n long, toxic long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow().sort_by("term")
    )


def _document_frequency(docs: DataFrame, shared: Broadcast, size: int, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each of ``size`` terms of the model is, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, np.zeros(size + 1, np.int64)
        for batch in batches:
            counts[size] += batch.num_rows
            for part in parts_of(batch.column(0)):
                counts[:size] += np.bincount(model.counted_flat(part)[1], minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], ["term", "n"])

    counted = (
        docs.select(raw_text(text).alias("text")).mapInArrow(run, "term long, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    frequency = np.zeros(size + 1)
    frequency[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return frequency[:size], int(frequency[size])


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: F.Column | None = None,
    id: str = "doc_id", text: str = "text", rows: int = SAMPLE,
) -> ToxicityModel:
    """A model of at most ``rows`` labelled texts among the ``usable`` ids.

    What the driver and each task hold are these texts' vectors. Without labelled texts every score is 0; a null
    label, id or text, repeated rows and other columns are as in ``labelled_sample``. An empty table gives such a model.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, rows, id, text)
    found = _term_table(sample)
    n, toxic = found["n"].to_numpy().astype(float), found["toxic"].to_numpy().astype(float)
    numbers = Numbers.of(found["term"].combine_chunks())
    bare = ToxicityModel(numbers, n.astype(np.int32), None, np.zeros(1), np.zeros(1), 0.0)
    del found
    shared = spark.sparkContext.broadcast(bare)
    frequency, total = _document_frequency(docs, shared, len(numbers), text)
    source = sample.select("doc_id", "label", raw_text().alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in as_frame_stream(batches, 1000):
            ends, *found = shared.value.counted_flat(batch.column(2))
            terms, counts = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a, pa.int32())) for a in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, counts], ["doc_id", "label", "terms", "counts"])

    held = source.mapInArrow(vectors, "doc_id long, label int, terms array<int>, counts array<int>").toArrow()
    held = held.sort_by([("doc_id", "ascending")]).combine_chunks()
    if not held.num_rows:
        return bare
    y = held["label"].to_numpy().astype(np.int8)
    flat = [held[c].combine_chunks() for c in ("terms", "counts")]
    terms, counts = (a.flatten().to_numpy(zero_copy_only=False) for a in flat)
    starts = np.r_[0, np.cumsum(flat[0].value_lengths().to_numpy())]
    weight = term_weights(np.log((1 + total) / (1 + frequency)) + 0.01, n, toxic, len(y), int(y.sum()))
    index = BlockMaxIndex(held["doc_id"].to_numpy(), y, starts, terms, counts, weight)
    model = bare._replace(index=index, no_evidence=float(y.mean()))
    tuned = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tuned.value
        for batch in as_frame_stream(batches, 1000):
            texts = model.counted(batch.column(2).to_pylist())
            # What no other example has would be unknown without this one.
            texts = [(t[shared], c[shared]) for t, c in texts for shared in [model.examples[t] > 1]]
            votes = [v for v, _, _ in model.votes_of(texts, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(1)], ["vote", "label"])

    votes = source.mapInArrow(left_out, "vote double, label int").filter("vote IS NOT NULL").toArrow()
    # What the driver keeps of these would stay beside the broadcast of the whole model.
    shared.unpersist()
    tuned.unpersist()
    x, rates = isotonic(votes["vote"].to_numpy(), votes["label"].to_numpy())
    return model._replace(votes=x, rates=rates)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` for every whole text; ``evidence`` are its three nearest examples.

    A text that shares no term with any example, null and empty ones among them, has no evidence and scores the
    examples' share of label 1. Without any examples every score is 0. Null ids and repeated rows are scored like
    others; other columns are ignored; an empty table gives no rows.
    """
    kept = docs.select(F.col(id).alias("doc_id"), raw_text(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in as_frame_stream(batches, 1000):
            found = shared.value.judged(batch.column(1).to_pylist(), seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                 pa.array([e for _, e in found], evidence_type)], ["doc_id", "score", "predicted", "evidence"])

    return kept.mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, label: int>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below ``threshold``, columns and repeated rows as they are.

    Null and empty texts score as in ``score_toxicity``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in as_frame_stream(batches, 1000):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([s < threshold for s, _ in shared.value.judged(texts, seen)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
