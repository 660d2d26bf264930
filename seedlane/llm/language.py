"""Language identification with Bloom filters whose every slot is a bitmask of languages.

N-grams of four bytes are counted per language over all training texts. Those that a language uses
often enough enter its filter. The filters of all languages share their hash functions and are stored
side by side: slot ``s`` holds a bit per language, so the AND of an n-gram's slots names all languages
that contain it, in a few lookups however many languages there are. A text's n-grams give a count per
language, from which the expected false positives of its filter are taken off; the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import byte_array, raw_text
from seedlane.plans.layout import settled

GRAM = 4
# A language's filter holds n-grams that make up at least one in so many of its n-grams: so many at most.
RARITY = 100_000
# ... and at least this share of what the language that uses it most has; less is taken for stray text.
LEAST_SHARE = 0.05
SLOTS_LOG2 = 21
# Odd multipliers, one for each hash function.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# Bytes handled at once.
CHUNK = 1 << 20
UNKNOWN = "und"

# Letters of ASCII in lower case; bytes of other characters stay; all else is one blank.
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x80:] = np.arange(0x80, 0x100)
FOLDED[0x61:0x7B] = FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x61:0x7B] = IS_LETTER[0x41:0x5B] = True


def padded(text: str) -> F.Column:
    """The text between blanks, so that every text has n-grams."""
    return F.concat(F.lit(b" "), raw_text(text), F.lit(b"   "))


def grams(data: np.ndarray) -> np.ndarray:
    """The n-gram that begins at each byte but the last three."""
    folded = FOLDED[data].astype(np.uint32)
    out = folded[:len(folded) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out |= folded[k:len(folded) - GRAM + 1 + k] << np.uint32(8 * k)
    return out


def chunks(ends: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Runs of n-grams that lie in one text each: ``(first byte, past the last, first text, ends)``.

    ``ends`` are the places where each text of the run begins and ends, from the run's first byte. Long
    texts are spread over several runs.
    """
    start, total = 0, int(ends[-1])
    while start < total:
        stop = min(start + CHUNK, total)
        first = int(np.searchsorted(ends, start, "right")) - 1
        last = int(np.searchsorted(ends, stop, "left"))
        yield start, stop, first, np.clip(ends[first:last + 1], start, stop) - start
        start = stop


def slots(codes: np.ndarray) -> list[np.ndarray]:
    wide = codes.astype(np.uint64)
    return [((wide * np.uint64(h)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64) for h in HASHES]


class LanguageFilters(NamedTuple):
    """The trained filters: ``masks[word][slot]`` has the bits of up to 64 languages."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: int

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text that each language contains, and of each text at all."""
        texts, n = len(ends) - 1, len(self.languages)
        found, total = np.zeros((texts, n), np.int64), np.maximum(np.diff(ends) - GRAM + 1, 0)
        for start, stop, first, at in chunks(ends):
            piece = data[start:min(stop + GRAM - 1, len(data))]
            codes = grams(piece)
            # N-grams that run over the end of their text do not count.
            valid = np.ones(len(codes), bool)
            for k in range(1, GRAM):
                over = ends[first + 1:first + len(at)] - k - start
                valid[over[(over >= 0) & (over < len(codes))]] = False
            places = slots(codes)
            edges = np.minimum(at, len(codes))
            for word, masks in enumerate(self.masks):
                held = reduce(np.bitwise_and, [masks[p] for p in places])
                held[~valid] = 0
                for bit in range(min(64, n - 64 * word)):
                    running = np.zeros(len(codes) + 1, np.int64)
                    np.cumsum((held >> np.uint64(bit)) & np.uint64(1), out=running[1:], dtype=np.int64)
                    found[first:first + len(at) - 1, 64 * word + bit] += np.diff(running[edges])
        return found, total

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and a score for each text."""
        found, total = self.counts(data, ends)
        chance = total[:, None] * self.false_rate
        real = np.maximum((found - chance) / (1 - self.false_rate), 0)
        best = real.argmax(axis=1)
        top, sums = real[np.arange(len(real)), best], real.sum(axis=1)
        best[top <= 0] = self.fallback
        return best, np.divide(top, sums, out=np.zeros(len(top)), where=sums > 0)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all texts that have a language."""
    kept = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), padded(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = byte_array(batch.column(1))
            names = batch.column(0).dictionary_encode()
            of_text = names.indices.to_numpy()
            for start, stop, first, at in chunks(ends):
                codes = grams(data[start:min(stop + GRAM - 1, len(data))])
                owner = np.repeat(of_text[first:first + len(at) - 1], np.diff(at))[:len(codes)]
                for k in range(1, GRAM):
                    over = ends[first + 1:first + len(at)] - k - start
                    owner[over[(over >= 0) & (over < len(codes))]] = -1
                for number, name in enumerate(names.dictionary.to_pylist()):
                    own = np.sort(codes[owner == number])
                    if len(own):
                        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        size = np.diff(np.r_[heads, len(own)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(heads), pa.string()), pa.array(own[heads].astype(np.int64)),
                             pa.array(size.astype(np.int64))], ["lang", "gram", "n"])

    return kept.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageFilters:
    """Filters from all texts with a language.

    To the driver come only a row per language and the slots of the filters: their number is fixed.
    """
    counted = settled(gram_counts(docs, text, lang))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, 1 << SLOTS_LOG2), np.uint64)
    if not languages:
        return LanguageFilters([], masks, np.zeros(0), 0)
    numbers = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    sizes = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(float(totals[name])))])
    shares = counted.select("gram", numbers[F.col("lang")].alias("number"), (F.col("n") / sizes[F.col("lang")]).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").filter(
        (F.col("share") >= 1 / RARITY) & (F.col("share") >= LEAST_SHARE * F.col("most"))
    ).select("gram", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(1).to_numpy()
            bit = np.left_shift(np.int64(1), number % 64)
            for place in slots(batch.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number // 64, pa.int32()), pa.array(place.astype(np.int32)), pa.array(bit)],
                    ["word", "slot", "mask"])

    filled = kept.mapInArrow(run, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    rows = filled.toArrow()
    word, slot = rows["word"].to_numpy(), rows["slot"].to_numpy()
    masks[word, slot] = rows["mask"].to_numpy().view(np.uint64)
    full = np.array([
        np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) / (1 << SLOTS_LOG2) for i in range(len(languages))
    ])
    fallback = max(range(len(languages)), key=lambda i: (totals[languages[i]], -i))
    return LanguageFilters(languages, masks, full ** len(HASHES), fallback)


def predict_language(
    docs: DataFrame, filters: LanguageFilters, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every whole text, one row per row.

    The score is the language's share of the corrected counts. A null text and one without any letter
    is ``und`` with score 0, as is every text if no language was learned. A text of letters whose n-grams
    no language has gets the language with most training text, and score 0. Ties go to the language
    that comes first in the alphabet.
    """
    kept = docs.select(F.col(id).alias("doc_id"), padded(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = np.array([*filters.languages, UNKNOWN], object)
        for batch in batches:
            data, ends = byte_array(batch.column(1))
            running = np.zeros(len(data) + 1, np.int32)
            np.cumsum(IS_LETTER[data], out=running[1:])
            letters = np.diff(running[ends]) > 0
            for k in np.flatnonzero(~letters):
                text = data[ends[k]:ends[k + 1]].tobytes().decode(errors="replace")
                letters[k] = any(map(str.isalpha, text))
            if filters.languages:
                best, score = filters.predict(data, ends)
            else:
                best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
                letters[:] = False
            best[~letters], score[~letters] = len(filters.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
