"""Phrases whose words go together, counted by prefix-free parsing.

Pieces of text are cut into chunks: if they are long, a word of a certain hash begins a new one (content-triggered, so
the same passage is cut alike wherever it stands). Chunks overlap: each runs on into the next by one word less than
the longest phrase has. The distinct chunks with their numbers of occurrences are the dictionary; what repeats
in the corpus is in it once. Phrases are counted inside distinct chunks, weighted by these numbers. A
phrase belongs to the chunk in whose own part it begins, so those in overlaps count once.

Counting goes by length. A phrase that is frequent enough has only frequent words and pairs of words,
so a bitmap of these turns away most others where they are read; what it lets through is counted
exactly. Tasks number words by themselves and add up what they hold, before rows are moved.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlane.llm.bitmap import bitmap_of, may_hold
from seedlane.llm.common import byte_array, raw_text
from seedlane.plans.layout import settled

# Words of a phrase; occurrences of a candidate; phrases reported of each language.
LONGEST, LEAST, TOP = 5, 100, 2000
# One word in so many begins a new chunk.
TRIGGER = 16
# A piece of so many words at most is one chunk.
SHORT = 16
# Bytes of chunks that a task holds before it hands on its sums.
HELD = 16 << 20
# Language of rows without one.
UNKNOWN = "und"

# Every byte that ends a piece becomes a line end, a tab a blank.
_PIECES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def pieces_of(text: bytes) -> list[bytes]:
    """The pieces of a text in lower case, their words parted by one blank; some may be empty."""
    text = text.lower().translate(_PIECES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def chunks_of(piece: bytes, overlap: int, trigger: int = TRIGGER) -> Iterator[tuple[bytes, int]]:
    """``(words, own words)`` of the chunks of a piece, own words 0 for a whole piece."""
    words = piece.split(b" ")
    starts = [0, *(i for i, w in enumerate(words) if i and zlib.crc32(w) % trigger == 0), len(words)]
    if len(starts) == 2:
        yield piece, 0
        return
    for a, b in zip(starts, starts[1:]):
        yield b" ".join(words[a:b + overlap]), b - a


def _rows(found: dict[str, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """Counted pieces and chunks of all languages in batches. Each word of a chunk is followed by a blank."""
    for lang, (whole, cut) in found.items():
        whole.pop(b"", None)
        for chunks, own, rows in (
            (list(whole), [0] * len(whole), list(whole.values())),
            ([c for c, _ in cut], [o for _, o in cut], list(cut.values())),
        ):
            for at in range(0, len(chunks), 20_000):
                part = chunks[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([c + b" " for c in part], pa.binary()),
                     pa.array(own[at:at + 20_000], pa.int32()), pa.array(rows[at:at + 20_000], pa.int64())],
                    ["lang", "chunk", "own", "rows"])


def parse(
    docs: DataFrame, text: str = "text", lang: str = "lang", overlap: int = LONGEST - 1, trigger: int = TRIGGER, short: int = SHORT
) -> DataFrame:
    """The dictionary ``(lang, chunk, own, rows)``: distinct chunks, their own words and how often they occur.

    A piece of at most ``short`` words is one chunk, all its own (``own`` 0), as is one without a trigger.
    """
    kept = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), raw_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for row, name in enumerate(batch.column(0).to_pylist()):
                whole, cut = found.setdefault(name, (Counter(), Counter()))
                body = batch.column(1)[row].as_py()
                pieces = pieces_of(body)
                long = [p for p in pieces if p.count(b" ") >= short]
                whole.update(pieces if not long else [p for p in pieces if p.count(b" ") < short])
                for piece in long:
                    cut.update(chunks_of(piece, overlap, trigger))
                held += len(body)
                if held > HELD:
                    yield from _rows(found)
                    found, held = {}, 0
        yield from _rows(found)

    parsed = kept.mapInArrow(run, "lang string, chunk binary, own int, rows long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("rows").alias("rows"))


def _hash_of(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(29)) | (b >> np.uint64(35)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' first places, sums of their weights, and the key number of every place."""
    _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    # Exact, as no sum here comes near 2 to the power of 53.
    return at, np.bincount(inverse, weights, len(at)).astype(np.int64), inverse


class Phrases:
    """Phrases in a batch of one language's chunks. A word's number is the place where it is first met."""

    def __init__(self, lang: str, parts: list[pa.RecordBatch]) -> None:
        bodies = [byte_array(p.column("chunk")) for p in parts]
        data = np.concatenate([b for b, _ in bodies])
        # Each word ends with a blank.
        blanks = np.concatenate([np.add.reduceat(b == 32, ends[:-1], dtype=np.int64) for b, ends in bodies])
        own = np.concatenate([p.column("own").to_numpy() for p in parts])
        rows = np.concatenate([p.column("rows").to_numpy() for p in parts])
        self.lang, self.words = lang, data.tobytes().split(b" ")[:-1]
        n = len(self.words)
        self.id = np.fromiter(map({}.setdefault, self.words, count()), np.int64, n)
        ends, place = np.cumsum(blanks), np.arange(n)
        self.left = np.repeat(ends, blanks) - place  # words to the chunk's end
        mine = np.where(own == 0, blanks, own)
        self.start = np.flatnonzero(place - np.repeat(ends - blanks, blanks) < np.repeat(mine, blanks))
        self.weight = np.repeat(rows, blanks)
        self.hash = np.zeros(n, np.uint64)
        first = np.flatnonzero(self.id == place)
        self.hash[first] = _hash_of(lang, [self.words[i] for i in first])
        self.hash = self.hash[self.id]

    def pair_hash(self, at: np.ndarray) -> np.ndarray:
        return _pair_hash(self.hash[at], self.hash[at + 1])

    def hashed_words(self) -> Iterator[tuple]:
        """The hashes of all words and their numbers."""
        at, sums, _ = _sums(self.id[self.start], self.weight[self.start])
        yield self.hash[self.start[at]].view(np.int64), sums

    def hashed_pairs(self, frequent: np.ndarray) -> Iterator[tuple]:
        """The hashes of all pairs of frequent words and their numbers."""
        good = may_hold(frequent, self.hash)
        start = self.start[self.left[self.start] >= 2]
        start = start[good[start] & good[start + 1]]
        hashes = self.pair_hash(start)
        at, sums, _ = _sums(hashes, self.weight[start])
        yield hashes[at].view(np.int64), sums

    def phrases(self, words: np.ndarray, pairs: np.ndarray | None, longest: int) -> Iterator[tuple]:
        """Phrases that have only frequent words and pairs, their numbers and sizes."""
        n = len(self.id)
        start, key = self.start[may_hold(words, self.hash[self.start])], self.id.copy()
        pair = np.zeros(n, bool)
        if pairs is not None:
            inside = np.flatnonzero(self.left >= 2)
            pair[inside] = may_hold(pairs, self.pair_hash(inside))
        for size in range(1, longest + 1):
            if size > 1:
                start = start[self.left[start] >= size]
                start = start[pair[start + size - 2]]
            # By the number of the phrase of one word less.
            at, sums, inverse = _sums(key[start] * n + self.id[start + size - 1] if size > 1 else key[start], self.weight[start])
            key[start] = inverse
            found = [b" ".join([self.words[i] for i in range(a, a + size)]) for a in start[at].tolist()]
            yield found, sums, np.full(len(at), size, np.int32)


def _counted(dictionary: DataFrame, find, schema: str) -> DataFrame:
    """What ``find`` gives for batches of chunks of one language, as rows of ``schema`` after the language."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                for columns in find(Phrases(lang, parts)):
                    for at in range(0, len(columns[0]), 20_000):
                        part = [c[at:at + 20_000] for c in columns]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), *[pa.array(c) for c in part]], names)

        for batch in batches:
            langs = pc.unique(batch.column(0)).to_pylist()
            for lang in langs:
                part = batch if len(langs) == 1 else batch.filter(pc.equal(batch.column(0), lang))
                held.setdefault(lang, []).append(part)
            size += len(byte_array(batch.column(1))[0])
            if size > HELD:
                yield from out()
                held, size = {}, 0
        yield from out()

    return dictionary.select("lang", "chunk", "own", "rows").mapInArrow(run, schema)


def phrase_counts(dictionary: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n, size)`` of all phrases that occur ``least`` times, and ``(lang, words)``, all words counted.

    ``dictionary`` as by :func:`parse`, with an overlap of at least ``longest - 1``. Phrases are bytes. Words and
    pairs are counted by hash first: two with one hash only let through more, which is counted by itself then.
    """
    context = dictionary.sparkSession.sparkContext

    def marked(found: DataFrame):
        return context.broadcast(bitmap_of(found.filter(F.col("n") >= least), "hash"))

    hashed = "lang string, hash long, n long"
    words = settled(
        _counted(dictionary, lambda p: p.hashed_words(), hashed).groupBy("lang", "hash").agg(F.sum("n").alias("n")))
    total = settled(words.groupBy("lang").agg(F.sum("n").alias("words")))
    word_bits, pair_bits = marked(words), None
    if longest > 1:
        pairs = _counted(dictionary, lambda p: p.hashed_pairs(word_bits.value), hashed).groupBy("hash").agg(F.sum("n").alias("n"))
        pair_bits = marked(settled(pairs.filter(F.col("n") >= least)))
    counted = _counted(
        dictionary, lambda p: p.phrases(word_bits.value, pair_bits.value if pair_bits else None, longest),
        "lang string, phrase binary, n long, size int",
    ).groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    return settled(counted.filter(F.col("n") >= least)), total


def score_phrases(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases of two words and more among ``counts``.

    Of the ways to cut a phrase in two the one of the lowest score counts, 1000 a n / (l r) rounded down, with ``a``, ``l``
    and ``r`` for how often the phrase and its parts occur among ``n`` words; of equal ones the first.
    Phrases that only occur inside one longer phrase are left out.
    """
    phrase = F.col("phrase")
    several = counts.filter("size > 1").withColumnRenamed("n", "a")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - F.lit(1)))).select(
        "lang", "phrase", "a", "k",
        # By bytes, also where a text is no valid UTF-8.
        F.expr("cast(substring_index(cast(phrase as string), ' ', k) as binary)").alias("head"),
        F.expr("cast(substring_index(cast(phrase as string), ' ', k - size) as binary)").alias("tail"),
    )
    heads = counts.select("lang", phrase.alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", phrase.alias("tail"), F.col("n").alias("r"))
    big = "decimal(18,0)"
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
        .withColumn("score", F.expr(f"(cast(a as {big}) * cast(words as {big}) * 1000) div (cast(l as {big}) * cast(r as {big}))"))
        .groupBy("lang", "phrase", "a", F.col("words").alias("n"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # A part occurs at least as often as the whole, and as often only if it occurs nowhere else.
    longer = counts.filter("size > 2")
    inside = longer.withColumn("part", F.explode(F.array(
        F.expr("substring_index(cast(phrase as string), ' ', size - 1)"),
        F.expr("substring_index(cast(phrase as string), ' ', 1 - size)"),
    ))).select("lang", F.col("part").cast("binary").alias("phrase"), F.col("n").alias("a")).distinct()
    return scored.join(inside, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language, highest score first.

    Letters A to Z count as small ones. Phrases do not go over punctuation marks or line ends; words are what stands
    between blanks and tabs. Ties go to the phrase that occurs more often, then to that of the smaller
    bytes. Null and empty texts have no words, a null language counts as ``und``; rows that repeat
    count each. Other columns are not read. An empty table gives no rows.
    """
    dictionary = settled(parse(docs, text, lang, longest - 1))
    scored = score_phrases(*phrase_counts(dictionary, least, longest))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), numbered AS (
  SELECT lang, row_number() OVER () AS piece, words FROM split
), placed AS (
  SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM numbered
), followed AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
  FROM placed WINDOW p AS (PARTITION BY piece ORDER BY pos)
), grams AS (
  SELECT lang, 1 AS size, w1 AS text FROM followed
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM followed WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM followed WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM followed WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM followed WHERE w5 IS NOT NULL
), counts AS (
  SELECT lang, string_split(text, ' ') AS words, size, count(*) AS n FROM grams GROUP BY lang, text, size
), total AS (
  SELECT lang, sum(n) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, words, size, n AS a FROM counts WHERE size > 1 AND n >= 100
), cuts AS (
  SELECT c.lang, c.words, c.a, k, h.n AS l, t.n AS r, total.n,
    (1000::HUGEINT * c.a::HUGEINT * total.n::HUGEINT) // (h.n::HUGEINT * t.n::HUGEINT) AS score
  FROM candidates c, range(1, 5) AS s(k), counts h, counts t, total
  WHERE k < c.size AND h.lang = c.lang AND h.words = c.words[1:k] AND t.lang = c.lang AND t.words = c.words[k + 1:]
    AND total.lang = c.lang
), scored AS (
  SELECT lang, words, a, n, min_by(struct_pack(score := score, l := l, r := r), (score, k)) AS cut
  FROM cuts GROUP BY lang, words, a, n
), inside AS (
  SELECT lang, words[i:i + part - 1] AS words, max(a) AS most
  FROM candidates, range(1, 5) AS f(i), range(2, 5) AS p(part)
  WHERE part < size AND i + part - 1 <= size GROUP BY ALL
), kept AS (
  SELECT scored.* FROM scored LEFT JOIN inside USING (lang, words) WHERE coalesce(100 * most < 100 * a, true)
), ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n::BIGINT AS n, cut.score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
