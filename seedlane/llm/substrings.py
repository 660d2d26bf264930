"""Passages that occur more than once, found by seed and extend on winnowed anchors.

A passage of ``length`` words holds ``length - GRAM + 1`` runs of ``GRAM`` words; the run of the smallest hash is
its anchor, so equal passages have equal anchors at equal places (winnowing). All places are joined
by their anchor. An anchor is extended to either side for as long as it stays the anchor: that is its block,
several passages that begin one after the other. Where all blocks of a shared anchor are equal, all of their
passages repeat. Where they differ, each different block is extended word by word: its passages are
counted with the rows of the other blocks of the anchor. Passages that repeat and begin one after
the other are one maximal repeat.

An anchor with very many places is dealt over many tasks, its blocks are counted before they are moved, and no
pairs are formed, so a group of copies costs what its text costs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.llm.bitmap import bitmap_of, may_hold
from seedlane.llm.common import free_prefix, raw_text
from seedlane.plans.layout import settled

# Words of a passage that count as a repeat, and of the runs whose hashes are compared.
LENGTH, GRAM = 35, 12
# Words handled at once, and bytes of text split at once.
WORDS, BYTES = 1 << 17, 1 << 20
# Anchors with more than one in so many places are dealt over several tasks.
HOT = 2000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ODD_A, _ODD_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    start = 0
    while start < len(text):
        found = _SPACE.search(text, start + BYTES)
        stop = found.start() if found else len(text)
        yield text[start:stop].split()
        start = stop


def _powers(odd: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, odd, np.uint64))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Runs:
    """Hashes of runs of words, from sums of word hashes times powers of an odd number."""

    def __init__(self, odd: int, words: int) -> None:
        self.up = _powers(odd, words)
        self.down = _powers(pow(odd, -1, 1 << 64), words)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:len(hashes)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((sums[stop] - sums[start]) * self.down[start])


class Winnower:
    """Blocks of passages of ``length`` words, by anchors of ``gram`` words."""

    def __init__(self, length: int, gram: int) -> None:
        if not 0 < gram <= length:
            raise ValueError("gram must be between 1 and length")
        self.length, self.gram, self.size = length, gram, WORDS + length
        self.a, self.b = Runs(_ODD_A, self.size), Runs(_ODD_B, self.size)

    def blocks(self, words: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(first, n, anchor, block, passages)``: of each block its first passage's place, how many they are, hashes.

        ``owner`` numbers the text of every word; no passage spans two. ``passages`` are the hashes of the
        passages at all places.
        """
        last = len(words) - self.length + 1
        none = np.zeros(0, np.int64)
        if last <= 0:
            return none, none, none, none, none
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        sums = self.a.sums(hashes)
        at = np.arange(len(words) - self.gram + 1)
        grams = self.a.of(sums, at, at + self.gram)
        view = np.lib.stride_tricks.sliding_window_view(grams, self.length - self.gram + 1)
        place = np.arange(last)
        anchor = place + view.argmin(axis=1)
        whole = owner[:last] == owner[self.length - 1:]
        begins = whole.copy()
        begins[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(begins)
        ends = np.flatnonzero(whole & np.concatenate([begins[1:] | ~whole[1:], [True]]))
        n = ends - first + 1
        sums = self.b.sums(_mixed(hashes))
        block = self.b.of(sums, first, ends + self.length)
        block = _mixed(block ^ _mixed((anchor[first] - first).astype(np.uint64) * np.uint64(self.length + 1) + n.astype(np.uint64)))
        passages = self.b.of(sums, place, place + self.length)
        return first, n, grams[anchor[first]], block, passages


def _pieces(texts: Iterator[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """``(words, owner, place)`` of at most ``WORDS`` words and an overlap; places of words in their text.

    A text goes on in the next piece with its last ``length - 1`` words, so every passage is in one.
    """
    words: list[bytes] = []
    owners, places = [], []

    def piece():
        return words, np.concatenate(owners), np.concatenate(places)

    for row, text in enumerate(texts):
        begun, own = 0, 0  # words of the text so far; those in this piece
        for some in words_of(text):
            while some:
                part = some[:WORDS - len(words)] if len(words) < WORDS else []
                words += part
                owners.append(np.full(len(part), row))
                places.append(np.arange(begun, begun + len(part)))
                begun, own, some = begun + len(part), own + len(part), some[len(part):]
                if len(words) >= WORDS:
                    yield piece()
                    keep = min(length - 1, own)
                    words = words[len(words) - keep:]
                    owners, places = [np.full(keep, row)], [np.arange(begun - keep, begun)]
                    own = keep
    if words:
        yield piece()


def _block_rows(docs: DataFrame, id: str, text: str, length: int, gram: int, seen=None) -> DataFrame:
    """``(a, b)`` of every block; with bitmaps ``seen`` of shared and of mixed anchors the shared blocks, with places.

    Then ``(id, hash, a, b, first, n, passages)``: hashes of its passages only where the anchor may be mixed.
    """
    kept = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), raw_text(text).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(length, gram)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            for words, owner, place in _pieces(texts, length):
                first, n, a, b, passages = winnower.blocks(words, owner)
                if not len(first):
                    continue
                if seen is None:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                    continue
                shared, mixed = seen.value
                some = np.flatnonzero(may_hold(shared, a))
                first, n, a, b = first[some], n[some], a[some], b[some]
                many = np.where(may_hold(mixed, a), n, 0)
                ends = np.concatenate([[0], np.cumsum(many)])
                which = np.repeat(first - ends[:-1], many) + np.arange(ends[-1])
                rows = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), pa.array(place[first]), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(passages[which].view(np.int64)))],
                    ["id", "hash", "a", "b", "first", "n", "passages"])

    if seen is None:
        return kept.mapInArrow(run, "a long, b long")
    return kept.mapInArrow(run, f"id {kind}, hash long, a long, b long, first long, n int, passages array<long>")


def repeated_parts(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(id, hash, first, n)``: passages that repeat and begin at words ``first`` to ``first + n - 1`` of a text.

    ``hash`` is that of the text, so that rows of one id are told apart. Rows may overlap or touch; see
    :func:`maximal_repeats` for joined ones.
    """
    spark = docs.sparkSession
    # Seeds: anchors at more than one place, and whether their blocks are all the same.
    anchors = settled(
        _block_rows(docs, id, text, length, gram).groupBy("a")
        .agg(F.count("*").alias("places"), F.min("b").alias("least"), F.max("b").alias("most"))
        .filter("places > 1").select("a", "places", (F.col("least") != F.col("most")).alias("mixed"))
    )
    seen = spark.sparkContext.broadcast((bitmap_of(anchors, "a"), bitmap_of(anchors, "a", F.col("mixed"))))
    # An anchor of very many places is dealt: at most HOT anchors, so these may be broadcast.
    total = anchors.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(anchors.filter(F.col("places") > max(total // HOT, 1000)).select(
        "a", F.least(F.ceil(F.col("places") * F.lit(HOT) / F.lit(max(total, 1))), F.lit(1000)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = _block_rows(docs, id, text, length, gram, seen).join(hot, "a", "left").withColumn(
        "deal", F.pmod(F.xxhash64("id", "first"), parts).cast("int")).drop("parts")
    copies = anchors.join(hot, "a", "left").select(
        "a", "mixed", F.explode(F.sequence(F.lit(0), parts - F.lit(1))).alias("deal"))
    found = settled(rows.join(copies.hint("merge"), ["a", "deal"]).drop("deal"))

    # Extension of blocks that differ from others of their anchor: equal ones once, with their number.
    place = ["id", "hash", "first", "n"]
    mixed = found.filter("mixed")
    blocks = settled(
        mixed.groupBy("a", "b").agg(
            F.count("*").alias("rows"), F.first("passages").alias("passages"), F.first(F.struct(*place)).alias("one"))
    )
    repeats = (
        blocks.select("a", "rows", F.explode("passages").alias("passage"))
        .groupBy("a", "passage").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("a", "passage")
    )
    alone = (
        blocks.filter("rows = 1").select("a", "one", F.posexplode("passages").alias("at", "passage"))
        .join(repeats.hint("merge"), ["a", "passage"])
        .select("one.id", "one.hash", (F.col("one.first") + F.col("at")).alias("first"), F.lit(1).alias("n"))
    )
    together = mixed.join(blocks.filter("rows > 1").select("a", "b").hint("merge"), ["a", "b"]).select(*place)
    return found.filter("not mixed").select(*place).unionByName(together).unionByName(alone)


def _spans(docs: DataFrame, id: str, text: str, length: int, gram: int) -> DataFrame:
    """``docs`` with ``(id, hash)`` and an array of their repeated parts, null without any.

    An array holds no more than its own text has places, also where rows repeat.
    """
    held = repeated_parts(docs, id, text, length, gram).groupBy("id", "hash").agg(
        F.collect_set(F.struct("first", "n")).alias("parts"))
    prefix = free_prefix("_repeats_", docs)
    held = held.toDF(*[f"{prefix}{c}" for c in held.columns])
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(
        held.hint("merge"), F.col(id).eqNullSafe(F.col(f"{prefix}id")) & (hashed == F.col(f"{prefix}hash")), "left"
    ).select(*[docs[c] for c in docs.columns], F.col(f"{prefix}parts").alias(f"{prefix}parts"))


def _joined(first: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal repeats ``(word, words)`` of parts: passages that begin one after the other are one."""
    out: list[tuple[int, int]] = []
    for a, k in sorted(zip(first.tolist(), n.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + k))
        else:
            out.append((a, a + k))
    return [(a, b - a + length - 1) for a, b in out]


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, repeats)``, a row per row: the text without words in repeated passages.

    A passage is ``length`` words of one text in a row that also begin anywhere else, in the same text too; words
    are what stands between ASCII white space. The words kept are joined by one space. ``repeats`` are the
    maximal repeats as ``(word, words)``. All places of a passage go, the first as well. Null and
    empty texts have no words, nor passages; rows that repeat count as places of their own, whatever
    their id, which may be null. Other columns are not read. An empty table gives no rows.
    """
    marked = _spans(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", length, gram)
    kept = marked.select("doc_id", raw_text("text").alias("text"), F.col(marked.columns[-1]).alias("parts"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = batch.column(2)[row]
                body = batch.column(1)[row].as_py()
                spans = []
                if parts.is_valid:
                    spans = _joined(parts.values.field("first").to_numpy(), parts.values.field("n").to_numpy(), length)
                left, words, removed, k = [], 0, 0, 0
                for some in words_of(body):
                    at = 0
                    while k < len(spans) and spans[k][0] < words + len(some):
                        start, stop = spans[k][0] - words, spans[k][0] + spans[k][1] - words
                        left += some[at:max(start, at)]
                        gone = min(stop, len(some))
                        removed += gone - max(start, at)
                        at = gone
                        if stop > len(some):
                            break
                        k += 1
                    left += some[at:]
                    words += len(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([b" ".join(left)], pa.binary()),
                     pa.array([words], pa.int64()), pa.array([removed], pa.int64()),
                     pa.array([[{"word": a, "words": n} for a, n in spans]], pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64())])))],
                    ["doc_id", "text", "n_words", "n_removed", "repeats"])

    out = kept.mapInArrow(
        run, f"doc_id {kind}, text binary, n_words long, n_removed long, repeats array<struct<word: bigint, words: bigint>>")
    return out.withColumn("text", F.col("text").cast("string"))


def maximal_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """``(doc_id, word, words)``: every maximal repeat, with the number of its first word and how many it has."""
    return remove_repeats(docs, id, text, length, gram).select("doc_id", F.explode("repeats").alias("r")).select(
        "doc_id", "r.word", "r.words")


REMOVED_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS line,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT line, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS passage
  FROM (SELECT line, words, unnest(range(1, len(words) - 33)) AS pos FROM split)
), repeated AS (
  SELECT line, pos FROM windows WHERE passage IN (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT line, pos + i AS pos FROM repeated, range(35) AS r(i)
), listed AS (
  SELECT line, list(pos) AS places FROM gone GROUP BY line
), kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(places, []), i)), ' ') AS left_over
  FROM split LEFT JOIN listed USING (line)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(left_over) AS kept_sha256 FROM kept
"""
