"""Near-duplicates by SimHash: 64-bit fingerprints, linked when at most three bits differ.

Equal fingerprints are one class, so copies are compared once. Fingerprints are laid out in tiles by the
population counts of their four quarters. A differing bit changes one of these counts by one, so two
tiles whose counts differ by more than the radius in all hold no link and are never brought together;
the others are compared exactly, by exclusive-or and bit counts over whole tiles. A pair of tiles yields
a spanning forest of its links, not all of them, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.llm.common import free_prefix, join_by_class, raw_text, sorted_groups
from seedlane.llm.components import connected_components
from seedlane.plans.layout import settled, shuffle_tasks

SEED = 42
WIDTH = 3
RADIUS = 3
SIDES = 17  # population counts of 16 bits
# Fingerprints on either side of what one group compares.
TILE, STREAM = 4096, 65536
# Compared at once.
ROWS = 256


def simhash(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a UTF-8 text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) > width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 4096):
        part = hashes[start:start + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, bits)`` for every row; ``bits`` is the fingerprint as a signed number."""
    kept = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), raw_text(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([simhash(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits)], ["doc_id", "text_hash", "bits"])

    return kept.mapInArrow(run, f"doc_id {kind}, text_hash long, bits long")


def cells_of(bits: np.ndarray) -> np.ndarray:
    """The population counts of the four quarters, as one number."""
    quarters = np.ascontiguousarray(bits).view(np.uint16).reshape(-1, 4)
    return np.bitwise_count(quarters).astype(np.int64) @ SIDES ** np.arange(3, -1, -1)


def half_ball(radius: int) -> np.ndarray:
    """Differences of counts of at most ``radius`` in all, one of each two opposite ones and not zero."""
    steps = range(-radius, radius + 1)
    return np.array([d for d in product(steps, repeat=4) if 0 < sum(map(abs, d)) <= radius and d > (0,) * 4])


def _offsets(cells: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step, the cells for which it stays inside, and where it leads."""
    counts = np.stack([cells // SIDES**k % SIDES for k in (3, 2, 1, 0)], axis=1)
    for step in half_ball(radius):
        to = counts + step
        inside = np.flatnonzero(((to >= 0) & (to < SIDES)).all(axis=1))
        yield inside, to[inside] @ SIDES ** np.arange(3, -1, -1)


class Forest:
    """Components of the links found so far among numbered fingerprints."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        fresh = a != b
        if not fresh.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[fresh], np.maximum(a, b)[fresh]], axis=1), axis=0)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        move = np.arange(len(self.root))
        for x in list(up):
            move[x] = find(x)
        self.root = move[self.root]


def forest_of(homes: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links among ``homes`` and between them and ``probes`` connect."""
    every = np.concatenate([homes, probes])
    forest, n = Forest(len(every)), len(homes)
    for start in range(0, n, ROWS):
        own = homes[start:start + ROWS]
        for at in range(start, len(every), TILE):
            near = np.bitwise_count(own[:, None] ^ every[None, at:at + TILE]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                forest.link(a + start, b + at)
    linked = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[linked], every[forest.root[linked]]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links among the distinct ``bits`` that connect all that lie within ``radius``."""
    spark = classes.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(cells_of(batch.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    bits = classes.select("bits")
    # At most 17^4 rows.
    found = bits.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    own = np.zeros(SIDES**4, np.int64)
    own[found["cell"].to_numpy()] = found["n"].to_numpy()
    met = own.copy()
    occupied = np.flatnonzero(own)
    for inside, to in _offsets(occupied, radius):
        np.add.at(met, to, own[occupied[inside]])
    tiles = np.maximum(1, -(-own // TILE)).astype(np.int32)
    streams = np.maximum(1, -(-met // STREAM)).astype(np.int32)
    shared = spark.sparkContext.broadcast((own > 0, tiles, streams))

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A fingerprint as one of its cell's tile, and as a visitor to each tile within the radius.

        A tile's visitors are cut into streams, each of which meets the tile in a group of its own; what
        lies in the same cell but another tile visits too, from the tile of the smaller number.
        """
        there, tiles, streams = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                bits = batch.column(0).to_numpy()[start:start + 20_000]
                cells = cells_of(bits)
                mix = (bits.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                mix = mix.astype(np.int64)
                tile = mix % tiles[cells]

                def rows(cell, tile, stream, home, bits):
                    return pa.RecordBatch.from_arrays(
                        [pa.array(cell.astype(np.int32)), pa.array(tile.astype(np.int32)),
                         pa.array(stream.astype(np.int32)), pa.array(np.full(len(bits), home, np.int8)), pa.array(bits)],
                        ["cell", "tile", "stream", "home", "bits"])

                def each(count):
                    """Repeats every row ``count`` times, numbered from 0."""
                    who = np.repeat(np.arange(len(count)), count)
                    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)

                who, stream = each(streams[cells])
                yield rows(cells[who], tile[who], stream, 0, bits[who])
                who, other = each(tiles[cells])
                later = other > tile[who]
                who, other = who[later], other[later]
                yield rows(cells[who], other, (mix[who] // 7) % streams[cells[who]], 1, bits[who])
                for inside, to in _offsets(cells, radius):
                    met = there[to]
                    inside, to = inside[met], to[met]
                    who, other = each(tiles[to])
                    inside, to = inside[who], to[who]
                    yield rows(to, other, (mix[inside] // 7) % streams[to], 1, bits[inside])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (home, bits) in sorted_groups(batches, 3):
            a, b = forest_of(bits[home == 0].view(np.uint64), bits[home == 1].view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    key = ["cell", "tile", "stream"]
    return (
        bits.mapInArrow(laid_out, "cell int, tile int, stream int, home tinyint, bits long")
        .repartition(4 * shuffle_tasks(spark), *key)
        .sortWithinPartitions(*key)
        .mapInArrow(compared, "a long, b long")
    )


def component_of_classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(bits, n, first_id, component_id)`` for every distinct fingerprint of ``(doc_id, bits)``."""
    classes = settled(marked.groupBy("bits").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")))
    roots = settled(connected_components(links(classes, radius)))
    rooted = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return settled(rooted.join(smallest, "root").drop("root"))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, text_hash, fingerprint, component_id)``, one row per row.

    ``component_id`` is the smallest id that links lead to. Empty and null texts have fingerprint zero and
    are linked like any other; repeated rows share a fingerprint. A null id is never a component's,
    unless all ids of the component are null. An empty table gives no rows.
    """
    marked = settled(fingerprints(docs, id, text))
    classes = component_of_classes(marked, radius)
    joined = join_by_class(marked, classes.select("bits", "n", "component_id"), "bits", "n", marked.count())
    return joined.select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest id stays.

    Null ids come last; of rows with one id, the one with the smallest hash of its text stays, and of
    rows that repeat id and text any one. Columns are kept as they are.
    """
    found = near_duplicates(docs, id, text, radius)
    # A group with a null component has no ids at all; its fingerprint stands for it.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("bits "), "fingerprint"))
    rows = found.groupBy(group.alias("group"), "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rows")).alias("first")
    prefix = free_prefix("kept_", docs)
    names = [f"{prefix}{n}" for n in ("id", "text", "rows")]
    kept = settled(rows.groupBy("group").agg(first).select(
        *[F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "text_hash", "rows"), names)]))
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    matched = docs.join(kept, F.col(id).eqNullSafe(F.col(names[0])) & (hashed == F.col(names[1])))
    once, more = matched.filter(F.col(names[2]) == 1), matched.filter(F.col(names[2]) > 1)
    return once.unionByName(more.dropDuplicates(names[:2])).drop(*names)
