"""Hard negatives by cover trees over norm-augmented vectors.

One more component gives all vectors of a block the same norm, so a large inner product is a small angle. The
tree of a block covers its vectors level by level: the children of a node are vectors as far from each other as
the radius they are given at least, and that radius, the largest distance of what is left, covers all below them. The
angle of a node's centre to an anchor, and the angle its radius spans, bound the inner products of all vectors
under it from above and below. Nodes are taken best first; those whose bounds lie outside of what is wanted are
skipped, leaves are computed exactly in whole numbers.

Blocks are of one vector length, by label and by the nearest of some sampled vectors, and no larger than a task
holds. Each task builds the trees of its blocks and searches them for the anchors as they come.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlane.llm.common import smallest_hashes
from seedlane.plans.layout import settled, shuffle_tasks

# Positives of an anchor, negatives of each; hundredths of a positive's score that a negative's has at least and at most.
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90
# A vector's components are multiplied by this and rounded down.
SCALE = 256
# Children of a node, vectors of a leaf, and bytes and most vectors of a block.
FANOUT, LEAF, BLOCK_BYTES, BLOCK_ROWS = 32, 256, 16 << 20, 32768
# Parts by label; most sampled vectors that further part them.
LABELS, CENTRES = 16, 1024
# Whole numbers are exact in doubles below this.
EXACT = 2.0**53


def scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; beyond 64 bits the nearest of those."""
    if not anchor.size or float(np.abs(vectors).max(initial=0)) * float(np.abs(anchor).max()) * len(anchor) < EXACT:
        return np.rint(vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    exact = vectors.astype(object) @ anchor.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


class CoverTree:
    """A cover tree of whole-number vectors. ``order`` are the rows by leaf; node 0 is the root."""

    def __init__(self, vectors: np.ndarray) -> None:
        plain = vectors.astype(np.float64)
        norms = (plain * plain).sum(axis=1)
        self.norm = float(np.sqrt(norms.max()))
        more = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.points = np.column_stack([plain, more])
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        away = self._distances(0, self.order)
        self._node(0, 0, len(vectors), float(away.max()))
        self.centres = plain[self.centre]
        # The angle that a chord of the radius spans on the sphere all points lie on; a little more for rounding.
        half = np.array(self.radius) / (2 * self.norm) if self.norm else np.zeros(len(self.radius))
        self.angle = 2 * np.arcsin(np.minimum(half, 1)) + 1e-7

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        apart = self.points[rows] - self.points[centre]
        return np.sqrt((apart * apart).sum(axis=1))

    def _node(self, centre: int, start: int, stop: int, radius: float) -> int:
        number = len(self.centre)
        self.centre.append(centre), self.radius.append(radius), self.span.append((start, stop)), self.children.append([])
        if stop - start <= LEAF or radius == 0:
            return number
        rows = self.order[start:stop]
        near, owner = self._distances(centre, rows), np.zeros(len(rows), np.int64)
        chosen = [centre]
        # The farthest from all centres is the next one, until half the radius covers all or there are enough.
        while len(chosen) < FANOUT and (far := int(near.argmax())) >= 0 and near[far] > radius / 2:
            away = self._distances(int(rows[far]), rows)
            closer = away < near
            near[closer], owner[closer] = away[closer], len(chosen)
            chosen.append(int(rows[far]))
        by = np.argsort(owner, kind="stable")
        self.order[start:stop], near, owner = rows[by], near[by], owner[by]
        edges = np.searchsorted(owner, np.arange(len(chosen) + 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                self.children[number].append(
                    self._node(chosen[k], start + int(a), start + int(b), float(near[a:b].max())))
        return number

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner product with a vector under each node."""
        q = anchor.astype(np.float64)
        size = float(np.sqrt(q @ q)) * self.norm
        if size == 0:
            return np.zeros(len(self.angle)), np.zeros(len(self.angle))
        to = np.arccos(np.clip(self.centres @ q / size, -1, 1))
        slack = 1e-6 * size + 1
        return (size * np.cos(np.minimum(to + self.angle, np.pi)) - slack,
                size * np.cos(np.maximum(to - self.angle, 0)) + slack)


class Block:
    """Vectors with their ids and labels, in the order of the leaves of their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.tree = CoverTree(vectors)
        order = self.tree.order
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.plain = self.vectors.astype(np.float64)
        self.largest = float(np.abs(self.plain).max(initial=0))

    def scores(self, start: int, stop: int, anchor: np.ndarray, exact: bool) -> np.ndarray:
        """Exact inner products with some of the vectors; ``exact`` if doubles hold them."""
        return self.plain[start:stop] @ anchor if exact else scores(self.vectors[start:stop], anchor)

    def search(
        self, anchor: np.ndarray, anchor_id: int, label: int, same: bool, windows: list[tuple[int, int]], count: int
    ) -> list[list[tuple[int, int]]]:
        """For each window ``(least, most)`` of scores the first ``count`` as ``(score, id)``, of the ``same`` label or of others."""
        low, high = (x.tolist() for x in self.tree.bounds(anchor))
        exact = self.largest * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * len(anchor) < EXACT
        anchor = anchor.astype(np.float64) if exact else anchor
        least, most = [a for a, _ in windows], [b for _, b in windows]
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        top = max(most)

        def wanted(node: int) -> bool:
            return any(low[node] <= b and high[node] >= a for a, b in zip(least, most))

        heap = [(-min(high[0], top), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not wanted(node):
                continue
            for child in self.tree.children[node]:
                if wanted(child):
                    heapq.heappush(heap, (-min(high[child], top), child))
            if self.tree.children[node]:
                continue
            start, stop = self.tree.span[node]
            own = self.scores(start, stop, anchor, exact)
            fits = (own >= min(least)) & (own <= top) & ((self.labels[start:stop] == label) == same)
            some = np.flatnonzero(fits)
            if not len(some):
                continue
            pairs = [(-int(s), i) for s, i in zip(own[some].tolist(), self.ids[start:stop][some].tolist()) if i != anchor_id]
            for k, (a, b) in enumerate(zip(least, most)):
                new = [p for p in pairs if a <= -p[0] <= b]
                if new:
                    found[k] = heapq.nsmallest(count, found[k] + new)
                    if len(found[k]) == count:
                        least[k] = max(a, -found[k][-1][0])
        return [[(-s, i) for s, i in own] for own in found]


def _prepared(rows: DataFrame, id: str, vector: str, label: str | Column) -> DataFrame:
    """``(id, label, vec)`` with whole numbers, of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long"))
    kept = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.when(~odd, whole).alias("vec"))
    return kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).groupBy("id").agg(
        F.min(F.struct("label", "vec")).alias("first")).select("id", "first.label", "first.vec")


def _blocks(points: DataFrame) -> DataFrame:
    """``points`` with their ``size``, ``part`` (by label) and ``block``."""
    spark = points.sparkSession
    total = points.count()
    wide = points.agg(F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("n")).first()["n"]
    rows = max(LEAF, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, wide))))
    centres = min(CENTRES, total // (LABELS * rows))
    sized = points.withColumn("size", F.size("vec")).withColumn("part", F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int"))
    if centres > 1:
        sample = [np.array(r["vec"], np.float64) for r in smallest_hashes(points, "id", centres, total).select("vec").collect()]
        kept = spark.sparkContext.broadcast(sample)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size = {n: np.array([c for c in kept.value if len(c) == n]) for n in {len(c) for c in kept.value}}
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                own = batch.column("size").to_numpy()
                for n in np.unique(own):
                    if n in by_size and n:
                        which = np.flatnonzero(own == n)
                        x = batch.column("vec").take(pa.array(which)).flatten().to_numpy().reshape(-1, n).astype(np.float64)
                        c = by_size[n]
                        cell[which] = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        sized = sized.mapInArrow(run, "id long, label long, vec array<long>, size int, part int, cell int")
    else:
        sized = sized.withColumn("cell", F.lit(0))
    key = ["size", "part", "cell"]
    counts = sized.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("deals"))
    return sized.join(counts, key).withColumn(
        "block", F.concat_ws("/", *key, F.pmod(F.xxhash64("id"), F.col("deals")))).select("id", "label", "vec", "size", "part", "block")


WINDOWS = "array<struct<positive: bigint, score: bigint>>"


def _searched(points: DataFrame, anchors: DataFrame, same: bool, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """What each block has to offer to the ``(id, label, vec, windows, block)`` anchors that were sent to it."""
    none = F.lit(None).cast(WINDOWS)
    rows = points.select("block", F.lit(0).alias("kind"), "id", "label", "vec", none.alias("windows")).unionByName(
        anchors.select("block", F.lit(1).alias("kind"), "id", "label", "vec", "windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept, block = None, [], None
        for batch in batches:
            names_, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids, labels = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple[int, int, int, int, int]] = []
            for row in range(batch.num_rows):
                vec = batch.column(4)[row].values.to_numpy()
                if names_[row] != name:
                    name, kept, block = names_[row], [], None
                if kinds[row] == 0:
                    kept.append((ids[row], labels[row], vec.copy()))
                    continue
                if block is None:
                    if not kept:
                        continue
                    block = Block(
                        np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64),
                        np.array([k[2] for k in kept], np.int64).reshape(len(kept), -1))
                if same:
                    asked, windows, count = [(0, 0)], [(-(2**63), 2**63 - 1)], positives
                else:
                    asked = [(w["positive"], w["score"]) for w in batch.column(5)[row].as_py()]
                    windows, count = [(-(-least * s // 100), most * s // 100) for _, s in asked], negatives
                hits = block.search(vec, ids[row], labels[row], same, windows, count)
                for (positive, score), own in zip(asked, hits):
                    out += [(ids[row], positive, score, i, s) for s, i in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    names = ["anchor_id", "positive_id", "positive_score", "found_id", "found_score"]
    return (
        rows.repartition(shuffle_tasks(points.sparkSession), "block").sortWithinPartitions("block", "kind")
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))
    )


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that are ``anchors``.

    ``anchors`` is a condition on ``id``. Scores are inner products of vectors whose components are multiplied by 256 and
    rounded down; ties go to the smaller id. An anchor's positives are its ``positives`` first rows of the same label,
    their negatives the ``negatives`` first rows of other labels with ``least`` to ``most`` hundredths of the
    positive's score. Only vectors of one length are compared. Rows without id, label or vector, and those with a
    component that is null or not finite, take no part; of rows of one id the one of the smallest label, then
    vector, does. Components beyond 64 bits count as the largest that fit, and scores likewise. Anchors without
    positives, and positives without negatives, give no rows; nor does an empty table. Other columns are not read.
    """
    points = settled(_blocks(settled(_prepared(rows, id, vector, label))))
    blocks = points.select("size", "part", "block").distinct()
    asked = points.filter(anchors if isinstance(anchors, Column) else F.expr(anchors)).select("id", "label", "vec", "size", "part")
    none = F.lit(None).cast(WINDOWS).alias("windows")
    near = asked.join(blocks, ["size", "part"]).select("id", "label", "vec", none, "block")
    best = settled(_first(_searched(points, near, True, positives, negatives, least, most), ["anchor_id"], positives))
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("found_id").alias("positive"), F.col("found_score").alias("score")))).alias("windows"))
    sent = asked.join(windows, "id").join(blocks.select("size", "block"), "size").select("id", "label", "vec", "windows", "block")
    found = _first(
        _searched(points, sent, False, positives, negatives, least, most), ["anchor_id", "positive_id"], negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("found_score").alias("negative_score"))


NEGATIVES_SQL = """
WITH points AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, p.id, a.label = p.label AS same, CAST(list_inner_product(a.vec, p.vec) AS BIGINT) AS score
  FROM points a JOIN points p ON a.id % 100 = 0 AND a.id <> p.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
