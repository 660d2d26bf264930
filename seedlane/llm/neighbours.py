"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

Trees are fitted on a bounded sample of the vectors: a node cuts its vectors in halves along the difference
of two of them, so every tree is complete and a leaf is a number. All vectors are then put into their leaf
of each tree. A query searches all trees through one priority queue, ordered by how far it is from the
nearest cut on the way, until it has met a number of leaves. Queries and vectors meet leaf by leaf, where
cosines are exact matrix products; a query's best of all leaves are its neighbours.

Equal vectors are one entry with its smallest ids, as many as can be needed. Leaves with many vectors or
queries are cut into pieces, which meet pair by pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedlane.llm.common import as_frame_stream, smallest_hashes, sorted_groups
from seedlane.plans.layout import settled, shuffle_tasks

SAMPLE = 32_768
TREES, LEAF = 12, 256
# Share of all trees' leaves that a query meets, and as many leaves as there are trees at least. Vectors without
# any structure need this much for a recall of 0.9; those of real models need far less.
SHARE = 0.08
# Vectors and queries of a leaf that are compared in one piece.
PIECE = 8192


class Forest(NamedTuple):
    """``normals[tree, node]`` and ``cuts[tree, node]`` in the order of a heap; leaves follow the last level."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, unit: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", unit, self.normals[tree, node]) > self.cuts[tree, node]
            node = 2 * node + 1 + side
        return node - (self.leaves - 1)

    def probe(self, margins: np.ndarray, count: int) -> list[int]:
        """Numbers of the most promising leaves, ``tree * leaves + leaf``; ``margins[tree, node]`` are the query's."""
        inner, trees = self.leaves - 1, len(self.cuts)
        queue = [(-np.inf, tree, 0) for tree in range(trees)]
        found: list[int] = []
        while queue and len(found) < count:
            priority, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree][node]
                far = 2 * node + 1 + (margin <= 0)
                heapq.heappush(queue, (max(priority, abs(margin)), tree, far))
                node = 2 * node + 1 + (margin > 0)
            found.append(tree * self.leaves + node - inner)
        return found


def fit_forest(unit: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
    """Trees whose leaves hold ``leaf`` of the given vectors at most."""
    random = np.random.default_rng(seed)
    n, width = unit.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    inner = (1 << depth) - 1
    normals, cuts = np.zeros((trees, max(1, inner), width)), np.zeros((trees, max(1, inner)))
    for tree in range(trees):
        groups = [np.arange(n)]
        for node in range(inner):
            own = groups[node]
            normal = random.normal(size=width)
            if len(own) > 1:
                a, b = random.choice(own, 2, replace=False)
                if (unit[a] != unit[b]).any():
                    normal = unit[a] - unit[b]
            normal /= np.linalg.norm(normal)
            along = unit[own] @ normal
            cut = float(np.median(along)) if len(own) else 0.0
            normals[tree, node], cuts[tree, node] = normal, cut
            groups += [own[along <= cut], own[along > cut]]
    return Forest(normals, cuts, depth)


def unit_rows(values: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable_vectors(table: DataFrame, id: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, ``vector`` as the bytes of doubles.

    Those have an id and finite components that are not all zero. If vectors differ in length, those of the
    most frequent length (of equally frequent ones the shortest) take part.
    """
    v = F.col(vector)
    fine = table.filter(
        F.col(id).isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    ).select(F.col(id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    length = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.filter(F.size("vector") == (length["n"] if length else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                # Negative zero is zero.
                packed = pa.array([row.tobytes() for row in flat + 0.0], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "vector"])

    return fine.mapInArrow(run, "vec_id long, vector binary")


def _pieces(rows: DataFrame, leaves: int, piece: int) -> np.ndarray:
    """In how many pieces each leaf is cut; there is a row per leaf at most."""
    found = rows.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(leaves, np.int64)
    out[found["leaf"].to_numpy()] = -(-found["n"].to_numpy() // piece)
    return np.maximum(out, 1)


def _lowest(cosine: np.ndarray, low: float, ids: list[np.ndarray], distinct: int) -> float:
    """The cosine down to which the best vectors have ``distinct`` different ids, at most ``low``."""
    best, seen = np.flatnonzero(cosine >= low), set()
    for place in best:
        seen.update(ids[place].tolist())
    if len(seen) >= distinct:
        return low
    rest = np.flatnonzero(cosine < low)
    for place in rest[np.argsort(-cosine[rest], kind="stable")]:
        seen.update(ids[place].tolist())
        low = cosine[place]
        if len(seen) >= distinct:
            break
    return low


def nearest_neighbours(
    table: DataFrame, queries: F.Column, id: str = "vec_id", vector: str = "embedding", k: int = 5,
    trees: int = TREES, leaf: int = LEAF, share: float = SHARE, sample: int = SAMPLE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for those ``vec_id`` that ``queries`` selects.

    ``score`` is the cosine in double precision. Rows of the query's own id are no candidates. Ties go to the
    smaller id; an id with several vectors is found by its nearest, and searches with all of them. Rows
    without an id, and vectors null, zero or with null or non-finite components take no part. Queries with
    fewer candidates get all of them; an empty table gives no rows.
    """
    spark = table.sparkSession
    fine = settled(usable_vectors(table, id, vector).distinct())
    few = Window.partitionBy("vector").orderBy("vec_id")
    # The k + 1 smallest ids of a vector are enough: one of them may be the query's own.
    entries = settled(
        fine.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    rows = entries.count()
    drawn = smallest_hashes(entries.select("vector"), "vector", sample, rows).toArrow()["vector"].to_pylist()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = fit_forest(unit_rows(drawn), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)
    total = trees * forest.leaves
    probes = max(trees, int(np.ceil(share * total)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in as_frame_stream(batches, 2000):
            unit = unit_rows(batch.column(0).to_pylist())
            packed = pa.array([np.array(i, np.int64).tobytes() for i in batch.column(1).to_pylist()], pa.binary())
            for tree in range(len(forest.cuts)):
                at = forest.leaf_of(unit, tree) + tree * forest.leaves
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), packed], ["leaf", "vector", "ids"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in as_frame_stream(batches, 500):
            unit = unit_rows(batch.column(1).to_pylist())
            flat = forest.normals.reshape(-1, unit.shape[1])
            margins = (unit @ flat.T).reshape(len(unit), *forest.cuts.shape) - forest.cuts
            found = [forest.probe(m.tolist(), probes) for m in margins]
            who = np.repeat(np.arange(len(unit)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), batch.column(1).take(pa.array(who)),
                 pa.array([np.int64(i).tobytes() for i in batch.column(0).to_numpy()[who]], pa.binary())],
                ["leaf", "vector", "ids"])

    shape = "leaf long, vector binary, ids binary"
    indexed = settled(entries.select("vector", "ids").mapInArrow(placed, shape))
    asked = settled(fine.filter(queries).select("vec_id", "vector").mapInArrow(searched, shape))
    cut = spark.sparkContext.broadcast((_pieces(indexed, total, PIECE), _pieces(asked, total, PIECE)))

    def dealt(kind: int):
        """A piece of a leaf's vectors for each piece of its queries, and the other way round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, other = cut.value if kind == 0 else cut.value[::-1]
            for batch in batches:
                leaf = batch.column(0).to_numpy()
                piece = np.arange(len(leaf)) % own[leaf]
                who = np.repeat(np.arange(len(leaf)), other[leaf])
                partner = np.arange(len(who)) - np.repeat(np.cumsum(other[leaf]) - other[leaf], other[leaf])
                a, b = (piece[who], partner) if kind == 0 else (partner, piece[who])
                index = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[who]), pa.array(a), pa.array(b), pa.array(np.full(len(who), kind)),
                     batch.column(1).take(index), batch.column(2).take(index)],
                    ["leaf", "piece", "asking", "kind", "vector", "ids"])

        return run

    wide = "leaf long, piece long, asking long, kind long, vector binary, ids binary"
    both = indexed.mapInArrow(dealt(0), wide).unionByName(asked.mapInArrow(dealt(1), wide))
    key = ["leaf", "piece", "asking"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (kind, vectors, ids) in sorted_groups(batches, 3):
            if kind.all() or not kind.any():
                continue
            stored, stored_ids = unit_rows(list(vectors[kind == 0])), [np.frombuffer(i, np.int64) for i in ids[kind == 0]]
            asking = unit_rows(list(vectors[kind == 1]))
            asking_ids = np.frombuffer(b"".join(ids[kind == 1]), np.int64)
            out: list[tuple[int, int, float]] = []
            every = np.concatenate(stored_ids)
            repeated = len(np.unique(every)) < len(every)
            for start in range(0, len(asking), 512):
                cosine = asking[start:start + 512] @ stored.T
                # A query's own vector may be one of the best without being a candidate.
                best = min(k + 1, len(stored))
                top = np.argpartition(-cosine, best - 1, axis=1)[:, :best]
                low = np.take_along_axis(cosine, top, axis=1).min(axis=1)
                if repeated:
                    # Several vectors of one id take one place.
                    low = np.array([_lowest(c, l, stored_ids, k + 1) for c, l in zip(cosine, low)])
                for row, query in enumerate(asking_ids[start:start + 512].tolist()):
                    # All that tie with the last of them, as far as rounding lets see.
                    for place in np.flatnonzero(cosine[row] >= low[row] - 1e-12):
                        score = float((asking[start + row] * stored[place]).sum())
                        out += [(query, i, score) for i in stored_ids[place].tolist() if i != query]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*out)], ["query_id", "vec_id", "score"])

    pairs = (
        both.repartition(2 * shuffle_tasks(spark), *key).sortWithinPartitions(*key, "kind")
        .mapInArrow(met, "query_id long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
