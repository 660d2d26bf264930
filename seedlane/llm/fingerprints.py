"""Document fingerprints: sketches of all shingle hashes below a fixed fraction of the hash range.

Unlike the k smallest hashes, such a sketch grows with its text, so that a short text's share in a very
long one can be estimated, and the union of two sketches is the sketch of both texts together. A text
none of whose hashes is below the bound keeps its smallest hash, which leaves all that true.

Everything is built-in functions on columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from seedlane.plans.layout import shuffle_tasks

WIDTH = 5
# One hash in so many is kept.
FRACTION = 4
BLANKS = r"[ \t\n\x0B\f\r]+"
LOWEST = -(1 << 63)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` lower-cased words; of the whole text if it has fewer words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")
    return F.transform(
        F.array(words),
        lambda w: F.when(
            F.size(w) > width - 1,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))),
                lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)]),
            ),
        ).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketch(text: Column, width: int = WIDTH, fraction: int = FRACTION) -> Column:
    """Sorted distinct hashes below 1/``fraction`` of the range, or the smallest one."""
    bound = LOWEST + (1 << 64) // fraction
    return F.transform(
        F.array(shingle_hashes(text, width)),
        lambda h: F.when(
            F.exists(h, lambda x: x < bound), F.array_sort(F.array_distinct(F.filter(h, lambda x: x < bound)))
        ).otherwise(F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())),
    )[0]


def fingerprint_text(hashes: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two texts; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both).cast("double")


def containment(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Estimated share of the first text's shingles that the second has, however unequal their lengths.

    Only hashes below the bound count; null if the first text has none.
    """
    bound = LOWEST + (1 << 64) // fraction
    kept = F.filter(a, lambda x: x < bound)
    return F.when(F.size(kept) > 0, F.size(F.array_intersect(kept, b)) / F.size(kept)).cast("double")


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    bound = LOWEST + (1 << 64) // fraction
    union = F.array_sort(F.array_union(a, b))
    return F.when(F.exists(union, lambda x: x < bound), F.filter(union, lambda x: x < bound)).otherwise(
        F.slice(union, 1, 1)
    )


def fingerprint(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    """The table with the sketch of each text (null: empty, whose sketch is empty)."""
    return docs.withColumn(name, sketch(F.col(text)))


def with_next(docs: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, WindowSpec]:
    """Rows ``(_key, _rank, *values, _part, _halo)`` and the window in which ``lead`` gives the next row's values.

    Rows with ``_halo`` 1 are only there to be next; drop them afterwards.

    Next is by a whole-number key, nulls first, rows of one key in the order of their values; after the
    last row comes the first. The keys are cut at approximate quantiles, which do not affect the result;
    every part is ordered by itself and also holds the first row of the part after it. Rows cross the
    network once.
    """
    parts = 4 * shuffle_tasks(docs.sparkSession)
    rank = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    ranks = docs.select(rank.alias("_rank"))
    cuts = ranks.agg(
        F.percentile_approx("_rank", [i / parts for i in range(1, parts)], 20 * parts).alias("cuts")
    ).first()["cuts"]
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))]).cast("array<bigint>")
    part = F.size(F.filter(cuts, lambda c: c <= F.col("_rank")))

    # One row for each part that has rows: its first key, and the part before it (of the first: the last).
    order = Window.orderBy("_part")
    firsts = ranks.withColumn("_part", part).groupBy("_part").agg(F.min("_rank").alias("_rank"))
    last = F.max("_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("_rank", F.coalesce(F.lag("_part").over(order), last).alias("_part"))

    own = docs.select(rank.alias("_rank"), *[F.col(v) for v in values], F.col(key).alias("_key"))
    heads = (
        own.join(F.broadcast(firsts), "_rank")
        .groupBy("_part", "_rank").agg(F.min(F.struct(*values)).alias("_head"))
        .select("_rank", *[F.col(f"_head.{v}").alias(v) for v in values], "_part", F.lit(1).alias("_halo"))
    )
    rows = own.withColumn("_part", part).withColumn("_halo", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    return rows, Window.partitionBy("_part").orderBy("_halo", "_rank", *[F.col(v).asc_nulls_first() for v in values])


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by the first as many (or all) of
    the next document, by ascending id; the first follows the last, so a single document follows itself.
    A null text counts as empty. Null ids come first, rows of one id are ordered by their text, and each
    repeated row is a document of its own. Two empty texts are alike (1), an empty one and another are
    not (0). Other columns are ignored; an empty table gives no rows.
    """
    kept = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows, order = with_next(kept, "_id", ["_text"])
    sketched = fingerprint(rows, "_text", "_sketch")
    n = F.char_length("_text").cast("long")
    half = F.floor(n / 2).cast("int")
    followed = sketched.select(
        F.col("_key").alias("doc_id"), n.alias("n_chars"), "_sketch", "_halo",
        F.lead("_sketch").over(order).alias("_next_sketch"),
        F.concat(
            F.substring("_text", F.lit(1), (n - half).cast("int")),
            F.substring(F.lead("_text").over(order), F.lit(1), half),
        ).alias("_edited"),
    ).filter("_halo = 0")
    done = fingerprint(followed, "_edited", "_edited_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("_sketch")).alias("fingerprint"),
        fingerprint_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
