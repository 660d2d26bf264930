"""Rows that every operator has to bear: nulls, empty and very long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "a"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from it now.", "en", "b"),
    (4, None, None, None),
    (5, "", "de", "a"),
    (6, " \t\n ", None, "b"),
    (7, "Ünïcödé 漢字 text 😀 with\x0bodd\x0cwhite space\x85here", "fr", None),
    (8, "one", "en", "b"),
    (9, "one two", "en", "b"),
    (10, "one two three four", "en", "b"),
    (11, LONG, "en", "a"),
    (None, "a text without an id that stands alone here", "en", "a"),
    (None, None, None, None),
    (-5, "1234 5678 !!! ???", "en", "c"),
    (2**40, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that operators use for columns of their own.
CLASHING = ["score", "label", "row", "word", "n", "kept_id", "mix_copy", "_id", "_part", "bits", "term", "key", "features"]


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def nothing(spark):
    return documents(spark, [])
