"""URL rules by a sort-merge range join.

A host's labels in reverse order, each followed by a dot, make a key in which a domain is a prefix of
its subdomains: a rule's host is an interval of keys. Pages and rules are cut at the same quantiles of
the pages' keys, a rule going to every range that its interval touches, and each range is sorted by key.
One sweep then meets a rule before the pages under it. Intervals are nested or apart, so the active
rules are a stack; the path decides among the rules on it.

A key with very many pages is the cut point of several ranges, over which its pages are dealt.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlane.plans.layout import shuffle_tasks

ALLOW, BLOCK = "allow", "block"
# Rows of the sample that decides where to cut, for the layout only.
SAMPLE = 20_000
RANGES_PER_TASK = 4
# Past all keys under a prefix: no UTF-8 text has this byte.
PAST = b"\xff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot, as bytes; empty for the empty host."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key).cast("binary")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = ALLOW
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per page.

    ``rules`` has ``(verdict, host, path)``. A rule fits a page whose host is the rule's or a subdomain and
    whose path begins with the rule's; the longest host and path together win, then the longer host, then
    ``block``. Without a rule, ``rule`` is null and ``verdict`` is ``default``. A null url and one without ``://``
    has an empty host and path, which only a rule for the empty host fits. Repeated pages and rules,
    null ids and other columns are allowed; without rules every page gets the default.
    """
    spark = pages.sparkSession
    kind = pages.schema[id].dataType.simpleString()
    parsed = pages.select(
        F.col(id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
        # Spreads the pages of one key over the ranges cut at it; the same for a task that is repeated.
        (F.pmod(F.xxhash64(id, url), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("spot"),
    ).withColumn("key", host_key(F.col("host")))
    laws = rules.select(
        F.col("verdict"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).distinct().withColumn("key", host_key(F.col("host")))

    ranges = RANGES_PER_TASK * shuffle_tasks(spark)
    rows = pages.count()
    sample = parsed.select("key").sample(min(1.0, SAMPLE / max(1, rows)), seed=11)
    keys = sorted(bytes(r["key"]) for r in sample.collect())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []

    shape = f"bin int, kind int, key binary, page_id {kind}, host string, path string, verdict string"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page's range. At a key where several ranges are cut, its random spot chooses one."""
        for batch in batches:
            bins = []
            for key, spot in zip(batch.column("key").to_pylist(), batch.column("spot").to_pylist()):
                low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                bins.append(low + int(spot * (high - low + 1)) if high > low else low)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins, pa.int32()), pa.array([1] * n, pa.int32()), batch.column("key"), batch.column("page_id"),
                 batch.column("host"), batch.column("path"), pa.nulls(n, pa.string())],
                ["bin", "kind", "key", "page_id", "host", "path", "verdict"])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule in every range that its keys may lie in."""
        for batch in batches:
            for row in batch.to_pylist():
                first = bisect_left(cuts, row["key"])
                last = bisect_right(cuts, row["key"] + PAST)
                n = last - first + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, last + 1), pa.int32()), pa.array([0] * n, pa.int32()),
                     pa.array([row["key"]] * n, pa.binary()), pa.nulls(n, page_type),
                     pa.array([row["host"]] * n, pa.string()), pa.array([row["path"]] * n, pa.string()),
                     pa.array([row["verdict"]] * n, pa.string())],
                    ["bin", "kind", "key", "page_id", "host", "path", "verdict"])

    from pyspark.sql.pandas.types import to_arrow_type

    page_type = to_arrow_type(pages.schema[id].dataType)
    both = parsed.mapInArrow(placed, shape).unionByName(laws.mapInArrow(copied, shape))
    sorted_ranges = both.repartition(shuffle_tasks(spark), "bin").sortWithinPartitions("bin", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, list]] = []
        current = None
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("bin", "kind", "key", "page_id", "host", "path", "verdict"))
            for bin_, kind_, key, page_id, host, path, verdict in zip(*columns):
                if bin_ != current:
                    current, stack = bin_, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind_ == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), len(host), verdict == BLOCK, path, host + path, verdict))
                else:
                    fits = [r for _, level in stack for r in level if path.startswith(r[3])]
                    best = max(fits, default=None)
                    out.append((page_id, host, path, best[4] if best else None, best[5] if best else default))
            if out:
                ids, *texts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, page_type), *(pa.array(x, pa.string()) for x in texts)],
                    ["page_id", "host", "path", "rule", "verdict"])

    return sorted_ranges.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


#: Rules of the query: (verdict, host, path).
RULES = [
    (ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"),
]

JUDGE_SQL = """
WITH parsed AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
    SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
           arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
    FROM parsed p JOIN rules r
      ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
    GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id
"""
