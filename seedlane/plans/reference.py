"""Building, extending and opening stored references.

A reference is a list of segments, each the content, index and names of what was added at once, in a
folder of its own that is written completely before the settings name it. Settings are numbered files
that are never changed: whoever is first to create the next number has published a new state, and the largest
number counts. A failed build or addition therefore leaves what was there as it was, and of two that
publish at once one sees that it came second.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlane.operators.content import BLOCK, build_content, build_content_from_lines
from seedlane.operators.index import (
    GROUP,
    Run,
    entry_counts,
    hot_keys,
    index_content,
    index_lines,
    index_sequences,
    list_counts,
)
from seedlane.operators.kmers import explode_kmers
from seedlane.operators.seeds import SAMPLE, SEEN
from seedlane.plans.layout import MOST_TASKS, text_size, text_tasks
from seedlane.sources.tables import (
    PACKED,
    PARTS,
    lists_for_buckets,
    lists_of_rows,
    load_index,
    load_table,
    open_buckets,
    stored_lists,
    whole_offsets,
    write_content,
    write_index,
)

KEY_SIZE = 11

# Distinct k-mers up to which their hashes are given to the scan of the index, which then skips what
# cannot hold them. More of them would touch all of it anyway.
PUSHED_KEYS = 5000

# How an index is stored; others must be built again.
FORM = 2

# Characters whose k-mers make up a bucket, all lists of which one task holds.
BUCKET_CHARS = 2 << 20


@dataclass(frozen=True)
class Reference:
    """An index and the content it belongs to.

    Several indexes (other key sizes) may go with the same content. ``names`` are ``(ref_id, name)``
    where they were given. ``hot`` are the most frequent k-mers of the index, which a search with
    very many queries spreads. ``rows`` are all lists of the index and ``buckets`` those of the other k-mers, one table per
    segment, as stored: a row has the lists of one k-mer, in blocks of ``group`` positions.
    """

    rows: DataFrame
    content: DataFrame
    names: DataFrame
    k: int
    block_size: int
    content_parts: int
    hot: DataFrame
    buckets: tuple[DataFrame, ...]
    group: int

    @property
    def index(self) -> DataFrame:
        """``(seq, ref_id, block, value, hash)`` with whole offsets."""
        lists = stored_lists(self.rows, "seq", "hash").withColumn("value", whole_offsets(self.group))
        return lists.select("seq", "ref_id", "block", "value", "hash")

    def entries_for(self, keys: DataFrame, few: bool) -> DataFrame:
        """Flat index entries that may belong to the given k-mers.

        Each bucket is stored in the order of a hash of the k-mer. Up to ``PUSHED_KEYS`` hashes are put
        into its scan, so that only parts of files that may hold them are read. More that are still
        ``few`` enough to be broadcast turn away the other lists in the scanning task.
        """
        rows = self.rows
        if few:
            hashes = keys.select(F.hash("seq").alias("_hash")).distinct()
            some = [r["_hash"] for r in hashes.limit(PUSHED_KEYS + 1).collect()]
            if len(some) <= PUSHED_KEYS:
                rows = rows.filter(F.col("hash").isin(some))
            else:
                rows = rows.join(F.broadcast(hashes), F.col("hash") == F.col("_hash"), "left_semi")
        at = F.col("_at") + F.col("block") * F.lit(self.group)
        return stored_lists(rows, "seq").select("seq", "block", "ref_id", F.explode("value").alias("_at")).select(
            "seq", "block", "ref_id", at.alias("offset"))

    def with_names(self, found: DataFrame) -> DataFrame:
        """Rows with the name of their reference, null where it has none."""
        return found.join(self.names.withColumnRenamed("name", "ref_name"), "ref_id", "left")


def _root(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file system of a path and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _state(spark: SparkSession, folder: str, name: str) -> tuple[int, dict | None]:
    """The largest number of the settings and the latest ones; 0 and None without any.

    A file that cannot be read was left by a writer that ended while it wrote: its number is used up, the
    settings before it hold.
    """
    system, place = _files(spark, f"{_root(folder, name)}/settings")
    if not system.exists(place):
        return 0, None
    found = sorted((s.getPath().getName() for s in system.listStatus(place) if s.getPath().getName().endswith(".json")), reverse=True)
    for file in found:
        rows = spark.read.text(f"{_root(folder, name)}/settings/{file}", wholetext=True).take(1)
        try:
            return int(found[0].split(".")[0]), json.loads(rows[0]["value"])
        except (IndexError, ValueError):
            continue
    return int(found[0].split(".")[0]) if found else 0, None


def _settings(spark: SparkSession, folder: str, name: str) -> dict:
    settings = _state(spark, folder, name)[1]
    if settings is None:
        raise FileNotFoundError(f"no reference {name} in {folder}")
    return settings


def _publish(spark: SparkSession, folder: str, name: str, number: int, settings: dict) -> bool:
    """Create the settings of a ``number``; False if another writer has."""
    system, place = _files(spark, f"{_root(folder, name)}/settings/{number:09d}.json")
    try:
        out = system.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps(settings).encode()))
    out.close()
    return True


def _buckets(chars: int, tasks: int) -> int:
    return max(tasks, min(MOST_TASKS, -(-chars // BUCKET_CHARS)))


def _pack(hot: DataFrame, group: int, buckets: int) -> Run:
    """Packs lists in the tasks that have them; ``hot`` are at most ``HOT_SHARE`` k-mers."""
    splits = {r["seq"]: r["splits"] for r in hot.select("seq", "splits").collect()}
    return lambda batches: lists_for_buckets(batches, group, buckets, splits)


def _add_segment(
    sequences: DataFrame, root: str, k: int, block_size: int, group: int, parts: int, index_only: bool,
    cross_lines: bool, names: DataFrame | None,
) -> tuple[str, int]:
    """Write one segment; returns its folder and the number of its buckets.

    Its hot k-mers are found in a sample of the text. This decides where their lists are stored, not which.
    """
    spark = sequences.sparkSession
    path = f"{root}/segment-{uuid.uuid4().hex}"
    by_line = "line" in sequences.columns
    content = (build_content_from_lines if by_line else build_content)(sequences, block_size)
    if not index_only:
        write_content(content, f"{path}/content", parts)
        content = load_table(spark, f"{path}/content")
    chars = text_size(content, "value").chars
    tasks = text_tasks(spark, chars)
    buckets = _buckets(chars, tasks)
    # Chosen by their numbers, so that the layout of a text does not depend on how its rows came.
    chosen = F.pmod(F.xxhash64("ref_id", "offset", F.lit(1)), F.lit(1 << 20)) < F.lit(round(SAMPLE * (1 << 20)))
    some = explode_kmers(content.filter(chosen), k, ["ref_id"], text="value", base=F.col("offset"))
    hot_keys(entry_counts(some), least=SEEN).write.parquet(f"{path}/hot")
    pack = _pack(load_table(spark, f"{path}/hot"), group, buckets)
    if not by_line:
        index = index_sequences(sequences, k, group, tasks, pack, PACKED)
    elif cross_lines:
        index = index_content(content, k, group, tasks, pack, PACKED)
    else:
        index = index_lines(sequences, k, group, tasks, pack, PACKED)
    write_index(index, f"{path}/index", group, buckets)
    none = spark.createDataFrame([], "ref_id long, name string")
    (none if names is None else names.select("ref_id", F.col("name").cast("string").alias("name"))).write.parquet(
        f"{path}/names")
    return path, buckets


def build_reference(
    sequences: DataFrame,
    folder: str,
    name: str,
    k: int = KEY_SIZE,
    block_size: int = BLOCK,
    group: int = GROUP,
    parts: int = PARTS,
    index_only: bool = False,
    cross_lines: bool = True,
    names: DataFrame | None = None,
) -> Reference | None:
    """Create or replace the named reference and open it.

    ``sequences`` are ``(ref_id, sequence)`` rows, or ``(ref_id, offset, line)`` rows for records
    of any length, ``names`` their ``(ref_id, name)``. ``index_only`` writes just an index, to be
    opened with the content of another reference. Without ``cross_lines``, the k-mers that span a
    line end are left out. The files of a reference that is replaced stay until they are deleted.
    """
    spark = sequences.sparkSession
    how = {"k": k, "block_size": block_size, "group": group, "parts": parts, "cross_lines": cross_lines}
    segment, buckets = _add_segment(
        sequences, _root(folder, name), k, block_size, group, parts, index_only, cross_lines, names)
    how |= {"form": FORM, "segments": [segment], "buckets": {segment: buckets}}
    while not _publish(spark, folder, name, _state(spark, folder, name)[0] + 1, how):
        pass
    return None if index_only else open_reference(spark, folder, name)


def append_reference(
    sequences: DataFrame, folder: str, name: str, renumber: bool = False, names: DataFrame | None = None
) -> Reference:
    """Add sequences to a stored reference, with its settings, and open it.

    Their ``ref_id`` must not be there already, which is checked. With ``renumber`` they are counted on
    from the largest one stored instead, as files read separately all begin at 1.
    """
    spark = sequences.sparkSession
    (number, how), stored = _state(spark, folder, name), open_reference(spark, folder, name)
    if renumber:
        last = stored.content.agg(F.coalesce(F.max("ref_id"), F.lit(0)).alias("n")).first()["n"]
        first = sequences.agg(F.coalesce(F.min("ref_id"), F.lit(1)).alias("n")).first()["n"]
        moved = (F.col("ref_id") + F.lit(last + 1 - first)).alias("ref_id")
        sequences = sequences.select(moved, *[c for c in sequences.columns if c != "ref_id"])
        names = None if names is None else names.select(moved, "name")
    else:
        _refuse_stored(sequences, stored.content)
    segment, buckets = _add_segment(
        sequences, _root(folder, name), how["k"], how["block_size"], how["group"], how["parts"], False,
        how["cross_lines"], names)
    while not _publish(spark, folder, name, number + 1, how | {
            "segments": [*how["segments"], segment], "buckets": how["buckets"] | {segment: buckets}}):
        # Someone else was first: add to what is there now, unless that has taken the same numbers.
        seen = how["segments"]
        number, how = _state(spark, folder, name)
        added = [s for s in how["segments"] if s not in seen]
        if added:
            _refuse_stored(
                load_table(spark, f"{segment}/content"), load_table(spark, *[f"{s}/content" for s in added]))
    return open_reference(spark, folder, name)


def _refuse_stored(sequences: DataFrame, content: DataFrame) -> None:
    there = content.select("ref_id").distinct()
    both = sequences.select("ref_id").distinct().join(there, "ref_id", "left_semi").take(3)
    if both:
        raise ValueError(f"already stored: ref_id {', '.join(str(r['ref_id']) for r in both)}")


def compact_reference(spark: SparkSession, folder: str, name: str) -> Reference:
    """Merge the segments of a reference into one and open it.

    Stored lists and blocks are moved once, text is not cut into k-mers again. What is added meanwhile stays a
    segment of its own. The files of the merged segments stay until they are deleted, so searches that
    use them go on.
    """
    number, how = _state(spark, folder, name)
    if how is None:
        raise FileNotFoundError(f"no reference {name} in {folder}")
    merged, path = how["segments"], f"{_root(folder, name)}/segment-{uuid.uuid4().hex}"
    if len(merged) > 1:
        content = load_table(spark, *[f"{s}/content" for s in merged]).drop("part")
        write_content(content, f"{path}/content", how["parts"])
        rows, group = load_index(spark, *[f"{s}/index" for s in merged], group=how["group"]), how["group"]
        chars = text_size(load_table(spark, f"{path}/content"), "value").chars
        buckets = _buckets(chars, text_tasks(spark, chars))
        hot_keys(list_counts(rows.withColumn("value", F.flatten("value"))), least=SEEN).write.parquet(f"{path}/hot")
        pack = _pack(load_table(spark, f"{path}/hot"), group, buckets)
        index = rows.drop("hash").mapInArrow(lambda batches: pack(lists_of_rows(batches, group)), PACKED)
        write_index(index, f"{path}/index", group, buckets)
        load_table(spark, *[f"{s}/names" for s in merged]).write.parquet(f"{path}/names")
        while True:
            later = [s for s in how["segments"] if s not in merged]
            if len(later) + len(merged) != len(how["segments"]):
                raise RuntimeError(f"{name} was replaced while its segments were merged")
            kept = {path: buckets} | {s: how["buckets"][s] for s in later}
            if _publish(spark, folder, name, number + 1, how | {"segments": [path, *later], "buckets": kept}):
                break
            number, how = _state(spark, folder, name)
    return open_reference(spark, folder, name)


def open_reference(
    spark: SparkSession, folder: str, name: str, index_name: str | None = None
) -> Reference:
    """The content of ``name`` with its own index or that of ``index_name``."""
    own = _settings(spark, folder, name)
    used = own if index_name is None else _settings(spark, folder, index_name)

    def table(of: dict, part: str) -> DataFrame:
        return load_table(spark, *[f"{segment}/{part}" for segment in of["segments"]])

    if used.get("form") != FORM:
        raise ValueError(f"stored by an earlier version, build it again: {index_name or name} in {folder}")
    group, paths = used["group"], [(f"{segment}/index", used["buckets"][segment]) for segment in used["segments"]]
    return Reference(
        load_index(spark, *[path for path, _ in paths], group=group), table(own, "content"), table(own, "names"),
        used["k"], own["block_size"], own["parts"],
        table(used, "hot").groupBy("seq").agg(F.max("splits").alias("splits")),
        tuple(open_buckets(spark, path, group, buckets) for path, buckets in paths), group,
    )
