import gzip

import pytest
from pyspark.sql import functions as F

from seedlane import SearchOptions, append_reference, build_reference, jobs, open_reference, search, search_reference
from seedlane.operators import kmers, metrics
from seedlane.sources import files, tables

from helpers import EXAMPLE2_LINES, QUERY2_LINES, QUERY_SET


def expected_lines(texts):
    """Records, lines and offsets of file contents, in the order of the file names."""
    base, out, names = 0, [], []
    for text in texts:
        record, headers, number, offset = base, 0, 0, 0
        for line in text.replace("\r", "").split("\n"):
            if line.startswith(">"):
                headers += 1
                record, number, offset = base + headers, 0, 0
                names.append((record, line[1:].strip()))
            elif line:
                out.append((record, number, offset, line.upper()))
                number, offset = number + 1, offset + len(line)
        base += headers + 1
    return sorted(out), sorted(names)


def write(folder, texts, compressed=False):
    folder.mkdir(exist_ok=True)
    for n, text in enumerate(texts):
        data = text.encode()
        if compressed:
            (folder / f"f{n}.txt.gz").write_bytes(gzip.compress(data))
        else:
            (folder / f"f{n}.txt").write_bytes(data)
    return str(folder)


MIXED = [
    "start\nof file\n>one  \nACGT\n\nacg\n>two\n" + "".join(f"{i:04d}x\n" for i in range(300)) + ">three\n>four\nlast",
    ">only header\r\nAB\r\nCD\r\n",
    "".join("y" * (i % 17) + "\n" for i in range(200)),
]


@pytest.mark.parametrize("split,rows", [(40, 10_000), (150, 3), (1 << 27, 7), (1 << 27, 10_000)])
def test_lines_of_files(spark, tmp_path, split, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    path = write(tmp_path / "in", MIXED)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.read_sequence_lines(spark, path)
        lines, names = expected_lines(MIXED)
        assert sorted(map(tuple, got.collect())) == lines
        assert sorted(map(tuple, files.read_sequence_names(spark, path).collect())) == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def executed(df):
    """The plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_of_files_is_read_once_and_not_shuffled(spark, tmp_path):
    path = write(tmp_path / "in", MIXED)
    plan = executed(files.read_sequence_lines(spark, path))
    final = plan.split("Initial Plan")[0]
    # The kept text is joined with broadcast bases; only counts of splits are exchanged.
    assert "FileScan text" not in plan
    assert not any("line#" in row for row in final.splitlines() if "Exchange hashpartitioning" in row)


def test_compressed_data_under_another_name_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_bytes(gzip.compress(b">a\nACGT\n" * 100))
    with pytest.raises(Exception, match="compressed data"):
        files.read_sequence_lines(spark, str(tmp_path / "in")).collect()


def test_too_long_a_record_is_no_query(spark, tmp_path):
    lines = files.read_sequence_lines(spark, write(tmp_path / "in", [">a\nACGT\nACGT\n>b\nA\n"]))
    assert files.records(lines, 8).count() == 2
    with pytest.raises(Exception, match="too long for a query"):
        files.records(lines, 7).collect()


def test_compressed_files(spark, tmp_path):
    path = write(tmp_path / "in", MIXED, compressed=True)
    assert sorted(map(tuple, files.read_sequence_lines(spark, path).collect())) == expected_lines(MIXED)[0]


def test_query_fasta(spark, tmp_path):
    path = write(tmp_path / "q", ["> Example query\n" + "\n".join(QUERY2_LINES)])
    rows = files.read_query_fasta(spark, path).collect()
    whole = "".join(QUERY2_LINES)
    assert [(r["sequence"], r["length"]) for r in rows] == [(whole, len(whole))]


def test_query_tsv(spark, tmp_path):
    # With blanks around the tabs, as made by awk, and with a quote inside a sequence.
    text = "".join(f"{t} \t {i} \t {len(t)}\n" for i, t in QUERY_SET) + "\n" + 'ab"c\t9\t4\n'
    path = write(tmp_path / "q", [text], compressed=True)
    rows = {(r["query_id"], r["sequence"], r["length"]) for r in files.read_query_tsv(spark, path).collect()}
    assert rows == {(i, t.upper(), len(t)) for i, t in QUERY_SET} | {(9, 'AB"C', 4)}


def test_query_tsv_round_trip(spark, tmp_path):
    queries = kmers.as_queries(spark.createDataFrame(QUERY_SET, "id long, t string"), "id", "t")
    files.write_query_tsv(queries, str(tmp_path / "out"))
    assert sorted(files.read_query_tsv(spark, str(tmp_path / "out")).select(*queries.columns).collect()) == sorted(
        queries.collect()
    )


def test_query_tsv_with_tabs_and_blanks(spark, tmp_path):
    texts = ["AC\t5\tGT", "AC\tGT", " AC", "AC ", "\t", "A\t1\t1", "1"]
    queries = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "query_id long, sequence string, length int")
    files.write_query_tsv(queries, str(tmp_path / "out"))
    assert sorted(files.read_query_tsv(spark, str(tmp_path / "out")).collect()) == sorted(queries.collect())
    for n, bad in enumerate(["AC\tGT\t2", "ACGT", "ACGT\t1\t9"]):
        path = write(tmp_path / f"bad{n}", [bad + "\n"])
        with pytest.raises(Exception, match="not sequence TAB id TAB length"):
            files.read_query_tsv(spark, path).collect()


@pytest.mark.parametrize("width", [5, 26, 80, 1000])
def test_search_does_not_depend_on_line_width(spark, tmp_path, width):
    text = "".join(EXAMPLE2_LINES).upper()
    records = spark.createDataFrame([("ref", text)], "name string, sequence string")
    files.write_fasta(records, str(tmp_path / "fasta"), width)
    lines = files.read_sequence_lines(spark, str(tmp_path / "fasta"))
    assert lines.agg(F.max(F.length("line"))).first()[0] == min(width, len(text))
    build_reference(lines, str(tmp_path), "ref", 11, block_size=30, group=20, parts=3)
    queries = kmers.as_queries(spark.createDataFrame(QUERY_SET, "id long, t string"), "id", "t")
    stored = open_reference(spark, str(tmp_path), "ref")
    got = search_reference(queries, stored, SearchOptions(threshold=5))
    plain = search(queries, stored.content.limit(0).select("ref_id").unionAll(
        spark.createDataFrame([(1,)], "ref_id long")).withColumn("sequence", F.lit(text)),
        SearchOptions(threshold=5))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def refs_of(spark, *texts, first=1):
    rows = list(enumerate(texts, first))
    return kmers.as_references(spark.createDataFrame(rows, "id long, t string"), "id", "t")


def test_replacing_and_appending(spark, tmp_path):
    build_reference(refs_of(spark, "ABCDEFGH", "IJKLMNOP"), str(tmp_path), "r", 4, parts=2)
    again = build_reference(refs_of(spark, "ABCDEFGH"), str(tmp_path), "r", 4, parts=2)
    assert again.content.count() == 1 and again.index.count() == 5
    with pytest.raises(ValueError, match="already stored: ref_id 1"):
        append_reference(refs_of(spark, "QRSTUVWX"), str(tmp_path), "r")
    names = spark.createDataFrame([(5, "five")], "ref_id long, name string")
    more = append_reference(refs_of(spark, "QRSTUVWX", first=5), str(tmp_path), "r", names=names)
    assert {r.ref_id for r in more.content.collect()} == {1, 5} and more.index.count() == 10
    assert [tuple(r) for r in more.names.collect()] == [(5, "five")]
    assert {r.ref_name for r in more.with_names(more.content).collect()} == {None, "five"}


def test_files_read_separately_do_not_collide(spark, tmp_path):
    """Both files begin at record 1; their texts must not be glued together."""
    for n, text in enumerate(["ABCDEFGHIJKLMNOPQRST", "1234567890"]):
        lines, names = files.read_sequences(spark, write(tmp_path / f"in{n}", [f">file {n}\n{text}\n"]))
        if n == 0:
            build_reference(lines, str(tmp_path), "r", 4, names=names)
        else:
            append_reference(lines, str(tmp_path), "r", renumber=True, names=names)
    stored = open_reference(spark, str(tmp_path), "r")
    queries = kmers.as_queries(spark.createDataFrame([(1, "23456789"), (2, "KLMNOPQR")], "id long, t string"), "id", "t")
    found = stored.with_names(search_reference(queries, stored, SearchOptions(k=4, threshold=2))).collect()
    assert {(r.query_id, r.ref_name, r.ref_start, r.ref_end, r.score) for r in found} == {
        (1, "file 1", 1, 8, 1.0), (2, "file 0", 10, 17, 1.0)}


def test_a_failed_build_leaves_the_reference(spark, tmp_path):
    build_reference(refs_of(spark, "ABCDEFGH"), str(tmp_path), "r", 4)
    broken = refs_of(spark, "XYZ").withColumn("sequence", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        build_reference(broken, str(tmp_path), "r", 4)
    assert open_reference(spark, str(tmp_path), "r").index.count() == 5


def test_few_kmers_are_looked_for_by_the_scan(spark, tmp_path):
    texts = ["".join(chr(65 + (i * j * 7 + j * j) % 26) for j in range(500)) for i in range(40)]
    stored = build_reference(refs_of(spark, *texts), str(tmp_path), "r", 6)
    queries = kmers.as_queries(spark.createDataFrame([(1, texts[3][100:120])], "id long, t string"), "id", "t")
    keys = kmers.query_keys(queries, 6)
    entries = stored.entries_for(keys, few=True)
    plan = executed(entries)
    assert "PushedFilters: [IsNotNull(hash), In(hash" in plan.replace("IsNotNull(value), ", "") or "In(hash" in plan
    wanted = {r.seq for r in keys.collect()}
    every = {tuple(r) for r in stored.entries_for(keys, few=False).collect() if r.seq in wanted}
    assert {tuple(r) for r in entries.collect()} == every and every


def test_scratch_tables_go(spark):
    from seedlane.plans import layout

    with layout.scratch(spark):
        kept = layout.settled(spark.range(3))
        path = kept.inputFiles()[0]
        assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.9, "A", "A")], "query_id long, ref_id long, score double, a string, b string")
    for kind in ("parquet", "csv"):
        path = tables.write_alignments(df, str(tmp_path), "q", "r", kind, kind)
        assert path.endswith(f"/q_r_{kind}")
    assert spark.read.parquet(str(tmp_path / "q_r_parquet")).count() == 1
    stats = str(tmp_path / "stats")
    for n in (1, 2):
        tables.append_run_stats(metrics.run_stats(spark, procedure="search", number=n), stats)
    saved = spark.read.csv(stats, sep=";", header=True)
    assert sorted(r["number"] for r in saved.collect()) == ["1", "2"]
    assert {"executors", "cores", "memory", "date"} <= set(saved.columns)


def test_jobs(spark, tmp_path):
    path = write(tmp_path / "ref", [">1\n" + "\n".join(EXAMPLE2_LINES) + "\n"])
    write(tmp_path / "set", ["".join(f"{t}\t{i}\t{len(t)}\n" for i, t in QUERY_SET)])
    write(tmp_path / "single", ["> one\n" + QUERY_SET[1][1]])
    common = ["--folder", str(tmp_path / "store"), "--name", "toy"]

    def job(*args):
        parsed = jobs.parser().parse_args(list(args))
        return parsed.run(spark, parsed)

    job("build", *common, "--stats", str(tmp_path / "built"), "--parts", "2", path)
    many = job("query", *common, "--stats", str(tmp_path / "ran"), "--multi", "--output", str(tmp_path / "out"), str(tmp_path / "set"))
    found = {(r["query_id"], r["ref_start"], r["ref_end"]): r["score"] for r in spark.read.parquet(many).collect()}
    assert found[(2, 20, 55)] == found[(4, 137, 163)] == 1.0
    one = job("query", *common, "--output", str(tmp_path / "out"), str(tmp_path / "single"))
    assert (20, 55, 1.0) in {(r["ref_start"], r["ref_end"], r["score"]) for r in spark.read.parquet(one).collect()}
    # K-mers inside lines only: the query lies on one line of the file and is still found.
    job("build", "--folder", str(tmp_path / "store"), "--name", "lines", "--index-only", "--single-lines", path)
    both = open_reference(spark, str(tmp_path / "store"), "toy", "lines")
    assert both.index.agg(F.sum(F.size("value"))).first()[0] == sum(len(t) - 10 for t in EXAMPLE2_LINES)
    built = spark.read.csv(str(tmp_path / "built"), sep=";", header=True).collect()
    ran = spark.read.csv(str(tmp_path / "ran"), sep=";", header=True).collect()
    assert [(r["procedure"], r["key_size"]) for r in built] == [("build", "11")]
    assert [(r["queries"], r["candidates"], r["alignments"]) for r in ran] == [("4", "3", "3")]
    assert {"query_keys", "partitions", "read_sec", "match_sec", "extend_sec", "query_core_sec"} <= set(ran[0].asDict())
    as_text = job("query", *common, "--stats", str(tmp_path / "ran2"), "--format", "csv", "--output", str(tmp_path / "out"), str(tmp_path / "single"))
    again = spark.read.csv(str(tmp_path / "ran2"), sep=";", header=True).collect()
    assert int(again[0]["alignments"]) == spark.read.csv(as_text, sep="\t", header=True).count() > 0
    named = spark.read.parquet(one).collect()
    assert {(r["query_name"], r["ref_name"]) for r in named} == {("one", "1")}
    # A second file is added; its records count on.
    more = write(tmp_path / "more", [">2\n" + QUERY_SET[1][1] + "\n"])
    job("build", *common, "--append", more)
    both = job("query", *common, "--output", str(tmp_path / "out"), str(tmp_path / "single"))
    assert {r["ref_name"] for r in spark.read.parquet(both).collect()} == {"1", "2"}
