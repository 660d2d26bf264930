"""Compressed files told by their first bytes."""

import gzip
import random

import pytest

from seedlane.sources import files

from test_sources import MIXED, expected_lines


def same_as_plain(spark, tmp_path, datas, plain):
    folder = tmp_path / "in put"
    folder.mkdir()
    for n, data in enumerate(datas):
        (folder / f"f{n}.txt").write_bytes(data)
    lines, names = files.read_sequences(spark, str(folder), by_content=True)
    want, called = expected_lines(plain)
    assert sorted(map(tuple, lines.select("ref_id", "line_no", "offset", "line").collect())) == want
    assert sorted(map(tuple, names.collect())) == called


@pytest.mark.parametrize("which", [lambda n: True, lambda n: n % 2 == 0, lambda n: False])
def test_names_do_not_matter(spark, tmp_path, which):
    datas = [gzip.compress(t.encode()) if which(n) else t.encode() for n, t in enumerate(MIXED)]
    same_as_plain(spark, tmp_path, datas, MIXED)


def test_members_line_ends_and_long_lines(spark, tmp_path):
    draw = random.Random(1)
    long = "".join(draw.choice("ACGT") for _ in range(3 << 20))
    text = f"ACGT\r\n>a\r\n{long}\r\nAC\n\n>b\n" + "GT\n" * 9000 + "TAIL"
    at = text.index("\r\nAC") + 1
    # Two members that meet within a line end, an empty one, and padding.
    data = gzip.compress(text[:at].encode()) + gzip.compress(b"") + gzip.compress(text[at:].encode()) + b"\0" * 512
    same_as_plain(spark, tmp_path, [data, gzip.compress(b"")], [text, ""])


def test_cut_files_are_errors(spark, tmp_path):
    (tmp_path / "cut").write_bytes(gzip.compress(b">a\nACGT\n" * 1000)[:-12])
    with pytest.raises(Exception, match="ends early"):
        files.read_sequence_lines(spark, str(tmp_path / "cut"), by_content=True).collect()


def test_query_files(spark, tmp_path):
    (tmp_path / "set").write_bytes(gzip.compress(b"acgt\t7\t4\n\nAC GT\t8\t5\n"))
    found = files.read_query_tsv(spark, str(tmp_path / "set"), by_content=True)
    assert sorted(map(tuple, found.collect())) == [(7, "ACGT", 4), (8, "AC GT", 5)]
