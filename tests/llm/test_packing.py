import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import TEXTS, documents, nothing
from seedlane.llm.packing import ROWS_PER_STEP, Packer, Steps, pack_documents, public_encoder


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_pieces_give_the_texts_back(spark, tokenizer):
    rows = pack_documents(documents(spark).coalesce(1)).collect()
    wanted = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t, _, _ in TEXTS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    # Repeated rows share a key; their pieces are told apart by going through them in order.
    found = []
    for (_, tokens), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in pieces)
        assert sum(r.length for r in pieces) == tokens * copies
        if copies == 1:
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
            found.append(tuple(i for r in pieces for i in r.ids))
    assert set(found) <= set(wanted) and len(found) > 8
    short = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert total <= pieces[0].tier and len({r.tier for r in pieces}) == 1
        short += total < pieces[0].tier
    assert short <= 1


def test_empty_table(spark):
    assert pack_documents(nothing(spark)).count() == 0


def test_encoder_equals_the_public_tokenizer(tokenizer):
    encode = public_encoder()
    for text in ["", " " * 200_000, "a" * 5000, "<|endoftext|> x", "a\x00b\x85  x é漢😀", "I'll  we've\n\n"]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_packer_loses_nothing(seed):
    random = np.random.default_rng(seed)
    packer = Packer(hold=int(random.choice([1, 7, 300])))
    sizes = random.integers(1, random.choice([40, 700, 3000]), size=random.choice([0, 1, 3, 500])).tolist() + [256, 512, 1024, 2048]
    for document, size in enumerate(sizes):
        packer.add(document, np.arange(size))
    packer.pack(last=True)
    seen = defaultdict(list)
    for tier, window in packer.sequences:
        assert 0 < sum(len(p[2]) for p in window) <= tier
        for document, start, ids in window:
            assert ids.tolist() == list(range(start, start + len(ids)))
            seen[document] += ids.tolist()
    assert {d: sorted(ids) for d, ids in seen.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    assert sum(sum(len(p[2]) for p in w) < t for t, w in packer.sequences) <= 1


def test_steps_hold_the_same_tokens():
    deal, random = Steps(), np.random.default_rng(0)
    held = defaultdict(int)
    for tier in random.choice([1024, 512, 256], 5000).tolist():
        held[deal(tier)] += tier
    full = [n for step, n in sorted(held.items())][:-2]
    assert all(n >= (ROWS_PER_STEP - 2) * 1024 for n in full) and max(full) <= ROWS_PER_STEP * 1024


def test_ids_by_the_plain_call(spark):
    """Also where an added token is spelled out, and where a text is no valid UTF-8."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [b"<|endoftext|> x", b"a<|endoftext|><|endoftext|>", b"<|endoftext", b"bad \xff\xfe bytes \xe2\x82", b"", b"x" * 3000 + b"<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) AS text")
    got = defaultdict(list)
    for r in sorted(pack_documents(df).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += r.ids
    for n, text in enumerate(texts):
        assert got[n] == plain.encode(text.decode(errors="replace"), add_special_tokens=False).ids + [0]
    assert 50256 in got[0]
