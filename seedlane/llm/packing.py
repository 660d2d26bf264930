"""Packing of tokenised documents into windows of several lengths.

A document is its token ids followed by one end id. It may be cut anywhere. Full windows of the
longest length are cut off first; what remains goes to the tier of the smallest context size that
holds it. Each tier is packed by itself: the remainders of the longest tier open windows whose gaps
are filled with the largest fitting pieces of the shorter tiers (a piece is cut when none fits), then
the same for the next tier. Windows of a shorter tier are therefore full as well, and only what is
left when a task ends is padded: less than one window per task, whatever the size of the table.
Nothing is shuffled, since any document can fill any gap.

Sequences are gathered in step groups that hold the same number of tokens: a row of a group is one
long window, or as many shorter ones as have its length.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedlane.llm.common import as_frame_stream, raw_text

TIERS = (1024, 512, 256)
END_ID = 0
# Remainders that a task holds before it packs them.
HOLD = 4096
ROWS_PER_STEP = 64


class Encoder:
    """Token ids of texts. ``tokenizers`` defines them; the faster library has the same vocabulary.

    It gives up on very long runs of white space, which then go to ``tokenizers``. So do texts that spell out one of the
    vocabulary's added tokens, such as that for the end of a text, if these are to be ``added``; they are
    ordinary text otherwise.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, added: bool = False) -> None:
        self.vocabulary, self._slow, self.added = vocabulary, None, []
        if added:
            with open(vocabulary, encoding="utf-8") as held:
                self.added = [t["content"] for t in json.load(held).get("added_tokens", [])]
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self._fast = tiktoken.Encoding(
            "bytes", pat_str=pattern, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        )

    def __call__(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return self.exact(text)
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self.exact(text)

    def exact(self, text: str) -> np.ndarray:
        if self._slow is None:
            self._slow = Tokenizer.from_file(self.vocabulary)
            self._slow.encode_special_tokens = not self.added
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


def public_encoder(
    vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", added: bool = False
) -> Encoder:
    return Encoder(
        public_tokenizers.path(vocabulary), public_tokenizers.path(ranks), public_tokenizers.PATTERN, added
    )


class Packer:
    """Packs pieces ``(document, start, ids)`` into sequences, a buffer at a time.

    ``sequences`` collects ``(tier, pieces)`` in the order they are closed.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, hold: int = HOLD) -> None:
        if any(a % b for a, b in zip(tiers, tiers[1:])):
            raise ValueError("each tier must divide the one before it")
        self.tiers, self.hold = tiers, hold
        self.waiting: list[list[tuple]] = [[] for _ in tiers]
        self.count = 0
        self.sequences: list[tuple[int, list[tuple]]] = []

    def add(self, document: int, ids: np.ndarray) -> None:
        longest = self.tiers[0]
        whole = len(ids) - len(ids) % longest
        for start in range(0, whole, longest):
            self.sequences.append((longest, [(document, start, ids[start:start + longest])]))
        if whole < len(ids):
            self._wait((document, whole, ids[whole:]))
            if self.count >= self.hold:
                self.pack()

    def _tier(self, size: int) -> int:
        return max(k for k, tier in enumerate(self.tiers) if size <= tier)

    def _wait(self, piece: tuple) -> None:
        self.waiting[self._tier(len(piece[2]))].append(piece)
        self.count += 1

    def pack(self, last: bool = False) -> None:
        """Close all windows that can be filled; the pieces of the others wait, or are closed too."""
        pieces, self.waiting, self.count = self.waiting, [[] for _ in self.tiers], 0
        for k, tier in enumerate(self.tiers):
            shorter = sorted((p for more in pieces[k + 1:] for p in more), key=lambda p: len(p[2]))
            sizes = [len(p[2]) for p in shorter]
            own = sorted(pieces[k], key=lambda p: -len(p[2]))
            pieces[k:] = [[] for _ in pieces[k:]]
            open_pieces: list[tuple] = []
            while own or (open_pieces and shorter):
                window = open_pieces or [own.pop()]
                open_pieces = []
                gap = tier - sum(len(p[2]) for p in window)
                while gap and (shorter or own):
                    fits = bisect_right(sizes, gap) - 1
                    if fits >= 0:
                        sizes.pop(fits)
                        piece = shorter.pop(fits)
                    else:
                        # None fits: the largest is cut, and its rest waits for the next gap.
                        document, start, ids = shorter.pop() if shorter else own.pop(0)
                        if sizes:
                            sizes.pop()
                        piece, rest = (document, start, ids[:gap]), (document, start + gap, ids[gap:])
                        at = bisect_right(sizes, len(rest[2]))
                        if len(rest[2]):
                            shorter.insert(at, rest)
                            sizes.insert(at, len(rest[2]))
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:
                    open_pieces = window
                    break
                self.sequences.append((tier, window))
            left = open_pieces + shorter + own
            if k + 1 < len(self.tiers) and not open_pieces:
                for piece in left:
                    pieces[max(k + 1, self._tier(len(piece[2])))].append(piece)
            else:
                for piece in left:
                    self._wait(piece)
        if last:
            self._close()

    def _close(self) -> None:
        """Put all that waits into windows of the longest tier, cutting where they end."""
        longest, window, gap = self.tiers[0], [], self.tiers[0]
        for document, start, ids in [p for more in self.waiting for p in more]:
            while len(ids):
                window.append((document, start, ids[:gap]))
                start, ids, gap = start + len(window[-1][2]), ids[gap:], gap - len(window[-1][2])
                if not gap:
                    self.sequences.append((longest, window))
                    window, gap = [], longest
        if window:
            self.sequences.append((longest, window))
        self.waiting, self.count = [[] for _ in self.tiers], 0


class Steps:
    """Deals sequences to step groups: rows of one long window, or of several shorter ones."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, rows: int = ROWS_PER_STEP) -> None:
        self.longest, self.rows, self.next_row = tiers[0], rows, 0
        self.lanes = {tier: [0, 0] for tier in tiers}

    def __call__(self, tier: int) -> int:
        lane = self.lanes[tier]
        if not lane[1]:
            lane[:] = self.next_row, self.longest // tier
            self.next_row += 1
        lane[1] -= 1
        return lane[0] // self.rows


def pack_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
    vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    Columns: the document's id, ``start`` (its ids before the piece), ``length``, ``ids_crc32`` (of the
    piece's ids as little-endian 32-bit numbers), ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset`` (place in the sequence), ``tier`` (the sequence's full length), ``step`` (its step group)
    and, unless ``with_ids`` is off, ``ids``.

    A null or empty text is its end id alone; bytes that are no valid UTF-8 count as replacement characters. Repeated rows are packed once each; ids may be null, and
    other columns are ignored. An empty table gives no rows. Sequence and step numbers begin anew above
    each task's number, so a repeated task gives the same ones.
    """
    kept = docs.select(F.col(id).alias("doc_id"), raw_text(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, tier int, step long" + (", ids array<int>" if with_ids else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, deal = public_encoder(vocabulary, ranks, added=True), Packer(tiers), Steps(tiers)
        base, number = TaskContext.get().partitionId() << 40, 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            for tier, window in packer.sequences:
                step, offset = base + deal(tier), 0
                for (doc_id, tokens), start, ids in window:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                 tokens, base + number, offset, tier, step))
                    offset += len(ids)
                    if with_ids:
                        parts.append(ids)
                number += 1
            packer.sequences = []
            if rows:
                columns = [
                    pa.array(values, field.type) for values, field in zip(zip(*rows), fields)
                ]
                if with_ids:
                    ends = np.cumsum([0] + [len(p) for p in parts])
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))
                    ))
                yield pa.RecordBatch.from_arrays(columns, names)

        names = [c.split(" ")[0] for c in schema.split(", ")]
        fields: list[pa.Field] = []
        for batch in as_frame_stream(batches, 1000):
            if not fields:
                long = pa.int64()
                fields = [batch.schema.field(0), *(pa.field(n, long) for n in names[1:7]),
                          pa.field("tier", pa.int32()), pa.field("step", long)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text.decode(errors="replace")), np.uint32(END_ID))
                packer.add((doc_id, len(ids)), ids)
                if len(packer.sequences) >= 500:
                    yield from closed()
        packer.pack(last=True)
        yield from closed()

    return kept.mapInArrow(run, schema)
