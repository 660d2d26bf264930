"""Column expressions over sequence text and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter whose pure runs carry no information, the character that fills a
# window running past the end of its reference, and the mark of a header line.
UNKNOWN_LETTER = "N"
FILL = " "
HEADER_MARK = ">"


def normalize(text: Column, keep_lines: bool = False) -> Column:
    """Upper-case ASCII text.

    Non-ASCII characters go first, so that upper-casing can never lengthen the text. Line ends
    are removed as well, unless ``keep_lines`` is set (then only carriage returns are).
    """
    junk = r"[^\x00-\x7F]|\r" if keep_lines else r"[^\x00-\x7F]|[\r\n]"
    return F.upper(F.regexp_replace(text, junk, ""))


def text_lines(text: Column) -> Column:
    """Array of the normalised, non-blank lines of ``text``."""
    return F.array_remove(F.split(normalize(text, keep_lines=True), "\n"), "")


def block_of(position: Column, size: int) -> Column:
    """Number of the fixed-size block that holds ``position`` (rounds down, also below zero)."""
    return F.floor(position / F.lit(size)).cast("long")


def starts(length: Column, window: int, step: int) -> Column:
    """Start positions ``0, step, 2*step, …`` of windows that fit into ``length`` characters.

    Empty when not even one window fits; ``sequence`` alone would count downwards there. The
    guard sits inside the expression because a filter would be pushed below the projection
    that prepares the text and evaluate it a second time.
    """
    none = F.array().cast("array<int>")
    return F.when(
        length >= window, F.sequence(F.lit(0), length - F.lit(window), F.lit(step))
    ).otherwise(none)


def cut(body: Column, start: Column, length: Column | int) -> Column:
    """Slice of ``body`` beginning at the 0-based ``start``.

    Give binary data: slicing a string costs time linear in the position, slicing bytes does not.
    """
    size = length if isinstance(length, Column) else F.lit(length)
    return F.substring(body, start + F.lit(1), size)


def is_uninformative(seq: Column, k: int) -> Column:
    """True for the k-mer made of the unknown letter only."""
    return seq == F.lit(UNKNOWN_LETTER * k)
