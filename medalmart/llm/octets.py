"""Texts as bytes: words without a copy of the whole text, numbers of rows that outlive a task."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
# Layout of row numbers: the partition above the low 33 bits, the place in it below.
PLACE_BITS = 33


def octets(text: Column) -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def word_lists(text: bytes, table: bytes | None = None, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words between blanks, in lists of about ``size`` bytes; no word is cut.

    ``table`` first maps every byte to one byte.
    """
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            piece = text[start:end]
            piece = piece.translate(table) if table else piece
            last = max(piece.rfind(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if last >= 0:
                yield piece[:last].split()
                start += last + 1
                continue
            # One word fills the piece: it goes on to the next blank.
            end = _word_end(text, end, table, size)
        piece = text[start:end]
        yield (piece.translate(table) if table else piece).split()
        start = end


def _word_end(text: bytes, at: int, table: bytes | None, size: int) -> int:
    while at < len(text):
        piece = text[at : at + size]
        found = _BLANK.search(piece.translate(table) if table else piece)
        if found:
            return at + found.start()
        at += size
    return len(text)


def row_numbers() -> Iterator[int]:
    """Numbers for the rows of a task, apart from those of all other tasks of its stage."""
    at = TaskContext.get().partitionId() << PLACE_BITS
    while True:
        yield at
        at += 1
