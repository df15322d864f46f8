"""Text functions as column expressions, and the recursive chunker as a vectorised function."""

from __future__ import annotations

import string
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as browsers' regular expressions know it; Java's \s misses the Unicode part.
WEB_SPACE = r"[\t\n\x0B\f\r    -     　﻿]+"
#: Characters one by one: Java looks single ones up in a table, and takes some sixty times as long over ranges.
NOT_PLAIN = f"[^{string.ascii_letters}{string.digits}_ .-]+"
NOT_SPACE = f"[^{WEB_SPACE[1:-2]}]"
CHUNK_SIZE, CHUNK_OVERLAP = 400, 20


def clean_text(text: Column) -> Column:
    """White space collapsed, anything but ASCII word characters, dots and hyphens removed, trimmed, lower case.

    The order matters: removing a character between two spaces leaves both.
    """
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, WEB_SPACE, " "), NOT_PLAIN, "")))


def trimmed(text: Column) -> Column:
    """Without the white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{WEB_SPACE}|{WEB_SPACE}\z", "")


def has_text(text: Column) -> Column:
    """Whether anything but white space is there; null counts as nothing."""
    return F.coalesce(F.rlike(text, F.lit(NOT_SPACE)), F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name if there is none."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def uri_component(text: Column) -> Column:
    """Percent-encoding of a URI component: ``! ' ( ) ~ *`` stay, a space is %20."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before; one for a short text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def fixed_chunk_at(text: Column, index: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The window of that number, from 0."""
    return F.substring(text, index * (size - overlap) + 1, F.lit(size))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that the text holds.

    Pieces still too long are cut by the next separator; pieces are put together again
    while they fit, and up to ``overlap`` trailing characters of whole pieces begin the
    next chunk. Chunks are stripped and empty ones left out.
    """
    rest = separators
    while rest[0] and rest[0] not in text:
        rest = rest[1:]
    gap = rest[0]
    out: list[str] = []
    held: deque[str] = deque()

    def flush() -> None:
        if chunk := gap.join(held).strip():
            out.append(chunk)

    length = 0  # of the held pieces and the gaps between them

    def first_out() -> int:
        return len(held.popleft()) + (len(gap) if held else 0)

    for piece in text.split(gap) if gap else list(text):
        if len(piece) > size:
            flush()
            held.clear()
            length = 0
            out.extend(split_recursively(piece, size, overlap, rest[1:]))
            continue
        if held and length + len(gap) + len(piece) > size:
            flush()
            while held and (length > overlap or length + len(gap) + len(piece) > size):
                length -= first_out()
        length += len(piece) + (len(gap) if held else 0)
        held.append(piece)
    flush()
    return out


def recursive_chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    @F.pandas_udf(ArrayType(StringType()))
    def chunk(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return chunk
