"""Expressions over sequences of one-byte symbols (BINARY), without UDFs."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the text format.
DELIMITER, SENTINEL = "%", "$"
DNA = ("A", "C", "G", "T", SENTINEL)


def normalised(text: Column, soft_mask: bool = False) -> Column:
    """ASCII letters in upper case; with ``soft_mask`` lower-case ones become N. STRING in, STRING out."""
    return F.translate(text, string.ascii_lowercase, "N" * 26 if soft_mask else string.ascii_uppercase)


def normalised_bytes(raw: Column, soft_mask: bool = False) -> Column:
    """The same for BINARY, byte by byte."""
    return F.encode(normalised(F.decode(raw, "ISO-8859-1"), soft_mask), "ISO-8859-1")


def one_byte_text(text: Column) -> Column:
    """Text in which every character is one byte: what isn't printable ASCII, or is a delimiter or sentinel, becomes N."""
    return F.regexp_replace(text, "[^ -#&-~]", "N")


def slice_of(data: Column, start: Column, length: Column | int) -> Column:
    """``length`` symbols from 0-based ``start``, fewer at the end; ``start`` must not be negative."""
    return F.substring(data, start.cast("int") + 1, F.lit(length) if isinstance(length, int) else length.cast("int"))


def symbol_at(data: Column, at: Column) -> Column:
    return slice_of(data, at, 1)


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two BINARY slices, up to ``most``, by binary descent."""
    step, steps = 1, [1]
    while step <= most:
        steps.insert(0, step)
        step *= 2
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + F.when(F.substring(a, n + 1, s) == F.substring(b, n + 1, s), s).otherwise(0)
    )
    return F.least(found, F.length(a), F.length(b), F.lit(most))


def context_bounds(rel: Column, seq_len: Column, seq_end: Column, prefix: int | None, suffix: int | None, clamped: bool) -> tuple[Column, Column, Column]:
    """Start, end and offset of a hit's context within its sequence.

    ``clamped`` ends inside the sequence; else the end is held against the
    sequence's absolute end, as the established output format does.
    """
    start = F.greatest(rel - (prefix or 0), F.lit(0))
    limit = seq_len if clamped else seq_end
    end = F.least(rel + suffix, limit) if suffix is not None else limit
    return start, end, rel - start


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with ``prefix``; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None
