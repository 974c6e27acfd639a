"""Spaced seeds: a mask of 1s (compared symbols) and 0s (ignored ones)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALID = re.compile(r"1+0[01]*1")


def is_valid_mask(mask: str) -> bool:
    """A mask starts and ends with 1 and has a 0 between."""
    return bool(_VALID.fullmatch(mask))


@dataclass(frozen=True)
class SeedMask:
    """A valid mask; anything else is a ValueError."""

    mask: str

    def __post_init__(self) -> None:
        if not is_valid_mask(self.mask):
            raise ValueError(f"invalid seed mask: {self.mask!r}")

    @classmethod
    def from_bytes(cls, flags: bytes) -> SeedMask:
        return cls("".join("1" if b else "0" for b in flags))

    @cached_property
    def positions(self) -> list[int]:
        """Offsets of the compared symbols."""
        return [i for i, c in enumerate(self.mask) if c == "1"]

    @cached_property
    def differences(self) -> list[int]:
        """Ignored symbols before each compared one."""
        return [p - i for i, p in enumerate(self.positions)]

    @property
    def weight(self) -> int:
        return len(self.positions)

    @property
    def span(self) -> int:
        return len(self.mask)

    def runs(self) -> list[tuple[int, int]]:
        """(offset, length) of each run of 1s."""
        out, at = [], 0
        for c, g in groupby(self.mask):
            n = len(list(g))
            if c == "1":
                out.append((at, n))
            at += n
        return out

    def span_of(self, common: int) -> int:
        """Symbols spanned by so many compared symbols in common: the offset after the last of them that is still certain."""
        if common <= 0:
            return 0
        return self.positions[common] if common < self.weight else self.span

    def project(self, query: str, most: int = 0) -> str:
        """The compared symbols of a query, at most so many; what lies beyond the mask is ignored."""
        kept = "".join(query[p] for p in self.positions if p < len(query))
        return kept[:most] if most else kept

    def key(self, text: Column, start: Column, most: int = 0) -> Column:
        """The compared symbols of the suffix of a BINARY ``text`` at 0-based ``start``."""
        parts, left = [], most or self.weight
        for at, n in self.runs():
            if left <= 0:
                break
            parts.append(F.substring(text, start + (at + 1), F.lit(min(n, left))))
            left -= n
        return F.concat(*parts)

    def __str__(self) -> str:
        return self.mask
