"""All core queries and their SQL by name."""

from __future__ import annotations

from lexaspan.plans import problems, substrings

QUERIES = {**substrings.QUERIES, **problems.QUERIES}
SQL = {**substrings.SQL, **problems.SQL}
