"""The driver contract, and the queries against their SQL on the smallest tables where they exist."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p4_found" in entry.queries() and "count_items" in entry.queries()


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["p4_found", "p4_stats", "count_items", "count_masked", "locate_rendered", "extract_context", "suffix_array_masked", "lcp_array", "n_runs"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = Counter(cur.fetchall())
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == want
