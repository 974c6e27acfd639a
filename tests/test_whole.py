"""Queries that leave nothing of their input out."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexaspan.plans.substrings import item_windows

DATA = Path("/root/testdata/sf0.001")


def against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    return Counter(tuple(r) for r in df.select(*names).collect()), Counter(cur.fetchall())


def test_windows_cover_the_item(spark):
    texts = {1: "Été " * 25 + "x", 2: "short", 3: "a" * 24, 4: "b" * 48, 5: "", 6: None}
    rows = item_windows(spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()
    assert len({r.query_num for r in rows}) == len(rows)
    for i, t in texts.items():
        seen = [None] * len(t or "")
        for r in rows:
            if r.query_num.item_id == i:
                assert r.query and len(r.query) == min(24, len(t))
                seen[r.query_num.start : r.query_num.start + len(r.query)] = r.query
        assert seen == [c.upper() if c.isascii() else c for c in t or ""]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_items_against_sql(spark):
    got, want = against_sql(spark, "count_items")
    assert got == want and any(not r[2].isascii() for r in want)


STORED = ["normalize_text", "softmask_text", "sequence_starts", "sequence_ends", "lcp_documents", "count_words", "count_index", "count_literal", "search_documents", "n_runs"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", STORED)
def test_stored_against_sql(spark, name):
    got, want = against_sql(spark, name + "_stored")
    assert got == want and want


def test_other_letters_stay_other(spark, tmp_path):
    rows = [(1, "\u00e0 la\n50 % of $5"), (2, "\u00e9 la"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in entry.queries()["normalize_text_stored"](spark, str(tmp_path)).collect()}
    assert kept == {1: "\u00e0 LA\n50 N OF N5", 2: "\u00e9 LA", 3: ""}


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_every_position_is_asked(spark):
    got, want = against_sql(spark, "string_at")
    assert got == want and sorted(p for p, _ in got) == list(range(len(got)))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["count_full", "extract_full", "count_requests", "requests_in_texts", "stream_windows"])
def test_whole_suffixes_and_requests_against_sql(spark, name):
    got, want = against_sql(spark, name)
    assert got == want and want
