import random
from collections import Counter

import pytest
import regex

from lexaspan.llm.term_counts import letter_run_counts, radix_aggregate, term_frequencies, value_counts


def result(df):
    rows = df.collect()
    assert len({(r.field, r.term) for r in rows}) == len(rows)
    return {(r.field, r.term): (r.occurrences, r.holders) for r in rows}


def test_words_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "Straße STRASSE  x1y_z", "a" * 70_000 + " b", "é ΟΔΟΣ\nİx"]
    texts += [" ".join(rng.choice(["the", "The", "cat,dog", "x-y", "3", "q" * rng.randrange(1, 30)]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, term string, holders int").repartition(4)
    want, held = Counter(), Counter()
    for t in texts:
        if t is not None:
            own = Counter(w.lower() for w in regex.findall(r"\p{L}+", t))
            want.update(own)
            held.update(own.keys())
    n = sum(t is not None for t in texts)
    for leaf, hold in ((1 << 20, 200_000), (600, 30)):
        got = result(term_frequencies([letter_run_counts(df, "text", "text", hold)], leaf_bytes=leaf, bits=1))
        assert got.pop(("text", "")) == (n, n)
        assert got == {("text", w): (c, held[w]) for w, c in want.items()}


def test_values_count_once_a_holder(spark):
    rows = [(1, 0, "A"), (1, 0, "A"), (1, 1, "A"), (2, 0, "A"), (2, 1, None), (2, 2, ""), (3, 0, " a"), (None, 0, "A")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "request_id long, query_num int, query string, term string")
    for hold, leaf in ((200_000, 1 << 20), (1, 1)):
        got = result(term_frequencies([value_counts(df, "query", ["request_id"], ["query_num"], "query", hold)], leaf_bytes=leaf))
        assert got == {("query", "A"): (4, 3), ("query", " a"): (1, 1), ("query", ""): (4, 4)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string")
    assert result(term_frequencies([letter_run_counts(df, "text", "text")])) == {}
    q = spark.createDataFrame([], "request_id long, query_num int, query string")
    assert result(term_frequencies([value_counts(q, "query", ["request_id"], ["query_num"], "query")])) == {("query", ""): (0, 0)}


def test_one_value_beyond_all_splits(tmp_path):
    """Rows of one hash can't be split; DuckDB takes them as one leaf."""
    import pyarrow as pa

    one = pa.RecordBatch.from_pydict({"field": ["t"] * 50, "term": ["x"] * 50, "occurrences": pa.array([2] * 50, pa.int64()), "holders": pa.array([1] * 50, pa.int64()), "h": pa.array([-7] * 50, pa.int64())})
    out = list(radix_aggregate([one] * 4, f"file://{tmp_path}/r", 100, 8, 64))
    assert [b.to_pylist() for b in out] == [[{"field": "t", "term": "x", "occurrences": 400, "holders": 200}]]
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_partitions_beyond_a_leaf_go_through_files(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import parquet

    files = []
    real = parquet.ParquetWriter
    monkeypatch.setattr(parquet, "ParquetWriter", lambda where, *a, **k: (files.append(where), real(where, *a, **k))[1])
    rng = random.Random(4)
    terms = [f"t{rng.randrange(3000)}" for _ in range(20_000)]
    h = [hash((t, 1)) for t in terms]
    rows = pa.RecordBatch.from_pydict({"field": ["t"] * len(terms), "term": terms, "occurrences": pa.array([1] * len(terms), pa.int64()), "holders": pa.array([1] * len(terms), pa.int64()), "h": pa.array(h, pa.int64())})
    for leaf, levels in ((1 << 30, 0), (200_000, 1), (20_000, 2)):
        files.clear()
        out = [r for b in radix_aggregate([rows.slice(a, 500) for a in range(0, 20_000, 500)], f"file://{tmp_path}/r", leaf, 4, 64) for r in b.to_pylist()]
        assert {r["term"]: r["occurrences"] for r in out} == Counter(terms) and len(out) == len(set(terms))
        assert (len(files) > 16) == (levels == 2) and (len(files) > 0) == (levels > 0)


@pytest.mark.parametrize("name", ["p1_found", "p1_counts", "p3_found", "p3_counts"])
def test_queries_against_sql(spark, name):
    from pathlib import Path

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    import duckdb

    from lexaspan.llm import catalogue

    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert Counter(tuple(r) for r in catalogue.QUERIES[name](spark, str(data)).select(*names).collect()) == Counter(cur.fetchall())
