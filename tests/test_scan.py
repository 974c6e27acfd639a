"""Answers from the text alone, against an index and against SQL."""

from pathlib import Path

import pytest
from test_whole import against_sql

import __spark_entry__ as entry
from lexaspan.operators import scan, search
from lexaspan.operators.corpus import BuildOptions, sequences
from lexaspan.operators.index import SuffixIndex
from lexaspan.runtime import local_path, shared_dir

DATA = Path("/root/testdata/sf0.001")
TEXTS = [(1, "BANANA"), (2, ""), (3, None), (4, "A\0B\0"), (5, "ANANAS AND BANANAS AND ANANAS"), (6, "BANANA"), (7, "ééA"), (8, "A" * 40)]
ASKED = [(0, "A"), (1, "ANANAS AND BANAN"), (2, "NAN"), (3, ""), (4, "Q"), (5, None), (6, "A\0"), (7, "é"), (8, "AAAAAAAAAAAAAAAAAAA"), (9, "BANANA"), (10, "ANANAS AND ANANAX")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(TEXTS, "seq_id long, text string").repartition(3), spark.createDataFrame(ASKED, "query_num int, query string")


def on_disk(spark):
    return sum(p.stat().st_size for p in Path(local_path(shared_dir(spark))).rglob("*.parquet"))


@pytest.mark.parametrize("options", [{"max_query_len": 16, "scope": "sequence"}, {"max_query_len": 5, "scope": "sequence"}, {"max_query_len": 16}, {"max_query_len": 12, "scope": "sequence", "is_dna": True}])
def test_ranks_are_those_of_an_index(spark, corpus, options):
    rows, asked = corpus
    o = BuildOptions(**options)
    seqs = sequences(rows, o, "seq_id", None, "text")
    want = search.rank_ranges_of(SuffixIndex.build(seqs, o), asked)
    want = sorted(map(tuple, want.collect()), key=str)
    for chunk in (7, scan.CHUNK):
        assert sorted(map(tuple, scan.ranks_in(seqs, asked, o, chunk=chunk).collect()), key=str) == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["search_documents", "search_documents_stored"])
def test_ranks_of_documents_need_no_disk(spark, name):
    before = on_disk(spark)
    got, want = against_sql(spark, name)
    assert got == want and want
    assert on_disk(spark) == before


@pytest.mark.parametrize("options", [{"max_query_len": 16, "scope": "sequence"}, {"max_query_len": 4}, {"seed_mask": "1101", "scope": "sequence"}, {"max_query_len": 12, "scope": "sequence", "is_dna": True}])
def test_hits_are_those_of_an_index(spark, corpus, options):
    rows, asked = corpus
    o = BuildOptions(**options)
    seqs = sequences(rows, o, "seq_id", None, "text")
    names = ["query_num", "query", "seq_id", "seq_pos"]
    want = sorted(map(tuple, search.search(SuffixIndex.build(seqs, o), asked).select(names).collect()), key=str)
    assert want
    for chunk in (7, scan.CHUNK):
        assert sorted(map(tuple, scan.locate_in(seqs, asked, o, chunk=chunk).select(names).collect()), key=str) == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_hits_in_documents_need_no_disk(spark, tmp_path):
    before = on_disk(spark)
    got, want = against_sql(spark, "locate_documents")
    assert got == want and want
    spark.createDataFrame([(3, "x neither the court neither the cour"), (5, "Sümmary of, summary of"), (6, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["locate_documents_stored"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, "3", 2), (0, "3", 20), (2, "5", 13)]
    assert on_disk(spark) == before


@pytest.mark.parametrize("options", [{"max_query_len": 16, "scope": "sequence"}, {"max_query_len": 5}, {"max_query_len": 12, "scope": "sequence", "is_dna": True}])
def test_prefix_lengths_are_those_of_an_index(spark, corpus, options, monkeypatch):
    rows, _ = corpus
    o = BuildOptions(**options)
    seqs = sequences(rows, o, "seq_id", None, "text")
    want = sorted(map(tuple, SuffixIndex.build(seqs, o).suffixes().groupBy("lcp").count().collect()))
    for chunk, sample in ((7, 2), (scan.CHUNK, scan.SAMPLE)):
        monkeypatch.setattr(scan, "SAMPLE", sample)
        assert sorted(map(tuple, scan.lcp_counts_in(seqs, o, chunk).collect())) == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["lcp_documents", "lcp_documents_stored"])
def test_prefix_lengths_of_documents_need_no_disk(spark, name):
    before = on_disk(spark)
    got, want = against_sql(spark, name)
    assert got == want and want
    assert on_disk(spark) == before


def test_no_suffixes_no_prefix_lengths(spark):
    o = BuildOptions(max_query_len=16, scope="sequence")
    seqs = sequences(spark.createDataFrame([(1, ""), (2, None)], "seq_id long, text string"), o, "seq_id", None, "text")
    assert scan.lcp_counts_in(seqs, o).collect() == []
