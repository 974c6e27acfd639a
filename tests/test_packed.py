"""The packed index: its rows against those of a stored index, and disorder planted in it."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scan import on_disk
from test_whole import against_sql

from lexaspan.functions.symbols import normalised
from lexaspan.operators import packed
from lexaspan.operators.corpus import BuildOptions, sequences
from lexaspan.operators.index import SuffixIndex
from lexaspan.plans import substrings

DATA = Path("/root/testdata/sf0.001")
TEXTS = [(5, "ANANAS AND BANANAS AND ANANAS"), (1, "BANANA"), (2, ""), (3, None), (4, "A\0B\0"), (6, "BANANA"), (-7, "ééA"), (8, "A" * 90), (9, "bananas and ananas")]
OPTIONS = [{"max_query_len": 16}, {"max_query_len": 5}, {"max_query_len": 8}, {"max_query_len": 12, "is_dna": True}]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(TEXTS, "seq_id long, text string").repartition(3)


@pytest.fixture(params=["small", "as set"])
def sizes(request, monkeypatch):
    if request.param == "small":
        for name, n in (("LOT", 9), ("BLOCK", 4), ("SAMPLE", 4), ("RANGE", 8), ("THIN", 1)):
            monkeypatch.setattr(packed, name, n)
    return 7 if request.param == "small" else packed.CHUNK


def upper():
    table = np.arange(256, dtype=np.uint8)
    table[97:123] -= 32
    return table


def key(k0, k1):
    return bytes(c - 1 for c in (int(k0) << 64 | int(k1)).to_bytes(16, "big").rstrip(b"\0"))


def kept_slices(monkeypatch):
    """The blocks of every slice, as they were before they were dropped."""
    kept = []
    ends = packed.slice_ends
    monkeypatch.setattr(packed, "slice_ends", lambda blocks: kept.append(sorted(blocks.filter("p >= 0").collect(), key=lambda r: (r.p, r.block))) or ends(blocks))
    return kept


@pytest.mark.parametrize("options", OPTIONS)
def test_rows_are_those_of_an_index(spark, corpus, options, sizes, monkeypatch):
    o = BuildOptions(scope="sequence", **options)
    index = SuffixIndex.build(sequences(corpus, o, "seq_id", None, "text"), o)
    want = [(bytes(r.key), r.seq_id, r.seq_pos, r.lcp) for r in index.suffixes().orderBy("rank").collect()]
    kept = kept_slices(monkeypatch)
    seqs = corpus.select(F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "seq_id")
    assert packed.violations(seqs, o, upper(), slices=3, chunk=sizes) == 0
    got, first = [], []
    for r in (r for rows in kept for r in rows):
        first += [r.block == 0] + [False] * (r.n - 1)
        got += [(key(a, b), s, p, n) for a, b, s, p, n in zip(*(c.tolist() for c in packed.block_rows(r.groups, r.n, r.least, bytes(r.data))))]
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(kept) > 1
    assert all(a[3] == b[3] for a, b, f in zip(got, want, first) if not f or b[3] == 0)


def changed(block, edit):
    columns = list(packed.block_rows(block.groups, block.n, block.least, bytes(block.data)))
    edit(columns)
    k0, k1, seq, at, lcp = columns
    data = packed._planes(k0, k1, np.ones(block.n, np.uint32), (seq - block.least).view(np.uint64), at.astype(np.uint32), lcp)
    return (block.p, block.block, block.n, block.n, block.least, data)


def swapped(i, j, which=range(4)):
    def edit(columns):
        for c in (columns[k] for k in which):
            c[[i, j]] = c[[j, i]]

    return edit


def lower_lcp(columns):
    columns[4][2] -= 1


@pytest.mark.parametrize("spot, edit", [("key", swapped(0, 1)), ("tie", swapped(1, 2, [2, 3])), ("lcp", lower_lcp), ("block", None), ("range", None), ("lost", None)])
def test_planted_disorder_is_found(spark, monkeypatch, spot, edit):
    """Within a block, across blocks, ranges and slices, and a block that is lost."""
    monkeypatch.setattr(packed, "BLOCK", 16)
    o = BuildOptions(max_query_len=16, scope="sequence")
    texts = [(i, "BANANA AND ANANAS") for i in range(40)] if spot != "key" else [(1, "".join(random.Random(1).choices("ABCDEFGH", k=400)))]
    seqs = spark.createDataFrame(texts, "seq_id long, text string").select(F.col("text").cast("binary").alias("bytes"), "seq_id")
    assert packed.violations(seqs, o, slices=2) == 0
    ends, done = packed.slice_ends, []

    def planted(blocks):
        rows = sorted(blocks.filter("p >= 0").collect(), key=lambda r: (r.p, r.block))
        if done or not rows or (edit and rows[0].n < 3):
            return ends(blocks)
        done.append(spot)
        rows = [tuple(r) for r in rows] if not edit else [changed(rows[0], edit), *map(tuple, rows[1:])]
        if spot == "lost":
            rows = rows[1:]
        elif spot == "range":  # all of a slice gets what its last block has
            rows[0] = (*rows[0][:2], *rows[-1][2:])
        elif spot == "block":
            rows[-1] = (*rows[-1][:2], *rows[0][2:])
        return ends(spark.createDataFrame(rows, packed.BLOCKS))

    monkeypatch.setattr(packed, "slice_ends", planted)
    assert packed.violations(seqs, o, slices=2) > 0 and done


@pytest.mark.parametrize("stored", [False, True])
def test_symbols_are_those_of_the_documents(spark, tmp_path, stored):
    text = "".join(map(chr, range(1, 0x250))) + "é日本語🙂 á\r\n\t~\x7f$%az{" * 3
    spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "🙂")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = substrings._STORED.set(stored)
    try:
        table = substrings.document_symbols()
        rows = substrings.docs(spark, str(tmp_path)).select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("b")).orderBy("doc_id").collect()
    finally:
        substrings._STORED.reset(before)
    import pyarrow as pa

    raw = pa.array([None, text, None, "", "🙂"])[1:]
    assert packed.recoded(raw, table).to_pylist() == [bytes(r.b) for r in rows]


def test_no_suffixes(spark):
    seqs = spark.createDataFrame([(1, b""), (2, b"")], "seq_id long, bytes binary").select("bytes", "seq_id")
    assert packed.violations(seqs, BuildOptions(max_query_len=16, scope="sequence")) == 0


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["index_is_sorted", "index_is_sorted_stored"])
def test_the_check_of_documents_leaves_no_index(spark, name, monkeypatch):
    before, most = on_disk(spark), []
    ends = packed.slice_ends
    monkeypatch.setattr(packed, "slice_ends", lambda blocks: most.append(on_disk(spark) - before) or ends(blocks))
    got, want = against_sql(spark, name)
    assert got == want and want
    assert len(most) == packed.SLICES and on_disk(spark) == before
    assert max(most) < 2 * sum(most) / packed.SLICES
