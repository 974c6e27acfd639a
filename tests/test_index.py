"""The index against published goldens and against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from lexaspan.functions.mask import SeedMask
from lexaspan.operators import listing, render, search
from lexaspan.operators.corpus import BuildOptions, sequences
from lexaspan.operators.index import SuffixIndex

# Inputs and arrays of published results, which the index must give.
ONE = [("1", "ACGTNnacgt")]
TWO = [("ABC", "ACGTacgt"), ("DEF", "acgtACGT")]
THREE = [("1", "AGCTTTTCATTCTGACTGCAACGGGCAATANNNNNNNNNNTGTCTC"), ("2", "TGTGTGGATTAAAAAAAGAGTGTC"), ("3", "TGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGTAAAT")]
ABBA = [("1", "AABABABABBABAB")]
SPACED = [("1", "AATTCTAGTCATAACGTCAATAGAGGCTCAATAATGGTGGAT")]


def build(spark, seqs, **options):
    o = BuildOptions(**options)
    rows = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, seq_name string, bytes string")
    return SuffixIndex.build(sequences(rows, o), o, name="test")


def model(seqs, is_dna=False, allow_ambiguity=False, ignore_softmask=False, max_query_len=0, seed_mask=None, delimiter="%"):
    """Suffixes, keys and common prefixes by sorting strings."""
    text = delimiter.join(s for _, s in seqs)
    text = "".join(("N" if ignore_softmask else c.upper()) if "a" <= c <= "z" else c for c in text) + "$"
    at = [i for i, c in enumerate(text) if not is_dna or allow_ambiguity or c in "ACGT$"]
    if seed_mask:
        key = lambda i: SeedMask(seed_mask).project(text[i:])
    else:
        key = lambda i: text[i : i + max_query_len] if max_query_len else text[i:]
    sa = sorted(at, key=lambda i: (key(i).encode(), -i))
    lcp = [0]
    for a, b in zip(sa, sa[1:]):
        x, y = key(a), key(b)
        lcp.append(next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
    return text, sa, lcp


def stored(index):
    rows = sorted(index.suffixes().select("rank", "pos", "lcp").collect())
    assert [r.rank for r in rows] == list(range(len(rows)))
    return [r.pos for r in rows], [r.lcp for r in rows]


@pytest.mark.parametrize(
    "seqs, options, sa, lcp",
    [
        (ONE, {"is_dna": True}, [10, 6, 0, 7, 1, 8, 2, 9, 3], [0, 0, 4, 0, 3, 0, 2, 0, 1]),
        (TWO, {"is_dna": True, "delimiter": "N"}, [17, 13, 9, 0, 4, 14, 10, 1, 5, 15, 11, 2, 6, 16, 12, 3, 7], [0, 0, 4, 8, 4, 0, 3, 7, 3, 0, 2, 6, 2, 0, 1, 5, 1]),
        (TWO, {"is_dna": True, "allow_ambiguity": True, "ignore_softmask": True}, [17, 8, 13, 0, 14, 1, 15, 2, 7, 12, 6, 11, 5, 10, 4, 9, 16, 3], None),
        (ABBA, {"max_query_len": 2}, [14, 0, 12, 10, 7, 5, 3, 1, 13, 11, 9, 6, 4, 2, 8], [0, 0, 1, 2, 2, 2, 2, 2, 0, 1, 2, 2, 2, 2, 1]),
        ([("1", "AAACAAACAAACAAAC")], {"seed_mask": "11011"}, [16, 13, 9, 5, 1, 12, 8, 4, 0, 14, 10, 6, 2, 15, 11, 7, 3], [0, 0, 2, 4, 4, 2, 3, 4, 4, 1, 2, 4, 4, 0, 1, 4, 4]),
    ],
)
def test_goldens(spark, seqs, options, sa, lcp):
    index = build(spark, seqs, **options)
    got = stored(index)
    assert got[0] == sa
    if lcp:
        assert got[1] == lcp
    assert got == model(seqs, **options)[1:]


def test_random_texts(spark):
    rng = random.Random(5)
    cases = [({"max_query_len": 5}, "AB"), ({"max_query_len": 9}, "ACGT"), ({"seed_mask": "1011"}, "ACN"), ({}, "AB"), ({"max_query_len": 3, "is_dna": True}, "ACGTN")]
    for options, letters in cases:
        seqs = [(str(i), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 7, 40])))) for i in range(9)]
        index = build(spark, seqs, **options)
        assert stored(index) == model(seqs, **options)[1:], (options, seqs)
        assert listing.disorder(index).count() == 0


@pytest.fixture(scope="module")
def three(spark):
    return build(spark, THREE, is_dna=True, max_query_len=40)


def queries(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "query_num int, query string")


def test_count(spark, three):
    q = queries(spark, "AAAAAAA", "TGTCTC", "TGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGT", "X", "", None, "acgt")
    got = {r.query_num: r["count"] for r in search.count(three, q).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: three.len_suffixes, 5: 0, 6: 0}
    assert (three.text_len, three.len_suffixes, three.metadata["num_sequences"]) == (113, 101, 3)
    assert sorted(r.query_num for r in search.missing(search.search(three, q), q).collect()) == [3, 5, 6]


@pytest.fixture(scope="module")
def whole(spark):
    return build(spark, THREE, is_dna=True)


def test_count_on_whole_suffixes(spark, whole):
    q = queries(spark, "AAAAAAA", "TGTCTC", "TGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGT", "X", "", None, "TGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGTT")
    got = {r.query_num: r["count"] for r in search.count(whole, q).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: whole.len_suffixes, 5: 0, 6: 0}


def occurrences(text, q):
    return [i for i in range(len(text)) if text.startswith(q, i)]


@pytest.mark.parametrize("options", [{}, {"is_dna": True}])
def test_queries_of_any_length_on_whole_suffixes(spark, options):
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(70))
    seqs = [("a", unit + "N" * 90 + unit[:50]), ("b", unit), ("c", "ACAC" * 30), ("d", "")]
    index = build(spark, seqs, **options)
    text, sa, lcp = model(seqs, **options)
    assert stored(index) == (sa, lcp) and listing.disorder(index).count() == 0
    asked = [text[a : a + n] for n in range(1, 65) for a in (rng.randrange(len(text) - n), len(text) - n)] + [unit[:40] + "T" * 9, "N" * 64, "AC" * 32, "ACAC" * 30 + "%$"]
    q = queries(spark, *asked)
    indexed = set(sa)
    want = {k: sorted(i for i in occurrences(text, x) if i in indexed) for k, x in enumerate(asked)}
    hits = search.search(index, q).collect()
    assert all(sa[r["rank"]] == r.pos for r in hits) and len({(r.query_num, r.pos) for r in hits}) == len(hits)
    assert {k: sorted(r.pos for r in hits if r.query_num == k) for k in want} == want
    assert {r.query_num: r["count"] for r in search.count(index, q).collect()} == {k: len(v) for k, v in want.items()}
    for x in (asked[60], "N" * 40, "AC" * 20):
        assert sorted(r.pos for r in search.search_literal(index, x).collect()) == [i for i in occurrences(text, x) if i in indexed]


def test_scans_are_pruned(spark, three):
    """Keys and ranks reach the scan as conditions."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan(three.key_ranges([(b"ACT", b"ACU")]))
    for df in (three.rank_range(3, 9), listing.list_rows(three, number=4), search.search(three, queries(spark, "ACT"))):
        assert "GreaterThanOrEqual(at," in plan(df)
    assert plan(three.rank_range(3, 9)).count("Join") == 1  # with the table of partitions


def test_many_ranges_and_fences(spark, monkeypatch):
    from lexaspan.operators import index as stored_index

    monkeypatch.setattr(stored_index, "FENCE", 4)
    monkeypatch.setattr(stored_index, "RANGES", 2)
    rng = random.Random(7)
    seqs = [(str(i), "".join(rng.choice("AB") for _ in range(40))) for i in range(6)]
    for options in ({"max_query_len": 7}, {}):
        index, (text, sa, _) = build(spark, seqs, **options), model(seqs, **options)
        asked = sorted({"".join(rng.choice("AB%") for _ in range(rng.randrange(1, 12))) for _ in range(60)})
        cut = [q[: options.get("max_query_len") or None] for q in asked]
        got = search.search(index, queries(spark, *asked)).collect()
        assert sorted((r.query_num, r.pos) for r in got) == sorted((k, i) for k, q in enumerate(cut) for i in occurrences(text, q))
        ranges = {r.query_num: (r.rank_start, r.rank_end) for r in search.rank_ranges_of(index, queries(spark, *asked)).collect()}
        for k, q in enumerate(cut):
            ranks = [r for r, i in enumerate(sa) if text.startswith(q, i)]
            assert ranges[k] == ((ranks[0], ranks[-1] + 1) if ranks else (None, None))
        assert [r.pos for r in listing.list_rows(index, [5, (0, 3), 9, 200, 5]).orderBy("ordinal").select(F.col("suffix").alias("pos")).collect()] == [sa[r] for r in (5, 0, 1, 2, 9, 200, 5)]


def test_sampled_index(spark, three, whole):
    from lexaspan.operators.sampled import SampledIndex

    text = model(THREE, is_dna=True)[0]
    for index in (three, whole):
        sampled = SampledIndex(index, 3)
        q = queries(spark, "A", "AC", "ACT", "TGTCT", "", None, "N", "GG")
        got = {r.query_num: r["count"] for r in sampled.count(q).collect()}
        assert got == {r.query_num: r["count"] for r in search.count(index, q, 3).collect()}
        hits = sorted((r.query_num, r["rank"], r.pos) for r in sampled.search(q).collect())
        assert hits == sorted((r.query_num, r["rank"], r.pos) for r in search.search(index, q, 3).collect())
        assert got[3] == len(occurrences(text, "TGT"))
    with pytest.raises(ValueError):
        SampledIndex(three, 41)


def test_planted_disorder_is_found(spark, three, whole, tmp_path):
    """Two neighbours change places, within a partition and across its end."""
    import shutil

    for index in (three, whole):
        for spot in ("inside", "across"):
            rows = index.stored().orderBy("at").collect()
            parts = [r["at"] >> 33 for r in rows]
            k = next(i for i in range(1, len(rows) - 1) if (parts[i] != parts[i - 1]) == (spot == "across"))
            rows = [r.asDict() for r in rows]
            for c in ("pos", "key", "seq_id", "seq_pos"):
                rows[k - 1][c], rows[k][c] = rows[k][c], rows[k - 1][c]
            path = str(tmp_path / f"{spot}-{index is whole}")
            shutil.copytree(index.path.removeprefix("file://"), path)
            shutil.rmtree(f"{path}/suffixes")
            spark.createDataFrame(rows, index.stored().schema).coalesce(1).write.parquet(f"{path}/suffixes")
            if spot == "across":
                ends = index.spark.read.parquet(f"{path}/parts").collect()
                ends = [r.asDict() for r in ends]
                for r in ends:
                    if r["part"] == parts[k - 1]:
                        r["last_key"], r["last_pos"] = rows[k - 1]["key"], rows[k - 1]["pos"]
                    if r["part"] == parts[k]:
                        r["first_key"], r["first_pos"] = rows[k]["key"], rows[k]["pos"]
                schema = index.spark.read.parquet(f"{path}/parts").schema
                shutil.rmtree(f"{path}/parts")
                spark.createDataFrame(ends, schema).coalesce(1).write.parquet(f"{path}/parts")
            assert listing.disorder(SuffixIndex(spark, path)).count() > 0
        assert listing.disorder(index).count() == 0


def test_common_prefixes_of_positions(spark, three):
    text = model(THREE, is_dna=True)[0]
    pairs = [(0, 88), (14, 88), (37, 40), (112, 112), (5, 500), (30, 30)]
    got = {(r.a, r.b): r.lcp for r in search.common_prefixes(three, spark.createDataFrame(pairs, "a long, b long"), 20).collect()}
    assert got == {(a, b): next((n for n in range(20) if a + n >= len(text) or b + n >= len(text) or text[a + n] != text[b + n]), 20) for a, b in pairs}


def test_counts_straight_from_the_text(spark):
    rng = random.Random(11)
    seqs = [(str(i), "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 3, 50])))) for i in range(30)]
    rows = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq_id long, seq_name string, bytes string")
    for scope in ("text", "sequence"):
        for more in ({"max_query_len": 20, "is_dna": scope == "text"}, {"seed_mask": "110101"}):
            o = BuildOptions(scope=scope, **more)
            texts = [model(seqs, **more)[0]] if scope == "text" else [s for _, s in seqs]
            asked = ["A", "AC", "N", "ACG", "$", "", None, "%", "GT%", "T%A"] + [t[a : a + n] for t in texts if len(t) > 20 for n in (2, 5, 17, 20, 30) for a in (0, len(t) - n)]
            asked = [q for q in asked if q is None or len(q) <= 40]
            want = {}
            for k, q in enumerate(asked):
                key = (lambda x: SeedMask(o.seed_mask).project(x)) if o.seed_mask else (lambda x: x[: o.max_query_len])
                cut = None if q is None else key(q)
                want[k] = sum(1 for t in texts for i in range(len(t)) if cut is not None and (not o.is_dna or t[i] in "ACGT$") and key(t[i : i + 64]).startswith(cut))
            for piece in (1 << 20, 7) if scope == "text" else (7,):
                got = {r.query_num: r["count"] for r in search.count_in(sequences(rows, o), queries(spark, *asked), o, piece=piece).collect()}
                assert got == want, (scope, more)


def test_locate(spark, three):
    q = queries(spark, "ACT", "GTT", "X")
    located = search.locate(three, q)
    assert [r.block for r in render.locate_blocks(located).collect()] == ["ACT\n1 14\n3 16\n//", "GTT\n3 20\n//"]
    assert [r.line for r in render.locate_absolute_lines(located).collect()] == ["ACT 14 88", "GTT 92"]
    arrays = {r.query_num: [p.suffix for p in r.positions] for r in search.locate_arrays(located, q).collect()}
    assert arrays == {0: [14, 88], 1: [92], 2: []}


def test_extract(spark, three):
    got = render.extract_fasta(search.extract(three, queries(spark, "ACT", "GTT"), 3, 15)).collect()
    assert [r.record for r in got] == [">1:11-29 ACT 3\nCTGACTGCAACGGGCAAT", ">3:13-31 ACT 3\nTGAACTGGTTACCTGCCG", ">3:17-35 GTT 3\nCTGGTTACCTGCCGTGAG"]
    over = search.extract(three, queries(spark, "TGTG")).select("range_start", "range_end", "text").orderBy("rank").collect()
    assert [(r.range_start, r.range_end) for r in over] == [(2, 72), (0, 72)] and over[0].text.endswith("$")
    inside = search.extract(three, queries(spark, "TGTG"), mode="clamped").select("text").collect()
    assert all(r.text.endswith("TGTC%") for r in inside)


def test_masked_search_cuts_to_compared_symbols(spark):
    index = build(spark, [("1", "RNELxRKELyRNQL".upper())], seed_mask="1011")
    got = search.locate(index, queries(spark, "RAEL", "RNELNNEEA")).collect()
    assert sorted((r.query_num, r.suffix) for r in got) == [(0, 0), (0, 5), (1, 0), (1, 5)]
    cut = search.locate(index, queries(spark, "RNEL"), max_query_len=1).collect()
    assert sorted(r.suffix for r in cut) == [0, 5, 10]


def test_list(spark):
    index = build(spark, ONE, is_dna=True)
    rows = listing.list_rows(index, length=3)
    assert [r.line for r in render.list_lines(rows, index.text_len).collect()] == ["$", "ACG", "ACG", "CGT", "CGT", "GT$", "GTN", "T$", "TNN"]
    rows = listing.list_rows(index, [8, 0, 8, 99])
    lines = [r.line for r in render.list_lines(rows, index.text_len, True, True, True).collect()]
    assert lines == [" 8  3  1 TNNACGT$", " 0 10  0 $", " 8  3  1 TNNACGT$"]
    assert listing.invalid_ranks(index, [8, 99]) == [99]
    assert listing.list_rows(index, number=3).count() == 3
    facts = dict(render.summary(index))
    assert (facts["Text Length"], facts["Len Suffixes"], facts["Num sequences"]) == ("11", "9", "1")
    assert [r.pos for r in index.rank_range(2, 4).orderBy("rank").collect()] == [0, 7]
    assert index.at_rank(3).first().pos == 7 and index.at_rank(9).count() == 0
    with pytest.raises(ValueError):
        index.rank_range(5, 20)


def test_subsample_keeps_ranks(spark):
    index = build(spark, ABBA, max_query_len=6)
    got = sorted((r.rank, r.pos) for r in index.subsample(1).collect())
    assert got == [(0, 14), (1, 0), (8, 13)]


def test_literal_search_and_stream(spark, three, tmp_path):
    from lexaspan.streaming.queries import answer_stream

    assert sorted(r.pos for r in search.search_literal(three, "ACT").collect()) == [14, 88]
    assert search.search_literal(three, "").count() == 101
    queries(spark, "ACT", "X").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_num int, query string").parquet(str(tmp_path / "in"))
    answer_stream(stream, three, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert {(r.query, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ACT", 2), ("X", 0)}


def test_empty_corpus_and_null_sequences(spark):
    assert stored(build(spark, [("a", None), (None, "AC"), ("c", "")], max_query_len=4)) == model([("a", ""), ("b", "AC"), ("c", "")], max_query_len=4)[1:]
    o = BuildOptions(max_query_len=4)
    empty = SuffixIndex.build(sequences(spark.createDataFrame([], "seq_id long, seq_name string, bytes binary"), o), o)
    assert empty.len_suffixes == 0 and empty.suffixes().count() == 0
    assert [r["count"] for r in search.count(empty, queries(spark, "A", "")).collect()] == [0, 0]


def test_symbol_runs(spark):
    rows = spark.createDataFrame([(1, b"ANNNCNN"), (2, b"NNN"), (3, None), (4, b"")], "seq_id long, bytes binary")
    got = sorted(tuple(r) for r in listing.symbol_runs(rows, "N", 3).collect())
    assert got == [(1, 1, 4), (2, 0, 3)]


def test_long_sequences_are_cut_into_pieces(spark, monkeypatch):
    from lexaspan.operators import corpus
    from lexaspan.operators import index as stored_index

    monkeypatch.setattr(corpus, "PIECE", 4)
    monkeypatch.setattr(stored_index, "LONG", 10)
    rng = random.Random(9)
    seqs = [(str(i), "".join(rng.choice("ACG") for _ in range(n))) for i, n in enumerate([0, 3, 4, 5, 23, 8, 1])]
    for options in ({"max_query_len": 6}, {"seed_mask": "1101"}):
        assert stored(build(spark, seqs, **options)) == model(seqs, **options)[1:]


def test_many_queries_go_by_shuffle(spark, three, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1)
    got = {r.query: r["count"] for r in search.count(three, queries(spark, "AC", "ACT", "TT", "ACTGAC", "Z")).collect()}
    text = model(THREE, is_dna=True)[0]
    assert got == {q: sum(text.startswith(q, i) for i in range(len(text))) for q in got}
