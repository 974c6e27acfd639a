import random

import numpy as np

from lexaspan.llm.splitting import boundaries, pieces_balanced, split_sequences

SCHEMA = "file_id long, seq binary, start_positions array<long>, is_dna boolean, piece_end string, loaded_at long"


def greedy(seq, is_dna, limit, overlap):
    """The stated rule, byte by byte."""
    stops = b"\n\r-" + (b"Nn" if is_dna else b"Xx*")
    natural = [i for i in range(1, len(seq) + 1) if seq[i - 1] in stops and (i == len(seq) or seq[i] not in stops)]
    out, s = [], 0
    while True:
        if len(seq) - s <= limit:
            out.append((s, len(seq)))
            return out
        inside = [e for e in natural if s + overlap < e <= s + limit]
        e = max(inside, default=s + limit)
        out.append((s, e))
        s = e - overlap


def sample(rng, n, letters=b"ACGTN-\nX*"):
    return bytes(rng.choice(letters if rng.random() < 0.1 else b"ACGT") for _ in range(n))


def test_against_the_stated_rule(spark):
    rng = random.Random(3)
    files, want = [], set()
    for f in range(30):
        seqs = [sample(rng, rng.choice([0, 5, 50, 51, 120, 400])) for _ in range(rng.randrange(5))]
        dna = rng.choice([True, False])
        starts, at = [], 0
        for s in seqs:
            starts.append(at)
            at += len(s) + 1
        files.append((f, b"%".join(seqs) + b"$", starts, dna, "clash", f))
        for j, s in enumerate(seqs):
            if len(s) > 50:
                want |= {(f, j, a, b) for a, b in greedy(s, dna, 50, 7)}
    whole = sample(rng, 90)
    files += [(90, whole + b"$", None, None, None, 0), (91, None, None, True, None, 0), (92, b"$", [], True, None, 0), (93, b"", None, True, None, 0), (90, whole + b"$", None, None, None, 1)]
    want |= {(90, 0, a, b) for a, b in greedy(whole, None, 50, 7)}
    got = split_sequences(spark.createDataFrame(files, SCHEMA), 50, 7, "last").select("file_id", "seq_no", "piece_start", "piece_end")
    assert {tuple(r) for r in got.distinct().collect()} == want


def test_pieces_put_together_give_the_sequence(spark):
    rng = random.Random(4)
    seqs = {i: sample(rng, n) for i, n in enumerate([51, 300, 5000])}
    df = spark.createDataFrame([(i, s + b"$", [0], True, None, 0) for i, s in seqs.items()], SCHEMA)
    for placement in ("last", "balanced"):
        rows = split_sequences(df, 50, 7, placement, with_bytes=True).orderBy("file_id", "piece_no").collect()
        for i, s in seqs.items():
            own = [r for r in rows if r.file_id == i]
            assert all(r.piece_end - r.piece_start <= 50 and bytes(r.piece) == s[r.piece_start : r.piece_end] for r in own)
            assert all(b.piece_start == a.piece_end - 7 for a, b in zip(own, own[1:]))
            assert own[0].piece_start == 0 and own[-1].piece_end == len(s)


def test_balanced_pieces_are_few_and_even():
    none = np.empty(0, np.int64)
    got = pieces_balanced(2500, none, none, 1000, 60)
    assert len(got) == 3 and max(e - s for s, e in got) - min(e - s for s, e in got) <= 2
    seq = np.frombuffer(b"A" * 850 + b"NNNN" + b"A" * 20 + b"N" + b"A" * 700, np.uint8)
    ends, runs = boundaries(seq, True)
    assert pieces_balanced(len(seq), ends, runs, 1000, 60)[0] == (0, 854)  # the longer run wins over the nearer


def test_balanced_pieces_are_linear_and_within_one_of_the_fewest():
    import time

    rng = np.random.default_rng(1)
    took = {}
    for n in (100_000, 1_000_000):
        seq = np.frombuffer(b"ACGTN-", np.uint8)[rng.choice(6, n, p=[0.24, 0.24, 0.24, 0.24, 0.02, 0.02])]
        began = time.time()
        got = pieces_balanced(n, *boundaries(seq, True), 1000, 60)
        took[n] = time.time() - began
        assert -(-(n - 60) // 940) <= len(got) <= -(-(n - 60) // 940) + 1
        assert got[0][0] == 0 and got[-1][1] == n and all(60 < e - s <= 1000 for s, e in got) and all(b[0] == a[1] - 60 for a, b in zip(got, got[1:]))
    assert took[1_000_000] < 30 * max(took[100_000], 0.02)
    for n in range(3, 40):  # limits hold in the smallest cases too
        for limit, overlap in ((2, 1), (2, 0), (3, 2), (5, 1), (9, 8)):
            if n > limit:
                got = pieces_balanced(n, *boundaries(np.frombuffer(b"A-" * n, np.uint8)[:n], True), limit, overlap)
                assert got[-1][1] == n and all(overlap < e - s <= limit for s, e in got) and all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))


def test_balanced_against_sql(spark):
    from pathlib import Path

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        return
    import duckdb

    from lexaspan.llm import catalogue

    con = duckdb.connect()
    con.execute(f"CREATE VIEW sequence_files AS SELECT * FROM '{data}/sequence_files.parquet'")
    cur = con.execute(catalogue.SQL["p2_balanced"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r) for r in catalogue.p2_balanced(spark, str(data)).select(*names).collect()) == sorted(cur.fetchall())


def test_empty_table(spark):
    assert split_sequences(spark.createDataFrame([], SCHEMA)).count() == 0
