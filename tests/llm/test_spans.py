import random

import numpy as np
import pytest

from lexaspan.llm import spans
from lexaspan.llm.spans import SharedAutomaton, anchors, sequence_bounds, shared_shares, shared_spans

SCHEMA = "index_id long, text string, sequence_starts array<long>, sequence_names array<string>, record string, anchor int"


def brute(rows, span):
    owner, seqs = {}, {}
    for i, text, starts, *_ in rows:
        if text is not None and i is not None:
            for j, (b, e) in enumerate(sequence_bounds(len(text), starts, text.endswith("$"))):
                seqs[i, j] = text[b:e]
    for k, s in seqs.items():
        for p in range(len(s) - span + 1):
            owner.setdefault(s[p : p + span], set()).add(k)
    out = set()
    for (i, j), s in seqs.items():
        hit = [False] * len(s)
        for p in range(len(s) - span + 1):
            if len(owner[s[p : p + span]]) > 1:
                hit[p : p + span] = [True] * span
        edge = [0, *[int(h) for h in hit], 0]
        begins = [p for p in range(len(s)) if edge[p + 1] > edge[p]]
        ends = [p + 1 for p in range(len(s)) if edge[p + 2] < edge[p + 1]]
        out |= {(i, j, a, b) for a, b in zip(begins, ends)}
    return out


def texts(seed, span):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(span - 2, 3 * span))) for _ in range(6)] + ["N" * (span * 2), "AB" * span]
    rows = []
    for i in range(14):
        seqs = []
        for _ in range(rng.randrange(5)):
            s = "".join(rng.choice([rng.choice(pool), "".join(rng.choice("ACGT") for _ in range(rng.randrange(span))), ""]) for _ in range(4))
            seqs.append(s)
        starts, at = [], 0
        for s in seqs:
            starts.append(at)
            at += len(s) + 1
        rows.append((i, "%".join(seqs) + "$", starts, [f"s{j}" for j in range(len(seqs))], "x", 1))
    rows.append((50, None, None, None, None, None))
    rows.append((51, pool[0] + "$", None, None, None, None))
    rows.append((52, "é" * span + pool[1], [0], [None], None, None))
    rows.append((None, pool[0], [0], None, None, None))
    return rows


@pytest.mark.parametrize("seed, span, limit, piece", [(1, 12, 500, 1 << 16), (2, 48, 500, 64), (3, 20, 1, 7)])
def test_against_brute_force(spark, monkeypatch, seed, span, limit, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    rows = texts(seed, span)
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = [tuple(r) for r in shared_spans(df, span=span, group_limit=limit, hot=20 if limit == 1 else 50_000).collect()]
    want = brute(rows, span)
    assert len(got) == len(set(got)) and set(got) == want
    if seed == 1:
        shares = {(r.index_id, r.seq_no): r for r in shared_shares(df, spark.createDataFrame(sorted(want), "index_id long, seq_no long, span_start long, span_end long")).collect()}
        covered = {k: sum(b - a for i, j, a, b in want if (i, j) == k) for k in shares}
        assert {k: r.covered for k, r in shares.items()} == covered
        assert all(0 <= r.share <= 1 for r in shares.values())


def test_equal_stretches_share_an_anchor():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 4, 30)
    a = np.concatenate([rng.integers(0, 4, 100), common, rng.integers(0, 4, 70)])
    b = np.concatenate([rng.integers(0, 4, 33), common, rng.integers(0, 4, 20)])
    (_, pa, ha), (_, pb, hb) = anchors(a, [(0, 200)], 30, 3), anchors(b, [(0, 83)], 30, 3)
    assert {h for p, h in zip(pa, ha) if 100 <= p <= 122} & {h for p, h in zip(pb, hb) if 33 <= p <= 55}
    assert len(anchors(np.zeros(10_000, np.int64), [(0, 10_000)], 48, 4)[0]) < 1500
    both = anchors(np.concatenate([a, [9], b]), [(0, 200), (200, 200), (201, 284)], 30, 3)
    assert set(both[0].tolist()) == {0, 2} and both[1].max() < 200 and both[1][both[0] == 2].max() < 83


def test_automaton_knows_who_holds_what():
    m = SharedAutomaton()
    m.add("abcabx", (1, 1, 0, 0))
    m.add("zabcaz", (2, 2, 0, 0))
    m.add("qqqq", (1, 1, 3, 3))
    m.add("qqqq", (1, 1, 3, 3))
    m.finish()
    assert m.shared("abcabx", 3) == [(0, 4)] and m.shared("zabcaz", 3) == [(1, 5)] and m.shared("qqqq", 2) == []


def test_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], SCHEMA)).count() == 0
