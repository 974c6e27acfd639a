import random
import re
from collections import defaultdict

from lexaspan.llm.ledger import Ledger, copy_pairs, hidden_duplicates

SCHEMA = "seq_id long, seq_name string, bytes binary, batch string, n long, key string"


def canonical(name, data):
    letters = re.sub(rb"[^A-Za-z]", b"", data or b"").upper()
    return (letters, tuple(sorted(f.upper() for f in re.findall(r"[A-Za-z0-9]+", name or "")))) if letters else None


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        core = rng.choice([b"ACGT", b"TTTT", b"GATTACA", b"", b"K" * 200])
        data = b"".join(rng.choice([b"", b" ", b"\n", b"7", b"\xff"]) + (bytes([c]) if rng.random() < 0.5 else bytes([c]).lower()) for c in core)
        name = rng.choice([None, "a|B", "b a", "B/A", "a a", "", "é|", "aé"])
        rows.append((i, name, rng.choice([data, data, None]) if rng.random() < 0.1 else data, rng.choice(["x", "y", None]), 3, "clash"))
    rows += rows[:30]
    rows.append((None, "a", b"AC", "x", 0, ""))
    sets = defaultdict(set)
    for i, name, data, *_ in rows:
        if i is not None and (k := canonical(name, data)):
            sets[k].add(i)
    records, ledger = hidden_duplicates(spark.createDataFrame(rows, SCHEMA), "seq_id", "bytes", "seq_name", rounds=3)
    assert sorted((r.first_id, r.n) for r in ledger.collect()) == sorted((min(s), len(s)) for s in sets.values())
    want = {(min(s), i) for s in sets.values() for i in s if i != min(s)}
    for heavy in (10_000, 5):
        got = [tuple(r) for r in copy_pairs(records, ledger, heavy).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_batches_add_up(spark):
    ledger = Ledger(spark, buckets=2)
    ledger.add(spark.createDataFrame([(b"k", 5), (b"k", 9), (b"m", 2)], "key binary, id long"))
    ledger.add(spark.createDataFrame([(b"k", 3), (b"z", 1)], "key binary, id long"))
    ledger.add(spark.createDataFrame([], "key binary, id long"))
    assert {bytes(r.key): (r.n, r.first_id) for r in ledger.table().collect()} == {b"k": (3, 3), b"m": (1, 2), b"z": (1, 1)}


def test_only_touched_buckets_are_written_and_a_ledger_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger = Ledger(spark, path, buckets=64)
    rows = [(f"key{i}".encode(), i) for i in range(500)]
    assert ledger.add(spark.createDataFrame(rows, "key binary, id long"), "first") > 60
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    again = Ledger(spark, path)
    assert again.add(spark.createDataFrame(rows, "key binary, id long"), "first") == 0
    assert again.add(spark.createDataFrame([(b"key7", 900), (b"key7", 901), (b"key7", 901)], "key binary, id long"), "second") == 1
    now = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert len(set(now) - set(stamps)) == 1 and len(set(stamps) - set(now)) == 1 and all(now[p] == stamps[p] for p in set(now) & set(stamps))
    got = {bytes(r.key): (r.n, r.first_id) for r in Ledger(spark, path).table().collect()}
    assert got == {k: ((3, 7) if i == 7 else (1, i)) for k, i in rows}
    assert len(list((tmp_path / "ledger/manifest").iterdir())) == 1


def test_an_id_in_two_batches_is_an_error(spark):
    import pytest

    rows = [(1, "a", b"AC", b, 0, "") for b in ("x", "y", "z", "w")]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        hidden_duplicates(df, "seq_id", "bytes", "seq_name", "batch", rounds=16)
    assert [(r.first_id, r.n) for r in hidden_duplicates(df, "seq_id", "bytes", "seq_name", rounds=2)[1].collect()] == [(1, 1)]


def test_empty_table(spark):
    records, ledger = hidden_duplicates(spark.createDataFrame([], SCHEMA), "seq_id", "bytes", "seq_name", rounds=2)
    assert ledger.count() == 0 and copy_pairs(records, ledger).count() == 0
