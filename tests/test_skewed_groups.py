import random
from collections import defaultdict

from lexaspan.operators.skewed_groups import grouped_order_stats


def brute(rows):
    by = defaultdict(set)
    for k, v, i in rows:
        if k is not None:
            by[k].add((v, i))
    out = {}
    for k, own in by.items():
        full = sorted((x for x in own if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        mid = full[(len(full) + 1) // 2 - 1] if full else (None, None)
        out[k] = (len(own), len(full), sum(x[0] for x in full) if full else None, *mid)
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, v, i, "x", 1) for k, v, i in rows], "k int, v long, i long, at string, n_rows int")
    got = {r.k: (r.n_rows, r.n_values, r.total, r.mid_value, r.mid_id) for r in grouped_order_stats(df, "k", "v", "i", **options).collect()}
    assert got == brute(rows)


def test_skew_ties_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7] * 6 + [None, 1, 2, 3, rng.randrange(50)]), rng.choice([None, 0, 0, 5, rng.randrange(100)]), i) for i in range(3000)]
    rows += rows[:200]
    check(spark, rows, partitions=5)
    check(spark, rows, partitions=5, broadcast_keys=0)


def test_one_key_and_small_inputs(spark):
    check(spark, [(1, 4, i) for i in range(100)], partitions=4)
    check(spark, [(1, None, 3), (2, None, 4), (2, 9, None), (2, 9, 1)])
    assert grouped_order_stats(spark.createDataFrame([], "k int, v long, i long"), "k", "v", "i").count() == 0
