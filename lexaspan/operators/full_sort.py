"""Whole suffixes in order, by prefix doubling over what is still tied."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.functions.symbols import DNA, common_prefix, slice_of
from lexaspan.operators.corpus import BuildOptions, suffix_rows, with_surroundings
from lexaspan.runtime import materialise, ship, shuffle_partitions

#: Symbols of a whole suffix that are compared at once at first, and kept as its key.
FIRST = 32


def _equal_to_last(column: pa.Array, last: object) -> np.ndarray:
    """For each value, whether it equals the one before; the first is held against ``last``."""
    out = np.zeros(len(column), bool)
    out[1:] = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    out[0] = column[0].as_py() == last
    return out


def _runs(rows: DataFrame, levels: list[str], tag: str) -> DataFrame:
    """Sort by ``levels`` (then position, falling) and add ``g0``, ``g1``, ... and ``tied``.

    ``g<i>`` is the place, in the order of all rows, of the first row that shares the
    first i + 1 levels; ``tied`` says that another row shares all of them. Equal rows
    may fill any number of partitions: each partition is walked apart, and what runs
    over its ends is settled on a table of a row a partition.
    """
    spark = rows.sparkSession
    ship(spark)
    order = [*[F.col(c).asc() for c in levels], F.col("pos").desc()]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    added = ["i_", *[f"s{k}" for k in range(len(levels))]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last, starts, held = 0, [None] * len(levels), [0] * len(levels), None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, same, columns = np.arange(n, n + batch.num_rows), np.ones(batch.num_rows, bool), []
            for k, c in enumerate(levels):
                same = same & (_equal_to_last(batch.column(c), last[k]) if n else np.append(False, _equal_to_last(batch.column(c), None)[1:]))
                first = np.where(same, -1, at)
                first[0] = max(first[0], starts[k])
                columns.append(np.maximum.accumulate(first))
                starts[k], last[k] = int(columns[-1][-1]), batch.column(c)[-1].as_py()
            tied = same.copy()
            tied[:-1] |= same[1:]
            if held is not None:
                held[1][-1] |= same[0]
                yield _with(held, added)
            held = (batch, tied, [at, *columns])
            n += batch.num_rows
        if held is not None:
            yield _with(held, added)

    walked = placed.mapInArrow(run, f"{kind}, tied boolean, " + ", ".join(f"{c} bigint" for c in added))
    table = materialise(walked.withColumn("part_", F.spark_partition_id()), tag)
    ends = table.groupBy("part_").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*levels), "i_").alias("first"),
        F.max_by(F.struct(*levels), "i_").alias("last"),
        *[F.max(f"s{k}").alias(f"s{k}") for k in range(len(levels))],
    )
    before, carried, out, prior = 0, [0] * len(levels), [], None
    for r in sorted(ends.collect(), key=lambda r: r.part_):  # a row for each partition of the exchange
        on = [prior is not None and r.first[: k + 1] == prior[: k + 1] for k in range(len(levels))]
        first = [carried[k] if on[k] else before for k in range(len(levels))]
        if on[-1] and out:
            out[-1]["ends"] = True
        out.append({"part_": r.part_, "before": before, "n_": r.n, "begins": on[-1], "ends": False, **{f"c{k}": x for k, x in enumerate(first)}})
        carried = [before + r[f"s{k}"] if r[f"s{k}"] else first[k] for k in range(len(levels))]
        before, prior = before + r.n, tuple(r["last"])
    kinds = "part_ int, before bigint, n_ bigint, begins boolean, ends boolean, " + ", ".join(f"c{k} bigint" for k in range(len(levels)))
    parts = spark.createDataFrame([tuple(x.values()) for x in out], kinds)
    whole = table.join(F.broadcast(parts), "part_")
    places = [F.when(F.col(f"s{k}") == 0, F.col(f"c{k}")).otherwise(F.col("before") + F.col(f"s{k}")).alias(f"g{k}") for k in range(len(levels))]
    over = (F.col("begins") & (F.col("i_") == 0)) | (F.col("ends") & (F.col("i_") == F.col("n_") - 1))
    return whole.select(*rows.columns, (F.col("tied") | over).alias("tied"), *places)


def _with(held: tuple, added: list[str]) -> pa.RecordBatch:
    batch, tied, columns = held
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(tied), *[pa.array(c) for c in columns]], names=[*batch.schema.names, "tied", *added])


def full_order(placed: DataFrame, options: BuildOptions) -> DataFrame:
    """``(pos, seq_id, seq_pos, key, lcp)`` of the indexed positions, sorted by whole suffix.

    The first round sorts by ``FIRST`` symbols. Each further round compares twice as
    many, and only for the positions that are still tied: they look up the place of
    the group that begins where their known part ends. The tied groups of each round
    stay; the common prefix of neighbours is read off them from the widest round
    down, and only for neighbours that share their whole first key. ``key`` holds the
    first symbols only.
    """
    if options.scope != "text":
        raise ValueError("whole suffixes are ordered over the joined text; give max_query_len for scope 'sequence'")
    bounded = BuildOptions(max_query_len=FIRST, delimiter=options.delimiter)
    rows = suffix_rows(with_surroundings(placed.drop("own", "halo"), bounded), bounded)
    first = _runs(rows, ["key"], "first").withColumnRenamed("g0", "label")
    settled, current, width, rounds = None, first.select("pos", "label", "tied"), FIRST, []
    while not (tied := current.filter("tied").select("pos", "label")).isEmpty():
        rounds.append((width, tied))
        done = current.filter("NOT tied").select("pos", "label")
        settled = done if settled is None else settled.unionByName(done)
        ahead = settled.unionByName(tied).select((F.col("pos") - width).alias("pos"), F.col("label").alias("after"))
        pairs = tied.join(ahead, "pos", "left").fillna(-1, ["after"])
        split = _runs(pairs, ["label", "after"], "doubling")
        current = materialise(split.select("pos", (F.col("label") + F.col("g1") - F.col("g0")).alias("label"), "tied"), "labels")
        width *= 2
    last = current.select("pos", "label")
    final = last if settled is None else settled.unionByName(last)
    whole = first.drop("label", "tied").join(final, "pos") if rounds else first.drop("tied")
    if options.is_dna and not options.allow_ambiguity:
        whole = whole.filter(slice_of(F.col("key"), F.lit(0), 1).isin(*[F.lit(c.encode()) for c in DNA]))
    ordered = _neighbours(whole)
    if rounds:
        deep = _deeper(ordered.filter(F.col("lcp") >= FIRST).select("pos", "before_pos"), rounds, first.select("pos", "key"))
        ordered = ordered.join(deep, "pos", "left").withColumn("lcp", F.coalesce("deep", "lcp"))
    n = shuffle_partitions(placed.sparkSession)
    return ordered.repartitionByRange(n, "label").sortWithinPartitions("label").select("pos", "seq_id", "seq_pos", "key", F.col("lcp").cast("int").alias("lcp"))


def _neighbours(whole: DataFrame) -> DataFrame:
    """Add the position before each in order of ``label`` (unique) and the common prefix of their keys."""
    n = shuffle_partitions(whole.sparkSession)
    placed = whole.repartitionByRange(n, "label").sortWithinPartitions("label").select("pos", "seq_id", "seq_pos", "key", "label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_pos, last_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, key = batch.column("pos"), batch.column("key")
            before_pos = pa.concat_arrays([pa.array([last_pos], pa.int64()), pos.slice(0, len(pos) - 1)])
            before_key = pa.concat_arrays([pa.array([last_key], key.type), key.slice(0, len(key) - 1)])
            last_pos, last_key = pos[-1].as_py(), key[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, before_pos, before_key], names=[*batch.schema.names, "before_pos", "before_key"])

    kind = "pos bigint, seq_id bigint, seq_pos bigint, key binary, label bigint, before_pos bigint, before_key binary"
    table = materialise(placed.mapInArrow(run, kind).withColumn("part_", F.spark_partition_id()), "ordered")
    ends = table.groupBy("part_").agg(F.max_by(F.struct("pos", "key"), "label").alias("last"))
    over, prior = [], None
    for r in sorted(ends.collect(), key=lambda r: r.part_):  # a row for each partition
        over.append((r.part_, *(prior or (None, None))))
        prior = (r["last"].pos, r["last"].key)
    parts = table.sparkSession.createDataFrame(over, "part_ int, over_pos bigint, over_key binary")
    joined = table.join(F.broadcast(parts), "part_")
    before = F.coalesce("before_pos", "over_pos")
    lcp = F.coalesce(common_prefix(F.col("key"), F.coalesce("before_key", "over_key"), FIRST), F.lit(0)).cast("bigint")
    return joined.select("pos", "seq_id", "seq_pos", "key", "label", before.alias("before_pos"), lcp.alias("lcp"))


def _deeper(pairs: DataFrame, rounds: list[tuple[int, DataFrame]], heads: DataFrame) -> DataFrame:
    """``(pos, deep)``: the common prefix of the pairs that share their first key."""
    walk = pairs.select("pos", F.col("pos").alias("a"), F.col("before_pos").alias("b"), F.lit(0).cast("bigint").alias("deep"))
    for width, tied in reversed(rounds):
        walk = walk.join(tied.toDF("a", "la"), "a", "left").join(tied.toDF("b", "lb"), "b", "left")
        step = F.coalesce(F.when(F.col("la") == F.col("lb"), width), F.lit(0))
        walk = walk.select("pos", (F.col("a") + step).alias("a"), (F.col("b") + step).alias("b"), (F.col("deep") + step).alias("deep"))
        walk = materialise(walk, "walk")
    walk = walk.join(heads.toDF("a", "ka"), "a", "left").join(heads.toDF("b", "kb"), "b", "left")
    rest = F.coalesce(common_prefix(F.col("ka"), F.col("kb"), FIRST), F.lit(0))
    return walk.select("pos", (F.col("deep") + rest).alias("deep"))
