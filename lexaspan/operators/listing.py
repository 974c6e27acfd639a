"""Listing an index by rank, checking it, and runs of a symbol."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaspan.functions.symbols import common_prefix
from lexaspan.operators.index import SuffixIndex
from lexaspan.operators.search import BROADCAST_QUERIES, text_ranges
from lexaspan.runtime import ship


def parse_rank_ranges(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of a list such as ``1,3-5``, whose ends are included.

    Signs, empty parts, other characters and ranges that don't rise are a ValueError.
    """
    out: list[tuple[int, int]] = []
    for part in text.split(","):
        ends = part.split("-")
        if len(ends) > 2 or not all(e.isascii() and e.isdigit() for e in ends):
            raise ValueError(f"illegal list value: {part!r}")
        numbers = [int(e) for e in ends]
        if len(numbers) == 2 and numbers[0] >= numbers[1]:
            raise ValueError(f"the first number of a range must be lower: {part!r}")
        out.append((numbers[0], numbers[-1] + 1))
    return out


def parse_ranks(text: str) -> list[int]:
    """The ranks of such a list one by one."""
    return [r for a, b in parse_rank_ranges(text) for r in range(a, b)]


def _as_ranges(ranks: list) -> list[tuple[int, int]]:
    return [r if isinstance(r, tuple) else (r, r + 1) for r in ranks]


def list_rows(index: SuffixIndex, ranks: list | None = None, number: int | None = None, length: int | None = None) -> DataFrame:
    """``(ordinal, rank, suffix, lcp, text)``: all rows, the first ``number`` (0 or none is all)
    or the given ranks (numbers or half-open ranges) in the order asked for, repeats kept;
    ranks beyond the index give no row. Only the rows asked for are read."""
    if ranks:
        known, at, asked = [], 0, []
        for a, b in _as_ranges(ranks):
            if a < (end := min(b, index.len_suffixes)):
                known.append((a, end))
                asked.append((at, a, end))
            at += b - a
        table = index.spark.createDataFrame(asked, "first_ bigint, begin_ bigint, end_ bigint")
        each = table.select("first_", "begin_", F.explode(F.sequence("begin_", F.col("end_") - 1)).alias("rank"))
        each = each.select((F.col("first_") + F.col("rank") - F.col("begin_")).alias("ordinal"), "rank")
        few = sum(b - a for a, b in known) <= BROADCAST_QUERIES
        rows = index.at_ranks(known).join(F.broadcast(each) if few else each, "rank")
    else:
        rows = index.at_ranks([(0, min(number, index.len_suffixes))]) if number else index.suffixes()
        rows = rows.withColumn("ordinal", F.col("rank"))
    rows = rows.select("ordinal", "rank", F.col("pos").alias("suffix"), "lcp")
    end = F.lit(index.text_len)
    if length is not None:
        end = F.least(F.col("suffix") + length, end)
    return text_ranges(index, rows.withColumn("to_", end), "suffix", "to_", ["ordinal"]).drop("to_")


def invalid_ranks(index: SuffixIndex, ranks: list) -> list[int]:
    """The asked ranks that lie beyond the index, the first 1,000 of each range."""
    n = index.len_suffixes
    return [r for a, b in _as_ranges(ranks) for r in range(max(a, n), min(b, max(a, n) + 1000))]


def disorder(index: SuffixIndex) -> DataFrame:
    """``(pos, pos_before)`` of neighbours out of order, or whose stored common prefix is wrong: none in a sound index.

    Neighbours within a stored partition and those across its ends are both held
    against each other by key, then position. Whole suffixes are also held against
    the text: where all positions are indexed, two neighbours must differ in their
    first symbol or what follows them must have the same order; elsewhere they must
    differ, in the right order, right behind their stored common prefix.
    """
    rows = index.stored().withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy("part").orderBy("at")
    rows = rows.select("part", "pos", "key", "lcp", F.lag("key").over(w).alias("key_before"), F.lag("pos").over(w).alias("pos_before")).filter("key_before IS NOT NULL")
    ends = index.spark.read.parquet(f"{index.path}/parts")
    by_part = Window.orderBy("part")  # a row for each partition
    over = ends.select(
        "part", F.col("first_pos").alias("pos"), F.col("first_key").alias("key"), F.col("first_lcp").alias("lcp"),
        F.lag("last_key").over(by_part).alias("key_before"), F.lag("last_pos").over(by_part).alias("pos_before"),
    ).filter("key_before IS NOT NULL")
    pairs = rows.unionByName(over)
    wrong = F.col("key") < F.col("key_before")
    if width := index.options.mask.weight if index.options.mask else index.options.max_query_len:
        tie = (F.col("key") == F.col("key_before")) & (F.col("pos") > F.col("pos_before"))
        return pairs.filter(wrong | tie | (F.col("lcp") != common_prefix(F.col("key"), F.col("key_before"), width))).select("pos", "pos_before")
    bad = pairs.filter(wrong).select("pos", "pos_before")
    if index.len_suffixes == index.text_len:
        ranked = index.suffixes().select("rank", "pos", F.substring("key", 1, 1).alias("c"))
        after = ranked.select((F.col("pos") - 1).alias("pos"), F.col("rank").alias("next"))
        each = ranked.join(after, "pos", "left").fillna(-1, ["next"])
        before = each.select((F.col("rank") + 1).alias("rank"), F.col("pos").alias("pos_before"), F.col("c").alias("c_before"), F.col("next").alias("next_before"))
        deep = each.join(before, "rank").filter((F.col("c") < F.col("c_before")) | ((F.col("c") == F.col("c_before")) & (F.col("next") <= F.col("next_before"))))
        return bad.unionByName(deep.select("pos", "pos_before"))
    ranked = index.suffixes().select("rank", "pos", "lcp")
    both = ranked.join(ranked.select((F.col("rank") + 1).alias("rank"), F.col("pos").alias("pos_before")), "rank")
    at = both.select("rank", "pos", "pos_before", (F.col("pos") + F.col("lcp")).alias("x"), (F.col("pos_before") + F.col("lcp")).alias("y"))
    seen = text_ranges(index, at.withColumn("x_", F.least(F.col("x") + 1, F.lit(index.text_len))), "x", "x_", ["rank"]).withColumnRenamed("text", "x_text")
    seen = text_ranges(index, seen.withColumn("y_", F.least(F.col("y") + 1, F.lit(index.text_len))), "y", "y_", ["rank"])
    return bad.unionByName(seen.filter(F.encode("x_text", "ISO-8859-1") <= F.encode("text", "ISO-8859-1")).select("pos", "pos_before"))


def symbol_runs(seqs: DataFrame, symbol: str = "N", least: int = 1000) -> DataFrame:
    """``(seq_id, run_start, run_end)`` of the runs of ``least`` or more of one symbol.

    Found within each text from the edges of its runs, vectorised over Arrow batches;
    an empty or null text has none.
    """
    ship(seqs.sparkSession)
    code = ord(symbol)
    kind = next(f.dataType for f in seqs.schema if f.name == "seq_id").simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, begins, ends = [], [], []
            for k, x in enumerate(batch.column(1)):
                if not x.is_valid or len(text := np.frombuffer(x.as_buffer(), np.uint8)) < least:
                    continue
                edge = np.flatnonzero(np.diff((text == code).view(np.int8), prepend=0, append=0))
                a, b = edge[::2], edge[1::2]
                long = b - a >= least
                if long.any():
                    owner.append(np.full(int(long.sum()), k))
                    begins.append(a[long])
                    ends.append(b[long])
            if owner:
                cols = [batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(begins)), pa.array(np.concatenate(ends))]
                yield pa.RecordBatch.from_arrays(cols, names=["seq_id", "run_start", "run_end"])

    return seqs.select("seq_id", "bytes").mapInArrow(run, f"seq_id {kind}, run_start bigint, run_end bigint")
