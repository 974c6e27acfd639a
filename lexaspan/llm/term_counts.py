"""Frequency of every distinct value or term (problem 1).

Tasks count terms within each record and add up what they hold before anything
moves. The partial counts are radix partitioned by bits of their hash: the upper
bits name the partition of the shuffle, and a partition of more bytes than a leaf
may hold is split by the lower ones into files in the shared folder, again and
again, until DuckDB aggregates each leaf within a fixed memory limit.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.runtime import local_path, scratch_path, ship, shuffle_partitions, spread

PARTIAL = "field string, term string, occurrences bigint, holders bigint"
_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("holders", pa.int64())])
_LETTERS = regex.compile(r"\p{L}+")


class LetterRuns:
    """The lower-case letter runs of each blank-separated piece, remembered."""

    def __init__(self, keep: int = 200_000) -> None:
        self.keep, self.of = keep, {}

    def count(self, text: str) -> dict[str, int]:
        if len(self.of) > self.keep:
            self.of.clear()
        known, found = self.of, {}
        for piece, n in Counter(text.split(" ")).items():
            runs = known.get(piece)
            if runs is None:
                runs = tuple(r.lower() for r in _LETTERS.findall(piece))
                if len(piece) < 64:
                    known[piece] = runs
            for r in runs:
                found[r] = found.get(r, 0) + n
        return found


def _partial(field: str, occ: dict[str, int], held: dict[str, int], step: int = 50_000) -> Iterator[pa.RecordBatch]:
    terms = list(occ)
    for a in range(0, len(terms), step):
        some = terms[a : a + step]
        yield pa.RecordBatch.from_arrays(
            [pa.array([field] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([occ[t] for t in some], pa.int64()), pa.array([held[t] for t in some], pa.int64())],
            schema=_SCHEMA,
        )


def letter_run_counts(texts: DataFrame, text: str, field: str, hold: int = 200_000) -> DataFrame:
    """Partial counts of the letter runs of ``text``, one record a row.

    ``holders`` of the term '' counts the records with non-null text. Null texts
    hold nothing, empty ones no term. ``hold`` bounds the terms in a task's memory.
    """
    ship(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, occ, held = LetterRuns(), {}, {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(a, 256).to_pylist():
                    if t is None:
                        continue
                    held[""] = held.get("", 0) + 1
                    occ[""] = held[""]
                    for term, n in runs.count(t).items():
                        occ[term] = occ.get(term, 0) + n
                        held[term] = held.get(term, 0) + 1
                    if len(occ) >= hold:
                        yield from _partial(field, occ, held)
                        occ, held = {}, {}
        yield from _partial(field, occ, held)

    return spread(texts.select(text)).mapInArrow(run, PARTIAL)


def value_counts(rows: DataFrame, value: str, holder: list[str], part: list[str], field: str, hold: int = 200_000) -> DataFrame:
    """Partial counts of whole values: what each task holds of a value.

    ``holder`` names the record a value counts once in, ``part`` the element
    within it; rows that share holder and part are one element. Null and empty
    values count for no term; the term '' counts all holders.
    """
    own = rows.select(*[F.col(c).alias(f"h{i}") for i, c in enumerate(holder)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(part)], F.col(value).alias("v"))
    h, p = [f"h{i}" for i in range(len(holder))], [f"p{i}" for i in range(len(part))]
    each = own.groupBy(*h, *p).agg(F.min("v").alias("v"))
    values = each.filter("v IS NOT NULL AND v <> ''").groupBy(*h, "v").agg(F.count(F.lit(1)).alias("n")).select("v", "n")
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task holds of each value; hot values leave it once, not once a holder."""
        occ, held = {}, {}
        for batch in batches:
            for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                occ[v] = occ.get(v, 0) + n
                held[v] = held.get(v, 0) + 1
            if len(occ) >= hold:
                yield from _partial(field, occ, held)
                occ, held = {}, {}
        yield from _partial(field, occ, held)

    values = values.mapInArrow(run, PARTIAL)
    n = own.select(*h).distinct().agg(F.count(F.lit(1)).alias("holders"))
    return values.unionByName(n.select(F.lit(field).alias("field"), F.lit("").alias("term"), F.col("holders").alias("occurrences"), "holders"))


class _Leaves:
    """DuckDB within a memory limit, one for a task; made when the first leaf comes."""

    def __init__(self, memory_mb: int, folder: str) -> None:
        self.memory_mb, self.folder, self.con = memory_mb, folder, None

    def add_up(self, source) -> Iterator[pa.RecordBatch]:
        import duckdb

        if self.con is None:
            self.con = duckdb.connect()
            path = local_path(self.folder)
            # what a leaf can't hold goes beside the files, or nowhere: never to a folder of the machine
            self.con.execute(f"SET threads = 1; SET memory_limit = '{self.memory_mb}MB'; SET temp_directory = '{path + '-duckdb' if path else ''}'")
        self.con.register("leaf", source)
        got = self.con.sql("SELECT field, term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(holders) AS BIGINT) AS holders FROM leaf GROUP BY field, term")
        yield from (getattr(got, "to_arrow_reader", None) or got.fetch_arrow_reader)(50_000)
        self.con.unregister("leaf")

    def close(self) -> None:
        if self.con is not None:
            self.con.close()


def radix_aggregate(batches: Iterable[pa.RecordBatch], folder: str, leaf_bytes: int, bits: int, memory_mb: int) -> Iterator[pa.RecordBatch]:
    """Sum one radix partition; beyond ``leaf_bytes`` split it by ``bits`` further bits of ``h``."""
    leaves = _Leaves(memory_mb, folder)
    try:
        yield from _split(batches, folder, leaf_bytes, bits, leaves, 0)
    finally:
        leaves.close()


def _split(batches: Iterable[pa.RecordBatch], folder: str, leaf_bytes: int, bits: int, leaves: _Leaves, level: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import dataset, fs, parquet

    it, held, n = iter(batches), [], 0
    for b in it:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n > leaf_bytes:
            break
    if not held:
        return
    if n <= leaf_bytes:
        yield from leaves.add_up(pa.Table.from_batches(held))
        return
    disk, base = fs.FileSystem.from_uri(folder)
    base = f"{base}/{uuid.uuid4().hex}"
    disk.create_dir(base)
    fan, writers, size = 1 << bits, {}, Counter()
    try:
        for b in chain(held, it):
            bucket = ((b.column("h").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(level * bits)) & np.uint64(fan - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ordered, at = b.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(fan + 1))
            for k in np.flatnonzero(np.diff(at)).tolist():
                some = ordered.slice(int(at[k]), int(at[k + 1] - at[k]))
                if k not in writers:
                    writers[k] = parquet.ParquetWriter(f"{base}/{k}.parquet", b.schema, filesystem=disk, compression="zstd")
                writers[k].write_batch(some)
                size[k] += some.nbytes
        held = []
        for w in writers.values():
            w.close()
        for k in writers:
            source = dataset.dataset(f"{base}/{k}.parquet", filesystem=disk)
            if size[k] <= leaf_bytes or (level + 2) * bits > 40:
                yield from leaves.add_up(source)
            else:
                yield from _split(source.to_batches(batch_size=65_536), folder, leaf_bytes, bits, leaves, level + 1)
            disk.delete_file(f"{base}/{k}.parquet")
    finally:
        disk.delete_dir(base)


def term_frequencies(partials: list[DataFrame], leaf_bytes: int = 1 << 20, bits: int = 4, memory_mb: int = 256, partitions: int | None = None) -> DataFrame:
    """Occurrences and holders of every distinct term over all ``partials``.

    Rows: ``(field, term, occurrences, holders)``; the term '' of a field holds
    the number of its records. Empty inputs give that row at most. ``leaf_bytes``
    bounds what is aggregated at once; the result doesn't depend on it.
    """
    spark = partials[0].sparkSession
    ship(spark)
    folder = scratch_path(spark, "radix")
    rows = partials[0]
    for p in partials[1:]:
        rows = rows.unionByName(p)
    hashed = rows.withColumn("h", F.xxhash64("field", "term"))
    n = partitions or shuffle_partitions(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from radix_aggregate(batches, folder, leaf_bytes, bits, memory_mb)

    upper = F.shiftrightunsigned("h", 40)  # splits go on with the 40 bits below
    return hashed.repartitionById(n, (upper % n).cast("int")).mapInArrow(run, PARTIAL)
