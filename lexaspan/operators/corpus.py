"""Sequences as a relation: normalisation, offsets in the joined text, and what follows each sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaspan.functions.mask import SeedMask
from lexaspan.functions.symbols import DELIMITER, DNA, SENTINEL, normalised_bytes, slice_of, symbol_at
from lexaspan.runtime import materialise, shuffle_partitions

IN_PART = (1 << 33) - 1
#: Symbols of a sequence that are enumerated at once.
PIECE = 1 << 16


@dataclass(frozen=True)
class BuildOptions:
    """How an index orders suffixes. ``max_query_len`` 0 means whole suffixes.

    ``scope`` 'text' joins the sequences by the delimiter, ends them with the
    sentinel and lets keys run on; 'sequence' ends keys with their sequence, which
    needs no knowledge of neighbours.
    """

    is_dna: bool = False
    allow_ambiguity: bool = False
    ignore_softmask: bool = False
    max_query_len: int = 0
    seed_mask: str | None = None
    delimiter: str = DELIMITER
    scope: str = "text"

    def __post_init__(self) -> None:
        if self.seed_mask and self.max_query_len:
            raise ValueError("max_query_len and seed_mask exclude each other")
        if self.scope not in ("text", "sequence"):
            raise ValueError(f"scope: {self.scope}")
        if len(self.delimiter.encode()) != 1:
            raise ValueError("the delimiter must be one byte")
        if self.seed_mask:
            SeedMask(self.seed_mask)

    @property
    def mask(self) -> SeedMask | None:
        return SeedMask(self.seed_mask) if self.seed_mask else None

    @property
    def reach(self) -> int:
        """Symbols a key may look at."""
        return self.mask.span if self.mask else self.max_query_len


def running_offsets(rows: DataFrame, order: list[str], weight: str, tag: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``number`` (0, 1, ...) and ``offset`` (sum of ``weight`` before) in ``order``.

    Range partitions are summed apart; only their totals, a row each, meet in one window.
    """
    n = partitions or shuffle_partitions(rows.sparkSession)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    table = materialise(placed, tag).withColumn("part_", F.shiftright("at_", 33))
    totals = table.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.sum(weight).alias("w_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n0_"), F.coalesce(F.sum("w_").over(before), F.lit(0)).alias("w0_"))
    inside = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    return (
        table.withColumn("in_", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(F.broadcast(totals), "part_")
        .withColumn("number", F.col("n0_") + F.col("at_").bitwiseAND(F.lit(IN_PART)))
        .withColumn("offset", F.col("w0_") + F.col("in_"))
        .drop("part_", "at_", "in_", "n0_", "w0_")
    )


def sequences(rows: DataFrame, options: BuildOptions, seq_id: str = "seq_id", seq_name: str | None = "seq_name", data: str = "bytes") -> DataFrame:
    """``(seq_id, seq_name, seq_start, seq_len, bytes)`` in order of ``seq_id``, normalised.

    ``data`` may be BINARY or STRING (taken as its UTF-8 bytes). Null data is an
    empty sequence; a null name is the id. Start offsets count the delimiters
    between. Ids must be unique; null ids come first.
    """
    kind = dict(rows.dtypes)[data]
    raw = F.col(data) if kind == "binary" else F.encode(F.col(data), "UTF-8")
    name = F.coalesce(F.col(seq_name).cast("string"), F.col(seq_id).cast("string")) if seq_name else F.col(seq_id).cast("string")
    own = rows.select(
        F.col(seq_id).cast("bigint").alias("seq_id"),
        name.alias("seq_name"),
        F.coalesce(normalised_bytes(raw, options.ignore_softmask), F.lit(b"")).alias("bytes"),
    ).withColumn("seq_len", F.length("bytes").cast("bigint"))
    placed = running_offsets(own.withColumn("w_", F.col("seq_len") + 1), ["seq_id"], "w_", "sequences").drop("w_")
    return placed.select("seq_id", "seq_name", F.col("offset").alias("seq_start"), "seq_len", "bytes", "number")


def with_surroundings(seqs: DataFrame, options: BuildOptions) -> DataFrame:
    """Add ``own`` (the sequence and its delimiter or sentinel) and ``halo`` (what follows).

    Each round doubles how far the halos reach, until all hold ``reach`` - 1 symbols
    or the text ends; sequences longer than that need one round.
    """
    seqs = seqs if "number" in seqs.columns else running_offsets(seqs, ["seq_start"], "seq_len", "numbered").drop("offset")
    if options.scope == "sequence":
        return seqs.withColumn("own", F.col("bytes")).withColumn("halo", F.lit(b""))
    last = seqs.agg(F.max("number")).first()[0]
    seqs = seqs.withColumn("own", F.concat("bytes", F.when(F.col("number") == (last if last is not None else -1), F.lit(SENTINEL.encode())).otherwise(F.lit(options.delimiter.encode()))))
    need = max(options.reach - 1, 0)
    if not need or last is None:
        return seqs.withColumn("halo", F.lit(b""))
    heads = materialise(seqs.select("number", slice_of(F.col("own"), F.lit(0), need).alias("head")), "heads")
    step, full = 1, False
    while not full and step <= last:
        further = heads.select((F.col("number") - step).alias("number"), F.col("head").alias("more"))
        heads = materialise(heads.join(further, "number", "left").select("number", slice_of(F.concat("head", F.coalesce("more", F.lit(b""))), F.lit(0), need).alias("head")), "heads")
        step *= 2
        full = heads.filter((F.length("head") < need) & (F.col("number") <= last - step)).isEmpty()
    halo = heads.select((F.col("number") - 1).alias("number"), F.col("head").alias("halo"))
    return seqs.join(halo, "number", "left").withColumn("halo", F.coalesce("halo", F.lit(b"")))


def suffix_rows(placed: DataFrame, options: BuildOptions, keep: list[str] | None = None, spread: int = 0) -> DataFrame:
    """One row for each indexed position: ``(pos, seq_id, seq_pos, key)`` and the columns in ``keep``.

    DNA indexes hold A, C, G, T and the sentinel only, unless ambiguity is allowed.
    ``spread`` deals the pieces of sequences out over so many partitions first,
    which a few very long sequences need; it moves the text once.
    """
    n = options.reach
    if not n:
        raise ValueError("whole suffixes have no bounded key; see full_sort")
    # long sequences are cut into pieces that hold what their last keys look at
    first = F.col("piece") * PIECE
    pieces = placed.filter(F.length("own") > 0).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.length("own") - 1) / PIECE).cast("int"))).alias("piece"))
    inside = first + PIECE + n <= F.length("own")
    looked = F.when(inside, F.substring("own", first + 1, F.lit(PIECE + n))).otherwise(F.concat(F.substring("own", first + 1, F.lit(PIECE + n)), "halo"))
    pieces = pieces.select(
        "seq_id", (F.col("seq_start") + first).alias("start_"), first.cast("bigint").alias("first_"), looked.alias("looked_"), F.least(F.length("own") - first, F.lit(PIECE)).alias("n_"), *(keep or [])
    )
    if spread:
        pieces = pieces.repartition(spread, "seq_id", "first_")
    at = F.col("at_")
    rows = pieces.select("*", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("at_"))
    if options.is_dna and not options.allow_ambiguity:
        rows = rows.filter(symbol_at(F.col("looked_"), at).isin(*[F.lit(c.encode()) for c in DNA]))
    key = options.mask.key(F.col("looked_"), at) if options.mask else slice_of(F.col("looked_"), at, n)
    return rows.select((F.col("start_") + at).alias("pos"), "seq_id", (F.col("first_") + at).alias("seq_pos"), key.alias("key"), *(keep or []))
