"""FASTA and FASTQ files as sequences; query lists; text sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspan.operators.corpus import running_offsets


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, seq_name, bytes)`` of a FASTA or FASTQ file or folder, numbered in file order.

    Splits of a file keep their order, as they are ordered by file, offset and line.
    The kind is told by the first character. Lines of a record are joined; the name
    is the header up to the first white space, or, where that is empty, the
    record's number counted from 1, plus 1. An empty or missing file is an error.
    """
    first = spark.read.text(path).filter("length(trim(value)) > 0").limit(1).collect()
    if not first:
        raise ValueError(f"no sequence in {path}")
    mark = first[0].value.lstrip()[:1]
    if mark not in (">", "@"):
        raise ValueError(f"neither FASTA nor FASTQ: {path}")
    rows = (_fasta if mark == ">" else _fastq)(spark, path)
    numbered = running_offsets(rows.withColumn("one_", F.lit(1)), ["file", "block", "line"], "one_", "records")
    name = F.when(F.col("name") != "", F.col("name")).otherwise((F.col("number") + 2).cast("string"))
    return numbered.select(F.col("number").alias("seq_id"), name.alias("seq_name"), F.encode("seq", "UTF-8").alias("bytes"))


def _name(header) -> F.Column:
    return F.regexp_extract(header, r"^(\S*)", 1)


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    """A record is what lies between two ``>`` that begin a line."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^>", "").alias("v"))
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*", ""), r"\s", "")
    return records.filter("length(trim(v)) > 0").select("file", "block", "line", _name(F.col("v")).alias("name"), body.alias("seq"))


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines each, counted in each file apart.

    Blank lines at the end of a file are none. A record whose first line doesn't begin
    with ``@`` or whose third doesn't begin with ``+``, or whose qualities don't go
    with its symbols, ends the read with an error, as a file that was cut does.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("v"))
    numbered = running_offsets(lines.withColumn("one_", F.lit(1)), ["file", "block", "line"], "one_", "lines")
    ends = numbered.groupBy("file").agg(F.min("number").alias("first"), F.max(F.when(F.col("v") != "", F.col("number"))).alias("last"))  # a row a file
    own = numbered.join(ends, "file").filter(F.col("number") <= F.col("last")).withColumn("k", F.col("number") - F.col("first"))
    pick = lambda n: F.max(F.when(F.col("k") % 4 == n, F.col("v")))
    four = own.groupBy("file", F.lit(0).alias("block"), F.floor(F.col("k") / 4).alias("line")).agg(pick(0).alias("head"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("quality"))
    seq = F.coalesce("seq", F.lit(""))
    sound = F.col("head").startswith("@") & F.coalesce(F.col("plus").startswith("+"), F.lit(False)) & (F.length(seq) == F.length(F.coalesce("quality", F.lit(""))))
    checked = F.when(sound, seq).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.coalesce("head", F.lit("")), F.lit(" in "), F.col("file"))).cast("string"))
    return four.select("file", "block", "line", _name(F.substring("head", 2, 1 << 30)).alias("name"), checked.alias("seq"))


def query_list(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """``(query_num, query)``: an argument that names a file stands for its white-space separated words, any other for itself."""
    out: list[str] = []
    for a in arguments:
        if os.path.isfile(a):
            with open(a, encoding="utf-8") as f:
                out += f.read().split()
        else:
            out.append(a)
    return spark.createDataFrame(list(enumerate(out)), "query_num int, query string")


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """A folder of text files, in the order of ``lines``."""
    lines.select(column).write.mode("errorifexists").text(path)
