"""Text output in the established line formats, as string columns."""

from __future__ import annotations

import textwrap
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.operators.index import SuffixIndex


def count_lines(counts: DataFrame) -> DataFrame:
    """``query count`` in order of the queries."""
    return counts.select("query_num", F.format_string("%s %d", "query", "count").alias("line")).orderBy("query_num")


def locate_lines(located: DataFrame) -> DataFrame:
    """``(query_num, sequence_name, line)``: a line ``name p1,p2`` for each query and sequence, by name and position."""
    each = located.groupBy("query_num", "query", "sequence_name").agg(F.sort_array(F.collect_list("sequence_position")).alias("p"))
    joined = F.concat_ws(",", F.transform("p", lambda x: x.cast("string")))
    return each.select("query_num", "query", "sequence_name", F.concat_ws(" ", "sequence_name", joined).alias("line"))


def locate_blocks(located: DataFrame) -> DataFrame:
    """A block for each query that was found: the query, its lines and ``//``."""
    lines = locate_lines(located).groupBy("query_num", "query").agg(F.array_sort(F.collect_list(F.struct("sequence_name", "line"))).alias("l"))
    text = F.concat_ws("\n", F.col("query"), F.concat_ws("\n", F.transform("l", lambda x: x["line"])), F.lit("//"))
    return lines.select("query_num", text.alias("block")).orderBy("query_num")


def locate_absolute_lines(located: DataFrame) -> DataFrame:
    """``query p1 p2 ...`` in rank order for each query that was found."""
    each = located.groupBy("query_num", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "suffix"))).alias("p"))
    places = F.concat_ws(" ", F.transform("p", lambda x: x["suffix"].cast("string")))
    return each.select("query_num", F.concat_ws(" ", "query", places).alias("line")).orderBy("query_num")


def extract_fasta(extracted: DataFrame) -> DataFrame:
    """``>name:start-end query offset`` and the text, in order of query and rank."""
    head = F.format_string(">%s:%d-%d %s %d", "sequence_name", "range_start", "range_end", "query", "suffix_offset")
    return extracted.select("query_num", "rank", F.concat_ws("\n", head, "text").alias("record")).orderBy("query_num", "rank")


def list_lines(rows: DataFrame, text_len: int, rank: bool = False, suffix: bool = False, lcp: bool = False) -> DataFrame:
    """Rows of ``listing.list_rows`` as lines; numbers are padded to the digits of the text length."""
    width = len(str(text_len))
    shown = [F.lpad(F.col(c).cast("string"), width, " ") for c, on in (("rank", rank), ("suffix", suffix), ("lcp", lcp)) if on]
    return rows.select("ordinal", F.concat_ws(" ", *shown, "text").alias("line")).orderBy("ordinal")


def summary(index: SuffixIndex, wrap: int = 40, names: int | None = None) -> list[tuple[str, str]]:
    """The name and value rows of an index, with the starts and names of all sequences, or of the first ``names``.

    The starts and names pass through the driver a partition at a time and are kept
    as the text that is shown.
    """
    m = index.metadata
    own = index.sequences().orderBy("seq_start").select("seq_start", "seq_name")
    starts, called = [], []
    for r in (own if names is None else own.limit(names)).toLocalIterator():
        starts.append(str(r.seq_start))
        called.append(r.seq_name)
    shown = lambda xs: "\n".join(textwrap.wrap(", ".join(xs), wrap))
    last = ("Seed mask", m["seed_mask"]) if m["seed_mask"] else ("Max query len", f"{m['max_query_len']:,}")
    size, written = index.size_and_time()
    return [
        ("Filename", m["filename"]),
        ("Modified", time.strftime("%Y-%m-%d %H:%M", time.localtime(written))),
        ("File Size", f"{size:,} bytes"),
        ("File Version", str(m["file_version"])),
        ("DNA", str(m["is_dna"]).lower()),
        ("Allow Ambiguity", str(m["allow_ambiguity"]).lower()),
        ("Ignore Softmask", str(m["ignore_softmask"]).lower()),
        ("Text Length", f"{m['text_len']:,}"),
        ("Len Suffixes", f"{m['len_suffixes']:,}"),
        last,
        ("Num sequences", f"{m['num_sequences']:,}"),
        ("Sequence starts", shown(starts)),
        ("Sequence names", shown(called)),
    ]
