"""Command line: create, count, locate, extract, list, summarize and check an index."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lexaspan.operators import listing, render, search
from lexaspan.operators.corpus import BuildOptions, sequences
from lexaspan.operators.index import SuffixIndex
from lexaspan.operators.sampled import SampledIndex
from lexaspan.sources.fasta import query_list, read_sequences


logger = logging.getLogger("lexaspan")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexaspan", description=__doc__)
    p.add_argument("--master", help="Spark master (default: the session's own, or all local cores)")
    p.add_argument("--threads", type=int, help="cores of a local run")
    p.add_argument("--log", choices=["error", "warn", "info", "debug"], default="error", help="what is logged")
    p.add_argument("--log-file", help="file for the messages of the command (default: the error stream)")
    sub = p.add_subparsers(dest="command", required=True)

    create = sub.add_parser("create", aliases=["cr"], help="build an index of a FASTA or FASTQ file")
    create.add_argument("file")
    create.add_argument("--output", help="folder of the index (default: the file's name with .index)")
    create.add_argument("--partitions", type=int)
    create.add_argument("--max-query-len", type=int, default=0)
    create.add_argument("--seed-mask")
    create.add_argument("--delimiter", default="%")
    create.add_argument("--dna", action="store_true")
    create.add_argument("--allow-ambiguity", action="store_true")
    create.add_argument("--ignore-softmask", action="store_true")

    for name, alias, text in (("count", "co", "count queries"), ("locate", "lo", "positions of queries"), ("extract", "ex", "queries with their context")):
        s = sub.add_parser(name, aliases=[alias], help=text)
        s.add_argument("index")
        s.add_argument("query", nargs="+", help="a query, or a file of queries")
        s.add_argument("--max-query-len", type=int)
        s.add_argument("--sampled", action="store_true", help="look queries up in a kept sub-sample of that length")
        s.add_argument("--output")
        if name == "locate":
            s.add_argument("--absolute", action="store_true", help="positions in the joined text, by rank")
        if name == "extract":
            s.add_argument("--prefix-len", type=int)
            s.add_argument("--suffix-len", type=int)
            s.add_argument("--clamped", action="store_true", help="end contexts with their sequence")

    ls = sub.add_parser("list", aliases=["ls"], help="suffixes by rank")
    ls.add_argument("index")
    ls.add_argument("ranks", nargs="*", help="such as 1,3-5")
    ls.add_argument("--rank", action="store_true")
    ls.add_argument("--suffix", action="store_true")
    ls.add_argument("--lcp", action="store_true")
    ls.add_argument("--len", type=int)
    ls.add_argument("--number", type=int, default=0)
    ls.add_argument("--output")
    for name, alias in (("summarize", "su"), ("check", "ch")):
        sub.add_parser(name, aliases=[alias]).add_argument("index")
    return p


def _emit(lines: DataFrame, column: str, output: str | None) -> None:
    """Lines in order, streamed through the driver a partition at a time."""
    rows: Iterable[str] = (r[column] for r in lines.select(column).toLocalIterator())
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.writelines(r + "\n" for r in rows)
    else:
        for r in rows:
            print(r)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run one command; how long it took is logged at level info."""
    began = time.time()
    code = _run(spark, args)
    logger.info("%s took %.3f s", args.command, time.time() - began)
    return code


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    command = args.command[:2]
    if command == "cr":
        options = BuildOptions(args.dna, args.allow_ambiguity, args.ignore_softmask, args.max_query_len, args.seed_mask, args.delimiter)
        output = args.output or os.path.splitext(os.path.basename(args.file))[0] + ".index"
        SuffixIndex.build(sequences(read_sequences(spark, args.file), options), options, output, os.path.basename(args.file), args.partitions)
        print(output)
        return 0
    index = SuffixIndex(spark, args.index)
    if command == "su":
        width = max(len(n) for n, _ in render.summary(index))
        for name, value in render.summary(index):
            print(f"{name:{width}}  " + value.replace("\n", "\n" + " " * (width + 2)))
        return 0
    if command == "ch":
        bad = listing.disorder(index).count()
        print("sorted" if not bad else f"{bad} neighbours out of order")
        return int(bad > 0)
    if command in ("ls", "li"):
        ranks = [r for text in args.ranks for r in listing.parse_rank_ranges(text)]
        for r in listing.invalid_ranks(index, ranks):
            print(f"Invalid rank: {r}", file=sys.stderr)
        rows = listing.list_rows(index, ranks, args.number, args.len)
        _emit(render.list_lines(rows, index.text_len, args.rank, args.suffix, args.lcp), "line", args.output)
        return 0
    queries = query_list(spark, args.query)
    if command == "co":
        counted = SampledIndex(index, args.max_query_len).count(queries) if args.sampled else search.count(index, queries, args.max_query_len)
        _emit(render.count_lines(counted), "line", args.output)
        return 0
    hits = SampledIndex(index, args.max_query_len).search(queries) if args.sampled else search.search(index, queries, args.max_query_len)
    for r in search.missing(hits, queries).orderBy("query_num").toLocalIterator():
        print(f"{r.query} not found", file=sys.stderr)
    if command == "lo":
        located = search.located(index, hits)
        lines = render.locate_absolute_lines(located) if args.absolute else render.locate_blocks(located)
        _emit(lines, "line" if args.absolute else "block", args.output)
    else:
        mode = "clamped" if args.clamped else "compat"
        _emit(render.extract_fasta(search.extracted(index, hits, args.prefix_len, args.suffix_len, mode)), "record", args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("lexaspan")
    if args.master or args.threads:
        builder = builder.master(args.master or f"local[{args.threads}]")
    logging.basicConfig(filename=args.log_file, level=args.log.upper(), format="%(asctime)s %(levelname)s %(message)s")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(args.log.upper())
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
