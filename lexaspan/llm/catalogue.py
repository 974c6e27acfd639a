"""Queries of the llm problems and their SQL by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspan.llm.bpe import encode_texts
from lexaspan.llm.leakage import find_leaks, find_near
from lexaspan.llm.ledger import copy_pairs, hidden_duplicates
from lexaspan.llm.spans import shared_shares, shared_spans
from lexaspan.llm.splitting import split_sequences
from lexaspan.llm.subjects import assign_subjects
from lexaspan.llm.term_counts import letter_run_counts, term_frequencies, value_counts
from lexaspan.runtime import materialise, read_table


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = value_counts(read_table(spark, sf_dir, "queries"), "query", ["request_id"], ["query_num"], "query")
    texts = letter_run_counts(read_table(spark, sf_dir, "documents"), "text", "text")
    counts = materialise(term_frequencies([queries, texts]), "terms")
    size = {r.field: r.holders for r in counts.filter("term = ''").collect()}  # a row a field
    held, in_query = F.col("holders"), F.col("field") == "query"
    mark = (
        F.when(in_query & (held == 1) | ~in_query & (held < 3), "rare")
        .when(in_query & (held > 0.02 * size.get("query", 0)) | ~in_query & (held > 0.4 * size.get("text", 0)), "common")
    )
    return counts.filter("term <> ''").withColumn("mark", mark)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and holders of every query string and every word, marked."""
    return _p1(spark, sf_dir).select("field", "term", "occurrences", "holders", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values held by too few or too many."""
    return _p1(spark, sf_dir).filter("mark IS NOT NULL").select("field", "term", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of long sequences, each cut at the last natural boundary within the limit."""
    pieces = split_sequences(read_table(spark, sf_dir, "sequence_files"), 1000, 60, "last")
    return pieces.select("file_id", "seq_no", "piece_start", "piece_end").distinct()


def p2_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of long sequences, fewest and of nearly equal length, at the strongest boundaries."""
    return split_sequences(read_table(spark, sf_dir, "sequence_files"), 1000, 60, "balanced").distinct()


def _p3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return hidden_duplicates(read_table(spark, sf_dir, "sequences"), "seq_id", "bytes", "seq_name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set of copies: its first record beside the others."""
    return copy_pairs(*_p3(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct record: its earliest representative and the number of copies."""
    return _p3(spark, sf_dir)[1].select(F.col("first_id").alias("seq_id"), F.col("n").alias("copies"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of symbols that another sequence repeats."""
    return shared_spans(read_table(spark, sf_dir, "index_texts"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sequence the number of shared spans and the share of it they cover."""
    texts = read_table(spark, sf_dir, "index_texts")
    return shared_shares(texts, shared_spans(texts))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text by byte_bpe_50k."""
    return encode_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show 12 or more consecutive words of a test item."""
    return _p7(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the longest run and the share of the item that leaked."""
    return _p7(spark, sf_dir).withColumn("share", F.round(F.col("matched") / F.col("item_words"), 6))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold many telling words of a test item close together, in any order."""
    return find_near(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects each revision is about."""
    return _p8(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents, and documents of that subject alone."""
    found = _p8(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("own"))
    each = found.select(F.explode("own").alias("subject"), (F.size("own") == 1).cast("int").alias("alone"))
    return each.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("alone").alias("alone"))


_P1 = r"""
WITH q AS (SELECT request_id, query_num, min(query) AS query FROM queries GROUP BY 1, 2),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT 'query' AS field, query AS term, count(*) AS occurrences, count(DISTINCT request_id) AS holders FROM q WHERE query <> '' GROUP BY query
  UNION ALL
  SELECT 'text', lower(w), count(*), count(DISTINCT doc_id) FROM d GROUP BY lower(w)),
m AS (
  SELECT *, CASE
    WHEN field = 'query' AND holders = 1 OR field = 'text' AND holders < 3 THEN 'rare'
    WHEN field = 'query' AND holders > 0.02 * (SELECT count(DISTINCT request_id) FROM queries) THEN 'common'
    WHEN field = 'text' AND holders > 0.4 * (SELECT count(text) FROM documents) THEN 'common' END AS mark
  FROM c)
"""
_P3 = r"""
WITH r AS (
  SELECT DISTINCT seq_id,
    upper(regexp_replace(regexp_replace(CAST(bytes AS VARCHAR), '\\x[0-9A-F][0-9A-F]', '', 'g'), '[^A-Za-z]', '', 'g')) AS letters,
    list_sort(list_transform(regexp_extract_all(coalesce(seq_name, ''), '[A-Za-z0-9]+'), lambda x: upper(x))) AS fields
  FROM sequences WHERE seq_id IS NOT NULL),
g AS (SELECT *, min(seq_id) OVER (PARTITION BY letters, fields) AS first_id FROM r WHERE letters <> '')
"""
_P2 = r"""
WITH RECURSIVE f AS (SELECT DISTINCT file_id, is_dna, decode(seq) AS t, coalesce(start_positions, [0]) AS st FROM sequence_files WHERE seq IS NOT NULL),
j AS (SELECT file_id, is_dna, t, st, unnest(range(0, len(st))) AS seq_no FROM f),
q AS (SELECT file_id, seq_no, substr(t, st[seq_no + 1] + 1, coalesce(st[seq_no + 2] - 1, length(t) - 1) - st[seq_no + 1]) AS x,
             chr(10) || chr(13) || '-' || CASE WHEN is_dna THEN 'Nn' ELSE 'Xx*' END AS stops FROM j),
l AS (SELECT file_id, seq_no, length(x) AS n, list_filter(range(1, length(x) + 1), lambda i: contains(stops, x[i]) AND (i = length(x) OR NOT contains(stops, x[i + 1]))) AS ends
      FROM q WHERE length(x) > 1000),
p AS (
  SELECT file_id, seq_no, n, ends, CAST(0 AS BIGINT) AS s, CAST(coalesce(list_max(list_filter(ends, lambda e: e > 60 AND e <= 1000)), 1000) AS BIGINT) AS e FROM l
  UNION ALL
  SELECT file_id, seq_no, n, ends, e - 60, CAST(CASE WHEN n - (e - 60) <= 1000 THEN n ELSE coalesce(list_max(list_filter(ends, lambda b: b > p.e AND b <= p.e + 940)), e + 940) END AS BIGINT)
  FROM p WHERE e < n)
SELECT file_id, seq_no, s AS piece_start, e AS piece_end FROM p
"""
_P2_BALANCED = r"""
WITH RECURSIVE f AS (SELECT DISTINCT file_id, is_dna, decode(seq) AS t, coalesce(start_positions, [0]) AS st FROM sequence_files WHERE seq IS NOT NULL),
j AS (SELECT file_id, is_dna, t, st, unnest(range(0, len(st))) AS seq_no FROM f),
q AS (SELECT file_id, seq_no, substr(t, st[seq_no + 1] + 1, coalesce(st[seq_no + 2] - 1, length(t) - 1) - st[seq_no + 1]) AS x,
             chr(10) || chr(13) || '-' || CASE WHEN is_dna THEN 'Nn' ELSE 'Xx*' END AS stops FROM j),
l AS (SELECT file_id, seq_no, length(x) AS n, list_filter(range(1, length(x) + 1), lambda i: contains(stops, x[i]) AND (i = length(x) OR NOT contains(stops, x[i + 1]))) AS ends,
             list_filter(range(1, length(x) + 1), lambda i: contains(stops, x[i]) AND (i = 1 OR NOT contains(stops, x[i - 1]))) AS begins
      FROM q WHERE length(x) > 1000),
b AS (SELECT file_id, seq_no, n, list_transform(ends, lambda e, i: [e - begins[i] + 1, e]) AS cuts, (n - 60 + 939) // 940 AS need FROM l),
p AS (
  SELECT file_id, seq_no, n, cuts, total, CAST(total AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(0 AS BIGINT) AS hard
  FROM (SELECT *, unnest(CASE WHEN (n - 60) // (need + 1) > 141 THEN [need, need + 1] ELSE [need] END) AS total FROM b)
  UNION ALL
  SELECT file_id, seq_no, n, cuts, total, k - 1, s, CASE WHEN k = 1 THEN n ELSE coalesce(best, greatest(target, low)) END, hard + CAST(k > 1 AND best IS NULL AS BIGINT)
  FROM (SELECT *, list_sort(list_transform(list_filter(cuts, lambda c: c[2] >= low AND c[2] <= high), lambda c: [-c[1], abs(c[2] - target), c[2]]))[1][3] AS best
        FROM (SELECT *, greatest(s + 61, n - (k - 1) * 940, target - 141) AS low, least(s + 1000, target + 141, n - 1) AS high
              FROM (SELECT *, s + 60 + (n - s - 60) // k AS target
                    FROM (SELECT file_id, seq_no, n, cuts, total, k, CASE WHEN e IS NULL THEN s ELSE e - 60 END AS s, hard FROM p WHERE k > 0))))),
h AS (SELECT file_id, seq_no, total, max(hard) AS hard FROM p GROUP BY ALL),
w AS (SELECT file_id, seq_no, arg_min(total, hard * 1000000 + total) AS total FROM h GROUP BY ALL)
SELECT file_id, seq_no, total - k - 1 AS piece_no, s AS piece_start, e AS piece_end FROM p JOIN w USING (file_id, seq_no, total) WHERE e IS NOT NULL
"""
_P5 = r"""
WITH x AS (SELECT index_id, any_value(text) AS t, any_value(coalesce(sequence_starts, [0])) AS st, any_value(sequence_names) AS names FROM index_texts WHERE text IS NOT NULL AND index_id IS NOT NULL GROUP BY index_id),
j AS (SELECT index_id, t, st, names, unnest(range(0, len(st))) AS seq_no FROM x),
q AS (SELECT index_id, seq_no, names[seq_no + 1] AS sequence_name, substr(t, st[seq_no + 1] + 1, coalesce(st[seq_no + 2] - 1, length(t) - CAST(ends_with(t, '$') AS INT)) - st[seq_no + 1]) AS s FROM j),
w AS (SELECT index_id, seq_no, p, substr(s, p + 1, 48) AS k FROM (SELECT *, unnest(range(0, length(s) - 47)) AS p FROM q WHERE length(s) >= 48)),
h AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT (index_id, seq_no)) > 1),
g AS (SELECT index_id, seq_no, p, CASE WHEN p <= lag(p) OVER (PARTITION BY index_id, seq_no ORDER BY p) + 48 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN h USING (k)),
r AS (SELECT index_id, seq_no, p, sum(fresh) OVER (PARTITION BY index_id, seq_no ORDER BY p) AS run FROM g),
f AS (SELECT index_id, seq_no, min(p) AS span_start, max(p) + 48 AS span_end FROM r GROUP BY index_id, seq_no, run)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_balanced": p2_balanced,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_near": p7_near,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
SQL = {
    "p2_found": _P2,
    "p2_balanced": _P2_BALANCED,
    "p5_found": _P5 + "SELECT index_id, seq_no, span_start, span_end FROM f",
    "p5_shares": _P5
    + """SELECT q.index_id, q.seq_no, q.sequence_name, length(q.s) AS symbols, count(f.span_start) AS n_spans, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS covered,
         CASE WHEN length(q.s) > 0 THEN round(coalesce(sum(span_end - span_start), 0) / length(q.s), 6) ELSE 0.0 END AS share
         FROM q LEFT JOIN f ON f.index_id = q.index_id AND f.seq_no = q.seq_no GROUP BY q.index_id, q.seq_no, q.sequence_name, q.s""",
    "p1_found": _P1 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_counts": _P1 + "SELECT field, term, occurrences, holders, mark FROM m",
    "p3_found": _P3 + "SELECT first_id AS keep_id, seq_id AS dup_id FROM g WHERE seq_id <> first_id",
    "p3_counts": _P3 + "SELECT first_id AS seq_id, count(*) AS copies FROM g GROUP BY first_id",
}
