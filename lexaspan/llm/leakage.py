"""Evaluation texts leaking into training text (problem 7).

A positional inverted index of the whole corpus is stored: for each range of documents
and each term the places where it stands, in order of the term. Test items meet it as
tables. Of each window of an item the two rarest terms are looked up, their lists are
brought to the same start by their offsets and intersected by an equi-join; the
documents found are then held against their items word by word. Proximity matches come
from the lists of an item's telling words. The corpus is parsed once, however many
items there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.llm.wikitext import WordIds, visible_text, words
from lexaspan.runtime import materialise, ship, spread

HITS = "doc_id bigint, item_id bigint, longest int, matched int, item_words int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("matched", pa.int32()), ("item_words", pa.int32())])
_STORED = pa.schema([("block", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
#: A place is the number of the document within its block and, in the lower bits, the number of the word.
WORD_BITS = 32


class PositionalIndex:
    """The stored index of a corpus: ``postings`` (block, term, places) and ``documents`` (block, number, doc_id)."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, block_tokens: int = 1_500_000) -> None:
        """Parse and store; null or empty texts and null ids hold nothing. A block is as many
        documents of a task as hold ``block_tokens`` words, and one document at least."""
        ship(docs.sparkSession)

        def block(number: int, ids: list[int], parts: list[bytes], known: WordIds) -> Iterator[pa.RecordBatch]:
            tokens = np.frombuffer(b"".join(parts), np.int32)
            lengths = np.array([len(p) // 4 for p in parts])
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            place = (np.repeat(np.arange(len(ids)), lengths) << WORD_BITS) + np.arange(len(tokens)) - first
            names = list(known.vocabulary)
            present, count = np.unique(tokens, return_counts=True)
            by_name = np.array(sorted(range(len(present)), key=lambda k: names[present[k]]), np.int64)
            slot = np.empty(len(names), np.int64)
            slot[present[by_name]] = np.arange(len(present))
            place = place[np.argsort(slot[tokens], kind="stable")]
            ends = np.concatenate([[0], np.cumsum(count[by_name])])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))], schema=_STORED)
            for a in range(0, len(present), 8192):
                b = min(a + 8192, len(present))
                places = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(place[ends[a] : ends[b]]))
                cols = [pa.array(np.full(b - a, number)), pa.array([names[k] for k in present[by_name[a:b]]], pa.string()), places, pa.nulls(b - a, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, schema=_STORED)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ids, parts, size, number = WordIds(), [], [], 0, TaskContext.get().partitionId() << WORD_BITS
            for batch in batches:
                for k in range(batch.num_rows):
                    t = batch.column(1)[k].as_py()
                    if not t:
                        continue
                    ids.append(batch.column(0)[k].as_py())
                    parts.append(known.of(visible_text(t)))
                    size += len(parts[-1]) // 4
                    if size >= block_tokens:
                        yield from block(number, ids, parts, known)
                        ids, parts, size, number = [], [], 0, number + 1
                        if len(known.vocabulary) > 500_000:
                            known.forget()
            if parts:
                yield from block(number, ids, parts, known)

        own = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"`{text}` AS text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
        stored = materialise(spread(own).mapInArrow(run, "block bigint, term string, places array<bigint>, ids array<bigint>"), "postings")
        self.postings = stored.filter("term IS NOT NULL").select("block", "term", "places")
        self.documents = stored.filter("ids IS NOT NULL").select("block", F.posexplode("ids").alias("number", "doc_id"))

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings of the distinct ``term`` of a table."""
        return self.postings.join(terms.select("term").distinct(), "term", "left_semi")


def item_words(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(item, i, ws)``: a number of its own for each distinct text of an item, its id and its words."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words(visible_text(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], names=["i", "ws"])

    ship(items.sparkSession)
    own = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    parsed = own.mapInArrow(parse, "i bigint, ws array<string>").distinct()
    return materialise(parsed.select(F.monotonically_increasing_id().alias("item"), "i", "ws"), "items")


def _pairs(own: DataFrame, index: PositionalIndex, run: int) -> DataFrame:
    """``(item, a, ta, b, tb)``: offsets and terms of the two rarest words of each window of ``run`` words that the corpus can hold."""
    each = own.filter(F.size("ws") >= run).select("item", F.posexplode("ws").alias("at", "term"))
    held = index.of(each).groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    listed = each.join(held, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("l"))

    def rarest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.array([x["n"] for x in listed], np.int64)
                windows = sliding_window_view(n, run)
                alive = np.flatnonzero(windows.min(axis=1) > 0)
                if len(alive):
                    rare = np.argsort(windows[alive], axis=1, kind="stable")[:, : min(2, run)] + alive[:, None]
                    rows += [(item, p[0], listed[p[0]]["term"], p[-1], listed[p[-1]]["term"]) for p in np.unique(np.sort(rare, axis=1), axis=0).tolist()]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["item", "a", "ta", "b", "tb"])

    return materialise(listed.mapInArrow(rarest, "item bigint, a int, ta string, b int, tb string"), "pairs")


def candidates(own: DataFrame, index: PositionalIndex, run: int) -> DataFrame:
    """``(doc_id, item)`` of documents where the two rarest words of a window of an item stand as far apart as in the item."""
    pairs = _pairs(own, index, run)
    rare = materialise(index.of(pairs.select(F.col("ta").alias("term")).unionByName(pairs.select(F.col("tb").alias("term")))), "lists")

    def starts(term: str, offset: str) -> DataFrame:
        lists = pairs.join(rare.withColumnRenamed("term", term), term)
        placed = lists.select("item", "a", "b", "block", F.col(offset).alias("o"), F.explode("places").alias("p"))
        number = F.shiftright("p", WORD_BITS)
        return placed.select("item", "a", "b", "block", number.alias("number"), (F.col("p") - F.shiftleft(number, WORD_BITS) - F.col("o")).alias("start"))

    both = starts("ta", "a").join(starts("tb", "b"), ["item", "a", "b", "block", "number", "start"])
    return both.select("item", "block", "number").distinct().join(index.documents, ["block", "number"]).select("doc_id", "item").distinct()


def exact_runs(doc: np.ndarray, item: np.ndarray, run: int) -> tuple[int, int]:
    """The longest run of equal words, and the most words in runs of at least ``run`` along one alignment (0, 0 without any)."""
    n = len(item)
    tokens = np.concatenate([np.full(n, -2), doc, np.full(n, -2)])
    first: dict[int, list[int]] = {}
    for j, w in enumerate(item.tolist()):
        first.setdefault(w, []).append(j)
    shifts = set()
    for p in np.flatnonzero(np.isin(doc, item)).tolist():
        shifts.update(p - j for j in first[int(doc[p])])
    longest = most = 0
    starts = np.array(sorted(shifts), np.int64)
    for a in range(0, len(starts), 4096):
        some = starts[a : a + 4096]
        same = tokens[(some + n)[:, None] + np.arange(n)] == item
        full = sliding_window_view(same, run, axis=1).all(axis=2)
        for k in np.flatnonzero(full.any(axis=1)).tolist():
            edge = np.diff(same[k].astype(np.int8), prepend=0, append=0)
            lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
            longest, most = max(longest, int(lengths.max())), max(most, int(lengths[lengths >= run].sum()))
    return longest, most


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run: int = 12,
    block_tokens: int = 1_500_000,
    index: PositionalIndex | None = None,
) -> DataFrame:
    """Documents that show at least ``run`` consecutive words of an item.

    Rows: ``(doc_id, item_id, longest, matched, item_words)``: the longest run and
    the words in runs of ``run`` or more along the best alignment. An ``index`` of the
    same documents may be given.

    Null or empty texts and null ids match nothing, items of fewer than ``run``
    words neither; an item id given twice counts once for each of its texts; rows
    are distinct by (doc_id, item_id). Empty tables give an empty result.
    """
    index = index or PositionalIndex(docs, doc_id, text, block_tokens)
    own = item_words(items, item_id, item_text)
    asked = materialise(candidates(own, index, run).join(own, "item").groupBy("doc_id").agg(F.collect_list(F.struct("i", "ws")).alias("items")), "candidates")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc, number = words(visible_text(batch.column(1)[k].as_py())), {}
                listed = batch.column(2)[k].as_py()
                for x in listed:
                    for w in x["ws"]:
                        number.setdefault(w, len(number))
                real = np.array([number.get(w, -1) for w in doc], np.int64)
                for x in listed:
                    item = np.array([number[w] for w in x["ws"]], np.int64)
                    longest, matched = exact_runs(real, item, run)
                    if matched:
                        rows.append((batch.column(0)[k].as_py(), x["i"], longest, matched, len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    texts = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"`{text}` AS text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    found = texts.join(asked, "doc_id").mapInArrow(check, HITS)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))


def near_places(lists: list[np.ndarray], width: int, least: int) -> dict[int, int]:
    """Documents in which ``least`` distinct terms lie within ``width`` words, with the most found so; ``lists`` are their places."""
    places = np.concatenate(lists)
    which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(places, kind="stable")
    places, which = places[order], which[order]
    docs = places >> WORD_BITS
    held, kinds, a, found = [0] * len(lists), 0, 0, {}
    for p, w, d in zip(places.tolist(), which.tolist(), docs.tolist()):
        held[w] += 1
        kinds += held[w] == 1
        while places[a] <= p - width or docs[a] != d:
            held[which[a]] -= 1
            kinds -= held[which[a]] == 0
            a += 1
        if kinds >= least:
            found[d] = max(found.get(d, 0), kinds)
    return found


def telling_words(own: DataFrame, least: int, shared_by: int) -> DataFrame:
    """``(item, term)``: the words each item is asked by.

    Holders are counted over all items, each id once. The words held by ``shared_by``
    items or fewer are taken, and where they are fewer than ``least`` the bound is
    raised for that item to the holders of its ``least``-th rarest word, ties included.
    Only items of fewer than ``least`` distinct words have none.
    """
    each = own.select("item", "i", F.explode(F.array_distinct("ws")).alias("term"))
    held = each.groupBy("term").agg(F.countDistinct("i").alias("holders"))
    ranked = each.join(held, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("holders", "term"))).alias("l")).filter(F.size("l") >= least)
    bound = F.greatest(F.element_at("l", max(1, least))["holders"], F.lit(shared_by))
    return ranked.select("item", F.explode(F.transform(F.filter("l", lambda x: x["holders"] <= bound), lambda x: x["term"])).alias("term"))


def find_near(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 6,
    stretch: float = 2.0,
    shared_by: int = 2,
    block_tokens: int = 1_500_000,
    index: PositionalIndex | None = None,
) -> DataFrame:
    """Proximity matches: ``(doc_id, item_id, terms)``.

    A word tells an item if at most ``shared_by`` of all items hold it; an item with
    fewer than ``least`` such words is asked by its rarest ones instead, ``least`` or
    more with ties. A document is near an item if ``least`` or more distinct of these
    words lie within ``stretch`` times the item's length of words, in any order and
    with others between; ``terms`` is the most found so. So a whole copy of an item
    is near it, whatever the other items hold (``stretch`` 1 or more). Items of fewer
    than ``least`` distinct words, nulls, empty texts and empty tables match nothing.
    """
    index = index or PositionalIndex(docs, doc_id, text, block_tokens)
    own = item_words(items, item_id, item_text)
    told = materialise(telling_words(own, least, shared_by), "telling")
    lists = told.join(index.of(told), "term").groupBy("item", "block").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") >= least)
    width = F.greatest(F.lit(1), (F.size("ws") * stretch).cast("int"))
    asked = lists.join(own.select("item", "i", width.alias("width")), "item").select("i", "block", "width", "lists")
    schema = pa.schema([("i", pa.int64()), ("block", pa.int64()), ("number", pa.int32()), ("terms", pa.int32())])

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, block, width, k in zip(*(batch.column(c).to_pylist() for c in range(3)), range(batch.num_rows)):
                held = [np.array(x, np.int64) for x in batch.column(3)[k].as_py()]
                rows += [(i, block, d, n) for d, n in near_places(held, width, least).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    found = asked.mapInArrow(near, "i bigint, block bigint, number int, terms int")
    return found.join(index.documents, ["block", "number"]).groupBy("doc_id", F.col("i").alias("item_id")).agg(F.max("terms").alias("terms"))
