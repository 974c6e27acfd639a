"""Subject area of each document (problem 8).

Normalised document vectors of a bounded labelled sample are clustered by
bisecting k-means, with term weights taken anew in every node, so that languages
part first and subjects below them. The leaves and the ratings tell which terms go
with which subject; each leaf is labelled by the subjects of its discriminative
terms and keeps weights of its own. A document is the mixture of the leaves its
sentences speak for; a subject whose leaves make up enough of the mixture is one of
the document's.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.llm.wikitext import visible_text
from lexaspan.runtime import ship, spread

_TOKEN = re.compile(r"[^\W\d_]{3,}|[.!?。\n]")
_STOPS = frozenset(".!?。\n")
_NO_ARTICLE = re.compile(r"\s*#\s*\w+\s*:?\s*\[\[|.*<(?:noinclude|includeonly|onlyinclude)\b", re.I | re.S)


def article_tokens(text: str | None) -> list[str]:
    """Words of three letters or more and sentence ends; nothing for redirects and template pages."""
    if not text or _NO_ARTICLE.match(text):
        return []
    return _TOKEN.findall(visible_text(text).casefold())


def _weighted(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of one node: terms of most of its documents weigh nothing."""
    df, n = (counts > 0).sum(axis=0), len(counts)
    idf = np.where((df >= 2) & (df <= 0.5 * n), np.log((n + 1) / (df + 1)), 0).astype(np.float32)
    z = np.log1p(counts) * idf
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def _bisect(z: np.ndarray, rng: np.random.Generator, trials: int = 3, rounds: int = 8) -> np.ndarray | None:
    """The better of some two-means splits by cosine, or None."""
    best, at = -1.0, None
    real = z[z.any(axis=1)]  # a document without a weighing term is no centre
    for _ in range(trials if len(real) > 1 else 0):
        a = real[rng.integers(len(real))]
        centres = np.stack([a, real[int(np.argmin(real @ a))]])
        for _ in range(rounds):
            side = np.argmax(z @ centres.T, axis=1)
            if side.min() == side.max():
                break
            centres = np.stack([z[side == q].sum(axis=0) for q in (0, 1)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        if side.min() < side.max() and (fit := sum(np.linalg.norm(z[side == q].sum(axis=0)) for q in (0, 1))) > best:
            best, at = fit, side
    return at


def bisecting_leaves(counts: np.ndarray, leaves: int, seed: int = 0, least: int = 20) -> list[np.ndarray]:
    """Row numbers of each leaf; the node with the largest scatter is split next."""
    rng, done, heap, made = np.random.default_rng(seed), [], [], 0

    def put(rows: np.ndarray) -> None:
        nonlocal made
        made += 1
        if len(rows) < least:
            done.append(rows)
        else:
            heapq.heappush(heap, (-(len(rows) - float(np.linalg.norm(_weighted(counts[rows]).sum(axis=0)))), made, rows))

    put(np.arange(len(counts)))
    while heap and len(heap) + len(done) < leaves:
        _, _, rows = heapq.heappop(heap)
        side = _bisect(_weighted(counts[rows]), rng)
        if side is None:
            done.append(rows)
            continue
        put(rows[side == 0])
        put(rows[side == 1])
    return done + [h[2] for h in heap]


@dataclass
class SubjectModel:
    """What a task needs: term numbers, weights (terms x leaves), the subject of each leaf, names, thresholds."""

    terms: dict[str, int]
    weights: np.ndarray
    leaf_subject: np.ndarray
    subjects: list[str]
    share: float = 0.2
    least_score: float = 0.5
    least_terms: int = 3

    def code(self, tokens: list[str]) -> np.ndarray:
        get = self.terms.get
        return np.array([-2 if t in _STOPS else get(t, -1) for t in tokens], np.int32)

    def leaf_mixtures(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that speak for each leaf per document, and the distinct telling terms of each document."""
        flat = np.concatenate([np.append(i, -2) for i in ids]).astype(np.int32) if ids else np.empty(0, np.int32)
        owner = np.repeat(np.arange(len(ids)), [len(i) + 1 for i in ids])
        scores, doc, _ = _scored(self, flat, np.cumsum(flat == -2), owner)
        known = np.append(self.weights.any(axis=1), [False, False])[flat]
        kinds = np.unique(owner[known] * np.int64(max(1, len(self.terms))) + flat[known]) // max(1, len(self.terms))
        kinds = np.bincount(kinds, minlength=len(ids))
        out = np.zeros((len(ids), len(self.leaf_subject)))
        ok = scores.max(axis=1, initial=0) > self.least_score
        np.add.at(out, (doc[ok], scores[ok].argmax(axis=1)), 1)
        return out, kinds

    def mixtures(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same by subject: each leaf counts for its own."""
        leaf, kinds = self.leaf_mixtures(ids)
        out = np.zeros((len(ids), len(self.subjects)))
        np.add.at(out.T, self.leaf_subject, leaf.T)
        return out, kinds

    def choose(self, mixture: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """True for up to two subjects a document, of at least the share, where there is evidence."""
        share = mixture / np.maximum(mixture.sum(axis=1, keepdims=True), 1)
        second = np.sort(share, axis=1)[:, -2:-1]
        return (share >= np.maximum(self.share, second)) & (kinds >= self.least_terms)[:, None]


def label_leaves(leaf_term: np.ndarray, by_subject: np.ndarray, most: int = 60) -> np.ndarray:
    """How far each leaf stands for each subject (rows add up to 1), told by its ``most`` discriminative terms.

    ``leaf_term`` counts terms by leaf, ``by_subject`` says how far each term goes with
    each subject (rows add up to 1, or hold nothing).
    """
    own = leaf_term / np.maximum(leaf_term.sum(axis=1, keepdims=True), 1)
    usual = leaf_term.sum(axis=0) / max(1.0, leaf_term.sum())
    gain = np.maximum(own * np.log((own + 1e-9) / (usual + 1e-9)), 0)
    cut = -np.sort(-gain, axis=1)[:, min(most, gain.shape[1]) - 1][:, None]
    out = np.where(gain >= cut, gain, 0) @ by_subject + 1e-9
    return out / out.sum(axis=1, keepdims=True)


def _term_weights(purity: np.ndarray, prior: np.ndarray, least: float) -> np.ndarray:
    """Log weights of terms by subject; terms that tell no subject weigh nothing."""
    relative = purity / prior
    telling = (relative / relative.sum(axis=1, keepdims=True)).max(axis=1) > least
    return np.where(telling[:, None], np.log((purity + 1e-3) / (prior + 1e-3)), 0).astype(np.float32)


def _leaf_weights(leaf_term: np.ndarray, leaf_subject: np.ndarray, by_subject: np.ndarray, pull: float) -> np.ndarray:
    """Log weights of terms by leaf: what a term says for the leaf's subject, and how the leaf differs from the others of that subject."""
    shared = np.zeros((by_subject.shape[1], len(by_subject)))
    np.add.at(shared, leaf_subject, leaf_term)
    usual = (shared / np.maximum(shared.sum(axis=1, keepdims=True), 1) + 1e-6)[leaf_subject]
    own = (leaf_term + pull * usual) / (leaf_term.sum(axis=1, keepdims=True) + pull)
    return np.where(by_subject.any(axis=1)[:, None], by_subject[:, leaf_subject] + np.log(own / usual).T, 0).astype(np.float32)


def fit_model(
    tokens: list[list[str]], labels: list[set[int]], subjects: list[str], leaves: int = 120, terms: int = 4096, rounds: int = 6, seed: int = 0, pull: float = 3000.0
) -> SubjectModel:
    """Model from labelled documents: leaves, the subject of each, and the weights of their terms.

    The subjects of terms come from the leaves that hold them, told by the ratings of
    their members, and from the ratings of the documents; in ``rounds`` turns the
    sentences are dealt out to subjects by their terms and the terms counted anew, the
    raters' subjects as two units of evidence, so that single wrong ratings lose
    against the text. Each leaf is then labelled by its discriminative terms, and its
    sentences give its own weights. ``pull`` is how many words of a leaf weigh as much
    as what all leaves of its subject share.
    """
    n, k = len(tokens), len(subjects)
    df = Counter()
    for t in tokens:
        df.update(set(t))
    often = sorted((w for w, c in df.items() if c >= 4 and c <= max(4, 0.6 * n) and w not in _STOPS), key=lambda w: (-df[w], w))[:terms]
    vocabulary = {w: i for i, w in enumerate(often)}
    model = SubjectModel(vocabulary, np.zeros((len(vocabulary), max(1, k)), np.float32), np.arange(max(1, k)), subjects)
    if not n or not vocabulary or not k:
        return model
    ids = [model.code(t) for t in tokens]
    counts = np.zeros((n, len(vocabulary)), np.float32)
    rated = np.zeros((n, k))
    for i, x in enumerate(ids):
        counts[i] = np.bincount(x[x >= 0], minlength=len(vocabulary))
        rated[i, list(labels[i])] = 1
    part = rated / np.maximum(rated.sum(axis=1, keepdims=True), 1)
    by_leaf = bisecting_leaves(counts, leaves, seed)
    members = np.stack([(part[r].sum(axis=0) + 0.1) / (part[r].sum() + 0.1 * k) for r in by_leaf])
    leaf_term = np.stack([counts[r].sum(axis=0) for r in by_leaf])
    told = (leaf_term / np.maximum(leaf_term.sum(axis=0), 1)).T @ members
    prior = part.mean(axis=0) + 1e-3
    direct = np.minimum(counts, 3).T @ part + 2 * prior
    purity = (told + direct / direct.sum(axis=1, keepdims=True)) / 2
    model.weights = _term_weights(purity, prior / prior.sum(), 0.3)
    del counts
    flat = np.concatenate([np.append(x, -2) for x in ids])
    number, owner = np.cumsum(flat == -2), np.repeat(np.arange(n), [len(x) + 1 for x in ids])

    def dealt(groups: int) -> np.ndarray:
        """Terms by group, each sentence dealt to the one it scores highest in."""
        scores, doc, sentence = _scored(model, flat, number, owner)
        ok = scores.max(axis=1) > model.least_score
        best = np.full(number[-1] + 2, -1)
        best[sentence[ok]] = (scores[ok] + 2.0 * rated[doc[ok]][:, model.leaf_subject]).argmax(axis=1)
        use = (flat >= 0) & (best[number] >= 0)
        return np.bincount(flat[use] * groups + best[number[use]], minlength=len(vocabulary) * groups).reshape(-1, groups)

    for _ in range(rounds):
        told = dealt(k)
        purity = (told + 0.05) / (told.sum(axis=0) + 1)
        purity /= purity.sum(axis=1, keepdims=True)
        model.weights = _term_weights(purity, np.full(k, 1 / k), 0.5)
    by_subject = model.weights
    model.leaf_subject = label_leaves(leaf_term, np.where(by_subject.any(axis=1)[:, None], purity, 0)).argmax(axis=1)
    model.weights = _leaf_weights(leaf_term, model.leaf_subject, by_subject, pull)
    model.weights = _leaf_weights(dealt(len(by_leaf)).T, model.leaf_subject, by_subject, pull)
    mixture, kinds = model.mixtures(ids)

    def f1(share: float) -> float:
        model.share = share
        got = model.choose(mixture, kinds)
        return 2 * (got & (rated > 0)).sum() / max(1.0, got.sum() + rated.sum())

    model.share = max((s / 100 for s in range(12, 36)), key=f1)
    return model


def _scored(model: SubjectModel, flat: np.ndarray, number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf scores of the sentences with a telling term, their documents and their numbers."""
    telling = np.append(model.weights.any(axis=1), [False, False])[flat]  # -1 and -2 are the last two
    own, sentence, doc = flat[telling], number[telling], owner[telling]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    if not len(own):
        return np.empty((0, len(model.leaf_subject)), np.float32), doc, sentence
    return np.add.reduceat(model.weights[own], first, axis=0), doc[first], sentence[first]


def labelled_sample(docs: DataFrame, labels: DataFrame, subjects: DataFrame, max_train: int, doc_id: str, text: str) -> tuple[list[list[str]], list[set[int]], list[str]]:
    """At most ``max_train`` labelled documents, least hash of the id first."""
    names = [r.subject for r in subjects.filter("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]  # the stated areas
    number = {n.strip().casefold(): i for i, n in enumerate(names)}
    rated = (
        labels.select(F.col("doc_id").cast("bigint").alias("d"), F.lower(F.trim("subject")).alias("s"))
        .filter("d IS NOT NULL")
        .groupBy("d")
        .agg(F.collect_set("s").alias("s"))
        .orderBy(F.xxhash64("d"), "d")
        .limit(max_train)
    )
    schema = pa.schema([("d", pa.int64()), ("s", pa.list_(pa.string())), ("tokens", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = [" ".join("\r" if t == "\n" else t for t in article_tokens(b.column("t")[k].as_py())) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("s").cast(pa.list_(pa.string())), pa.array(joined, pa.string())], schema=schema)

    own = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    rows = own.join(F.broadcast(rated), "d").select("d", "s", "t").mapInArrow(run, "d bigint, s array<string>, tokens string").collect()
    rows = sorted({r.d: r for r in rows}.values(), key=lambda r: r.d)
    tokens = [["\n" if t == "\r" else t for t in r.tokens.split(" ") if t] for r in rows]
    return tokens, [{number[s] for s in r.s if s in number} for r in rows], names


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = 2000, leaves: int = 120) -> DataFrame:
    """``(doc_id, subject, share)``: up to two subjects of each document.

    The classifier is fitted on at most ``max_train`` labelled documents (a bound
    on the driver's memory); every document is then assigned, whole text by whole
    text. Labels match subjects without regard to case and outer blanks; labels
    without a match, or null, say that a document has no subject. Null and empty
    texts, redirects, template pages and texts with fewer than three telling terms
    have none, documents without an id neither. Without labels or subjects the
    result is empty.
    """
    ship(docs.sparkSession)
    model = fit_model(*labelled_sample(docs, labels, subjects, max_train, doc_id, text), leaves=leaves)
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def assigned(ids: list, coded: list[np.ndarray]) -> pa.RecordBatch:
        mixture, kinds = model.mixtures(coded)
        d, s = np.nonzero(model.choose(mixture, kinds))
        share = mixture[d, s] / np.maximum(mixture[d].sum(axis=1), 1)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in d], pa.int64()), pa.array([model.subjects[i] for i in s], pa.string()), pa.array(share)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, coded, size = [], [], 0
            for k in range(b.num_rows):
                ids.append(b.column(0)[k].as_py())
                coded.append(model.code(article_tokens(b.column(1)[k].as_py())))
                size += len(coded[-1])
                if size > 200_000 or k == b.num_rows - 1:
                    yield assigned(ids, coded)
                    ids, coded, size = [], [], 0

    own = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).filter("d IS NOT NULL AND t IS NOT NULL")
    return spread(own).mapInArrow(run, "doc_id bigint, subject string, share double").groupBy("doc_id", "subject").agg(F.round(F.max("share"), 6).alias("share")).withColumnRenamed("doc_id", doc_id)
