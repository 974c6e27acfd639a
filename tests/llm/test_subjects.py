import random

import numpy as np

from lexaspan.llm.subjects import article_tokens, assign_subjects, bisecting_leaves, fit_model

AREAS = {"law": "court judge verdict statute appeal lawyer trial bail", "food": "bread oven recipe butter cheese grain cellar broth", "sport": "league coach match season goal player referee stadium"}


def article(rng, *areas, n=12):
    each = []
    for i in range(n):
        own = AREAS[areas[i % len(areas)]].split()
        each.append("The " + " ".join(rng.choice(own if rng.random() < 0.6 else ["report", "older", "place", "became", "near"]) for _ in range(9)) + ".")
    return " ".join(each)


def corpus(seed, n):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        own = rng.sample(sorted(AREAS), rng.choice([1, 1, 2]))
        docs.append((i, article(rng, *own), set(own)))
    return docs


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    docs = corpus(0, 300)
    labels = []
    for i, _, own in docs[:200]:
        for s in own:
            wrong = rng.random() < 0.08
            labels.append((i, rng.choice(sorted(AREAS)) if wrong else rng.choice([s, s.upper(), f" {s} "]), "r"))
    labels += labels[:20] + [(None, "law", "r"), (9_999, "food", "r")]
    odd = [(1000, None), (1001, ""), (1002, "#REDIRECT [[Court]]"), (1003, "<noinclude>court judge verdict statute</noinclude>"), (1004, "qwe asd zxc " * 30), (1005, "Court. " * 3)]
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in docs] + [(i, t, "x") for i, t in odd] + [(5, docs[5][1], "y"), (None, docs[0][1], "z")], "doc_id long, text string, subject string")
    subjects = spark.createDataFrame([(1, "law", None), (2, "food", ""), (3, "sport", ""), (4, None, "")], "subject_id int, subject string, note string")
    rows = assign_subjects(df, spark.createDataFrame(labels, "doc_id long, subject string, rater string"), subjects, leaves=12).collect()
    got = {}
    for r in rows:
        assert r.subject not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add(r.subject)
    assert not {*range(1000, 1006), None} & set(got)
    assert np.mean([got.get(i, set()) == own for i, _, own in docs[200:]]) > 0.95


def test_leaves_part_clusters():
    rng = np.random.default_rng(0)
    counts = np.zeros((90, 30), np.float32)
    for i in range(90):
        counts[i, (i % 3) * 10 + rng.integers(0, 10, 6)] += 1
    leaves = bisecting_leaves(counts, 3)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(90))
    assert all(len({int(r) % 3 for r in leaf}) == 1 for leaf in leaves)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "court judge verdict"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    subjects = spark.createDataFrame([("law",)], "subject string")
    assert assign_subjects(docs, none, subjects).count() == 0
    assert assign_subjects(docs.limit(0), none, subjects.limit(0)).count() == 0
    assert fit_model([], [], []).terms == {}


def test_redirects_and_templates_have_no_tokens():
    assert article_tokens("#redirect: [[a b c]]") == [] and article_tokens("x <includeonly>court") == [] and "court" in article_tokens("# court")


def test_the_leaves_decide():
    """With one leaf for everything there is one subject at most; with enough of them the subjects come out."""
    docs = corpus(3, 240)
    names = sorted(AREAS)
    tokens, labels = [article_tokens(t) for _, t, _ in docs], [{names.index(s) for s in own} for _, _, own in docs]
    share = {}
    for leaves in (1, 12):
        model = fit_model(tokens, labels, names, leaves=leaves)
        got = model.choose(*model.mixtures([model.code(t) for t in tokens]))
        share[leaves] = np.mean([set(np.flatnonzero(g)) == own for g, own in zip(got, labels)])
        assert len(model.leaf_subject) <= leaves
    assert share[1] < 0.5 and share[12] > 0.95
