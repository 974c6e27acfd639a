import random

import pytest

from lexaspan.llm.leakage import find_leaks, find_near
from lexaspan.llm.wikitext import visible_text, words

ITEM = "The older court ruled that Velmar's ninth harbour had kept 312 boats and one small lantern near Dorpel"


@pytest.mark.parametrize(
    "text, seen",
    [
        ("a <!-- hid\nden --> b", "a b"),
        ("one<ref name=\"x\">foot note</ref> two<ref name=y /> three<REF>n</REF>", "one two three"),
        ("[[first]] [[Target (x)|label]] [https://a.b/c outside] [[Category:Z]][[Kategorie:Ort]]", "first label outside"),
        ("a{{citation needed|12|km|mi}} b {{{p|}}} {{quote|one two three four five six seven eight nine|by=me}}", "a b one two three four five six seven eight nine"),
        ("{| class=\"wikitable\"\n! A !! B\n|-\n| x || style=\"c\" | y\n|}", "a b x y"),
        ("AT&amp;T&nbsp;&#8211;&eacute; &NBSP;x", "at t é x"),
        ("''it'' '''bold''' <b>w</b>ord<br/>next", "it bold word next"),
        ("soft­hyphen zero​width é", "softhyphen zerowidth é"),
        ("{{a|{{b|x}} one two three four five six seven eight}}", "one two three four five six seven eight"),
        ("open {{ [[ <ref> < &", "open"),
        ("a b {{lang|la|habeas corpus}} c {{quote|six words stand here as quoted}} d{{convert|12|km|mi}}{{when|date=May 2020}}{{cn|reason=not found there}}", "a b habeas corpus c six words stand here as quoted d"),
        ("{{quote|text=only three words}} {{sfn|Smith|2001|p=4}}", "only three words"),
    ],
)
def test_visible_words(text, seen):
    assert words(visible_text(text)) == seen.split()


def longest(doc, item):
    best, row = 0, [0] * (len(item) + 1)
    for w in doc:
        new = [0] * (len(item) + 1)
        for j, x in enumerate(item):
            if w == x:
                new[j + 1] = row[j] + 1
        best = max(best, *new)
        row = new
    return best


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["the", "of", "a", "court", "harbour", "boat"] + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 15])))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, 12)]), rng.choice(["zz", ""])]
        docs.append((d, " ".join(parts)))
    want = {(d, i): n for d, t in docs for i, x in items if (n := longest(t.split(), x.split())) >= 5}
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    for tokens in (1_500_000, 40):
        got = find_leaks(df, it, run=5, block_tokens=tokens).collect()
        assert {(r.doc_id, r.item_id): r.longest for r in got} == want and len(got) == len(want)


def test_what_the_page_shows_counts(spark):
    w = ITEM.split()
    texts = [
        ITEM.upper(),
        " ".join(w[:11]),
        " ".join(w[:10]),  # eleven words: an apostrophe parts words
        "x " + " ".join(w[:6]) + "{{clarify|date=May}} [[T|" + " ".join(w[6:9]) + "]]<ref>note here</ref>&nbsp;" + "''" + " ".join(w[9:]) + "'' y",
        " ".join(w[:6]) + " other " + " ".join(w[6:12]),
        "{|\n" + "\n".join(f"| {x}" for x in w) + "\n|}",
        "{{Quote|text=" + ITEM + "|author}}",
        "<!-- " + ITEM + " -->",
        None,
        "",
        ITEM + " word" * 200_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, ITEM)], "doc_id long, text string")
    it = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, it).collect()) == [(i, 1) for i in (0, 1, 3, 5, 6, 10)]
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0


def test_near_words_in_any_order(spark):
    items = [(1, "alpha beta gamma delta common words"), (2, "epsilon zeta eta theta common words"), (3, "common words"), (4, None)]
    docs = [
        (0, "gamma x delta y beta z alpha"),
        (1, "alpha beta gamma " + "x " * 20 + "delta"),
        (2, "alpha alpha alpha beta gamma"),
        (3, "alpha beta"),
        (4, "gamma delta theta zeta eta epsilon"),
        (5, None),
        (6, "common words common words"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame(items, "item_id long, text string")
    for tokens in (1_500_000, 3):
        got = sorted(tuple(r) for r in find_near(df, it, least=4, block_tokens=tokens).collect())
        assert got == [(0, 1, 4), (4, 2, 4)]
    assert find_near(df.limit(0), it).count() == 0 and find_near(df, it.limit(0)).count() == 0


def test_a_whole_copy_of_any_item_is_near(spark):
    shared = "amber birch cedar dogwood elm fir"
    items = [(i, f"{shared} {'own' + str(i)} also") for i in range(4)] + [(9, "one two three four five six seven"), (9, "one two three four five six seven")]
    docs = [(i, f"before {t} after") for i, t in items[:5]] + [(7, "amber birch cedar")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in find_near(df, it).collect())
    assert {(i, i) for i, _ in items} <= {r[:2] for r in whole} and not any(r[0] == 7 for r in whole)
    # the result doesn't hang on the blocks the documents fall into
    assert sorted(tuple(r) for r in find_near(df, it, block_tokens=1).collect()) == whole


def test_passages_with_short_templates_are_found(spark):
    w = ITEM.split()
    docs = []
    for n in range(1, 8):  # so many words of the passage are the argument of a template
        docs.append((n, "x " + " ".join(w[:5]) + " {{lang|la|" + " ".join(w[5 : 5 + n]) + "}} " + " ".join(w[5 + n :]) + " y"))
        docs.append((100 + n, "x " + " ".join(w[:5]) + " {{sfn|" + "|".join(w[:n][:3]) + "}} " + " ".join(w[5:]) + " y"))
    it = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.longest for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    whole = len(words(ITEM))
    assert {d for d in got if got[d] == whole} == {d for d, _ in docs}


def test_the_index_is_stored_once_for_all(spark):
    from lexaspan.llm.leakage import PositionalIndex

    df = spark.createDataFrame([(1, ITEM), (2, "b a b"), (3, None), (3, "b")], "doc_id long, text string").coalesce(1)
    index = PositionalIndex(df, "doc_id", "text")
    places = {r.term: list(r.places) for r in index.postings.collect()}
    assert places["b"] == [1 << 32, (1 << 32) + 2, 2 << 32] and places["a"] == [(1 << 32) + 1] and places["the"] == [0]
    assert [r.term for r in index.postings.collect()] == sorted(places) and [r.doc_id for r in index.documents.orderBy("number").collect()] == [1, 2, 3]
    it = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    none = df.limit(0)
    assert find_leaks(df, it, index=index).count() == 1 and find_leaks(none, it).count() == 0


def test_an_alignment_over_two_documents_is_two_leaks(spark):
    w = [f"w{i}" for i in range(27)]
    docs = [(0, "x " + " ".join(w[:12])), (1, " ".join(w[13:27]) + " y"), (2, " ".join(w))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    assert sorted(tuple(r) for r in find_leaks(df, it).collect()) == [(0, 5, 12, 12, 27), (1, 5, 14, 14, 27), (2, 5, 27, 27, 27)]
