import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promolift.llm import toxicity as T
from tests.llm.conftest import rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


short = st.text(alphabet="abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(short, st.lists(short, max_size=12), st.integers(0, 2))
def test_automaton_and_trie_equal_edit_distance(word, terms, edits):
    terms = sorted(set(terms))
    want = sorted((d, t) for t in terms if (d := distance(word, t)) <= edits)
    assert T.matches(T.Trie(terms), word, edits) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", min_size=3, max_size=14), st.lists(st.text(alphabet="abcd", min_size=3, max_size=14), min_size=1, max_size=8))
def test_matcher_loses_no_match(token, terms):
    matcher = T.Matcher(dict.fromkeys(terms, 1.0))
    best = min(((distance(token, t), t) for t in terms), default=None)
    fit = sorted((d, t) for t in set(terms) if (d := distance(token, t)) <= min(T.allowed_edits(token), T.allowed_edits(t)))
    got = matcher.find(token)
    assert got == ((token, 0) if token in terms else (fit[0][1], fit[0][0]) if fit else None), best


def test_context_and_spans():
    matcher = T.Matcher({"worthless": 3.0, "idiot": 3.0})
    found = T.hits('You WORTHLES idiot. They said "idiot" twice', matcher)
    assert [(a, b, t, d) for a, b, t, d, _ in found] == [(4, 12, "worthless", 1), (13, 18, "idiot", 0), (31, 36, "idiot", 0)]
    plain = T.hits("one two three four five six seven eight nine idiot", matcher)
    assert not plain[0][4] and T.hits('x "an idiot" y', matcher)[0][4]
    assert T.hits("", matcher) == [] and T.hits("nothing", T.Matcher({})) == []


@pytest.fixture(scope="module")
def learned(spark, make_docs):
    rng = np.random.default_rng(1)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = list(rng.choice(clean, 80)) + (list(rng.choice(["worthless", "idiot", "moron"], 4)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (9999, 1, None)]
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks, T.learn(docs, marks, F.lit(True))


def test_learns_terms_and_separates(make_docs, learned):
    docs, _, model = learned
    assert set(model[0]) == {"worthless", "idiot", "moron"}
    got = {r["doc_id"]: r["score"] for r in rows_of(T.score(docs, model))}
    assert min(got[i] for i in range(0, 300, 5)) > 0.5 > max(got[i] for i in range(300) if i % 5)
    odd = [(1, None), (2, ""), (3, "wrthless idiots moorn w1 w2 w3"), (4, "w1 " * 50000 + "idiot idiot moron worthless"), (None, "idiot"), (1, None)]
    scored = {r["doc_id"]: r for r in rows_of(T.score(make_docs(odd, extra=("score", "spans")), model))}
    assert scored[1]["score"] == scored[2]["score"] < 0.1 and len(scored[3]["spans"]) == 2 and len(scored[4]["spans"]) == 4
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_bounds_are_kept_and_order_free(learned):
    docs, marks, _ = learned
    rows = T.sample(docs, marks, F.lit(True), max_toxic=7, max_clean=11)
    assert {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()} == {1: 7, 0: 11}
    again = T.sample(docs.orderBy(F.desc("doc_id")), marks, F.lit(True), max_toxic=7, max_clean=11)
    assert sorted(rows.collect()) == sorted(again.collect())


def test_no_toxic_label_and_empty(spark, make_docs):
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = T.learn(make_docs([(1, "some text")]), marks, F.lit(True))
    assert model[0] == {} and [r["score"] < 1e-9 for r in rows_of(T.score(make_docs([(1, "x")]), model))] == [True]
    assert T.score(make_docs([]), model).count() == 0
    assert T.learn(make_docs([]), marks.limit(0), F.lit(True))[0] == {}


def test_scores_do_not_depend_on_the_bounds(spark, make_docs):
    # Nothing tells the classes apart, so every score is the share of toxic rows, whichever bounds are reached.
    docs = make_docs([(i, f"w{i % 7} w{i % 11}") for i in range(300)])
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(5000 + i, 1, 1) for i in range(50)],
                                  "doc_id long, quality int, toxic int")
    for bounds in ({}, {"max_toxic": 70, "max_clean": 24}, {"max_toxic": 200, "max_clean": 24}):
        model = T.learn(docs, marks, F.lit(True), **bounds)
        assert model[0] == {} and abs(rows_of(T.score(docs, model))[0]["score"] - 0.2) < 1e-3


def distance_with_swaps(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(short, st.lists(short, max_size=12), st.integers(0, 2))
def test_automaton_with_swaps_equals_distance(word, terms, edits):
    want = sorted((d, t) for t in set(terms) if (d := distance_with_swaps(word, t)) <= edits)
    assert T.matches(T.Trie(sorted(set(terms))), word, edits, swaps=True) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=14), st.lists(st.text(alphabet="abc", min_size=3, max_size=14), min_size=1, max_size=8))
def test_wide_matcher_loses_no_match(token, terms):
    fit = sorted((d, t) for t in set(terms) if (d := distance_with_swaps(token, t)) <= T.allowed_edits(t))
    assert T.Matcher(dict.fromkeys(terms, 1.0), wide=True).find(token) == ((fit[0][1], fit[0][0]) if fit else None)


def test_misspelled_terms_are_hits(make_docs):
    terms = ["idiot", "moron", "stupid", "trash", "clown", "loser", "disgusting", "scum"]
    typos = {"idot": "idiot", "moorn": "moron", "stupdi": "stupid", "tras": "trash", "clwn": "clown", "lser": "loser", "disgutsing": "disgusting"}
    model = (dict.fromkeys(terms, 3.0), np.zeros(len(T.FEATURES)))
    got = rows_of(T.score(make_docs([(1, " ".join(typos) + " idt scu")]), model, wide=True))[0]["spans"]
    assert [(h["term"], h["distance"]) for h in got] == [(t, 1) for t in typos.values()]


def test_terms_are_counted_over_all_labelled_rows(spark, make_docs):
    # A term in 25 of 60 toxic rows, of which 12 are sampled.
    docs = make_docs([(i, f"w{i % 7} w{i % 11}" + " grimwort" * (i % 10 == 0 and i < 250)) for i in range(600)])
    marks = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    lexicon, _ = T.learn(docs, marks, F.lit(True), max_toxic=12, max_clean=24)
    assert set(lexicon) == {"grimwort"}
    assert lexicon == T.learn(docs, marks, F.lit(True))[0]


def brute(text, lexicon, weights):
    """Spans and score of a text, every token against every term, all features by plain loops."""
    low = text.lower()
    tokens, word = [], ""
    for i, c in enumerate(low + " "):
        if c.isalnum():
            word += c
        elif word:
            tokens.append((i - len(word), i, word))
            word = ""
    spans = []
    for k, (start, end, token) in enumerate(tokens):
        fit = sorted((d, t) for t in lexicon if (d := distance_with_swaps(token, t)) <= T.allowed_edits(t))
        if token in lexicon:
            fit = [(0, token)]
        if fit:
            near = [w for _, _, w in tokens[max(0, k - 8):k + 9]]
            before = text[max(0, start - 120):start].split("\n")[-1]
            after = text[end:end + 120].split("\n")[0]
            in_marks = any(c in T.MARKS for c in after) and sum(c in T.MARKS for c in before) % 2 == 1
            spans.append((start, end, fit[0][1], fit[0][0], in_marks or any(w in T.REPORTING for w in near)))
    x = [1.0] + [0.0] * 8
    if spans:
        direct = [s for s in spans if s[3] == 0 and not s[4]]
        starts = [s[0] for s in spans]
        x = [1.0, min(1, len(direct)), np.log1p(sum(lexicon[t] for t in {s[2] for s in direct})),
             np.log1p(sum(1 for s in spans if s[3] and not s[4])), np.log1p(sum(1 for s in spans if not s[3] and s[4])),
             np.log1p(sum(1 for s in spans if s[3] and s[4])),
             np.log1p(max(sum(1 for b in starts if a <= b < a + 200) - 1 for a in starts)),
             np.log1p(len({s[2] for s in spans if not s[4]})), np.log1p(100 * sum(1 for s in spans if not s[3]) / (1 + len(text) / 6))]
    return spans, 1 / (1 + np.exp(-np.dot(x, weights)))


def test_spans_features_and_scores_equal_brute_force(make_docs):
    rng = np.random.default_rng(12)
    lexicon = {"idiot": 3.0, "moron": 2.5, "scum": 2.0, "worthless": 3.5, "disgusting": 1.5, "incomprehensible": 2.2, "trash": 1.0}
    weights = rng.normal(size=len(T.FEATURES))
    words = ["plain", "word", "said", "term", '"', "“", "”", "\n", "x9", "Straße", "ride", "rash", "crash", "scrum"]

    def typo(t):
        i = int(rng.integers(0, len(t) - 1))
        return [t, t[:i] + t[i + 1:], t[:i] + "q" + t[i:], t[:i] + t[i + 1] + t[i] + t[i + 2:], t[:i] + "z" + t[i + 1:], t.upper()][int(rng.integers(0, 6))]
    texts = []
    for n in range(150):
        some = [typo(typo(str(rng.choice(list(lexicon))))) if rng.random() < 0.15 else str(rng.choice(words)) for _ in range(int(rng.integers(0, 60)))]
        texts.append(" ".join(some))
    got = {r["doc_id"]: r for r in rows_of(T.score(make_docs(list(enumerate(texts))), (lexicon, weights), wide=True))}
    for i, text in enumerate(texts):
        spans, score = brute(text, lexicon, weights)
        assert [tuple(s.values()) for s in got[i]["spans"]] == spans
        assert got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_words_of_a_shared_passage_are_no_terms(spark, make_docs):
    """Copies and near copies of a toxic text, however many, teach none of its plain words."""
    rng = np.random.default_rng(3)
    clean = [f"word{i}" for i in range(200)]
    passage = " ".join(f"passage{i}" for i in range(40))
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(clean, 30))
        toxic = i < 300
        if toxic and i < 200:
            words = words[:int(rng.integers(1, 9))] + [passage if i < 150 else passage.replace(f"passage{i % 40} ", "")] + words[20:]
        if toxic:
            words.insert(int(rng.integers(0, len(words))), "scum")
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, _ = T.learn(make_docs(rows), marks, F.lit(True))
    # The passage's own border words have many contexts; its inner words have few.
    assert "scum" in lexicon and len([t for t in lexicon if t.startswith("passage")]) <= 2
