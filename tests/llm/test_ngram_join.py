import random
import re

import numpy as np
import pytest

from promolift.llm import ngram_join as N
from tests.llm.conftest import rows_of


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, class_id, n_links, n_texts) of every row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    norm = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links, texts = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 5 * inter >= 4 * (len(sets[i]) + len(sets[j]) - inter):
                    links[i] += 1
                    if norm[i] != norm[j]:
                        texts[i].add(norm[j])
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        out.append((d, min(known) if known else None, links[i], len(texts[i])))
    return sorted(out, key=str)


def corpus(seed=1, groups=12, size=9, near=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    rows = [(None, "a b c"), (500, None), (501, ""), (502, " \n"), (503, "a b c"), (504, "a  b c"), (505, "a b"), (506, "one two three four five six")]
    i = 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 40, 120, 300]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = word()
            rows.append((i, (" " if rng.random() < 0.8 else "\n ").join(t)))
            i += 1
    base = [word() for _ in range(150)]
    for k in range(near):  # one large group of near copies, all different, and exact copies of it
        t = list(base)
        t[k * 3] = f"own{k}"
        rows += [(1000 + k, " ".join(t))] * 1
    rows += [(2000 + k, " ".join(base)) for k in range(15)]
    rows += [(3000 + k, " ".join(word() for _ in range(60))) for k in range(30)]
    return rows + [(7, rows[15][1]), (7, rows[15][1])]


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in rows_of(df)), key=str)


@pytest.mark.parametrize("chunk", [1024, 7])
def test_join_equals_all_pairs(make_docs, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK_TEXTS", chunk)  # 7: groups of many chunks
    rows = corpus()
    assert got(N.jaccard_join(make_docs(rows, extra=("key", "grp", "class_id")))) == brute(rows)


def test_spread_group_over_chunks(make_docs, monkeypatch):
    """Texts around the threshold, so that links, non-links and core members mix in one group."""
    monkeypatch.setattr(N, "CHUNK_TEXTS", 6)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(45):
        t = list(base)
        for p in rng.sample(range(0, 200, 5), rng.choice([0, 1, 2, 4, 6])):
            t[p] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(t)))
    assert got(N.jaccard_join(make_docs(rows))) == brute(rows)


def test_keep_one_of_each_class(make_docs):
    rows = corpus(seed=2, groups=5)
    docs = make_docs(rows, extra=("_name", "root"))
    out = N.keep_one(docs)
    assert out.columns == docs.columns
    kept = rows_of(out)
    stay = {(d, c) for d, c, _, _ in brute(rows) if d == c}
    worded = [r for r in kept if shingles(r["text"])]
    assert {r["doc_id"] for r in worded} == {d for d, _ in stay if shingles(dict(rows).get(d)) or d == 7}
    assert len(worded) == len({r["doc_id"] for r in worded})
    assert sorted(r["doc_id"] for r in kept if not shingles(r["text"])) == [500, 501, 502]


def test_hashes_equal_sets():
    rng = random.Random(3)
    one = N.Shingler()
    for _ in range(50):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(40))]
        b = a[: len(a) // 2] + [rng.choice("abcdef") for _ in range(9)]
        x, y = one(" ".join(a)), one("\t".join(b))
        assert len(x) == len(shingles(" ".join(a))) and len(np.intersect1d(x, y)) == len(shingles(" ".join(a)) & shingles(" ".join(b)))


def test_pruning_keeps_what_can_reach_the_threshold():
    assert 0 < N.least_matches(16) < N.least_matches(64) < N.least_matches(128) < 103
    # At similarity 0.8 a pair passes all steps but very rarely.
    rng = np.random.default_rng(5)
    left = rng.integers(0, 2**32, (400, N.N_HASHES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 2**32, left.shape, dtype=np.uint32))
    pairs = N.survivors(left, right)
    assert {(i, i) for i in range(400)} <= set(map(tuple, pairs.tolist())) and len(pairs) == 400


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {(i.to_bytes(4, "big"), root(i).to_bytes(4, "big")) for i in parent}
    found = [(bytes(r["node"]), bytes(r["root"])) for r in rows_of(N.components(df))]
    assert set(found) == want and len(found) == len(want)


def test_empty_and_single(make_docs):
    assert N.jaccard_join(make_docs([])).count() == 0 and N.keep_one(make_docs([])).count() == 0
    assert got(N.jaccard_join(make_docs([(3, "just one text of some words")]))) == [(3, 3, 0, 0)]


def test_very_long_texts(make_docs):
    base = [f"w{i}" for i in range(60_000)]
    other = list(base)
    other[5] = "x"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:30_000]))]
    assert got(N.jaccard_join(make_docs(rows))) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 0)]
