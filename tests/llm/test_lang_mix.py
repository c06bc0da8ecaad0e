import numpy as np
import pytest

from promolift.llm import lang_mix as L
from tests.llm.conftest import rows_of

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it goes home with the others who have seen the thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann geht er nach hause mit den anderen die es sahen",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis il rentre à la maison avec les autres qui ont vu",
}


def shuffled(lang, seed, n=60):
    words = SAMPLES[lang].split()
    return " ".join(np.random.default_rng(seed).choice(words, n))


@pytest.fixture(scope="module")
def model(make_docs):
    return L.train(make_docs([(i, shuffled(x, i), "s", x) for i in range(40) for x in SAMPLES] + [(900, None, "s", "en"), (901, "text", "s", None)]))


def test_predicts_held_out_and_special_cases(make_docs, model):
    rows = [(i, shuffled(x, 1000 + i), "s", "xx") for i, x in enumerate(list(SAMPLES) * 5)]
    odd = [(100, None), (101, ""), (102, "12 34 !!"), (103, "a"), (104, shuffled("de", 7) * 600), (None, shuffled("fr", 8)), (100, None)]
    got = rows_of(L.predict(make_docs(rows + odd, extra=("lang_pred", "score")), model))
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == x for i, x in enumerate(list(SAMPLES) * 5))
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (100, 101, 102))
    assert by[103]["lang_pred"] in SAMPLES and by[104]["lang_pred"] == "de" and by[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture_finds_both_languages(make_docs, model):
    text = shuffled("de", 1, 120) + " " + shuffled("en", 2, 60)
    r = rows_of(L.predict(make_docs([(1, text)]), model))[0]
    assert r["languages"] == ["de", "en"] and r["lang_pred"] == "de"
    assert abs(r["shares"][0] - 0.68) < 0.12 and abs(sum(r["shares"]) - 1) < 1e-6
    alone = rows_of(L.predict(make_docs([(1, shuffled("en", 3, 200))]), model))[0]
    assert alone["languages"] == ["en"] and alone["score"] == 1.0


def test_em_never_lowers_likelihood():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(50), 3).T)
    n = rng.integers(1, 9, 50).astype(float)
    reached = [L.mixture(n, logp, rounds)[1] for rounds in range(1, 30)]
    assert all(b >= a - 1e-9 for a, b in zip(reached, reached[1:], strict=False))


def test_long_text_counts_like_short_pieces():
    text = shuffled("en", 4, 30000)
    cells, n = L.grams(text)
    want = np.bincount(L._cells(np.frombuffer(text.encode(), dtype=np.uint8)), minlength=L.CELLS)
    assert (want[cells] == n).all() and n.sum() == len(text) - 2


def test_nothing_learned_and_empty(make_docs):
    none = L.train(make_docs([(1, None)]))
    assert [r["lang_pred"] for r in rows_of(L.predict(make_docs([(1, "words")]), none))] == ["und"]
    assert L.predict(make_docs([]), none).count() == 0


def plain_cells(text):
    """Trigram counts by cell, byte by byte."""
    data = text.lower().encode()
    data += b" " * (3 - len(data))
    out = {}
    for i in range(len(data) - 2):
        code = (data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435769 % (1 << 32) >> 16
        out[code] = out.get(code, 0) + 1
    return out


def plain_mixture(n, columns):
    """Expectation-maximisation over (cell -> count) with plain loops; columns: cell -> P."""
    share = [1 / len(columns)] * len(columns)
    total = sum(n.values())
    for _ in range(L.ROUNDS):
        new = [0.0] * len(columns)
        for cell, count in n.items():
            weight = [s * p[cell] for s, p in zip(share, columns, strict=True)]
            for i, w in enumerate(weight):
                new[i] += count * w / sum(weight) / total
        moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
        share = new
        if moved < 1e-4:
            break
    return share, sum(count * np.log(sum(s * p[cell] for s, p in zip(share, columns, strict=True))) for cell, count in n.items())


def plain_predict(text, langs, tables):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, []
    n = plain_cells(text)
    total = {x: sum(tables[x].values()) for x in langs}
    p = {x: {c: (tables[x].get(c, 0) + 0.5) / (total[x] + 0.5 * 65536) for c in n} for x in langs}
    alone = {x: sum(k * np.log(p[x][c]) for c, k in n.items()) for x in langs}
    chosen = [max(langs, key=lambda x: alone[x])]
    best, shares = alone[chosen[0]], [1.0]
    full = dict(zip(langs, plain_mixture(n, [p[x] for x in langs])[0], strict=True))
    for x in sorted((x for x in langs if x != chosen[0]), key=lambda x: -full[x]):
        if full[x] * sum(n.values()) < 2:
            break
        trial, likelihood = plain_mixture(n, [p[y] for y in [*chosen, x]])
        if 2 * (likelihood - best) <= 2.0 * np.log(max(2, sum(n.values()))):
            break
        chosen, best, shares = [*chosen, x], likelihood, trial
    order = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
    return chosen[order[0]], min(1.0, shares[order[0]]), [chosen[i] for i in order]


def test_equals_brute_force(make_docs):
    """Counts, likelihoods, mixtures and the chosen languages, against plain Python over the same rows."""
    rows = [(i, shuffled(x, i, 30), "s", x) for i in range(12) for x in SAMPLES] + [(500, None, "s", "en"), (501, "lost", "s", None)]
    tables = {x: {} for x in SAMPLES}
    for _, text, _, lang in rows:
        if text is not None and lang is not None:
            for c, k in plain_cells(text).items():
                tables[lang][c] = tables[lang].get(c, 0) + k
    model = L.train(make_docs(rows))
    assert model[0] == sorted(SAMPLES)
    rng = np.random.default_rng(6)
    texts = [None, "", "123", "é", "ab"]
    for n in range(40):
        some = rng.choice(sorted(SAMPLES), int(rng.integers(1, 4)), replace=False)
        texts.append(" ".join(shuffled(str(x), 50 + n, int(rng.integers(2, 80))) for x in some))
    got = {r["doc_id"]: r for r in rows_of(L.predict(make_docs(list(enumerate(texts))), model))}
    for i, text in enumerate(texts):
        lang, score, languages = plain_predict(text, sorted(SAMPLES), tables)
        assert (got[i]["lang_pred"], got[i]["languages"]) == (lang, languages)
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
