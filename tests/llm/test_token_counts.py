import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promolift.llm import token_counts as T
from promolift.llm.bpe import tokenizer_path
from tests.conftest import SMALL
from tests.llm.conftest import rows_of

PATH = tokenizer_path("byte_bpe_50k.json")
WHOLE = T.prove_whole(PATH)
SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return T.TokenCounter(PATH, WHOLE)


def test_proven_strings(library):
    plain = sorted(WHOLE[0])
    assert len(plain) > 40_000
    for text in random.Random(3).sample(plain, 2000):
        assert library(text) == 1


def test_proven_words_are_not_merged(counter):
    before = counter.merged
    assert counter.count_many(["The house is big and the garden is small."]) == [10]
    assert counter.merged == before


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*SPACES, "<|endoftext|>", "'s", "'ll", "über", "naïve", "北京", "12345", "!!", "a" * 90]),
                          st.text(max_size=12)), max_size=25))
def test_equals_library(parts):
    text = "".join(parts)
    t = Tokenizer.from_file(PATH) if not hasattr(test_equals_library, "t") else test_equals_library.t
    test_equals_library.t = t
    c = getattr(test_equals_library, "c", None) or T.TokenCounter(PATH, WHOLE)
    test_equals_library.c = c
    assert c.count_many([text]) == [len(t.encode(text, add_special_tokens=False).ids)]


def test_long_texts(library, monkeypatch):
    monkeypatch.setattr(T.TokenCounter, "BATCH", 500)
    c = T.TokenCounter(PATH, WHOLE)
    rng = random.Random(4)
    words = ["the", "  ", "Überblick", "x1y2", "\n\n", "don't", "我们在北京，他们", "。", "<|endoftext|>", "zzzzqqqq", " ", "!?"]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(2000))
        assert c.count_many(["a b", text, ""]) == [2, library(text), 0]
    for text in ("x" * 50_000, "我们在北京，他们。" * 3000, " " * 20_000, "ab1" * 9000):
        assert c.count_many([text]) == [library(text)]


def test_memory_is_bounded_by_characters(monkeypatch, library):
    monkeypatch.setattr(T.TokenCounter, "KEEP_CHARS", 2000)
    c = T.TokenCounter(PATH, WHOLE)
    base = len(c.counts)
    for i in range(50):
        texts = [f"qx{i}z{j}vw {'k' * 100}{j} 北京{i}x{j}" for j in range(20)]
        assert c.count_many(texts) == [library(t) for t in texts]
        assert c.remembered < 2000 + 20 * 40 and len(c.counts) - base < 500
        assert all(len(w) <= c.LONGEST for w in c.counts if w not in WHOLE[0])


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows_of(T.count_tokens(docs, PATH)):
        n = library(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


def test_odd_rows(spark, make_docs, library):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "same"), (4, "same"), (5, "word " * 1024 + "end"), (6, "🙂é\x00")]
    got = rows_of(T.count_tokens(make_docs(rows, extra=("n_tokens", "id", "n_bytes")), PATH))
    want = [(i, len((t or "").encode()), library(t or "")) for i, t in rows]
    assert sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got)) == sorted((i or 0, b, n) for i, b, n in want)
    assert {r["doc_id"] for r in got if r["over_limit"]} == {5}
    assert T.count_tokens(make_docs([(1, "a")]).limit(0), PATH).collect() == []
