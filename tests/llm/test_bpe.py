import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promolift.llm import bpe as B
from tests.llm.conftest import rows_of

PATH = B.tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = B.Codec(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def by_tree(text, size):
    return B.concatenate(CODEC, [(p.encode(), CODEC.encode(p)) for p in B.leaves(text, size)]).tolist()


letters = st.text(alphabet=st.sampled_from("aab 's\n\t!é𝒳1한 \u0085\x1c<|>"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(letters)
def test_pieces_give_the_librarys_ids(text):
    assert CODEC.encode(text).tolist() == library(text)
    assert "".join(CODEC.pieces(text)) == text
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(library(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(letters, st.sampled_from(["<|endoftext|>", "a" * 300, "=" * 200, " " * 150, "'s" * 60, "the cat's "])), max_size=12), st.integers(5, 90))
def test_tree_concatenation_is_exact(parts, size):
    text = "".join(parts)
    assert by_tree(text, size) == library(text)


@pytest.mark.parametrize("text", [
    "a" * 20_000, "ab" * 9000, "antidisestablishment" * 700, "é" * 9000, "한국어" * 3000, "1234567890" * 1500, "!?" * 5000, " " * 9000, "\n" * 5000, "x'll" * 3000,
    "<|endoftext|>" * 500, "<|endo" * 900, "𝒳" * 4000])
def test_long_unsplit_texts(text):
    for size in (50, 333, 4096):
        assert by_tree(text, size) == library(text)


SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()] + ["\u200b", "\ufeff"]


@pytest.mark.parametrize("space", SPACES)
def test_white_space_near_a_window_end(space):
    """A window that ends after white space sees one run where the whole text has two pieces."""
    filler = "The cat sat. " * 60
    for k in range(0, 24):
        for run in (space, " " + space, space * 2, space + " "):
            right = ("the cat " * 40)[:124 - k] + "." + run + "|" + "x y " * 10 + filler
            left = filler[:500]
            joined = B.concatenate(CODEC, [(p.encode(), CODEC.encode(p)) for p in (left, right)])
            assert joined.tolist() == library(left + right)


@pytest.mark.parametrize("space", ["\x85", "\u2003", "\u2009", "\u2028", " "])
def test_white_space_at_the_real_leaf(space):
    filler = "The cat sat. " * 4000
    for k in range(12):
        text = (filler[:20000] + ("the cat " * 40)[:124 - k] + "." + " " + space + "|" + "x y " * 10 + filler)[:40_000]
        assert by_tree(text, B.LEAF) == library(text)


def test_random_joins():
    """Random texts of kinds that change often, cut anywhere: joins equal the library."""
    rng = random.Random(77)
    bits = [*SPACES, " ", " ", "'", "'s", "'ll", "a", "bc", "Word", "12", "!", "?'", "''", "é", "한", "𝒳", "<|endoftext|>", "<|endo", "\n\n", "   "]
    for n in range(400):
        some = rng.sample(bits, rng.randrange(2, 9)) if n % 2 else bits
        text = "".join(rng.choice(some) * rng.choice((1, 1, 1, 2, 40)) for _ in range(rng.randrange(100, 400)))
        want = library(text)
        for _ in range(5):
            at = rng.randrange(len(text))
            parts = [(p.encode(), CODEC.encode(p)) for p in (text[:at], text[at:])]
            assert B.concatenate(CODEC, parts).tolist() == want


def test_random_unsplit_letters():
    rng = random.Random(8)
    for _ in range(20):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3000, 9000)))
        assert by_tree(text, 64) == library(text)


def test_table_of_documents(make_docs):
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, " "), (4, "Hello world's  \n end <|endoftext|> x"), (5, "z" * 50_000), (6, "word " * 30_000), (None, "x y"), (4, "again"),
            (7, "".join(rng.choice("abcdefg ,.'") for _ in range(100_000)))]
    docs = make_docs(rows, extra=("row", "leaf", "ids"))
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in rows_of(
        B.encode_documents(docs, PATH, leaf=5000, with_ids=True))), key=str)
    want = []
    for i, text in rows:
        ids = library(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want, key=str)


def test_empty(make_docs):
    assert B.encode_documents(make_docs([]), PATH).count() == 0
    assert CODEC.encode("").tolist() == [] and B.concatenate(CODEC, []).tolist() == []
    assert isinstance(CODEC.encode("a"), np.ndarray)
