import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from promolift.llm import packing as K
from promolift.llm.bpe import tokenizer_path
from tests.llm.conftest import rows_of

PATH = tokenizer_path("word_bpe_49k.json")


def brute_level(packer, n):
    """Least sum of squares over every level that the piece fits, a new window among them; ties to the fullest."""
    best = None
    for h in range(packer.window - n, -1, -1):
        if h and not packer.levels[h]:
            continue
        after = packer.levels.copy()
        if h:
            after[h] -= 1
        if h + n < packer.window:
            after[h + n] += 1
        value = int((after ** 2).sum())
        if best is None or value < best[0]:
            best = value, h
    return best[1]


@pytest.mark.parametrize(("window", "max_open", "sizes"), [(16, 1000, range(1, 40)), (64, 5, range(1, 60)), (64, 1000, [33]), (4096, 1024, range(1, 9000))])
def test_rule_and_whole_cover(window, max_open, sizes):
    rng = random.Random(window + max_open)
    packer, done, sent = K.Packer(window, max_open), [], {}
    for doc in range(400):
        ids = np.array([rng.randrange(50_000) for _ in range(rng.choice(sizes) if window < 4096 else rng.randrange(1, 900))], dtype="<u4")
        rest = len(ids) % window
        if rest:
            assert packer.best_level(rest) == brute_level(packer, rest)
        sent[doc] = ids
        done += packer.add(K.Piece(doc, 0, ids.tobytes(), len(ids)))
        assert packer.n_open <= max_open + 1
    done += packer.close()
    back = {}
    for w in done:
        n = sum(map(len, w.pieces))
        assert n == w.filled and (n == window or n & (n - 1) == 0)
        for p in w.pieces:
            back.setdefault(p.doc, []).append(p)
    for doc, ids in sent.items():
        pieces = sorted(back[doc], key=lambda p: p.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [len(p) for p in pieces[:-1]]).tolist()
        assert b"".join(p.ids for p in pieces) == ids.tobytes()
    assert packer.n_open == 0 and not packer.levels.any()


def test_documents(make_docs):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", " ", "Hello  World's <|endoftext|>\tÉ́ x\x1cy\x85z", "long word " * 9000, "a" * 20_000, "ÀÉ ß ẞ İ"] + [f"doc number {i} " * (i % 50) for i in range(80)]
    rows = [*enumerate(texts), (None, "no id"), (3, "repeated id")]
    docs = make_docs(rows, extra=("start", "ids", "sequence_id"))
    got = rows_of(K.pack_documents(docs, PATH, with_ids=True))
    by = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and 4 * r["length"] == len(r["ids"]) > 0
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[i, len(ids)], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == ids and [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces[:-1]]).tolist()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_runs_alike_and_empty(make_docs):
    docs = make_docs([(i, f"text {i} " * i) for i in range(60)])
    one, two = (sorted(map(str, K.pack_documents(docs, PATH).collect())) for _ in range(2))
    assert one == two
    assert K.pack_documents(make_docs([]), PATH).count() == 0


def test_words_stay_known():
    """A quarter of a million words are encoded once, however often they come."""
    from promolift.llm.pieces import WordEncoder
    encoder = WordEncoder(PATH)
    pairs = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    words = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxy" for b in pairs for c in pairs]
    texts = [" ".join(words[at:at + 5000]) for at in range(0, len(words), 5000)]
    first = [ids for text in texts for ids in encoder.encode_many([text])]
    learned = []
    learn = encoder._learn
    encoder._learn = lambda new: (learned.extend(new), learn(new))
    assert [ids for text in texts for ids in encoder.encode_many([text])] == first
    assert not learned
