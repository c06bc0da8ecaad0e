import random
import re
from collections import Counter

import pytest

from promolift.llm import quality
from tests.llm.conftest import rows_of

WS = r"[\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    words = [w for w in re.split(WS, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in often for k in (i, i + 1, i + 2)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_letter_words": sum(any(c.isalpha() for c in w) for w in words)}


def texts():
    rng = random.Random(5)
    some = ["", None, " \n\t ", "a", "a b", "a b c", "a b c a b c", "x y z w x y z", "é ü 𝒳 é ü 𝒳", "a\n\na\n a\na", "# $ % & | < > * #",
            "w " * 3000, "line one two\n" * 40, "\x0b\x0cfoo\rbar\tbaz"]
    for _ in range(60):
        n = rng.choice([5, 30, 60, 300])
        some.append("".join(rng.choice("abc") + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n)))
    return some


def test_measurements_equal_brute_force(make_docs):
    given = texts()
    got = {r["doc_id"]: r for r in rows_of(quality.ledger(make_docs(enumerate(given), extra=("_words", "n_words", "w"))))}
    for i, text in enumerate(given):
        want = measured(text)
        assert {k: got[i][k] for k in want} == want, repr(text)


def test_bits_and_policies(make_docs):
    entries = quality.ledger(make_docs([(1, None), (2, "good word here is one " * 1), (3, " ".join(f"wort{i}" for i in range(60))),
                                        (4, " ".join(f"w{i}#" for i in range(60))), (5, "same line of text\n" * 30)]))
    got = {r["doc_id"]: r for r in rows_of(quality.apply_policy(entries))}
    assert not got[3]["rule_bits"] and got[3]["kept"]
    assert got[1]["base_failed"] and got[1]["rule_bits"] & quality.BIT["few_words"]
    assert not got[4]["base_failed"] and not got[4]["kept"] and got[4]["rule_bits"] & quality.BIT["symbols"]
    assert got[5]["rule_bits"] & quality.BIT["repeated_words"] and got[5]["rule_bits"] & quality.BIT["duplicate_lines"]
    assert {r["doc_id"] for r in rows_of(quality.apply_policy(entries, "base")) if r["kept"]} == {3, 4}
    table = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rows_of(quality.ablation(entries))}
    assert table["few_words"] == (2, 2) and table["symbols"] == (1, 1) and table["repeated_words"] == (1, 0)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "t"), (1, "t")]])
def test_small_tables(make_docs, rows):
    docs = make_docs(rows, extra=("rule_bits", "kept"))
    assert quality.ledger(docs).count() == len(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 0


def test_keep_good_returns_own_columns(make_docs):
    docs = make_docs([(None, " ".join(f"wort{i}" for i in range(60))), (2, "short")], extra=("text2", "_lines", "rule_bits"))
    got = rows_of(quality.keep_good(docs))
    assert len(got) == 1 and got[0]["doc_id"] is None and got[0]["rule_bits"] == "x" and got[0]["_lines"] == "x"
