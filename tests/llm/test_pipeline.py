import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from promolift.llm import oracle, queries, secrets
from promolift.llm.bpe import tokenizer_path
from promolift.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import rows_of
from tests.llm.test_ngram_join import brute as near_classes
from tests.llm.test_quality import measured


def test_registry():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(oracle.ORACLE) <= set(entry.oracle_sql()) <= names
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(oracle.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: str(r)
    assert sorted((tuple(r[c] for c in columns) for r in rows_of(got)), key=key) == sorted(
        (tuple(r) for r in want.project(", ".join(columns)).fetchall()), key=key)


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "secret_scan", "sequences"]
    rows = {r["doc_id"]: r for r in rows_of(docs)}

    good = stages["quality_rules"](spark, docs, SMALL).cache()
    assert good.columns == docs.columns
    for r in rows_of(good):
        m = measured(r["text"])
        assert m["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"]

    single = stages["exact_copies"](spark, good, SMALL).cache()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in rows_of(good):
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in rows_of(single)) == sorted(first.values())

    apart = stages["near_copies"](spark, single, SMALL).cache()
    want = sorted(d for d, c, _, _ in near_classes([(r["doc_id"], r["text"]) for r in rows_of(single)]) if d == c)
    assert sorted(r["doc_id"] for r in rows_of(apart)) == want and all(r["text"] == rows[r["doc_id"]]["text"] for r in rows_of(apart))

    safe = stages["secret_scan"](spark, apart, SMALL).cache()
    assert safe.columns == docs.columns and sorted(r["doc_id"] for r in rows_of(safe)) == want
    changed = [r for r in rows_of(safe) if r["text"] != rows[r["doc_id"]]["text"]]
    assert all("[SECRET]" in r["text"] for r in changed)

    packed = rows_of(stages["sequences"](spark, safe, SMALL))
    assert {r["doc_id"] for r in packed} == set(want)
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def plain_redacted(rows):
    """Texts with the secrets of fewer than three owners cut out: spans, owners and cutting in plain Python."""
    patterns = [(re.compile(p, re.ASCII), group, least) for p, group, least in secrets.KINDS.values()]
    found, owners = {}, {}
    for i, text, source in rows:
        for rank, (pattern, group, least) in enumerate(patterns):
            for m in pattern.finditer(text or ""):
                if len(m.group(group)) >= least:
                    found.setdefault(i, []).append((m.start(), rank, m.end(), m.group(group)))
                    owners.setdefault(m.group(group), set()).add(source)
    out = {}
    for i, text, _ in rows:
        cut, at = "", 0
        for start, _, end, value in sorted(found.get(i, [])):
            if len(owners[value]) < 3:
                cut += (text[at:start] + "[SECRET]") if start >= at else ""
                at = max(at, end)
        out[i] = None if text is None else cut + text[at:]
    return out


def test_secret_stage_equals_brute_force(spark):
    docs = table(spark, SMALL.replace("0.001", "0.01"), "documents")  # large enough to hold live secrets
    want = plain_redacted([(r["doc_id"], r["text"], r["source"]) for r in rows_of(docs)])
    got = {r["doc_id"]: r["text"] for r in rows_of(corpus_pipeline.secret_scan(spark, docs, SMALL))}
    assert got == want and sum("[SECRET]" in (t or "") for t in got.values()) > 0


def test_sequences_hold_the_librarys_ids(spark):
    """Pieces put together by document are the library's ids with the end token; by sequence they have no gap."""
    docs = table(spark, SMALL, "documents")
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in rows_of(corpus_pipeline.sequences(spark, docs, SMALL)):
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    for r in rows_of(docs):
        want = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert sum((ids for _, ids in sorted(pieces[r["doc_id"]])), []) == want
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_quality_stage_equals_brute_force(spark):
    """Every rule of the policy, not the base rules alone."""
    docs = table(spark, SMALL, "documents")
    stay = []
    for r in rows_of(docs):
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = len(words), sum(map(len, words))
        repeated, seen = set(), {}
        for k in range(n - 2):
            seen.setdefault(tuple(words[k:k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                repeated.update(j for k in places for j in (k, k + 1, k + 2))
        failed = [n < 50, 100 * len(repeated) > 50 * n, 10 * len(re.findall(r"[#*$%&|<>]", text)) > n,
                  100 * (len(lines) - len(set(lines))) > 60 * len(lines), chars < 2 * n, chars > 20 * n,
                  2 * sum(any(c.isalpha() for c in w) for w in words) < n]
        if not any(failed):
            stay.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows_of(corpus_pipeline.quality_rules(spark, docs, SMALL))) == sorted(stay)


def test_clashing_columns_travel_through(spark):
    """Columns with the names that stages use inside stay as they are."""
    names = ["_hash", "_live", "key", "grp", "digest", "row", "rule_bits", "spans", "_doc", "_name"]
    docs = table(spark, SMALL, "documents").selectExpr("*", *[f"concat('c', doc_id) AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[-len(names):] == names, name
    rows = rows_of(docs)
    assert rows and all(r[n] == f"c{r['doc_id']}" for r in rows for n in names)
