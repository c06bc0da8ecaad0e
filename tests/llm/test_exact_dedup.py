import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from promolift.llm import exact_dedup as D
from tests.llm.conftest import rows_of


def dig(i):
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
def test_shard_behaves_like_a_counter(ops):
    shard, live = D.Shard(), {}
    for add, i in ops:
        if add:
            shard.insert(dig(i), (i, 0))
            live[i] = live.get(i, 0) + 1
        else:
            shard.delete(dig(i))
            live = {k: n - (k == i) for k, n in live.items() if n - (k == i) > 0}
    assert {d: e[1] for d, e in shard.content.items()} == {dig(i): n for i, n in live.items()}
    assert all(shard.holds(dig(i)) == (i in live) for i in range(41))


def test_overflow_resizes_without_loss():
    shard = D.Shard()
    for i in range(5000):
        shard.insert(dig(i), (i, 0))
    assert shard.n_resized > 2 and all(shard.holds(dig(i)) for i in range(5000))
    again = D.Shard(dict(shard.content), shard.filter.to_bytes())
    assert all(again.filter.contains(dig(i)) for i in range(5000))
    for i in range(0, 5000, 2):
        again.delete(dig(i))
    assert all(again.holds(dig(i)) == bool(i % 2) for i in range(5000))
    # The filter forgets deleted digests too, but for rare equal fingerprints.
    assert sum(again.filter.contains(dig(i)) for i in range(0, 5000, 2)) < 50


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def some_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "c", "", None, " ", "\n", "é  𝒳", "long " * 9000])) for i in range(200)]
    return rows + [(None, "c"), (None, "only null"), (None, "only null"), (5, "twice"), (5, "twice")]


def test_groups_equal_brute_force(make_docs):
    rows = some_rows()
    got = rows_of(D.exact_groups(make_docs(rows, extra=("digest", "row", "keep_id"))))
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(brute(rows), key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_copies(make_docs):
    docs = make_docs(some_rows(), extra=("_name", "_digest"))
    out = D.drop_copies(docs)
    assert out.columns == docs.columns
    got = rows_of(out)
    want = {(h, i) for _, i, _, h in brute(some_rows())}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(((hashlib.sha256(norm(r["text"]).encode()).hexdigest(), r["doc_id"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["_name"] == "x" for r in got)


def test_updates_insert_and_delete(make_docs, monkeypatch):
    monkeypatch.setattr(D, "SHARD_ROWS", 20)
    first = make_docs([(i, f"text {i % 30}") for i in range(60)])
    index = D.update(None, D.keys_of(first))
    assert index.agg({"shard": "max"}).first()[0] == 2
    more, gone = make_docs([(100 + i, f"text {i}") for i in range(25, 90)]), make_docs([(i, f"text {i % 30}") for i in range(10)] + [(5, "unknown")])
    index = D.update(index, D.keys_of(more), D.keys_of(gone))
    sizes = {bytes(r["digest"]): r["group_size"] for r in rows_of(D.live(index))}
    want = {}
    for i in range(90):
        n = 2 * (i < 30) + (i >= 25) - (i < 10)
        if n:
            want[hashlib.sha256(f"text {i}".encode()).digest()] = n
    assert sizes == want
    index = D.update(index, None, D.keys_of(make_docs([(i, f"text {i}") for i in range(10)])))
    assert {bytes(r["digest"]) for r in rows_of(D.live(index))} == {hashlib.sha256(f"text {i}".encode()).digest() for i in range(10, 90)}


def test_empty_table(make_docs):
    assert D.exact_groups(make_docs([])).count() == 0
    assert D.drop_copies(make_docs([])).count() == 0


def test_deletes_name_the_next_holder(make_docs, monkeypatch):
    monkeypatch.setattr(D, "SHARD_ROWS", 20)
    rows = [(i, f"text {i % 20}") for i in range(60)] + [(5, "text 5"), (None, "text 7"), (None, "none")]
    # Holders, one of two rows alike, a whole group, rows without an id, and ids that were never inserted.
    gone = [(i, f"text {i}") for i in range(10)] + [(29, "text 9"), (49, "text 9"), (None, "none"), (1000, "text 3"), (3, "text 4"), (1, "unknown")]
    keys, deletes = D.keys_of(make_docs(rows)), D.keys_of(make_docs(gone))
    index = D.update(D.update(None, keys), None, deletes, rows=keys)
    left = list(rows)
    for row in gone:
        if row in left:
            left.remove(row)
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in rows_of(D.live(index))}
    want = {hashlib.sha256(t.encode()).digest(): (i, n) for i, n, t in {
        (min((j for j, u in left if u == t and j is not None), default=None), sum(u == t for _, u in left), t) for _, t in left}}
    assert got == want
    firsts = keys.groupBy("digest", "id").agg({"row": "min"}).withColumnRenamed("min(row)", "row")
    kept = rows_of(D.decide(firsts.join(D.keys_of(make_docs(left)), ["digest", "id"], "left_semi"), index).where("kept"))
    assert sorted(bytes(r["digest"]) for r in kept) == sorted(want)
    # The same in one batch.
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in rows_of(D.live(D.update(None, keys, deletes, rows=keys)))} == want
