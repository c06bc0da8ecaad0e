"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Every link between different texts is counted,
classes are the connected components of the links.

1. One pass hashes each text's shingles and takes 128 MinHash values, cut into 32
   bands of four. Texts at the threshold share a band but for 5 in 10^8. Copies
   (equal up to white space) are one *text* from here on, combined on the map side.
2. Texts that share a band with another are *active*. Each bucket gives star
   edges to its smallest text, never pairs; their connected components are
   the candidate groups. Inactive texts are done.
3. Shingles of the active texts alone are shuffled, once, to their candidate
   group. There MinHash values are compared 16 at a time and a pair is
   dropped as soon as the posterior probability that its similarity reaches
   0.8 (uniform prior) is under ``TOLERANCE``; the pairs that stay are
   verified on their whole shingle sets. A task returns link counts and a
   spanning forest of the links, rows in proportion to the texts.
4. A group too large for one task is cut into chunks. Members within distance
   0.1 of the group's pivot are linked with one another by the triangle
   inequality of the Jaccard distance, so a large group of near copies
   costs one comparison a member. The others are compared with the texts of
   their own buckets, in blocks; a pair that shares several bands counts in the first.

Memory a task is bounded by ``CHUNK_TEXTS`` and ``CHUNK_SHINGLES`` (and by the
longest text). Joins are equi-joins that Spark may split where a key is hot;
groupings are combined before the shuffle. Nothing but counts reaches the driver.

Defined results: a text of one to four words is one shingle; texts without a
word (null and empty ones) have no shingle, no links, and are each their own
class. The class id is the smallest doc_id of the class (null only if all are
null); repeated rows are copies. A text of any length is one row of one task. Small groups compare
all their pairs, large ones those that share a band, as candidates do (a pair at the threshold shares
none with odds of 5 in 10^8). Only the id and the text are read (``keep_one`` carries rows as one struct), so
other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import SPACE, saved, text_of
from promolift.llm.pieces import Remembered

WORDS = 5
THRESHOLD = (4, 5)  # 0.8, as a fraction so that verification is exact
N_HASHES, N_BANDS, STEP = 128, 32, 16
TOLERANCE = 1e-9
CHUNK_TEXTS, CHUNK_SHINGLES = 1024, 2_000_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; word hashes are remembered up to a bound."""

    def __init__(self, keep: int = 24 << 20):
        self.known = Remembered(keep)  # bytes

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").split()  # ASCII white space
        if not words:
            return np.empty(0, dtype=np.uint64)
        self.known.learn((w, xxhash.xxh64_intdigest(w)) for w in self.known.missing(set(words)))
        codes = np.fromiter(map(self.known.young.__getitem__, words), dtype=np.uint64, count=len(words))
        self.known.forget()
        n = min(WORDS, len(words))
        out = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = (out + codes[i:i + len(out)]) * _ROLL
            out ^= out >> np.uint64(29)
        out = (out ^ (out >> np.uint64(33))) * _MIX
        out = (out ^ (out >> np.uint64(33))) * _MIX2
        return np.unique(out ^ (out >> np.uint64(33)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The 128 MinHash values (upper 32 bits of the least product)."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at:at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band, different between bands."""
    rows = signature.reshape(N_BANDS, -1).astype(np.uint64)
    out = np.arange(1, N_BANDS + 1, dtype=np.uint64) * _MIX2
    for i in range(rows.shape[1]):
        out = (out ^ rows[:, i]) * _MIX
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among n for which P(similarity >= threshold) is not under the tolerance.

    With a uniform prior the posterior after k matches is Beta(k+1, n-k+1);
    its upper tail is a binomial sum.
    """
    tail = 0.0
    for k in range(n + 1):
        tail += comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k)
        if tail >= tolerance:
            return k
    return n


_LEAST = {n: least_matches(n) for n in range(STEP, N_HASHES + 1, STEP)}


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index pairs (i, j) of signatures that no step of the comparison drops."""
    out = []
    for i, one in enumerate(left):
        alive = np.arange(len(right))
        same = np.zeros(len(right), dtype=np.int32)
        for at in range(0, N_HASHES, STEP):
            same = same + (right[alive, at:at + STEP] == one[at:at + STEP]).sum(axis=1)
            ok = same >= _LEAST[at + STEP]
            alive, same = alive[ok], same[ok]
            if not len(alive):
                break
        if len(alive):
            out.append(np.column_stack([np.full(len(alive), i), alive]))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _alike(inter: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    return THRESHOLD[1] * inter >= THRESHOLD[0] * (n_left + n_right - inter)


def verified(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The pairs whose whole shingle sets are similar enough."""
    if not len(pairs):
        return pairs
    n_left = np.array([len(s) for s in left], dtype=np.int64)
    n_right = np.array([len(s) for s in right], dtype=np.int64)
    # Sizes alone decide many: the similarity is at most smaller / larger.
    a, b = n_left[pairs[:, 0]], n_right[pairs[:, 1]]
    pairs = pairs[THRESHOLD[1] * np.minimum(a, b) >= THRESHOLD[0] * np.maximum(a, b)]
    if len(pairs) <= 8 * (len(left) + len(right)):
        inter = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], dtype=np.int64)
        return pairs[_alike(inter, n_left[pairs[:, 0]], n_right[pairs[:, 1]])]
    # Many pairs: all intersections at once, over the shingles that more than one text has.
    rows = np.concatenate([np.repeat(np.arange(len(left)), n_left), len(left) + np.repeat(np.arange(len(right)), n_right)])
    values, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column = (np.cumsum(count > 1) - 1)[column[shared]]
    rows, n_columns = rows[shared], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(left), len(right)))
    for at in range(0, n_columns, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(left) + len(right), min(2048, n_columns - at)), dtype=np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        total += part[:len(left)] @ part[len(left):].T
    inter = total[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return pairs[_alike(inter, n_left[pairs[:, 0]], n_right[pairs[:, 1]])]


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links, by union-find."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


# ---------------------------------------------------------------- on Spark

def key_of(text_col: str = "text") -> Column:
    """Name of a text: MD5 of its words with one space between."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(text_of(text_col), SPACE, " "))))


def _has_words(text_col: str) -> Column:
    return text_of(text_col).rlike(r"[^\x20\x09-\x0D]")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text with a word, saved: key, rep_id, copies, n_shingles, bands."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            n_shingles, found = [], []
            for text in batch["text"]:  # one text's shingles at a time
                s = shingler(text)
                n_shingles.append(len(s))
                found.append(bands(minhash(s)))
            yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "n_shingles": n_shingles, "bands": found})
    rows = docs.where(_has_words(text_col)).select(
        key_of(text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    found = rows.mapInPandas(hashed, "key binary, id long, n_shingles long, bands array<long>")
    return saved(found.groupBy("key").agg(F.min("id").alias("rep_id"), F.count("*").alias("copies"),
                                          F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "ngram_texts")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the smallest node.

    Alternates linking larger and smaller neighbours to the least one until
    the edges are stars. Minima are combined before the shuffle and joined back
    on the node, so a hub's edges may be split over tasks.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    stars = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while (now := mark(stars)) != before and now[0]:
        before = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def candidate_groups(texts: DataFrame) -> DataFrame:
    """(key, grp) of the active texts, saved."""
    each = texts.select("key", F.explode("bands").alias("band"))
    least = each.groupBy("band").agg(F.min("key").alias("m"), F.max("key").alias("x")).where("m != x").select("band", "m")
    edges = each.join(least, "band").where("key != m").select(F.col("key").alias("a"), F.col("m").alias("b")).distinct()
    return saved(components(edges).select(F.col("node").alias("key"), F.col("root").alias("grp")), "ngram_groups")


def _shipped(docs: DataFrame, active: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Active texts with shingles and signature, one row each (two at most differ in nothing)."""
    name = F.concat_ws(":", F.hex("key"), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    rows = docs.select(key_of(text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       text_of(text_col).alias("text")).withColumn("name", name).drop("id")
    wanted = active.withColumn("id", F.col("rep_id")).withColumn("name", name).select(
        "name", "grp", "copies", "n_chunks", "chunk")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at:at + 256]
                sets = [shingler(t) for t in some["text"]]
                yield pd.DataFrame({"key": some["key"], "grp": some["grp"], "copies": some["copies"], "n_chunks": some["n_chunks"],
                                    "chunk": some["chunk"], "shingles": [s.tobytes() for s in sets],
                                    "signature": [minhash(s).tobytes() for s in sets]})
    # The texts move once at any size of the active side, which is never broadcast.
    return rows.join(wanted.hint("shuffle_hash"), "name").mapInPandas(packed, SHIPPED)


SHIPPED = "key binary, grp binary, copies long, n_chunks int, chunk int, shingles binary, signature binary"
#: A row counts links of ``key`` (other null), or is a spanning edge (key, other), counting nothing.
LINKS = "key binary, other binary, n_texts long, n_docs long"


def _arrays(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sets = [np.frombuffer(b, dtype=np.uint64) for b in rows["shingles"]]
    signatures = np.stack([np.frombuffer(b, dtype=np.uint32) for b in rows["signature"]])
    return sets, signatures, rows["copies"].to_numpy(np.int64)


def _answer(keys: list[bytes], n_texts: np.ndarray, n_docs: np.ndarray, edges: list[tuple[bytes, bytes]]) -> pd.DataFrame:
    some = np.flatnonzero(n_texts)
    return pd.DataFrame({
        "key": [keys[i] for i in some] + [a for a, _ in edges], "other": [None] * len(some) + [b for _, b in edges],
        "n_texts": n_texts[some].tolist() + [0] * len(edges), "n_docs": n_docs[some].tolist() + [0] * len(edges)})


def within(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the texts of one candidate group that fits one task."""
    rows = rows.drop_duplicates("key")
    sets, signatures, copies = _arrays(rows)
    pairs = survivors(signatures, signatures)
    pairs = verified(sets, sets, pairs[pairs[:, 0] < pairs[:, 1]])
    n_texts, n_docs = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for here, there in ((0, 1), (1, 0)):
        np.add.at(n_texts, pairs[:, here], 1)
        np.add.at(n_docs, pairs[:, here], copies[pairs[:, there]])
    keys = rows["key"].to_list()
    return _answer(keys, n_texts, n_docs, [(keys[i], keys[j]) for i, j in _forest(pairs, len(rows))])


def _small(rows: pd.DataFrame) -> pd.DataFrame:
    """Several small groups dealt to one task."""
    out = [within(g) for _, g in rows.groupby("grp", sort=False)]
    return pd.concat(out) if out else _answer([], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [])


def _near_pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """Which texts of a chunk are within distance 0.1 of the group's pivot (its first text, in every chunk)."""
    pivot = rows.loc[rows["key"] == rows["grp"], "shingles"].iloc[0]
    centre = np.frombuffer(pivot, dtype=np.uint64)
    rows = rows[rows["chunk"] == rows["at"]].drop_duplicates("key")
    near = []
    for b in rows["shingles"]:
        s = np.frombuffer(b, dtype=np.uint64)
        inter = len(np.intersect1d(s, centre, assume_unique=True))
        near.append(10 * inter >= 9 * (len(s) + len(centre) - inter))
    return pd.DataFrame({"key": rows["key"], "grp": rows["grp"], "copies": rows["copies"], "core": near})


def _between(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of the outside texts of part i of a bucket with all texts of its part j.

    A pair of two outside texts is seen from both sides, each counting its own
    links; a pair with a core text is seen once and counts for both. Texts that
    share several bands meet in several buckets and count in that of the first.
    """
    band_no = rows["band_no"].iloc[0]
    rows = rows.drop_duplicates(["key", "side"])
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(left) or not len(right):
        return _answer([], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [])
    sets_l, sig_l, copies_l = _arrays(left)
    sets_r, sig_r, copies_r = _arrays(right)
    keys_l, keys_r = left["key"].to_list(), right["key"].to_list()
    core_r = right["core"].to_numpy(bool)
    pairs = survivors(sig_l, sig_r)
    pairs = pairs[[keys_l[i] != keys_r[j] for i, j in pairs.tolist()]] if len(pairs) else pairs
    pairs = verified(sets_l, sets_r, pairs[first_band(sig_l, sig_r, pairs) == band_no])
    n = len(keys_l) + len(keys_r)
    n_texts, n_docs = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    np.add.at(n_texts, pairs[:, 0], 1)
    np.add.at(n_docs, pairs[:, 0], copies_r[pairs[:, 1]])
    back = pairs[core_r[pairs[:, 1]]] if len(pairs) else pairs
    np.add.at(n_texts, len(keys_l) + back[:, 1], 1)
    np.add.at(n_docs, len(keys_l) + back[:, 1], copies_l[back[:, 0]])
    tied = np.column_stack([pairs[:, 0], len(keys_l) + pairs[:, 1]])
    keys = keys_l + keys_r
    return _answer(keys, n_texts, n_docs, [(keys[i], keys[j]) for i, j in _forest(tied, n)])


def first_band(left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Number of the first band in which the signatures of each pair are equal (0 if in none)."""
    out = np.empty(len(pairs), dtype=np.int64)
    for at in range(0, len(pairs), 20_000):
        some = pairs[at:at + 20_000]
        equal = (left[some[:, 0]] == right[some[:, 1]]).reshape(len(some), N_BANDS, -1).all(axis=2)
        out[at:at + len(some)] = equal.argmax(axis=1)
    return out


def _large_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the groups that one task can't hold."""
    rows = saved(rows, "ngram_large")
    # The pivot goes to every chunk of its group.
    everywhere = rows.where("key = grp").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    dealt = rows.where("key != grp").withColumn("at", F.col("chunk")).unionByName(everywhere)
    judged = saved(dealt.groupBy("grp", "at").applyInPandas(
        _near_pivot, "key binary, grp binary, copies long, core boolean"), "ngram_core")
    totals = judged.where("core").groupBy("grp").agg(F.count("*").alias("n"), F.sum("copies").alias("d"))
    core = judged.where("core").join(totals, "grp").select(
        "key", F.lit(None).cast("binary").alias("other"), (F.col("n") - 1).alias("n_texts"), (F.col("d") - F.col("copies")).alias("n_docs"))
    stars = judged.where("core AND key != grp").select("key", F.col("grp").alias("other"), F.lit(0).cast("long").alias("n_texts"),
                                                       F.lit(0).cast("long").alias("n_docs"))
    known = rows.join(judged.select("key", "core"), "key").select("key", "copies", "core", "shingles", "signature")
    # The texts outside the core meet the others bucket by bucket: the work follows
    # the buckets, not the square of a group that chance similarities chained together.
    spread = known.select("key", "core", (F.octet_length("shingles") / 8).alias("s")).join(texts.select("key", "bands"), "key") \
        .select("key", "core", "s", F.posexplode("bands").alias("band_no", "band"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    buckets = spread.groupBy("band").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.bool_or(~F.col("core")).alias("waits")) \
        .where("waits AND n > 1").select("band", parts.alias("parts"))
    placed = saved(spread.join(buckets, "band").select(
        "key", "core", "band", "band_no", "parts", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int").alias("part")), "ngram_placed")
    left = placed.where("NOT core").select("key", "band", "band_no", F.col("part").alias("i"),
                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"))
    # A part goes only where a part with outside texts waits for it.
    waiting = placed.where("NOT core").select("band", F.col("part").alias("i")).distinct()
    right = placed.join(waiting, "band").select("key", "band", "band_no", "i", F.col("part").alias("j"), F.lit(1).alias("side"))
    blocks = left.unionByName(right).join(known, "key").groupBy("band", "i", "j").applyInPandas(_between, LINKS)
    return core.unionByName(stars).unionByName(blocks)


def links_of(docs: DataFrame, texts: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Link rows (see ``LINKS``), saved, and whether some group needed several tasks."""
    sizes = texts.select("key", "rep_id", "copies", "n_shingles").join(groups, "key")
    whole = sizes.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    n_chunks = F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    # Only groups of several chunks are joined back: one row for a thousand texts at most.
    large = whole.withColumn("n_chunks", n_chunks).where("n_chunks > 1").select("grp", "n_chunks")
    planned = sizes.join(large, "grp", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1))) \
        .withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(7)), F.col("n_chunks")).cast("int"))
    planned = saved(planned, "ngram_plan")
    some_large, total = planned.agg(F.max(F.col("n_chunks") > 1), F.sum("n_shingles")).first()
    shipped = _shipped(docs, planned, id_col, text_col)
    deals = max(1, -(-(total or 0) // (CHUNK_SHINGLES // 2)))
    if some_large:
        shipped = saved(shipped, "ngram_shipped")
    small = shipped.where("n_chunks = 1").withColumn("deal", F.pmod(F.xxhash64("grp"), F.lit(deals)))
    links = small.groupBy("deal").applyInPandas(_small, LINKS)
    if some_large:
        links = links.unionByName(_large_links(shipped.where("n_chunks > 1"), texts))
    return saved(links, "ngram_links"), bool(some_large)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text with a word: key, rep_id, copies, root (key of its class), n_texts, n_docs.

    ``n_texts`` counts the other texts linked, ``n_docs`` their documents.
    """
    texts = texts_of(docs, id_col, text_col)
    links, _ = links_of(docs, texts, candidate_groups(texts), id_col, text_col)
    counted = links.where("other IS NULL").groupBy("key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    roots = components(links.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    return texts.select("key", "rep_id", "copies").join(counted, "key", "left") \
        .join(roots.select(F.col("node").alias("key"), "root"), "key", "left") \
        .select("key", "rep_id", "copies", F.coalesce("root", "key").alias("root"),
                F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, class_id, n_links, n_texts.

    ``n_links`` counts the other documents of similarity 0.8 or more, copies
    of the own text among them; ``n_texts`` the different texts linked.
    """
    found = saved(classes(docs, id_col, text_col), "ngram_classes")
    # The least id of a class; both sides are one row a text.
    ids = found.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    per_text = found.join(ids, "root").select("key", "class_id", "copies", "n_texts", "n_docs")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(_has_words(text_col), key_of(text_col)).alias("key"))
    worded = rows.where("key IS NOT NULL").join(per_text, "key").select(
        F.col("_id").alias(id_col), "class_id", (F.col("n_docs") + F.col("copies") - 1).alias("n_links"), "n_texts")
    bare = rows.where("key IS NULL").select(
        F.col("_id").alias(id_col), F.col("_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_texts"))
    return worded.unionByName(bare)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; texts without words all stay."""
    found = saved(classes(docs, id_col, text_col), "ngram_classes")
    first = F.struct(F.col("rep_id").isNull(), F.col("rep_id"), F.col("key"))
    stay = found.groupBy("root").agg(F.min_by(F.struct("key", "rep_id"), first).alias("_r")).select(
        F.concat_ws(":", F.hex("_r.key"), F.coalesce(F.col("_r.rep_id").cast("string"), F.lit("none"))).alias("_name"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.where(_has_words(text_col)).select(own.alias("_doc"), F.concat_ws(":", F.hex(key_of(text_col)), F.coalesce(
        F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("none"))).alias("_name"))
    worded = named.join(stay, "_name", "left_semi").dropDuplicates(["_name"]).select("_doc.*")
    return worded.unionByName(docs.where(~_has_words(text_col)))
