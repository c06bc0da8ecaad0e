"""Exact deduplication over a cuckoo-filter index of live digests.

The index is cut into *shards* by digest. A shard holds the digests that are
live (with their holder and the number of live copies) and a cuckoo filter
over them: two candidate buckets of four 16-bit fingerprints a digest. A
lookup asks the filter first; only a hit is verified against the shard's
stored content, so absent digests, the common case, cost two bucket reads.
Deletion takes the fingerprint out when the last copy goes. When an insertion
finds no place after ``MAX_KICKS`` moves, the filter doubles and is built anew
from the stored digests, so no digest is ever lost to an overflow.

On Spark: texts are normalised and hashed (SHA-256) inside the JVM, only
digests are shuffled. Copies are combined per input partition before the
shuffle, so a text that makes up a third of the corpus reaches its shard as
one row per partition. Shards are sized by a count of the digests
(``SHARD_ROWS``), so their memory is bounded at any corpus size. Decisions go
back to the rows by a join on the digest (Spark may split a hot digest there).

Defined results: a null text counts as empty; equal are texts that are
identical after each run of white space is replaced by one space. The row with the
smallest id stays; rows with a null id come last, and of rows with the same id
the first as read. An empty table gives an empty result. Extra columns stay
out of the decisions, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import SPACE, saved, text_of

SLOTS = 4
MAX_KICKS = 400
SHARD_ROWS = 200_000


class CuckooFilter:
    """Approximate membership of 32-byte digests, with deletion.

    The alternative bucket of an entry follows from its bucket and its
    fingerprint alone, so entries can move without the digest at hand.
    """

    def __init__(self, n_buckets: int = 64):
        self.n_buckets = n_buckets  # a power of two
        self.slots = [0] * (n_buckets * SLOTS)
        self.turn = 0

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1  # 0 marks an empty slot

    def first_bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (self.n_buckets - 1)

    def other_bucket(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n_buckets - 1)

    def _slot(self, bucket: int, value: int) -> int:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[at] == value:
                return at
        return -1

    def contains(self, digest: bytes) -> bool:
        fp, one = self.fingerprint(digest), self.first_bucket(digest)
        return self._slot(one, fp) >= 0 or self._slot(self.other_bucket(one, fp), fp) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if no place was found; the filter must then be rebuilt larger."""
        fp, bucket = self.fingerprint(digest), self.first_bucket(digest)
        for b in (bucket, self.other_bucket(bucket, fp)):
            at = self._slot(b, 0)
            if at >= 0:
                self.slots[at] = fp
                return True
        for _ in range(MAX_KICKS):
            self.turn += 1
            at = bucket * SLOTS + self.turn % SLOTS
            fp, self.slots[at] = self.slots[at], fp
            bucket = self.other_bucket(bucket, fp)
            at = self._slot(bucket, 0)
            if at >= 0:
                self.slots[at] = fp
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        fp, one = self.fingerprint(digest), self.first_bucket(digest)
        for b in (one, self.other_bucket(one, fp)):
            at = self._slot(b, fp)
            if at >= 0:
                self.slots[at] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.slots, dtype="<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(max(1, len(data) // (2 * SLOTS)))
        out.slots = np.frombuffer(data, dtype="<u2").tolist()
        return out


class Shard:
    """A cuckoo filter over the stored content of one shard: digest -> [holder, live copies]."""

    def __init__(self, content: dict[bytes, list] | None = None, filter_bytes: bytes | None = None):
        self.content = content or {}
        self.n_resized = self.n_false_hits = 0
        if filter_bytes is None:
            self.filter = CuckooFilter()
            self._rebuild(self.filter.n_buckets)
        else:
            self.filter = CuckooFilter.from_bytes(filter_bytes)

    def _rebuild(self, n_buckets: int) -> None:
        while True:
            self.filter = CuckooFilter(n_buckets)
            if all(map(self.filter.insert, self.content)):
                return
            n_buckets *= 2

    def holds(self, digest: bytes) -> bool:
        if not self.filter.contains(digest):
            return False
        if digest in self.content:  # a hit is verified against the stored content
            return True
        self.n_false_hits += 1
        return False

    def insert(self, digest: bytes, holder: tuple, copies: int = 1) -> None:
        if self.holds(digest):
            entry = self.content[digest]
            entry[0], entry[1] = min(entry[0], holder), entry[1] + copies
            return
        self.content[digest] = [holder, copies]
        if not self.filter.insert(digest):
            self.n_resized += 1
            self._rebuild(2 * self.filter.n_buckets)

    def settle(self, digest: bytes, holder: tuple, copies: int) -> None:
        """Make these the holder and the live copies; a digest without live copies leaves the index."""
        if self.holds(digest):
            self.content[digest] = [holder, copies]
            if copies <= 0:
                del self.content[digest]
                self.filter.delete(digest)
        elif copies > 0:
            self.insert(digest, holder, copies)

    def delete(self, digest: bytes, copies: int = 1) -> None:
        """Take copies away, whichever they are; a digest without live copies leaves the index. Unknown ones are ignored."""
        if self.holds(digest):
            entry = self.content[digest]
            entry[1] -= copies
            if entry[1] <= 0:
                del self.content[digest]
                self.filter.delete(digest)


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256)


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, row) of every document row, saved: the only pass over the texts."""
    return saved(docs.select(F.unhex(digest_of(text_col)).alias("digest"), F.col(f"`{id_col}`").cast("long").alias("id"),
                             F.monotonically_increasing_id().alias("row")), "dedup_keys")


#: After every id, so that rows without one come last.
NO_ID = (1 << 63) - 1

DELTA = "digest binary, id long, row long, copies long"
ENTRY = "shard int, digest binary, id long, row long, copies long, filter binary"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest of an input partition: its first holder and its copies.

    What is held is one batch and the digests of up to ``SHARD_ROWS`` rows.
    """
    held: dict[bytes, list] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"digest": list(held), "id": [h[0][0] for h in held.values()],
                             "row": [h[0][1] for h in held.values()], "copies": [h[1] for h in held.values()]})
    for batch in batches:
        for digest, i, row, copies in zip(batch["digest"], batch["id"], batch["row"], batch["copies"], strict=True):
            entry = held.get(digest)
            if entry is None:
                held[digest] = [(i, row), copies]
            else:
                entry[0], entry[1] = min(entry[0], (i, row)), entry[1] + copies
        if len(held) >= SHARD_ROWS:
            yield out()
            held.clear()
    if held:
        yield out()


def _shard_of(n_shards: int) -> Column:
    # The last bytes of the digest: the filter uses the first ones.
    return F.pmod(F.conv(F.hex(F.substring("digest", 26, 7)), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


def _rows(shard_id: int, shard: Shard) -> pd.DataFrame:
    items = list(shard.content.items())
    return pd.DataFrame({
        "shard": shard_id, "digest": [d for d, _ in items] + [None], "id": [e[0][0] for _, e in items] + [0],
        "row": [e[0][1] for _, e in items] + [0], "copies": [e[1] for _, e in items] + [0],
        "filter": [None] * len(items) + [shard.filter.to_bytes()]})


def shards_for(n_rows: int) -> int:
    return max(1, -(-n_rows // SHARD_ROWS))


def settled(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """Holder and live copies of every digest that ``deletes`` touches, derived anew from the key rows.

    A delete takes away one row of its digest and id, of rows that repeat both
    the last as read; one that names no row changes nothing.
    """
    gone = deletes.groupBy("digest", "id").agg(F.count("*").alias("n_gone"))
    each = rows.join(gone.select("digest").distinct(), "digest", "left_semi").groupBy("digest", "id").agg(
        F.count("*").alias("n"), F.min("row").alias("row")).alias("r")
    both = (F.col("r.digest") == F.col("g.digest")) & F.col("r.id").eqNullSafe(F.col("g.id"))
    stay = F.greatest(F.col("n") - F.coalesce("n_gone", F.lit(0)), F.lit(0))
    left = each.join(gone.alias("g"), both, "left").select(
        "r.digest", F.coalesce("r.id", F.lit(NO_ID)).alias("id"), "row", stay.alias("stay"))
    holder = F.min(F.when(F.col("stay") > 0, F.struct("id", "row")))
    return left.groupBy("digest").agg(holder.alias("h"), F.sum("stay").alias("copies")).select(
        "digest", F.coalesce("h.id", F.lit(0)).alias("id"), F.coalesce("h.row", F.lit(0)).alias("row"), "copies")


def update(index: DataFrame | None, inserts: DataFrame | None, deletes: DataFrame | None = None,
           n_shards: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The index after a batch of inserts, then deletes (both as ``keys_of`` gives them).

    ``rows``: the key rows that are live before the deletes, those of
    ``inserts`` too. With them each delete takes away the row it names, and
    the smallest row left becomes the holder. Without them the index, which
    stores one row a digest, can only count: every delete of a live digest
    lowers its copies, and the holder it names may be gone.

    Returns the new index table, saved in the shared folder; the old one stays
    valid until its files go, so a failed update changes nothing. When the
    live digests outgrow the shards, the next update with a larger
    ``n_shards`` deals them anew from the stored digests.
    """
    def deltas(keys: DataFrame, sign: int) -> DataFrame:
        one = keys.select("digest", F.coalesce("id", F.lit(NO_ID)).alias("id"), "row", F.lit(1).cast("long").alias("copies"))
        return one.mapInPandas(_combined, DELTA).withColumn("copies", F.col("copies") * sign)
    given = [deltas(k, s).withColumn("final", F.lit(False)) for k, s in ((inserts, 1), (deletes, -1))
             if k is not None and (s > 0 or rows is None)]
    if deletes is not None and rows is not None:
        given.append(settled(rows, deletes).withColumn("final", F.lit(True)))
    if not given:
        raise ValueError("nothing to apply")
    batch = given[0] if len(given) == 1 else given[0].unionByName(given[1])
    if n_shards is None:
        # A count of the keys sizes the shards; no digest comes to the driver.
        n_shards = shards_for(sum(k.count() for k in (inserts, deletes) if k is not None)
                              + (index.where("digest IS NOT NULL").count() if index is not None else 0))
        old = index.agg(F.max("shard")).first()[0] if index is not None else None
        if old is not None:
            n_shards = max(n_shards, old + 1)
    batch = batch.withColumn("shard", _shard_of(n_shards))

    def apply(shard: Shard, rows: pd.DataFrame) -> Shard:
        rows = rows.sort_values(["final", "copies", "id", "row"], ascending=[True, False, True, True], kind="stable")
        for digest, i, row, copies, final in zip(rows["digest"], rows["id"], rows["row"], rows["copies"], rows["final"], strict=True):
            if final:
                shard.settle(digest, (i, row), copies)
            elif copies > 0:
                shard.insert(digest, (i, row), copies)
            else:
                shard.delete(digest, -copies)
        return shard

    if index is None:
        def fresh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return _rows(key[0], apply(Shard(), rows))
        return saved(batch.groupBy("shard").applyInPandas(fresh, ENTRY), "dedup_index")

    stored = index
    if (index.agg(F.max("shard")).first()[0] or 0) + 1 != n_shards:
        stored = index.where("digest IS NOT NULL").withColumn("shard", _shard_of(n_shards))

    def onto(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        live = old[old["digest"].notna()]
        content = {d: [(i, r), c] for d, i, r, c in zip(live["digest"], live["id"], live["row"], live["copies"], strict=True)}
        kept = old.loc[old["digest"].isna(), "filter"]
        return _rows(key[0], apply(Shard(content, kept.iloc[0] if len(kept) else None), rows))
    return saved(stored.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(onto, ENTRY), "dedup_index")


def live(index: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of every live digest."""
    return index.where("digest IS NOT NULL").select(
        "digest", F.when(F.col("id") != NO_ID, F.col("id")).alias("keep_id"), F.col("row").alias("keep_row"),
        F.col("copies").alias("group_size"))


def decide(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Per key row: keep_id, group_size, kept."""
    return keys.join(live(index), "digest").withColumn(
        "kept", (F.col("row") == F.col("keep_row")) & F.col("id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, keep_id, group_size, kept, text_sha256)."""
    keys = keys_of(docs, id_col, text_col)
    return decide(keys, update(None, keys)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, its own columns unchanged.

    The rows that stay are named by (digest, id); of repeated rows with both
    alike, one stays.
    """
    keys = keys_of(docs, id_col, text_col)
    name = F.concat_ws(":", F.lower(F.hex("digest")), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    stay = decide(keys, update(None, keys)).where("kept").select(name.alias("_name"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(own.alias("_doc"), F.concat_ws(":", digest_of(text_col), F.coalesce(
        F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("none"))).alias("_name"))
    return named.join(stay, "_name", "left_semi").dropDuplicates(["_name"]).select("_doc.*")
