"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

A text over ``LEAF`` characters is halved again and again, at any character,
without regard to words. The leaves are encoded in parallel by different
tasks, then neighbours are joined bottom-up: a window around the join is
encoded anew, and grows until it agrees with both sides.

Why the result is exact. Within a word (a piece of the pre-tokenizer) tokens are *the* encoding of
their text if every adjacent pair is the encoding of the pair's own text. At each side of the join a token is
looked for that window and side have alike, at the same place, with ``GUARD`` bytes of the window
between it and both the join and the window's end. There the sides are spliced: pairs up to
the left token come from the left side, from there to the right token from the window, then from the right side, so
each pair is valid. Words are alike too: where a word ends depends on the kinds of the characters around
(one after white space included, of which the pre-tokenizer looks at the next character), and on the run that
a character stands in. Within ``GUARD`` bytes either the kind changes, which both see alike, or
both are within one run, whose end both see. A special token across the join lies in the window.
Where a window reaches an end of the text, nothing needs to agree there.

Within a leaf, equal words are encoded once by a worker (``pieces``), by the
library itself.

Defined results: null is the empty text, which has no tokens; equal texts get
equal results; an empty table gives an empty result. A long text's leaves
meet again in one task, which holds that text and its ids. Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import saved, text_of
from promolift.llm.pieces import ByteEncoder, shared

LEAF = 1 << 15
FIRST_WINDOW = 128
GUARD = 32


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs
    stand for themselves, the other bytes for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(ByteEncoder):
    """A byte-level BPE tokenizer file: exact ids, exact decoding."""

    def __init__(self, path: str):
        super().__init__(path)
        signs = byte_signs()
        special = set(self.tokenizer.get_added_tokens_decoder())
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if i in special else bytes(signs[c] for c in token)
        self.n_bytes = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.numbers = [str(i) for i in range(len(self.token_bytes))]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the library gives them without added special tokens."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, dtype="<i4") for ids in self.encode_many(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens kept."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def ids_text(self, ids: np.ndarray) -> str:
        numbers = self.numbers
        return ",".join([numbers[i] for i in ids.tolist()])


# ---------------------------------------------------------------- tree concatenation

def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text halved until no part is longer than ``size`` characters."""
    if len(text) <= size:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], size) + leaves(text[half:], size)


def join(codec: Codec, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Ids of the concatenation from the ids of both sides (text bytes, ids)."""
    (lb, li), (rb, ri) = left, right
    if not lb or not rb:
        return lb + rb, li if not rb else ri
    middle = len(lb)
    left_at = np.concatenate([[0], np.cumsum(codec.n_bytes[li])])    # where tokens begin, and the end
    right_at = middle + np.concatenate([[0], np.cumsum(codec.n_bytes[ri])])
    width = FIRST_WINDOW
    while True:
        a = _char_start(lb, max(0, middle - width), -1)
        b = _char_start(rb, min(len(rb), width), 1)
        ids = codec.encode((lb[a:] + rb[:b]).decode("utf-8", "replace"))
        at = a + np.concatenate([[0], np.cumsum(codec.n_bytes[ids])])
        first = _alike(at, ids, left_at, li, a + GUARD, middle - GUARD)
        last = _alike(at, ids, right_at, ri, middle + GUARD, middle + b - GUARD)
        if (a == 0 or len(first[0])) and (b == len(rb) or len(last[0])):
            head, i = (0, 0) if a == 0 else (first[1][0], first[0][0])
            j, tail = (len(ids), len(ri)) if b == len(rb) else (last[0][-1] + 1, last[1][-1] + 1)
            return lb + rb, np.concatenate([li[:head], ids[i:j], ri[tail:]])
        width *= 2


def _char_start(data: bytes, at: int, step: int) -> int:
    """The nearest border of characters from ``at``, going by ``step``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def _alike(at: np.ndarray, ids: np.ndarray, side_at: np.ndarray, side: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (window, side) of equal tokens at the same place, whole within [low, high]."""
    begin, end = np.searchsorted(side_at[:-1], [low, high])
    _, i, j = np.intersect1d(at[:-1], side_at[begin:end], assume_unique=True, return_indices=True)
    j += begin
    ok = (ids[i] == side[j]) & (at[i + 1] <= high)
    return i[ok], j[ok]


def concatenate(codec: Codec, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Join neighbours level by level until one part is left."""
    while len(parts) > 1:
        paired = [join(codec, parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
        parts = paired + parts[len(paired) * 2:]
    return parts[0][1] if parts else np.empty(0, dtype="<i4")


# ---------------------------------------------------------------- on Spark

def _digests(codec: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(codec.ids_text(ids).encode()).hexdigest(),
            hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF,
                     with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (and the ids, if asked for).

    ``path`` is read by the executors; it must exist on each of them.
    """
    columns = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    # ``text`` is set for a leaf still to be encoded; ``row`` names its document.
    first = columns + ", row string, leaf int, text string"

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        codec, n = shared(Codec, path), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, out = batch.iloc[at:at + 256], []
                long = some["text"].str.len() > leaf
                short = some[~long]
                for i, ids in zip(short["id"], codec.encode_all(short["text"].to_list()), strict=True):
                    out.append((i, *_digests(codec, ids), ids if with_ids else None, None, None, None))
                for i, text in zip(some.loc[long, "id"], some.loc[long, "text"], strict=True):
                    n += 1
                    out += [(i, None, None, None, None, f"{task}-{n}", k, part) for k, part in enumerate(leaves(text, leaf))]
                frame = pd.DataFrame(out, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "row", "leaf", "text"])
                yield frame.astype({"id": "Int64", "n_tokens": "Int64", "leaf": "Int32"})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    begun = saved(rows.mapInPandas(start, first), "bpe_first")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared(Codec, path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at:at + 64]
                yield some.assign(ids=[x.tobytes() for x in codec.encode_all(some["text"].to_list())])
    parts = begun.where("text IS NOT NULL").select("id", "row", "leaf", "text") \
        .repartition(F.col("row"), F.col("leaf")).mapInPandas(encode, "id long, row string, leaf int, text string, ids binary")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared(Codec, path)
        for batch in batches:
            out = []
            for i, found in zip(batch["id"], batch["parts"], strict=True):
                tree = [(p["text"].encode("utf-8"), np.frombuffer(p["ids"], dtype="<i4")) for p in sorted(found, key=lambda p: p["leaf"])]
                ids = concatenate(codec, tree)
                out.append((i, *_digests(codec, ids), ids if with_ids else None))
            yield pd.DataFrame(out, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]).astype({"id": "Int64"})
    # A document's own leaves meet again: as much as its text, in one row.
    joined = parts.groupBy("row").agg(F.first("id").alias("id"), F.collect_list(F.struct("leaf", "text", "ids")).alias("parts")) \
        .select("id", "parts").mapInPandas(finish, columns)
    whole = begun.where("text IS NULL").select("id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").unionByName(joined)
    return whole.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
