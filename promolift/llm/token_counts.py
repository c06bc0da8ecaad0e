"""Token counts by the whole-token shortcut.

Before any text is read, the driver proves which strings of a vocabulary
encode alone as one token: each is encoded by the library, and those that give
exactly one are kept (a set bounded by the vocabulary). A string that encodes alone
as one token is one pre-token, and the ids of a pre-token depend on it alone, so
a pre-token found in the set counts one wherever it stands. Only the
others are merged, by the library's own model, each different one
once while it is remembered.

Pre-tokens of plain Latin text come from the tokenizer's pattern (``pieces``);
any other piece is split by the library's pre-tokenizer and looked up in the
same set. A piece that holds the text of a special token goes to the library whole, so
the special text counts as its default does: one token.

How it runs: one narrow pass over whole texts, nothing shuffled; the set is
broadcast. A worker remembers merged words up to a bound in characters, and long
texts are taken slice by slice.

Defined results: a null or empty text has no bytes and no tokens; equal texts
get equal counts; an empty table gives an empty result. Only the id and
the text are read, so other columns may have any name. ``path`` must exist on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolift.llm.bpe import byte_signs
from promolift.llm.common import ready, text_of
from promolift.llm.pieces import ByteEncoder

LIMIT = 1024


def prove_whole(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """Vocabulary strings that encode alone as one token: as text, and in the vocabulary's byte signs."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    signs = byte_signs()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    written = {}
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token in special or not all(c in signs for c in token):
            continue
        try:
            text = bytes(signs[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
        written[text] = token
    texts = list(written)
    alone = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    proven = [t for t, e in zip(texts, alone, strict=True) if len(e.ids) == 1]
    return frozenset(proven), frozenset(written[t] for t in proven)


class TokenCounter(ByteEncoder):
    """Counts of texts: proven pre-tokens count one, the others are merged."""

    #: Characters of remembered words; a longer word than ``LONGEST`` is never remembered.
    KEEP_CHARS, LONGEST = 4_000_000, 64
    #: A cut that no pre-token reaches over, for scripts without blanks: a letter or number, then a sign.
    _CUT = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W_])(?=[。、，．！？；：])")

    def __init__(self, path: str, whole: tuple[frozenset[str], frozenset[str]]):
        super().__init__(path)
        self.whole, self.whole_signs = whole
        sign_of = {b: c for c, b in byte_signs().items()}
        self.signs = {i: "".join(sign_of[b] for b in chr(i).encode()) for i in range(0x250)}
        self.counts = dict.fromkeys(self.whole, 1)
        self.remembered = 0
        self.merged = 0  # pre-tokens that were merged, for tests and tuning

    def merge(self, pretoken: str) -> int:
        """Tokens of one pre-token, written in byte signs."""
        if pretoken in self.whole_signs:
            return 1
        self.merged += 1
        return len(self.tokenizer.model.tokenize(pretoken))

    def _count(self, word: str, odd: bool) -> int:
        if not odd:
            return self.merge(word.translate(self.signs))
        if self.special.search(word):
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return sum(self.merge(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word))

    def _sum(self, texts: list[list[str]]) -> list[int]:
        if self.remembered > self.KEEP_CHARS:
            self.counts, self.remembered = dict.fromkeys(self.whole, 1), 0
        counts = self.counts
        passing = []
        for word in set().union(*texts).difference(counts):
            counts[word] = self._count(word, word in self.odd)
            if len(word) > self.LONGEST:
                passing.append(word)
            else:
                self.remembered += len(word)
        self.odd.clear()
        out = [sum(map(counts.__getitem__, words)) for words in texts]
        for word in passing:
            del counts[word]
        return out

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        for m in self._CUT.finditer(text):
            if m.start() - start >= self.BATCH:
                yield text[start:m.start()]
                start = m.start()
        yield text[start:]

    def count_many(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            if size + len(text) > 2 * self.BATCH:
                out += self._sum(some)
                some, size = [], 0
            if len(text) > 2 * self.BATCH:
                out.append(sum(self._sum([self.words(part)])[0] for part in self.slices(text)))
            else:
                some.append(self.words(text))
                size += len(text)
        return out + self._sum(some)


_counters: dict[str, TokenCounter] = {}


def _counter(path: str, whole: tuple[frozenset[str], frozenset[str]]) -> TokenCounter:
    """One counter a worker process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path, whole)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    ready(spark)
    proven = spark.sparkContext.broadcast(prove_whole(path))  # bounded by the vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path, proven.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": counter.count_many(batch["text"].to_list())})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                       text_of(text_col).alias("text"))
    found = rows.mapInPandas(count, "id long, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
