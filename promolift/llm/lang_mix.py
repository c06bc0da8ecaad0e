"""Language identification by inferring a mixture of languages.

A document is seen as draws from several languages: each of its character
trigrams (over UTF-8 bytes of the lower-cased text, hashed to 2^16 cells)
comes from language l with probability share(l) * P(gram | l).
Expectation-maximisation estimates the shares; the set of languages is chosen
by penalised likelihood, adding the next likely language only while twice the
gain of log-likelihood exceeds the penalty ``PENALTY * log(grams)``. The
predicted language is the one with the largest share of the chosen set.

The model is counted over every training row (no sample): each task sums its
rows into one table of cells a language, tasks' tables are merged by a grouped
sum. Its size is 2^16 cells a language whatever the corpus, which bounds what
is collected and broadcast. Prediction is one narrow pass, row by row, over
whole texts; memory is one Arrow batch.

Defined results: a text that is null or has no letter is ``und`` with score 0; so
is every text when no language could be learned. Equal texts get equal
results; of languages equally likely the first in order is taken. Long texts are counted piece
by piece. Only the text (and the label, in training) and the kept columns are read, so others
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 16
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS = 12
#: Texts are hashed piece by piece of this many bytes, so a long text needs little extra memory.
PIECE = 1 << 20


def grams(text: str) -> np.ndarray:
    """Counts per cell, as (cells, counts) of a whole text's byte trigrams."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    if len(data) < 3:
        data = np.concatenate([data, np.full(3 - len(data), 32, dtype=np.uint8)])
    if len(data) <= 1 << 15:
        return np.unique(_cells(data), return_counts=True)
    total = np.zeros(CELLS, dtype=np.int64)
    for at in range(0, len(data) - 2, PIECE):
        total += np.bincount(_cells(data[at:at + PIECE + 2]), minlength=CELLS)
    used = np.flatnonzero(total)
    return used, total[used]


def _cells(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log P[cell, language]) from every row with a text and a label."""
    given = rows.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()) \
        .select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang not in tables:
                    tables[lang] = np.zeros(CELLS, dtype=np.int64)
                cells, n = grams(text)
                tables[lang][cells] += n
        for lang, table in tables.items():
            used = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "cell": used.astype(np.int32), "n": table[used]})
    # At most 2^16 rows a language.
    got = given.mapInPandas(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((CELLS, len(langs)))
    counts[got["cell"].to_numpy(), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = got["n"]
    total = counts.sum(axis=0, keepdims=True)
    return langs, np.log((counts + SMOOTHING) / (total + SMOOTHING * CELLS)).astype(np.float64)


def mixture(n: np.ndarray, logp: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of each column and the log-likelihood they reach, by expectation-maximisation."""
    top = logp.max(axis=1)
    p = np.exp(logp - top[:, None])
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        weighted = p * share
        new = (n / weighted.sum(axis=1)) @ weighted / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ (np.log(p @ share) + top))


def infer(n: np.ndarray, logp: np.ndarray) -> dict[int, float]:
    """Chosen languages (columns) and their shares."""
    alone = n @ logp
    chosen, best = [int(alone.argmax())], float(alone.max())
    shares = np.ones(1)
    if logp.shape[1] == 1:
        return {chosen[0]: 1.0}
    full, _ = mixture(n, logp)
    penalty = PENALTY * np.log(max(2, n.sum()))
    # Languages in order of their share in the full mixture, after the likeliest one.
    for nxt in [int(i) for i in np.argsort(-full, kind="stable") if i != chosen[0]]:
        # A share so small cannot pay its penalty: the gain is at most n * share * largest ratio.
        if full[nxt] * n.sum() < 2:
            break
        trial, likelihood = mixture(n, logp[:, [*chosen, nxt]])
        if 2 * (likelihood - best) <= penalty:
            break
        chosen, best, shares = [*chosen, nxt], likelihood, trial
    return dict(zip(chosen, shares.tolist(), strict=True))


PREDICTED = "lang_pred string, score double, languages array<string>, shares array<double>"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score (its share), and the chosen languages with their shares."""
    langs = model[0]
    held = docs.sparkSession.sparkContext.broadcast(model[1])  # 2^16 cells a language

    @F.pandas_udf(PREDICTED)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logp = held.value
        for texts in batches:
            out = []
            for text in texts:
                if not langs or text is None or not has_letter(text):
                    out.append(("und", 0.0, [], []))
                    continue
                cells, n = grams(text)
                found = infer(n.astype(np.float64), logp[cells])
                order = sorted(found, key=lambda i: (-found[i], i))
                out.append((langs[order[0]], min(1.0, found[order[0]]), [langs[i] for i in order], [found[i] for i in order]))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages", "shares"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], judged(F.col(text_col).cast("string")).alias("_p")) \
        .select(*[F.col(f"`{c}`") for c in keep], "_p.*")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
