"""Toxicity by misspelling-tolerant lexicon matches, weighed by their context.

A lexicon of abusive terms is learned from labelled rows and kept as a trie.
A token is turned into a Levenshtein automaton (its states are the reachable
positions for each number of edits) and the automaton is walked together with the trie, so all terms within the allowed edits are found in
one descent and dead branches are left at once. Terms of 5 or more letters
may have one edit, of 12 or more two; shorter ones are met as they are.
``wide`` matching, which the query uses, allows them whatever the token's length
(a letter left out of a 5-letter term too) and takes a swap of neighbours as one
edit. Without it the token must be long enough for the edits too, and a swap is two.

Each hit is scored with a window of tokens around it. Hits between quotation
marks, or whose window has a word of reporting, count as quoted; the others as
direct. The score is a logistic model over the exact and the misspelled hits, direct and
quoted, how strong and how dense they are.

The lexicon's terms are counted over all different labelled texts (copies count once, and shared passages too). The model is fitted
on a bounded sample of them (``MAX_TOXIC`` and ``MAX_CLEAN`` rows, the smallest hashes of their ids, so
the choice does not depend on the input's order); the bounds are parameters.
Both classes are counted over all labelled rows, and a sampled row weighs as
many as it stands for, so that scores and the cut at 0.5 do not depend on
which bounds the table's size reaches.
What is broadcast is bounded: the sample's ids, the labels (if counted under
``BROADCAST_ROWS``, else they are joined by a shuffle), the lexicon (every term
that qualifies; its size is counted first, and one beyond ``MAX_LEXICON`` is an error) and the weights. Scoring is one narrow pass over whole texts.

Defined results: a null or empty text has no hits and gets the model's base
score; rows without a label, or with a null id, are never learned from; without any
toxic label the lexicon is empty and every score is the share of toxic rows among
the labelled ones (0 if there is none). Equal texts get equal scores. Of terms equally near
a token the first in order is its match. Texts of any length are scored whole, in one task. Only the
id, the text and the kept columns are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import saved, text_of
from promolift.llm.pieces import Remembered

MAX_TOXIC, MAX_CLEAN = 6000, 12000
#: What a worker can hold: bytes of the terms with their shortened forms (more is refused, never cut); labels to broadcast.
MAX_LEXICON, BROADCAST_ROWS = 256 << 20, 2_000_000
#: A term must be in this many toxic texts, mostly in toxic ones, and the expected number of terms that are so by luck this small.
MIN_ROWS, MIN_LOG_ODDS, MAX_LUCK = 6, 2.0, 0.01
WINDOW = 8
#: Words that report speech; a hit near one is likelier quoted than meant.
REPORTING = frozenset((
    "said says wrote writes called calls quoted quote quotes word words term terms means "
    "dit écrit mot terme sagte schrieb wort begriff dijo escribió palabra término").split())
TOKEN = re.compile(r"[^\W_]+")
#: Quotation marks that open and close alike, and pairs.
MARKS = "\"“”„«»‹›"


class Trie:
    """Terms letter by letter; node 0 is the root."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][ch]
            self.term[node] = t


class Automaton:
    """Levenshtein automaton of a word.

    A state has one bit set a number of edits: bit i of set e says that the
    first i letters of the word can be matched with e edits. A step is a few
    shifts, however many positions are alive. With ``swaps``, further sets
    follow: bit i of set e says that, i letters being matched with e edits, the
    second of the next two letters has come first.
    """

    def __init__(self, word: str, edits: int, swaps: bool = False):
        self.n, self.edits, self.swaps = len(word), edits, swaps
        self.at: dict[str, int] = {}
        for i, ch in enumerate(word):
            self.at[ch] = self.at.get(ch, 0) | (1 << i)

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (min(e, self.n) + 1)) - 1 for e in range(self.edits + 1)) + (0,) * (self.edits * self.swaps)

    def step(self, state: tuple[int, ...], ch: str) -> tuple[int, ...]:
        here = self.at.get(ch, 0)
        whole = (1 << (self.n + 1)) - 1
        below = (state[0] & here) << 1
        out = [below]
        for e in range(1, self.edits + 1):
            # a match; or one edit more: an extra letter, another letter, a letter left out
            below = (((state[e] & here) << 1) | state[e - 1] | (state[e - 1] << 1) | (below << 1)) & whole
            if self.swaps:
                below |= (state[self.edits + e] & here) << 2
            out.append(below)
        if self.swaps:
            out += [state[e] & (here >> 1) for e in range(self.edits)]
        return tuple(out)

    def distance(self, state: tuple[int, ...]) -> int | None:
        """Edits with which the whole word is accepted, None if it is not."""
        return next((e for e, bits in enumerate(state[:self.edits + 1]) if bits >> self.n & 1), None)


def allowed_edits(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 12 else 2


def matches(trie: Trie, word: str, edits: int, swaps: bool = False) -> list[tuple[int, str]]:
    """(distance, term) of every term within ``edits`` of the word: automaton and trie walked together."""
    machine = Automaton(word, edits, swaps)
    found, stack = [], [(0, machine.start())]
    while stack:
        node, state = stack.pop()
        if trie.term[node] is not None and (d := machine.distance(state)) is not None:
            found.append((d, trie.term[node]))
        for ch, child in trie.children[node].items():
            if any(after := machine.step(state, ch)):
                stack.append((child, after))
    return sorted(found)


def shortened(word: str, edits: int) -> set[str]:
    """The word with up to ``edits`` letters left out. Words within that distance, swaps or not, share one of these."""
    out = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class Pieces:
    """What a token must have to be within one or two edits of some term: a piece of it, whole.

    One edit (a swap too) leaves the first or the last of two pieces whole that have a letter between
    them; two edits leave one of three. The middle one of three may have moved by one letter.
    """

    def __init__(self, terms: list[str], edits: int):
        self.first: dict[int, set[str]] = {}
        self.middle: dict[int, set[str]] = {}
        self.last: dict[int, set[str]] = {}
        for t in terms:
            size = (len(t) - edits) // (edits + 1)
            end = size if edits == 2 else len(t) - 1 - size
            self.first.setdefault(size, set()).add(t[:size])
            self.last.setdefault(end, set()).add(t[len(t) - end:])
            if edits == 2:
                self.middle.setdefault(size, set()).add(t[size + 1:2 * size + 1])

    def has(self, token: str) -> bool:
        return any(token[:n] in some for n, some in self.first.items()) \
            or any(token[len(token) - n:] in some for n, some in self.last.items() if n <= len(token)) \
            or any(token[n + 1 + by:2 * n + 1 + by] in some for n, some in self.middle.items() for by in (-1, 0, 1))


class Matcher:
    """Best lexicon term of a token, remembered for the tokens seen before (up to a bound).

    The automaton is only built for tokens that can match: those with a whole piece of a term, that
    share a shortened form with one of about their length; both are necessary for any match. Terms are
    indexed by the edits they allow, so only tokens near a term of two edits are shortened by two letters.
    """

    KEEP = 16 << 20  # bytes, each of two generations

    def __init__(self, lexicon: dict[str, float], wide: bool = False):
        self.lexicon, self.wide = lexicon, wide
        self.trie = Trie(sorted(lexicon))
        self.known = Remembered(self.KEEP)
        #: For each number of edits: the terms' pieces and forms, and the lengths of tokens they can be met in.
        self.index: dict[int, tuple[Pieces, set[str], set[int]]] = {}
        for edits in (1, 2):
            terms = [t for t in lexicon if allowed_edits(t) == edits]
            if terms:
                lengths = {len(t) + d for t in terms for d in range(-edits, edits + 1)}
                self.index[edits] = Pieces(terms, edits), set().union(*(shortened(t, edits) for t in terms)), lengths

    def find(self, token: str) -> tuple[str, int] | None:
        """(term, distance) of the nearest term, the first of the nearest in order."""
        if token in self.lexicon:
            return token, 0
        most = 2 if self.wide else allowed_edits(token)
        edits = 0
        for allowed, (pieces, forms, lengths) in self.index.items():
            reach = min(allowed, most)  # the term must allow the edits, and unless ``wide`` the token too
            if reach and len(token) in lengths and pieces.has(token) and not forms.isdisjoint(shortened(token, reach)):
                edits = reach
        if not edits:
            return None
        fit = [(d, t) for d, t in matches(self.trie, token, edits, self.wide) if d <= allowed_edits(t)]
        return (fit[0][1], fit[0][0]) if fit else None

    def find_all(self, tokens: set[str]) -> dict[str, tuple[str, int]]:
        self.known.learn((t, self.find(t)) for t in self.known.missing(tokens))
        young = self.known.young
        out = {t: best for t in tokens if (best := young[t])}
        self.known.forget()
        return out


FEATURES = ["base", "direct", "direct_strength", "direct_fuzzy", "quoted", "quoted_fuzzy", "density", "distinct", "per_100"]


def _quoted(text: str, start: int, end: int, reach: int = 120) -> bool:
    """True if the hit stands between quotation marks on its line, both near."""
    left = text[max(0, start - reach):start].rpartition("\n")[2]
    right = text[end:end + reach].partition("\n")[0]
    return any(c in MARKS for c in right) and sum(c in MARKS for c in left) % 2 == 1


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, term, distance, quoted) of every match in the text, in order."""
    low = text.lower()
    if len(low) != len(text):  # rare letters change length; offsets are those of the lower-cased text
        text = low
    vocabulary = matcher.find_all(set(TOKEN.findall(low)))
    if not vocabulary:
        return []
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(low)]
    out = []
    for i, (start, end, token) in enumerate(tokens):
        if token in vocabulary:
            term, distance = vocabulary[token]
            near = tokens[max(0, i - WINDOW):i + WINDOW + 1]
            told = any(t in REPORTING for _, _, t in near)
            out.append((start, end, term, distance, told or _quoted(text, start, end)))
    return out


def features(text: str, found: list[tuple[int, int, str, int, bool]], lexicon: dict[str, float]) -> list[float]:
    if not found:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    exact = [h for h in found if h[3] == 0]
    direct, quoted = [h for h in exact if not h[4]], [h for h in exact if h[4]]
    fuzzy = [h for h in found if h[3]]
    strength = {h[2]: lexicon[h[2]] for h in direct}
    starts = np.array([h[0] for h in found])
    near = np.searchsorted(starts, starts + 200) - np.arange(len(starts)) - 1
    return [1.0, min(1, len(direct)), np.log1p(sum(strength.values())), np.log1p(sum(not h[4] for h in fuzzy)),
            np.log1p(len(quoted)), np.log1p(sum(h[4] for h in fuzzy)), np.log1p(near.max()),
            np.log1p(len({h[2] for h in found if not h[4]})), np.log1p(100 * len(exact) / (1 + len(text) / 6))]


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, stands_for: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; the base weight is not shrunk. A row counts as the rows it stands for."""
    n = np.ones(len(y)) if stands_for is None else stands_for
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - keep * w
        step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(keep), grad)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def known_labels(labels: DataFrame, allowed, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic) of every allowed id with a label."""
    return labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).where(allowed) \
        .groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic, n_toxic, n_clean) of every different labelled text: copies are one text, with as many rows as they are.

    A text with both labels is toxic if it is so as often as not.
    """
    known = known_labels(labels, allowed, id_col)
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("text")).join(known, id_col)
    return rows.groupBy("text").agg(F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("toxic") == 0).alias("n_clean")) \
        .withColumn("toxic", F.col("n_toxic") >= F.col("n_clean"))


def sample(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text",
           max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """Up to ``max_toxic`` and ``max_clean`` labelled rows (text, toxic), saved. ``allowed``: condition on the id.

    One row an id: of rows that repeat one, the text that sorts first.
    """
    known = known_labels(labels, allowed, id_col)

    def some(toxic: int, n: int) -> DataFrame:
        return known.where(F.col("toxic") == toxic).orderBy(F.xxhash64(id_col), id_col).limit(n)
    ids = some(1, max_toxic).unionByName(some(0, max_clean))  # bounded by the two parameters
    return saved(docs.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("text"))
                 .join(F.broadcast(ids), id_col).groupBy(id_col, "toxic").agg(F.min("text").alias("text")).select("text", "toxic"),
                 "toxic_sample")


def _words(text: Column, least: int) -> Column:
    """Words of at least so many letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0))


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, bad, good, n_toxic, n_clean): different texts of each class that hold the term, saved.

    The empty term counts all texts, and the labelled rows they stand for.
    """
    words = F.array_union(_words(F.col("text"), 3), F.array(F.lit("")))
    each = texts.select("toxic", F.explode(words).alias("term"), "n_toxic", "n_clean")
    return saved(each.groupBy("term").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"),
                                          F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")), "toxic_terms")


def context_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, bad, good): different pairs of neighbours that a term has in texts of each class.

    A passage that many texts share gives its words one context, however many texts hold it.
    """
    words = F.concat(F.array(F.lit("")), _words(F.col("text"), 1), F.array(F.lit("")))
    at = F.sequence(F.lit(1), F.size("w") - 2)
    triples = F.transform(at, lambda i: F.struct(F.get("w", i).alias("term"), F.get("w", i - 1).alias("left"), F.get("w", i + 1).alias("right")))
    each = texts.select("toxic", words.alias("w")).where(F.size("w") > 2).select("toxic", F.explode(triples).alias("t")).select("toxic", "t.*")
    met = each.join(F.broadcast(terms), "term").groupBy("term", "left", "right") \
        .agg(F.bool_or("toxic").alias("t"), F.bool_or(~F.col("toxic")).alias("c"))
    return met.groupBy("term").agg(F.count_if("t").alias("bad"), F.count_if("c").alias("good"))


def _over(counts: DataFrame, share: float, tests: int) -> DataFrame:
    """Terms of ``counts`` that are over-represented beyond luck, with their log odds."""
    n = F.col("bad") + F.col("good")
    luck = F.col("bad") * F.log(F.col("bad") / n / share) + F.when(
        F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / max(1 - share, 1e-9))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / share) - F.log((F.col("good") + 0.5) / max(1 - share, 1e-9))
    return counts.where(F.col("bad") >= MIN_ROWS).withColumn("odds", odds) \
        .where((luck > math.log(max(1, tests) / MAX_LUCK)) & (F.col("odds") > MIN_LOG_ODDS)).select("term", "odds")


def learn_lexicon(texts: DataFrame, counts: DataFrame, max_bytes: int = MAX_LEXICON) -> dict[str, float]:
    """Terms that are surely over-represented in toxic texts -> log odds; all that qualify.

    A term in ``bad`` toxic texts of ``n`` has a chance of at most exp(-n D) to be so by luck, D being the
    divergence of its share of toxic texts from that of all texts (Chernoff's bound). That must be under
    ``MAX_LUCK`` divided by the number of terms looked at, or a larger corpus, with more terms, would let
    more of them in by luck. Terms that pass are counted again by their different contexts, and must
    pass again: the words of a passage that toxic texts share are not terms of abuse.
    """
    whole = counts.where(F.col("term") == "").first()
    if whole is None or not whole["bad"]:
        return {}
    share = whole["bad"] / (whole["bad"] + whole["good"])
    seen = counts.where((F.col("term") != "") & (F.col("bad") >= MIN_ROWS))
    tests = seen.count()
    first = saved(_over(seen, share, tests).select("term"), "toxic_candidates")
    _within(first, max_bytes)
    top = saved(_over(context_counts(texts, first), share, tests), "toxic_lexicon")
    return {r["term"]: float(r["odds"]) for r in top.orderBy("term").collect()}


def _within(terms: DataFrame, max_bytes: int) -> None:
    """Terms go to every worker: their size is counted first."""
    size = terms.agg(F.coalesce(F.sum(form_bytes(F.length("term"))), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the lexicon would take {size} bytes in each worker; the bound is {max_bytes}")


def form_bytes(n: Column) -> Column:
    """Bytes that a term of ``n`` characters takes in a worker with its shortened forms, generously."""
    forms = F.when(n < 5, 1).when(n < 12, n + 1).otherwise(n * n / 2 + n + 1)
    return (forms * (120 + n)).cast("long")


def learn(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text",
          max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, wide: bool = False) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights): terms from all labelled rows, weights from the bounded sample. ``wide`` as in ``score``."""
    rows = sample(docs, labels, allowed, id_col, text_col, max_toxic, max_clean)
    texts = labelled(docs, labels, allowed, id_col, text_col)
    counts = term_counts(texts)
    whole = counts.where(F.col("term") == "").first()
    sizes = {1: whole["n_toxic"], 0: whole["n_clean"]} if whole else {}
    lexicon = learn_lexicon(texts, counts)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, wide)
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, hits(t, matcher), lexicon) for t in batch["text"]], "toxic": batch["toxic"]})
    got = rows.mapInPandas(measured, "x array<double>, toxic int").toPandas()  # a few numbers for each sampled row
    weights = np.zeros(len(FEATURES))
    if not len(got) or not (got["toxic"] == 1).any():
        weights[0] = -30.0
        return lexicon, weights
    y = got["toxic"].to_numpy(dtype=float)
    stands_for = got["toxic"].map({c: sizes[c] / n for c, n in got["toxic"].value_counts().items()}).to_numpy(dtype=float)
    return lexicon, fit_weights(np.stack(got["x"].to_list()), y, stands_for=stands_for)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          wide: bool = False) -> DataFrame:
    """``keep`` columns with score (0 to 1) and the spans found (start, end, term, distance, quoted).

    ``wide``: edits by the term's length alone, a swap of neighbours is one; a model is scored as it was learned.
    """
    lexicon, weights = model
    shown = "struct<start:int,end:int,term:string,distance:int,quoted:boolean>"

    @F.pandas_udf(f"score double, spans array<{shown}>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, wide)
        for texts in batches:
            found = [hits(t, matcher) for t in texts]
            x = np.array([features(t, h, lexicon) for t, h in zip(texts, found, strict=True)]).reshape(-1, len(FEATURES))
            spans = [[{"start": a, "end": b, "term": t, "distance": d, "quoted": bool(q)} for a, b, t, d, q in h] for h in found]
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), "spans": spans})
    return docs.select(*[F.col(f"`{c}`") for c in keep], scored(text_of(text_col)).alias("_s")) \
        .select(*[F.col(f"`{c}`") for c in keep], "_s.*")
