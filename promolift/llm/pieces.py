"""Encoding texts word by word, each different word once.

The tokenizer's own word pattern is run here on texts of Latin letters,
digits, ASCII signs and ASCII white space, on which it is a plain regular
expression. Equal words have equal ids, so the ids of a word are remembered,
and new words are encoded many at a time. Any other text is cut at places that
no word reaches over; a plain piece of it is treated alike, the others go to the
library as they are. Memory is bounded in bytes: there are two generations of
remembered words, and the older one goes when the younger is full; long words
are not remembered, and long texts are taken slice by slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII signs.
SIGNS = r"!-/:-@\[-`{-~"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class Remembered:
    """A map bounded in bytes, with two generations; what is used stays.

    Keys over ``LONGEST`` characters are kept only until ``forget`` is called.
    """

    LONGEST = 64
    #: Bytes of an entry besides its characters: two objects and their place in the map.
    ENTRY = 200

    def __init__(self, keep: int):
        self.keep, self.size, self.young, self.old, self.passing = keep, 0, {}, {}, []

    def missing(self, keys: set) -> list:
        """The keys that are not known; the known ones are in ``young`` afterwards."""
        if self.size > self.keep:
            self.size, self.young, self.old = 0, {}, self.young
        left = keys.difference(self.young)
        old = self.old
        if not old:
            return list(left)
        self.learn((k, old[k]) for k in left if k in old)
        return [k for k in left if k not in old]

    def learn(self, pairs: Iterable[tuple]) -> None:
        for key, value in pairs:
            self.young[key] = value
            if len(key) > self.LONGEST:
                self.passing.append(key)
            else:
                self.size += self.ENTRY + 4 * len(key)

    def forget(self) -> None:
        for key in self.passing:
            self.young.pop(key, None)
        self.passing.clear()


class WordwiseEncoder:
    """Ids of texts as little-endian 32-bit numbers. Subclasses give the word pattern and the cuts."""

    #: Bytes of remembered words, each of two generations.
    KEEP = 32 << 20
    #: Characters taken at a time; a longer text is cut into slices of about this size.
    BATCH = 1 << 20

    _PLAIN = re.compile(rf"[{LETTERS}0-9{SIGNS} \t-\r]*")
    _WORD: re.Pattern

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Remembered(self.KEEP)
        self.odd: set[str] = set()  # pieces of the texts at hand that are not plain
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.border[i] = self.is_border(token)
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or r"(?!)")

    def is_border(self, token: str) -> bool:
        raise NotImplementedError

    def pieces(self, text: str) -> list[str]:
        """The text cut where no word reaches over."""
        raise NotImplementedError

    def _plain(self, text: str) -> bool:
        return self._PLAIN.fullmatch(text) is not None and not self.special.search(text)

    def words(self, text: str) -> list[str]:
        """Words of the tokenizer; pieces that are not plain come as they are (no plain word equals one)."""
        if self._plain(text):
            return self._WORD.findall(self.folded(text))
        out: list[str] = []
        for piece in self.pieces(text):
            if self._plain(piece):
                out += self._WORD.findall(self.folded(piece))
            else:
                out.append(piece)
                self.odd.add(piece)
        return out

    def folded(self, text: str) -> str:
        return text

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            if len(text) > 2 * self.BATCH:
                out += self._encode(some)
                out.append(b"".join(self._encode([self.words(part)])[0] for part in self.slices(text)))
                some, size = [], 0
                continue
            some.append(self.words(text))
            size += len(text)
            if size > self.BATCH:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def slices(self, text: str) -> list[str]:
        """A long text cut before spaces that stand between non-spaces."""
        out, start = [], 0
        for m in re.compile(r"(?<=\S) (?=\S)").finditer(text):
            if m.start() - start >= self.BATCH:
                out.append(text[start:m.start()])
                start = m.start()
        return [*out, text[start:]]

    def _encode(self, texts: list[list[str]]) -> list[bytes]:
        if new := self.known.missing(set().union(*texts)):
            self._learn(new)
        get = self.known.young.__getitem__
        found = [b"".join(map(get, words)) for words in texts]
        self.known.forget()
        return found

    def _learn(self, new: list[str]) -> None:
        joint, alone = [], []
        for w in new:
            (joint if w not in self.odd and self.can_join(w) else alone).append(w)
        self.odd.clear()
        self.known.learn(zip(joint, self._together(joint), strict=True))
        if alone:
            found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            self.known.learn((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(alone, found, strict=True))

    JOINT = ""

    def can_join(self, word: str) -> bool:
        """Whether a plain word keeps its tokens among others, and its border token."""
        return True

    def cuts(self, border: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _together(self, words: list[str], at_once: int = 1000) -> list[bytes]:
        """Ids of many words from few calls: they are encoded joined, and cut at the tokens that border a word."""
        groups = [words[at:at + at_once] for at in range(0, len(words), at_once)]
        out: list[bytes] = []
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([self.JOINT.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = self.cuts(self.border[ids])
            if len(cuts) + 1 != len(some):
                raise ValueError("the words' borders are not the tokens' borders")
            bounds = [0, *(4 * cuts).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out


class WordEncoder(WordwiseEncoder):
    """For tokenizers that drop white space, ignore case and mark the token that ends a word."""

    # Texts of four languages have some hundred thousand words; what is forgotten is encoded again.
    KEEP = 64 << 20

    _WORD = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[{SIGNS}]+")
    JOINT = " "

    def is_border(self, token: str) -> bool:
        return token.endswith("</w>")

    def pieces(self, text: str) -> list[str]:
        return text.split(" ")

    def folded(self, text: str) -> str:
        return text.lower()  # plain letters alone: one for one

    def cuts(self, border: np.ndarray) -> np.ndarray:
        return np.flatnonzero(border)[:-1] + 1


class ByteEncoder(WordwiseEncoder):
    """For byte-level tokenizers, whose words may begin with a space."""

    _WORD = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\s+(?!\S)|\s+")
    _GLUED = re.compile(r" (?!\S)")

    def is_border(self, token: str) -> bool:
        return token.startswith("Ġ")  # the sign of a leading space

    def pieces(self, text: str) -> list[str]:
        """The text cut before each space that is followed by a non-space."""
        first, *rest = text.split(" ")
        if not self._GLUED.search(text):
            return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]
        out = [first]
        for p in rest:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [p for p in out if p]

    def can_join(self, word: str) -> bool:
        return word[0] == " " and not word.isspace()

    def cuts(self, border: np.ndarray) -> np.ndarray:
        return np.flatnonzero(border)[1:]


@lru_cache(maxsize=2)
def shared(kind: type, path: str) -> WordwiseEncoder:
    """One encoder a worker process: a tokenizer file is read once, and words stay known from task to task."""
    return kind(path)
