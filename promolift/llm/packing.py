"""Sum-of-squares online packing of token sequences.

Documents come one by one. What is longer than a window fills whole windows;
the rest is placed by the sum-of-squares rule: of all fill levels at which it
fits (an empty window among them), it goes to the one that leaves the least sum
over levels of (partially filled windows at that level) squared. A level array
keeps the number of windows at each level; the windows themselves hang on
their level, newest first.

Each input partition is packed by one task over its own stream of documents,
so nothing is shuffled and a hot source means nothing. Memory is bounded: when more than
``MAX_OPEN`` windows are open (some mixes of sizes never fit together), and at
the end of the partition, open windows are closed by cutting: pieces of the emptiest fill the
gaps of the fullest. The last window of a partition is cut into sequences whose
lengths are powers of two, which need no padding. Each id lies in exactly one piece.

A partition's packing follows from its rows in order alone, so a task that
runs again gives the same sequences; sequence ids hold the partition number
and a counter.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each; a text of any length is encoded slice by slice and cut into windows; of fill levels
equally good the fullest is taken. Only the id and the text are read, so other columns may have any name.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import ready, text_of
from promolift.llm.pieces import WordEncoder, shared

WINDOW = 4096
MAX_OPEN = 1024


@dataclass
class Piece:
    doc: object
    start: int
    ids: bytes  # 4 bytes an id
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:4 * n], self.doc_tokens),
                Piece(self.doc, self.start + n, self.ids[4 * n:], self.doc_tokens))


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    filled: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.filled += len(piece)


class Packer:
    """Online packer; ``add`` and ``close`` return the windows that are finished."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, dtype=np.int64)  # partially filled windows by fill level
        self.open: list[list[Window]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def best_level(self, n: int) -> int:
        """Fill level (0: a new window) whose use for ``n`` tokens leaves the least sum of squares; ties: the fullest."""
        room = self.window - n
        # Moving one window from level h to h + n changes the sum by 2 (N[h + n] - N[h]) + 2; a full one leaves the array.
        change = 2 * (self.levels[n:self.window + 1] - self.levels[:room + 1]) + 2
        change[0] = 2 * self.levels[n] + 1 if n < self.window else 0
        if room:
            change[room] = 1 - 2 * self.levels[room]
        usable = self.levels[:room + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(room - change[::-1].argmin())

    def _take(self, level: int) -> Window:
        if level == 0:
            return Window()
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: Window) -> None:
        self.levels[window.filled] += 1
        self.n_open += 1
        self.open[window.filled].append(window)

    def add(self, piece: Piece) -> list[Window]:
        done = []
        while len(piece) >= self.window:
            head, piece = piece.cut(self.window)
            done.append(Window([head], self.window))
        if not len(piece):
            return done
        target = self._take(self.best_level(len(piece)))
        target.add(piece)
        if target.filled == self.window:
            done.append(target)
        else:
            self._put(target)
            if self.n_open > self.max_open:
                done += self._merge()
        return done

    def _merge(self) -> list[Window]:
        """Fill the fullest open windows with pieces of the emptiest; at most one stays open."""
        waiting = [w for level in self.open for w in level]  # emptiest first
        for level in self.open:
            level.clear()
        self.levels[:] = 0
        self.n_open = 0
        done, low = [], 0
        while low < len(waiting):
            target = waiting.pop()
            while target.filled < self.window and low < len(waiting):
                source = waiting[low]
                piece = source.pieces.pop()
                source.filled -= len(piece)
                gap = self.window - target.filled
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    source.add(rest)
                target.add(piece)
                if not source.pieces:
                    low += 1
            if target.filled == self.window:
                done.append(target)
            else:
                self._put(target)
        return done

    def close(self) -> list[Window]:
        """Every window still open, the last one cut into lengths that need no padding."""
        done = self._merge()
        for window in [w for level in self.open for w in level]:
            pieces = window.pieces[::-1]
            left = window.filled
            while left:
                size = 1 << (left.bit_length() - 1)
                part = Window()
                while part.filled < size:
                    piece = pieces.pop()
                    if len(piece) > size - part.filled:
                        piece, rest = piece.cut(size - part.filled)
                        pieces.append(rest)
                    part.add(piece)
                left -= size
                done.append(part)
        for level in self.open:
            level.clear()
        self.levels[:] = 0
        self.n_open = 0
        return done


PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
#: Pieces are handed on when they hold so many bytes of ids, or are so many.
FLUSH_BYTES, FLUSH_ROWS = 2 << 20, 5000
#: Characters of the texts that are encoded at a time (a longer text comes alone).
ENCODE_CHARS = 1 << 18


def some_at_a_time(ids: Iterable, texts: Iterable[str], most: int = ENCODE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Rows in lists of at most ``most`` characters in all; a longer text is a list of its own."""
    some, size = ([], []), 0
    for i, text in zip(ids, texts, strict=True):
        if some[0] and size + len(text) > most:
            yield some
            some, size = ([], []), 0
        some[0].append(i)
        some[1].append(text)
        size += len(text)
    if some[0]:
        yield some


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, max_open: int = MAX_OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, as
    little-endian unsigned 32-bit numbers in a binary column).

    ``path`` is a tokenizer file that the executors can read.
    """
    ready(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = shared(WordEncoder, path), Packer(window, max_open)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held = 0

        def emit(done: list[Window]) -> bool:
            """Take finished windows; whether enough is held to hand on."""
            nonlocal number, held
            for w in done:
                offset = 0
                for p in w.pieces:
                    out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset, p.ids if with_ids else None))
                    offset += len(p)
                held += 4 * offset * with_ids
                number += 1
            return held >= FLUSH_BYTES or len(out) >= FLUSH_ROWS

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True)) if out else [()] * (len(names) + 1)
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + ([pa.array(columns[-1], pa.binary())] if with_ids else [])
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, [*names, *(["ids"] if with_ids else [])])
        for batch in batches:
            for docs_, texts in some_at_a_time(batch.column("id").to_pylist(), map(str, batch.column("text"))):
                for doc, ids in zip(docs_, encoder.encode_many(texts), strict=True):
                    ids += end
                    if emit(packer.add(Piece(doc, 0, ids, len(ids) // 4))):
                        yield batch_of()
        emit(packer.close())
        yield batch_of()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(pack, PACKED + (", ids binary" if with_ids else ""))
