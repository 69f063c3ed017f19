"""Distinct pre-tokens and their ids, kept per task while a partition streams
through it. Only words not seen yet reach the tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words a process remembers; beyond it those met once are forgotten
#: (bounded memory, same results).
MAX_WORDS = 150_000

#: Text handled at a time inside an Arrow batch, in bytes.
CHUNK_BYTES = 1_000_000


class WordTable:
    """word -> row of a ragged integer table. ``encode(words)`` gives
    ``(values, lengths)`` for new distinct words."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MAX_WORDS):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words met again since they came, at most half of the limit."""
        often = np.flatnonzero(self.met >= 2)
        if len(often) > self.limit // 2:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[: self.limit // 2]])
        names = list(self.index)
        self.index = {names[i]: k for k, i in enumerate(often.tolist())}
        self.values, self.lengths = self.gather(often), self.lengths[often]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.met = np.zeros(len(often), np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word; new ones are encoded together. Rows hold until the
        next call."""
        index = self.index
        new = list({w: None for w in words if w not in index})
        if new and index and len(index) + len(new) > self.limit:
            self._forget()
            index = self.index
            new = list({w: None for w in words if w not in index})
        if new:
            values, lengths = self.encode(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.values = np.concatenate([self.values, values.astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int64)])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        rows = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.met += np.bincount(rows, minlength=len(self.met)) if len(rows) else 0
        return rows

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Values of these rows, end to end."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - n), n)
        return self.values[at]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Runs ``(from, to, texts)`` of a text column, of about ``size`` bytes (one
    long text is its own run); only one run at a time is held as Python strings.
    Null counts as empty."""
    at, held = 0, 0
    for i, k in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + k > size:
            yield at, i, [t or "" for t in column.slice(at, i - at).to_pylist()]
            at, held = i, 0
        held += k
    if at < len(column):
        yield at, len(column), [t or "" for t in column.slice(at).to_pylist()]


def split_all(texts: list[str], split: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in order and the number per text."""
    words: list[str] = []
    n = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = split(t)
        words += own
        n[i] = len(own)
    return words, n


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of each run of ``n`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from end-to-end values."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Code points that Python takes for white space and the tokenizers do not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
