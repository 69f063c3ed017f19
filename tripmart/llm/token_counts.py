"""Operator 1: token counts by rank-synchronous array merging.

Every Arrow batch is cut into pre-tokens; the distinct new ones are held as one
ragged numpy array of symbols. In each round every unfinished sequence applies
its own lowest-rank pair, all sequences at once; what survives is counted. No
merge crosses a pre-token: the vocabulary has no piece in which a word start
follows another character, which is checked when it is read (else a whole text
is one pre-token).

Pre-tokens over ``LONG`` characters (blobs without a space) would take a round per
merge; they go through a heap of the same merges, one at a time, in n log n.

A rank is merged at all its places of a sequence in one round, left to right,
unless merging it can make a pair of lower rank; then one place a round. Both
give the library's order of merges exactly.

Defined results: null and empty texts have 0 tokens; repeated rows and ties
count row by row; an empty table gives an empty result; other columns of the
input, also such named like the result's, are left out.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text
from tripmart.llm.words import WordTable, chunks, split_all, sums

START = "▁"  # the piece alphabet's mark for a space
FAR = np.int64(2**62)

#: Characters from which on a pre-token is merged with a heap.
LONG = 500


class PieceRanks:
    """Vocabulary of a SentencePiece BPE model with byte fallback as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = {
            sp.id_to_piece(i): i
            for i in range(n)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.names, self.size = names, n
        self.bytes_of = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_of) != 256:
            raise ValueError("a model with byte fallback is needed")
        score = {p: sp.get_score(i) for p, i in names.items()}
        order = sorted(set(score.values()), reverse=True)
        dense = {s: r for r, s in enumerate(order)}
        rank = {p: dense[s] for p, s in score.items()}
        shared = Counter(rank[p] for p in names if len(p) > 1)
        keys, into, ranks, early = [], [], [], set()
        for p, i in names.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in names and b in names:
                    keys.append(names[a] * n + names[b])
                    into.append(i)
                    ranks.append(rank[p])
                    early.update(x for x in (a, b) if rank[p] < rank[x])
        at = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[at]
        self.into = np.array(into, np.int64)[at]
        self.ranks = np.array(ranks, np.int64)[at]
        #: Ranks whose merge can make a pair of lower rank.
        self.early = np.zeros(len(order) + 1, bool)
        self.early[[rank[p] for p in early]] = True
        self.early[[r for r, k in shared.items() if k > 1]] = True
        self.of_point = -1 - np.arange(0x110000)
        for p, i in names.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.of_point[32] = names.get(START, -33)
        self.table: dict[int, tuple[int, int]] = {}
        inner = any(b == START != a for p in names for a, b in zip(p, p[1:], strict=False))
        line = any("\n" in p for p in names)
        self.word = re.compile(r"(?s).+" if inner else r" +[^ ]*|[^ ]+" if line else r" +[^ \n]*|[^ \n]+|\n+")

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; a space stands for the word mark."""
        return self.word.findall(" " + text.replace(START, " ")) if text else []

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Single-character symbols of all words, end to end (unknown ones as
        ``-1 - code point``), and the number per word."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        return self.of_point[flat], np.fromiter(map(len, words), np.int64, len(words))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of joining a and b (FAR: no such piece) and the piece."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], FAR), np.where(hit, self.into[at], 0)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, end to end, and the number per word."""
        sym, n = self.symbols(words)
        word = np.repeat(np.arange(len(words)), n)
        done_sym, done_word = [], []
        if len(n) and n.max() > LONG:
            ends = np.cumsum(n)
            for w in np.flatnonzero(n > LONG):
                own = self.merge_long(sym[ends[w] - n[w] : ends[w]])
                done_sym.append(own)
                done_word.append(np.full(len(own), w))
            short = np.repeat(n <= LONG, n)
            sym, word = sym[short], word[short]
        rank, into = self._ranks(sym, word) if len(sym) else (sym, sym)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            over = low == FAR
            if over.any():
                out = np.repeat(over, size)
                done_sym.append(sym[out])
                done_word.append(word[out])
                sym, word, rank, into = sym[~out], word[~out], rank[~out], into[~out]
                low, size = low[~over], size[~over]
                if not len(sym):
                    break
            take = rank == np.repeat(low, size)
            at = np.flatnonzero(take)
            # the second of two overlapping places waits; one place only where a merge can make a lower rank
            run = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            at = at[np.where(self.early[rank[at]], first, nth % 2 == 0)]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            new = moved[at]
            near = np.zeros(len(sym), bool)
            near[new] = near[new[new > 0] - 1] = True
            touched = np.flatnonzero(near)
            rank[touched], into[touched] = self._ranks(sym, word, touched)
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        back = np.argsort(word, kind="stable")
        return sym[back], np.bincount(word, minlength=len(words))

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same merges on one long sequence: lowest rank first, then leftmost."""
        if not self.table:
            self.table.update(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.into.tolist(), strict=True), strict=True))
        table, size = self.table, self.size
        s: list[int] = sym.tolist()
        n = len(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and s[i] >= 0 and s[j] >= 0:
                found = table.get(s[i] * size + s[j])
                if found:
                    heapq.heappush(heap, (found[0], i, j, s[i], s[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, j, a, b, p = heapq.heappop(heap)
            if gone[i] or gone[j] or right[i] != j or s[i] != a or s[j] != b:
                continue
            s[i], gone[j] = p, 1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return np.array([x for x, g in zip(s, gone, strict=True) if not g], np.int64)

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        rank, into = self.pairs(sym[at], sym[after])
        end = (after == at) | (word[after] != word[at])
        rank[end] = FAR
        return rank, into

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a character without a piece counts its bytes."""
        sym, n = self.merge(words)
        code = -1 - sym
        size = np.where(sym >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        return sums(size, n)


@functools.lru_cache(maxsize=4)
def piece_ranks(path: str) -> PieceRanks:
    """One reading of the vocabulary per process."""
    return PieceRanks(path)


@functools.lru_cache(maxsize=4)
def _table(path: str) -> WordTable:
    """Words that this process has met, over all its tasks."""
    ranks = piece_ranks(path)
    return WordTable(lambda new: (ranks.counts(new), np.ones(len(new), np.int64)))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text as the SentencePiece library counts them:
    ``id_col, n_bytes, n_tokens, over_limit``. A narrow map, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table = piece_ranks(model_path), _table(model_path)
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for lo, hi, texts in chunks(batch.column(1)):
                words, n = split_all(texts, ranks.split)
                at = table.rows(words)
                found[lo:hi] = sums(table.values[at].astype(np.int64), n)
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(found), pa.array(found > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)
