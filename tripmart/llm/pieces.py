"""Operator 10: SentencePiece encoding and decoding by suffix-array matching.

The distinct new pre-tokens of a batch are put end to end; their suffixes are
sorted (as deep as the longest piece), every piece of the vocabulary is binary-
searched for its range of suffixes, and the ranges give all edges: places where
a piece could stand. Edges are sorted by the position where they end and relaxed
in that order: at each position the edge survives whose piece may follow the
best last piece of the text before it. For a BPE vocabulary, "may follow" means
that merging the two pieces' characters gives back exactly the two; exactly one
edge survives at each position, and the path of survivors is the library's
encoding. Characters without a piece become their bytes' pieces.

Defined results: null and empty texts have no ids; repeated rows are rows; an
empty table gives an empty result. Decoding gives the text back, but for a
literal word mark (U+2581), which the vocabulary reads as a space.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text, without
from tripmart.llm.token_counts import START, PieceRanks, piece_ranks
from tripmart.llm.words import WordTable, chunks, ragged, split_all, sums

#: Pre-tokens over this length are relaxed one position after another.
LONG = 48

#: Distinct words a process remembers.
WORDS = 300_000

#: Slots for pairs of pieces that a process remembers (a prime), and pairs of
#: long pre-tokens, whose memory is emptied beyond that.
SLOTS, MAX_PAIRS = 2_000_003, 100_000

NONE = -(1 << 40)


class Lattice:
    """Suffix search and relaxation over one vocabulary."""

    def __init__(self, ranks: PieceRanks):
        self.r = ranks
        size = ranks.size
        # pieces that merging their own characters gives
        names = [p for p in ranks.names]
        ids = np.array([ranks.names[p] for p in names], np.int64)
        merged, n = ranks.merge([p.replace(START, " ") for p in names])
        alone = (n == 1) & (merged[np.minimum(np.cumsum(n) - n, len(merged) - 1)] == ids)
        self.name = {i: p for p, i in ranks.names.items()}
        self.usable = np.zeros(size, bool)
        self.usable[ids[alone]] = True
        kept = [(p, i) for p, i in zip(names, ids.tolist(), strict=True) if self.usable[i]]
        self.deep = max(len(p) for p, _ in kept)
        letters = sorted({c for p, _ in kept for c in p})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        points = np.array([ord(" " if c == START else c) for c in letters])
        order = np.argsort(points)
        self.points, self.codes = points[order], (order + 1).astype(np.uint16)
        self.ids = np.array([i for _, i in kept], np.int64)
        self.sizes = np.array([len(p) for p, _ in kept], np.int64)
        self.size_of = np.ones(size, np.int64)
        self.size_of[self.ids] = self.sizes
        low, high = np.zeros((len(kept), self.deep), ">u2"), np.full((len(kept), self.deep), 0xFFFF, ">u2")
        for k, (p, _) in enumerate(kept):
            low[k, : len(p)] = high[k, : len(p)] = [self.code[c] for c in p]
        self.low, self.high = self._keys(low), self._keys(high)
        self.pair, self.answer = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.known: dict[int, bool] = {}  # pairs of long pre-tokens

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{2 * self.deep}").ravel()

    def _merged(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging the characters of each pair gives the pair again."""
        size = self.r.size
        merged, n = self.r.merge([self.name[k // size] + self.name[k % size] for k in keys.tolist()])
        first = np.minimum(np.cumsum(n) - n, len(merged) - 1)
        second = np.minimum(first + 1, len(merged) - 1)
        return (n == 2) & (merged[first] * size + merged[second] == keys)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a: merging the characters of both gives the
        two again. Pairs met before are remembered, one per slot (a later pair of
        the same slot takes it over); new ones are merged together."""
        out = (a < 0) | (b < 0)
        live = np.flatnonzero(~out)
        keys = a[live] * self.r.size + b[live]
        slot = keys * 0x9E3779B1 % SLOTS
        got = self.answer[slot]
        new = np.flatnonzero(self.pair[slot] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            answer = self._merged(fresh)
            got[new] = answer[back]
            slot = fresh * 0x9E3779B1 % SLOTS
            slot, last = np.unique(slot, return_index=True)
            self.pair[slot], self.answer[slot] = fresh[last], answer[last]
        out[live] = got
        return out

    def edges(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all pieces in the text: start, piece, length."""
        at = np.minimum(np.searchsorted(self.points, flat), len(self.points) - 1)
        coded = np.where(self.points[at] == flat, self.codes[at], 0)
        padded = np.concatenate([coded, np.zeros(self.deep, np.int64)]).astype(">u2")
        keys = self._keys(np.lib.stride_tricks.sliding_window_view(padded, self.deep)[: len(coded)])
        suffixes = np.argsort(keys, kind="stable")
        keys = keys[suffixes]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return suffixes[np.repeat(lo, n) + nth], np.repeat(self.ids, n), np.repeat(self.sizes, n)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number per word."""
        flat = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n + 1) - n - 1
        offset = np.arange(len(flat)) - np.repeat(first, n + 1)[: len(flat)]
        start, piece, size = self.edges(flat)
        # a character without a piece is an edge to itself
        single = np.zeros(len(flat), bool)
        single[start[size == 1]] = True
        lone = np.flatnonzero(~single)
        lone = lone[offset[lone] < np.repeat(n, n + 1)[lone]]
        start = np.concatenate([start, lone])
        piece = np.concatenate([piece, -1 - flat[lone]])
        size = np.concatenate([size, np.ones(len(lone), np.int64)])
        last = np.full(len(flat) + 1, NONE, np.int64)  # by position: last piece of the best path up to here
        end = start + size
        long = np.repeat(n > LONG, n + 1)[: len(flat)][start] if len(start) else np.zeros(0, bool)
        self._relax(start[~long], piece[~long], end[~long], offset, last)
        self._relax_long(start[long], piece[long], end[long], offset, last)
        return self._paths(first, n, last)

    def _relax(self, start, piece, end, offset, last) -> None:
        depth = offset[start] + (end - start)
        order = np.argsort(depth, kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            s, p = start[lo:hi], piece[lo:hi]
            before = np.where(offset[s] == 0, NONE, last[s])
            ok = self.follows(before, p)
            last[end[lo:hi][ok]] = p[ok]

    def _relax_long(self, start, piece, end, offset, last) -> None:
        known, size = self.known, self.r.size
        if len(known) > MAX_PAIRS:
            known.clear()
        order = np.argsort(end, kind="stable")
        for s, p, e in zip(start[order].tolist(), piece[order].tolist(), end[order].tolist(), strict=True):
            before = NONE if offset[s] == 0 else int(last[s])
            ok = before < 0 or p < 0 or known.get(before * size + p)
            if ok is None:
                ok = known[before * size + p] = bool(self.follows(np.array([before]), np.array([p]))[0])
            if ok:
                last[e] = p

    def _paths(self, first: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, at = np.arange(len(n)), first + n
        found_word, found = [], []
        live = n > 0
        word, at = word[live], at[live]
        while len(word):
            p = last[at]
            found_word.append(word)
            found.append(p)
            at = at - np.where(p < 0, 1, self.size_of[np.maximum(p, 0)])
            go = at > first[word]
            word, at = word[go], at[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
        word, ids = np.concatenate(found_word)[::-1], np.concatenate(found)[::-1]
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
        if (ids < 0).any():  # bytes of characters without a piece
            own = [[i] if i >= 0 else [self.r.bytes_of[x] for x in chr(-1 - i).encode()] for i in ids.tolist()]
            word = np.repeat(word, [len(x) for x in own])
            ids = np.array([i for x in own for i in x], np.int64)
        return ids, np.bincount(word, minlength=len(n))


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One table per process."""
    return Lattice(piece_ranks(path))


@functools.lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    """Words that this process has met, over all its tasks."""
    return WordTable(lattice(path).encode, WORDS)


@functools.lru_cache(maxsize=2)
def _bytes_of_pieces(path: str) -> list[bytes]:
    ranks = piece_ranks(path)
    out = [b""] * ranks.size
    for p, i in ranks.names.items():
        out[i] = p.replace(START, " ").encode()
    for x, i in ranks.bytes_of.items():
        out[i] = bytes([x])
    return out


def _texts(of: list[bytes], flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """Texts of runs of ``n`` ids."""
    ends = np.cumsum(n)
    return pa.array([b"".join([of[i] for i in flat[e - k : e].tolist()]).decode("utf-8", "replace")[1:] for e, k in zip(ends, n, strict=True)], pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col, ids`` for every whole text; a narrow map, no shuffle. With
    ``decoded`` also the text of these ids, from the same map (a map of its own
    would hold a second Python worker a core)."""
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = rows.select("_id", F.array(F.lit(0)).alias("ids"), *([F.lit("").alias("decoded")] if decoded else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table = lattice(path), _table(path)
        for batch in batches:
            for lo, hi, texts in chunks(batch.column(1)):
                words, n = split_all(texts, net.r.split)
                at = table.rows(words)
                flat, n = table.gather(at), sums(table.lengths[at], n)
                cols = [batch.column(0).slice(lo, hi - lo), ragged(flat, n, pa.int32())]
                if decoded:
                    cols.append(_texts(_bytes_of_pieces(path), flat, n))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: empty)."""
    rows = without(encoded, out_col)
    schema = rows.withColumn(out_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _bytes_of_pieces(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x or ()) for x in lists.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(of, flat, n)], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, schema)
