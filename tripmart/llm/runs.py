"""Operator 11: runs of repeated words by an online sparse diagonal recurrence.

A run is a longest stretch of words with a smallest period ``q`` that lasts at
least ``max(least, 3 * q)`` words. Two words ``q`` apart that are equal stand on
the diagonal of lag ``q``; a run is a diagonal that lasts long enough. Reading a
document word by word, every earlier occurrence of what stands at a place makes
the match length of its lag one longer; a lag that is not continued ends there and
gives a run at once if it lasted.

What makes it sparse: a lag ``q`` needs ``max(least - q, 2 * q)`` matches in a row,
so whole factors of words are looked up, not single words: factors of ``WIDTHS[0]``
words for the lags below that, of ``m`` words for the lags ``m / 2`` to ``m - 1``, ``m``
doubling. Factors are named exactly, a wide one by the names of its halves, and
only factors that occur again in their document are carried on. Of the earlier
occurrences within ``m`` words at most two can lie on a diagonal of a smallest
period: the last one (``d`` words back), and the last one before the chain of
steps of ``d`` that ends there, because two occurrences that overlap by ``d`` words
belong to one stretch of period ``d``, in which all lags but ``d`` are multiples of it.
So a word costs a bounded number of steps per doubling, whatever a text repeats.

Words are the maximal stretches without ``[\\x20\\x09-\\x0D]``. Defined results: null and
empty texts have no words and no runs; repeated rows are rows of their own; a
null id stays null; ties of the exact ratio length / period go to the smallest
start, then period; an empty table gives an empty result; other columns are left
out. Whole texts are read, about a megabyte of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text
from tripmart.llm.words import chunks

#: Shortest run, in words.
LEAST = 24

WORD = r"[^\x20\x09-\x0D]+"

RUN = "struct<start:long,length:long,period:long>"


def _named(keys: np.ndarray) -> np.ndarray:
    """Names of equal keys: small integers."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) if len(keys) else keys.astype(np.int64)


def _repeated(at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) whose name occurs more than once, with new names."""
    n = np.bincount(name)
    again = n[name] > 1
    return at[again], _named(name[again])


def _wider(at: np.ndarray, name: np.ndarray, step: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the factors twice as wide: those of both halves, ``step`` apart."""
    where = np.full(total, -1, np.int64)
    where[at] = np.arange(len(at))
    right = np.full(len(at), -1, np.int64)
    inside = at + step < total
    right[inside] = where[at[inside] + step]
    both = right >= 0
    return at[both], _named(name[both] * np.int64(len(name) + 1) + name[right[both]])


def _events(at: np.ndarray, name: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, lag)`` of earlier occurrences at lags ``low`` to ``width - 1`` that
    may lie on a diagonal of a smallest period (see above)."""
    order = np.argsort(name, kind="stable")
    spot, own = at[order], name[order]
    k = np.arange(len(spot))
    first = np.ones(len(spot), bool)
    first[1:] = own[1:] != own[:-1]
    step = np.zeros(len(spot), np.int64)
    step[1:] = np.where(first[1:], 0, spot[1:] - spot[:-1])
    # a chain of equal steps: index of the occurrence in front of its first step
    turn = first.copy()
    turn[1:] |= first[:-1] | (step[1:] != step[:-1])
    head = np.maximum.accumulate(np.where(turn, k, 0)) - 1
    out_at, out_lag = [], []
    for back in (k - 1, head - 1):
        ok = ~first & (back >= 0)
        # the second one must still be the same factor and lie before the chain
        ok[ok] = own[back[ok]] == own[ok]
        lag = np.where(ok, spot - spot[np.maximum(back, 0)], 0)
        hit = (lag >= low) & (lag < width)
        out_at.append(spot[hit])
        out_lag.append(lag[hit])
    return np.concatenate(out_at), np.concatenate(out_lag)


def _diagonals(at: np.ndarray, lag: np.ndarray, width: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Reads the events in order of their place; ``(start, length, period)`` of every
    diagonal that lasted, as it ends."""
    order = np.argsort(at, kind="stable")
    active: dict[int, int] = {}  # lag -> first place of its matches
    last, grown = None, {}

    def ended(before: dict[int, int], to: int) -> Iterator[tuple[int, int, int]]:
        for q, begin in before.items():
            length = to - begin + width + q
            if length >= max(least, 3 * q):
                yield begin - q, length, q

    for i, q in zip(at[order].tolist(), lag[order].tolist(), strict=True):
        if i != last:
            if last is not None:
                yield from ended({k: b for k, b in active.items() if k not in grown}, last - 1)
                active, grown = grown, {}
                if i != last + 1:
                    yield from ended(active, last)
                    active = {}
            last = i
        grown[q] = active.get(q, i)
    if last is not None:
        yield from ended({k: b for k, b in active.items() if k not in grown}, last - 1)
        yield from ended(grown, last)


def runs_of(ids: np.ndarray, n: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of documents of ``n`` words each, whose
    words ``ids`` (integers) stand end to end."""
    total, doc = len(ids), np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    found: list[list[tuple[int, int, int]]] = [[] for _ in n]
    # matches that any run has: least - q for q = 1, 2 q for a lag of a third
    width = 1 << max(0, (2 * least // 3).bit_length() - 1)
    at, name = np.arange(total), _named(doc * np.int64(ids.max(initial=0) + 1) + ids)
    step = 1
    while step < width:
        at, name = _wider(*_repeated(at, name), step, total)
        step *= 2
    low = 1
    while len(at):
        at, name = _repeated(at, name)
        for start, length, q in _diagonals(*_events(at, name, low, width), width, least):
            d = int(np.searchsorted(first, start, side="right")) - 1
            while n[d] == 0:
                d -= 1
            found[d].append((start - int(first[d]), length, q))
        at, name = _wider(at, name, width, total)
        low, width = width, 2 * width
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


def word_ids(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all their numbers end to end and their count per text."""
    # bytes.split knows only [\x20\x09-\x0D]
    words = [t.encode().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for own in words for w in own), np.int64, int(n.sum()))
    return words, ids, n


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by one space: a word goes if any run holds it
    after that run's first period."""
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return b" ".join(words if kept.all() else [words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, texts: bool = False) -> DataFrame:
    """One row per document: ``id_col, runs`` (by start, then period),
    ``collapsed_sha256`` and, with ``texts``, ``collapsed`` itself. A narrow map."""
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = rows.select("_id", F.expr(f"CAST(array() AS array<{RUN}>)").alias("runs"), F.lit("").alias("collapsed_sha256"),
                         *([F.lit("").alias("collapsed")] if texts else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, own in chunks(batch.column(1)):
                words, ids, n = word_ids(own)
                found = runs_of(ids, n, least)
                short = [collapsed(w, r) for w, r in zip(words, found, strict=True)]
                spans = [[{"start": s, "length": k, "period": q} for s, k, q in r] for r in found]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(spans, kind), pa.array([hashlib.sha256(s).hexdigest() for s in short])]
                cols += [pa.array([s.decode() for s in short], pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _strongest(runs: Column) -> Column:
    """The run of greatest exact ratio; of equal ones the first in order."""
    def better(acc: Column, r: Column) -> Column:
        more = r["length"].cast("decimal(20,0)") * acc["period"] > acc["length"].cast("decimal(20,0)") * r["period"]
        return F.when(acc.isNull() | more, r).otherwise(acc)

    return F.aggregate(runs, F.expr(f"CAST(NULL AS {RUN})"), better)


def run_report(found: DataFrame) -> DataFrame:
    """The rows of ``find_runs`` with ``n_runs``, the strongest run (``start, length,
    period, exponent_milli``; null without a run) and ``runs_sha256``."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("_best", _strongest(F.col("runs")))
    return best.select(
        *[c for c in found.columns if c not in ("runs", "collapsed_sha256")],
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's input: in one document of ten, chosen by its id, the words
    from a place ``a`` on repeat with period ``p`` (``text_col`` then holds the words
    joined by one space). A null id or text stays as it is."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(whole_text(text_col), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("_w"), F.floor(h / 10).cast("long").alias("_g"))
    rows = rows.withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("transform(_w, (x, i) -> CASE WHEN i < _a THEN x ELSE _w[CAST(_a + (i - _a) % _p AS int)] END)")
    return rows.select(id_col, F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col(text_col)).alias(text_col))
