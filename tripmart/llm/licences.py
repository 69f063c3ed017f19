"""Operator 13: licence scans by a positional rare-token index.

Licence notices are short templates: words, a label, and key phrases that must stand
in them. The index gives, for every word of a template, its positions there
(postings). A first pass over all texts counts in how many documents each template
word stands; rare words have a high inverse document frequency (IDF). A notice is found
if the words that stand where the template wants them carry at least ``share`` of its
IDF weight. So of a template's words only the rarest are looked up: the highest-IDF ones
that carry more than ``1 - share`` together; any place that reaches ``share`` holds
one of them. Every occurrence of such a word in a text, less its positions in the
template, is a place where the notice may start; there the other words' postings are
intersected by relative position, and the key phrases verified word by word.

Base phrases are templates of share 1 (their rarest word alone is looked up), so all
their places are found.

Words are the maximal stretches of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased. The index is as large as the templates, whatever the
corpus; the document counts (one number per template word) are all that reaches the
driver. Scoring is a narrow map.

Defined results: null and empty texts have no words, no labels and score 0; a score is
the largest share of a verified notice or base phrase (0: none); with equal or unknown
counts every word weighs alike; a notice cut by the text's start or end counts as far as it
stands; repeated rows are rows; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text
from tripmart.llm.words import chunks

# --- fixed values: phrases and notices of public licences ---------------------------
#: phrase -> label; every place of it is reported.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: (label, notice, mandatory key phrases)
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge to any person obtaining a copy"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]
# ------------------------------------------------------------------------------------

#: Part of a notice's IDF weight that must stand in place.
SHARE = 0.8

#: What separates words becomes a space, A-Z lower case; UTF-8's upper bytes stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]
    share: float
    base: bool


def templates(phrases: dict[str, str], notices: list[tuple[str, str, list[str]]], share: float) -> list[Template]:
    """Base phrases (all words, share 1) and notices as templates."""
    own = [Template(label, tuple(p.split()), (tuple(p.split()),), 1.0, True) for p, label in phrases.items()]
    own += [Template(label, tuple(t.split()), tuple(tuple(k.split()) for k in keys), share, False) for label, t, keys in notices]
    for t in own:
        if not t.words or any(_places(t.words, k) == [] for k in t.keys):
            raise ValueError(f"a notice needs words, and its key phrases must stand in it: {t}")
    return own


def _places(words: tuple, phrase: tuple) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


class Index:
    """Postings of the templates' words, and which of them are looked up."""

    def __init__(self, own: list[Template], weight: dict[str, float]):
        self.templates = own
        self.vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for t in own for w in t.words}))}
        self.words, self.weights, self.must = [], [], []
        looked = []  # (word, template, position)
        for k, t in enumerate(own):
            ids = np.array([self.vocabulary[w.encode()] for w in t.words], np.int64)
            idf = np.array([weight.get(w, 1.0) for w in t.words])
            idf = idf / idf.sum() if idf.sum() > 0 else np.full(len(idf), 1 / len(idf))
            must = np.zeros(len(ids), bool)
            for key in t.keys:
                at = _places(t.words, key)[0]
                must[at : at + len(key)] = True
            self.words.append(ids)
            self.weights.append(idf)
            self.must.append(must)
            rare, held = [], 0.0
            for p in np.argsort(-idf, kind="stable").tolist():
                if held > 1 - t.share + 1e-9:
                    break
                rare.append(p)
                held += float(idf[p])
            looked += [(int(ids[p]), k, p) for p in rare]
        looked.sort()
        self.postings = np.array(looked, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.postings[:, 0], np.arange(len(self.vocabulary) + 1))

    def found(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(template, document, place, share)`` of everything found. ``ids`` are the words of
        all documents end to end (-1: no template word); a notice may begin before its document."""
        spots = np.flatnonzero(ids >= 0)
        per = self.first[ids[spots] + 1] - self.first[ids[spots]]
        spots, per = spots[per > 0], per[per > 0]
        nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        rows = self.postings[np.repeat(self.first[ids[spots]], per) + nth]
        at = np.repeat(spots, per)
        doc = np.searchsorted(start, at, side="right") - 1
        for k in range(len(self.templates)):
            mine = rows[:, 1] == k
            if not mine.any():
                continue
            # distinct starts, kept with their document: notices at a border may overlap two
            pairs = np.unique(np.c_[doc[mine], at[mine] - rows[mine, 2]], axis=0)
            own, place = pairs[:, 0], pairs[:, 1]
            held = np.zeros(len(pairs))
            whole, every = np.ones(len(pairs), bool), np.ones(len(pairs), bool)
            for p, (word, x, key) in enumerate(zip(self.words[k], self.weights[k], self.must[k], strict=True)):
                spot = place + p
                inside = (spot >= start[own]) & (spot < start[own] + n[own])
                stands = inside & (ids[np.where(inside, spot, 0)] == word)
                held += np.where(stands, x, 0)
                every &= stands
                if key:
                    whole &= stands
            held[every] = 1.0
            ok = whole & (held >= self.templates[k].share - 1e-9)
            if ok.any():
                yield k, own[ok], place[ok] - start[own[ok]], np.minimum(held[ok], 1.0)


def document_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each of ``words``: one pass over all
    whole texts, summed per task before the shuffle."""
    numbers = {w.encode(): i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(len(words), np.int64)
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                total += len(texts)
                for t in texts:
                    for w in numbers.keys() & set(split(t)):
                        held[numbers[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(words)), pa.int64()), pa.array([total, *held.tolist()], pa.int64())], names=["i", "n"])

    parts = docs.select(whole_text(text_col).alias("_text")).mapInArrow(run, "i long, n long")
    got = {r.i: r.n for r in parts.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row per template word
    return got.get(-1, 0), {w: got.get(i, 0) for i, w in enumerate(words)}


@functools.lru_cache(maxsize=4)
def _index(key: str) -> Index:
    """One index per process."""
    phrases, notices, share, weight = json.loads(key)
    return Index(templates(phrases, notices, share), weight)


def scan_texts(index: Index, texts: list[str]) -> list[dict]:
    """Per text: number of words, base places, base and other labels, the notices found
    ``(label, start, end, share)`` and the score."""
    words = [split(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(n) - n
    known = index.vocabulary
    ids = np.fromiter((known.get(w, -1) for own in words for w in own), np.int64, int(n.sum()))
    out = [{"n_words": int(k), "base": [], "notices": [], "score": 0.0} for k in n]
    # a text without words shares its start with the next one: searchsorted takes the last
    for k, doc, place, share in index.found(ids, start, n):
        t = index.templates[k]
        for d, p, s in zip(doc.tolist(), place.tolist(), share.tolist(), strict=True):
            row = out[d]
            row["score"] = max(row["score"], s)
            if t.base:
                row["base"].append((p, t.label))
            row["notices"].append({"label": t.label, "start": p, "end": p + len(t.words), "share": s})
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE_PHRASES,
                  notices: list[tuple[str, str, list[str]]] = NOTICES, share: float = SHARE) -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score, notices`` (array of ``label, start, end, share``, words from 0)."""
    own = templates(phrases, notices, share)
    total, held = document_counts(docs, sorted({w for t in own for w in t.words}), text_col)
    weight = {w: float(np.log((total + 1) / (k + 0.5))) for w, k in held.items()}
    key = json.dumps([phrases, notices, share, weight])
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    notice = "array<struct<label:string,start:long,end:long,share:double>>"
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    schema = rows.select(
        "_id", zero.alias("n_words"), zero.alias("n_base"), none.alias("first_word"), none.alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.expr(f"CAST(array() AS {notice})").alias("notices"),
    ).schema
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key)
        for batch in batches:
            for lo, hi, texts in chunks(batch.column(1)):
                got = scan_texts(index, texts)
                at = [[p for p, _ in r["base"]] for r in got]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([r["n_words"] for r in got], pa.int64()),
                    pa.array([len(p) for p in at], pa.int64()),
                    pa.array([min(p, default=None) for p in at], pa.int64()),
                    pa.array([max(p, default=None) for p in at], pa.int64()),
                    pa.array([",".join(sorted({x for _, x in r["base"]})) for r in got], pa.string()),
                    pa.array([",".join(sorted({x["label"] for x in r["notices"]})) for r in got], pa.string()),
                    pa.array([r["score"] for r in got], pa.float64()),
                    pa.array([sorted(r["notices"], key=lambda x: (x["start"], x["end"], x["label"])) for r in got], kind),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
