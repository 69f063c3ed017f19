"""Operator 4: toxicity by a linear-chain conditional random field.

From a bounded sample of labelled training documents, words that are far more
frequent in toxic than in clean documents label the tokens of toxic documents;
a two-tag CRF (word weights and tag transitions) is fitted to those tags by
maximum likelihood. Scoring runs the forward-backward recursion over every whole
text, many documents at a time; the marginals give the offending spans and,
through a small logistic model fitted on the same sample, a document score.

The sample is the only thing that is bounded (``SAMPLE_DOCS`` documents of at
most ``SAMPLE_BYTES`` bytes, by a hash of the id); every row and whole text is
scored. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts score like a text without a token; without
any training rows of both classes all scores are 0; repeated rows are rows; a
null id counts as held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text, without
from tripmart.llm.words import chunks, split_all

#: Bound of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 32768

#: Words with a weight of their own, at most.
MAX_FEATURES = 20000

#: Token pairs whose expectations are taken at a time.
PART = 1 << 17

WORD = re.compile(r"\w+")
FOLDS = 5
FLOOR = -12.0  # marginal logit of a text without a token


def words(text: str) -> list[str]:
    """Words of the text as it is, each in lower case (a word has no blank)."""
    found = WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else found


def forward_backward(emit: np.ndarray, n: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios (tag 1 to tag 0) for runs of ``n`` tokens: forward, with the
    token itself, and backward, without it. All runs step together."""
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    start, size = first[order], n[order]
    fore, back = np.empty(len(emit)), np.zeros(len(emit))
    (t00, t01), (t10, t11) = np.exp(trans)
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # runs longer than t
    for t in range(steps):
        at = start[: live[t]] + t
        if t:
            r = np.exp(np.clip(fore[at - 1], -30, 30))
            fore[at] = emit[at] + np.log((r * t11 + t01) / (r * t10 + t00))
        else:
            fore[at] = emit[at]
    for t in range(steps - 2, -1, -1):
        at = start[: live[t + 1]] + t
        r = np.exp(np.clip(emit[at + 1] + back[at + 1], -30, 30))
        back[at] = np.log((r * t11 + t10) / (r * t01 + t00))
    return fore, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summary(logit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per run: highest marginal logit, log of the expected toxic tokens, log length."""
    out = np.tile(np.array([FLOOR, FLOOR, 0.0]), (len(n), 1))
    full = n > 0
    if full.any():
        first = (np.cumsum(n) - n)[full]
        out[full, 0] = np.clip(np.maximum.reduceat(logit, first), FLOOR, -FLOOR)
        out[full, 1] = np.log(np.add.reduceat(_sigmoid(logit), first) + np.exp(FLOOR))
        out[full, 2] = np.log(n[full])
    return out


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 25) -> dict | None:
    """CRF and document model from labelled texts (None: one class only)."""
    if len(texts) == 0 or toxic.min() == toxic.max():
        return None
    vocabulary: dict[str, int] = {}
    own = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words(t)), np.int32) for t in texts]
    ids, n = np.concatenate(own).astype(np.int64), np.fromiter(map(len, own), np.int64, len(own))
    doc = np.repeat(np.arange(len(n)), n)
    seen = np.unique(ids * len(n) + doc) if len(ids) else ids
    in_toxic = toxic[seen % len(n)] == 1
    count = len(vocabulary)
    bad = np.bincount((seen // len(n))[in_toxic], minlength=count)
    good = np.bincount((seen // len(n))[~in_toxic], minlength=count)
    rate_bad = (bad + 0.5) / (toxic.sum() + 1)
    rate_good = (good + 0.5) / ((1 - toxic).sum() + 1)
    marks = (bad >= 5) & (rate_bad > 8 * rate_good)
    tags = (marks[ids] & (toxic[doc] == 1)).astype(float) if len(ids) else np.zeros(0)
    # words seen often enough carry a weight; 0 is every other word
    often = np.argsort(-(bad + good), kind="stable")[:MAX_FEATURES]
    often = often[(bad + good)[often] >= 3]
    own = np.zeros(count, np.int64)
    own[often] = np.arange(1, len(often) + 1)
    feature = own[ids] if len(ids) else ids
    weight, trans = np.zeros(len(often) + 1), np.zeros((2, 2))
    weight[:] = np.log((tags.mean() + 1e-4) / (1 - tags.mean() + 1e-4)) if len(tags) else FLOOR
    step_w, step_t = np.full(len(weight), 1e-6), np.full((2, 2), 1e-6)
    follow = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    both = (2 * tags[follow] + tags[follow + 1]).astype(int) if len(follow) else follow
    seen_pairs = np.bincount(both, minlength=4).reshape(2, 2)
    for _ in range(rounds):  # full-batch adaptive gradient ascent on the likelihood
        emit = weight[feature]
        fore, back = forward_backward(emit, n, trans)
        gain = np.bincount(feature, tags - _sigmoid(fore + back), len(weight)) - 1e-3 * weight
        step_w += gain**2
        weight = weight + 1.0 * gain / np.sqrt(step_w)
        if len(follow):
            expected = np.zeros((2, 2))
            for lo in range(0, len(follow), PART):
                at = follow[lo : lo + PART]
                ahead = emit[at + 1] + back[at + 1]
                score = np.stack([[trans[i, j] + i * fore[at] + j * ahead for j in (0, 1)] for i in (0, 1)])
                score = np.exp(score - score.max(axis=(0, 1)))
                expected += (score / score.sum(axis=(0, 1))).sum(axis=2)
            gain_t = seen_pairs - expected - 1e-3 * trans
            step_t += gain_t**2
            trans = trans + 0.3 * gain_t / np.sqrt(step_t)
    fore, back = forward_backward(weight[feature], n, trans)
    x = np.c_[_summary(fore + back, n), np.ones(len(n))]
    coef = np.zeros(4)
    for _ in range(30):  # Newton steps of a ridge logistic model
        p = _sigmoid(x @ coef)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        coef = coef + np.linalg.solve(hess, x.T @ (toxic - p) - 1e-2 * coef)
    names = list(vocabulary)
    kept = {names[i]: float(weight[own[i]]) for i in often}
    return {"words": kept, "other": float(weight[0]), "trans": trans.ravel().tolist(), "doc": coef.tolist()}


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the id's text divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Fit on a bounded sample, in one task of Spark; the driver gets the model
    (at most ``MAX_FEATURES`` words)."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    sample = texts.where(F.octet_length("_text") <= SAMPLE_BYTES).join(F.broadcast(own), "_id")  # at most sample_docs rows
    # rows of a repeated id beyond the bound are left out of the fit
    sample = sample.orderBy(F.xxhash64("_id", "_text"), "_id").limit(sample_docs).select("_text", "_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches]
        texts = [t for b in got for t in b.column(0).to_pylist()]
        model = fit(texts, np.array([y for b in got for y in b.column(1).to_pylist()], dtype=int))
        if model:
            rows = [("word", w, x) for w, x in model["words"].items()] + [("other", "", model["other"])]
            rows += [("trans", "", x) for x in model["trans"]] + [("doc", "", x) for x in model["doc"]]
            kind, word, value = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(kind), pa.array(word), pa.array(value)], names=["i", "kind", "word", "value"])

    got = sample.coalesce(1).mapInArrow(run, "i long, kind string, word string, value double").collect()
    if not got:
        return None
    got.sort(key=lambda r: r.i)
    return {
        "words": {r.word: r.value for r in got if r.kind == "word"},
        "other": next(r.value for r in got if r.kind == "other"),
        "trans": [r.value for r in got if r.kind == "trans"],
        "doc": [r.value for r in got if r.kind == "doc"],
    }


def _spans(text: str, hot: np.ndarray) -> list[dict]:
    """Offsets of runs of tagged tokens in the text itself."""
    out: list[dict] = []
    last = -2
    found = list(WORD.finditer(text))
    for i in np.flatnonzero(hot).tolist():
        if i == last + 1 and out:
            out[-1]["end"] = found[i].end()
        else:
            out.append({"start": found[i].start(), "end": found[i].end()})
        last = i
    return out


def score_batch(model: dict, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and offending spans of texts."""
    weights = model["words"]
    trans, coef = np.array(model["trans"]).reshape(2, 2), np.array(model["doc"])
    flat, n = split_all(texts, words)
    emit = np.fromiter(map(weights.get, flat, repeat(model["other"])), float, len(flat))
    fore, back = forward_backward(emit, n, trans)
    logit = fore + back
    score = _sigmoid(np.c_[_summary(logit, n), np.ones(len(n))] @ coef)
    spans: list[list[dict]] = [[] for _ in texts]
    ends = np.cumsum(n)
    hot = logit >= 0
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(hot), side="right")).tolist():
        spans[i] = _spans(texts[i], hot[ends[i] - n[i] : ends[i]])
    return score, spans


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic_spans`` (offsets in code points, end
    exclusive); a narrow map, no shuffle. Null and empty texts score like a text without
    a token; without a model all scores are 0; columns of these two names are replaced,
    all others keep their values; an empty table gives an empty result."""
    rows = without(docs, "score", "toxic_spans")
    schema = rows.withColumns({"score": F.lit(0.0), "toxic_spans": F.expr("CAST(array() AS array<struct<start:int,end:int>>)")}).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text_col)
        for batch in batches:
            for lo, hi, texts in chunks(batch.column(at)):
                if model is None:
                    own, spans = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                else:
                    own, spans = score_batch(model, texts)
                cols = [*batch.slice(lo, hi - lo).columns, pa.array(own), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted, toxic_spans``."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    out = score(rows, model, "_text")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
