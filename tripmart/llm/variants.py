"""Operator 12: spelling variants by finite-state composition.

Words are counted over all whole texts. Those of at least ``least_length`` code
points and ``least_count`` occurrences are the vocabulary. Two words are near if
they differ by one inserted, deleted or replaced code point: the pairs accepted by
vocabulary acceptor, one-edit transducer and vocabulary acceptor, composed. A word's
form is its near word of largest count (ties: the smallest in code-point order) if
that count is at least ``ratio`` times its own; its root is where the forms end.

The composition runs per initial state. Words that share their first ``k`` code
points (``k``: half of ``least_length``) enter at one state; their acceptor is
minimised and composed there. A pair that differs within its first ``k`` code points
agrees in its last ``k``, so it is found in the acceptor of the reversed words. An
initial state with more than ``limit`` words is not entered: pairs that differ right
behind it come from equality joins on what follows (a replaced code point: the rest
behind it; an inserted one: the rest with and without it), and its words go on to
the states behind it, past everything that they all share. So no task holds more than
``limit`` words, whatever share of the vocabulary begins alike.

Word counts are combined before the shuffle; vocabulary rows are shuffled twice
(from the front and from the back).

Defined results: null and empty texts have no words; a null id counts as empty in
the hash; repeated rows are counted as often as they stand; a word without a near
word has ``n_near`` 0, itself as root and null ``form`` and ``form_n``; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.acceptor import Acceptor
from tripmart.llm.tables import whole_text
from tripmart.session import materialize

#: A lower-cased run of letters.
LETTERS = "[a-zÀ-ÿ]+"

#: Words that enter at one initial state, at most.
LIMIT = 20_000

PAIR = "word string, n long, near string, near_n long"


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 0) -> DataFrame:
    """``word`` for every run of letters of every text, A-Z lower-cased. With
    ``drop_every``, a run whose CRC32 of ``<id>:<run>`` it divides loses the code
    point at that CRC modulo the run's length."""
    text = F.translate(whole_text(text_col), string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                        F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word"))
    if not drop_every:
        return found.select("word")
    found = found.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
    return found.select(F.expr(
        f"CASE WHEN _h % {drop_every} = 0 THEN concat(substring(word, 1, CAST(_h % char_length(word) AS int)), "
        "substring(word, CAST(_h % char_length(word) AS int) + 2)) ELSE word END"
    ).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    counts = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def _near_in_group(k: int):
    """Composition of one initial state's words: both directions of every pair.
    Reversed words give only pairs that the words as they are do not."""

    def run(group: pa.Table) -> pa.Table:
        back = group["_back"][0].as_py()
        depth = len(group["_key"][0].as_py())
        count = dict(zip(group["_w"].to_pylist(), group["n"].to_pylist(), strict=True))
        start = next(iter(count))[:depth]
        rows = []
        for a, b in Acceptor(w[depth:] for w in count).near():
            a, b = start + a, start + b
            x, y = (a[::-1], b[::-1]) if back else (a, b)
            if not back or x[:k] != y[:k]:
                rows += [(x, count[a], y, count[b]), (y, count[b], x, count[a])]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["word", "n", "near", "near_n"])

    return run


def _behind(hot: DataFrame, k: int) -> DataFrame:
    """Pairs that differ right behind the shared start of their hot group."""
    at = hot.select("_back", "_key", "_w", "n", F.expr("substring(_w, _depth + 1, 1)").alias("_c"),
                    F.expr("substring(_w, _depth + 1)").alias("_rest"), F.expr("substring(_w, _depth + 2)").alias("_next"))
    a, b = at.alias("a"), at.where("_c <> ''").alias("b")
    same = (F.col("a._back") == F.col("b._back")) & (F.col("a._key") == F.col("b._key")) & (F.col("a._c") != F.col("b._c"))
    replaced = a.join(b, same & (F.col("a._next") == F.col("b._next")) & (F.col("a._c") != ""))
    inserted = a.join(b, same & (F.col("a._rest") == F.col("b._next")))
    one = [F.col("a._w").alias("x"), F.col("a.n").alias("n"), F.col("b._w").alias("y"), F.col("b.n").alias("near_n"), F.col("a._back").alias("_back")]
    other = [F.col("b._w").alias("x"), F.col("b.n").alias("n"), F.col("a._w").alias("y"), F.col("a.n").alias("near_n"), F.col("a._back").alias("_back")]
    pairs = replaced.select(*one).unionByName(inserted.select(*one)).unionByName(inserted.select(*other))
    for c in ("x", "y"):
        pairs = pairs.withColumn(c, F.when(F.col("_back"), F.reverse(c)).otherwise(F.col(c)))
    pairs = pairs.where(~F.col("_back") | (F.substring("x", 1, k) != F.substring("y", 1, k)))
    return pairs.select(F.col("x").alias("word"), "n", F.col("y").alias("near"), "near_n")


SHARED = """CASE WHEN least(char_length(_min), char_length(_max)) = 0 THEN 0 ELSE
    aggregate(sequence(1, least(char_length(_min), char_length(_max))), 0,
              (acc, i) -> CASE WHEN acc = i - 1 AND substring(_min, i, 1) = substring(_max, i, 1) THEN i ELSE acc END) END"""


def near_words(vocab: DataFrame, least_length: int = 6, limit: int = LIMIT) -> DataFrame:
    """``word, n, near, near_n`` for every ordered pair of near words of ``vocab``
    (``word, n``; distinct words of at least ``least_length`` code points)."""
    k = least_length // 2
    ahead = vocab.select(F.lit(False).alias("_back"), F.col("word").alias("_w"), "n")
    back = vocab.select(F.lit(True).alias("_back"), F.reverse("word").alias("_w"), "n")
    rows = (ahead.unionByName(back) if k else ahead).withColumn("_depth", F.lit(k))
    out, done = [], []
    while True:
        keyed = rows.withColumn("_key", F.expr("substring(_w, 1, _depth)"))
        sizes = keyed.groupBy("_back", "_key").agg(F.count(F.lit(1)).alias("_size"), F.min("_w").alias("_min"), F.max("_w").alias("_max"))
        sizes = sizes.where(F.col("_size") > limit)
        large = materialize(sizes.select("_back", "_key", F.expr(SHARED).alias("_shared")), "initial-states")
        if large.isEmpty():
            done.append(keyed)
            break
        done.append(keyed.join(large, ["_back", "_key"], "left_anti"))
        hot = materialize(keyed.join(large, ["_back", "_key"]), "words")
        out.append(_behind(hot.where("_shared <= _depth"), k))
        # a word that ends here has no pair further on
        rows = hot.select("_back", "_w", "n", F.when(F.col("_shared") > F.col("_depth"), F.col("_shared")).otherwise(F.col("_depth") + 1).alias("_depth"))
        rows = rows.where("char_length(_w) >= _depth")
    for part in done:
        out.append(part.select("_back", "_key", "_w", "n").groupBy("_back", "_key").applyInArrow(_near_in_group(k), PAIR))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms`` (``word, form``) that has a form. Forms
    lead to words of larger count, so they end; every round doubles the steps."""
    left = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = left.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        both = materialize(left.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        left = both.select("word", "root")
        if both.where("_moved").isEmpty():
            return left


def variant_groups(vocab: DataFrame, least_length: int = 6, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """One row per word of ``vocab`` (``word, n``): ``word, form, root, n, n_near, form_n``."""
    vocab = materialize(vocab.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(vocab, least_length, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    strong = -F.col("_best.m") >= F.col("n") * ratio
    forms = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.m")).alias("form_n"),
    )
    forms = materialize(forms, "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
