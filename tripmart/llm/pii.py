"""Operator 5 [native]: information-theoretic sanitisation of personal data.

Base spans (emails, IP addresses, card and phone numbers) are found in every
whole text. Protected entities are their values and, with ``parts``, what recurs
from value to value: names in a mail address, mail domain, network, card issuer,
dialling code. Terms are counted with the entities of their whole text, and over
all texts; equal texts count once. A term discloses an entity if its pointwise
mutual information with it reaches the share ``disclosure`` of the entity's
information content, i.e. if knowing the term all but names the entity, if at
least ``support`` different texts show the pair, and if so many texts of a term
would meet the entity by chance once in two to the power ``evidence`` at most
(a part that most texts hold is met by chance). Every occurrence of such a term in a whole text that holds the entity
is a span too; with ``everywhere``, in every text, with or without the entity.
Sanitising generalises base spans to their kind and disclosing terms to a class.

Counts of terms that texts with a recurring entity hold, (term, text) pairs of
those texts and (term, entity) pairs shuffle, combined before. Bitmaps of fixed
size keep other terms, and texts without a copy, out of every join.

Defined results: null and empty texts have no spans; repeated rows are rows, but
equal texts are one piece of evidence; a null ``doc_id`` stays null; an empty
table gives an empty result. Matching is linear in the text: patterns are
possessive, and start only where the plain pattern could.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import named, place, positional, whole_text
from tripmart.operators.sketch import hash_bitmap
from tripmart.session import materialize

KINDS = ["email", "ip", "card", "phone", "term"]

# Same matches as the plain patterns, without a restart inside a run that can't match.
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.(?={LABEL})(?:(?!\.(?!{LABEL}))[A-Za-z0-9.-])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter runs of digits would be dropped anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){11}(?:(?![\x20-](?![0-9]))[0-9\x20-])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}][\p{L}\p{N}_]++"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _none() -> Column:
    return F.expr(f"CAST(array() AS array<{SPAN}>)")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(
        F.transform(back, lambda d, i: (d.cast("int") * (i % 2 + 1)).cast("int")),
        F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) == 0) | ((F.length(bare) <= 3) & (F.substring(bare, 1, 4).cast("int") <= 255))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda span: _valid(kind, span["value"])


def _found(text: Column, pattern: str, kind: int, keep=lambda hit: F.lit(True)) -> Column:
    """Matches of a pattern that ``keep`` takes, with code point offsets: gaps and
    matches in turn."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(x["hit"].isNull() | ~keep(x["hit"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"),
        )

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][\\x20-]?[0-9]"), "phone": text.contains("+")}
    own = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.filter(_found(text, PATTERNS[kind], k), _validity(kind))
        own.append(F.when(needs[kind], spans).otherwise(_none()))
    return F.array_sort(F.concat(*own))


def _masked(text: Column, base: Column) -> Column:
    """The text with every base span blanked, code point by code point."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), s["end"] - F.greatest(acc["at"], s["start"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    done = F.aggregate(base, start, step)
    return F.when(F.size(base) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def _terms() -> Column:
    """Distinct terms of the whole text outside its base spans."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_masked(F.col("_text"), F.col("_base")), F.lit(TERM), F.lit(0)), F.lower))


def _parts(span: Column) -> Column:
    """A base span's value and its parts that recur in other values."""
    value = F.lower(span["value"])
    names = F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit("[a-z0-9]{2,}"), F.lit(0))
    email = F.concat(F.array(F.concat(F.lit("domain:"), F.substring_index(value, "@", -1))), F.transform(names, lambda n: F.concat(F.lit("name:"), n)))
    networks = F.array(*(F.concat(F.lit(f"net{k}:"), F.substring_index(value, ".", k)) for k in (2, 3)))
    issuer = F.array(F.concat(F.lit("issuer:"), F.substring(_digits(value), 1, 6)))
    dialling = F.array(F.concat(F.lit("dial:"), F.substring(_digits(value), 1, 4)))
    own = F.when(span["kind"] == 0, email).when(span["kind"] == 1, networks).when(span["kind"] == 2, issuer).otherwise(dialling)
    return F.concat(F.array(F.concat(F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), F.lit(":"), value)), own)


def _entities(parts: bool) -> Column:
    """Distinct protected entities of a text."""
    return F.array_distinct(F.flatten(F.transform("_base", _parts if parts else lambda s: F.slice(_parts(s), 1, 1))))


def _text_key() -> Column:
    """256-bit digest of the text: no two texts share one."""
    return F.unhex(F.sha2(F.col("_text"), 256))


def _among(values: DataFrame, name: str):
    """Filter that passes every value of a column, and few others, without a join."""
    holds = hash_bitmap(values.select(F.xxhash64(name).alias("_h")))
    return holds(F.xxhash64(name))


def _texts(rows: DataFrame) -> DataFrame:
    """One row of each distinct text. Only ids and digests shuffle, and the texts of
    rows that a bitmap of fixed size takes for further copies."""
    keys = rows.select("_rid", "_text_key")
    copied = keys.groupBy("_text_key").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = materialize(keys.join(copied, "_text_key").where("_rid <> _first").select("_rid"), "again")
    perhaps = _among(again, "_rid")
    rows = rows.select("_rid", "_text_key", "_text", "_base")
    return rows.where(~perhaps).unionByName(rows.where(perhaps).join(again, "_rid", "left_anti"))


def disclosing(rows: DataFrame, disclosure: float, support: int, evidence: float = 0.0, parts: bool = False) -> DataFrame:
    """``term, entity`` pairs whose term discloses the entity.

    ``rows`` has ``_rid, _text_key, _text, _base`` of every document. PMI(t, e) /
    IC(e) over different texts: N, n(t) that hold t, n(e) and n(t, e). As n(t, e)
    is at most n(e), only terms with n(t) <= n(e) * (N / n(e)) ** (1 -
    disclosure) can reach the share; no other pairs are made. Only terms that
    ``support`` texts with a recurring entity hold are looked at."""
    texts = _texts(rows)
    total = texts.agg(F.count(F.lit(1)).alias("n"))
    held = texts.where(F.size("_base") > 0)
    named = materialize(held.select("_rid", F.explode(_entities(parts)).alias("entity")), "entities")
    entities = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    most = F.col("n_entity") * F.pow(F.col("n") / F.col("n_entity"), F.lit(1 - disclosure)) * 1.000001
    entities = entities.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("n_entity")).withColumn("_most", most)  # one row
    entities = materialize(entities, "n_entity")
    if not entities.head(1):  # nothing recurs, so nothing can be disclosed
        return entities.select(F.lit("").alias("term"), "entity")
    bound = entities.agg(F.max("_most").alias("_bound"))
    own = materialize(named.join(entities, "entity"), "recurring")
    held = held.join(own.select("_rid").distinct(), "_rid", "left_semi")
    held = materialize(held.select("_rid", F.explode(_terms()).alias("term")), "held")
    near = materialize(held.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= support).select("term"), "near")
    terms = texts.select(F.explode(_terms()).alias("term")).where(_among(near, "term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # an inner join: a semi-join would be pushed below the aggregate, and every occurrence shuffled
    terms = terms.join(near, "term").crossJoin(F.broadcast(bound)).where(F.col("n_term") <= F.col("_bound")).drop("_bound")  # one row
    pairs = held.join(materialize(terms, "terms"), "term").join(own, "_rid").where(F.col("n_term") <= F.col("_most"))
    pairs = pairs.groupBy("term", "entity", "n_term", "n_entity", "n").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    content = F.log(F.col("n") / F.col("n_entity"))
    score = F.log(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_entity"))) / content
    return pairs.where((score >= disclosure) & (F.col("n_both") * content / math.log(2) >= evidence)).select("term", "entity")


def _told_spans() -> Column:
    """Spans of every occurrence of a term of ``_told`` outside the base spans."""
    return _found(_masked(F.col("_text"), F.col("_base")), TERM, 4, keep=lambda hit: F.array_contains(F.col("_told"), F.lower(hit)))


def _with_spans(rows: DataFrame, disclosure: float, support: int, everywhere: bool, evidence: float, parts: bool) -> DataFrame:
    """Rows (``_rid, _base, ...`` written before) with ``_spans``."""
    pairs = materialize(disclosing(rows, disclosure, support, evidence, parts), "pairs")
    if everywhere:
        names = materialize(pairs.select("term").distinct(), "names")
        told = rows.select("_rid", F.explode(_terms()).alias("term")).where(_among(names, "term")).join(names, "term")
    else:
        some = rows.where(F.size("_base") > 0).select("_rid", _entities(parts).alias("_own"), F.explode(_terms()).alias("term"))
        told = some.join(pairs, "term").where(F.array_contains("_own", F.col("entity")))
    told = materialize(told.groupBy("_rid").agg(F.collect_set("term").alias("_told")), "told")
    spans = F.array_sort(F.concat("_base", _told_spans()))
    return rows.join(told, "_rid", "left").withColumn("_spans", F.when(F.col("_told").isNull(), F.col("_base")).otherwise(spans)).drop("_told")


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    """Positional columns of ``docs`` and the operator's own, written."""
    rows = positional(docs).withColumn("_rid", F.monotonically_increasing_id()).withColumn("_text", whole_text(place(docs, text_col)))
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).withColumn("_text_key", _text_key())
    return materialize(rows, "rows")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.9, support: int = 3,
                 everywhere: bool = False, evidence: float = 12.0, parts: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_email, n_ip, n_card, n_phone,
    base_sha256, spans``."""
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = rows.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_base", base_spans(F.col("_text")))
    rows = materialize(rows.withColumn("_text_key", _text_key()), "rows")
    out = _with_spans(rows, disclosure, support, everywhere, evidence, parts)
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select(F.col("_id").alias(id_col), *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first's class."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(tags, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitize(docs: DataFrame, text_col: str = "text", disclosure: float = 0.9, support: int = 3, everywhere: bool = False,
             evidence: float = 12.0, parts: bool = False) -> DataFrame:
    """``docs`` with every span generalised in ``text_col``; all rows and columns stay,
    whatever their names, the others with their values. Texts without a span are
    unchanged (null stays null)."""
    own = place(docs, text_col)
    out = _with_spans(_prepared(docs, text_col), disclosure, support, everywhere, evidence, parts)
    clean = F.when(F.size("_spans") > 0, _rewritten(F.col("_text"), F.col("_spans"))).otherwise(F.col(own))
    return named(out.withColumn(own, clean), docs)
