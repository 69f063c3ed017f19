"""Token counts, SentencePiece, packing and PII against the libraries and
plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.conftest import EDGES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripmart.llm.packing import first_fit, pack
from tripmart.llm.pieces import decode, encode
from tripmart.llm import pii
from tripmart.llm.pii import find_private, sanitize
from tripmart.llm.token_counts import PieceRanks, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(edges, sp):
    got = sorted(map(tuple, count_tokens(edges, MODEL, limit=20).collect()), key=repr)
    want = []
    for i, text, *_ in EDGES:
        n = len(sp.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 20))
    assert got == sorted(want, key=repr)


def test_heap_and_rounds_agree(sp):
    ranks = PieceRanks(MODEL)
    for word in ["ab" * 90, "thethethe" * 20, "aaaa" * 60, "internationalisation" * 9]:
        sym, _ = ranks.symbols([word])
        merged, _ = ranks.merge([word])
        assert ranks.merge_long(sym).tolist() == merged.tolist()


def test_counts_of_an_empty_table(edges):
    assert count_tokens(edges.limit(0), MODEL).collect() == []


def test_encoding_equals_the_library_and_decodes(edges, sp):
    want = sorted((repr(i), sp.encode(t or ""), (t or "").replace("▁", " ")) for i, t, *_ in EDGES)
    for both in (decode(encode(edges, MODEL), MODEL), encode(edges, MODEL, decoded=True)):
        assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in both.collect()) == want


def test_encoding_of_prose(many, sp):
    texts = {r.doc_id: r.text for r in many.collect()}
    for r in encode(many, MODEL).collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id])


def test_both_libraries_give_the_same_ids(many):
    import json

    from tripmart.llm.packing import byte_ranks, encoder

    tok, fast = Tokenizer.from_file(BYTES), encoder(BYTES)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}x\n{chr(c)} 's{chr(c)}'ll  {chr(c)}" for c in points]
    texts += [t or "" for _, t, *_ in EDGES] + [r.text for r in many.collect()[:50]] + ["<|endoftext|>", "x <|endoftext|>\n"]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert fast(t).tolist() == e.ids, t[:60]
    with open(BYTES) as f:
        model = json.load(f)
    assert len(byte_ranks(model)) == 50256 and byte_ranks(model | {"normalizer": {"type": "NFC"}}) is None
    other = public_tokenizers.path("word_bpe_49k.json")  # not byte-level: its own library
    assert encoder(other)("Some words").tolist() == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


def check_packing(rows, texts, size):
    tok = Tokenizer.from_file(BYTES)
    by_sequence = defaultdict(list)
    found = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for i, group in texts.items():
        ids = [tok.encode(t, add_special_tokens=False).ids + [1] for t in group]
        want = sorted(
            (s, min(size, len(x) - s), zlib.crc32(np.array(x[s : s + size], "<u4").tobytes()), len(x)) for x in ids for s in range(0, len(x), size)
        )
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found[i]) == want
    return len(by_sequence)


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_holds_every_id_once(edges, size):
    texts = defaultdict(list)
    for i, t, *_ in EDGES:
        texts[i].append(t or "")
    check_packing(pack(edges, BYTES, size=size, group_pieces=5).collect(), texts, size)
    assert pack(edges.limit(0), BYTES).collect() == []


def test_packing_wastes_little(many):
    texts = {r.doc_id: [r.text] for r in many.collect()}
    rows = pack(many, BYTES, size=2048).collect()
    used = check_packing(rows, texts, 2048)
    assert sum(r.length for r in rows) > 0.9 * 2048 * used


def test_packing_gives_the_ids(many):
    for r in pack(many, BYTES, keep_ids=True).collect()[:50]:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_first_fit_is_the_first_bin_with_room():
    lengths = np.array([9, 8, 7, 6, 5, 4, 3, 3, 2, 1, 1, 1])
    room = [10] * len(lengths)
    want = []
    for n in lengths.tolist():
        k = next(k for k, r in enumerate(room) if r >= n)
        want.append((k, 10 - room[k]))
        room[k] -= n
    assert list(zip(*(x.tolist() for x in first_fit(lengths, 10)), strict=True)) == want


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            twice = [int(d) * (k % 2 + 1) for k, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
        return 9 <= len(digits) <= 15 if kind == "phone" else True

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(kind, m.group())]
    return sorted(found)


def digest(text):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in plain_spans(text)).encode()).hexdigest()


TRICKY = [
    "a@b.c_d@e.f g@h i@j..k l@m.n. +1 (2) 3-4.5 6789 01234 +12", "4111-1111-1111-1111 4111 1111 1111 11111 41111111111111111111",
    "0.0.0.0 1.2.3 1.2.3.4.5.6.7.8.9 000255.1.1.1 256.1.1.1 \U0001F600 9.9.9.9", "%+-@a.b-.c -@-.- é@b.cc @a.b x@y.z@u.v 12 3-4  5- 6",
]


def test_base_spans_equal_the_plain_patterns(spark, edges):
    rows = [(100 + k, t) for k, t in enumerate(TRICKY)]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in find_private(docs).collect())
    want = []
    for i, t, *_ in [*EDGES, *rows]:
        kinds = [k for *_, k in plain_spans(t or "")]
        want.append((repr(i), *(kinds.count(k) for k in PLAIN), digest(t or "")))
    assert got == sorted(want)
    assert find_private(docs.limit(0)).collect() == []


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} from Zanzibar office the desk: agent{i % 7} writes to m.x@secret.org today {i * 31}") for i in range(6)]
    rows += [(100 + i, f"the desk today writes note {i} to nobody") for i in range(60)]
    copy = "a copy from Atlantis office: agent writes to other@secret.org today"
    rows += [(200 + i, copy) for i in range(5)]  # copies are one piece of evidence
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    told = {}
    for r in find_private(docs, support=3).collect():
        told[r.doc_id] = {texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
    assert all("Zanzibar" in told[i] for i in range(6))
    assert "the" not in told[0] and "desk" not in told[0]
    assert all(told[i] == set() for i in range(100, 160)) and all(told[i] == set() for i in range(200, 205))
    clean = {r.doc_id: r.text for r in sanitize(docs).collect()}
    assert len(clean) == len(rows) and "[EMAIL]" in clean[0] and "Zanzibar" not in clean[0] and clean[100] == texts[100]


def test_sanitize_keeps_rows_and_columns(edges):
    out = sanitize(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES)
    assert out.where("doc_id = 2").first().text is None
    assert out.where("doc_id = 1").first().text == "The quick brown fox. Mail [EMAIL] or [PHONE]!"
    assert out.where(F.col("doc_id") == 9).first().text.endswith(" 256.1.1.1 [IP].[IP] [EMAIL][EMAIL]")


def _terms_told(docs, **how):
    texts = {r.doc_id: r.text for r in docs.collect()}
    return {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
            for r in find_private(docs, **how).collect()}


def test_copies_do_not_hide_a_disclosing_term(spark):
    rows = [(i, f"Zanzibar office {i * 7} m.x@secret.org") for i in range(3)] + [(100 + i, f"plain office words {i}") for i in range(60)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    told = _terms_told(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(told[i] == (["Zanzibar"] if "Zanzibar" in t else []) for i, t in rows)


def test_terms_of_whole_texts(spark):
    gap = " ".join(f"filler{k % 9}" for k in range(40))
    rows = [(i, f"Zanzibar {gap} {i * 7} m.x@secret.org {gap} zanzibar") for i in range(3)] + [(100 + i, f"{gap} plain {i}") for i in range(60)]
    rows += [(200, f"nothing but Zanzibar here {gap}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    here = _terms_told(docs, disclosure=0.8)
    assert all(here[i] == (["Zanzibar", "zanzibar"] if i < 3 else []) for i, _ in rows)
    everywhere = _terms_told(docs, disclosure=0.8, everywhere=True)
    assert everywhere == here | {200: ["Zanzibar"]}
    clean = {r.doc_id: r.text for r in sanitize(docs, disclosure=0.8, everywhere=True).collect()}
    assert clean[200] == f"nothing but [TERM] here {gap}" and clean[0] == f"[TERM] {gap} 0 [EMAIL] {gap} [TERM]" and clean[100] == rows[3][1]


def plain_parts(kind, value):
    value, digits = value.lower(), re.sub("[^0-9]", "", value)
    own = {
        "email": [f"domain:{value.split('@')[1]}", *(f"name:{n}" for n in re.findall("[a-z0-9]{2,}", value.split("@")[0]))] if kind == "email" else [],
        "ip": [f"net{k}:{'.'.join(value.split('.')[:k])}" for k in (2, 3)],
        "card": [f"issuer:{digits[:6]}"],
        "phone": [f"dial:{digits[:4]}"],
    }[kind]
    return {f"{kind}:{value}", *own}


def plain_disclosing(texts, disclosure, support, evidence):
    """Pairs by counting every term with every entity of every different text."""
    n, terms, entities, both = len(set(texts)), Counter(), Counter(), Counter()
    for text in set(texts):
        spans = plain_spans(text)
        bare = list(text)
        for a, _, b, _ in spans:
            bare[a:b] = " " * (b - a)
        own = {t.lower() for t in re.findall(r"[^\W_]\w+", "".join(bare))}
        held = {e for a, _, b, kind in spans for e in plain_parts(kind, text[a:b])}
        terms.update(own)
        entities.update(held)
        both.update((t, e) for t in own for e in held)
    out = set()
    for (t, e), k in both.items():
        if k >= support and entities[e] < n:
            content = math.log(n / entities[e])
            if math.log(k * n / (terms[t] * entities[e])) / content >= disclosure and k * content / math.log(2) >= evidence:
                out.add((t, e))
    return out


@pytest.mark.parametrize("evidence", [0.0, 16.0])
def test_disclosure_equals_plain_counting(spark, evidence):
    draw = random.Random(11)
    rows = []
    for i in range(240):
        words = [draw.choice(["the", "of", "it", "9x", "a42b", "Ort", "desk", f"w{draw.randrange(60)}w"]) for _ in range(12)]
        if i % 4 == 0:
            firm = draw.randrange(6)
            words += [f"Firm{firm}a", draw.choice([f"{draw.choice('abc')}.smith{firm}@mail{firm}.org", f"10.{firm}.{draw.randrange(3)}.9"] if firm < 5 else [f"+4{firm} 30 {draw.randrange(10**6, 10**7)};"])]
        if i % 9 == 0:
            words += ["4111 1111 1111 1111", "bank"]
        draw.shuffle(words)
        rows += [(i, " ".join(words))] * (1 + 30 * (i == 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_disclosing([t for _, t in rows], 0.9, 3, evidence)
    got = {tuple(r) for r in pii.disclosing(pii._prepared(docs, "text"), 0.9, 3, evidence, parts=True).collect()}
    assert got == want and any(e.startswith(("domain", "net", "dial")) for _, e in want) and ("bank", "issuer:411111") in want
    # spans: every occurrence of a disclosing term in any text, outside the base spans
    told = {t for t, _ in want}
    for r in find_private(docs, everywhere=True, evidence=evidence, parts=True).distinct().collect():
        text = dict(rows)[r.doc_id]
        base = plain_spans(text)
        bare = list(text)
        for a, _, b, _ in base:
            bare[a:b] = " " * (b - a)
        terms = [(m.start(), 4, m.end(), "term") for m in re.finditer(r"[^\W_]\w+", "".join(bare)) if m.group().lower() in told]
        assert r.spans == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(base + terms))
