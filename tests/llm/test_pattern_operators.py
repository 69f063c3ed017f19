"""Periodic runs, spelling variants and licence scans against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llm.conftest import EDGES, prose

from tripmart.llm import licences, queries, variants
from tripmart.llm.acceptor import Acceptor
from tripmart.llm.licences import NOTICES, SHARE, scan_licences
from tripmart.llm.runs import find_runs, periodic_tails, run_report, runs_of
from tripmart.llm.variants import near_words, variant_groups, vocabulary, words_of

SF = "/root/testdata/sf0.001"


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=24):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            begin = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            own = w[start:i]
            if length >= max(least, 3 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, size):
    w, k = [], rng.choice([1, 2, 3, 5])
    while len(w) < size:
        how = rng.random()
        if how < 0.5:
            u = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 15, 16, 17, 21, 31, 32, 33]))]
            w += (u * rng.choice([1, 2, 3, 4, 7, 12]))[: -1 - rng.randrange(len(u))]
        elif how < 0.8 or not w:
            w += [rng.randrange(k) for _ in range(rng.randrange(9))]
        else:
            w += w[rng.randrange(len(w)):] * rng.choice([1, 2, 3])
    return w[:400]


@pytest.mark.parametrize("least", [24, 9, 40])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    found = 0
    for _ in range(80):
        docs = [repetitive(rng, rng.choice([0, 30, 100, 250])) for _ in range(4)]
        got = runs_of(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), least)
        assert got == [brute_runs(d, least) for d in docs]
        found += sum(map(len, got))
    assert found > 100


def test_runs_of_one_word_are_linear():
    assert runs_of(np.zeros(300_000, np.int64), np.array([300_000])) == [[(0, 300_000, 1)]]


def run_row(i, text):
    w = words_in(text)
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return (
        i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
    )


def planted(i, text):
    h, w = zlib.crc32(str(i).encode()), words_in(text)
    g, n = h // 10, len(w)
    if i is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def test_run_report_of_planted_and_odd_rows(spark, edges):
    rows = [(i, prose(i, 40 + i)) for i in range(200)] + [(1000, "x y z " * 30 + "a b " * 20 + "x y z " * 30), (1000, "x y z " * 30 + "a b " * 20 + "x y z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges.where("doc_id IS NULL OR doc_id <> 8").select("doc_id", "text"))
    rows += [(i, t) for i, t, *_ in EDGES if i != 8]
    changed = periodic_tails(docs)
    assert sorted((repr(r.doc_id), r.text) for r in changed.collect() if r.text is not None) == sorted((repr(i), planted(i, t)) for i, t in rows if t is not None)
    out = run_report(find_runs(changed))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [run_row(i, planted(i, t)) for i, t in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and sum(r[1] for r in want) > 15
    assert find_runs(docs.limit(0)).collect() == []


def test_runs_of_a_long_text_and_columns(spark, edges):
    assert find_runs(edges).columns == ["doc_id", "runs", "collapsed_sha256"]
    got = {r.doc_id: r for r in find_runs(edges, texts=True).collect()}
    assert [tuple(r) for r in got[8].runs] == [(0, 30_000, 1)] and got[8].collapsed == "1 4111 1111 1111 1111"
    assert got[2].collapsed == "" and got[2].runs == [] and len(got) == len({i for i, *_ in EDGES})


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def test_composition_accepts_the_near_pairs():
    rng = random.Random(4)
    for _ in range(150):
        own = sorted({"".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(9))) for _ in range(50)})
        got = [tuple(sorted(p)) for p in Acceptor(own).near()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for i, a in enumerate(own) for b in own[i + 1:] if one_edit(a, b)}
    assert list(Acceptor([]).near()) == [] and list(Acceptor([""]).near()) == [] and len(Acceptor(["xing", "ping"]).moves) == 5
    assert len(list(Acceptor(["a" * 30_000, "a" * 30_001, "b" + "a" * 29_999]).near())) == 2


@pytest.mark.parametrize("limit", [20_000, 30, 1])
def test_near_words_at_any_limit(spark, limit):
    rng = random.Random(7)
    own = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(250)} | {"prefix" + "".join(rng.choice("xy") for _ in range(rng.randrange(5))) for _ in range(60)}
    rows = [(w, 5 + i) for i, w in enumerate(sorted(own))]
    got = near_words(spark.createDataFrame(rows, "word string, n long"), 6, limit).collect()
    count = dict(rows)
    want = {(a, count[a], b, count[b]) for a in own for b in own if one_edit(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def brute_variants(rows, least_length=6, least_count=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    own = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in own if one_edit(w, x)] for w in own}
    best = {w: min(near[w], key=lambda x: (-own[x], x), default=None) for w in own}
    form = {w: x if x and own[x] >= ratio * own[w] else None for w, x in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), own[form[w]] if form[w] else None) for w, n in own.items()}


def test_variants_equal_brute_force(spark, edges):
    rng = random.Random(9)
    base = ["separate", "Necessary", "ÉCOLEs", "écoles", "received", "recieved", "thunder", "thunders", "thunderss"]
    rows = []
    for i in range(400):
        own = [rng.choice(base[: 1 + i % len(base)]) for _ in range(30)]
        rows.append((i, " ".join(w[:k] + w[k + 1:] if rng.random() < 0.1 else w for w in own for k in [rng.randrange(len(w))])))
    chain = [("chaina", 5), ("chainb", 30), ("chainbs", 200), ("chainbst", 1100)]  # forms of forms of forms
    rows += [(2000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges.select("doc_id", "text"))
    rows += [(i, t) for i, t, *_ in EDGES]
    want = brute_variants(rows)
    got = variant_groups(vocabulary(words_of(docs, drop_every=199))).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    by = {r.word: r for r in got}
    assert by["chaina"].root == "chainbst" and by["chainbst"].form is None and sum(r.form is not None for r in got) > 10
    assert variant_groups(vocabulary(words_of(docs.limit(0)))).collect() == []
    assert Counter(r.word for r in words_of(edges.where("doc_id = 10")).collect()) == Counter(["thequickbrown", "fox"])


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_licences(rows):
    own = licences.templates(licences.BASE_PHRASES, NOTICES, SHARE)
    texts = [plain_words(t) for _, t in rows]
    df = Counter(w for t in texts for w in set(t))
    weight = {w: np.log((len(rows) + 1) / (df[w] + 0.5)) for t in own for w in t.words}
    out = []
    for (i, _), words in zip(rows, texts, strict=True):
        base, found = [], []
        for t in own:
            total = sum(weight[w] for w in t.words)
            for at in range(1 - len(t.words), len(words)):
                stands = [0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(t.words)]
                share = sum(weight[w] for w, s in zip(t.words, stands, strict=True) if s) / total
                keys = all(all(stands[p : p + len(x)]) for x in t.keys for p in [next(p for p in range(len(t.words)) if t.words[p : p + len(x)] == x)])
                if share >= t.share - 1e-9 and keys:
                    found.append((t.label, share))
                    if t.base:
                        base.append((at, t.label))
        at = [p for p, _ in base]
        out.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
                    ",".join(sorted({x for x, _ in found})), round(min(1.0, max((s for _, s in found), default=0.0)), 9)))
    return sorted(out, key=repr)


def licence_rows():
    rng = random.Random(2)
    rows = [(i, prose(i, 30)) for i in range(120)]
    for k, (_, notice, _) in enumerate(NOTICES):
        words = notice.split()
        rows.append((200 + k, f"{prose(k, 9)} {notice.upper()}. {prose(k, 5)}"))
        words[rng.randrange(len(words))] = "other"  # one word of the notice is another
        rows.append((300 + k, f"{prose(k, 9)}; {', '.join(words)} -- {prose(k, 5)}"))
        rows.append((400 + k, " ".join(notice.split()[rng.randrange(4):])))  # cut by the start of the text
    rows += [(500, "CC BY cc-by CC\nBY. All rights reserved, all rights all rights reserved"), (501, "the of general public license ccby é general public license"),
             (502, "the the the of of " * 200 + "license public general"), (503, "Licensed under CC BY-NC 4.0."), (504, "GNU General Public License, version 3.")]
    return rows


def test_licences_equal_brute_force(spark, edges):
    rows = licence_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges.where("doc_id IS NULL OR doc_id NOT IN (7, 8, 9)").select("doc_id", "text"))
    rows += [(i, t) for i, t, *_ in EDGES if i not in (7, 8, 9)]
    got = scan_licences(docs).drop("notices").collect()
    assert sorted([(*tuple(r)[:-1], round(r.score, 9)) for r in got], key=repr) == brute_licences(rows)
    by = {r.doc_id: r for r in got}
    assert by[500].n_base == 5 and (by[500].first_word, by[500].last_word, by[500].base_labels) == (0, 11, "cc-by,reserved")
    assert by[503].base_labels == "cc-by" and "cc-by-nc-4.0" in by[503].labels and by[2].labels == "" and by[2].score == 0
    assert all(by[i].labels == "" for i in range(10, 120)) and all(by[200 + k].score == 1 for k in range(len(NOTICES)))
    assert scan_licences(docs.limit(0)).collect() == []


def test_licences_of_odd_rows_and_notices(edges):
    out = scan_licences(edges)
    assert len(out.collect()) == len(EDGES) and out.columns[-1] == "notices" and "shard" not in out.columns
    with pytest.raises(ValueError):
        scan_licences(edges, notices=[("x", "some notice", ["no key of it"])])
    assert scan_licences(edges, phrases={"quick brown": "fox"}, notices=[]).where("labels = 'fox'").count() == 4


@pytest.mark.parametrize("key", ["op11_periodic_runs", "op13_licence_scan"])
def test_registered_query_covers_its_table(spark, key):
    out = queries.QUERIES[key](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    if key.startswith("op11"):
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(run_row(i, planted(i, t))) for i, t in rows)
    else:
        assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows)


def test_registered_variants_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.QUERIES["op12_spelling_variants"](spark, SF).collect()} == brute_variants(rows)
    assert variants.LIMIT > 0
