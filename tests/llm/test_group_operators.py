"""Sharding, duplicates, embeddings, toxicity, quality and the pipeline against
brute-force versions."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm.conftest import EDGES, prose
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from tripmart.llm import exact_dedup, quality, queries, simhash, toxicity
from tripmart.llm.embeddings import near_vectors
from tripmart.llm.quality import chained, coded, grams, score_quality, triples
from tripmart.llm.sharding import interleave, write_shards
from tripmart.llm.tables import components
from tripmart.session import run_scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_shards_hold_the_mixture(many, rows_per_range):
    rows = interleave(many, shards=16, range_rows=rows_per_range).join(many.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == 300
    shards, sources = defaultdict(list), Counter(r.source for r in rows)
    for r in rows:
        shards[r.shard].append(r)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), "rows", None)
    counts = [len(s) for s in shards.values()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        own = Counter(r.source for r in s)
        assert all(abs(own[x] - n / 16) <= 2 for x, n in sources.items())
    assert [r.doc_id for r in sorted(shards[0], key=lambda r: r.slot)] != sorted(r.doc_id for r in shards[0])


def test_shards_of_odd_rows(edges, tmp_path):
    out = interleave(edges, shards=4)
    rows = out.collect()
    assert len(rows) == len(EDGES) and {r.shard for r in rows} == {0, 1, 2, 3}
    assert out.where("doc_id = 2").first().asDict()["size"] == 1 and out.where("doc_id = 2").first().text_crc32 == 0
    assert interleave(edges.limit(0)).collect() == []
    write_shards(out, str(tmp_path / "s"))
    assert len([d for d in os.listdir(tmp_path / "s") if d.startswith("shard=")]) == 4


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})].append((-len(t or ""), i is None, i or 0, k))
    return Counter((rows[g[3]][0], rows[min(own)[3]][0], len(own), g[3] == min(own)[3]) for own in groups.values() for g in own)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda b: F.octet_length(b).cast("long")])
@pytest.mark.parametrize("size", [5, 16384])
def test_exact_groups(edges, hashed, size):
    got = exact_dedup.exact_groups(edges.where("doc_id IS NULL OR doc_id NOT IN (7, 8, 9)"), block_bytes=size, hashed=hashed).collect()
    rows = [(i, t) for i, t, *_ in EDGES if i not in (7, 8, 9)]
    # of equal rows either may stay
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute_exact(rows)


def test_exact_names_long_texts(spark):
    base = prose(3, 4000)
    texts = [base, base, base[:-1] + "!", "!" + base[1:], base + base, base[:16384], base[:16384]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, block_bytes=64).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 2), 6: (5, 2)}


def test_drop_exact_keeps_columns(edges):
    out = exact_dedup.drop_exact(edges)
    assert set(out.columns) >= set(edges.columns) - {"_rid"}
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 4, 5, None, 7, 8, 9, 11, 12])
    assert exact_dedup.exact_groups(edges.limit(0)).collect() == []


def test_exact_oracle(spark):
    key = "op6_exact_dedup"
    assert compare(spark, duck(SF), key, queries.QUERIES[key], queries.ORACLES[key], SF)["ok"]


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    low = {}
    for i, x in zip(label, ids, strict=True):
        low[i] = min(low.get(i, x), x)
    return [low[i] for i in label]


def test_simhash_links_every_near_pair(many):
    rows = many.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = brute_components([r.doc_id for r in rows], linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(many).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)}
    assert len(set(want)) < len(want) - 40


def test_simhash_index_is_complete(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    prints = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            x = b
            for bit in rng.choice(64, n, replace=False).tolist():
                x ^= (1 << bit) - (1 << 64 if bit == 63 else 0)
            prints.add(x)
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "_fp long")).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want


def test_simhash_of_odd_rows(edges):
    got = simhash.near_groups(edges).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in EDGES)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[4].component_id == 2
    kept = simhash.drop_near(edges)
    assert kept.where("doc_id IN (2, 3, 4)").count() == 1 and kept.where("doc_id = 1").count() == 1
    assert simhash.near_groups(edges.limit(0)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_embeddings_find_every_link(spark, monkeypatch):
    from tripmart.llm import embeddings

    rng = np.random.default_rng(5)
    tops = rng.normal(size=(60, 8))
    rows = [(tops[i % 60] + rng.normal(size=8) * (0.02 + 0.3 * (i % 3))).tolist() for i in range(700)]
    rows += [rows[0]] * 30 + [[2 * x for x in rows[1]]]
    odd = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 0.0], [1.0, 0.1], None]
    table = [(i, v, 0, "x") for i, v in enumerate(rows + odd)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    n = len(rows)
    pairs = list(zip(*np.nonzero(link), strict=True)) + [(n + 6, n + 7)]
    comp = brute_components(list(range(len(table))), pairs)
    want = {i: (int(link[i].sum()) if i < n else int(i in (n + 6, n + 7)), c, i == c) for i, c in enumerate(comp)}
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, _k string")
    for block in (8192, 64):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
        assert got == want
    assert near_vectors(df.limit(0)).collect() == [] and near_vectors(df.where("embedding IS NULL")).count() == 2


def brute_marginals(emit, trans):
    n = len(emit)
    weight = np.zeros((2,) * n)
    for tags in np.ndindex(*weight.shape):
        weight[tags] = math.exp(sum(e for e, t in zip(emit, tags, strict=True) if t) + sum(trans[a][b] for a, b in zip(tags, tags[1:], strict=False)))
    weight /= weight.sum()
    return [weight.take(1, axis=k).sum() for k in range(n)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    n = np.array([3, 0, 6, 1])
    emit, trans = rng.normal(size=10), rng.normal(size=(2, 2))
    fore, back = toxicity.forward_backward(emit, n, trans)
    got = 1 / (1 + np.exp(-(fore + back)))
    ends = np.cumsum(n)
    want = [p for e, k in zip(ends, n, strict=True) for p in brute_marginals(emit[e - k : e], trans)]
    assert np.allclose(got, want)


def test_toxicity_learns_and_tags(spark, edges):
    rows = [(i, prose(i, 50) + (" you vilefool go" if i % 4 == 0 else "") + " " + prose(i + 999, 20)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    texts = dict(rows)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert all(out[i].predicted == int(i % 4 == 0) and 0 <= out[i].score <= 1 for i in out)
    for i in (0, 4, 8):
        assert "vilefool" in {texts[i][s.start : s.end] for s in out[i].toxic_spans} or any("vilefool" in texts[i][s.start : s.end] for s in out[i].toxic_spans)
    odd = toxicity.score_toxicity(edges, labels).collect()
    assert len(odd) == len(EDGES)
    none = toxicity.score_toxicity(edges, labels.limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.score_toxicity(edges.limit(0), labels).collect() == []


def brute_quality(trusted, texts, order=3):
    """Interpolated modified Kneser-Ney over words, counted with dicts."""
    def grams_of(text):
        words = ["<s>"] * 2 + re.findall("[^\\x20\\x09-\\x0D]+", text.lower()) + ["</s>"]
        return [tuple(words[i : i + order]) for i in range(len(words) - 2)] if len(words) > 3 else []

    tables = {order: Counter(g for t in trusted for g in grams_of(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount = {}
    for k, table in tables.items():
        n = [sum(1 for c in table.values() if c == m) for m in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            discount[k] = [0, 0.5, 0.75, 0.75]
            continue
        y = n[0] / (n[0] + 2 * n[1])
        discount[k] = [0] + [min(max(m - (m + 1) * y * n[m] / n[m - 1], 0.05), m) if n[m - 1] else 0.75 for m in (1, 2, 3)]
    context = {k: defaultdict(list) for k in tables}
    for k, table in tables.items():
        for g, c in table.items():
            context[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        k = len(g)
        own = context[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d = discount[k]
        c = tables[k].get(g, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in own) * p(g[1:])) / sum(own)

    own = [grams_of(t) for t in texts]
    return [math.exp(-sum(math.log(p(g)) for g in gs) / len(gs)) if gs else None for gs in own]


def in_fold(text):
    """Whether a trusted text sets thresholds instead of training."""
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).view(np.int64)) % 5 == 0


def test_quality_equals_plain_kneser_ney(spark):
    rows = [(i, prose(i, 12) if i % 9 else "ZZQX!! %%", "en" if i % 2 else "de") for i in range(60)]
    rows += [(60, "", "en"), (61, None, None), (62, " \n\t", "en"), (63, prose(3, 12), "fr"), (64, "one", "en"), (65, prose(2, 9) * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit("extra")).withColumn("_rid", F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(0, 60, 2)] + [(2, 1), (62, 1), (None, 1)], "doc_id long, quality int")
    good = {i for i in range(0, 60, 2) if i % 9} | {62}
    trusted = [t for i, t, _ in rows if i in good and not in_fold(t)]
    want = brute_quality(trusted, [t or "" for _, t, _ in rows])
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for (i, text, _), x in zip(rows, want, strict=True):
        assert (got[i].perplexity is None and x is None) or math.isclose(got[i].perplexity, x, rel_tol=1e-9)
        assert got[i].n_words == len((text or "").split())
    held = [(lang, x) for (i, t, lang), x in zip(rows, want, strict=True) if i in good and in_fold(t) and x is not None]
    assert len(held) > 2 and sum(r.held_out for r in got.values()) >= len(held)
    for (i, _, lang), x in zip(rows, want, strict=True):
        most = max((y for k, y in held if k == lang), default=max(y for _, y in held))
        assert math.isclose(got[i].threshold, most, rel_tol=1e-9) and got[i].kept == (x is not None and got[i].perplexity <= got[i].threshold)
    assert all(r.kept == bool(r.perplexity) for r in score_quality(docs, labels.limit(0)).collect())
    assert score_quality(docs.limit(0), labels).collect() == []


def test_quality_sees_word_order(spark):
    texts = [prose(k, 40) for k in range(40)]
    shuffled = [" ".join(random.Random(k).sample(t.split(), len(t.split()))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + shuffled)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(docs, labels, quantile=1.0).collect()}
    assert all(got[i].kept for i in range(40)) and sum(got[i].held_out for i in range(40)) > 2
    assert all(got[i + 40].perplexity > 2 * got[i].perplexity for i in range(40) if not got[i].held_out)


def test_ngram_keys_are_sparks(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    got = rows.select("a", "b", F.xxhash64("a").alias("one"), F.xxhash64("a", "b").alias("two")).toPandas()
    a, b = (got[c].to_numpy().view(np.uint64) for c in "ab")
    assert (chained(a).view(np.int64) == got.one).all() and (chained(b, chained(a)).view(np.int64) == got.two).all()


def test_quality_leaves_no_shuffle_and_one_table(spark):
    def held():
        shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [shuffles.apply(i).getName() for i in range(shuffles.size())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    docs = spark.createDataFrame([(i, prose(i, 12), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    before = held()
    with run_scratch(spark) as path:
        score_quality(docs, labels)
        assert [n.split("-")[0] for n in os.listdir(path.removeprefix("file:"))] == ["perplexity"]
    for _ in range(50):
        if len(held() - before) <= 8:
            break
        time.sleep(0.1)
    assert len(held() - before) <= 8  # the thresholds' own; before, those of every join


def test_parts_hold_every_ngram():
    texts = [prose(k, 30) for k in range(20)] + ["", "one", "a a a a a a"]
    table, places, size = coded(texts)
    doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
    train = np.arange(len(size)) % 2 == 0
    want, seen = Counter(), Counter()
    for i, t in enumerate(texts):
        w = [0, 0, *(xxhash.xxh3_64_intdigest(x) for x in t.split()), 1] if t else []
        for k in (1, 2, 3):
            for j in range(k == 1, len(w) - k + 1):
                key = np.uint64(42)
                for x in w[j : j + k]:
                    key = chained(np.array([x], np.uint64), key)
                want[i, int(key[0])] += 1
        if train[i]:
            seen.update(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    got, pairs = Counter(), Counter()
    for part in range(4):
        once = Counter()
        for d, k, n in zip(*grams(table, places, doc, part, 4), strict=True):
            once[int(d), int(k)] += int(n)
        got |= once  # a pair whose words are of two parts is in both
        for a, b, c, n in zip(*triples(table, places, doc, train, part, 4), strict=True):
            assert int(b) % 4 == part
            pairs[int(a), int(b), int(c)] += int(n)
    assert got == want and pairs == seen


def test_texts_meet_labels_in_parts(spark, monkeypatch):
    """Before, one join moved every text at once."""
    class Stop(Exception):
        pass

    def stop(texts):
        raise Stop(texts.select(F.sum("n_texts")).first()[0])

    docs = spark.createDataFrame([(i if i % 50 else None, prose(i, 5), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 3)], "doc_id long, quality int")
    seen, coded_rows = [], quality._coded
    monkeypatch.setattr(quality, "_coded", lambda rows: seen.append((rows.count(), rows.where("_train").count())) or coded_rows(rows))
    monkeypatch.setattr(quality, "log_sums", stop)
    with pytest.raises(Stop, match="400"):
        score_quality(docs, labels)
    good = sum(1 for i in range(0, 400, 3) if i % 50 and not in_fold(prose(i, 5)))
    assert sum(n for n, _ in seen) == 400 and max(n for n, _ in seen) < 200 and sum(n for _, n in seen) == good


def test_coded_texts_are_packed(spark):
    """Before, hashes and places were kept as they are, and zstd had to do."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 50_000}" for _ in range(400)) for _ in range(200)] + ["", "one"]
    table, places, size = coded(texts)
    plain = sum(len(pa.compress(x.tobytes(), "zstd", asbytes=True)) for x in (table, places))
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "_rid long, _text string, _train boolean").coalesce(1)
    found = quality._coded(rows).toArrow()
    assert found.num_rows == 1 and sum(len(found[c][0].as_py()) for c in ("words", "places")) < 0.9 * plain
    (_, train, own_table, own_places, doc), = quality._chunks(found.to_batches())
    assert (own_table[own_places] == table[places]).all() and (np.bincount(doc, minlength=len(texts)) == size).all()
    assert train.tolist() == [i % 2 == 0 for i in range(len(texts))]


def test_blocks_hold_every_key():
    key = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64))
    some, sizes, (blocks,) = quality._blocks(quality._bucket(key, 7), [key])
    assert some.tolist() == list(range(7)) and sizes.sum() == 5000
    assert (quality._column(pa.table({"size": sizes, "x": blocks}), "x", np.uint64) == key).all()
    none = quality._blocks(quality._bucket(key[:0], 7), [key[:0]])
    assert len(none[0]) == 0 and quality._column(pa.table({"size": none[1], "x": none[2][0]}), "x", np.uint64).tolist() == []


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    start, nice, single, near, safe, packed = ({r.doc_id: r for r in d.collect()} for d in seen)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    order = sorted(start)
    scores, _ = toxicity.score_batch(model, [start[i].text or "" for i in order])
    assert set(nice) == {i for i, s in zip(order, scores, strict=True) if s < 0.5}
    kept = {k[0] for k in brute_exact([(i, nice[i].text) for i in nice]) if k[3]}
    assert set(single) == kept
    ids = sorted(single)
    prints = [brute_fingerprint(single[i].text or "") for i in ids]
    linked = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert set(near) == set(brute_components(ids, linked))
    assert set(safe) == set(near) and all(d.columns == docs.columns for d in seen[:-1])
    assert all(safe[i].n_chars == len(safe[i].text) for i in safe)
    assert {r.doc_id for r in packed.values()} == set(safe)
    assert corpus_pipeline.run(spark, SF).count() == seen[-1].count()


@pytest.mark.parametrize("key", ["op1_token_counts", "op2_sharding", "op3_embedding_near_dedup", "op5_pii", "op8_quality", "op9_packing", "op10_sentencepiece"])
def test_registered_query_covers_its_table(spark, key):
    out = queries.QUERIES[key](spark, SF)
    name, col = ("embeddings", "vec_id") if key.startswith("op3") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(col).collect()}
    assert {r[0] for r in out.select(col).collect()} == ids


def test_toxic_spans_of_words_that_lower_case_lengthens():
    model = {"words": {"vilefool": 9.0}, "other": -9.0, "trans": [0.0] * 4, "doc": [1.0, 0.0, 0.0, 0.0]}
    text = "\u0130stanbul vilefool \u0130"
    assert toxicity.words(text) == ["i\u0307stanbul", "vilefool", "i\u0307"] and toxicity.words(" ") == []
    _, spans = toxicity.score_batch(model, [text, ""])
    assert [[text[s["start"] : s["end"]] for s in own] for own in spans] == [["vilefool"], []]


ODD_COLUMNS = {"_rid": 7, "_fp": "own", "_text": "mail a.b@c.de", "_base": 1.5, "_spans": "s", "score": 9.5, "toxic_spans": "t", "_id": 3, "c0": "zero", "_cell": 1, "kept": "k", "component_id": 5}


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like the operators' own, in front and behind."""
    rows = [(i, prose(i, 40) + (" mail m.x@secret.org" if i % 3 == 0 else "")) for i in range(40)] + [(100 + i, prose(1, 40)) for i in range(3)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = [F.lit(v).alias(k) for k, v in ODD_COLUMNS.items()]
    return docs.select(*odd[:4], "doc_id", *odd[4:], "text").withColumn("_rid", F.col("doc_id") * 2 + 1)


def assert_own_values(out, docs, changed=()):
    assert out.columns == docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in out.collect():
        for c in docs.columns:
            assert c in changed or r[c] == before[r["doc_id"]][c], c


def test_clashing_names_keep_their_values(spark, clashing):
    from tripmart.llm import pii

    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(clashing, labels)
    scored = toxicity.score(clashing, model)
    assert scored.columns == [c for c in clashing.columns if c not in ("score", "toxic_spans")] + ["score", "toxic_spans"]
    assert_own_values(scored.select(*clashing.columns), clashing, ("score", "toxic_spans"))
    assert scored.where("score BETWEEN 0 AND 1").count() == 44
    single = exact_dedup.drop_exact(clashing)
    assert_own_values(single, clashing)
    assert single.count() == 41
    near = simhash.drop_near(clashing)
    assert_own_values(near, clashing)
    assert near.count() <= 41
    safe = pii.sanitize(clashing)
    assert_own_values(safe, clashing, ("text",))
    assert safe.where("text LIKE '%@%'").count() == 0 and safe.where("text LIKE '%[EMAIL]%'").count() == 14


def test_pipeline_stages_keep_clashing_columns(spark, clashing, tmp_path):
    import corpus_pipeline

    docs = clashing.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stage(spark, docs, str(tmp_path)), docs
        assert_own_values(docs, before, ("text", "n_chars") if name == "pii" else ())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
