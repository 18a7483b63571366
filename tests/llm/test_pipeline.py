"""The pipeline against a brute-force version of its stages."""

import re
import tracemalloc
from collections import defaultdict

import corpus_pipeline
import numpy as np
from docloom.llm import min_hash, packing, simhash, toxicity
from pyspark.sql import functions as F

from ..conftest import SF
from .test_llm_operators import LOWER, ODD, brute_components, brute_contamination, brute_fingerprint


def brute_shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(width, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def alike(a, b, least=0.8):
    return bool(a) and len(a & b) >= least * len(a | b)


def brute_groups(rows):
    """doc_id -> least doc_id of its group: two bits of the fingerprints, or 0.8 of the five-word shingles."""
    roots = brute_components({i: brute_fingerprint(t) for i, t in rows.items()})
    sets = {i: brute_shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if roots[i] != roots[j] and 0.8 * len(sets[i]) <= len(sets[j]) <= 1.25 * len(sets[i]) + 1 and alike(sets[i], sets[j]):
                low, high = sorted((roots[i], roots[j]))
                roots = {x: low if r == high else r for x, r in roots.items()}
    return roots


def kept_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = {i: t for i, t in rows.items() if model.score((t or "").encode())[0] < 0.3}
    roots = brute_groups(rows)
    rows = {i: t for i, t in rows.items() if roots[i] == i}
    hits = brute_contamination(rows.values(), items)
    return {i: t for (i, t), (_, n, _) in zip(list(rows.items()), hits) if n == 0}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    want = kept_documents(spark)
    encoder = packing.Encoder("byte_bpe_50k.json")
    pieces, bins = defaultdict(int), defaultdict(list)
    for r in out:
        pieces[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: len(encoder.encode(t)) // 4 + 1 for i, t in want.items()}
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024


def test_filters_keep_columns_and_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (2, "A b c d e f", 2, "y"), (3, None, 3, "z"), (4, "", 4, "z"), (None, "a b c d e f", 5, "n"), (5, "quite another text here", 6, None)],
        "doc_id bigint, text string, score int, component_id string",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.score) for r in kept) == [(0, 5), (1, 1), (3, 3), (5, 6)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def edited(seed, groups, copies):
    """Texts in groups of near copies, around passages that many of them share."""
    r = np.random.default_rng(seed)
    word = lambda: f"w{int(r.integers(400))}"
    passage = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(60)] + (passage if g % 2 else [])
        for _ in range(copies):
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                t[int(r.integers(len(t)))] = word()
            out.append(" ".join(t))
    return [*out, *out[:5], *ODD, " ".join(passage), " ".join(passage[:-1])]


def test_near_duplicates_against_brute_force(spark):
    rows = dict(enumerate(edited(1, 12, 6)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()], "doc_id bigint, text string, fp string, n int").withColumnRenamed("n", "__key")
    out = simhash.drop_near_duplicates(df.union(df), similarity=0.8)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_groups(rows).values()))


def test_links_are_alike_and_nearly_all_found(spark):
    """Every link is one by brute force; nearly every pair of alike texts is joined by links or a common fingerprint."""
    rows = dict(enumerate(edited(2, 30, 9)))
    df = spark.createDataFrame(list(rows.items()), "key bigint, text string")
    texts = df.select("key", F.col("key").alias("doc_id"), F.col("key").alias("fp"), min_hash.keys(F.col("text")).alias("bands"))
    links = {(x.u, x.v) for x in min_hash.links(texts, df.withColumn("doc_id", F.col("key"))).collect()}
    sets = {i: brute_shingles(t) for i, t in rows.items()}
    assert links and all(alike(sets[i], sets[j]) for i, j in links)
    root = {i: i for i in rows}
    for u, v in links:
        low, high = sorted((root[u], root[v]))
        root = {x: low if r == high else r for x, r in root.items()}
    pairs = [(i, j) for i in rows for j in rows if i < j and alike(sets[i], sets[j])]
    assert sum(root[i] == root[j] for i, j in pairs) >= 0.99 * len(pairs)


def test_shingles():
    assert min_hash.shingles_of(None).tolist() == [] == min_hash.shingles_of(b" \n ").tolist()
    assert len(min_hash.shingles_of(b"a b")) == 1 and min_hash.shingles_of(b"A b").tolist() == min_hash.shingles_of(b"a  B").tolist()
    long_ = b"the words of a very long text. " * 60_000
    assert len(min_hash.shingles_of(long_)) == 7


def test_stages_take_odd_rows(spark):
    long_ = "The words of a very long text, over and over. " * 25_000
    rows = [(1, None), (2, ""), (3, long_), (3, long_), (4, long_ + "x"), (None, "free words"), (5, "some other words here")]
    names = ["__d", "__key", "__goes", "__n", "__scan", "__t", "fp", "score"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in names))
    alone = sorted(set(brute_groups({i: t for i, t in rows if i is not None}).values()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r["__t"] == 5 and r.fp == 6 for r in out.collect())
        kept = sorted((r.doc_id or 0) for r in out.collect())
        assert kept == ([0, *alone] if name == "near_duplicates" else [0, 1, 2, 3, 3, 4, 5]), name
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4, 5} and sum(r.length for r in packed if r.doc_id == 3) % 2 == 0


def test_links_of_a_crowded_key_are_all_found(spark, monkeypatch):
    """all texts under one band key, in several blocks; most are unlike the key's least and greatest text."""
    monkeypatch.setattr(min_hash, "keys", lambda text: F.filter(F.array(F.lit(7).cast("bigint")), lambda _: F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\f\v", "")) != ""))
    monkeypatch.setattr(min_hash, "BLOCK", 16)
    rows = dict(enumerate(edited(3, 12, 6)))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    out = simhash.drop_near_duplicates(df, similarity=0.8)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute_groups(rows).values()))


def test_training_is_no_work_of_the_driver(spark, monkeypatch):
    """the sample's texts do not reach the driver, which gets the same model's weights; odd tables give a model too."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    expected = toxicity.train(toxicity.training_rows(docs, labels))

    def refuse(*_, **__):
        raise AssertionError("trained on the driver")

    whole = toxicity.train
    monkeypatch.setattr(toxicity, "training_rows", refuse)
    monkeypatch.setattr(toxicity, "train", lambda rows: refuse() if rows else whole(rows))
    found = toxicity.trained(docs, labels)
    assert (found.weights == expected.weights).all() and found.weights.any()
    assert (found.bias, found.mean, found.spread) == (expected.bias, expected.mean, expected.spread)
    assert toxicity.drop_toxic(docs, labels).count() < docs.count()
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " .!"), (4, "bad words")], "doc_id long, text string")
    assert toxicity.drop_toxic(odd, spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)], "doc_id long, toxic int")).count() == 3


def test_training_holds_used_buckets_only():
    """what training holds beside the texts are the buckets that have a weight, and counts of a fixed size."""
    random = np.random.default_rng(1)
    rows = [(b" ".join(b"word%d" % k for k in random.integers(0, 4000, 250)) + (b". vile slur" if n % 2 else b"."), n % 2) for n in range(400)]
    tracemalloc.start()
    model = toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    assert model.score(b"a vile slur")[0] > 0.9 and model.score(b"word1 word2")[0] < 0.1
