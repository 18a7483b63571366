"""The corpus operators against brute force, exact round trips and held-out rows, with nulls, empties, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import decontamination, html_text, license_scan, packing, queries, simhash, token_counts, topk, toxicity, url_filter, warc

from ..conftest import SF, same_as_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\t", "word", "a b", "É é İ ſ", "x" * 5000, "same text here", "same text here", "\x00 \x7f", "▁▁ <s> 日本"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "score") for k, t in enumerate(texts)], "doc_id bigint, text string, score string")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    same_as_sql(queries.QUERIES[name](spark, SF), duck, queries.SQL[name])


def test_empty_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    p = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert token_counts.count_tokens(d).count() == 0
    assert license_scan.scan_licenses(d).count() == 0
    assert decontamination.contamination_report(d, items).count() == 0
    assert simhash.near_duplicates(d).count() == 0
    assert simhash.drop_near_duplicates(d).count() == 0
    assert packing.pack_documents(d).count() == 0
    assert url_filter.filter_urls(p).count() == 0
    assert topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet").limit(0), F.lit(True)).count() == 0
    assert html_text.extract_text(p).count() == 0
    assert warc.archive_round_trip(p).count() == 0
    assert toxicity.score_toxicity(d, labels).count() == 0
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert toxicity.score_toxicity(whole, labels).filter("predicted = 1").count() == 0
    assert decontamination.contamination_report(whole, items.limit(0)).filter("contaminated").count() == 0


# 1


def test_token_counts_are_the_librarys(spark, documents):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SF).collect()}
    want = {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in documents.items()}
    assert got == want
    got = [r.n_tokens for r in token_counts.count_tokens(docs_of(spark, ODD)).orderBy("doc_id").collect()]
    assert got == [len(model.encode(t or "")) for t in ODD]


def test_chunks_compose(documents):
    import public_tokenizers

    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    for t in [*list(documents.values())[:20], "a" * 300, " " * 100 + "b", "no▁spaces" * 30]:
        assert len({c.count(t, size) for size in (3, 50, 10**6)}) == 1


def test_chunk_maps_need_no_neighbour(documents):
    import public_tokenizers

    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    machine, blank = c.machine, c.machine.blank
    text = " " + next(t for t in documents.values() if t and len(t) > 400)[:400] + "   x▁▁y  " + "zq" * 40
    maps = token_counts.chunks(text, machine, 23)
    # a map alone, from every state that other texts can leave it in, equals a plain run
    for k, m in enumerate(maps):
        for entry in ("", " the", " ab", "9"):
            state = machine.run(blank, entry)[0]
            spaces = k and text[23 * k - 1] in " ▁"
            if not spaces:
                assert m(state) == machine.run(state, text[23 * k : 23 * k + 23])
    want = machine.run(blank, text)
    r = np.random.default_rng(0)
    for _ in range(20):  # any bracketing
        left = list(maps)
        while len(left) > 1:
            k = int(r.integers(len(left) - 1))
            left[k : k + 2] = [token_counts.compose(left[k], left[k + 1])]
        assert left[0](blank) == want
    assert token_counts.scan(maps)(blank) == want


# 2


def base_places(text):
    w = words(text)
    out = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), out


def test_license_base(spark, documents):
    extra = ["MIT License mit license", "gnu general public license gnu general public", "cc by cc-by CC BY.", None, "mit  -- LICENSE", "general public license", "apache license" * 3]
    rows = {**documents, **{-1 - k: t for k, t in enumerate(extra)}}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    for r in license_scan.scan_licenses(df).collect():
        n, places = base_places(rows[r.doc_id])
        starts = [k for k, _ in places]
        labels = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_matching_statistics_are_longest():
    s = license_scan.Scanner(templates=license_scan.NOTICES)
    sequences = [license_scan.words_of(p.encode()) for p, _ in (*license_scan.BASE, *license_scan.NOTICES)]
    parts = {tuple(q[a:b]) for q in sequences for a in range(len(q)) for b in range(a + 1, len(q) + 1)}
    text = [w for q in sequences[4:7] for w in (*q[2:6], b"zz", *q)]
    v = n = 0
    for i, w in enumerate(text):
        while v and w not in s.auto.next[v]:
            v = s.auto.link[v]
            n = s.auto.length[v]
        v = s.auto.next[v].get(w, 0)
        n = n + 1 if v else 0
        assert n == max((k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in parts), default=0)


def test_license_template_with_gap():
    text = b"Permission is hereby granted, free of charge, to any person obtaining a copy of THIS BRANCH of this software and associated documentation files, to deal in the software without restriction"
    assert "mit-text" in license_scan.Scanner().scan(text)["labels"]


def brute_chains(text, template, min_match, max_gap):
    """The most template words that any chain of maximal matches covers, by trying every chain."""
    matches = []
    for end in range(1, len(text) + 1):
        longest = lambda e: max((n for n in range(e + 1) if any(template[p : p + n] == text[e - n : e] for p in range(len(template) - n + 1))), default=0)
        n = longest(end)
        if n >= min_match and (end == len(text) or longest(end + 1) <= n):
            matches += [(end, n, p + n) for p in range(len(template) - n + 1) if template[p : p + n] == text[end - n : end]]
    best = 0

    def extend(last, covered):
        nonlocal best
        best = max(best, covered)
        for end, n, stop in matches:
            if end > last[0] and stop > last[2] and end - n - last[0] <= max_gap:
                extend((end, n, stop), covered + min(n, stop - last[2], end - last[0]))

    for m in matches:
        extend(m, m[1])
    return best


def test_chains_against_every_chain():
    r = np.random.default_rng(11)
    for _ in range(150):
        template = [b"w%d" % k for k in r.integers(0, 5, 14)]
        text = [b"w%d" % k for k in r.integers(0, 6, 6)]
        for _ in range(3):
            a = int(r.integers(0, 10))
            text += template[a : a + int(r.integers(2, 7))] + [b"q"] * int(r.integers(0, 3))
        s = license_scan.Scanner((), ((b" ".join(template).decode(), "t"),), min_match=2, min_cover=0.01, max_gap=2)
        spans = s.scan(b" ".join(text))["spans"]
        want = brute_chains(text, template, 2, 2)
        assert max((x["cover"] for x in spans), default=0) == pytest.approx(min(1, want / 14))
        for x, y in zip(spans, spans[1:]):
            assert x["end"] <= y["start"]


def test_whole_licences_are_found():
    s = license_scan.Scanner()
    texts = dict((label, text) for text, label in license_scan.default_templates())
    for label in ("mit-text", "apache-2.0-text", "gpl-3-text", "mpl-2.0-text", "bsd-3-clause-text", "isc-text"):
        w = texts[label].split()
        changed = " ".join(["Copyright 2024 Somebody.", *w[: len(w) // 2], "our own few words", *w[len(w) // 2 : -5]])
        found = s.scan(("x y z " * 50 + changed + " and a tail").encode())
        assert label in found["labels"].split(",") and any(x["label"] == label and x["cover"] > 0.9 for x in found["spans"])
    assert s.scan(b"the terms of this and the use of the work without any licence at all")["labels"] == ""


# 3


def brute_contamination(texts, items, width=10):
    bank = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            bank[tuple(w[k : k + n])].add(str(i))
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in bank}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in bank:
                    hit |= set(range(k, k + n))
                    found |= bank[tuple(w[k : k + n])]
        yield len(w), len(hit), sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item"), (10, "one two three four five six seven eight nine ten zzz"), (11, None), (12, "...")]
TEXTS = ["x one two three four five six seven eight nine ten eleven y", "a SHORT item; short item", "one two three four five six seven eight nine", None, "", "short one", "short item one two three four five six seven eight nine ten"]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.contamination_report(docs_of(spark, TEXTS), items, max_bytes=limit).orderBy("doc_id").collect()
    want = list(brute_contamination(TEXTS, ITEMS))
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == want
    assert [r.items_sha256 for r in got] == [hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in want]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontaminate(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    d = docs_of(spark, TEXTS).withColumn("items", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted(r.doc_id for r in decontamination.decontaminate(d, items, max_bytes=limit).collect()) == [2, 3, 4, 5]
    assert [r.doc_id for r in decontamination.decontaminate(d, items).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(d, items, remove="spans", max_hit_share=0.95).collect()}
    assert cut == {0: "x  y", 1: "a ", 2: TEXTS[2], 3: None, 4: "", 5: "short one"}


def test_contamination_of_rows_that_share_id_and_text(spark):
    items = spark.createDataFrame([*ITEMS, (None, "short thing here")], "item_id bigint, text string")
    texts = [t for t in TEXTS for _ in range(2)] + ["a short thing here", "Short thing HERE"]
    d = spark.createDataFrame([(7, t, k, None) for k, t in enumerate(texts)], "doc_id bigint, text string, __row int, __scan string")
    whole = decontamination.contamination_report(d, items)
    joined = decontamination.contamination_report(d, items, max_bytes=0)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, whole.collect())) == sorted(map(key, joined.collect())) and joined.count() == len(texts)
    for limit in (10**6, 0):
        kept = decontamination.decontaminate(d, items, max_bytes=limit)
        assert kept.columns == d.columns and sorted(r["__row"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9, 10, 11]


# 4


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, documents):
    rows = {**documents, **{10_000 + k: t for k, t in enumerate(ODD)}}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    prints = {i: brute_fingerprint(t) for i, t in rows.items()}
    roots = brute_components(prints)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", roots[i]) for i in rows}
    assert len(got) == len(rows)
    kept = simhash.drop_near_duplicates(df.union(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


@pytest.mark.parametrize("max_block", [1, 2, 64])
def test_near_links_at_any_block_size(spark, max_block):
    r = np.random.default_rng(3)
    prints = set()
    for c in r.integers(0, 2**63, 6):
        x = int(c)
        for _ in range(25):  # a chain: each a bit or two from some earlier one
            prints.add(x)
            x ^= (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) if r.random() < 0.5 else 1 << int(r.integers(64))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = simhash.fingerprint_components(spark.createDataFrame([(p,) for p in signed], "fp bigint"), max_block).collect()
    name = {p: p for p in signed} | {x.fp: x.root for x in got}
    want = brute_components({p: p & (2**64 - 1) for p in signed})
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(name) == groups(want)


# 5


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [None, "", " a", "a  b", "tab\t \n x ", "a\n \nb", "a\n b\u3000 c", "<|endoftext|> it's", "x <|endoftext|><|endoftext|>y", "word " * 3000]
    rows = {**documents, **{-1 - k: x for k, x in enumerate(extra)}}
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows.items()}
    out = packing.pack_documents(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), group_size=150).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for i, ps in pieces.items():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids[i])
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert all(p.length == 1024 for p in ps[1:])
    assert set(pieces) == set(rows)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 1024 + 2


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 10])
    assert len(packing.local_search([[0], [1], [2], [3], [4], [5], [6]], lengths, 10)) == 4
    bins = packing.local_search([[0, 1], [2, 3], [4]], np.array([5, 3, 4, 3, 5]), 10)  # one for two makes both full
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]


def descending_best_fit(lengths, capacity):
    order = np.argsort(-lengths, kind="stable")
    return packing.best_fit(lengths[order], capacity)


def test_search_reaches_descending_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = np.array([r.length for r in packing.cut_documents(docs, with_ids=False).orderBy("ids_crc32", "doc_id", "piece").collect()])
    r = np.random.default_rng(4)
    for lengths in (real, r.integers(300, 401, 2000), r.integers(1, 1025, 3000), r.integers(400, 1000, 800), np.full(500, 340), np.full(3000, 1)):
        begun = packing.start(lengths, 1024)
        searched = packing.local_search(begun, lengths, 1024)
        bins = packing.pack_lengths(lengths)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < lengths[b].sum() <= 1024 for b in bins)
        assert len(searched) <= len(begun) and len(bins) <= min(len(searched), len(descending_best_fit(lengths, 1024)))
    begun = packing.start(real, 1024)
    assert len(packing.local_search(begun, real, 1024)) < len(begun)
    many = r.integers(300, 401, 2000)  # hundreds of underfull bins, all searched
    assert len(packing.pack_lengths(many)) < 0.95 * len(descending_best_fit(many, 1024))


def test_search_steps_raise_squared_fill():
    r = np.random.default_rng(8)
    lengths = r.integers(1, 60, 120)
    state = packing._Open([[2 * k, 2 * k + 1] for k in range(60)], lengths.tolist(), 128)
    squared = sum(f * f for f in state.fill)
    while any(state.improve(a) for a in sorted(range(60), key=state.fill.__getitem__) if 0 < state.fill[a] < 128):
        now = [sum(n * len(x) for n, x in held.items()) for held in state.bins]
        assert now == state.fill and max(now) <= 128 and sum(f * f for f in now) > squared
        squared = sum(f * f for f in now)


def test_packing_repeats_and_names(spark):
    d = spark.createDataFrame([(1, "a b", 3, "x"), (1, "a b", 3, "x"), (None, "c", 4, "y")], "doc_id bigint, text string, sequence_id int, length string")
    out = packing.pack_documents(d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert sorted((r.doc_id or 0, r.offset, r.length) for r in out.collect())[1:] == sorted((r.doc_id or 0, r.offset, r.length) for r in out.collect())[1:] and out.count() == 3


# 6

URLS = [None, "", "no scheme", "http://", "http://x.org", "http://x.org/", "HTTP://User@X.ORG/a", "http://a.example.org/es/x?q#f", "http://example.org/en/12", "http://org/en", "http://notexample.org/es/", "http://q.com/fr/a", "http://q.com/de", "http://q.com/de/", "http://www.cheap-pills.example.net/", "http://x.net/://y.org/", "ftp://k.com#/fr/"]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, duck, limit):
    p = spark.createDataFrame([(k, u, "v") for k, u in enumerate(URLS)], "page_id bigint, url string, verdict string")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, u) for k, u in enumerate(URLS)])
    same_as_sql(url_filter.filter_urls(p, max_rules=limit), con, queries.OP6_SQL)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules_of_any_form(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "SALT_ROWS", 2)
    rules = [*url_filter.default_rules(), url_filter.Rule(r"^[^/]*\d{3}", "block", 7, "digits", ()), url_filter.Rule(r"(?<=com)/\w*é$", "block", 2_000, "look-behind", ("com",))]
    urls = ["http://a.com/é", "http://a.com/fr/é", "http://x123.net/", "http://x123.com/fr/", "http://b.com/x", None, *[f"http://b{k}.com/fr/" for k in range(9)], "http://b.com/x"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(p, rules, max_rules=limit).orderBy("page_id").collect()]
    fr = ("com/fr/", "allow")
    assert got == [("look-behind", "block"), fr, ("digits", "block"), fr, (None, "allow"), (None, "allow"), *[fr] * 9, (None, "allow")]


# 7


def test_top_k_with_odd_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=8).round(1)], 0) for k in range(120)]
    rows += [(200, None, 0), (201, [None] + [1.0] * 7, 0), (202, [float("nan")] * 8, 0), (203, [float("inf")] * 8, 0), (204, [1.0, 2.0], 0), (250, [1.0, -2.0], 0), (None, [1.0] * 8, 0), (7, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=32, query_block=2).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    q = lambda v: [int(np.floor(256 * float(np.float32(c)))) for c in v]
    good = [(i, q(v)) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = {}
    for i, v in good:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:5]
            want[i] = [(k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert {k: [x[2] for x in v] for k, v in got.items()} == {k: [x[2] for x in v] for k, v in want.items() if v}
    assert got == {k: v for k, v in want.items() if v}


def best_by_product(items, ids, query, own, k=5):
    scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, query)), int(i)) for v, i in zip(items.tolist(), ids) if i != own)[:k]
    return [(i, -s) for s, i in scores]


def test_top_k_of_rows_that_repeat(spark):
    """A third of all rows are one row: each of its copies is a candidate, none of itself, and they lie in several blocks."""
    rows = [(7, [0.5, 0.25])] * 60 + [(k, [k / 64, -k / 128]) for k in range(100, 220)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=16).collect()
    score = lambda a, b: sum(int(np.floor(256 * np.float64(x))) * int(np.floor(256 * np.float64(y))) for x, y in zip(a, b))
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-score(v, w), i) for i, w in rows if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == best


def test_runs_of_spaces_of_any_length():
    import public_tokenizers
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    model, machine = sentencepiece.SentencePieceProcessor(model_file=file), token_counts.Transducer(token_counts.Pieces(file))
    for n in (*range(60, 70), 95, 96, 97, 200, 333):
        text = "a" + " " * n + "b"
        assert machine.run(machine.blank, "▁" + text.replace(" ", "▁"))[1] == len(model.encode(text)), n


def test_nra_stops_early_and_is_exact():
    r = np.random.default_rng(1)
    items = np.vstack([r.integers(-20, 20, (3000, 16)), r.integers(90, 100, (8, 16))]).astype(float)
    ids = np.arange(3008)
    at, found, score, share = topk.nra(items[-1:], np.array([3007]), items, ids, 5)
    assert list(zip(found, score)) == best_by_product(items, ids, items[-1], 3007) and share < 0.5
    plain = r.normal(size=(4000, 64))
    plain = topk.quantise(plain / np.linalg.norm(plain, axis=1)[:, None])
    ids = np.arange(4000)
    at, found, score, share = topk.nra(plain[:20], ids[:20], plain, ids, 5)
    assert share < 0.9  # even where all directions are alike
    for q in range(20):
        assert [(i, s) for a, i, s in zip(at, found, score) if a == q] == best_by_product(plain, ids, plain[q], q)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e37, 1e306])
def test_top_k_of_large_components(spark, size):
    r = np.random.default_rng(6)
    x = (r.normal(size=(150, 6)) * size).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    q = np.array([[int(np.floor(256 * c)) if size < 1e300 else 256 * int(c) for c in v] for v in x], dtype=object)
    got = defaultdict(list)
    for row in topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=60).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    bound = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == {i: [(j, bound(s)) for j, s in best_by_product(q, range(150), q[i], i)] for i in (0, 50, 100)}


# 8


def test_blocks():
    page = "<html><head><title>T &amp; t</title><script>if (a < b) '</p>'</script></head><body><nav><li>n1<li>n2</nav><article><h1>H&#233;</h1><p>a <b>b</b>\n c<br>d<p>e &lt;x&gt; <!-- no --> f<ul><li>i<li>j</ul></article><div class=ad>z</div></body>"
    assert [(b.text, b.path[-1][0]) for b in html_text.blocks_of(page)] == [("T & t", "title"), ("n1", "li"), ("n2", "li"), ("Hé", "h1"), ("a b c d", "p"), ("e <x> f", "p"), ("i", "li"), ("j", "li"), ("z", "div")]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of('<p>x <a href="') [0].text == "x"


def test_gradients():
    r = np.random.default_rng(0)
    m = html_text.Labeller(1)
    pages = [([[1, 2], [3], [4, 5]], [[7], [8, 9], [1]], r.random((3, html_text.SCALARS)).astype(np.float32), np.array([1, 0, 1], np.float32)), ([[2]], [[3]], r.random((1, html_text.SCALARS)).astype(np.float32), np.array([0], np.float32))]

    def loss(model):
        total = n = 0
        for path, word, s, y in pages:
            z = model.logits(model.inputs(path, word, s)[None], np.ones((1, len(y)), np.float32))[0]
            total += float(np.sum(np.logaddexp(0, z) - y * z))
            n += len(y)
        return total / n

    before = loss(m)
    m.fit(pages, epochs=60, batch=2)
    assert loss(m) < 0.2 * before


def test_html_text_against_markup(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op8_html_text(spark, SF).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    right = 0
    for p in rows:
        want = "\n".join(b.text for b in html_text.blocks_of(p.html) if html_text.declared_label(b.path))
        right += got[p.page_id].text == want
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert right >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y")], "page_id bigint, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(odd).collect()] == [("", 0), ("", 0)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<script src='x.js' />var leaked = 1;</script>b", ["ab"]),
        ("<p>a</p><style media=x />p{}</STYLE ><p>b</p>", ["a", "b"]),
        ("<p>a<svg viewBox='0'/>b<textarea / >t</textarea><scripted>c", ["ab", "c"]),
        ("<p>a</p><script>never closed <p>b</p>", ["a"]),
        ("<p>1 &lt; 2 &amp;amp; &#x41;&nbsp;&eacute;</p>\n\t<p> \n </p><p>x\n\n y", ["1 < 2 &amp; A é", "x y"]),
        ("no markup at all", ["no markup at all"]),
        ("<p>" + "long " * 200_000 + "</p>", [("long " * 200_000).strip()]),
    ],
)
def test_blocks_of_odd_pages(page, want):
    assert [b.text for b in html_text.blocks_of(page)] == want


NAMED = (
    '<html><head><title>Site</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a href=a>One<li><a href=b>Two</ul></nav>'
    '<div class="cookie-notice">We use cookies. Please accept.</div><article><h1>On bread</h1><p>Bread needs time, water, salt and flour.</p>'
    '<div class="ad">Buy our new oven today.</div><script src=x />track();</script><p>Most of all, it needs patience, and a warm room.</p></article>'
    '<section class="comments"><h2>Comments</h2><p>Nice text, thank you.</p></section><aside>Other texts</aside><footer>Copyright 2024</footer></body></html>',
    "On bread\nBread needs time, water, salt and flour.\nMost of all, it needs patience, and a warm room.",
)
PLAIN = (
    '<html><head><title>T</title></head><body><div><div><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></div>'
    "<div><h1>The river in winter</h1><div>The river froze in the first week of January, and people walked across it to the old mill.</div>"
    "<div>By March, the ice had gone, and the boats were back. Nobody spoke of the flood again.</div></div></div></body></html>",
    ["The river froze", "By March"],
    ["Home"],
)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.train(html_text.sample_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_html_text_of_known_articles(spark, labeller):
    cut = NAMED[0][: NAMED[0].index("Most of all") + 12] + "<a hr"
    pages = [NAMED[0], PLAIN[0], cut, NAMED[0].replace("</p>", ""), "", None, "<p>", NAMED[0], NAMED[0] * 40]
    rows = spark.createDataFrame([(k, None, p, "clash") for k, p in enumerate(pages)], "page_id bigint, url string, html string, n_chars string")
    kept = html_text.Labeller.from_bytes(labeller.to_bytes())
    got = {r.page_id: r for r in html_text.extract_text(rows, model=kept).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    assert got[0].text == NAMED[1] == got[7].text
    assert all(x in got[1].text for x in PLAIN[1]) and not any(x in got[1].text for x in PLAIN[2])
    assert got[2].text == NAMED[1][: NAMED[1].index("Most of all") + 12] and "Bread needs" in got[3].text
    assert [got[k].text for k in (4, 5, 6)] == ["", "", ""]
    assert got[8].text.split("\n").count("Bread needs time, water, salt and flour.") >= 38


def test_html_text_without_names(spark, labeller):
    """Pages that the training has not seen, their parts' names hidden; labels are what the hidden names had declared."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id % 50 = 7 and html is not null").collect()]
    r, features, right, total = np.random.default_rng(2), html_text.Features(), 0, 0
    for page in pages:
        blocks = html_text.blocks_of(page)
        want = np.array([html_text.declared_label(b.path) for b in blocks])
        got = labeller.label([html_text.unnamed(blocks, r, "gone")], features)[0] >= 0.5
        right, total = right + int((got == want).sum()), total + len(want)
    assert right >= 0.95 * total


# 9


def test_warc_round_trip(spark, tmp_path):
    long_ = "é" * 600
    rows = [(1, "u1", long_), (5, None, long_), (3, "u\n3", long_), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", long_), (5, None, long_), (9, "x", "y" * 400_000)]
    p = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, refers_to int")
    index = warc.write_archives(p, f"file://{tmp_path}/a", frame_bytes=2000)
    got = warc.read_archives(index, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows) == index.count()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), sha(t), "revisit" if i in (1, 3) else "response", 5 if i in (1, 3) else None) for i, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {t or "" for _, _, t in rows}
    import pyarrow.fs as pafs
    import zstandard

    record_ids = []
    for x in index.collect():
        reader = warc.BundleReader(pafs.LocalFileSystem().open_input_file(x.path))
        headers, block = reader.record(x.frame, x.offset)
        assert headers.get("x-page-id") == (None if x.page_id is None else str(x.page_id))
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["warc-date"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert headers["content-type"] == "application/http; msgtype=response" and headers["warc-target-uri"]
        assert (headers["warc-type"] == "revisit") == ("warc-refers-to-target-uri" in headers)
        record_ids.append(headers["warc-record-id"])
    assert len(set(record_ids)) == len(rows)
    path = index.filter("page_id = 9").first().path
    with open(path, "rb") as f:  # any Zstandard reader can read a bundle through
        assert b"y" * 400_000 in zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    joined = warc.with_roles(p, max_groups=0).select("page_id", "refers_to").collect()
    assert Counter(joined) == Counter(warc.with_roles(p).select("page_id", "refers_to").collect())


def test_warc_damage_is_seen(spark, tmp_path):
    p = spark.createDataFrame([(k, "u", f"page {k}") for k in range(3)], "page_id bigint, url string, html string")
    index = warc.write_archives(p.coalesce(1), f"file://{tmp_path}/b", date="2024-01-31T12:00:00Z")
    assert warc.read_archives(index, f"file://{tmp_path}/b").count() == 3
    moved = index.withColumn("page_id", F.col("page_id") + 1)
    with pytest.raises(Exception, match="not where the index says"):
        warc.read_archives(moved, f"file://{tmp_path}/b").count()


# 10


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, big).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_noisy_or_finds_the_sentence():
    r = np.random.default_rng(2)
    sentence = lambda: " ".join(f"w{k}" for k in r.integers(0, 40, 8))
    rows = [((". ".join([sentence() for _ in range(6)] + ["you vile toad"] * (k % 2))).encode(), k % 2) for k in range(120)]
    m = toxicity.train(rows)
    clean, _ = m.score(sentence().encode())
    score, found = m.score(b"w1 w2 w3. you VILE toad. w4 w5")
    assert clean < 0.3 < score and [(f["start"], f["end"]) for f in found] == [(9, 23)]
    assert m.score(None) == (0.0, []) and m.score(b"...") == (0.0, [])


def test_toxicity_of_long_clean_texts(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    m = toxicity.train(toxicity.training_rows(docs, labels))
    rows = [(r.text.encode(), r.toxic) for r in docs.join(labels, "doc_id").filter("text is not null").orderBy("doc_id").collect()]
    clean = [t for t, k in rows if k == 0 and m.score(t)[0] < 0.3]
    worst = max((t for t, k in rows if k == 1), key=lambda t: m.score(t)[0])
    offending = max(m.score(worst)[1], key=lambda s: s["score"])
    offending = worst[offending["start"] : offending["end"]].strip()
    for n in (100, len(clean)):
        joined = b"\n".join(clean[:n])
        assert len(joined) > 100_000 and m.score(joined)[0] < 0.3
        score, found = m.score(joined + b"\n" + offending + b"\n")
        assert score >= 0.3 and any(f["start"] == len(joined) + 1 for f in found)


LONG = "The words of a very long text, over and over. " * 25_000 + "MIT License"
CLASH = "doc_id bigint, text string, score string, labels string, fp int, fingerprint string, piece int, length int, n_words string, __text int, __t int, __key int, __d int, held_out int"


@pytest.fixture(scope="module")
def odd_rows(spark):
    texts = [None, "", "released under the MIT License, it says here", LONG, "released under the MIT License, it says here", ITEMS[0][1]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(2, texts[2]), (3, LONG), (None, texts[2])]
    return spark.createDataFrame([(i, t, *["x" if " string" in c else 7 for c in CLASH.split(", ")[2:]]) for i, t in rows], CLASH)


def same_for_same(rows, columns):
    """Rows of the same document agree in the columns."""
    seen = defaultdict(set)
    for r in rows:
        seen[r.doc_id].add(tuple(r[c] for c in columns))
    assert all(len(v) == 1 for v in seen.values())
    return {i: dict(zip(columns, next(iter(v)))) for i, v in seen.items()}


def test_odd_rows_through_every_document_operator(spark, odd_rows):
    n = odd_rows.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")

    counted = token_counts.count_tokens(odd_rows).collect()
    got = same_for_same(counted, ["n_bytes", "n_tokens", "over_limit"])
    assert len(counted) == n and got[0] == got[1] == {"n_bytes": 0, "n_tokens": 0, "over_limit": False} and got[3]["n_bytes"] == len(LONG)

    scanned = license_scan.scan_licenses(odd_rows).collect()
    got = same_for_same(scanned, ["n_words", "n_base", "first_word", "last_word", "base_labels", "score"])
    assert len(scanned) == n and got[0] == got[1] == {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "score": 0.0}
    assert got[2]["n_base"] == 1 and got[3] == {"n_words": 250_002, "n_base": 1, "first_word": 250_000, "last_word": 250_000, "base_labels": "mit", "score": 1.0}

    for limit in (10**6, 0):
        found = decontamination.contamination_report(odd_rows, items, max_bytes=limit).collect()
        got = same_for_same(found, ["n_words", "n_hit", "n_items"])
        assert len(found) == n and got[5] == {"n_words": 11, "n_hit": 11, "n_items": 2} and got[3]["n_words"] == 250_002 and got[0]["n_words"] == 0

    near = simhash.near_duplicates(odd_rows)
    got = same_for_same(near.collect(), ["fingerprint", "component_id"])
    assert near.columns == ["doc_id", "fp", "fingerprint", "component_id"] and near.count() == n
    assert got[0]["component_id"] == got[1]["component_id"] == 0 and got[4]["component_id"] == got[None]["component_id"] == 2

    packed = packing.pack_documents(odd_rows, with_ids=False).collect()
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r.length)
    assert pieces[0] == pieces[1] == [1] and len(pieces[2]) == 2 and len(pieces[3]) % 2 == 0 and len(pieces[3]) > 400

    scored = toxicity.score_toxicity(odd_rows, labels).collect()
    got = same_for_same(scored, ["score", "predicted"])
    assert len(scored) == n and got[0] == got[1] == {"score": 0.0, "predicted": 0} and got[3]["predicted"] == 0
    assert not any(r.held_out for r in scored if r.doc_id is None)


def test_odd_rows_through_every_page_operator(spark):
    long_ = "<article><p>" + LONG + "</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "http://x.org/" + "a/" * 200_000, long_), (3, "http://x.org/" + "a/" * 200_000, long_), (None, "http://a.com/fr/", "<p>x"), (5, "http://a.com/fr/", long_)]
    p = spark.createDataFrame([(*r, "host", 7, "text", b"p") for r in rows], "page_id bigint, url string, html string, host string, rule int, n_chars string, payload binary")
    judged = url_filter.filter_urls(p).collect()
    assert len(judged) == 6 and Counter(r.rule for r in judged) == {None: 2, "org/": 2, "com/fr/": 2}
    assert len([r for r in judged if r.page_id == 3 and len(r.path) == 400_001]) == 2
    text = html_text.extract_text(p, model=html_text.Labeller()).collect()
    assert len(text) == 6 and sum(r.text == "" for r in text) >= 2 and all(len(r.text) == r.n_chars for r in text)
    kept = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(p).collect())
    assert kept == {(1, "response", None): 1, (2, "response", None): 1, (3, "revisit", 5): 2, (None, "response", None): 1, (5, "response", None): 1}


def test_long_texts(spark):
    text = "the words of a very long text. " * 60_000
    d = docs_of(spark, [text])
    assert license_scan.scan_licenses(d).first().n_words == 420_000
    assert token_counts.count_tokens(d).first().over_limit
    assert packing.pack_documents(d, with_ids=False).count() > 400
