"""Fingerprints over randomised lexicons against a plain version in Python, with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from docloom.llm import imatch

P = imatch.PARTS


def terms(text):
    words = {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w}
    return {int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words}


def fingerprint(text, lexicon):
    own = terms(text)
    step = 0
    while P << step <= len(own):
        step += 1
    kept = [t for t in sorted(own & lexicon) if (t // P) % (1 << step) == 0]
    if not kept:
        return "=" + hashlib.md5(text.encode()).hexdigest()
    out = [str(step)]
    for k in range(imatch.STEPS):
        parts = {}
        for t in kept:
            if (t // P) % (1 << step + k) == 0:
                parts.setdefault(t % P, []).append(str(t))
        out.append(",".join(f"{p:02x}" + hashlib.md5(",".join(parts[p]).encode()).hexdigest()[:4] for p in sorted(parts)))
    return ";".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    x, y = a.split(";"), b.split(";")
    at = max(int(x[0]), int(y[0]))
    if at - int(x[0]) > 2 or at - int(y[0]) > 2:
        return 0.0
    p, q = (set(filter(None, z[1 + at - int(z[0])].split(","))) for z in (x, y))
    either = {s[:2] for s in p | q}
    return len(p & q) / len(either) if either else 0.0


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    df = {}
    for _, t in ordered:
        for h in terms(t):
            df[h] = df.get(h, 0) + 1
    lexicon = {h for h, n in df.items() if imatch.RAREST <= n <= max(imatch.RAREST, int(len(rows) * imatch.SHARE))}
    out = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b = fingerprint(t, lexicon), fingerprint(e, lexicon)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, fingerprint(after, lexicon))))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, data):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in data], "doc_id bigint, text string, fingerprint string, row int").repartition(3)


def texts(seed, n, vocabulary):
    r = random.Random(seed)
    return [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 40, 150, 600, 2500]))) for _ in range(n)]


def test_against_plain_version(spark):
    vocabulary = [f"w{k}" for k in range(3000)]
    data = list(enumerate(texts(1, 90, vocabulary)))
    odd = [(500, None), (501, ""), (502, "\x00 \x7f"), (503, "É é İ 日本 x"), (-4, data[5][1]), (601, data[5][1]), (602, data[5][1] + " more")]
    data = [(i * 7, t) for i, t in data] + odd
    assert rows(imatch.fingerprint_documents(made(spark, data))) == sorted(expected(data), key=str)


def test_repeated_rows_and_null_ids(spark):
    t = texts(2, 12, [f"w{k}" for k in range(60)])
    data = [(k % 4 if k % 3 else None, x) for k, x in enumerate(t)] + [(2, t[0])] * 5 + [(None, t[1])] * 2
    got = rows(imatch.fingerprint_documents(made(spark, data)))
    assert got == sorted(expected(data), key=str)


def test_small_tables(spark):
    assert imatch.fingerprint_documents(made(spark, [(1, "a")]).limit(0)).count() == 0
    for data in ([(1, "one two three")], [(1, None)], [(None, "x")], [(1, "a b"), (2, "b c")]):
        assert rows(imatch.fingerprint_documents(made(spark, data))) == sorted(expected(data), key=str)


def test_equal_texts_and_halves(spark):
    base = texts(3, 60, [f"v{k}" for k in range(20000)])
    data = [(k, t) for k, t in enumerate(base * 2)]
    found = imatch.fingerprint_documents(made(spark, data)).withColumn("base", F.col("doc_id") % 60)
    assert found.groupBy("base").agg(F.countDistinct("fingerprint").alias("n")).filter("n > 1").count() == 0
    long = [r for r in found.collect() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
