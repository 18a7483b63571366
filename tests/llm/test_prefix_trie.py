"""The trie of conversation prefixes against a plain version, long chains, hot beginnings, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.llm import prefix_trie


def remainder(c, k):
    return c - int(c / k) * k


def expected(rows, every=100, most=6):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        seq = own.get(c - remainder(c, every), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids)
    return sorted(
        ((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()),
        key=str,
    )


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, depth int").repartition(4)


def check(spark, rows, **options):
    got = sorted(map(tuple, prefix_trie.prefix_trie(made(spark, rows), **options).collect()), key=str)
    assert got == expected(rows, **options)


def test_random_conversations(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ccc", "日本"])) for c in r.sample(range(700), 260) for t in range(r.randint(1, 7))]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", ""), (1, 0, None, "user"), (-7, 2, "u", "t"), (-7, 2, "u", "t"), (-107, 1, "u", "t"), (100, 0, "u", "y" * 3000), (150, 9, "u", "z"), (199, 1, "u", "z")]
    check(spark, rows + rows[3:6])
    assert prefix_trie.prefix_trie(made(spark, rows).limit(0)).count() == 0


def test_long_chains_and_blocks(spark):
    """Two conversations of 300 turns that part late, and one that stops early: chains far longer than rounds."""
    rows = [(c, t, "u", f"turn {t}" if t < 260 or c == 1 else f"other {t}") for c in (1, 2) for t in range(300)] + [(3, t, "u", f"turn {t}") for t in range(80)]
    check(spark, rows, every=1)


def test_hot_beginning(spark):
    """Most conversations share their first turn and many are the same: ids beyond one piece, one parent of most nodes."""
    rows = [(c, t, "u", "hello" if t == 0 else f"{c % 900 if c % 3 else 'same'} {t}") for c in range(1500) for t in range(2)]
    check(spark, rows, every=1)


def test_contraction_of_any_forest(spark):
    r = random.Random(9)
    parent = {0: None, 1: None, **{k: r.choice([k - 1, k - 1, k - 1, r.randrange(k)]) for k in range(2, 400)}}
    total = {k: [k, 1] for k in parent}
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            total[parent[k]] = [a + b for a, b in zip(total[parent[k]], total[k])]
    nodes = spark.createDataFrame([(k, p, k, 1) for k, p in parent.items()], "id bigint, parent bigint, a bigint, b bigint")
    got = prefix_trie.subtree_totals(nodes, ["a", "b"])
    assert {x.id: [x.a, x.b] for x in got.collect()} == total
    assert got.select(F.countDistinct("id")).first()[0] == got.count()
