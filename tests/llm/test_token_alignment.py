"""Token alignment against a plain version that uses the libraries' own encoders, on odd texts and real ones."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docloom.llm import token_alignment

from ..conftest import SF

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "  two  spaces ", "a\n b\t c", "line\nline\n\n", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ mark", "É é İ ſ 日本 🙂", "\x00 \x7f", "x" * 3000, "the " * 400, "don't we'll  I'm", " lead", "trail ", "ﬁ ½ Å", " nbsp 　wide", "a▁b"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(A))
    t.encode_special_tokens = True
    chars = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    letters = {chr(c): c for c in chars} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in chars)}
    return t, letters, sentencepiece.SentencePieceProcessor(model_file=P.path(B))


def plain(text, libraries):
    t, letters, m = libraries
    if not text:
        return [], []
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def expected(rows, libraries):
    half, count = [], Counter()
    for doc, text in rows:
        a, b = plain(text, libraries)
        spans = []
        for side in (a, b):
            at, s = 0, []
            for i, x in side:
                s.append((at, at + len(x), i))
                at += len(x)
            spans.append(s)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        at, groups = 0, []
        for e in ends:
            groups.append("|".join(",".join(str(i) for _, f, i in s if at < f <= e) for s in spans))
            at = e
        last = [{e: i for _, e, i in s} for s in spans]
        links = [(last[0][e], last[1][e]) for e in ends]
        count.update(links)
        shared = sum(p < f and q < e for p, e, _ in spans[0] for q, f, _ in spans[1]) if len(spans[0]) < 2000 else None
        half.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", shared))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(d, na, nb, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), h) for d, na, nb, g, ls, h, _ in half], {(d, s) for d, _, _, _, _, _, s in half if s is not None}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, rows, libraries, **options):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, pairs string, row int").repartition(3)
    got = token_alignment.align_tokens(docs, **options).cache()
    want, shared = expected(rows, libraries)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(want, key=str)
    assert shared <= {(r.doc_id, r.n_overlaps) for r in got.select("doc_id", "n_overlaps").collect()}


def test_odd_texts(spark, libraries):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, ODD[12]), (40, ODD[11])]
    check(spark, rows, libraries)
    check(spark, rows, libraries, broadcast_rows=0)


def test_documents(spark, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, [r for r in rows if len(r[1] or "") < 6000], libraries)


def test_random_texts(spark, libraries):
    r = random.Random(4)
    check(spark, [(k, "".join(r.choice("ab é日 \n\t'1▂.") for _ in range(r.randint(1, 60)))) for k in range(150)], libraries)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    assert token_alignment.align_tokens(docs).count() == 0
