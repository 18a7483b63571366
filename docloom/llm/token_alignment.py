"""Alignment of two tokenizers' tokens over the same bytes, and which token pairs go together over the whole corpus.

Both tokenizers cut the text (with a space before it, which the second adds itself) into byte ranges. In batches of
documents, ``pandas.merge_asof``, keyed by document, finds for each token's start the other side's token that covers it;
both directions together are all overlaps. Overlaps that end together are links, and their ends cut the tokens into groups.
How often each pair of ids is linked is counted over all documents and joined back to each document's links.

Nulls, empty texts and texts whose tokens do not give back their bytes (such as texts with the space mark itself) have no
tokens: counts of 0 and an empty ``groups_sha256``. Repeated rows each give a row and count each time. An empty table gives
no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .common import utf8, written

SPACE = "▁"
#: Bytes of text whose tokens are one pandas frame; a longer text is a frame of its own.
FRAME_BYTES = 1 << 20
#: Words that a worker keeps with their ids.
MAX_WORDS = 200_000
#: Pairs of ids that are joined by broadcast (about 64 MB); more are joined by key, with salts for pairs that are everywhere.
MAX_BROADCAST = 1_000_000
SALTS = 32
COUNTS = ("n_a", "n_b", "n_overlaps", "n_groups", "n_links")


class ByteSide:
    """Ids of " " + text by a byte-level BPE vocabulary, special strings as plain text."""

    def __init__(self, name: str):
        self.encoder = packing.Encoder(name)
        model = self.encoder.model
        self.bytes = [model.decode_single_token_bytes(i) for i in range(len(self.encoder.leads))]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoder.model.encode_ordinary(" " + text), dtype=np.int64)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it, in one go."""
        learnt = self.encoder.learn(words)
        return [learnt[w] for w in words]

    def gives_back(self, ids: np.ndarray, whole: bytes) -> bool:
        """Tokens are stretches of the text in order, none twice: they give it back if they are as long."""
        return int(self.sizes[ids].sum()) == len(whole)


class PieceSide:
    """Ids of a text by a sentencepiece model that puts a space before it."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        # no piece crosses from a word into the next: words can be encoded one by one
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in plain)
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.leads = np.array([p.startswith(SPACE) for p in pieces])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it, in one go: a piece with the space mark begins a word (a word with the mark itself raises)."""
        ids = np.array(self.model.encode(" ".join(words)), dtype="<u4")
        data, at = ids.tobytes(), [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
        return [data[p:q] for _, p, q in zip(words, at[:-1], at[1:], strict=True)]

    def gives_back(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the pieces are the text's bytes (the model may write other characters than the text has)."""
        return int(self.sizes[ids].sum()) == len(whole) and b"".join(map(self.bytes.__getitem__, ids.tolist())) == whole


class Sides:
    """Both tokenizers, with the ids of words between single spaces kept for both."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split(" ")
        ids = list(map(self.known.get, words)) if self.b.by_word else [None]
        if not all(ids):
            missing = list({w for w, x in zip(words, ids) if x is None})
            if not self.b.by_word or any(not w or w[-1].isspace() for w in missing):  # white space before the next space
                return self.a.whole(text), self.b.whole(text)
            new = dict(zip(missing, zip(self.a.words(missing), self.b.words(missing))))
            ids = [x or new[w] for w, x in zip(words, ids)]
            if len(self.known) + len(new) > MAX_WORDS:
                self.known.clear()
            self.known.update((w, x) for w, x in new.items() if len(w) <= 32)
        left, right = zip(*ids)
        return np.frombuffer(b"".join(left), dtype="<u4").astype(np.int64), np.frombuffer(b"".join(right), dtype="<u4").astype(np.int64)


@lru_cache(maxsize=1)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def tokens(data: bytes | None, both: Sides) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' ids; none where either side's tokens do not give back the bytes."""
    none = np.zeros(0, dtype=np.int64)
    if not data:
        return none, none
    try:
        x, y = both.encode(data.decode("utf-8", "surrogatepass"))
    except (UnicodeError, ValueError):
        return none, none
    whole = b" " + data
    return (x, y) if both.a.gives_back(x, whole) and both.b.gives_back(y, whole) else (none, none)


def _frame(ids: list[np.ndarray], sizes: np.ndarray, name: str) -> pd.DataFrame:
    """doc, id, start, end of many documents' tokens; starts go on from document to document, so that they are in order."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    end = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "start": end - sizes[flat], f"{name}_id": flat, f"{name}_end": end, f"{name}_at": np.arange(len(flat))})


def overlaps(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> pd.DataFrame:
    """doc, a_id, a_end, a_at, b_id, b_end, b_at of all token pairs that share bytes."""
    a, b = _frame(a_ids, a_sizes, "a"), _frame(b_ids, b_sizes, "b")
    covered_a = pd.merge_asof(a, b.assign(b_start=b["start"]), on="start", by="doc")
    covered_b = pd.merge_asof(b, a.assign(a_start=a["start"]), on="start", by="doc")
    both = [covered_a.drop(columns="b_start"), covered_b[covered_b["a_start"] < covered_b["start"]].drop(columns="a_start")]  # equal starts are in the first
    return pd.concat(both, ignore_index=True)


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a: ByteSide, b: PieceSide) -> list[tuple]:
    """n_a, n_b, n_overlaps, n_groups, n_links, groups as text, pairs, times of each document.

    No token is empty, so that exactly one token of each side ends where a group ends: groups are as many as links.
    """
    o = overlaps(a_ids, b_ids, a.sizes, b.sizes)
    n_overlaps = np.bincount(o["doc"].to_numpy(), minlength=len(a_ids))
    links = o[(o["a_end"] == o["b_end"]).to_numpy()]
    order = np.argsort(links["a_at"].to_numpy(), kind="stable")
    a_last, b_last, of_doc, x, y = (links[c].to_numpy()[order] for c in ("a_at", "b_at", "doc", "a_id", "b_id"))
    pair = x * len(b.bytes) + y
    cut = np.searchsorted(of_doc, np.arange(len(a_ids) + 1))
    a_base, b_base = (np.concatenate([[0], np.cumsum([len(v) for v in ids])]) for ids in (a_ids, b_ids))
    # all groups of all documents as one sequence of printed ids: a group's tokens of A, then those of B
    a_flat, b_flat = (np.concatenate([*ids, np.zeros(0, dtype=np.int64)]) for ids in (a_ids, b_ids))
    a_group, b_group = np.searchsorted(a_last, np.arange(len(a_flat))), np.searchsorted(b_last, np.arange(len(b_flat)))
    place_a = np.arange(len(a_flat)) + np.concatenate([[0], b_last + 1])[a_group]
    place_b = np.arange(len(b_flat)) + (a_last + 1)[b_group]
    a_flat[a_last] += len(a.bytes)
    b_flat[b_last] += len(b.bytes)
    printed = np.empty(len(a_flat) + len(b_flat), dtype=np.int64)
    printed[place_a], printed[place_b] = a_flat, b_flat + 2 * len(a.bytes)
    texts, out = print_table(len(a.bytes), len(b.bytes)), []
    for k in range(len(a_ids)):
        lo, hi = cut[k], cut[k + 1]
        groups = "".join(map(texts.__getitem__, printed[a_base[k] + b_base[k] : a_base[k + 1] + b_base[k + 1]].tolist()))[:-1]
        pairs, times = np.unique(pair[lo:hi], return_counts=True)
        out.append((len(a_ids[k]), len(b_ids[k]), int(n_overlaps[k]), int(hi - lo), int(hi - lo), groups, pairs, times))
    return out


@lru_cache(maxsize=2)
def print_table(n_a: int, n_b: int) -> list[str]:
    """Every id with what follows it: ids of A inside and at the end of their part of a group, then those of B."""
    return [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]


_KINDS = {"doc_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
_DDL = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, the counts, groups_sha256, and the document's linked pairs (a_id * size of b + b_id) with how often each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a, b)
        for batch in batches:
            held, ids, size = [], ([], []), 0
            for k, (doc, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
                data = text.as_py()
                x, y = tokens(data, both)
                held.append(doc.as_py())
                ids[0].append(x)
                ids[1].append(y)
                size += len(data or b"")
                if size >= FRAME_BYTES or k == batch.num_rows - 1:
                    rows = [(d, *r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[0] else "", r[6], r[7]) for d, r in zip(held, align(*ids, both.a, both.b))]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _KINDS.values())], list(_KINDS))
                    held, ids, size = [], ([], []), 0

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, _DDL)


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", broadcast_rows: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_overlaps, n_groups, n_links, n_best, count_sum, groups_sha256 of documents (doc_id, text).

    n_best: links whose pair is the corpus-wide most frequent of its id of side b, ties included; count_sum: the sum of the
    corpus-wide counts of the document's links.
    """
    rows = written(aligned(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    size = _size_of(b)
    long = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times"))
    counts = written(long.groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    top = counts.groupBy((F.col("pair") % size).alias("b_id")).agg(F.max("n").alias("most"))
    known = counts.join(top, F.col("pair") % size == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if counts.count() <= broadcast_rows:
        met = long.join(F.broadcast(known), "pair")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = long.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, "row", "left").select("doc_id", *COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


@lru_cache(maxsize=4)
def _size_of(b: str) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b)).vocab_size()
