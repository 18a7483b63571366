"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming links, components.

Fingerprints within ``distance`` = 2 bits of each other agree in at least two of four 16-bit blocks, so each distinct
fingerprint is filed under its six pairs of blocks and only fingerprints of one block pair are compared. Copies share
a fingerprint and enter once. A block pair that holds more than ``max_block`` distinct fingerprints is not joined with
itself: the pigeonhole is carried to its end there, one-bit blocks. Two fingerprints within 2 bits have a common
neighbour within one bit of each, so every member is filed under itself and its 64 one-bit neighbours, and the members
under one such key (65 at most) are linked to the least of them. That keeps the components exact at linear cost.

Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part in linking but
never name a component (component_id is the least non-null doc_id, null if there is none).
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import min_hash
from .common import LOWER_TABLE, cut_lineage, utf8
from .components import components

SHINGLE = 3
SEED = 42
BLOCK_BITS = 16
MAX_BLOCK = 64


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(LOWER_TABLE).split() if text else []
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[n - 1 :])), "<u8", len(words) - n + 1)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def simhash(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed bigint (the same 64 bits)."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint_of(t.as_py(), shingle, seed) for t in texts], dtype=np.uint64)
        return pa.array(out.view(np.int64), pa.int64())

    return prints(utf8(text))


def near_links(prints: DataFrame, distance: int = 2, max_block: int = MAX_BLOCK) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that have the same components as all links."""
    if distance != 2:
        raise ValueError("blocks are laid out for distance 2")
    mask = (1 << BLOCK_BITS) - 1
    keys = []
    for k, (i, j) in enumerate(combinations(range(64 // BLOCK_BITS), 2)):
        part = [F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND(F.lit(mask)) for b in (i, j)]
        keys.append((F.lit(k) * F.lit(1 << 32) + part[0] * F.lit(1 << BLOCK_BITS) + part[1]).cast("bigint"))
    filed = cut_lineage(prints.select("fp", F.explode(F.array(*keys)).alias("block")))
    sizes = filed.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    small = sizes.filter(F.col("n") <= max_block).select("block")
    large = sizes.filter(F.col("n") > max_block).select("block")
    cold = filed.join(small, "block", "left_semi")
    pairs = cold.alias("a").join(cold.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.fp") < F.col("b.fp")))
    near = pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    hot = filed.join(large, "block", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    starred = around.withColumn("least", F.min("fp").over(Window.partitionBy("near")))
    return near.union(starred.filter(F.col("fp") != F.col("least")).select(F.col("least").alias("u"), F.col("fp").alias("v")))


def fingerprint_components(prints: DataFrame, max_block: int = MAX_BLOCK, more: DataFrame | None = None) -> DataFrame:
    """fp -> root (a fingerprint) for the fingerprints that have links, near ones or those of ``more`` (u, v); the others are alone."""
    found = near_links(prints, max_block=max_block)
    return components(found if more is None else found.union(more)).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, fp (bigint), fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Repeated rows repeat; columns other than doc_id and text are left out. The component rounds end after
    log-many steps; ``components`` raises beyond 60, which no table of less than 2**60 links can need.
    """
    rows = cut_lineage(docs.select("doc_id", simhash(F.col("text")).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_components(prints.select("fp"), max_block)
    rooted = prints.join(links, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_block: int = MAX_BLOCK, similarity: float | None = None) -> DataFrame:
    """``docs`` (same columns) with one row per component: its least doc_id (of equal ids and texts, one row).

    Texts are linked at two bits of their fingerprints and, where ``similarity`` is given, at that Jaccard similarity of
    their five-word shingles. Rows with a null doc_id cannot be named and stay. Columns may have any name. Only names of
    rows that go are joined with the texts: broadcast up to a million of them, counted first.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d"), "doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__key"))
    known = whole.filter(F.col("doc_id").isNotNull())
    if similarity is None:
        rows, more = cut_lineage(known.select("doc_id", "__key", simhash(F.col("text")).alias("fp"))), None
    else:
        rows = cut_lineage(known.select("doc_id", "__key", simhash(F.col("text")).alias("fp"), min_hash.keys(F.col("text")).alias("bands")))
        texts = rows.groupBy(F.col("__key").alias("key")).agg(F.min(F.struct("doc_id", "fp", "bands")).alias("t")).select("key", "t.*")
        more = min_hash.links(texts, known.select("doc_id", F.col("__key").alias("key"), "text"), similarity)
    prints = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "__key")).alias("least"))
    roots = fingerprint_components(prints.select("fp"), max_block, more)
    if similarity is not None:
        # texts of a key that are in different components by now are compared with each other, which joins components
        left = cut_lineage(min_hash.rest(texts, known.select("doc_id", F.col("__key").alias("key"), "text"), roots, similarity))
        if not left.isEmpty():
            top = components(left).select(F.col("node").alias("__node"), F.col("root").alias("__top"))
            every = prints.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
            roots = every.join(top, every["root"] == top["__node"], "left").select("fp", F.coalesce("__top", "root").alias("root"))
    named = prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    kept = named.groupBy("root").agg(F.min("least").alias("kept"))
    kept_of = named.join(kept, "root").select("fp", "kept")
    names = rows.groupBy("doc_id", "__key", "fp").agg(F.count("*").alias("__n"))
    names = names.join(kept_of, "fp").withColumn("__goes", F.struct("doc_id", "__key") != F.col("kept"))
    marked = cut_lineage(names.filter(F.col("__goes") | (F.col("__n") > 1)).select("doc_id", "__key", "__goes"))
    small = marked.count() <= min_hash.MAX_BROADCAST
    out = whole.join(F.broadcast(marked) if small else marked, ["doc_id", "__key"], "left").filter(~F.coalesce("__goes", F.lit(False)))
    one = out.filter(F.col("__goes").isNull())
    repeated = out.filter(F.col("__goes").isNotNull())  # rows that stay and repeat
    order = Window.partitionBy("doc_id", "__key").orderBy(F.lit(1))
    first = repeated.withColumn("__k", F.row_number().over(order)).filter("__k = 1")
    return one.select("__d").union(first.select("__d")).select("__d.*")
