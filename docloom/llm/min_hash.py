"""Links between texts of alike word shingles: candidates by banded minimum hashes, verification by exact Jaccard similarity.

A text has ``ROWS * BANDS`` minima of its ``WIDTH``-word shingles' hashes. ``links`` compares the texts of one band key
with the key's least and greatest text, fewer than 2 n pairs for n texts; ``rest`` compares all others of a key that are
not in one component by then, so that within a key no link between components is lost. Each pair is compared whole. Two
texts of similarity 0.8 share some key with a probability of 0.9996.

Texts without words have no shingles, no keys and no links; repeated texts count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, cut_lineage, utf8

WIDTH = 5
SIMILARITY = 0.8
MAX_WORDS = 50_000
#: Texts under comparison that are broadcast by name; more are joined.
MAX_BROADCAST = 1_000_000

ROWS, BANDS = 5, 20
#: A key or text with more than this share of all rows is dealt with apart: there are at most as many as its inverse.
HOT = 0.005
SALTS = 32
#: Texts of a key that ``rest`` compares with as many others in one group.
BLOCK = 128
_random = np.random.default_rng(20)
_ADD = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def shingles_of(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes in ascending order; a shingle's hash is made of its words' hashes."""
    words = text.translate(LOWER_TABLE).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of hashes as signed integers."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; shingles are taken in stretches, so that a long text needs no more memory than a short one."""
    if not len(shingles):
        return shingles
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        mixed = (shingles[None, k : k + 4096] ^ _ADD[:, None]) * _TIMES[:, None]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys


def keys(text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def make(texts: pa.Array) -> pa.Array:
        return _lists([band_keys(shingles_of(t.as_py())) for t in texts])

    return make(utf8(text))


def shingles(text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def make(texts: pa.Array) -> pa.Array:
        return _lists([shingles_of(t.as_py()) for t in texts])

    return make(utf8(text))


def _apart(df: DataFrame, column: str) -> DataFrame:
    """The few values of a column that more than the share HOT of the rows have."""
    n = df.groupBy(column).agg(F.count("*").alias("__n"))
    return n.join(F.broadcast(n.agg(F.sum("__n").alias("__all"))), F.col("__n") > F.col("__all") * HOT).select(column)


def candidates(texts: DataFrame) -> DataFrame:
    """a, b: distinct pairs of texts (key, bands) that a band brings together."""
    filed = cut_lineage(texts.select("key", F.explode("bands").alias("band")))
    ends = cut_lineage(filed.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi"))
    hot = F.broadcast(_apart(filed, "band"))
    met = filed.join(F.broadcast(ends.join(hot, "band", "left_semi")), "band").unionByName(filed.join(hot, "band", "left_anti").join(ends.join(hot, "band", "left_anti"), "band"))
    pairs = met.select("key", F.explode(F.array("lo", "hi")).alias("end")).filter("key <> end")
    return pairs.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()


def _sets(asked: DataFrame, whole: DataFrame) -> DataFrame:
    """key, fp, s: the shingles of texts (key, doc_id, fp)."""
    small = asked.count() <= MAX_BROADCAST
    found = whole.join(F.broadcast(asked) if small else asked, ["key", "doc_id"])
    return cut_lineage(found.select("key", "fp", shingles(F.col("text")).alias("s")).dropDuplicates(["key"]))


def _alike(similarity: float) -> Column:
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return shared >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - shared)


def links(texts: DataFrame, whole: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: fingerprints of texts (key, doc_id, fp, bands; one row a text) that are alike. whole: doc_id, key, text."""
    pairs = cut_lineage(candidates(texts))
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "doc_id", "fp"), "key"))
    sets = _sets(asked, whole)
    # a text that is in very many pairs is copied, so that no task has all of them
    hot = cut_lineage(_apart(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key").withColumn("hot", F.lit(True)))
    spread = lambda side, other: F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int").alias(f"salt_{side}")
    copies = sets.join(F.broadcast(hot), "key", "left").select("key", "fp", "s", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    p = pairs.join(F.broadcast(hot.withColumnRenamed("key", "a")), "a", "left").select("a", "b", spread("a", "b"))
    p = p.join(F.broadcast(hot.withColumnRenamed("key", "b")), "b", "left").select("a", "b", "salt_a", spread("b", "a"))
    side = lambda n: copies.select(F.col("key").alias(n), F.col("salt").alias(f"salt_{n}"), F.col("fp").alias(f"fp_{n}"), F.col("s").alias(f"s_{n}"))
    j = p.join(side("a"), ["a", "salt_a"]).join(side("b"), ["b", "salt_b"]).filter("fp_a <> fp_b")
    return j.filter(_alike(similarity)).select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))


def rest(texts: DataFrame, whole: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: roots of alike texts that share a band key and have different roots (fp, root; without a row: fp itself).

    All such pairs of a key are compared, each under the first key that both share. A key's texts are dealt into blocks of
    about BLOCK and every two blocks meet in a group of their own, so that no task has a crowded key: such keys cost the
    product of their components' sizes, in bounded groups.
    """
    named = texts.join(roots.select("fp", "root").hint("merge"), "fp", "left").select("key", "doc_id", "fp", "bands", F.coalesce("root", "fp").alias("root"))
    filed = cut_lineage(named.select("key", "root", F.posexplode("bands").alias("k", "band")))
    mixed = filed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = cut_lineage(filed.join(mixed.hint("merge"), "band"))
    asked = cut_lineage(met.select("key").distinct().join(texts.select("key", "doc_id", "fp", "bands"), "key"))
    sets = _sets(asked.drop("bands"), whole).join(asked.select("key", "bands").hint("merge"), "key").drop("fp")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "root", "k", "band", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets.hint("merge"), "key")
    side = lambda n: dealt.select("band", "k", "i", "j", *[F.col(c).alias(f"{c}_{n}") for c in ("key", "root", "own", "bands", "s")])
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True)) == F.col("k") + 1
    near = (F.col("own_a") != F.col("own_b")) | (F.col("i") == F.col("j"))
    size = (F.size("s_a") >= F.lit(similarity) * F.size("s_b")) & (F.size("s_b") >= F.lit(similarity) * F.size("s_a"))
    j = side("a").join(side("b").hint("merge"), ["band", "k", "i", "j"]).filter(F.col("key_a") < F.col("key_b")).filter((F.col("root_a") != F.col("root_b")) & near & size & first)
    return j.filter(_alike(similarity)).select(F.col("root_a").alias("u"), F.col("root_b").alias("v")).distinct()
