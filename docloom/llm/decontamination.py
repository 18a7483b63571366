"""Benchmark decontamination: a hash set of benchmark word windows, scanned over every window of the corpus.

A window is ``width`` consecutive words of an item (the whole item, if shorter). The set maps the window's own text,
so a hit in it is already verified word for word. Up to ``max_broadcast_bytes`` of windows the set travels as a
broadcast variable and the scan is one narrow pass over the corpus; a larger benchmark goes through
``scan_by_join``: only windows that pass a bit map of the benchmark's window hashes leave the scan, and they are joined
by their text.

Null texts have no words. Items without words have no windows. Repeated items count once per item_id; windows of items
with a null id hit, but name no item. Rows of ``docs`` that repeat are each reported.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, words_of

WIDTH = 10
MAX_BROADCAST_BYTES = 64 << 20
#: The join path's bit map has two to this power of places (16 MB).
FILTER_BITS = 27


def windows_of(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    if not words:
        return []
    n = min(width, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def benchmark_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (string id), n (words), window (bytes): the distinct windows of each item."""

    @F.arrow_udf("array<struct<n:int,window:binary>>")
    def windows(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = words_of(t.as_py())
            out.append([{"n": min(width, len(words)), "window": w} for w in dict.fromkeys(windows_of(words, width))])
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("window", pa.binary())])))

    rows = items.select(F.col(id_col).cast("string").alias("item"), utf8(text_col).alias("__text"))
    return rows.select("item", F.explode(windows("__text")).alias("w")).select("item", "w.n", "w.window").distinct()


class Bank:
    """windows by word count: {n: {window: item numbers}}."""

    def __init__(self, rows: list):
        self.items = sorted({r["item"] for r in rows if r["item"] is not None})
        number = {item: k for k, item in enumerate(self.items)}
        self.by_size: dict[int, dict[bytes, list[int]]] = {}
        for r in rows:
            found = self.by_size.setdefault(r["n"], {}).setdefault(bytes(r["window"]), [])
            if r["item"] is not None:
                found.append(number[r["item"]])

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit word spans (end exclusive, merged, in order), ids of items found."""
        words = words_of(text)
        if not words:
            return 0, [], []
        joined = b" ".join(words)
        ends = list(accumulate([len(w) + 1 for w in words]))
        starts = [0, *ends[:-1]]
        hits, items = [], set()
        for n, bank in self.by_size.items():
            here = [joined[a : b - 1] for a, b in zip(starts, ends[n - 1 :])]
            if not bank.keys().isdisjoint(here):
                for i, w in enumerate(here):
                    if w in bank:
                        hits.append((i, i + n))
                        items.update(bank[w])
        spans: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return len(words), spans, sorted(self.items[k] for k in items)


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def bank_of(windows: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES):
    """The broadcast bank, or None where the windows are larger than the bound (checked before anything is collected)."""
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 100), F.lit(0)).alias("b")).first()["b"]
    if size > max_bytes:
        return None
    return windows.sparkSession.sparkContext.broadcast(Bank(windows.collect()))


def scan_column(text: Column, bank) -> Column:
    """Struct of n_words, n_hit, items and hit spans for each whole text."""

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            n, spans, items = bank.value.scan(t.as_py())
            out.append({"n_words": n, "n_hit": sum(b - a for a, b in spans), "items": items, "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(out, _TYPE)

    return scan(utf8(text))


def window_bits(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map of ``2**bits`` places with a bit for each window's hash; its size does not depend on the benchmark's."""

    @F.arrow_udf("bigint")
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_intdigest(t.as_py()) & ((1 << bits) - 1) for t in texts], pa.int64())

    at = windows.select(places("window").alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def scan_by_join(docs: DataFrame, windows: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """``docs`` with the same struct as column ``__scan``, for a benchmark too large to broadcast.

    Results belong to a text, which the SHA-256 of its bytes names: copies are scanned once. Windows that pass the bit map
    are joined with the benchmark's by their text; matched places come back by that name, so only matches are grouped.
    """
    bank = docs.sparkSession.sparkContext.broadcast(window_bits(windows))

    @F.arrow_udf("array<struct<n:int,at:bigint,window:binary>>")
    def places(texts: pa.Array) -> pa.Array:
        out, digest, bits = [], xxhash.xxh3_64_intdigest, bank.value
        mask = 64 * len(bits) - 1
        for t in texts:
            words = words_of(t.as_py())
            found = []
            for n in sizes:
                here = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
                at = np.fromiter((digest(w) & mask for w in here), np.int64, len(here))
                found += [{"n": n, "at": int(i), "window": here[i]} for i in np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int64()), ("window", pa.binary())])))

    names = docs.columns
    text = docs.select(utf8(text_col).alias("__text")).filter(F.octet_length("__text") > 0)
    text = text.groupBy(F.sha2("__text", 256).alias("__row")).agg(F.first("__text").alias("__text"))
    exploded = text.select("__row", F.explode(places("__text")).alias("p")).select("__row", "p.*")
    hits = exploded.join(windows, ["n", "window"]).groupBy("__row").agg(
        F.collect_set(F.struct("at", "n")).alias("__places"), F.array_sort(F.collect_set("item")).alias("__items")
    )

    @F.arrow_udf("array<struct<start:bigint,end:bigint>>")
    def merged(found: pa.Array) -> pa.Array:
        out = []
        for row in found.to_pylist():
            spans: list[list[int]] = []
            for p in sorted(row or [], key=lambda p: (p["at"], p["n"])):
                a, b = p["at"], p["at"] + p["n"]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            out.append([{"start": a, "end": b} for a, b in spans])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    @F.arrow_udf("bigint")
    def n_words(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__d"), utf8(text_col).alias("__text"))
    keyed = keyed.withColumn("__row", F.sha2(F.coalesce("__text", F.lit(b"")), 256))
    out = keyed.join(hits, "__row", "left").withColumn("__spans", merged("__places"))
    scan = F.struct(
        n_words("__text").alias("n_words"),
        F.aggregate("__spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]).alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        F.col("__spans").alias("spans"),
    )
    return out.select(*[F.col("__d").getField(c).alias(c) for c in names], scan.alias("__scan"))


def scan_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BROADCAST_BYTES, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__scan`` (in place of one of that name); every row stays."""
    docs = docs.drop("__scan")
    windows = benchmark_windows(items, width)
    bank = bank_of(windows, max_bytes)
    if bank is not None:
        return docs.withColumn("__scan", scan_column(F.col(text_col), bank))
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``width`` values
    return scan_by_join(docs, windows, text_col, sizes)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", width: int = WIDTH, max_hit_share: float = 0.5, **options) -> DataFrame:
    """``docs`` (same columns) without benchmark text.

    remove="documents": rows with any hit go. remove="spans": hit spans are cut out of the text, and rows in which more
    than ``max_hit_share`` of the words are hit go. Rows without a hit, null texts and null ids included, stay as they
    are, each as often as it stands; other columns may have any name.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d"), "text")
    scanned = scan_contamination(whole, items, width, **options)
    if remove == "documents":
        return scanned.filter(F.col("__scan.n_hit") == 0).select("__d.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, scans: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t.as_py(), s["spans"]) for t, s in zip(texts, scans.to_pylist())], pa.string())

    kept = scanned.filter(F.col("__scan.n_hit") <= max_hit_share * F.col("__scan.n_words"))
    text = F.when(F.col("__scan.n_hit") > 0, cut(utf8("text"), F.col("__scan"))).otherwise(F.col("text"))
    return kept.select(*[text.alias(c) if c == "text" else F.col("__d").getField(c).alias(c) for c in docs.columns])


def cut_spans(text: bytes | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    from .common import WORD_TABLE

    if text is None:
        return None
    flat, at = text.translate(WORD_TABLE), []
    for w in flat.split():
        start = flat.index(w, at[-1][1] if at else 0)
        at.append((start, start + len(w)))
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return (b"".join(out) + text[last:]).decode("utf-8", "replace")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans: one row per row of ``docs``.

    Null and empty texts have no words and no hits; columns other than doc_id and text are left out.
    """
    rows = docs.select("doc_id", "text")
    out = scan_contamination(rows, items, **options)
    return out.select(
        "doc_id",
        F.col("__scan.n_words").alias("n_words"),
        F.col("__scan.n_hit").alias("n_hit"),
        F.size("__scan.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__scan.items"), ","), 256).alias("items_sha256"),
        (F.col("__scan.n_hit") > 0).alias("contaminated"),
        F.col("__scan.items").alias("items"),
        F.col("__scan.spans").alias("spans"),
    )
