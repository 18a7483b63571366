"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and word beginnings; a
document's score is the noisy-or of its sentences, one minus the product of their complements. Weights are trained from
document labels alone through that noisy-or, and then tell which sentences offend.

Summed over a long text, the little that each clean sentence scores would pass any threshold. So sentences under
``THRESHOLD`` count only by what their log-complements sum to beyond the sum that as many sentences of the sample's clean
documents reach (mean and ``CHANCE`` standard errors); the others count whole, and the most toxic one always does.

Training reads a bounded sample (``SAMPLE`` labelled documents a class, of at most ``SAMPLE_BYTES`` each, chosen by a
hash of doc_id) in one task; scoring reads every word of every document. Null and empty texts have no sentences and score 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, hash_sample, utf8

SAMPLE = 2_000
SAMPLE_BYTES = 65_536
DIM = 1 << 20
#: Standard errors that a bucket's log-odds must keep above zero to be used; rarer buckets would be learnt by heart.
SURE = 2.0
THRESHOLD = 0.3
#: Standard errors beyond the mean of clean sentences that weak sentences must sum to before they count.
CHANCE = 4.0
#: The log-complement, negated, of a sentence at the threshold.
WEAK = -np.log1p(-THRESHOLD)
PREFIXES = (4, 6)
#: Words whose weight a worker keeps.
MAX_WORDS = 100_000
_SENTENCE = re.compile(rb"[^.!?\n]+")


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its beginnings."""
    return [zlib.crc32(word) % DIM] + [zlib.crc32(b"%d:" % n + word[:n]) % DIM for n in PREFIXES if len(word) >= n]


def each_sentence(text: bytes | None) -> Iterator[tuple[int, int, set[bytes]]]:
    """(start byte, end byte, distinct words) of each sentence that has words; one that repeats counts where it stands first."""
    seen = set()
    for m in _SENTENCE.finditer(text or b""):
        sentence = m.group()
        if sentence not in seen:
            seen.add(sentence)
            words = set(sentence.translate(WORD_TABLE).split())
            if words:
                yield m.start(), m.end(), words


def sentences_of(text: bytes | None) -> list[tuple[int, int, set[bytes]]]:
    return list(each_sentence(text))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, mean: float = 0.0, spread: float = 0.0):
        """``mean`` and ``spread`` (standard deviation): of the log-complements of clean documents' weak sentences."""
        self.weights, self.bias, self.mean, self.spread = weights.astype(np.float32, copy=False), float(bias), float(mean), float(spread)
        self.words: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "mean": self.mean, "spread": self.spread, "words": {}}

    def word(self, w: bytes) -> float:
        x = self.words.get(w)
        if x is None:
            x = float(sum(self.weights[k] for k in features(w)))
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[w] = x
        return x

    def score(self, text: bytes | None, locate: bool = True) -> tuple[float, list[dict]]:
        """The document's score and, with ``locate``, its offending sentences; a long text's words are not held at once."""
        word, bias = self.word, self.bias
        places, z = [], []
        for start, end, words in each_sentence(text):
            z.append(bias + sum(map(word, words)))
            places.append((start, end))
        if not z:
            return 0.0, []
        z = np.array(z)
        found = [{"start": places[k][0], "end": places[k][1], "score": float(1 / (1 + np.exp(-z[k])))} for k in np.flatnonzero(z >= 0)] if locate else []
        mass = np.logaddexp(0, z)
        weak = mass[mass < WEAK]
        beyond = weak.sum() - len(weak) * self.mean - CHANCE * self.spread * len(weak) ** 0.5
        return float(-np.expm1(-max(mass.max(), mass[mass >= WEAK].sum() + max(0.0, beyond)))), found


def sure_evidence(documents: np.ndarray, clean: float, toxic: float, sure: float = SURE) -> np.ndarray:
    """The lower bound of each bucket's log-odds of standing in toxic against clean documents (counts: clean, toxic)."""
    c, t = documents[0] + 0.5, documents[1] + 0.5
    return np.log(t / (toxic + 1)) - np.log(c / (clean + 1)) - sure * np.sqrt(1 / c + 1 / t)


def used_buckets(documents: np.ndarray, clean: float, toxic: float, stretch: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose sure evidence is positive, and that evidence; read in stretches, so that no table of all is made."""
    places, values = [], []
    for k in range(0, documents.shape[1], stretch):
        evidence = sure_evidence(documents[:, k : k + stretch], clean, toxic)
        at = np.flatnonzero(evidence > 0)
        places.append(at + k)
        values.append(evidence[at])
    return np.concatenate(places), np.concatenate(values)


def train(rows: list[tuple[bytes | None, int]], steps: int = 200, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Adam on the noisy-or likelihood; clean documents weigh three times as much as toxic ones together.

    Texts are read twice: for the documents that each bucket is in, then for the buckets in use. Others have no weight,
    so they are not held.
    """
    if not rows:
        return Model(np.zeros(DIM), -20.0)
    documents = np.zeros((2, DIM), np.int32)
    y = []
    for text, label in rows:
        words = set().union(*(w for _, _, w in each_sentence(text)))
        if words:
            documents[label, list({k for w in words for k in features(w)})] += 1
            y.append(label)
    if not y or len(set(y)) < 2:
        return Model(np.zeros(DIM), 20.0 if y and y[0] else -20.0)
    y = np.array(y, np.float64)
    used, scale = used_buckets(documents, len(y) - y.sum(), y.sum())
    del documents
    place = np.full(DIM, -1, np.int32)
    place[used] = np.arange(len(used))
    known: dict[bytes, tuple[int, ...]] = {}
    flat, sentence_sizes, bags = array("i"), array("i"), []
    for text, _ in rows:
        n = 0
        for _, _, words in each_sentence(text):
            before = len(flat)
            for w in sorted(words):
                f = known.get(w)
                if f is None:
                    if len(known) >= MAX_WORDS:
                        known.clear()
                    f = known[w] = tuple(int(k) for k in place[features(w)] if k >= 0)
                flat.extend(f)
            sentence_sizes.append(len(flat) - before)
            n += 1
        if n:
            bags.append(n)
    known.clear()
    flat, bags = np.array(flat, np.int64), np.array(bags)
    sentence = np.repeat(np.arange(len(sentence_sizes)), np.array(sentence_sizes))  # of each place in flat
    n, bag_starts = len(sentence_sizes), np.cumsum(bags) - bags
    share = y.mean()
    weight = np.repeat(np.where(y == 1, 0.25 / share, 0.75 / (1 - share)) / len(y), bags)
    w, b = np.ones(len(used)), -9.0  # weights in units of the bucket's evidence
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(sentence, (w * scale)[flat], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = -np.expm1(-np.add.reduceat(np.logaddexp(0, z), bag_starts))
        whole = np.repeat(np.clip(whole, 1e-9, 1), bags)
        dz = weight * p * (whole - np.repeat(y, bags)) / whole
        g = np.bincount(flat, dz[sentence], len(w)) * scale + decay * w
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[used] = w * scale
    mass = np.logaddexp(0, np.bincount(sentence, (w * scale)[flat], n) + b)[np.repeat(y == 0, bags)]
    weak = mass[mass < WEAK]
    return Model(weights, b, *((weak.mean(), weak.std()) if len(weak) else ()))


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """__o, doc_id, __toxic, __text of the sample: ids first (bounded), then their texts in one pass over the documents."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 2))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumn("__o", F.xxhash64("doc_id"))
    sizes = {r["__toxic"]: r["count"] for r in named.groupBy("__toxic").count().collect()}
    parts = [hash_sample(named.filter(F.col("__toxic") == k), "__o", sizes.get(k, 0), per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])
    fit = docs.select("doc_id", utf8("text").alias("__text")).filter(F.octet_length("__text") <= max_bytes)
    # of an id's rows the least text counts, so that every run sees the same sample
    return fit.join(F.broadcast(chosen), "doc_id").groupBy("__o", "doc_id", "__toxic").agg(F.min("__text").alias("__text"))


def training_rows(docs: DataFrame, labels: DataFrame, **sample) -> list[tuple[bytes, int]]:
    """The sample on the driver, in order."""
    rows = training_sample(docs, labels, **sample).collect()
    return [(bytes(r["__text"]), int(r["__toxic"])) for r in sorted(rows, key=lambda r: (r["__o"], r["doc_id"]))]


def _train_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = train([(t.as_py(), int(k.as_py())) for b in batches for t, k in zip(b.column("__text"), b.column("__toxic"))])
    at = np.flatnonzero(model.weights).astype("<i4")
    one = [[at.tobytes()], [model.weights[at].astype("<f4").tobytes()], [model.bias], [model.mean], [model.spread]]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, (pa.binary(), pa.binary(), *[pa.float64()] * 3))], names=["at", "weights", "bias", "mean", "spread"])


def trained(docs: DataFrame, labels: DataFrame, **sample) -> Model:
    """The model of the sample, trained in one task: its texts do not pass through the driver, which gets weights only."""
    rows = training_sample(docs, labels, **sample).select("__o", "doc_id", "__toxic", "__text")
    rows = rows.repartition(1).sortWithinPartitions("__o", "doc_id").select("__toxic", "__text")
    found = rows.mapInArrow(_train_in_task, "at binary, weights binary, bias double, mean double, spread double").collect()
    if not found:
        return train([])
    r, weights = found[0], np.zeros(DIM, np.float32)
    weights[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["weights"], "<f4")
    return Model(weights, r["bias"], r["mean"], r["spread"])


RESULT = "struct<score:double,sentences:array<struct<start:bigint,end:bigint,score:double>>>"
_TYPE = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def toxicity(text: Column, model) -> Column:
    """Struct of the document's score and its offending sentences (byte ranges); ``model`` is a broadcast Model."""

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        m = model.value
        return pa.array([dict(zip(("score", "sentences"), m.score(t.as_py()))) for t in texts], _TYPE)

    return score(utf8(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences: one row per row of ``docs``.

    Null and empty texts score 0. Repeated rows repeat; null ids are not held out; an id's labels count as toxic if any
    is; columns other than doc_id and text are left out, whatever their names. Without labels of both classes nothing
    (or, with toxic ones only, every text with words) is toxic.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **sample))
    rows = docs.select("doc_id", toxicity(F.col("text"), model).alias("__t"))
    return rows.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        F.col("__t.score").alias("score"),
        (F.col("__t.score") >= threshold).cast("int").alias("predicted"),
        F.col("__t.sentences").alias("sentences"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """``docs`` (same columns, of any name) without the rows that score at or above the threshold; null texts stay."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **sample))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.value.score(t.as_py(), locate=False)[0] for t in texts], pa.float64())

    return docs.filter(score(utf8("text")) < threshold)
