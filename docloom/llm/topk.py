"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A block of candidates keeps one list for each component, sorted by value. A query reads the lists in stretches, each
list from the end that is good for it (high values for positive weights, low ones for negative), and goes on with the
list that leaves most of its score open: the one with the largest gap between frontier and far end. A list is read
first a sixty-fourth part deep and, when its turn comes again, to its end. What has been read counts exactly; an unread component lies between the list's frontier and its far end, and all unread ones of
a candidate together are held by Cauchy and Schwarz: the rest of the query's length times the rest of the candidate's.
That gives each candidate a lower and an upper bound. A query stops when at most ``OPEN`` times k candidates have an
upper bound that reaches the k-th best lower bound: outsiders cannot qualify any more. Those inside are then resolved
to exact integers.

Blocks of candidates meet blocks of queries in grouped tasks of bounded size, and the k best of each block are merged
by query. Vectors that are null, or hold nulls or non-finite components, take no part; only vectors of equal length
are compared. Ties go to the smaller id; rows with a null id take no part. Scores are exact integers whatever the
components; one beyond the range of a bigint is ranked by its true value and given as the nearest bigint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES = 8_192
QUERIES = 1_024
#: A list is read in two stretches: this part of it, then the rest. Bounds are computed after every
#: sixteenth of all stretches.
FIRST = 64
#: Candidates inside, as a multiple of k, that are resolved directly.
OPEN = 32
#: Room for rounding in bounds of scaled components, by component; exact scores need none.
SLACK = 1e-12
BIGINT = 2**63


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: as float64 where that is exact and finite, else as Python integers."""
    if x.size == 0 or float(np.abs(x).max()) < 2.0**900:
        return np.floor(x * 256.0)
    return np.array([[int(v) * 256 if abs(v) > 2.0**900 else int(np.floor(v * 256.0)) for v in row] for row in x.tolist()], dtype=object)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Components as float64 between -1 and 1; scaling keeps the order of scores."""
    if x.dtype == object:
        top = max((abs(v) for v in x.ravel().tolist()), default=0)
        shift = max(0, top.bit_length() - 53)
        x = np.array([[v >> shift for v in row] for row in x.tolist()], dtype=np.float64).reshape(x.shape) if shift else x.astype(np.float64)
    top = float(np.abs(x).max()) if x.size else 0.0
    return x / top if top else x


def _exact(items: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products as Python integers."""
    d = items.shape[1]
    if items.dtype != object and query.dtype != object and items.size and float(np.abs(items).max()) * float(np.abs(query).max()) * d < 2.0**53:
        return (items @ query).astype(np.int64).tolist()
    q = [int(v) for v in query.tolist()]
    return [sum(int(v) * w for v, w in zip(row, q)) for row in items.tolist()]


class Lists:
    """The sorted lists of a block of candidates (rows by ascending id)."""

    def __init__(self, items: np.ndarray, ids: np.ndarray):
        self.items, self.ids = items, ids
        self.x = np.ascontiguousarray(_scaled(items).T)  # a row is one component
        self.order = np.argsort(self.x, axis=1, kind="stable")
        self.squared = self.x * self.x
        self.squares = self.squared.sum(axis=0)
        self.stretches_read = self.stretches = 0

    def search(self, query: np.ndarray, weights: np.ndarray, own: np.int64, k: int) -> tuple[list[int], list[int]]:
        """Ids and exact scores of the k best items but those with the id ``own``; ``weights`` is the scaled query.

        ``known`` and ``rest`` hold, by item, the score read so far and the squared length not read. What the unread
        components can add is a sum over all lists (``total``: by frontier, by far end, by squared weight) less what the
        item has had of it (``had``); a list counts in both until it is read to its end.
        """
        d, n = self.x.shape
        cut = -(-n // FIRST)
        mine = slice(*np.searchsorted(self.ids, [own, own + 1]))  # rows of the query's own id
        ends = self.x[np.arange(d), self.order[:, -1]] * weights, self.x[np.arange(d), self.order[:, 0]] * weights
        rising = weights > 0
        frontier, far = np.where(rising, *ends), np.where(rising, *ends[::-1])
        gap, state = frontier - far, np.zeros(d, int)
        known, rest, had = np.zeros(n), self.squares.copy(), np.zeros((3, n))
        total = np.array([frontier.sum(), far.sum(), (weights * weights).sum()])
        first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        reads, checked, slack = 0, 0, SLACK * max(1, d)
        self.stretches += 2 * d
        inside, part = np.delete(np.arange(n), mine), np.empty(n)
        while len(inside) > OPEN * k and gap.any():
            c = int(gap.argmax())
            w = weights[c]
            reads += 1
            if state[c] == 0 and cut < n:  # the first stretch
                at = self.order[c, : n - cut - 1 : -1] if rising[c] else self.order[c, :cut]
                v = self.x[c, at]
                known[at] += w * v
                rest[at] -= v * v
                f = w * v[-1]  # no unread value of this list adds more
                total[0] += f - frontier[c]
                share = np.array([f, far[c], w * w])
                had[:, at] += share[:, None]
                first[c] = at, share
                state[c], gap[c] = 1, f - far[c]
            else:  # the list to its end
                np.multiply(self.x[c], w, out=part)
                known += part
                rest -= self.squared[c]
                if state[c]:
                    at, share = first.pop(c)
                    v = self.x[c, at]
                    known[at] -= w * v
                    rest[at] += v * v
                    had[:, at] -= share[:, None]
                else:
                    share = np.array([frontier[c], far[c], w * w])
                total -= share
                state[c], gap[c] = 2, 0.0
            if reads - checked < max(1, d // 8) and gap.any():
                continue
            checked = reads
            upper, lower, weight = total[:, None] - had
            np.multiply(np.maximum(weight, 0), np.maximum(rest, 0), out=part)
            np.sqrt(part, out=part)
            upper = known + np.minimum(upper, part) + slack
            lower = known + np.maximum(lower, -part) - slack
            upper[mine] = lower[mine] = -np.inf
            kth = np.partition(lower, n - k)[n - k] if n > k else -np.inf
            inside = np.flatnonzero(upper >= max(kth, -np.finfo(float).max))
        self.stretches_read += reads
        scores = _exact(self.items[inside], query)
        best = sorted(zip((-s for s in scores), self.ids[inside].tolist()))[:k]
        return [i for _, i in best], [-s for s, _ in best]


def nra(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[int], float]:
    """(query position, item id, score) of each query's k best items but those with its own id, and the share of the
    lists that was read. Items must come by ascending id; components are integers (float64 or Python's)."""
    lists = Lists(items, ids)
    weights = _scaled(queries)
    at, found, out = [], [], []
    for q in range(len(queries)):
        best, scores = lists.search(queries[q], weights[q], query_ids[q], k)
        at += [q] * len(best)
        found += best
        out += scores
    return at, found, out, lists.stretches_read / max(1, lists.stretches)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return quantise(values.reshape(len(flat), -1))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row that the condition ``queries`` picks.

    Rows with repeated ids are searched one by one: a query's own id, however often it stands, is no candidate of it.
    """
    v = F.col(vector_col)
    if not isinstance(vectors.select(v).schema[0].dataType, T.ArrayType) or not isinstance(vectors.select(v).schema[0].dataType.elementType, (T.FloatType, T.DoubleType)):
        v = v.cast("array<double>")
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), queries.alias("is_query"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & sound).withColumn("d", F.size("v"))
    n, nq = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, -(-n // candidates)), max(1, -(-nq // query_block))
    # candidates are dealt by their place in the input, so that rows that repeat spread over all blocks
    deal = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
    left = rows.filter("is_query").dropDuplicates(["id", "v"]).withColumn("qb", deal(query_blocks, "id", "v")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("b", deal(blocks, F.monotonically_increasing_id(), F.lit(2))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        at, found, scores, ids = [], [], [], q["id"].to_numpy()
        if q.num_rows and c.num_rows:
            c = c.sort_by("id")
            at, found, scores, _ = nra(_matrix(q["v"]), ids, _matrix(c["v"]), c["id"].to_numpy(), k)
        near = [min(max(s, -BIGINT), BIGINT - 1) for s in scores]
        # an order-preserving form of the scores that no bigint holds
        beyond = [None if s == n else (s + (1 << 2199)).to_bytes(275, "big") for s, n in zip(scores, near)]
        return pa.table({"query_id": ids[np.array(at, int)], "vec_id": pa.array(found, pa.int64()), "score": pa.array(near, pa.int64()), "beyond": pa.array(beyond, pa.binary())})

    keys = ["d", "qb", "b"]
    pairs = left.select("id", "v", *keys).groupBy(*keys).cogroup(right.select("id", "v", *keys).groupBy(*keys))
    best = pairs.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
