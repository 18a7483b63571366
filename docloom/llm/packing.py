"""Best-fit packing of token sequences, finished by swap-based local search.

Documents are tokenised, closed with an end id and, only if longer than ``capacity``, cut into pieces: full ones, after
a shorter first one. Pieces are dealt to groups of a bounded number (``group_size``) by a hash; each group is packed on
its own: best fit in the order dealt, then local search over all underfull bins. A search step moves a piece, exchanges
one for one or two for one between two bins whenever that raises the sum of squared fills, which drains light bins
until they are empty. Bins that stay underfull are opened again and packed once more with those of other groups, so
that the loss does not grow with the number of groups.

Null texts are empty: one piece with the end id only. Every piece lies whole in one sequence, gapless from 0. Repeated
rows are packed as often as they stand; columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

CAPACITY = 1024
END_ID = 2
GROUP_SIZE = 20_000
MAX_UNITS = 100_000


class Encoder:
    """Token ids of byte_bpe-style vocabularies, kept by white-space-led unit.

    The vocabulary's pattern never joins text across a single space that follows other text, so ``" word"`` units are
    encoded once and looked up afterwards. Texts with a space after other white space are encoded whole. The strings
    of special tokens stand for their ids, as the library has it by default.
    """

    def __init__(self, name: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that depend on their surroundings are not supported")
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")")
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leads = np.zeros(max(ranks.values()) + 1, dtype=bool)  # ids whose token begins with a space
        self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.units: dict[str, bytes] = {}

    def ids_of(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(c in text for c in self.special):
            return b"".join(self.special[t] if t in self.special else self.plain(t) for t in self.split.split(text))
        return self.plain(text)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of the units of the words, encoded in one go; only a unit's first token begins with a space."""
        order = list(words)
        ids = np.array(self.model.encode_ordinary(" " + " ".join(order)), dtype="<u4")
        data, at = ids.tobytes(), [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
        return {w: data[a:b] for w, a, b in zip(order, at[:-1], at[1:], strict=True)}

    def plain(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return self.ids_of(text)
        units = self.units
        ids = list(map(units.get, words))
        if not all(ids):
            missing = {w for w, x in zip(words, ids) if x is None}
            if any(not w or w[-1].isspace() for w in missing):  # white space before the next space
                return self.ids_of(text)
            new = self.learn(missing)
            ids = [x or new[w] for w, x in zip(words, ids)]
            if len(units) + len(new) > MAX_UNITS:
                units.clear()
            units.update((w, x) for w, x in new.items() if len(w) <= 32)
        return self.ids_of(first) + b"".join(ids)


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"
_TYPE = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))


def cut(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of each piece; the first takes what full pieces leave."""
    n = len(ids) // 4
    head = n if n <= capacity else (n - 1) % capacity + 1
    return [(a, ids[4 * a : 4 * b]) for a, b in [(0, head)] + [(a, a + capacity) for a in range(head, n, capacity)]]


def pieces(text: Column, capacity: int = CAPACITY, name: str = "byte_bpe_50k.json", end_id: int = END_ID, with_ids: bool = True) -> Column:
    """Array of the text's pieces; ids are left null where only their places and checksums are asked for."""

    @F.arrow_udf(PIECE)
    def make(texts: pa.Array) -> pa.Array:
        e, end, out = encoder(name), np.array([end_id], dtype="<u4").tobytes(), []
        for t in texts:
            out.append([
                {"piece": k, "start": a, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "ids": ids if with_ids else None}
                for k, (a, ids) in enumerate(cut(e.encode(t.as_py()) + end, capacity))
            ])
        return pa.array(out, _TYPE)

    return make(text.cast("string"))


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids]: one row per piece."""
    rows = docs.select("doc_id", F.explode(pieces(F.col("text"), capacity, with_ids=with_ids, **options)).alias("p")).select("doc_id", "p.*")
    return rows if with_ids else rows.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, in the order given, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class _Open:
    """The underfull bins, filed by room, with bit masks of the piece lengths and of the sums of two that they hold."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.bins: list[dict[int, list[int]]] = []  # length -> pieces
        self.fill: list[int] = []
        self.one: list[int] = []
        self.two: list[int] = []
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # room -> bins, in order of arrival
        self.seen = [[0, 0] for _ in range(capacity + 1)]  # masks of a room's bins; may name lengths that have left
        self.rooms: list[int] = []
        for members in bins:
            held: dict[int, list[int]] = {}
            for i in members:
                held.setdefault(size[i], []).append(i)
            self.bins.append(held)
            self.fill.append(0)
            self.one.append(0)
            self.two.append(0)
            self.file(len(self.bins) - 1)

    def file(self, b: int) -> None:
        held = self.bins[b]
        self.fill[b] = sum(n * len(x) for n, x in held.items())
        one = two = 0
        for n, x in held.items():
            one |= 1 << n
        for n, x in held.items():
            two |= (one if len(x) > 1 else one & ~(1 << n)) << n
        self.one[b], self.two[b] = one, two & ((1 << self.capacity) - 1)
        room = self.capacity - self.fill[b]
        if 0 < room < self.capacity:
            if not self.at[room]:
                bisect.insort(self.rooms, room)
                self.seen[room] = [0, 0]
            self.at[room][b] = None
            self.seen[room][0] |= one
            self.seen[room][1] |= self.two[b]

    def unfile(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if b in self.at[room]:
            del self.at[room][b]
            if not self.at[room]:
                self.rooms.remove(room)

    def holder(self, room: int, n: int, pair: int, but: int) -> int | None:
        """A bin of that room that holds the length (or, with ``pair``, two of that sum)."""
        masks = self.two if pair else self.one
        for b in self.at[room]:
            if masks[b] >> n & 1 and b != but:
                return b
        mask = 0
        for b in self.at[room]:
            mask |= masks[b]
        self.seen[room][pair] = mask
        return None

    def exact(self, s: int, a: int) -> tuple[int, int, int] | None:
        """(bin, length it gives back, whether as two) of a step that takes s from bin a and fills another one up."""
        for b in self.at[s] if s < self.capacity else ():
            if b != a:
                return b, 0, 0
        for room in self.rooms:
            if room >= s:
                break
            back = s - room
            for pair in (0, 1):
                if self.seen[room][pair] >> back & 1:
                    b = self.holder(room, back, pair, a)
                    if b is not None:
                        return b, back, pair
        return None

    def best(self, s: int, a: int) -> tuple[int, tuple[int, int, int]] | None:
        """(gain in squared fill, step) of the best step that takes s from bin a and fills no bin up."""
        found, most, fill = None, 0, self.fill[a]
        for room in self.rooms:
            heavy = self.capacity - room
            if heavy < fill:
                break
            if room > s and 2 * s * (heavy - fill + s) > most:
                b = next((b for b in self.at[room] if b != a), None)
                if b is not None:
                    found, most = (b, 0, 0), 2 * s * (heavy - fill + s)
            least = max(1, s - room)
            for pair in (0, 1):
                rest = self.seen[room][pair] >> least
                while rest:
                    back = least + (rest & -rest).bit_length() - 1
                    d = s - back
                    if d <= 0 or 2 * d * (heavy - fill + d) <= most:
                        break
                    b = self.holder(room, back, pair, a)
                    if b is not None:
                        found, most = (b, back, pair), 2 * d * (heavy - fill + d)
                        break
                    rest &= rest - 1
        return (most, found) if found else None

    def take(self, b: int, n: int, pair: bool) -> list[int]:
        """Takes a piece of length n, or two of that sum, out of bin b."""
        held, out = self.bins[b], []
        parts = [n]
        if pair:
            x = next(x for x in sorted(held) if n - x in held and (2 * x != n or len(held[x]) > 1))
            parts = [x, n - x]
        for x in parts:
            out.append(held[x].pop())
            if not held[x]:
                del held[x]
        return out

    def apply(self, a: int, s: int, as_pair: bool, step: tuple[int, int, int]) -> None:
        b, back, pair = step
        self.unfile(a)
        self.unfile(b)
        given = self.take(a, s, as_pair)
        returned = self.take(b, back, bool(pair)) if back else []
        for to, pieces_ in ((b, given), (a, returned)):
            for i in pieces_:
                self.bins[to].setdefault(self.size[i], []).append(i)
        self.file(a)
        self.file(b)

    def offers(self, a: int, as_pair: bool) -> list[int]:
        """Lengths that bin a can give, the longest first."""
        mask, out = (self.two if as_pair else self.one)[a], []
        while mask:
            n = mask.bit_length() - 1
            out.append(n)
            mask ^= 1 << n
        return out

    def improve(self, a: int) -> bool:
        """Takes the first step that fills a bin up, else the one that gains most; False if bin a has no step."""
        best = None
        for as_pair in (False, True):
            for s in self.offers(a, as_pair):
                step = self.exact(s, a)
                if step and not (as_pair and not step[1]):  # two pieces are moved one by one
                    self.apply(a, s, as_pair, step)
                    return True
        for as_pair in (False, True):
            for s in self.offers(a, as_pair):
                step = self.best(s, a)
                if step and (best is None or step[0] > best[0]) and not (as_pair and not step[1][1]):
                    best = (step[0], s, as_pair, step[1])
        if best:
            self.apply(a, *best[1:])
        return best is not None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges until no step is left; returns the bins that are not empty.

    The lightest underfull bin gives: it moves a piece, or gives one for one, two for one, or one for two, to a bin that
    is no lighter. Steps that fill a bin up come first, else that which gains most. Net length always goes from a
    lighter to a fuller bin, so squared fill rises with every step and the search ends: when every underfull bin has
    been tried since the last step, or once no packing can have fewer bins. All underfull bins take part, whatever
    their number; filing them by room and lengths (at most ``capacity`` values each) keeps a step short.
    """
    size = lengths.tolist()
    least = -(-sum(size) // capacity)
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    under = [b for b in bins if sum(size[i] for i in b) < capacity]
    state = _Open(under, size, capacity)
    left = len(bins)
    improved = True
    while improved and left > least:
        improved = False
        for a in sorted((b for room in state.rooms for b in state.at[room]), key=state.fill.__getitem__):
            while 0 < state.fill[a] < capacity and left > least and state.improve(a):
                improved = True
                left -= state.fill[a] == 0
    return full + [[i for x in held.values() for i in x] for held in state.bins if held]


def start(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in the order given, but pieces over half the capacity first: no two of them share a bin."""
    order = np.argsort(2 * lengths <= capacity, kind="stable")
    return [order[b].tolist() for b in best_fit(lengths[order], capacity)]


def reopened(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The search once more over its underfull bins and the bins of most pieces, eight for each, from descending lengths.

    Full bins hold the short pieces that underfull ones lack. Repeated while that leaves fewer bins.
    """
    least = -(-int(lengths.sum()) // capacity)
    while len(bins) > least:
        fill = [int(lengths[b].sum()) for b in bins]
        order = sorted(range(len(bins)), key=lambda k: (fill[k] == capacity, -len(bins[k])))
        n = sum(f < capacity for f in fill)
        opened = [i for k in order[: 9 * n] for i in bins[k]]
        opened = np.array(sorted(opened, key=lambda i: (-lengths[i], i)))
        again = local_search(best_fit(lengths[opened], capacity), lengths[opened], capacity)
        if len(again) >= min(9 * n, len(bins)):
            break
        bins = [bins[k] for k in order[9 * n :]] + [opened[b].tolist() for b in again]
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices: ``start``, ``local_search``, and the search again over ``reopened`` bins."""
    return reopened(local_search(start(lengths, capacity), lengths, capacity), lengths, capacity)


def pack(rows: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, rounds: int = 2) -> DataFrame:
    """``rows`` (a column length, and any others) with sequence_id and offset.

    A group holds about ``group_size`` pieces whatever the input's size: rows are dealt by a hash of their place in the
    checkpointed table, so neither repeated rows nor equal ids can fill a group.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__left", T.BooleanType())])
    names = list(rows.columns)

    def packer(round_: int, last: bool):
        def place(key: tuple, group: pa.Table) -> pa.Table:
            # an order that neither depends on the shuffle nor on lengths
            group = group.select(names).sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece", "length") if c in names])
            lengths = group["length"].to_numpy()
            sequence, offset, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            for b, members in enumerate(pack_lengths(lengths, capacity)):
                ends = np.cumsum(lengths[members])
                sequence[members] = (round_ << 58) + (key[0].as_py() << 26) + b
                offset[members] = ends - lengths[members]
                left[members] = not last and ends[-1] < capacity
            return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("__left", pa.array(left))

        return place

    todo, done = cut_lineage(rows), []
    for k in range(rounds):
        n = todo.count()
        last = k == rounds - 1 or n <= group_size
        groups = F.lit(max(1, -(-n // group_size))).cast("bigint")
        dealt = todo.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), groups))
        placed = cut_lineage(dealt.groupBy("__group").applyInArrow(packer(k, last), schema))
        done.append(placed.filter(~F.col("__left")).drop("__left"))
        if last:
            break
        todo = placed.filter("__left").select(*[F.col(f"`{c}`") for c in names])
    return reduce(DataFrame.union, done)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset for every piece of every row of ``docs``.

    Null and empty texts are one piece, the end id; null ids are carried through; repeated rows are packed each.
    """
    return pack(cut_documents(docs, capacity, with_ids), capacity, **options)
