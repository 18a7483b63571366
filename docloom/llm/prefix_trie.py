"""Conversations as a trie of shared prefixes, and its subtree totals by parallel tree contraction (Miller and Reif, 1985).

A node is a distinct sequence of a conversation's first turns. Its identity is the exclusive or of the hashes of its
turns, each hashed with its place, so that prefixes follow from running aggregates and texts are never shuffled.

Subtree totals come from rounds of joins. Rake takes all leaves off and adds what they hold to their parents. Compress
takes nodes with one child out of their chains (no two neighbours at once: lots decide) and links the child to the
parent above, so that long chains shrink by a fixed share each round. Rounds grow with the logarithm of the nodes, not with
the depth. Then the rounds are gone through backwards: a node that was taken out has what it held and its child's total.

Nulls: null roles and texts are empty, a null turn comes first, rows without conv_id play no part. Rows of one conversation
that tie in turn are ordered by a hash of role and text; repeated rows are turns of their own. Remainders of negative ids
keep the sign, as in SQL. An empty table has no nodes, not even a root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.shared import numbered

from .common import cut_lineage, written

#: Turns of a conversation whose running hash is one window; longer conversations are put together from such blocks.
BLOCK = 256
#: Consecutive conversation ids that make one piece of a node's member list.
IDS = 256
#: A parent with more than this share of all children is joined by broadcast: there are at most as many as its inverse.
HOT = 0.005


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (role and text), n_chars of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    t = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("bigint").alias("n_chars"))
    n = numbered(t, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")])
    first = n.groupBy("conv_id").agg(F.min("number").alias("__first"))
    return n.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("__first") + 1).alias("place"), "digest", "n_chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, digest, n_chars, length) and conversations (conv_id, length) with borrowed beginnings.

    Conversation c takes the first h = crc32(c) % most turns of conversation c - c % every (all, if it has fewer; none, if
    there is none) in the place of its own first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.groupBy("conv_id").agg(F.max("place").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    lent = own.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    c = own.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    c = c.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    heads = turns.filter(F.col("place") < most).withColumnRenamed("conv_id", "base")
    head = c.join(heads, "base").filter(F.col("place") <= F.col("h")).select("conv_id", "place", "digest", "n_chars", "length")
    tail = turns.join(c, "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_chars", "length")
    return head.unionByName(tail), c.select("conv_id", "length")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Adds x, y: the hash of the conversation's turns up to this one; and x0, y0: up to the one before."""
    t = turns.withColumns({"__x": F.xxhash64("place", "digest"), "__y": F.xxhash64("digest", F.lit("y"), "place"), "__block": F.floor((F.col("place") - 1) / BLOCK)})
    t = t.select("conv_id", "place", "n_chars", "length", "__x", "__y", "__block")
    inside = Window.partitionBy("conv_id", "__block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumns({"x": F.expr("bit_xor(__x)").over(inside), "y": F.expr("bit_xor(__y)").over(inside)})
    # blocks after the first, of the conversations that have any: what came before them
    after = t.filter(F.col("length") > BLOCK).groupBy("conv_id", "__block").agg(F.expr("bit_xor(__x)").alias("bx"), F.expr("bit_xor(__y)").alias("by"))
    earlier = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = after.select("conv_id", "__block", F.expr("bit_xor(bx)").over(earlier).alias("bx"), F.expr("bit_xor(by)").over(earlier).alias("by")).filter("bx is not null")
    j = run.join(carried, ["conv_id", "__block"], "left")
    whole = lambda c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"b{c}"), F.lit(0).cast("bigint")))
    j = j.withColumns({"x": whole("x"), "y": whole("y")})
    return j.select("conv_id", "place", "n_chars", "length", "x", "y", F.col("x").bitwiseXOR(F.col("__x")).alias("x0"), F.col("y").bitwiseXOR(F.col("__y")).alias("y0"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas; rows come sorted, only the running hash is kept."""
    key, running = None, None
    names = ["depth", "x", "y", "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        done = []
        for d, x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "x", "y", "ids"))):
            if (d, x, y) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (d, x, y), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done) if done else [()] * 4, kinds)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, running.hexdigest()), kinds)], names)


def member_hashes(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of ends (depth, x, y, conv_id): ids in order, joined in pieces before they meet in one task."""
    piece = F.floor(F.col("conv_id") / IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "x", "y", piece.alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "piece").mapInArrow(_hash_lists, "depth bigint, x bigint, y bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """id, parent, conv_id, depth, parent_conv_id, n_convs, n_children, chars, ends_sha256: one row a node, root included.

    turns: conv_id, place, digest, n_chars, length; convs: conv_id, length (0 for a conversation without turns).
    """
    t = cut_lineage(with_prefixes(turns))
    zero = F.lit(0).cast("bigint")
    made = t.groupBy(F.col("place").alias("depth"), "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("chars"), F.min("x0").alias("x0"), F.min("y0").alias("y0"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("bigint")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("chars"), none.alias("x0"), none.alias("y0"))
    nodes = cut_lineage(made.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    ends = t.filter(F.col("place") == F.col("length")).select(F.col("place").alias("depth"), "x", "y", "conv_id")
    ends = ends.unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id"))
    # a parent with very many children is joined by broadcast, the others by their key
    up = nodes.filter("depth > 0").select("id", (F.col("depth") - 1).alias("pd"), F.col("x0").alias("px"), F.col("y0").alias("py"))
    counts = up.groupBy("pd", "px", "py").agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("pd"), F.col("x").alias("px"), F.col("y").alias("py")).join(counts, ["pd", "px", "py"])
    parents = cut_lineage(parents)
    bound = parents.agg(F.sum("n_children")).first()[0] or 0
    hot = parents.filter(F.col("n_children") > F.lit(HOT) * bound)
    keys = ["pd", "px", "py"]
    by_key = up.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(parents.filter(F.col("n_children") <= F.lit(HOT) * bound), keys)
    links = by_key.unionByName(up.join(F.broadcast(hot), keys)).select("id", "parent", "parent_conv_id")
    with_parent = nodes.join(links, "id", "left").join(parents.select(F.col("parent").alias("id"), "n_children"), "id", "left")
    out = with_parent.join(member_hashes(ends), ["depth", "x", "y"], "left")
    return cut_lineage(out.select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def _drawn(node: str, turn: int) -> Column:
    """A number that is drawn anew for each node and round, the same wherever it is asked for."""
    return F.xxhash64(F.col(node), F.lit(turn))


def subtree_totals(nodes: DataFrame, sums: Sequence[str], max_rounds: int = 400) -> DataFrame:
    """id and the sums of the columns ``sums`` over each node's subtree, by tree contraction.

    nodes: id (bigint), parent (null for roots; there may be many trees), and the columns (bigint). A parent's children may
    be any number: they are summed before they are shuffled.
    """
    held, edge = list(sums), [f"__e_{s}" for s in sums]
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("bigint")
    now = nodes.select("id", "parent", *held).join(kids, "id", "left").withColumns({"kids": F.coalesce("kids", zero), **{e: zero for e in edge}})
    rounds: list[tuple[DataFrame, DataFrame]] = []
    for turn in range(max_rounds):
        # rake: leaves give what they and their edge hold to their parents
        leaf = F.col("kids") == 0
        given = now.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            F.count_if(leaf).alias("__raked"), F.min(F.when(~leaf, F.col("id"))).alias("only"), *[F.sum(F.when(leaf, F.col(s) + F.col(e))).alias(f"__g_{s}") for s, e in zip(held, edge)]
        )
        after = now.join(given, "id", "left").withColumns({"off": leaf, "kids": F.col("kids") - F.coalesce("__raked", zero), **{s: F.col(s) + F.coalesce(f"__g_{s}", zero) for s in held}})
        after = written(after.select("id", "parent", "kids", "only", "off", *held, *edge), "raked")
        left = after.filter(~F.col("off"))
        # compress: nodes with one child leave their chain where they draw less than the node above and the one below
        out = left.filter((F.col("kids") == 1) & F.col("parent").isNotNull() & (_drawn("id", turn) < _drawn("parent", turn)) & (_drawn("id", turn) < _drawn("only", turn)))
        child = left.select(F.col("id").alias("only"), *[F.col(e).alias(f"__c{e}") for e in edge])
        taken = written(out.join(child, "only").select("id", "only", "parent", *held, *edge, *[f"__c{e}" for e in edge]), "compressed")
        rounds.append((after.filter("off"), taken))
        moved = taken.select(F.col("only").alias("id"), F.col("parent").alias("__up"), *[(F.col(s) + F.col(e)).alias(f"__m_{s}") for s, e in zip(held, edge)])
        stay = left.join(taken.select("id"), "id", "left_anti").join(moved, "id", "left")
        now = stay.withColumns({"parent": F.coalesce("__up", "parent"), **{e: F.col(e) + F.coalesce(f"__m_{s}", zero) for s, e in zip(held, edge)}}).select("id", "parent", "kids", *held, *edge)
        if left.filter(F.col("parent").isNotNull() | (F.col("kids") > 0)).isEmpty():
            break
    else:
        raise RuntimeError(f"trees were not contracted in {max_rounds} rounds")
    known = now.select("id", *held)
    for raked, taken in reversed(rounds):
        # the child's edge, as it was then, holds what had been taken out between the two
        totals = known.select(F.col("id").alias("only"), *[F.col(s).alias(f"__t_{s}") for s in held])
        back = taken.join(totals, "only").select("id", *[(F.col(s) + F.col(f"__c{e}") + F.col(f"__t_{s}")).alias(s) for s, e in zip(held, edge)])
        known = written(known.unionByName(back).unionByName(raked.select("id", *held)), "expanded")
    return known


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text), with what their subtrees hold."""
    turns, convs = rebuilt(cut_lineage(ordered(conversations)), every, most)
    nodes = trie(turns, cut_lineage(convs))
    sums = nodes.select("id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    return nodes.join(subtree_totals(sums, ["n_leaves", "saved_tokens"]), "id").select(*names, "n_leaves", "saved_tokens", "ends_sha256")
