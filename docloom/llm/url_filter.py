"""URL rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict and a rank. Every literal token that a rule is sure
to contain (cut off by separators on both sides) could index it; it is filed under the one that is rarest in the URLs
at hand, counted over all of them. A URL looks up its own tokens, and only the rules found there, and those without a
sure token, run their expression. The best-ranked fitting rule decides; without one the method's own rules, filed in
the same index at lower rank, do; without any the URL is allowed.

Null URLs, or URLs without ``://``, have an empty host and path, fit no rule and are allowed. Up to ``MAX_RULES`` rules
are broadcast; a longer list is joined by token, and the same expressions decide. Repeated rows repeat; columns other
than page_id and url are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
#: URLs that share a token, by salt, in the join.
SALT_ROWS = 1_000_000
TOKEN = "[A-Za-z0-9]+"

# The base rules (verdict, host, path).
BASE = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The method's own rules: host labels of sites that sell, bet or exist for links.
OWN_LABELS = ("cheap-pills", "free-bets", "spam-farm", "online-casino", "payday-loans", "adult-cams")


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str
    rank: int  # the highest fitting rank wins; ties by name
    name: str | None  # None: one of the method's own
    tokens: tuple[str, ...]  # sure to stand whole in any URL that fits


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains, and paths that start with ``path``; a longer host and path ranks higher."""
    sure = re.findall(TOKEN, host) + re.findall(f"{TOKEN}(?=[^A-Za-z0-9])", path)
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, len(host) + len(path) + 1_000, host + path, tuple(sure))


def label_rule(label: str) -> Rule:
    return Rule(rf"^(?:[^/]*\.)?{re.escape(label)}\.", "block", 0, None, tuple(re.findall(TOKEN, label)))


def default_rules() -> list[Rule]:
    return [prefix_rule(*r) for r in BASE] + [label_rule(x) for x in OWN_LABELS]


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with __host and __path; only A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url_col, "://") > 0, F.substring_index(F.col(url_col), "://", 1))
    after = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(__after, length(__raw_host) + 1)"), r"^[^?#]*", 0)
    out = pages.withColumn("__has", rest.isNotNull()).withColumn("__after", F.when(F.col("__has"), after).otherwise(""))
    out = out.withColumn("__raw_host", F.when(F.col("__has"), host).otherwise(""))
    lower = F.translate("__raw_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.withColumn("__host", lower).withColumn("__path", path).drop("__has", "__after", "__raw_host")


def _tokens(column: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"({TOKEN})"), 1))


def index_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs (column __full) hold each token that some rule could be filed under."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(wanted, 0)
    names = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    found = urls.select(F.explode(_tokens(F.col("__full"))).alias("token")).groupBy("token").count().join(names, "token", "left_semi")
    counts.update({r["token"]: r["count"] for r in found.collect()})  # at most one row for each token of the rules
    return counts


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for r in rules:
            entry = (r.rank, r.name or "", r.verdict, re.compile(r.pattern, re.S))
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts[t], -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)
        self.token = re.compile(TOKEN)

    def best(self, full: str) -> dict | None:
        """The best-ranked rule that fits, ties to the greater name."""
        best = None
        for entries in [self.always, *(self.by_token[t] for t in set(self.token.findall(full)) if t in self.by_token)]:
            for e in entries:
                if (best is None or e[:2] > best[:2]) and e[3].search(full):
                    best = e
        return best and {"rank": best[0], "key": best[1], "rule": best[1] or None, "verdict": best[2]}


DECISION = "struct<rank:int,key:string,rule:string,verdict:string>"
_DECISION = pa.struct([("rank", pa.int32()), ("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


@lru_cache(maxsize=65_536)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.S)


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages`` (repeated rows repeat)."""
    rules = default_rules() if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = with_host_and_path(rows).withColumn("__full", F.concat("__host", "__path"))
    counts = index_tokens(rows, rules)
    if len(rules) > max_rules:
        return _by_join(rows, rules, counts)
    index = rows.sparkSession.sparkContext.broadcast(Index(rules, counts))

    @F.arrow_udf(DECISION)
    def decide(urls: pa.Array) -> pa.Array:
        return pa.array([index.value.best(u.as_py() or "") for u in urls], _DECISION)

    out = rows.withColumn("__found", decide("__full"))
    return out.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "__found.rule", F.coalesce("__found.verdict", F.lit("allow")).alias("verdict"))


def _by_join(rows: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """The same decisions by a join of URL tokens with the index, for rule lists beyond the broadcast bound.

    Only tokens that file a rule are joined; URLs that share one are spread over as many salts as the token's count
    asks for. Rules without a sure token would meet every URL: they are broadcast, and there may be ``MAX_RULES`` of them.
    """
    spark = rows.sparkSession
    loose = [r for r in rules if not r.tokens]
    if len(loose) > MAX_RULES:
        raise ValueError("too many rules without a sure token")
    index = spark.sparkContext.broadcast(Index(loose, counts))
    filed = [(t := min(r.tokens, key=lambda t: (counts[t], -len(t), t)), 1 + counts[t] // SALT_ROWS, r.pattern, r.rank, r.name, r.verdict) for r in rules if r.tokens]
    by_token = spark.createDataFrame(filed, "token string, salts int, pattern string, rank int, name string, own string")
    distinct = rows.select("__full").distinct()
    tokens = distinct.select("__full", F.explode(_tokens(F.col("__full"))).alias("token"))
    tokens = tokens.join(by_token.select("token", "salts").distinct(), "token")
    tokens = tokens.select("__full", "token", F.pmod(F.xxhash64("__full"), F.col("salts")).cast("int").alias("salt"))
    salted = by_token.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    @F.arrow_udf("boolean")
    def fits(urls: pa.Array, patterns: pa.Array) -> pa.Array:
        return pa.array([_compiled(p.as_py()).search(u.as_py()) is not None for u, p in zip(urls, patterns)], pa.bool_())

    @F.arrow_udf(DECISION)
    def loosely(urls: pa.Array) -> pa.Array:
        return pa.array([index.value.best(u.as_py() or "") for u in urls], _DECISION)

    fitting = tokens.join(salted, ["token", "salt"]).filter(fits("__full", "pattern"))
    order = F.struct("rank", F.coalesce("name", F.lit("")).alias("key"), F.col("name").alias("rule"), F.col("own").alias("verdict"))
    best = fitting.groupBy("__full").agg(F.max(order).alias("__b"))
    out = rows.join(best, "__full", "left").withColumn("__l", loosely("__full"))
    found = F.greatest("__b", F.when(F.col("__l.verdict").isNotNull(), F.col("__l")))
    return out.withColumn("__f", found).select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "__f.rule", F.coalesce("__f.verdict", F.lit("allow")).alias("verdict"))
