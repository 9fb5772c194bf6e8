"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host#path#rest``, an action and the literal tokens
that any URL it fits must hold.  Token frequencies over all URLs choose the rarest token of
each rule as its key; a URL's tokens fetch the rules keyed by them, and only those run.  Of
the fitting rules the one with the highest rank wins: rules of fixed places first, the
longest one, then pattern rules.  All of it is DataFrame expressions: with few rules the index
is a map literal and nothing is shuffled, with many it is a table joined by token.

Edge cases: a null URL or one without ``://`` has an empty host and path, no tokens and no
rule, and gets the default verdict, allow; a rule without tokens is tried on every URL;
repeated rows each get the same result; an empty table gives no rows; columns of ``pages``
called host, path, rule, action or rank are replaced.  Rules of alternatives are split, so that
each has a token; the token "a number" serves rules about raw addresses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    rank: int


def place_rule(action: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the path starts with ``path``; longer ones rank higher."""
    whole = [*host.split("."), *re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())]
    return Rule(f"{host}{path}", rf"(?s)^([^#]*\.)?{re.escape(host)}#{re.escape(path)}", tuple(whole), action, 1_000_000 + 1000 * len(host + path) + len(host))


def pattern_rule(action: str, name: str, pattern: str, tokens: tuple[str, ...], rank: int = 0) -> Rule:
    return Rule(name, pattern, tokens, action, rank)


#: Stands among a URL's tokens for any that is a number.
NUMBER = "#number"
#: The rules of fixed places, and the pattern rules of the method: spam hosts, trackers, adult and gambling words, raw addresses.
PLACES = (
    place_rule("block", "com", "/en/"), place_rule("allow", "example.com", "/en/7"), place_rule("allow", "net", "/de/"),
    place_rule("block", "example.net", "/de/8"), place_rule("block", "org", "/es/"),
)
PATTERNS = (
    pattern_rule("block", "~spam-host", r"^([^#]*[.-])?spam[.-][^#]*#", ("spam",), 9),
    pattern_rule("block", "~link-farm", r"^([^#]*[.-])?farm[.-][^#]*#", ("farm",), 8),
    pattern_rule("block", "~casino", r"(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",), 7),
    pattern_rule("block", "~porn", r"(^|[^a-z0-9])porn([^a-z0-9]|$)", ("porn",), 6),
    *(pattern_rule("block", "~ad-server", rf"^([^#]*\.)?{host}\.[^#]*#", (host,), 5) for host in ("ads", "adserver", "doubleclick")),
    pattern_rule("block", "~raw-address", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?#", (NUMBER,), 4),
)
#: With more rules than this the index is joined as a table.
LITERAL_RULES = 256
#: A table of rules up to this many is broadcast, a larger one is joined by shuffle.
BROADCAST_RULES = 100_000


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, the text that rules see, and the distinct tokens."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, position('://' IN `{url}`) + 3)"))
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.expr("substring(_rest, length(host) + 1)")
    df = pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("host", host).withColumn("_after", after)
    df = df.withColumn("path", F.regexp_extract("_after", r"(?s)^[^?#]*", 0))
    df = df.withColumn("_seen", F.concat_ws("#", "host", "path", F.expr("substring(_after, length(path) + 1)")))
    low = F.translate("_seen", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("_tokens", F.array_distinct(F.filter(F.split(low, r"[^a-z0-9]+"), lambda t: t != "")))
    number = F.when(F.exists("_tokens", lambda t: F.rlike(t, F.lit("^[0-9]+$"))), F.array(F.lit(NUMBER))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_tokens", F.concat("_tokens", number)).drop("_rest", "_after")


def rarest(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[Rule, str]:
    """Each rule's token that the fewest URLs hold; the counts of the rules' tokens only come to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    of = parts.select(F.explode(F.array_intersect("_tokens", F.lit(wanted))).alias("t")).groupBy("t").count()
    n = dict.fromkeys(wanted, 0) | {r["t"]: r["count"] for r in of.collect()}
    return {r: min(r.tokens, key=lambda t: (n[t], t)) for r in rules if r.tokens}


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))


def matched(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """Adds host, path, and the winning rule's ``rule``, ``action`` and ``rank`` (null where none fits)."""
    parts = with_parts(pages, url)
    key = rarest(parts, rules)
    always = [r for r in rules if r not in key]
    fits = lambda c: F.filter(c, lambda r: F.rlike(F.col("_seen"), r["pattern"]))
    kind = "array<struct<rank:int,name:string,action:string,pattern:string>>"
    anyhow = F.array(*map(_struct, always)).cast(kind) if always else F.lit(None).cast(kind)
    if len(key) <= LITERAL_RULES:
        tokens = sorted(set(key.values()))
        if tokens:
            index = F.create_map(*(x for t in tokens for x in (F.lit(t), F.array(*(_struct(r) for r in rules if key.get(r) == t)))))
            fetched = F.flatten(F.transform(F.array_intersect("_tokens", F.lit(tokens)), lambda t: F.element_at(index, t))).cast(kind)
        else:
            fetched = F.array().cast(kind)
        candidates = F.concat(fetched, F.coalesce(anyhow, F.array().cast(kind)))
        best = parts.withColumn("_best", F.array_max(fits(candidates)))
    else:
        spark = pages.sparkSession
        rows = spark.createDataFrame([(key[r], r.rank, r.name, r.action, r.pattern) for r in key], "token string, rank int, name string, action string, pattern string")
        if len(key) <= BROADCAST_RULES:
            rows = F.broadcast(rows)
        # URLs with the same parts are judged once; a token that many URLs hold is spread by the join's skew handling
        seen = parts.select("_seen", "_tokens").distinct()
        got = seen.select("_seen", F.explode("_tokens").alias("token")).join(rows, "token").where(F.rlike(F.col("_seen"), F.col("pattern")))
        top = got.groupBy("_seen").agg(F.max(F.struct("rank", "name", "action", "pattern")).alias("_hit"))
        best = parts.join(top, "_seen", "left").withColumn("_best", F.array_max(F.filter(F.concat(F.array("_hit"), F.coalesce(fits(anyhow), F.array().cast(kind))), lambda r: r.isNotNull()))).drop("_hit")
    return best.withColumns({"rule": F.col("_best.name"), "action": F.col("_best.action"), "rank": F.col("_best.rank")}).drop("_best", "_seen", "_tokens")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, place rule and verdict of every page's URL."""
    got = matched(table(spark, sf_dir, "pages").select("page_id", "url"), PLACES + PATTERNS)
    fixed = F.col("rank") >= 1_000_000
    return got.select("page_id", "host", "path", F.when(fixed, F.col("rule")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"), F.when(~fixed, F.col("rule")).alias("pattern"))


#: The same rows in DuckDB SQL.
OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
p AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*', 0, 's') AS path, substr(rest, length(host) + 1) AS after FROM h),
r(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT p.*, row_number() OVER () AS n FROM p),
f AS (SELECT m.n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action FROM m JOIN r ON (m.host = rhost OR ends_with(m.host, '.' || rhost)) AND starts_with(m.path, rpath) GROUP BY m.n),
s AS (SELECT m.*, rule, action, host || '#' || path || '#' || substr(after, length(path) + 1) AS seen FROM m LEFT JOIN f USING (n)),
t AS (SELECT *, CASE
  WHEN regexp_matches(seen, '^([^#]*[.-])?spam[.-][^#]*#') THEN '~spam-host'
  WHEN regexp_matches(seen, '^([^#]*[.-])?farm[.-][^#]*#') THEN '~link-farm'
  WHEN regexp_matches(seen, '(^|[^a-z0-9])casino([^a-z0-9]|$)') THEN '~casino'
  WHEN regexp_matches(seen, '(^|[^a-z0-9])porn([^a-z0-9]|$)') THEN '~porn'
  WHEN regexp_matches(seen, '^([^#]*\.)?(ads|adserver|doubleclick)\.[^#]*#') THEN '~ad-server'
  WHEN regexp_matches(seen, '^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?#') THEN '~raw-address' END AS pattern FROM s)
SELECT page_id, host, path, rule, COALESCE(action, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM t
"""
