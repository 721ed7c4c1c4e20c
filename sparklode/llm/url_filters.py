"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over host + path, plus the literal tokens
that every text it matches must hold as whole tokens: one set of tokens, or one
for each branch of its alternations. A branch is filed under the one of its
tokens that is rarest in the table at hand; a url fetches the rules filed under
its own tokens, and only those run their expressions. Rules come as a table (or
a tuple, for a few), which is broadcast up to ``MAX_BROADCAST_RULES`` branches
and joined beyond.

Everything is DataFrame code: one pass counts the rule tokens, one shuffle
brings equal urls together, so that each different url is judged once. Rows
without a host and path, however many, are spread over ``SPREAD`` keys.

Edge cases: a null url, or one without ``://``, has an empty host and path and
no rule, unless one without tokens matches the empty text; urls of any length
are read whole; of rules of equal length that fit, the last by name decides.
Repeated rows and repeated or null page ids keep one output row each. Columns
beyond ``url`` are passed through; input columns named like an output column are
replaced by it. Empty tables, of pages or rules, give no rows or no rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: Branches of rules that are broadcast; beyond, Spark joins them as it sees fit.
MAX_BROADCAST_RULES = 100_000
#: Keys among which rows without host and path are dealt.
SPREAD = 64
BRANCHES = "array<array<string>>"

TOKEN_BREAK = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on host + path; ``branches`` are the token sets of which a match holds one. ``name`` rules decide by length; the rest are the method's own block patterns."""

    regex: str
    action: str
    branches: tuple[tuple[str, ...], ...] = ((),)
    name: str | None = None


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    regex = r"^(?:[^/?#]*\.)?" + _quoted(host + path)
    # The last token of a path prefix may go on in the url, so it is no whole token.
    whole = re.split(TOKEN_BREAK, host) + re.split(TOKEN_BREAK, path)[:-1]
    return Rule(regex, action, (tuple(t for t in whole if t),), host + path)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


# The rules that decide by name, and the method's own patterns.
NAMED_RULES = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)
PATTERN_RULES = (
    Rule(r"^(?:[^/]*\.)?(?:casino|poker|slots)-(?:win|play|bonus)\.", "block", tuple((a, b) for a in ("casino", "poker", "slots") for b in ("win", "play", "bonus"))),
    Rule(r"^(?:[^/]*\.)?(?:free|sure)-bets?\.", "block", tuple((a, b) for a in ("free", "sure") for b in ("bet", "bets"))),
    Rule(r"^(?:[^/]*\.)?cheap-(?:pills|meds)[0-9]*\.", "block", (("cheap",),)),
    Rule(r"^(?:[^/]*\.)?ads?-track(?:er)?\.", "block", tuple((a, b) for a in ("ad", "ads") for b in ("track", "tracker"))),
    Rule(r"^(?:[^/]*\.)?adult-[a-z]+\.", "block", (("adult",),)),
    Rule(r"^[^/]+/(?:[^?]*/)?(?:adserver|banners|popunder)/", "block", (("adserver",), ("banners",), ("popunder",))),
    Rule(r"^[^/]+/(?:[^?]*/)?(?:login|signin|register|checkout)(?:/|\.php|\.html?)?$", "block", (("login",), ("signin",), ("register",), ("checkout",))),
    Rule(r"^[^/]+/.*\.(?:exe|apk|dmg|msi)$", "block", (("exe",), ("apk",), ("dmg",), ("msi",))),
)


def url_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.drop("host", "path", "__rest")
        .withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", ascii_lower(F.regexp_extract("__rest", r"^(?s)([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("__rest", r"^(?s)[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A few rules as a local relation (rule_no, regex, action, name, branches)."""
    text = lambda s: F.lit(s).cast("string")
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("rule_no"),
            text(r.regex).alias("regex"),
            text(r.action).alias("action"),
            text(r.name).alias("name"),
            F.array(*[F.array(*[text(t) for t in branch]).cast(T.ArrayType(T.StringType())) for branch in r.branches]).cast(BRANCHES).alias("branches"),
        )
        for i, r in enumerate(rules)
    ]
    none = F.array().cast(f"array<struct<rule_no:long,regex:string,action:string,name:string,branches:{BRANCHES}>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule_no, regex, action, name): each branch of a rule under its token that is rarest among ``urls`` (array column ``tokens``).

    A branch without a token, and a rule without a branch, is filed under the
    empty token, which every url has.
    """
    branch = rules.select("rule_no", F.posexplode_outer("branches").alias("branch", "tokens"))
    wanted = branch.select("rule_no", F.coalesce("branch", F.lit(0)).alias("branch"), F.explode_outer("tokens").alias("token")).fillna("", ["token"])
    seen = (
        urls.select(F.explode("tokens").alias("token"))
        .join(wanted.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        wanted.join(seen, "token", "left")
        .groupBy("rule_no", "branch")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    return rarest.select("rule_no", "token").distinct().join(rules.drop("branches"), "rule_no")


def judge_urls(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = NAMED_RULES + PATTERN_RULES) -> DataFrame:
    """Adds host, path, rule, verdict and n_candidates (expressions run).

    ``rules``: a table (rule_no, regex, action, name, branches: array<array<string>>), or rules.
    """
    spark = pages.sparkSession
    pages = url_parts(pages.drop("rule", "verdict", "n_candidates", "__salt"))
    urls = (
        pages.select("host", "path")
        .distinct()
        .withColumn("target", F.concat("host", "path"))
        .withColumn("tokens", F.array_distinct(F.concat(F.array(F.lit("")), F.split("target", TOKEN_BREAK))))
    )
    few = isinstance(rules, tuple) or rules.select(F.sum(F.greatest(F.size("branches"), F.lit(1)))).collect()[0][0] or 0
    index = rule_index(urls, rules_table(spark, rules) if isinstance(rules, tuple) else rules)
    if few is True or few <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    fetched = urls.withColumn("token", F.explode("tokens")).join(index, "token")
    fits = F.expr("target rlike regex")
    longest = F.when(fits & F.col("name").isNotNull(), F.struct(F.length("name"), "name"))
    judged = fetched.groupBy("host", "path").agg(
        F.max_by("name", longest).alias("rule"),
        F.max_by("action", longest).alias("__named"),
        F.max(fits & F.col("name").isNull() & (F.col("action") == "block")).alias("__blocked"),
        F.count("*").alias("n_candidates"),
    )
    blank = F.concat("host", "path") == ""
    judged = judged.withColumn("__salt", F.explode(F.when(blank, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    pages = pages.withColumn("__salt", F.when(blank, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")).otherwise(0))
    own = F.when(F.coalesce("__blocked", F.lit(False)), "block").otherwise("allow")
    return (
        pages.join(judged, ["host", "path", "__salt"], "left")
        .withColumn("verdict", F.coalesce("__named", own))
        .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
        .drop("__named", "__blocked", "__salt")
    )


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
  SELECT hp.*,
    (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
    (SELECT action FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS named
  FROM hp
)
SELECT page_id, host, path, rule,
  coalesce(named, CASE WHEN regexp_matches(host, '(^|\.)((casino|poker|slots)-(win|play|bonus)|(free|sure)-bets?|cheap-(pills|meds)[0-9]*|ads?-track(er)?|adult-[a-z]+)\.')
    OR regexp_matches(path, '/(adserver|banners|popunder)/|/(login|signin|register|checkout)(/|\.php|\.html?)?$|/.*\.(exe|apk|dmg|msi)$') AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
