"""Operator 1: URL rules, indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every url it fits
must hold. Each rule is filed under that one of its tokens that the fewest urls
have; a url's tokens fetch the rules filed under them, and only those
expressions run on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists up to this length are broadcast; longer ones join by shuffle.
BROADCAST_RULES = 50_000
#: Stands for "in every url"; rules without a literal token are filed under it.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """``tokens``: whole runs of a-z and 0-9 in the lower-cased url. Higher ``rank`` wins, then block."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with ``path``; the longest rule wins."""
    pattern = rf"(?s)\A(?:(?!://).)*+://(?:[^/?#]*\.)?(?i:{re.escape(host)}){re.escape(path)}"
    inner = re.findall("[a-z0-9]+", path if path.endswith("/") else path.rpartition("/")[0] + "/") if re.fullmatch("[^A-Z]*", path) else []
    return Rule(host + path, action, pattern, (*re.findall("[a-z0-9]+", host.lower()), *inner), 1_000_000 + len(host + path))


def plain_rule(action: str, pattern: str, *tokens: str) -> Rule:
    return Rule(pattern, action, pattern, tokens, 0, listed=False)


#: The rules of the contract.
LISTED = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: What is blocked where no listed rule fits.
PLAIN = (
    plain_rule("block", r"[?&]gclid=", "gclid"),
    plain_rule("block", r"[?&]fbclid=", "fbclid"),
    plain_rule("block", r"/ads/", "ads"),
    plain_rule("block", r"/adserver/", "adserver"),
    plain_rule("block", r"/banners/", "banners"),
    plain_rule("block", r"/popup/", "popup"),
    plain_rule("block", r"/tracking/pixel", "tracking"),
)


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: key, host, path, the listed rule that fits best (else null), the pattern that decided, and the verdict.

    Without any fitting rule the verdict is allow. Null urls and urls without
    ``://`` have empty host and path; plain patterns may still fit the latter.
    Repeated rows stay, each with its verdict, very long urls are judged as a
    whole, and other columns are left out.
    No rule or no page gives the same columns. The expressions run once for
    each distinct url; pages of one very common url meet its verdict in a join
    whose large side Spark can split.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.col("url"), "://", 1)).otherwise(None)
    rest = F.substring(F.col("url"), F.length(rest) + 4, F.length("url"))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    parts = pages.select(key, "url", F.coalesce(lower_ascii(host), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    urls = pages.select("url").where("url is not null").distinct()
    found = F.array_union(F.array(F.lit(ANY)), F.regexp_extract_all(lower_ascii(F.col("url")), F.lit("([a-z0-9]+)")))
    tokens = urls.select("url", F.explode(found).alias("token"))
    table = spark.createDataFrame([(i, r.name, r.action, r.pattern, r.rank, r.listed) for i, r in enumerate(rules)], "rule_id int, name string, action string, pattern string, rank int, listed boolean")
    literals = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in (r.tokens or (ANY,))], "rule_id int, token string")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)

    seen = tokens.join(small(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literals.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    fits = tokens.join(small(rarest.join(table, "rule_id")), "token").where(F.expr("url rlike pattern"))
    order = F.struct("rank", (F.col("action") == "block").cast("int").alias("b"), "name", "action", "listed")
    best = fits.groupBy("url").agg(F.max(order).alias("best"))
    return parts.join(best, "url", "left").select(
        key, "host", "path",
        F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
        F.col("best.name").alias("pattern"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), LISTED + PLAIN)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM u
), r AS (
  SELECT page_id, url, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(url, '{"|".join(r.pattern for r in PLAIN)}') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
