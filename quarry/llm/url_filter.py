"""URL filters (operator 6), in DataFrame functions only.

A url is expanded into (host suffix, path prefix) expressions.  Expressions are
joined to the rules on the first 32 bits of their SHA-256; the full digest then
confirms a match, and of the rules that fit the longest wins.

Only the suffixes and prefixes that some rule could have are made: suffixes with
as many labels, prefixes with as many characters as rules have.  Both lists are
distinct small integers, so the expansion of a url stays small even for a host
of thousands of labels.  A page's expressions carry its row's number, under which its
rules meet again: nothing is dealt by url, so neither a frequent url nor null ones are
a key of many rows.  A rule table above ``BROADCAST_RULES`` rows is joined by shuffle,
its expressions salted by the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

BROADCAST_RULES = 100_000
SALTS = 16
#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds the full digest and its first 32 bits of (r_host, r_path)."""
    digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)  # null where a url has no expression
    return rows.withColumn("digest", digest).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", id_col: str = "page_id", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has verdict, host, path; a rule fits its host and all subdomains if
    the url's path starts with the rule's.  The longest host-and-path wins, then
    the longer host; where two rules have the same host and path, block wins.  No
    rule fits: rule null and verdict ``default``.

    Edge cases: urls that are null or lack ``://`` have empty host and path and fit
    no rule with a host; rules with a null host or path are left out; repeated
    pages come back as often; no other column of ``pages`` is read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("row_no", F.monotonically_increasing_id())
    usable = rules.where("host is not null and path is not null")
    shape = usable.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    # distinct small integers: no more of them than a host has labels, or a path characters
    known = shape.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars"), F.count("*").alias("n")).first()
    best_rules = _hashed(usable.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict")))
    best_rules = best_rules.select("short", F.col("digest").alias("r_digest"), F.col("r_host").alias("rule_host"), F.concat("r_host", "r_path").alias("rule"), "verdict")

    labels = F.split("host", r"\.")
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    suffixes = F.transform(F.filter(ints(known["labels"]), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.transform(F.filter(ints(known["chars"]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    own = ["row_no", "page_id", "host", "path"]
    expressions = _hashed(urls.select(*own, F.explode_outer(suffixes).alias("r_host")).select(*own, "r_host", F.explode_outer(prefixes).alias("r_path")))
    if known["n"] <= broadcast_rules:
        pairs = expressions.join(F.broadcast(best_rules), "short", "left")
    else:
        salted = expressions.withColumn("salt", F.pmod("row_no", F.lit(SALTS)))
        spread = best_rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        pairs = salted.join(spread, ["short", "salt"], "left")
    # the full digest confirms; of a row's rules the longest stays, on the map side first
    fits = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule"), F.length("rule_host"), "rule", "verdict"))
    out = pairs.groupBy("row_no").agg(*[F.first(c).alias(c) for c in own[1:]], F.max(fits).alias("won"))
    return out.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
       (SELECT r.host || r.path FROM r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
