"""URL filter by host suffixes and path prefixes, with DataFrame functions only.

Every distinct (host, path) is expanded into the host suffixes and path prefixes whose label counts and
lengths occur among the rules; the expressions meet the rules in an equi-join on the first 4 bytes of
their SHA-256, and the full digest confirms the match.  The longest rule wins; of equally long ones
(the same text), ``block`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PREFIX_HEX = 8


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table (verdict, rule_host, rule_path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; a null url or one without ``://`` has both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return pages.withColumns({"host": _lower_ascii(host), "path": path})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Returns page_id, url, host, path, rule, verdict for every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's.  Without a fitting
    rule, ``rule`` is null and the verdict is ``default``.  Rows that repeat are all judged; an empty
    table gives none; rules with a null part are ignored.
    """
    pages = with_host_and_path(pages.select("page_id", F.col("url").cast("string").alias("url")))
    digest = F.sha2(F.concat("host_part", F.lit("\n"), "path_part"), 256)
    rules = (
        rules.dropna()
        .select("verdict", F.col("rule_host").alias("host_part"), F.col("rule_path").alias("path_part"))
        .select("verdict", "host_part", "path_part", digest.alias("rule_digest"))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
        .withColumn("rule", F.concat("host_part", "path_part"))
    )
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host_part", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path_part")).alias("lengths"),
    )
    seen = pages.select("host", "path").distinct().crossJoin(F.broadcast(shapes))
    wide = (
        seen.withColumn("n", F.explode("labels"))
        .where(F.size(F.split("host", r"\.")) >= F.col("n"))
        .withColumn("host_part", F.expr("substring_index(host, '.', -n)"))
        .withColumn("m", F.explode("lengths"))
        .where(F.char_length("path") >= F.col("m"))
        .withColumn("path_part", F.expr("substring(path, 1, m)"))
        .select("host", "path", digest.alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    hits = wide.join(rules.select("short", "rule_digest", "rule", "verdict"), "short").where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("rule").alias("size"), (F.col("verdict") == "block").alias("block"), "rule")).alias("b")
    )
    best = best.select(
        "host", "path", F.col("b.rule").alias("rule"), F.when(F.col("b.block"), "block").otherwise("allow").alias("verdict")
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM q
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
