"""URL rules by expression lookup.

Each URL becomes a set of expressions - every suffix of its host that has as many labels as some rule's host, joined
with every prefix of its path that has the length of some rule's path. Expressions meet the rules in an equi-join on the
first eight hex digits of their SHA-256; the full digest then confirms the match, and the longest rule wins (of equally
long ones: block). Only hits are gathered by URL; hosts and paths are written once with a number for each row.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule. Repeated rows are
judged one by one. Without rules, or where none fits, the verdict is the default and the rule null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, table, written

#: The rules of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path of a URL column."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), A_Z, a_z)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict. rules: verdict, host, path.

    The lengths of the rules' paths and the numbers of labels of their hosts are gathered on the driver: as many numbers
    as there are different ones, so at most the length of the longest rule. Rules of up to 64 MB are broadcast, more are
    joined by a shuffle.
    """
    rules = rules.select(F.col("verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).dropna().distinct()
    rules = rules.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_path").alias("path_length"), F.size(F.split("rule_host", r"\.")).alias("labels"))
    rules = rules.withColumn("digest", F.sha2("rule", 256))
    distinct = [F.sort_array(F.collect_set(c)).alias(c) for c in ("path_length", "labels")]
    shape = rules.agg(*distinct, F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("rule")), F.lit(0)).alias("width")).first()
    host, path = split_url(F.col("url"))
    urls = written(spark, pages.select("page_id", F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")))
    labels = F.split("host", r"\.")
    numbers = lambda values, most: F.filter(F.array(*map(F.lit, values)).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(numbers(shape.labels, F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.transform(numbers(shape.path_length, F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    each = urls.select("row", F.explode(F.array_distinct(expressions)).alias("expression")).withColumn("found", F.sha2("expression", 256))
    known = bounded(rules.drop("path_length", "labels").withColumn("prefix", F.substring("digest", 1, 8)), shape.n, 200 + 2 * shape.width)
    hits = each.withColumn("prefix", F.substring("found", 1, 8)).drop("expression").join(known, "prefix").filter(F.col("found") == F.col("digest"))
    best = hits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("first"), F.col("rule"), F.col("verdict"))).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    """RULES as a table of literals."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(verdict, host, path)")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"), contract_rules(spark))


OP7_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""
