"""URL rules by expressions of host suffix and path prefix, joined on short hash prefixes and confirmed by digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Hexadecimal digits of the digest that the join uses.
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without :// empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """-> (id_col, host, path, rule, verdict): a row for each row of df.

    rules: (verdict, host, path). A rule fits its host and all subdomains, if the path starts with the rule's; the
    longest host + path wins, then the greater in order; of equal rules block wins. No rule: null and the default.

    Each distinct (host, path) is expanded to the host suffixes with as many labels as some rule has and the path
    prefixes as long as some rule's, so the number of expressions depends on the rules' shapes, not on the address.
    Expressions meet the rules by an equi-join on the first digits of their SHA-256; the whole digest confirms. A host
    that a third of all rows have is many distinct paths; an address that a third of all rows have is one row here and
    meets its rows again in a join that adaptive execution splits.

    A null URL, or one without ://, has an empty host and path and gets the default. Rows that repeat keep a row each.
    Rules with a null part are ignored. Other columns of df are not read.
    """
    # the numbers of labels and the path lengths that occur in rules: two short lists, whatever the number of rules
    rules = rules.dropna(subset=["verdict", "host", "path"]).select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    own = rules.select(F.concat("rule_host", "rule_path").alias("rule"), "verdict").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    own = own.withColumn("rule_digest", F.sha2(F.col("rule").cast("binary"), 256)).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))

    seen = df.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    one = seen.select("host", "path").distinct()
    labels = F.array(*[F.lit(n) for n in sorted(shape["labels"])]) if shape["labels"] else F.array().cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(F.split("host", r"\."))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    spread = one.select("host", "path", F.explode(both).alias("expression"))
    spread = spread.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    hits = spread.join(own, "prefix").filter("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), F.col("rule"), F.col("verdict"))).alias("best"))
    judged = seen.join(best, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP10_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.*, r.verdict AS v, r.h || r.p AS fit FROM p LEFT JOIN r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.p))
SELECT page_id, host, path, max_by(fit, length(fit)) AS rule, coalesce(max_by(v, length(fit)), 'allow') AS verdict FROM f GROUP BY page_id, host, path
"""
