"""Quality rules by document and by host: rule failures are counted for each host, their rates shrunk towards an
empirical beta prior, and hosts whose shrunk rate is too high are rejected with all their documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, table

#: Rules by document: least words, and the largest share (percent) of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Rules that only hosts are judged by: largest symbols, and lines that repeat, a hundred words and lines; range of the
#: mean number of characters a word, in tenths.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_CHARS = 10, 50, (20, 150)
RULES = ("short", "repeated", "symbols", "dup_lines", "word_chars")
#: A host is rejected if the shrunk rate of a rule's failures is over HOST_LIMIT.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents; the upper one also stands where hosts differ by chance only.
STRENGTH = (2.0, 1000.0)
#: Longs that a rejected host and its rules are taken for where it is asked whether they are few.
HOST_LONGS = 40

_GAP, _WORD, _SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def measures(df: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """-> (id_col, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row for each row of df.

    Everything is an expression over one row's arrays, so no text is shuffled. Windows of words are told apart by 64
    bits of hash: two different ones of a text of n words are taken for one with a chance of n * n / 2^65. Null texts
    have no words. Other columns of df are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), host.alias("host"), text.alias("text"))
    own = own.select(
        "id", "host", F.array_remove(F.split("text", _GAP), "").alias("w"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(_WORD)).alias("lines"),
    )
    count = lambda c: F.size(c).cast("long")
    own = own.select("id", "host", "w", "n_symbols", count("w").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), (count("lines") - count(F.array_distinct("lines"))).alias("n_dup_lines"))
    starts = F.when(F.col("n_words") >= WINDOW, F.slice("w", F.lit(1), F.size("w") - (WINDOW - 1))).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("runs", F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, WINDOW)])))
    # only texts with a window twice are sorted with places
    own = own.withColumn("places", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.sort_array(F.transform("runs", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    twice = F.filter("places", lambda p, k: (p["h"] == F.get("places", k - 1)["h"]) | (p["h"] == F.get("places", k + 1)["h"]))
    own = own.withColumn("twice", F.sort_array(F.transform(twice, lambda p: p["k"])))
    # a window's words that the next one does not begin with, and all of the last's
    covered = F.aggregate(F.transform("twice", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return own.select(F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """Whether a document, by its measures, fails each rule."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": n < LEAST_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * n,
        "word_chars": (10 * chars < WORD_CHARS[0] * n) | (10 * chars > WORD_CHARS[1] * n),
    }


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, rule, n, k): documents and failures -> + rate, rejected.

    For each rule a beta prior is fitted to the hosts' rates by moments, weighted by documents: its mean is the rate of
    all documents, its strength what the spread over hosts beyond chance tells, within STRENGTH. rate is the posterior
    mean, (k + mean * strength) / (n + strength): few documents leave it near the mean.
    """
    d = lambda c: F.col(c).cast("double")
    fit = counts.groupBy("rule").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all"), F.sum("k").alias("failed"), F.sum(d("n") * d("n")).alias("squares"), F.sum(d("k") * d("k") / d("n")).alias("spread"))
    mean = d("failed") / d("all")
    chance = mean * (1 - mean)
    beyond = (d("spread") - d("failed") * mean - (d("hosts") - 1) * chance) / F.nullif(d("all") - d("squares") / d("all"), F.lit(0.0))
    strength = F.when(beyond > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), chance / beyond - 1))).otherwise(STRENGTH[1])
    fit = fit.select("rule", mean.alias("mean"), strength.alias("strength"))
    rate = (d("k") + F.col("mean") * F.col("strength")) / (d("n") + F.col("strength"))
    return counts.join(F.broadcast(fit), "rule").withColumn("rate", rate).withColumn("rejected", F.col("rate") > limit).drop("mean", "strength")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """-> (id_col, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rules, kept), a
    row for each row of df.

    base_failed: too few words, or too many in repeated windows. host_rules: the rules that reject the row's host, comma
    separated, else null. kept: neither. A row without host is judged by itself alone. The measures, a few numbers a
    row, are written once; failures are summed by host and rule before they are shuffled, so a host with a third of all
    rows is a row a task there, and the join back is with rejected hosts only: while these are few (common.FEW_BYTES) they are
    broadcast and no row moves, beyond that adaptive execution splits a host's rows. Empty tables give no rows; repeated rows count each.
    """
    seen = cut(measures(df, id_col, text_col, F.col("source") if host is None else host))
    fails = failures()
    told = seen.filter("host is not null").select("host", *[c.cast("long").alias(r) for r, c in fails.items()])
    by_host = told.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in RULES])
    counts = by_host.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("c")).select("host", "n", "c.rule", "c.k")
    bad = host_verdicts(cut(counts), limit).filter("rejected").groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("host_rules"))
    _, bad = few(bad, HOST_LONGS)
    base = reduce(lambda a, b: a | b, (fails[r] for r in ("short", "repeated")))
    out = seen.join(bad, "host", "left").withColumn("base_failed", base)
    return out.select(id_col, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rules", (~F.col("base_failed") & F.col("host_rules").isNull()).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents judged by rules and by their source."""
    return judge(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT row, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
t AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS times FROM g),
c AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS j) WHERE times > 1 GROUP BY row),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (row)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
             [n_words < {LEAST_WORDS}, 100 * n_repeat_words > {MOST_REPEATED} * n_words, 100 * n_symbols > {MOST_SYMBOLS} * n_words, 100 * n_dup_lines > {MOST_DUP_LINES} * n_words, 10 * word_chars < {WORD_CHARS[0]} * n_words OR 10 * word_chars > {WORD_CHARS[1]} * n_words] AS failed FROM m),
k AS (SELECT host, j AS rule, count(*)::DOUBLE AS n, count(*) FILTER (failed[j])::DOUBLE AS k FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS j) WHERE host IS NOT NULL GROUP BY ALL),
p AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(k) AS k, sum(k) / sum(n) AS mean, sum(n * n) AS squares, sum(k * k / n) AS spread FROM k GROUP BY rule),
b AS (SELECT rule, mean, (spread - k * mean - (hosts - 1) * mean * (1 - mean)) / nullif(n - squares / n, 0) AS beyond FROM p),
s AS (SELECT rule, mean, CASE WHEN beyond > 0 THEN greatest({STRENGTH[0]}, least({STRENGTH[1]}, mean * (1 - mean) / beyond - 1)) ELSE {STRENGTH[1]} END AS strength FROM b),
r AS (SELECT host, string_agg(['short', 'repeated', 'symbols', 'dup_lines', 'word_chars'][rule], ',' ORDER BY ['short', 'repeated', 'symbols', 'dup_lines', 'word_chars'][rule]) AS host_rules FROM k JOIN s USING (rule) WHERE (k + mean * strength) / (n + strength) > {HOST_LIMIT} GROUP BY host)
SELECT doc_id, f.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rules, NOT base_failed AND host_rules IS NULL AS kept FROM f LEFT JOIN r ON r.host = f.host
"""
