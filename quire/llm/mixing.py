"""Mixing sources to target weights: raking of token weights to marginals, then calibrated sampling of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, few, table

#: A dimension's target shares are its token counts to this power, scaled to 1: below 1 evens out, 1 keeps.
TEMPER = {"source": 0.5, "lang": 0.8, "topic": 1.0}
#: Part of all tokens to keep in expectation, rounds of raking, and what makes samples differ.
KEEP, ROUNDS, SEED = 0.7, 6, "mix-1"
#: Scales that are tried at once in the search of the one that keeps KEEP of the tokens; it is searched twice, and on
#: while the expected part of all tokens is below KEEP by more than TOLERANCE.
GRID, TOLERANCE = 64, 0.001
#: Longs that one dimension of a cell takes, its value, target and weight, when few cells are told.
LONGS = 8
#: Rows of the table of cells that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def topic(text: Column) -> Column:
    """The kind of content, by marks that stand in the text."""
    return F.when(text.contains(" | "), "table").when(text.contains("\n- "), "list").when(text.contains("{") | text.contains(";"), "code").otherwise("prose")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def chance(id_: Column, seed: str = SEED) -> Column:
    """An even number in [0, 1) that depends on the id and the seed only."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, dims: list[str], tempers: Mapping[str, float], rounds: int = ROUNDS) -> DataFrame:
    """cells (dims..., base) -> (dims..., base, w): w has, in every dimension, the target shares of the total of base.

    Iterative proportional fitting: each step scales the weights of a value's cells by target over present sum. Sums
    are grouped aggregations; nothing but the number of cells grows with the input. Few cells (common.FEW_BYTES) stand
    in one partition, where a sum is a window, so a round is one task without joins, exchanges or broadcasts; more keep
    partitions of their own, are joined with their sums, and checkpointed step by step, as a step's plan holds the one
    before twice. No dimension is null.
    """
    rows, held = few(cells, LONGS * len(dims))
    one = held is not rows
    cells = rows.withColumn("w", F.col("base"))
    for d in dims:
        t = cells.groupBy(d).agg(F.sum("base").alias("b")).withColumn("power", F.pow("b", F.lit(tempers[d])))
        powers, total = t.agg(F.sum("power"), F.sum("b")).first()
        target = F.lit(total) * F.pow("sum", F.lit(tempers[d])) / F.lit(powers)
        cells = _with_sum(cells, d, "base", one).withColumn(f"target_{d}", target).drop("sum")
        cells = cells if one else cut(cells)
    for _ in range(rounds):
        for d in dims:
            cells = _with_sum(cells, d, "w", one).withColumn("w", F.col("w") * (F.col(f"target_{d}") / F.col("sum"))).drop("sum")
            cells = cells if one else cut(cells)
        cells = cut(cells).coalesce(1) if one else cells
    return cells.select(*dims, "base", "w")


def _with_sum(cells: DataFrame, d: str, of: str, one: bool) -> DataFrame:
    """cells with the sum of a column over all of the same value of d; one: they stand in one partition."""
    if one:
        return cells.withColumn("sum", F.sum(of).over(Window.partitionBy(d)))
    return cells.join(cells.groupBy(d).agg(F.sum(of).alias("sum")), d)


def calibrated(cells: DataFrame, dims: list[str], keep: float = KEEP) -> DataFrame:
    """(dims..., base, w) -> (dims..., p): p = min(1, scale * w / base), scale such that keep of all tokens is expected.

    The scale is the largest of a grid that keeps no more, refined once at least, and on until what it keeps is within
    TOLERANCE of all tokens; each search is one aggregation. Where p meets 1, a value falls short of its target, as documents are not repeated.
    """
    low, high = 0.0, None
    rated = cells.withColumn("r", F.col("w") / F.col("base"))
    total, least = rated.agg(F.sum("base"), F.min("r")).first()
    if not total:
        return rated.select(*dims, F.lit(1.0).alias("p"))
    high = 1.0 / least  # keeps all
    turn, kept = 0, 0.0
    while turn < 2 or kept < (keep - TOLERANCE) * total:
        step = (high - low) / GRID
        if low + step == low:  # no number lies between
            break
        sums = rated.agg(F.array(*[F.sum(F.least(F.lit(1.0), F.col("r") * F.lit(low + step * k)) * F.col("base")) for k in range(GRID + 1)])).first()[0]
        k = max([i for i, s in enumerate(sums) if s <= keep * total], default=0)
        low, high, kept, turn = low + step * k, low + step * (k + 1), sums[k], turn + 1
    return rated.select(*dims, F.least(F.lit(1.0), F.col("r") * F.lit(low)).alias("p"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: Mapping[str, Column] | None = None, tempers: Mapping[str, float] | None = None, keep: float = KEEP, columns: list[str] | None = None) -> DataFrame:
    """-> (columns or id_col, the dimensions, tokens, probability, kept): a row for each row of df.

    Token weights of the cells (one for each combination of the dimensions' values) are raked to the target marginals,
    and each document is kept with its cell's calibrated probability, by a number that depends on its id only: equal
    ids are kept alike. Documents without tokens (null or blank text) have probability 1.

    Null values of a dimension are a value. A null id is an id. An empty table has no rows. Internal columns have names
    of their own, so other columns may have any.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.coalesce(F.col(text_col), F.lit("")))}
    tempers = tempers or TEMPER
    names = list(dims)
    rows = df.select(F.struct(*(columns or [id_col])).alias("row"), F.col(id_col).alias("id"), *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(f"dim_{d}") for d, c in dims.items()], tokens(F.col(text_col)).alias("tokens"))
    own = [f"dim_{d}" for d in names]
    cells = rows.filter("tokens > 0").groupBy(*own).agg(F.sum("tokens").cast("double").alias("base"))
    p = calibrated(rake(cells, own, {f"dim_{d}": tempers[d] for d in names}), own, keep)
    p = cut(p)
    out = rows.join(F.broadcast(p) if p.count() <= BROADCAST_ROWS else p, own, "left")
    p = F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(1.0))).otherwise(F.lit(1.0))
    return out.select("row.*", *[F.when(F.col(f"dim_{d}") != "", F.substr(F.col(f"dim_{d}"), F.lit(2))).alias(f"mix_{d}") for d in names], "tokens", F.round(p, 6).alias("probability"), (chance(F.col("id")) < p).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    dims = list(TEMPER)
    out = [f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), chr(10) || '- ') THEN 'list'
    WHEN contains(coalesce(text, ''), '{{') OR contains(coalesce(text, ''), ';') THEN 'code' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS base, CAST(sum(tokens) AS DOUBLE) AS w FROM d WHERE tokens > 0 GROUP BY ALL)"""]
    for x in dims:
        out.append(f"t_{x} AS MATERIALIZED (SELECT {x}, sum(b) OVER () * pow(b, {TEMPER[x]}) / sum(pow(b, {TEMPER[x]})) OVER () AS target FROM (SELECT {x}, sum(base) AS b FROM w0 GROUP BY 1))")
    n = 0
    for _ in range(ROUNDS):
        for x in dims:
            out.append(f"w{n + 1} AS MATERIALIZED (SELECT w{n}.* REPLACE (w * target / sum(w) OVER (PARTITION BY w{n}.{x}) AS w) FROM w{n} JOIN t_{x} ON w{n}.{x} IS NOT DISTINCT FROM t_{x}.{x})")
            n += 1
    out.append(f"r AS MATERIALIZED (SELECT source, lang, topic, base, w / base AS r FROM w{n})")
    out.append("s0 AS (SELECT 0.0::DOUBLE AS low, 1.0 / min(r) AS high, sum(base) AS total FROM r)")
    for k in (0, 1):
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT low + step * k AS low, low + step * (k + 1) AS high, total FROM (SELECT any_value(low) AS low, any_value((high - low) / {GRID}) AS step, k, any_value(total) AS total, sum(least(1.0, r * (low + (high - low) / {GRID} * k)) * base) AS s FROM s{k}, r, range({GRID + 1}) g(k) GROUP BY k) WHERE s <= {KEEP} * total OR k = 0 ORDER BY k DESC LIMIT 1)")
    return ",\n".join(out) + f"""
SELECT doc_id, d.source AS mix_source, d.lang AS mix_lang, d.topic AS mix_topic, tokens, round(p, 6) AS probability, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM (SELECT d.*, CASE WHEN tokens > 0 THEN least(1.0, r * low) ELSE 1.0 END AS p FROM d LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic LEFT JOIN s2 ON true) d"""


OP5_SQL = _sql()
