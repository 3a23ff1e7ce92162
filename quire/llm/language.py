"""Language of each row by fusing what its text, its declared language, its address suffix and its host say."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, python_ready, table, working_for
from .shingles import blocks

#: The text model is fitted on about so many labelled rows of each language, by the hashes of their ids.
SAMPLE = 500
#: Most different labels; each has a table of PLACES in the model, which every task holds.
MOST_LANGUAGES = 500
#: Places of the table of hashed byte trigrams, and what is added to each count.
PLACES, ADDED = 1 << 15, 0.05
#: Trigrams after which a text's evidence no longer grows.
ENOUGH = 60
#: How often a declared language is right; how many rows the parent's distribution counts for in a host's or suffix'.
DECLARED_RIGHT, PARENT_ROWS = 0.9, 20.0
#: Least posterior, and least mean evidence a trigram over an even spread of all trigrams, of a row that is kept.
CONFIDENT, OVER_EVEN = 0.5, 0.0
#: Rows of a host table that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000


def _places(data: np.ndarray) -> np.ndarray:
    """The table place of the trigram that starts at each byte but the last two; A-Z is as a-z."""
    x = data.astype(np.uint32)
    x = x + 32 * ((x >= 65) & (x <= 90))
    return ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA77 + x[2:] * 0xC2B2AE3D) & 0xFFFFFFFF) >> 17


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, text) -> (label, place, n): trigrams of a task's texts by table place."""
    working_for("language")
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch["label"], batch["text"], strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            own = counts.setdefault(label, np.zeros(PLACES, dtype=np.int64))
            if len(data) > 2:
                own += np.bincount(_places(data), minlength=PLACES)
    for label, own in counts.items():
        place = np.flatnonzero(own)
        yield pd.DataFrame({"label": label, "place": place, "n": own[place]})


def fit(df: DataFrame, id_: Column, text: Column, label: Column) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probability of each table place in each language).

    The languages are all labels of all rows. Each is fitted on about SAMPLE of its rows, all if it has no more: those
    whose hashes of ids are in the share of all hashes that SAMPLE is of its rows, and those of the least hash. Their
    whole texts are read; a label whose sampled rows have no text has an even spread. Only counts reach the driver:
    PLACES for each language at most. More than MOST_LANGUAGES labels are an error.
    """
    labelled = df.select(F.xxhash64(id_.cast("string")).alias("h"), text.alias("text"), label.cast("string").alias("label")).filter("label is not null")
    share = F.lit(float(SAMPLE)) / F.count(F.lit(1))
    bound = labelled.groupBy("label").agg(F.min("h").alias("least"), F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).otherwise((1 << 63) - 1).alias("most"))
    bound = cut(bound.select("label", F.greatest("least", "most").alias("most")))
    names = sorted(r[0] for r in bound.select("label").limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels are no languages")
    rows = labelled.join(F.broadcast(bound), "label").filter("h <= most and text is not null").select("label", "text")
    got = rows.mapInPandas(_counts, "label string, place int, n long").groupBy("label", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(names), PLACES), ADDED)
    row = {name: k for k, name in enumerate(names)}
    counts[np.array([row[x] for x in got["label"].to_pylist()], dtype=np.int64), np.asarray(got["place"])] += np.asarray(got["n"])
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def scorer(model: np.ndarray):
    """A Pandas UDF: whole text -> mean log likelihood of its trigrams in each language, and then their number."""
    packed = model.astype(np.float32)

    @F.pandas_udf("array<double>")
    def score(text: pd.Series) -> pd.Series:
        import pyarrow as pa

        working_for("language")
        out = []
        for _, offsets, data in blocks(pa.Array.from_pandas(text, type=pa.string())):
            n = np.maximum(np.diff(offsets) - 2, 0)
            if len(data) < 3:
                out += [[*np.zeros(len(packed)), 0.0]] * len(n)
                continue
            places, total = _places(data), np.zeros(len(data) - 1)
            start = np.minimum(offsets[:-1], len(total) - 1)
            end = np.minimum(start + n, len(total) - 1)
            mean = np.empty((len(n), len(packed)))
            for k, own in enumerate(packed):  # one language at a time: sums of all would take eight bytes each for every byte of text
                np.cumsum(own[places], dtype=np.float64, out=total[1:])
                mean[:, k] = (total[end] - total[start]) / np.maximum(n, 1)
            out += np.concatenate([np.where(n[:, None] > 0, mean, 0), n[:, None]], axis=1).tolist()
        return pd.Series(out, index=text.index)

    return score


def smoothed(rows: DataFrame, names: list[str], key: str, parent: str | None) -> DataFrame:
    """(key, <key>_own, <key>_up): numbers of declared languages by key, and the distribution that they are drawn towards,
    the parent's, itself drawn towards the whole table's, and that towards an even one. All by grouped aggregation of all
    rows."""
    count = [F.sum(F.when(F.col("declared") == n, 1).otherwise(0)).cast("double") for n in names]
    own = rows.filter(F.col(key).isNotNull()).groupBy(key, *([parent] if parent else [])).agg(F.array(*count).alias("own"))
    even = F.array_repeat(F.lit(1.0 / max(1, len(names))), len(names))
    whole = rows.groupBy().agg(F.array(*count).alias("all")).select(_draw(F.col("all"), even).alias("up"))
    if parent:
        above = rows.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.array(*count).alias("above")).crossJoin(F.broadcast(whole)).select(parent, _draw(F.col("above"), F.col("up")).alias("closer"))
        own = own.join(above, parent, "left")
    own = own.crossJoin(F.broadcast(whole))  # one row
    up = F.coalesce("closer", "up") if parent else F.col("up")
    return own.groupBy(key).agg(F.first("own").alias(f"{key}_own"), F.first(up).alias(f"{key}_up"))


def _draw(own: Column, up: Column) -> Column:
    rows = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, up, lambda c, p: (c + PARENT_ROWS * p) / (rows + PARENT_ROWS))


def identify(df: DataFrame, id_col: str, text_col: str, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, label: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """-> (keep or id_col..., language, confidence, declared, accepted), a row for each row of df.

    The posterior of a language is, up to a factor, the product of: the likelihood of the text's byte trigrams, taken
    as ENOUGH trigrams at most; the chance of the declared language, which is right DECLARED_RIGHT of the time; and the
    prior of the host, a smoothed distribution of the declared languages of all its other rows, drawn towards that of
    its suffix, and that towards the whole table's; so a row's own declared language counts once, as evidence. The languages are all labels
    (declared, if none are given) of all rows, the model is fitted on about SAMPLE rows of each; counts cover all rows.

    accepted: the text has a trigram, the posterior is CONFIDENT or more, and the text is likelier in the language than
    under an even spread of trigrams (so it is no noise). Null, empty or very short text: judged by the other evidence,
    not accepted. Null evidence says nothing; a declared language that the model does not know neither. A table without
    labels, or an empty one, has language null and accepted false. Ties take the first language in order. Rows that
    repeat are judged alike. Internal columns have names of their own, so other columns may have any.
    """
    spark = df.sparkSession
    python_ready(spark)
    nothing = F.lit(None).cast("string")
    columns = keep or [id_col]
    label = declared if label is None else label
    names, model = fit(df, F.col(id_col), F.col(text_col), label) if label is not None else ([], None)
    rows = df.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text"), (nothing if declared is None else declared).alias("declared"), (nothing if host is None else host).alias("host"), (nothing if suffix is None else suffix).alias("suffix"))
    if not names:
        return rows.select("row.*", nothing.alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("accepted"))
    rows = rows.select("row", "declared", "host", "suffix", scorer(model)(F.col("text")).alias("score"))
    evidence = df.select((nothing if declared is None else declared).alias("declared"), (nothing if host is None else host).alias("host"), (nothing if suffix is None else suffix).alias("suffix"))
    for key, parent, given in (("host", "suffix" if suffix is not None else None, host), ("suffix", None, suffix)):
        if given is None:
            rows = rows.withColumn(f"{key}_own", F.lit(None).cast("array<double>")).withColumn(f"{key}_up", F.lit(None).cast("array<double>"))
            continue
        prior = smoothed(evidence, names, key, parent)
        few = evidence.select(key).distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(prior) if few else prior, key, "left")
    k = len(names)
    known = F.coalesce(F.col("declared").isin(names), F.lit(False))
    said = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.when(~known, F.lit(0.0)).when(n == F.col("declared"), F.lit(math.log(DECLARED_RIGHT))).otherwise(F.lit(math.log((1 - DECLARED_RIGHT) / max(1, k - 1)))))
    flat = F.array_repeat(F.lit(0.0), k)
    weight = F.least(F.element_at("score", -1), F.lit(float(ENOUGH)))
    own = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(n == F.col("declared"), F.lit(False)).cast("double"))
    prior = lambda key: F.transform(_draw(F.zip_with(f"{key}_own", own, lambda n, o: n - o), F.col(f"{key}_up")), lambda p: F.log(p))
    total = F.zip_with(F.zip_with(F.slice("score", 1, k), said, lambda a, b: a * weight + b), F.coalesce(prior("host"), prior("suffix"), flat), lambda a, b: a + b)
    rows = rows.withColumn("total", total).withColumn("best", F.array_position("total", F.array_max("total")).cast("int"))
    confidence = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("total")))
    language = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("best"))
    accepted = (F.element_at("score", -1) > 0) & (confidence >= CONFIDENT) & (F.element_at("score", F.col("best")) > -math.log(PLACES) + OVER_EVEN)
    return rows.select("row.*", language.alias("language"), F.round(confidence, 9).alias("confidence"), "declared", accepted.alias("accepted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: declared language lang, host source."""
    return identify(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"), F.col("source"))


def op9_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: declared language of the markup, address suffix and host of the URL, text without markup."""
    from .url_filter import host

    url = host(F.col("url"))
    df = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ").alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1).alias("markup"))
    return identify(df, "page_id", "text", F.nullif(F.lower("markup"), F.lit("")), F.nullif(url, F.lit("")), F.nullif(F.regexp_extract(url, r"([^.:]+)(:\d*)?$", 1), F.lit("")))
