"""Quality rules against their SQL and brute force, and on odd rows and hosts."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import quality

SF = "/root/testdata/sf0.001"


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(runs)
    again = {k + j for k, r in enumerate(runs) if times[r] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_op13_equals_its_sql(spark, same):
    same(spark, SF, quality.op13_quality_rules, quality.OP13_SQL)


def test_op13_on_odd_rows(spark, same, tmp_path):
    long = " ".join(f"w{k % 700}" for k in range(20_000))
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a a a", "a a a a", "é é é é\n\né é é é\n é", "x y z", long, long + " end", "a b c d a b c\x0bd", "# # $ <a> |", "l\nl\nl \n\n\nl", " lead and  two"]
    rows = [(k % 14, t, s, "en", 1) for k, t in enumerate(texts) for s in ("p.org", None, "q.org")] + [(1, "again and again", "p.org", "en", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 as id", "2 as w", "3 as host", "4 as runs", "5 as n")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.op13_quality_rules(spark, str(tmp_path)).collect())
    assert got == sorted((r[0], *measured(r[1])) for r in rows)
    empty = df.limit(0)
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert quality.op13_quality_rules(spark, str(tmp_path / "none")).collect() == []


def test_hosts_are_rejected_by_shrunk_rates(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "good.org") for k in range(400)] + [(1_000 + k, good if k < 3 else good + " #" * 30, "bad.org") for k in range(40)]
    rows += [(2_000 + k, good, f"h{k}.org") for k in range(40)] + [(3_000, good + " #" * 30, "one.org"), (3_001, good, None), (3_002, "few words", None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[k]["kept"] and got[k]["host_rules"] == "symbols" and not got[k]["base_failed"] for k in range(1_000, 1_040))
    # a host of one failing row says little: it stays near the mean of all
    assert all(got[k]["kept"] for k in [*range(400), *range(2_000, 2_040), 3_000, 3_001]) and not got[3_002]["kept"]


def test_rates_are_posterior_means(spark):
    counts = [("a", "r", 100, 90), ("b", "r", 100, 10), ("c", "r", 1, 1), ("d", "q", 50, 5), ("e", "q", 50, 5)]
    got = {r["host"]: r["rate"] for r in quality.host_verdicts(spark.createDataFrame(counts, "host string, rule string, n long, k long")).collect()}
    mean = 101 / 201
    spread = 90 * 90 / 100 + 10 * 10 / 100 + 1 - 101 * mean
    strength = mean * (1 - mean) / ((spread - 2 * mean * (1 - mean)) / (201 - 20_001 / 201)) - 1
    strength = max(2.0, strength)
    want = {"a": (90 + mean * strength) / (100 + strength), "c": (1 + mean * strength) / (1 + strength), "d": 0.1}
    assert all(abs(got[h] - v) < 1e-9 for h, v in want.items())
    assert quality.host_verdicts(spark.createDataFrame([], "host string, rule string, n long, k long")).filter(F.col("rejected")).count() == 0
