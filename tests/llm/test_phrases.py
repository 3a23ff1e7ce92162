"""Phrase collocations against their SQL and brute force, and on odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2_000):
    """rows (lang, text) -> the rows of collocations, from the definition."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {p: n for p, n in f.items() if n >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), n in f.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if n >= f[lang, p[i : i + k]]}
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    ranks, got = Counter(), []
    for lang, score, a, p, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], p.decode(), -a, left, right, n, -score))
    return sorted(got)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op11_equals_its_sql(spark, same, sf):
    same(spark, sf, phrases.op11_phrase_collocations, phrases.OP11_SQL)


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2_000), (2, 3, 50)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], least, longest, top)
    assert rows_of(phrases.collocations(docs.repartition(3), least=least, longest=longest, top=top)) == want and len(want) > 100


def test_collocations_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "REMEMBERED", 50)
    word = "x" * 9_000
    texts = [None, "", " \t ", ".,;", "a", "A b", "a\tb", "a  b c", "a b. b c", "a b\x0bc d", "\xa0 \xa0 \xa0", "é É é É", "a a a a a a a", f"{word} {word}y {word} {word}y", "a b c d e f g h " * 3_000, "der der der", "a b c", "a b c", "　 b", "a b\nA B\r\na b"]
    rows = [(t, x) for t in texts for x in (None, "en", "und", "")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as k", "2 as n", "'z' as phrase", "3 as h", "4 as rank")
    for least in (1, 2, 5):
        assert rows_of(phrases.collocations(df, least=least)) == brute([(x, t) for t, x in rows], least)
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.filter("text = ' \t '"), least=1).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 10**16 + 3, 10**12 + 9, 10**12 + 39), (100, 10**16, 100, 100), (999_999_999_989, 9_007_199_254_740_993, 999_999_999_989, 1_000_000_000_039)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.scored(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in cases]


def test_places_and_bitmap(spark):
    words = phrases.Words(np.array([0, 8, 8, 15]), np.frombuffer(b"A b. c\tdxx y, z", dtype=np.uint8))
    assert [words.phrase(i, 1) for i in range(7)] == [b"a", b"b", b"c", b"d", b"xx", b"y", b"z"] and words.phrase(2, 2) == b"c d"
    assert words.runs(2, np.zeros(3, dtype=np.uint64))[1].tolist() == [True, False, True, False, True, False]
    bits = phrases.bitmap(spark.createDataFrame([(0,), (63,), (64,), (64,), (127,)], "at long"), 256)
    assert [k for k in range(256) if phrases.held(bits, np.array([k]))[0]] == [0, 63, 64, 127]
