"""Phrases whose words keep together: frequent runs of words are counted length by length, each pass also counting the
runs one word longer by hash buckets, so that the next pass counts only what can still be frequent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_ROWS, FILTER_BITS_MAX, cut, python_ready, table
from .shingles import blocks, mix

#: Occurrences that make a phrase a candidate, its most words, and the phrases of a language that are returned.
LEAST, LONGEST, TOP = 100, 5, 2_000
#: Buckets of the next length's runs, and how many stand in a row of counts. A bitmap of them is broadcast: 256 KB.
BUCKETS, WIDE = 1 << 21, 8
#: Different phrases that a task remembers before it gives out their counts; rows of a batch that it gives out.
REMEMBERED, OUT_ROWS = 400_000, 20_000

_U = np.uint64
_random = np.random.default_rng(11)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_NTH = _random.integers(0, 1 << 63, LONGEST + 1, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_FAR = 1 << 12
_PLACE = mix(np.arange(1, _FAR + 1, dtype=np.uint64) * _STEP) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in words, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
PHRASE, BUCKET, WORDS = 0, 1, 2
_OUT = pa.schema([("kind", pa.int16()), ("lang", pa.string()), ("phrase", pa.binary()), ("h", pa.int64()), *[(f"n{k}", pa.int64()) for k in range(WIDE)]])
_SCHEMA = "kind short, lang string, phrase binary, h long, " + ", ".join(f"n{k} long" for k in range(WIDE))


@lru_cache(maxsize=4_096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Words:
    """The words of a run of texts: where they start and end, the text and the piece of each, and a hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n = len(data)
        self.data = _LOWER[data]
        kind = _CLASS[data]
        word = kind == 0
        edge = np.zeros(n + 1, dtype=bool)  # a text ends before this byte
        edge[offsets] = True
        start, last = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum((kind == 2) | edge[:-1])[self.starts]
        if len(self.starts):
            place = np.arange(n) - self.starts[np.maximum(np.cumsum(start), 1) - 1]
            place[~word] = 0
            far = (place // _FAR).astype(np.uint64) * _STEP * _U(2) if place.max() >= _FAR else _U(0)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * (_PLACE[place % _FAR] + far), out=total[1:])
            self.hashes = mix(total[self.ends] - total[self.starts] + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)

    def runs(self, k: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words from each word on, and whether these stand in one piece."""
        n = max(0, len(self.starts) - k + 1)
        h = sum((self.hashes[j : n + j] * _NTH[j] for j in range(1, k)), self.hashes[:n] * _NTH[0])
        return mix(h + salts[self.text[:n]] + _NTH[k]), self.piece[:n] == self.piece[k - 1 : n + k - 1]

    def phrase(self, i: int, k: int) -> bytes:
        own = self.data[self.starts[i] : self.ends[i + k - 1]].tobytes()
        return b" ".join(own.replace(b"\t", b" ").split()) if k > 1 else own


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h & _U(BUCKETS - 1)).astype(np.int64)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places of a bitmap of 64-bit words are set."""
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) != 0


class Tally:
    """Counts of phrases by hash, with a phrase and its language for each."""

    def __init__(self) -> None:
        self.known, self.slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.counts, self.phrases, self.langs, self.hashes = np.zeros(0, dtype=np.int64), [], [], []

    def add(self, words: Words, k: int, at: np.ndarray, hashes: np.ndarray, langs: list[str]) -> None:
        new, first, times = np.unique(hashes, return_index=True, return_counts=True)
        place = np.searchsorted(self.known, new)
        old = np.zeros(len(new), dtype=bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == new[inside]
        self.counts[self.slot[place[old]]] += times[old]
        fresh = np.flatnonzero(~old)
        if len(fresh):
            self.known = np.insert(self.known, place[fresh], new[fresh])
            self.slot = np.insert(self.slot, place[fresh], len(self.phrases) + np.arange(len(fresh)))
            self.counts = np.concatenate([self.counts, times[fresh]])
            where = at[first[fresh]]
            self.phrases += [words.phrase(i, k) for i in where.tolist()]
            self.langs += [langs[t] for t in words.text[where].tolist()]
            self.hashes.append(new[fresh])

    def out(self) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([*self.hashes, np.zeros(0, dtype=np.uint64)]).view(np.int64)
        for a in range(0, len(self.phrases), OUT_ROWS):
            n = len(hashes[a : a + OUT_ROWS])
            zero = pa.array(np.zeros(n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, PHRASE, dtype=np.int16)), pa.array(self.langs[a : a + OUT_ROWS], pa.string()), pa.array(self.phrases[a : a + OUT_ROWS], pa.binary()), pa.array(hashes[a : a + OUT_ROWS]), pa.array(self.counts[a : a + OUT_ROWS]), *[zero] * (WIDE - 1)], schema=_OUT)
        self.__init__()


def counted(texts: DataFrame, k: int, longest: int, frequent: Broadcast | None, buckets: Broadcast | None) -> DataFrame:
    """(lang, text) -> a task's counts of the runs of k words, rows of kind PHRASE, and of the runs of k + 1 words by
    bucket, WIDE buckets a row of kind BUCKET; at k = 1 also of all words of a language, kind WORDS.

    A run of k words is counted if the runs of its first and of its last k - 1 words may be frequent and its bucket is;
    a longer one if its two runs of k words are counted. frequent and buckets are bitmaps of bounded size. They let
    more through than is frequent, never less, so counts of frequent runs are whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, waiting, waits = Tally(), [], 0
        seen = np.zeros(BUCKETS, dtype=np.int64)
        total: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            salts = np.array([_salt(x) for x in langs], dtype=np.uint64)
            for row, offsets, data in blocks(batch.column(1)):
                words = Words(offsets, data)
                own, salt = langs[row : row + len(offsets) - 1], salts[row : row + len(offsets) - 1]
                h, ok = words.runs(k, salt)
                if frequent is not None:
                    part, _ = words.runs(k - 1, salt)
                    alive = held(frequent.value, ((part >> _U(32)) & _U(64 * len(frequent.value) - 1)).astype(np.int64))
                    ok &= alive[:-1] & alive[1:]
                if buckets is not None:
                    ok &= held(buckets.value, bucket_of(h))
                at = np.flatnonzero(ok)
                tally.add(words, k, at, h[at], own)
                if k == 1:
                    for t, n in enumerate(np.bincount(words.text, minlength=len(own)).tolist()):
                        total[own[t]] = total.get(own[t], 0) + n
                if k < longest:
                    longer, whole = words.runs(k + 1, salt)
                    waiting.append(bucket_of(longer[whole & ok[:-1] & ok[1:]]))
                    waits += len(waiting[-1])
                    if waits >= BUCKETS:
                        seen += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                        waiting, waits = [], 0
                if len(tally.phrases) >= REMEMBERED:
                    yield from tally.out()
        yield from tally.out()
        if waiting:
            seen += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        rows = seen.reshape(-1, WIDE)
        some = np.flatnonzero(rows.any(axis=1))
        for a in range(0, len(some), OUT_ROWS):
            own = some[a : a + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), BUCKET, dtype=np.int16)), pa.nulls(len(own), pa.string()), pa.nulls(len(own), pa.binary()), pa.array(own), *[pa.array(np.ascontiguousarray(rows[own, j])) for j in range(WIDE)]], schema=_OUT)
        if total:
            yield pa.RecordBatch.from_pylist([{"kind": WORDS, "lang": x, "n0": n} | {f"n{j}": 0 for j in range(1, WIDE)} for x, n in total.items()], schema=_OUT)

    return texts.mapInArrow(count, _SCHEMA)


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A column of places below bits -> a bitmap of 64-bit words, bits / 8 bytes whatever the number of rows."""
    at = places.columns[0]
    got = places.groupBy(F.shiftright(at, 6).alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63L as int)))").alias("held")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("id").to_numpy()] = got.column("held").to_numpy()
    return out.view(np.uint64)


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """-> (lang, phrase, k, f) of every run of up to `longest` words that a language has `least` times or more, and
    (lang, n), all its words.

    Words are what spaces and tabs part within the pieces between . , ; : ! ? and line ends, A-Z lower-cased. Whole texts
    are read, once for each length. Tasks give out sums, so no word, however frequent, is more than a row a task. Runs are
    told apart by 64 bits of hash within a task (two of a million different ones are taken for one with a chance of 3 in
    100 million) and by their text everywhere else.
    """
    spark = df.sparkSession
    python_ready(spark)
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    levels, totals, frequent, buckets = [], None, None, None
    for k in range(1, longest + 1):
        sums = counted(texts, k, longest, frequent, buckets).groupBy("kind", "lang", "phrase", "h").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(WIDE)])
        enough = reduce(lambda a, b: a | b, (F.col(f"n{j}") >= least for j in range(WIDE)))
        found = cut(sums.filter((F.col("kind") == WORDS) | enough))
        if k == 1:
            totals = found.filter(F.col("kind") == WORDS).select("lang", F.col("n0").alias("n"))
        own = found.filter(F.col("kind") == PHRASE)
        levels.append(own.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), F.col("n0").alias("f")))
        number = own.count()
        if k == longest or not number:
            break
        bits = max(1 << 16, min(FILTER_BITS_MAX, 1 << (16 * number - 1).bit_length()))
        frequent = spark.sparkContext.broadcast(bitmap(own.select((F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))).alias("at")), bits))
        some = found.filter(F.col("kind") == BUCKET).select(F.explode(F.array(*[F.when(F.col(f"n{j}") >= least, F.col("h") * WIDE + j) for j in range(WIDE)])).alias("at")).filter("at is not null")
        buckets = spark.sparkContext.broadcast(bitmap(some, BUCKETS))
    return reduce(DataFrame.union, levels), totals


def scored(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits: exact while the products stay below 10^38."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(20,0)") * n.cast("decimal(17,0)"), wide(left) * wide(right))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """-> (lang, rank, phrase, a, l, r, n, score): phrases of two words or more, by how much more often they stand together
    than their parts would by chance, at the cut where that is least.

    A phrase is left out if a longer frequent one holds all its occurrences. Ranks are by score and a, the larger first,
    then by the phrase's bytes; top ranks of a language are returned, all if None. Null texts are empty, a null language
    is und; repeated rows count each; an empty table gives no rows. Other columns of df are not read.
    """
    phrases, totals = frequent_phrases(df, text_col, lang_col, least, longest)
    phrases = cut(phrases)
    words = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    long = phrases.filter("k > 1").withColumn("words", words)
    # occurrences of a part are never fewer, so a longer phrase with as many is one word longer or has such a one inside
    inside = long.filter("k > 2").select("lang", F.explode(F.array(piece(1, F.col("k") - 1), piece(2, F.col("k") - 1))).alias("phrase"), "f").distinct()
    cuts = long.join(inside, ["lang", "phrase", "f"], "left_anti").select("lang", "phrase", F.col("f").alias("a"), "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", piece(1, F.col("at")).alias("left"), piece(F.col("at") + 1, F.col("k") - F.col("at")).alias("right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumn("score", scored(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("m"))
    out = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank.cast("long"))
    return (out if top is None else out.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = f.lang AND x.k > f.k AND x.f >= f.f AND contains(' ' || x.phrase || ' ', ' ' || f.phrase || ' '))),
s AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c),
t AS (SELECT s.lang, s.phrase, s.a, j, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * s.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM s JOIN n USING (lang)
      JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
