"""Fingerprints of whole texts from prefix polynomial hashes, and the likeness of two of them."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table

#: Two hashes modulo this prime, with these bases, make one of 62 bits.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525)
#: Most samples of the prefix array, and of the suffix array, in a fingerprint.
SAMPLES = 32
#: Code points whose hash marks a border of spans, where it is the least of as many as REACH to either side.
WINDOW, REACH = 8, 8
#: Most code points of a span.
LONGEST = 256
_U = np.uint64
_MARKS = [_U(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, WINDOW + 1)]
_up = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_up[0]) < n:
        for k, base in enumerate(BASES):
            out, have = np.ones(1 << (n - 1).bit_length(), dtype=np.uint64), 1
            while have < len(out):
                out[have : 2 * have] = out[:have] * _U(pow(base, have, PRIME)) % _U(PRIME)
                have *= 2
            _up[k] = out
    return _up


class Prefixes:
    """Modular prefix arrays of a text's code points: hashes of any span, in constant time."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + _U(1)
        self.n = len(codes)
        self.sums = []
        for power in _powers(self.n + 1):
            x = codes * power[: self.n]
            x = (x & _U(PRIME)) + (x >> _U(31))
            total = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(x, out=total[1:])
            self.sums.append(total)

    def span(self, start, length) -> np.ndarray:
        """Hashes of the spans [start, start + length), equal for equal spans wherever they stand."""
        start, end = np.asarray(start), np.asarray(start) + np.asarray(length)
        high, low = ((t[end] - t[start]) % _U(PRIME) * inverse(start, k) % _U(PRIME) for k, t in enumerate(self.sums))
        return (high << _U(31)) | low


#: A power of the inverse of a base is a product of two: one below 1 << LOW, and one of its multiples.
LOW = 12
_down: list[tuple[np.ndarray, np.ndarray]] = []


def _inverses(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse powers of base k: base ** -i for i < 1 << LOW, and base ** -(j << LOW) for all j that a place can have,
    each 32 KB and 4 MB, made once in a Python worker."""
    if not _down:
        for base in BASES:
            step = pow(base, PRIME - 2, PRIME)
            both = []
            for first, size in ((step, 1 << LOW), (pow(step, 1 << LOW, PRIME), (PRIME >> LOW) + 1)):
                out, have = np.ones(size, dtype=np.uint64), 1
                while have < size:
                    more = min(have, size - have)
                    out[have : have + more] = out[:more] * _U(pow(first, have, PRIME)) % _U(PRIME)
                    have += more
                both.append(out)
            _down.append((both[0], both[1]))
    return _down[k]


def inverse(n: np.ndarray, k: int) -> np.ndarray:
    """base ** -n modulo PRIME, for 0 <= n <= PRIME."""
    low, high = _inverses(k)
    return low[n & ((1 << LOW) - 1)] * high[n >> LOW] % _U(PRIME)


def extension(a: Prefixes, b: Prefixes, i: int = 0, j: int = 0) -> int:
    """Length of the longest common extension of a from i and b from j, by binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.span([i], mid) == b.span([j], mid) else (low, mid - 1)
    return low


def borders(text: str) -> np.ndarray:
    """Places, 0 and the end among them, that part a text into spans; none is in an empty text.

    A place is one where the next WINDOW code points have a hash below those of the REACH places before, and not above
    those of the REACH places after: so it depends on what stands around it only, and comes again wherever that does.
    Spans over LONGEST (periods, single characters) are cut at its multiples.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n, m = len(codes), len(codes) - WINDOW + 1
    inner = np.empty(0, dtype=np.int64)
    if m > 1:
        h = codes[:m] * _MARKS[0]
        for k in range(1, WINDOW):
            h += codes[k : k + m] * _MARKS[k]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        least = np.full(m + 2 * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)  # least[i]: of the places i - REACH to i - 1
        least[REACH : REACH + m] = h
        k = 1
        while k < REACH:
            least[:-k] = np.minimum(least[:-k], least[k:])
            k *= 2
        inner = np.flatnonzero((h < least[:m]) & (h <= least[REACH + 1 : REACH + 1 + m]))
    ends = np.unique(np.concatenate([[0, n], inner])) if n else inner
    size = np.diff(ends)
    if len(size) and size.max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *[np.arange(a, a + k, LONGEST) for a, k in zip(ends[:-1], size, strict=True) if k > LONGEST]]))
    return ends


@dataclass(frozen=True)
class Print:
    """n code points, one hash of all, the hashes of the prefixes and of the suffixes whose lengths are multiples of a
    step (the least power of two of which n has SAMPLES multiples at most), and all spans between borders in order: 48
    bits of a hash, then 16 of the length. Spans grow in number with the text."""

    n: int
    whole: int
    prefix: tuple[int, ...]
    suffix: tuple[int, ...]
    spans: tuple[int, ...] = ()

    @property
    def step(self) -> int:
        return step(self.n)


def step(n: int) -> int:
    return 1 << max(0, (max(n, 1) - 1) // SAMPLES).bit_length()


def fingerprint(text: str) -> Print:
    p = Prefixes(text)
    lengths = np.arange(1, p.n // step(p.n) + 1) * step(p.n)
    ends, k = borders(text), len(lengths)
    size = np.diff(ends)
    hashes = p.span(np.concatenate([[0], np.zeros_like(lengths), p.n - lengths, ends[:-1]]), np.concatenate([[p.n], lengths, lengths, size]))
    spans = (hashes[1 + 2 * k :] << _U(16)) | size.astype(np.uint64)
    return Print(p.n, int(hashes[0]), tuple(hashes[1 : 1 + k].tolist()), tuple(hashes[1 + k : 1 + 2 * k].tolist()), tuple(spans.tolist()))


def written(p: Print) -> str:
    """As a string; read() gets the fingerprint back."""
    return f"{p.n:x}." + base64.urlsafe_b64encode(np.array([p.whole, *p.prefix, *p.suffix, *p.spans], dtype="<u8").tobytes()).decode().rstrip("=")


def read(s: str) -> Print:
    n, _, code = s.partition(".")
    values = np.frombuffer(base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)), dtype="<u8").tolist()
    k = int(n, 16) // step(int(n, 16))
    return Print(int(n, 16), values[0], tuple(values[1 : 1 + k]), tuple(values[1 + k : 1 + 2 * k]), tuple(values[1 + 2 * k :]))


def _common(a: tuple, b: tuple, of: int, to: int) -> int:
    """How many of the samples taken at the coarser step agree: those of a shared prefix do, and no later ones."""
    most = min(len(a) // of, len(b) // to)
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid * of - 1] == b[mid * to - 1] else (low, mid - 1)
    return low


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1: the code points that two texts share, as a part of the longer one: those of the longest common
    prefix and suffix, to the coarser step, found by binary search in the samples of the two fingerprints, and those of
    the spans between them that both have, in any place, each as often as both have it. Equal texts: 1, the empty one
    included."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    both = max(a.step, b.step)
    head, tail = (_common(x, y, both // a.step, both // b.step) * both for x, y in ((a.prefix, b.prefix), (a.suffix, b.suffix)))
    shared = head + tail
    if shared < min(a.n, b.n):
        shared += sum((s & 0xFFFF) * k for s, k in (_between(a, head, tail) & _between(b, head, tail)).items())
    return min(shared, min(a.n, b.n)) / max(a.n, b.n)


def _between(p: Print, head: int, tail: int) -> Counter:
    """The spans that lie after the first head and before the last tail code points."""
    at, out = 0, []
    for s in p.spans:
        end = at + (s & 0xFFFF)
        if at >= head and end <= p.n - tail:
            out.append(s)
        at = end
    return Counter(out)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, after, id, text) in order -> a result for each row that is not `after`, with the next row's text."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, after, id_, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            own = None if after else (bucket, id_, text or "", fingerprint(text or ""))
            if held is not None and held[0] == bucket:
                out.append(_row(held, text or "", own[3] if own else fingerprint(text or "")))
            held = own
        columns = zip(*out, strict=True) if out else [[]] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _OUT.values(), strict=True)], names=list(_OUT))


_OUT = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _row(held: tuple, following: str, next_print: Print) -> tuple:
    _, id_, text, own = held
    k = len(text) // 4
    edited = text[: len(text) - k] + following[:k]
    new = fingerprint(edited)
    return id_, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(new), likeness(read(written(own)), new), likeness(own, next_print)


def with_next(df: DataFrame) -> DataFrame:
    """Rows (id, text) -> (bucket, after, id, text), dealt by bucket and ordered in each: ranges of ids, each followed
    by a copy (after) of the row that comes next, the last range by the first row of all.

    Bounds are quantiles of the ids, as many as there are shuffle partitions; the first row of each range is found by
    an aggregation of ids, so texts are shuffled once and no task sees more than its range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select("id")
    quantiles = [k / n for k in range(1, n)]
    bounds = sorted(set((ids.agg(F.percentile_approx("id", quantiles, 100 * n)).first()[0] if quantiles else None) or []))
    bucket = lambda c: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= c)) if bounds else F.lit(0)
    bucket_of = F.when(F.col("id").isNull(), F.lit(0)).otherwise(bucket(F.col("id"))).cast("int")
    firsts = ids.select("id", bucket_of.alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("m")).orderBy("bucket").collect()
    if not firsts:
        return df.select(F.lit(0).alias("bucket"), F.lit(True).alias("after"), "id", "text")
    # one row a range: the first of each goes to the range before it as well, that of the first range to the last
    before = [(r["m"]["id"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]
    also = spark.createDataFrame(before, "first_id long, before int")
    rows = df.select(bucket_of.alias("bucket"), F.lit(False).alias("after"), "id", "text")
    copies = df.join(F.broadcast(also), F.col("id").eqNullSafe(F.col("first_id"))).groupBy("before", "id").agg(F.min("text").alias("t"), F.max(F.col("text").isNull()).alias("null"))
    copies = copies.select(F.col("before").alias("bucket"), F.lit(True).alias("after"), "id", F.when(~F.col("null"), F.col("t")).alias("text"))
    return rows.union(copies).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "after", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a row of df.

    edited: the last floor(n_chars / 4) code points replaced by the first as many of the next row's text, by id and,
    where ids are equal, by text (nulls first); after the last row comes the first. A null text is empty. An empty
    table has no rows; a single row is followed by itself. Other columns are not read.
    """
    python_ready(df.sparkSession)
    rows = with_next(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    types = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return rows.mapInArrow(_printed, ", ".join(f"{k} {types[t]}" for k, t in _OUT.items())).withColumnRenamed("id", id_col)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
