"""Near-duplicate vectors by a forest of random-projection trees with spill, comparison within leaves and components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, python_ready, table

#: Trees, rows that a leaf should hold, and the part of a node's rows on each side of a split that go to both children.
TREES, LEAF, SPILL = 10, 96, 0.06
#: The splits are fitted on at most so many rows, those with the least hashes of their ids; every row is indexed.
SAMPLE = 20_000
#: A split also sends both ways what is nearer to it than this part of the distance of two vectors at the threshold.
MARGIN = 0.5
#: A node of which more than this part would go both ways is a tight cluster: it is not split, but compared in blocks.
TIGHT = 0.5
#: Sampled rows that a node needs for a split of its own; below, it takes the split of its whole level.
OWN_SPLIT = 12
#: Rows of a leaf that are compared at once; a larger leaf is compared in pairs of such blocks.
BLOCK = 1024
#: Most rows of a table of oversized leaves that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000


@dataclass
class Tree:
    """Directions by level; the lower and upper bound of each fitted split by level and node."""

    directions: np.ndarray
    nodes: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    common: list[tuple[float, float]] = field(default_factory=list)

    def split(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, b = self.nodes[level], self.bounds[level]
        if not len(known):
            return np.full(len(node), self.common[level][0]), np.full(len(node), self.common[level][1])
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        hit = known[at] == node
        return tuple(np.where(hit, b[at, k], self.common[level][k]) for k in (0, 1))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): a row is in every leaf that it reaches; what lies between a split's bounds goes both ways."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        at = x @ self.directions.T
        for level in range(len(self.directions)):
            low, high = self.split(level, node)
            p = at[row, level]
            left, right = p <= high, (p >= low) & ((p > high) | (low < high))  # where both are one value, it goes left only
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def _split(p: np.ndarray, spill: float, margin: float) -> tuple[float, float]:
    """Bounds of a split at the median of projections p; both infinite where all rows are to stay together (left)."""
    low, mid, high = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill])
    low, high = min(low, mid - margin), max(high, mid + margin)
    return (low, high) if ((p >= low) & (p <= high)).mean() <= TIGHT else (np.inf, np.inf)


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, threshold: float = 0.95, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    depth = max(0, math.ceil(math.log2(max(rows, 1) / leaf))) if rows > leaf else 0
    out = []
    margin = MARGIN * math.sqrt(2 * max(0.0, 1 - threshold))
    for _ in range(trees):
        tree = Tree(rng.standard_normal((depth, sample.shape[1])))
        at, node = sample @ tree.directions.T, np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            p = at[:, level]
            tree.common.append(_split(p, spill, margin))
            order = np.argsort(node, kind="stable")
            known, first = np.unique(node[order], return_index=True)
            runs = np.split(order, first[1:])
            fitted = [(k, *_split(p[r], spill, margin)) for k, r in zip(known, runs, strict=True) if len(r) >= OWN_SPLIT]
            tree.nodes.append(np.array([f[0] for f in fitted], dtype=np.int64))
            tree.bounds.append(np.array([f[1:] for f in fitted]).reshape(-1, 2))
            low, high = tree.split(level, node)
            node = 2 * node + (p > np.where(np.isinf(low), np.inf, low / 2 + high / 2))
        out.append(tree)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of doubles, each of length 1. They are first brought near 1 by powers of two, which is exact, so that the
    squares of very large or small components neither overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1))


def _codes(forest: list[Tree]):
    """(id, size, v) -> the same with the sorted codes (tree, leaf) that a row is in."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            rows, codes = zip(*((r, (np.int64(t) << 48) | n) for t, (r, n) in enumerate(f.leaves(x) for f in forest)), strict=True)
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((code, row))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(code[order]))], names=["id", "size", "v", "codes"])

    return go


def _compare(threshold: float):
    """Rows of one pair of blocks of a leaf -> (id, other, n): links to count for id (other null), or one link of a
    spanning forest of the leaf (n null). A pair is counted only in the first leaf that both its rows are in."""

    def go(key: tuple, t: pa.Table) -> pa.Table:
        code, i, j = (k.as_py() for k in key)
        chunk = np.asarray(t["chunk"])
        t = t.combine_chunks()
        a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        x, ids, size = _matrix(t["v"].chunk(0) if t["v"].num_chunks else t["v"].combine_chunks()), np.asarray(t["id"]), np.asarray(t["size"])
        near = x[a] @ x[b].T >= threshold
        if i == j:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        p, q = a[p], b[q]
        if not len(p):
            return _none
        used, local = np.unique(np.concatenate([p, q]), return_inverse=True)
        lists = t["codes"].combine_chunks().take(pa.array(used))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(used)), np.asarray(lists.value_lengths()))
        early = flat < code
        names, place = np.unique(flat[early], return_inverse=True)
        inside = np.zeros((len(used), len(names)), dtype=np.float32)
        inside[owner[early], place] = 1
        lp, lq = local[: len(p)], local[len(p) :]
        new = (inside @ inside.T)[lp, lq] == 0
        count = np.bincount(lp[new], size[q[new]], len(used)) + np.bincount(lq[new], size[p[new]], len(used))
        root = list(range(len(used)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for m, n in zip(lp.tolist(), lq.tolist(), strict=True):
            m, n = top(m), top(n)
            root[max(m, n)] = min(m, n)
        roots = np.array([top(k) for k in range(len(used))])
        counted, hung = np.flatnonzero(count), np.flatnonzero(roots != np.arange(len(used)))
        name = ids[used]
        return pa.table({"id": np.concatenate([name[counted], name[hung]]), "other": pa.array([None] * len(counted) + name[roots[hung]].tolist(), pa.int64()), "n": pa.array(count[counted].astype(np.int64).tolist() + [None] * len(hung), pa.int64())})

    return go


_none = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def _linked(classes: DataFrame, threshold: float, trees: int, leaf: int, spill: float) -> DataFrame:
    """classes (id, size, v of one length) -> (id, other, n) of _compare."""
    spark = classes.sparkSession
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], dtype=np.float64)
    forest = fit(_unit(sample), classes.count(), trees, leaf, spill, threshold)
    rows = cut(classes.mapInArrow(_codes(forest), f"id long, size long, v {classes.schema['v'].dataType.simpleString()}, codes array<long>"))
    large = rows.select(F.explode("codes").alias("code")).groupBy("code").count().filter(F.col("count") > BLOCK).select("code", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"))
    large = cut(large)
    copies = rows.select("id", "size", "v", "codes", F.explode("codes").alias("code"))
    copies = copies.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "code", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    copies = copies.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    copies = copies.select("id", "size", "v", "codes", "chunk", "code", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    return copies.groupBy("code", "i", "j").applyInArrow(_compare(threshold), "id long, other long, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """-> (id_col, n_links, component_id, kept): a row for each row of df.

    Links are pairs of rows whose vectors have a cosine of threshold or more in double precision; pairs are found by a
    forest of random-projection trees (every row is in it; its splits are fitted on SAMPLE rows), so a pair near the
    threshold can be missed, rarely. n_links: other rows linked directly; component_id: the smallest id that links
    reach, the row's included; kept: it is its own component_id.

    Equal vectors are one class, compared once and counted as often as they occur. A leaf of more than BLOCK rows is
    compared in pairs of blocks, which different tasks take. Within leaves only numbers of links and the links of a
    spanning forest are kept, so a group of near copies gives no more rows than it has members in a leaf.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths neither. A null id: no links, component_id null, kept false. Rows that repeat an id are each other's
    neighbours as other rows are. Components stay floats where the column holds floats, and are doubles otherwise.
    Other columns are not read.
    """
    spark = df.sparkSession
    python_ready(spark)
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    sound = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.filter(F.coalesce(sound, F.lit(False)))
    classes = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).select(F.col("rep").alias("id"), "size", "v"))
    out = None
    for n in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        found = _linked(classes.filter(F.size("v") == n), threshold, trees, leaf, spill)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "id long, other long, n long")
    out = cut(out)
    counts = out.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    member = good.join(classes.select("v", F.col("id").alias("rep"), "size"), "v").select("id", "rep", "size")
    same = member.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = connected_components(out.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).union(same.join(same.groupBy("a").count().filter("count > 1").select("a"), "a", "left_semi")))
    named = member.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = named.select("id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    lone = rows.filter(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(lone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
