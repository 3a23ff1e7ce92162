"""What several operators of this subpackage share: tables, checkpoints, components, a bounded id filter."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bits of an id filter: 8 MB are broadcast at most, whatever the number of ids.
FILTER_BITS_MAX = 1 << 26
#: Bytes, at 8 a column or array element, of a checkpointed table that is put together in one partition and may be
#: broadcast at most.
FEW_BYTES = 8 << 20
#: Rows and bytes of an Arrow batch that a Python worker is given at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on one machine where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: a short lineage that survives lost executors.

    The optimizer also forgets what it derived about the rows: in a loop, the constraints that a checkpointed plan
    hands on would multiply from round to round.
    """
    spark = df.sparkSession
    shared_dir(spark)
    plan = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)


def few(df: DataFrame, longs: int) -> tuple[DataFrame, DataFrame]:
    """df, a narrow table of so many longs a row, checkpointed: as it is to be read, and as it is to be joined with.

    Up to FEW_BYTES it is read in one partition, and marked for broadcast where it is joined with, so that steps over
    it take few tasks and no shuffle; beyond, both are the table with its own partitions. The rows are the same.
    """
    df = cut(df)
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    if 8 * longs * df.coalesce(max(1, parts // 16)).count() > FEW_BYTES:
        return df, df
    one = df.coalesce(1)
    return one, F.broadcast(one)


def python_ready(spark: SparkSession) -> None:
    """Let Python workers find this package, and bound what one Arrow batch of whole texts takes in them.

    The two settings are the session's from then on, as plans are run after the operator has returned; one that the
    session has made smaller stays. A batch ends once it is over the bytes, so one text more may stand in it.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: What this Python worker remembers from task to task: the operator that does, and how to forget it.
_remembers: dict[str, Callable[[], object]] = {}


def working_for(operator: str, forget: Callable[[], object] | None = None) -> None:
    """Called in a Python worker as a task of an operator begins: what other operators remember there is forgotten, and
    the memory goes back to the system, as the worker would else hold it for as long as it is used again.

    forget, where given, empties what this operator's next tasks would find.
    """
    others = [name for name in _remembers if name != operator]
    for name in others:
        _remembers.pop(name)()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)
    if forget is not None:
        _remembers[operator] = forget


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component): each linked node with the smallest node that it reaches.

    Distributed: every round hangs each node below its smallest smaller neighbour, halves the paths of that forest
    by joining it with itself until they end at roots, and contracts the edges to those roots, until none is left.
    Rounds are logarithmic in the number of nodes; only counts reach the driver. Tables of few links stand in one
    partition and are joined with by broadcast (few); the steps are the same. Null ends and self links are ignored.
    No edges give no rows.
    """
    e, _ = few(edges.dropna().select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), 2)
    ends = e.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    labels, _ = few(ends.select("node", F.col("node").alias("component")), 2)
    while not e.isEmpty():
        p, held = few(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), 2)
        while True:
            over = held.select(F.col("node").alias("up"), F.col("up").alias("above"))
            p, held = few(p.join(over, "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), 3)
            if p.filter("moved").isEmpty():
                break
        root = held.select(F.col("node").alias("component"), "up")
        labels, _ = few(labels.join(root, "component", "left").select("node", F.coalesce("up", "component").alias("component")), 2)
        a, b = (held.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")) for end in ("lo", "hi"))
        moved = e.join(a, "lo", "left").join(b, "hi", "left").select(F.coalesce("lo_up", "lo").alias("x"), F.coalesce("hi_up", "hi").alias("y"))
        e, _ = few(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).filter("lo < hi").distinct(), 2)
    return labels


def likely_in(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose long column col is an id of the first column of ids, and few others; no shuffle of df.

    A bit set of bounded size (FILTER_BITS_MAX) is broadcast as one row: past the bound it lets more rows through. It
    only thins out what a join would shuffle; the join that follows decides, so results never depend on it.
    """
    spark, name = df.sparkSession, ids.columns[0]
    bits = max(1 << 16, min(FILTER_BITS_MAX, 1 << max(1, 16 * ids.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    held = ids.select(place(F.col(name)).alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L as int)))").alias("held"))
    words = spark.range(0, bits // 64, 1, 1).join(held, "id", "left").select("id", F.coalesce("held", F.lit(0).cast("long")).alias("held"))
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "held"))), lambda w: w["held"]).alias("bit_set"))
    at = place(df[col])
    hit = F.get(F.col("bit_set"), F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return df.join(F.broadcast(cut(one)), hit, "left_semi")
