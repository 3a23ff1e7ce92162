"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar, by a weighted
automaton over rows that is determinised lazily."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, python_ready, table

#: Grammar of role initials, (s?(ua)+)?: what each state goes to, and where a conversation may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Roles that rows may be given, by initial; costs of edits, and of a truncated row that stays.
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Rows of an Arrow batch of results.
OUT_ROWS = 4_096

_BLANK = r"^[\x20\x09-\x0D]*\z"
_CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
_NEVER = 1 << 40


@dataclass
class Repairer:
    """Costs and edits of sequences of symbols, one of Repairer.symbol for each row.

    A determinised state is the vector of the costs, from each grammar state, to repair all rows from some place on,
    less its least entry. Vectors are met from the last row to the first; what a symbol makes of one, and by how much
    the least entry grows, is worked out once and kept in a table, so a row costs one look-up. There are as many vectors
    as costs within a few edits of each other allow, whatever the data.
    """

    vectors: list[tuple[int, ...]] = field(default_factory=list)
    numbers: dict[tuple[int, ...], int] = field(default_factory=dict)
    moves: dict[tuple[int, str], tuple[int, int]] = field(default_factory=dict)
    traces: dict[tuple[int, str, int], tuple[str, int]] = field(default_factory=dict)

    @staticmethod
    def arcs(symbol: str, q: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, state after it) of what may become of a row before grammar state q. A symbol is 'x' for a row that
        has to go, else the role's initial and '!' if it is truncated."""
        yield "D", DELETE, q
        if symbol == "x":
            return
        stays = TRUNCATED if symbol.endswith("!") else 0
        for initial, after in GRAMMAR[q].items():
            if initial == symbol.removesuffix("!"):
                yield "K", stays, after
            if initial in ROLES:
                yield "R", REROLE + stays, after

    def _number(self, costs: list[int]) -> tuple[int, int]:
        """The number of a vector, closed under inserting rows, and its least entry."""
        for _ in GRAMMAR:
            costs = [min([costs[q], *(INSERT + costs[after] for initial, after in GRAMMAR[q].items() if initial in ROLES)]) for q in range(len(GRAMMAR))]
        least = min(costs)
        own = tuple(c - least for c in costs)
        if own not in self.numbers:
            self.numbers[own] = len(self.vectors)
            self.vectors.append(own)
        return self.numbers[own], least

    def end(self) -> tuple[int, int]:
        return self._number([0 if q in ENDS else _NEVER for q in range(len(GRAMMAR))])

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """(vector before a row, growth of the least cost)."""
        found = self.moves.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            found = self.moves[state, symbol] = self._number([min(cost + after[to] for _, cost, to in self.arcs(symbol, q)) for q in range(len(GRAMMAR))])
        return found

    def edits(self, symbols: list[str]) -> tuple[int, str]:
        """(cost, edits in order) of the rows' symbols: of the cheapest edits those least in order of ASCII.

        The scan goes from the last row to the first; the trace goes back over it, so it meets edits in reading order.
        """
        state, total = self.end()
        states = array("i", [state])
        for symbol in reversed(symbols):
            state, grown = self.move(state, symbol)
            total += grown
            states.append(state)
        q, out = 0, []
        total += self.vectors[state][0]
        for i, symbol in enumerate(symbols):
            before, after = states[-1 - i], states[-2 - i]
            key = (after, symbol, q)  # what comes before follows from these
            if key not in self.traces:
                self.traces[key] = self._step(before, after, symbol, q)
            text, q = self.traces[key]
            out.append(text)
        return total, "".join(out) + self._last(q)

    def _step(self, before: int, after: int, symbol: str, q: int) -> tuple[str, int]:
        here, there = self.vectors[before], self.vectors[after]
        grown = self.moves[after, symbol][1]
        text = ""
        while True:
            tight = {edit: to for edit, cost, to in self.arcs(symbol, q) if cost + there[to] == here[q] + grown}
            insert = [to for initial, to in GRAMMAR[q].items() if initial in ROLES and INSERT + here[to] == here[q]]
            if "D" not in tight and insert:
                text, q = text + "I", insert[0]
                continue
            edit = min(tight)
            return text + edit, tight[edit]

    def _last(self, q: int) -> str:
        out = ""
        while q not in ENDS:
            q = next(after for initial, after in GRAMMAR[q].items() if initial in ROLES)
            out += "I"
        return out


def faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """-> (conv, turn, row_no, role, text, initial, fault, joint): rows numbered from 0 in their conversation by turn, nulls
    first, then by role and text.

    fault is the first of blank (no character but white space), duplicate (role and text stood earlier), truncated (the
    last such character ends no sentence), else null. joint: the initials of the row before and of this one. A null
    role or text is one space. A null conversation is one of its own. Repeated rows are duplicates.
    """
    told = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    by = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    told = told.withColumn("row_no", F.row_number().over(by).cast("long") - 1).withColumn("initial", F.substring("role", 1, 1))
    told = told.withColumn("joint", F.concat(F.lag("initial").over(W.partitionBy("conv").orderBy("row_no")), "initial"))
    again = F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("row_no")) > 1
    return told.withColumn("fault", F.when(F.col("text").rlike(_BLANK), "blank").when(again, "duplicate").when(F.col("text").rlike(_CUT_OFF), "truncated"))


def plans(faulty: DataFrame) -> DataFrame:
    """(conv, row_no, initial, fault) -> (conv, cost, audit), a row a conversation: the cheapest edits' initials in order,
    D delete, I insert, K keep, R rerole.

    Rows are dealt by conversation and stream, in order, through the tasks; of a conversation a task holds two small
    numbers a row and no text. The automaton's table is a task's own, a few dozen entries.
    """
    python_ready(faulty.sparkSession)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.concat("initial", F.when(F.col("fault") == "truncated", "!").otherwise("")))
    rows = faulty.select("conv", "row_no", symbol.alias("symbol")).repartition("conv").sortWithinPartitions("conv", "row_no")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = Repairer(), []
        now, symbols, begun = None, [], False

        def full(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["conv", "cost", "audit"])
                out.clear()

        for batch in batches:
            for conv, sym in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if begun and conv != now:
                    out.append((now, *machine.edits(symbols)))
                    symbols = []
                now, begun = conv, True
                symbols.append(sym)
            yield from full(OUT_ROWS)
        if begun:
            out.append((now, *machine.edits(symbols)))
        yield from full(1)

    return rows.mapInArrow(scan, "conv long, cost long, audit string")


def repaired(faulty: DataFrame, planned: DataFrame) -> DataFrame:
    """-> (conv, place, edit, role, text): the repaired conversations' rows in order, inserted ones with empty texts."""
    letters = planned.select("conv", F.posexplode(F.split("audit", "")).alias("place", "edit")).filter("edit <> ''")
    by = W.partitionBy("conv").orderBy("place")
    before = F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    letters = letters.withColumn("row_no", F.when(F.col("edit") != "I", before - 1))
    told = faulty.select(F.col("conv").alias("c"), F.col("row_no").alias("r"), "role", "text", "initial")
    rows = letters.join(told, F.col("conv").eqNullSafe(F.col("c")) & (F.col("row_no") == F.col("r")), "left").filter("edit <> 'D'")
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("kept", F.when(F.col("edit") == "K", F.col("initial")))
    # rows that were inserted or changed: user and assistant take turns from the last row that was kept on
    upto = W.partitionBy("conv").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("last", F.max(F.when(F.col("kept").isNotNull(), F.struct("n", "kept"))).over(upto))
    since = F.col("n") - F.coalesce(F.col("last")["n"], F.lit(0))
    answered = F.coalesce(F.col("last")["kept"], F.lit("")) == "u"
    user = F.when(answered, since % 2 == 0).otherwise(since % 2 == 1)
    role = F.when(F.col("edit") == "K", F.col("role")).when(user, ROLES["u"]).otherwise(ROLES["a"])
    return rows.select("conv", (F.col("n") - 1).alias("place"), "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv, place, role, text) -> (conv, sha256): the hash of role:text of a conversation's rows joined by line ends. Rows
    stream through the tasks in order; of a conversation a task holds the hash's state."""
    python_ready(rows.sparkSession)
    rows = rows.select("conv", "place", F.concat("role", F.lit(":"), "text").alias("told")).repartition("conv").sortWithinPartitions("conv", "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, told in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(told.encode("utf-8", "surrogatepass"))
            if len(done) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist([{"conv": c, "sha256": h} for c, h in done], schema=_DIGEST)
                done = []
        if state is not None:
            done.append((now, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pylist([{"conv": c, "sha256": h} for c, h in done], schema=_DIGEST)

    return rows.mapInArrow(scan, "conv long, sha256 string")


_DIGEST = pa.schema([("conv", pa.int64()), ("sha256", pa.string())])


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> the rows with their faults, the plan of each conversation, and the repaired rows (see faults, plans, repaired).

    Blank and duplicate rows have to be deleted; the others are kept, given another role or deleted, and rows are
    inserted, so that role initials follow GRAMMAR at the least cost. Empty tables give no rows; other columns of df are
    not read. A conversation's rows are in one task, as its edits follow from each other, but stream through it.
    """
    faulty = cut(faults(df, conv, turn, role, text))
    planned = cut(plans(faulty))
    return faulty, planned, repaired(faulty, planned)


def damaged(df: DataFrame) -> DataFrame:
    """conversations, damaged by crc32 of conv_id:turn in one of five ways, or not; nulls are one space each but for turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), way.alias("way")).filter("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, damaged and repaired: faults, cost, audit and a hash of the repaired text for each of them."""
    whole = table(spark, sf_dir, "conversations")
    faulty, planned, rows = repair(damaged(whole))
    of = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    told = faulty.groupBy("conv").agg(gaps.alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count_if(F.col("joint").isNotNull() & ~F.col("joint").isin("su", "ua", "au")).alias("illegal"))
    out = whole.select(F.col("conv_id").alias("own")).distinct()
    for df in (told, planned, digests(rows)):
        df = df.withColumnRenamed("conv", "c")
        out = out.join(df, F.col("own").eqNullSafe(F.col("c")), "left").drop("c")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("own").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
