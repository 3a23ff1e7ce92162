"""Line deduplication: an edit-distance self join of lines by segments, and removal of all but the first of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, table

#: Most edits (insertions, deletions, substitutions of a character) between two lines that count as one.
EDITS = 1
#: Characters that a line must have to be linked with lines that differ from it; shorter ones are only equal or not.
LEAST_CHARS = 40
#: Characters that a line must have to go as an equal repeat, in the query and the pipeline: all that are not blank.
LEAST_EQUAL = 1
#: Parts into which the window of an edit is cut in each round of narrowing it.
PARTS = 16
#: Characters that verification keeps of what two lines share at either end.
MARGIN = 4
#: Rows of two longs that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most so many edits apart: bit-parallel, over a band of 2 * edits + 1 diagonals.

    A step for each character of b moves the band's window by one character of a. vp and vn are the vertical steps up
    and down of the band's cells, as bits; the distance is followed along the band's upper diagonal, then along the
    last row. Everything stays in the low bits of a long.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    state = F.struct(F.lit(mask & ~((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("dist"))
    inv = lambda x: F.lit(mask).cast("long").bitwiseXOR(x)

    def distance(x: Column, y: Column) -> Column:
        turn = F.size(x) - edits  # steps before this one go along the diagonal

        def step(s: Column, i: Column) -> Column:
            hit = F.lit(0).cast("long")
            for k in range(width):
                hit = hit.bitwiseOR(F.when(F.coalesce((i - edits + k >= 0) & (F.get(x, i - edits + k) == F.get(y, i)), F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))

            def one(m: Column) -> Column:
                d0 = ((m.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(F.lit(mask).cast("long"))).bitwiseXOR(s["vp"]).bitwiseOR(m).bitwiseOR(s["vn"])
                return let(d0, two)

            def two(d: Column) -> Column:
                return let(F.struct(d.alias("d"), s["vn"].bitwiseOR(inv(d.bitwiseOR(s["vp"]))).alias("hp"), d.bitwiseAND(s["vp"]).alias("hn")), three)

            def three(t: Column) -> Column:
                down = F.shiftrightunsigned(t["d"], 1)
                bit = F.lit(1 << (width - 1)).cast("long")
                flat = F.pow(F.lit(2), F.greatest(F.lit(width - 2) - (i - turn), F.lit(0))).cast("long")
                move = F.when(i < turn, F.when(t["d"].bitwiseAND(bit) == 0, 1).otherwise(0)).otherwise(F.when(t["hp"].bitwiseAND(flat) != 0, 1).otherwise(0) - F.when(t["hn"].bitwiseAND(flat) != 0, 1).otherwise(0))
                return F.struct(t["hn"].bitwiseOR(inv(down.bitwiseOR(t["hp"]))).alias("vp"), down.bitwiseAND(t["hp"]).alias("vn"), (s["dist"] + move).cast("int").alias("dist"))

            return let(hit, one)

        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), state, step, lambda s: s["dist"])

    chars = lambda s: F.split(s, "")
    apart = F.abs(F.length(a) - F.length(b)) > edits
    short = F.least(F.length(a), F.length(b)) <= 2 * edits + 1
    return F.when(apart, False).when(short, F.levenshtein(a, b, edits) >= 0).otherwise(let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda p: distance(p["x"], p["y"])) <= edits)


def _segments(line: Column, length: Column, edits: int) -> list[tuple[int, Column, Column]]:
    """(number, start from 1, size) of the edits + 1 segments of a line of that length, the longer ones last."""
    parts = edits + 1
    size = F.floor(length / parts).cast("int")
    extra = length - size * parts
    out = []
    for i in range(parts):
        longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra))
        out.append((i, size * i + longer + 1, size + F.when(F.lit(i) >= F.lit(parts) - extra, 1).otherwise(0)))
    return out


def index_keys(line: Column, edits: int) -> Column:
    """Hashes of (length, segment number, segment) of a line."""
    n = F.length(line)
    return F.array(*[F.xxhash64(n, F.lit(i), F.substring(line, start, size)) for i, start, size in _segments(line, n, edits)])


def probe_keys(line: Column, edits: int) -> Column:
    """Hashes of the substrings of a line that a segment of a line no longer, within edits of it, must equal one of: at
    segment i they start within i places of the segment's, seen from the left, and edits - i seen from the right."""
    out, n = [], F.length(line)
    for less in range(edits + 1):
        length = n - less
        for i, start, size in _segments(line, length, edits):
            for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                at = start + move
                out.append(F.when((at >= 1) & (at + size - 1 <= n), F.xxhash64(length, F.lit(i), F.substring(line, at, size))))
    return F.array(*out)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by steps of falling powers of two."""
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def go(at: Column, step: Column) -> Column:
        return F.when((step <= most - at) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at)

    return F.aggregate(F.filter(steps, lambda s: s <= most), F.lit(0), go)


def near(a: Column, b: Column, edits: int) -> Column:
    """within(a, b, edits) of what is left of two lines without their common ends, which are no matter of distance; but
    for MARGIN characters there. Each step is bound once; as columns they would be inlined again and again."""
    pair = lambda x, y, n: F.struct(x.alias("x"), y.alias("y"), F.greatest(n - MARGIN, F.lit(0)).alias("n"))
    tail = lambda p, c: F.substring(p[c], p["n"] + 1, F.length(p[c]))
    head = lambda q, c: F.substring(q[c], F.lit(1), F.length(q[c]) - q["n"])
    core = lambda q: let(pair(head(q, "x"), head(q, "y"), F.lit(0)), lambda c: within(c["x"], c["y"], edits))
    cut_tail = lambda r: let(pair(r["x"], r["y"], shared_prefix(F.reverse(r["x"]), F.reverse(r["y"]))), core)
    cut_head = lambda p: let(pair(tail(p, "x"), tail(p, "y"), F.lit(0)), cut_tail)
    return let(pair(a, b, shared_prefix(a, b)), cut_head)


def bounded(df: DataFrame) -> DataFrame:
    """df, checkpointed, and marked for broadcast if its rows are few; they must be narrow."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_keys(rows: DataFrame) -> DataFrame:
    """(h, key) -> (key): keys of several h. A hot key is combined before the shuffle, to its least and greatest h."""
    return rows.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least < most").select("key")


def window_key(line: Column, less: Column, start: Column, size: Column) -> Column:
    """Hash of a line without a window, of `size` characters in the shorter of two lines (less = 0) and one more in one
    that is longer by one (less = 1), with the window's place."""
    return F.xxhash64(start, size, F.substring(line, F.lit(1), start - 1), F.substring(line, start + size + less, F.lit((1 << 31) - 1)))


def halves(lines: DataFrame) -> DataFrame:
    """(line) -> (h, less, start, size, key): windows of a line's two segments, as a line like any other and as one
    longer by a character than another."""
    ways = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i")) for less in (0, 1) for i in (0, 1)])
    rows = lines.select("line", F.xxhash64("line").alias("h"), F.length("line").alias("n")).select("*", F.inline(ways)).filter("n >= less")
    half = F.shiftright(F.col("n") - F.col("less"), 1)
    rows = rows.select("line", "h", "less", F.when(F.col("i") == 0, 1).otherwise(half + 1).alias("start"), F.when(F.col("i") == 0, half).otherwise(F.col("n") - F.col("less") - half).alias("size"))
    return rows.select("h", "less", "start", "size", window_key(F.col("line"), F.col("less"), F.col("start"), F.col("size")).alias("key"))


def windows(line: Column, less: Column, start: Column, size: Column) -> Column:
    """A window's PARTS parts, or fewer of at least a character."""
    wide = F.ceil(size / PARTS).cast("int")

    def part(at: Column) -> Column:
        own = F.least(wide, start + size - at)
        return F.struct(less.alias("less"), at.alias("start"), own.alias("size"), window_key(line, less, at, own).alias("key"))

    return F.transform(F.sequence(start, start + size - 1, wide), part)


def one_edit_links(lines: DataFrame) -> DataFrame:
    """(line) -> (a, b): hashes of lines, linked so that all lines one edit apart are joined by verified links.

    Of two segments of a line, an edit leaves one as it is: lines that share a segment, at its place in lines of their
    length, are candidates. The edit is then within the other segment, which is cut in turn, so that candidates share
    all but an ever smaller window, until it is a character. Each round keeps the windows that several lines have and
    never pairs them. Lines of a length that share all but one character are linked with the first of them; a longer
    line is looked up without each character of its window. So the work is linear in lines, however many share a segment.
    """
    h = F.xxhash64("line").alias("h")
    first = halves(lines)
    keys = bounded(shared_keys(first))
    state = cut(first.join(keys, "key", "left_semi").select("h", "less", "start", "size").distinct())
    wanted = bounded(state.select("h").distinct())
    texts = cut(lines.select(h, "line").join(wanted, "h", "left_semi").distinct())
    done = []
    while True:
        done.append(state.filter("size <= 1"))
        state = state.filter("size > 1")
        if state.isEmpty():
            break
        parts = cut(state.join(texts, "h").select("h", F.inline(windows(F.col("line"), F.col("less"), F.col("start"), F.col("size")))))
        state = cut(parts.join(bounded(shared_keys(parts)), "key", "left_semi").select("h", "less", "start", "size"))
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    ends = ends.join(texts, "h")
    same = cut(ends.filter("less = 0").select("h", window_key(F.col("line"), F.lit(0), F.col("start"), F.col("size")).alias("key")))
    equal = same.join(same.groupBy("key").agg(F.min("h").alias("b")), "key").select(F.col("h").alias("a"), "b").filter("a <> b")
    without = F.transform(F.sequence(F.col("start"), F.col("start") + F.col("size")), lambda at: F.xxhash64(F.concat(F.substring("line", F.lit(1), at - 1), F.substring("line", at + 1, F.length("line")))))
    longer = ends.filter("less = 1").select(F.col("h").alias("a"), F.explode(without).alias("b")).filter("a <> b")
    longer = longer.join(texts.select(F.col("h").alias("b")), "b", "left_semi").select("a", "b")
    return verified(equal.union(longer).distinct(), texts, 1)


def segment_links(lines: DataFrame, edits: int) -> DataFrame:
    """(line) -> (a, b): hashes of all lines within edits of each other, by a join of segments with substrings. Pairs
    of lines that share a segment are all looked at."""
    h = F.xxhash64("line")
    index = lines.select(h.alias("a"), F.explode(index_keys(F.col("line"), edits)).alias("key")).distinct()
    probe = lines.select(h.alias("b"), F.explode(probe_keys(F.col("line"), edits)).alias("key")).filter("key is not null").distinct()
    pairs = cut(index.join(probe, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    return verified(pairs, lines.select(h.alias("h"), "line").join(bounded(wanted), "h", "left_semi").distinct(), edits)


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The (a, b) whose (h, line) are within edits."""
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("h").alias(end), F.col("line").alias(f"line_{end}")), end)
    return pairs.filter(near(F.col("line_a"), F.col("line_b"), edits)).select("a", "b")


def line_classes(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, line) -> (h, cls): hashes of lines that have others within edits, with the least hash that such links reach."""
    close = one_edit_links(lines.select("line")) if edits == 1 else segment_links(lines, edits)
    return connected_components(close).select(F.col("node").alias("h"), F.col("component").alias("cls"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST_CHARS, columns: list[str] | None = None, least_equal: int | None = None) -> DataFrame:
    """-> (columns or id_col and text_col, n_lines, n_dropped): a row for each row of df, its text without the lines
    that repeat an earlier one.

    Lines are what line ends part. Lines of at least `least_equal` characters (`least`, if not given) that are equal
    are a class, and so are lines of at least `least` that are joined by steps of at most `edits` edits; it keeps its
    first line, by id and place, and all others go. Lines are told apart by 64-bit hashes. Null text stays null, with 0
    lines; blank lines and those under `least_equal` stay. Rows that repeat an id are one document: each of them keeps
    the class' first place. Rows with a null id stay as they are, and count for nothing. An empty table has no rows.
    Internal columns have names of their own, so other columns may have any.
    """
    least_equal = least if least_equal is None else least_equal
    counts = lambda line: (F.length(line) >= least_equal) & line.rlike(r"(?U)\S")
    columns = columns or [id_col, text_col]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns) if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    split = F.split("text", "\n")
    spread = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").select("id", F.posexplode(split).alias("place", "line")).filter(counts(F.col("line")))
    seen = spread.select("id", "place", F.xxhash64("line").alias("h"))
    cls = line_classes(spread.filter(F.length("line") >= least).select("id", "line"), edits)
    counted = seen.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).join(cls, "h", "left").filter("n > 1 or cls is not null").withColumn("cls", F.coalesce("cls", "h"))
    of_class = counted.groupBy("cls").agg(F.min("first").alias("first"))
    again = cut(seen.join(counted.select("h", "cls").join(of_class, "cls"), "h"))
    start = again.filter("id = first").groupBy("cls").agg(F.min("place").alias("start"))
    gone = again.join(start, "cls").filter("id <> first or place <> start").groupBy("id").agg(F.collect_set("place").alias("gone"))
    out = rows.join(gone.withColumnRenamed("id", "gone_id"), F.col("id") == F.col("gone_id"), "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda line, k: ~(F.array_contains("gone", k) & counts(line))), "\n"))
    n = F.coalesce(F.size(split), F.lit(0))
    out = out.select("row", kept.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[f"_{i}"]).alias(c) for i, c in enumerate(columns)], "n_lines", F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(0).cast("long").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), least_equal=LEAST_EQUAL)
