"""Near-duplicate documents by SuperMinHash signatures, banding, verification on whole shingle sets and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, few, likely_in, python_ready, table, working_for
from .shingles import blocks, mix, sets, shingles

#: Slots of a signature, and how many of them make a band: at a similarity of 0.75, two sets share no band once in 190,000.
SLOTS, ROWS = 128, 4
#: Slots that a candidate pair must agree in before its texts are compared, for a threshold of 75: sets that are so
#: similar agree in fewer once in 10**13 pairs. For other thresholds it is scaled.
AGREE = 60
#: The copies that are central to others are looked for again as long as one in PAYS of the pairs compared is a link.
PAYS = 8
#: Members that are compared with one copy of a hub's text.
GROUP = 64
_UNSET = np.uint32(0xFFFFFFFF)
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def superminhash(hashes: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of the sets hashes[bounds[k]:bounds[k + 1]]; an empty set has no slot filled.

    Each element deals the levels 0, 1, ... to the slots in an order of its own (a Fisher-Yates shuffle drawn from its
    hash) with a random fraction below each level; a slot keeps its least value. All elements take a level together, so
    a set is done, and leaves, at the first level after which all its slots are filled: no later value can be less.
    """
    docs = len(bounds) - 1
    out = np.full((docs, slots), _UNSET, dtype=np.uint32)
    flat = out.reshape(-1)
    of = np.repeat(np.arange(docs), np.diff(bounds))
    h, order = hashes, None
    for level in range(slots):
        if not len(h):
            break
        r = mix(h + _U((int(_STEP) * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = level + (((r & _U(0xFFFFFFFF)) * _U(slots - level)) >> _U(32)).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            rows = np.arange(len(h))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, level]
        np.minimum.at(flat, of * slots + slot, ((r >> _U(39)).astype(np.uint32) | np.uint32(level << 25)))
        here = np.unique(of)
        open_ = np.zeros(docs, dtype=bool)
        open_[here] = (out[here] == _UNSET).any(axis=1)
        keep = open_[of]
        h, of = h[keep], of[keep]
        if level == 0:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
            order[np.arange(len(h)), pick[keep]] = 0
        else:
            order = order[keep]
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature, different for each band's place."""
    x = signatures.astype(np.uint64).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(1, x.shape[1] + 1, dtype=np.uint64) * _STEP, x.shape[:2])
    for k in range(rows):
        key = mix(key + x[:, :, k])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    working_for("minhash")
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, offsets, data in blocks(texts):
            hashes, bounds = shingles(offsets, data)
            own = [np.unique(hashes[bounds[k] : bounds[k + 1]]) for k in range(len(bounds) - 1)]
            size = np.array([len(x) for x in own], dtype=np.int64)
            digest = np.array([np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), dtype=np.int64) for x in own]).reshape(-1, 2)
            flat = np.concatenate([[0], np.cumsum(size)])
            signatures = superminhash(np.concatenate(own), flat)
            lists = [pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * x.shape[1], x.reshape(-1)) for x in (bands(signatures), sketch(signatures))]
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(own)), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *lists], names=["id", "size", "d1", "d2", "bands", "sig"])


def sketch(signatures: np.ndarray) -> np.ndarray:
    """The low byte of each slot, eight to a long."""
    return np.ascontiguousarray(signatures.astype(np.uint8)).view(np.int64)


def agreeing(a: str, b: str, slots: int = SLOTS) -> Column:
    """How many bytes two sketches have in common: those of their exclusive or whose bits, folded into the lowest, are 0."""
    fold = lambda x, k: x.bitwiseOR(F.shiftrightunsigned(x, k))
    out = F.lit(slots)
    for k in range(slots // 8):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        out = out - F.bit_count(fold(fold(fold(x, 4), 2), 1).bitwiseAND(F.lit(0x0101010101010101)))
    return out


def _alike(threshold: int):
    """Rows (hub, salt, member, text), dealt by (hub, salt), each group's hub (member null) first -> linked (a, b)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("minhash")
        at, hubs = None, []  # several texts of a hub, where its id repeats
        for batch in batches:
            a, b = [], []
            for hub, salt, member, x in zip(*(batch.column(k).to_pylist() for k in range(3)), sets(batch.column(3)), strict=True):
                if at != (hub, salt):
                    at, hubs = (hub, salt), []
                if member is None:
                    hubs.append(x)
                    continue
                for own in hubs:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if both and 100 * both >= threshold * (len(own) + len(x) - both):
                        a.append(hub)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return go


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those (hub, member) of pairs whose whole texts in texts (id, text) have 100 * common >= threshold * united shingles.

    A member's text is sent once for each pair, a hub's once for GROUP members, so hot hubs are spread over tasks.
    """
    size = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    _, size = few(size, 2)
    dealt = pairs.join(size, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"), "member")
    both = F.array(F.struct(F.col("member").alias("id"), F.col("member").alias("member")), F.struct(F.col("hub").alias("id"), F.lit(None).cast("long").alias("member")))
    _, wanted = few(dealt.select("hub", "salt", F.inline(both)).distinct(), 4)
    rows = texts.join(wanted, "id").select("hub", "salt", "member", "text").repartition("hub", "salt")
    return rows.sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first()).mapInArrow(_alike(threshold), "a long, b long")


def _own_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, c, text) -> (row, rep, c, size, hashes); row numbers a text, of which a repeated id can have several."""
    from pyspark import TaskContext

    working_for("minhash")
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        own = list(sets(batch.column(2)))
        if own:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            hashes = pa.ListArray.from_arrays(bounds.astype(np.int32), np.concatenate(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(own))), batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), hashes], names=["row", "rep", "c", "size", "hashes"])
            row += len(own)


def rare_keys(texts: DataFrame, threshold: int) -> DataFrame:
    """(rep, c, text) -> (h, rep, size, rest): of each text's shingles the first that it can share with a text of another
    c so that both reach the threshold; rest: how many of its shingles are left, this one included.

    Sets of m <= n shingles that reach it have at least threshold / (100 + threshold) of m + n in common, and m is at
    least threshold / 100 of n. So in any order of all shingles, the first that they share leaves at least as many to
    come in both: it is near the front of either, and in the smaller set nearer still, as its partner is no smaller.
    The order puts first what only one component has, which can link nothing, and then the rare; so texts that have a
    common passage, or belong to another group of copies, meet only if they have hardly anything of their own.
    """
    own = cut(texts.mapInArrow(_own_shingles, "row long, rep long, c long, size long, hashes array<long>"))
    spread = own.select("row", "c", F.explode("hashes").alias("h"))
    common = spread.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("h", "n")
    ranked = spread.join(common, "h").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("common"))
    key = own.select("row", "rep", "size").join(ranked, "row").withColumn("rest", F.size("common"))
    front = (F.col("rest") - _part(threshold / 100, F.col("size")) + 1).cast("int")
    key = key.withColumn("front", front).filter("front > 0").select("rep", "size", "rest", F.posexplode(F.slice("common", F.lit(1), F.col("front"))).alias("k", "s"))
    return cut(key.select(F.col("s.h").alias("h"), "rep", "size", (F.col("rest") - F.col("k")).cast("long").alias("rest")))


def _part(part: float, of: Column) -> Column:
    return F.ceil(part * of - 1e-6)


def central_pairs(key: DataFrame, threshold: int) -> DataFrame:
    """(h, rep, c, size, rest) -> (hub, member): those of rare_pairs of which one has the most in common with others of
    all that have the shingle; a text that others are copies of links them all at once."""
    hub = key.groupBy("h").agg(F.max_by(F.struct("rep", "c", "size", "rest"), F.struct(F.col("rest") / F.col("size"), "rep")).alias("m")).select("h", *[F.col(f"m.{x}").alias(f"{x}_other") for x in ("rep", "c", "size", "rest")])
    return key.join(hub, "h").filter(_reach(threshold)).select(F.col("rep_other").alias("hub"), F.col("rep").alias("member")).distinct()


def rare_pairs(key: DataFrame, threshold: int) -> DataFrame:
    """(h, rep, c, size, rest) of rare_keys -> (hub, member): all pairs of different c whose sets can reach the threshold."""
    small = key.filter(F.col("rest") >= _part(2 * threshold / (100 + threshold), F.col("size")))
    large = key.select("h", *[F.col(x).alias(f"{x}_other") for x in ("rep", "c", "size", "rest")])
    once = (F.col("size") < F.col("size_other")) | (F.col("size") == F.col("size_other")) & (F.col("rep") < F.col("rep_other"))
    return small.join(large, "h").filter(once & _reach(threshold)).select(F.col("rep").alias("hub"), F.col("rep_other").alias("member")).distinct()


def _reach(threshold: int) -> Column:
    sizes = [F.col("size"), F.col("size_other")]
    enough = F.least("rest", "rest_other") >= _part(threshold / (100 + threshold), sizes[0] + sizes[1])
    return (F.col("c") != F.col("c_other")) & (100 * F.least(*sizes) >= threshold * F.greatest(*sizes)) & enough


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """-> (id_col, n_shingles, component_id, kept): a row for each row of df.

    Links are pairs whose sets of distinct five-word shingles have 100 * common >= threshold * united; component_id is
    the smallest id that a row's links reach, itself included; kept: it is its own component_id. Texts with equal sets
    are one class, whose smallest id stands for it; classes that share a band of their signatures are candidates.

    A bucket (the classes that share a band's key) is first compared with one hub only, its smallest id. What is apart
    after that is joined on rare shingles (rare_keys), first only with the member of each shingle that is central, while
    that pays, so a group of near copies costs a few links for each member and not the square of its size; then all
    pairs that are still apart and can reach the threshold (rare_pairs), which leaves no candidate out. Pairs whose sizes
    or signatures rule a link out are dropped before their texts are compared.

    Null or blank text: no shingle, linked with nothing. A null id: no links, component_id null, kept false. Rows that
    repeat an id are one node with all their texts' links. Other columns of df are not read and may have any name.
    """
    spark = df.sparkSession
    python_ready(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(docs.mapInArrow(_signed, "id long, size long, d1 long, d2 long, bands array<long>, sig array<long>"))
    linked = signed.filter("size > 0 and id is not null")
    # a class is named by the least id of its rows; an id that repeats with other texts may stand for several
    named = linked.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    member = cut(linked.join(named, ["d1", "d2"]).select("id", "rep", "size", "bands", "sig"))
    bucket = member.filter("id = rep").select("rep", F.explode("bands").alias("key"))
    shared = bucket.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).filter("hub < far")
    bucket = cut(bucket.join(shared.select("key"), "key", "left_semi").distinct().select("key", "rep"))
    wanted, held = few(bucket.select(F.col("rep").alias("id")).distinct(), 1)
    least = AGREE * threshold // 75
    _, sketches = few(member.filter("id = rep").join(held, "id", "left_semi").select("rep", "size", "sig").distinct(), 3 + SLOTS // 8)
    texts = cut((docs if held is not wanted else likely_in(docs, "id", wanted)).join(held, "id", "left_semi").distinct())

    def likely(pairs: DataFrame) -> DataFrame:
        for end in ("hub", "member"):
            pairs = pairs.join(sketches.select(F.col("rep").alias(end), F.col("size").alias(f"{end}_size"), F.col("sig").alias(f"{end}_sig")), end)
        fits = 100 * F.least("hub_size", "member_size") >= threshold * F.greatest("hub_size", "member_size")
        return pairs.filter(fits & (agreeing("hub_sig", "member_sig") >= least)).select("hub", "member").distinct()

    own, comp = few(wanted.select(F.col("id").alias("rep"), F.col("id").alias("c")), 2)
    tried = key = None
    for step in ("hub", "central", "all"):
        while True:
            if step == "hub":
                apart = bucket.join(comp, "rep")
                apart = apart.join(apart.groupBy("key").agg(F.min_by(F.struct("rep", "c"), "rep").alias("hub"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most"), "key")
                pairs = apart.filter("c <> hub.c").select(F.col("hub.rep").alias("hub"), F.col("rep").alias("member")).distinct()
            elif key is None:
                apart = bucket.join(comp, "rep")
                apart = apart.join(apart.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most"), "key").select(F.col("rep").alias("id"), "c").distinct()
                key = rare_keys(texts.join(apart, "id").select(F.col("id").alias("rep"), "c", "text"), threshold)
                continue
            else:
                pairs = (central_pairs if step == "central" else rare_pairs)(key.join(comp, "rep"), threshold)
            pairs = likely(pairs)
            if tried is not None:
                pairs = pairs.join(tried, ["hub", "member"], "left_anti")
            pairs, _ = few(pairs, 2)
            ways = F.array(F.struct("hub", "member"), F.struct(F.col("member").alias("hub"), F.col("hub").alias("member")))
            both = pairs.select(F.inline(ways))
            _, tried = few(both if tried is None else tried.union(both), 2)
            a, b = (comp.select(F.col("rep").alias(end), F.col("c").alias(f"c_{end}")) for end in "ab")
            new, _ = few(verified(pairs, texts, threshold).join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), 2)
            if links := new.count():
                _, joined = few(connected_components(new).withColumnRenamed("node", "c"), 2)
                own, comp = few(own.join(joined, "c", "left").select("rep", F.coalesce("component", "c").alias("c")), 2)
            if step != "central" or PAYS * links <= pairs.count():
                break
    named = member.select("id", "rep").join(comp, "rep", "left").select("id", F.coalesce("c", "rep").alias("component"))
    named = named.groupBy("id").agg(F.min("component").alias("component"))
    out = signed.select("id", "size").join(named, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
