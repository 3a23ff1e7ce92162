"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, common, fingerprint, forest, language, lines, minhash, mixing, packing, registry, sharding, url_filter

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 700}" for k in range(20_000))
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "a b c d e f", "fr", "s", 2), (5, long, None, "s", 1), (6, long + " end", "en", "t", 1), (7, " \n\n ", "de", "t", 3), (8, "word", "en", "s", 4), (9, "word", "en", "s", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit(1)).withColumn("row", F.lit("x")).withColumn("component", F.lit(0))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, same, name):
    same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(ids, edges):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_op1_equals_brute_force(spark, docs):
    own = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    edges = [(a, b) for a in own for b in own if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])]
    expected = components(own, edges)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert edges and {k: (len(own[k]), expected[k], expected[k] == k) for k in own} == {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()}


def jaccard_links(own, threshold=75):
    """All pairs of ids whose sets reach the threshold, by the shingles that two sets have in common."""
    holders, common = defaultdict(list), Counter()
    for i, x in own.items():
        for h in x:
            holders[h].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    return [(a, b) for (a, b), n in common.items() if 100 * n >= threshold * (len(own[a]) + len(own[b]) - n)]


def test_op1_equals_an_exact_join_of_sf001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    expected = components(own, jaccard_links(own))
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == expected and len(set(expected.values())) < len(own)


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_op1_groups_around_the_threshold(spark, threshold):
    # copies of one text with ever more words changed, a passage that all share, and texts of several lengths
    rng = random.Random(threshold)
    base, passage = [f"b{k}" for k in range(200)], " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(w if rng.random() > (k % 25) / 400 else f"x{rng.random()}" for w in base[: 80 + 40 * (k % 4)]) for k in range(160)]
    texts += [passage + " " + " ".join(f"u{k}_{j}" for j in range(5 + k % 90)) for k in range(80)]
    own = dict(enumerate(map(shingles, texts)))
    expected = components(own, jaccard_links(own, threshold))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=threshold)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == expected and 20 < len(set(expected.values())) < 240


@pytest.mark.parametrize("threshold", [50, 75, 95])
def test_op1_rare_pairs_leave_nothing_out(spark, threshold):
    rng = random.Random(threshold)
    words = [[f"v{rng.randrange(40)}" if rng.random() < 0.3 else f"b{k}" for k in range(rng.randint(30, 60))] for _ in range(60)]
    texts = [" ".join(words[rng.randrange(60)][: rng.randint(20, 60)]) for _ in range(120)]
    own = dict(enumerate(map(shingles, texts)))
    df = spark.createDataFrame([(k, k % 7, t) for k, t in enumerate(texts)], "rep long, c long, text string")
    key = minhash.rare_keys(df, threshold).join(df.select("rep", "c"), "rep")
    got = {(min(r), max(r)) for r in minhash.rare_pairs(key, threshold).collect()}
    assert {(min(r), max(r)) for r in minhash.central_pairs(key, threshold).collect()} <= got
    wanted = {(min(p), max(p)) for p in jaccard_links(own, threshold) if p[0] % 7 != p[1] % 7}
    assert wanted <= got and wanted


def test_op1_words_do_not_collide_by_construction(spark):
    # a word of a and b by the parity of the bits of each place, and its complement: equal under any polynomial modulo 2**64
    one = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    got = minhash.near_duplicates(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2)]


def test_op1_sketches_count_agreeing_slots(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (20, 128)).astype(np.uint32)
    s = minhash.sketch(x).tolist()
    df = spark.createDataFrame([(k, s[0], s[k]) for k in range(20)], "k int, a array<long>, b array<long>")
    assert [r[0] for r in df.orderBy("k").select(minhash.agreeing("a", "b")).collect()] == [(x[0] == x[k]).sum() for k in range(20)]


def test_likely_in_keeps_every_id(spark):
    ids = spark.range(0, 3000, 7)
    got = common.likely_in(spark.range(3000).withColumnRenamed("id", "x"), "x", ids)
    assert ids.count() == ids.join(got, ids["id"] == got["x"]).count() and got.count() < 600


def test_op1_ids_that_repeat_with_other_texts(spark):
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, text), (1, other), (2, text + " end"), (3, other + " end"), (4, "alone"), (1, text)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4} and len(got) == 6


def test_op1_odd_rows(spark, odd):
    got = sorted(map(tuple, minhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == 10 and (2, 0, 2, True) in got and (3, 0, 3, True) in got and got.count((1, 2, 1, True)) == 2
    assert (9, 1, 8, False) in got and (None, 2, None, False) in got and [r for r in got if r[0] == 6][0][2:] == (5, False)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    both = np.concatenate([a[:600], a[300:]])
    s = minhash.superminhash(both, np.array([0, 600, 1200]))
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15
    tiny = minhash.superminhash(a[:1], np.array([0, 1]))
    assert sorted((tiny[0] >> 25).tolist()) == list(range(128))  # one element deals every level once


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    expected = components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in expected.items())


def test_workers_forget_what_other_operators_remember(monkeypatch):
    monkeypatch.setattr(common, "_remembers", {})
    code = packing.codec(packing.tokenizer_path())
    common.working_for("packing", packing.forget)
    common.working_for("packing", packing.forget)
    assert packing.codec(packing.tokenizer_path()) is code  # the next task of the same operator finds it
    common.working_for("minhash")
    assert not packing._codecs and not common._remembers
    assert packing.codec(packing.tokenizer_path()) is not code


def test_near_dedup_of_tables_that_are_not_few(spark, monkeypatch):
    """Shuffled joins, as beyond FEW_BYTES, give the rows of broadcast ones."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), " ".join(words[::-1]), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda: sorted(map(tuple, minhash.near_duplicates(df).collect()))
    broadcast = rows()
    monkeypatch.setattr(common, "FEW_BYTES", -1)
    assert rows() == broadcast
    assert [r[2] for r in broadcast] == [0, 0, 0, 3, 4, 5]


def test_op2_equals_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    prints = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + follow[:n]).encode()).hexdigest()
        assert r["near_edited"] >= 0.6 and (r["near_next"] < 0.5 or t[:50] == follow[:50] or t[-50:] == follow[-50:])
        prints[t].add(r["fingerprint"])
    assert len(got) == len(rows) and all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_op2_odd_rows(odd):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == 10 and fingerprint.fingerprints(odd.limit(0)).count() == 0
    one = fingerprint.fingerprints(odd.filter("doc_id = 8")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"worw").hexdigest()


def test_op2_extension():
    random.seed(3)
    for _ in range(50):
        a, b = ("".join(random.choice("ab") for _ in range(40)) for _ in "xy")
        i, j = random.randrange(40), random.randrange(40)
        n = next((k for k in range(min(40 - i, 40 - j)) if a[i + k] != b[j + k]), min(40 - i, 40 - j))
        assert fingerprint.extension(fingerprint.Prefixes(a), fingerprint.Prefixes(b), i, j) == n
        p = fingerprint.fingerprint(a)
        assert fingerprint.read(fingerprint.written(p)) == p


def test_op2_likeness_sees_between_scattered_edits():
    random.seed(4)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(4000)]
    for n in (200, 4000):
        text = words[:n]
        edited = [f"{w}x" if k % (n // 5) == n // 10 else w for k, w in enumerate(text)]
        a, b = fingerprint.fingerprint(" ".join(text)), fingerprint.fingerprint(" ".join(["new", *edited, "end"]))
        assert fingerprint.likeness(a, b) == fingerprint.likeness(b, a) >= (0.7 if n == 200 else 0.97)
        moved = fingerprint.fingerprint(" ".join(text[n // 2 :] + text[: n // 2]))
        assert fingerprint.likeness(a, moved) >= (0.8 if n == 200 else 0.97)
        assert fingerprint.read(fingerprint.written(b)) == b and sum(s & 0xFFFF for s in b.spans) == b.n
    same, other = fingerprint.fingerprint("ab" * 5000), fingerprint.fingerprint("ab" * 2000 + "c" + "ab" * 3000)
    assert len(same.spans) < 100 and fingerprint.likeness(same, other) > 0.9


def test_op2_inverse_takes_a_few_passes():
    passes = 0

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            nonlocal passes
            passes += 1
            plain = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs]
            out = getattr(ufunc, method)(*plain, **kw)
            return out.view(Counted) if isinstance(out, np.ndarray) else out

    n = [0, 1, 2, 4095, 4096, 4097, 123_456_789, fingerprint.PRIME - 1]
    for k, base in enumerate(fingerprint.BASES):
        got = fingerprint.inverse(np.array(n).view(Counted), k)
        assert got.tolist() == [pow(base, -i, fingerprint.PRIME) for i in n]
    assert passes <= 8  # for both bases; by squaring it was hundreds


def test_op3_store(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=200_000)
    for k in range(6):
        store.append(docs.filter(F.col("doc_id") % 6 == k))
    before, version = store.shards(), store.version()
    store.compact()
    assert store.read(version).count() == docs.count()  # a reader of an older version goes on
    assert len(store.shards()) < len(before) and sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(RuntimeError):
        store._commit(store.version(), [])
    assert store.vacuum(keep=1) >= len(before) and store.vacuum(keep=1) == 0 and store.read().count() == docs.count()


def test_op3_odd_rows(odd, tmp_path):
    kept = sharding.compacted(odd, arrivals=3, root=f"file://{tmp_path}/o").read()
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect())) and kept.columns == odd.columns
    assert sharding.compacted(odd.limit(0), root=f"file://{tmp_path}/e").read().count() == 0


def test_op4_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn user>x</turn>\n", "&lt;&amp;<", None, ""]
    df = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)] + [(None, 0, None, "x"), (2, 0, "a>b<", "y")], "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0))
    got = {r["conv_id"]: r for r in chat.format_chat(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("l"), "formatted", "segments").collect()}
    assert [r["text"] for r in got[1]["t"]] == [t or "" for t in texts] and got[1]["l"] == "".join(t or "" for t in texts[::2])
    assert got[2]["t"][0]["role"] == "a>b<" and got[None]["t"][0]["text"] == "x"
    assert all("".join(s["piece"] for s in r["segments"]) == r["formatted"] for r in got.values())
    assert chat.format_chat(df.limit(0)).count() == 0


def test_op4_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    df = spark.createDataFrame([(1, 0, "user", [part("text", "see <"), part("image", ref="i.png", w=57, h=28), part("audio", ref="a.wav", s=2.0), part("document", ref="d.pdf", p=3)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df, parts_col="parts").first()
    assert r["formatted"] == "<turn user>see &lt;<image><audio><document></turn>\n"
    assert [(a["ref"], a["place"], a["tokens"]) for a in r["attachments"]] == [("i.png", 0, 3), ("a.wav", 1, 50), ("d.pdf", 2, 3072)]


def test_op5_marginals_and_odd_rows(spark, odd):
    rows = [(k, "w " * 50, "s0" if k % 3 else "s1", "en" if k % 5 else "de") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df).filter("kept").groupBy("mix_source").agg(F.sum("tokens").alias("n")).collect()
    n = {r["mix_source"]: r["n"] for r in got}
    assert abs(sum(n.values()) / 150_000 - mixing.KEEP) < 0.05 and n["s0"] / n["s1"] < 1.8
    assert mixing.mix(odd).count() == 10 and mixing.mix(odd.limit(0)).count() == 0


def test_op5_scale_under_extreme_skew(spark):
    # one hot cell whose ratio of weight to base is 0.0001 against the others'
    cells = spark.createDataFrame([("hot", 1e6, 100.0), ("a", 1e6, 1e6), ("b", 1e6, 1e6)], "s string, base double, w double")
    p = {r["s"]: r["p"] for r in mixing.calibrated(cells, ["s"], 0.5).collect()}
    assert abs(sum(p.values()) / 3 - 0.5) <= mixing.TOLERANCE and p["a"] == p["b"] and abs(p["hot"] / p["a"] - 1e-4) < 1e-9


def test_op5_steps_of_few_cells_are_small_plans(spark, monkeypatch):
    cells = spark.createDataFrame([(f"={a % 7}", f"={a % 3}", float(1 + a)) for a in range(21)], "dim_a string, dim_b string, base double")
    tempers, plans = {"dim_a": 0.5, "dim_b": 0.8}, []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.cut(df)

    weights = lambda: {r["dim_a"] + r["dim_b"]: r["w"] for r in mixing.rake(cells, list(tempers), tempers, 2).collect()}
    monkeypatch.setattr(mixing, "cut", seen)
    few = weights()
    assert len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
    monkeypatch.setattr(common, "FEW_BYTES", 0)
    many = weights()
    assert few.keys() == many.keys() and len(few) == 21 and all(abs(w - many[k]) < 1e-9 * w for k, w in few.items())


def test_pipeline_repeated_ids(spark):
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(5, text), (5, text), (7, text + " end"), (3, "alone"), (3, "alone"), (7, other), (9, None), (9, None), (None, text), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, text), (3, "alone"), (7, other), (9, None), (None, text), (None, text)], key=str)
    unique = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in minhash.near_duplicates(unique).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, unique, "").collect()) == sorted(kept)


def test_op6_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16))
    x = np.concatenate([x, x[:20] + 0.05 * rng.standard_normal((20, 16)), x[:1] + 0.05 * rng.standard_normal((40, 16)), x[:3]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    expected = components(range(len(y)), zip(*np.nonzero(near), strict=True))
    for leaf in (1000, 24):
        got = {r["vec_id"]: r for r in forest.near_vectors(df, leaf=leaf).collect()}
        found = sum(got[k]["n_links"] for k in range(len(y)))
        assert found <= near.sum() and found >= 0.97 * near.sum()
        assert leaf < 1000 or all((got[k]["n_links"], got[k]["component_id"]) == (near[k].sum(), expected[k]) for k in range(len(y)))
        assert got[900]["n_links"] == got[901]["n_links"] == got[902]["n_links"] == 0 and not got[None]["kept"]
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_op6_doubles_of_any_size_and_length(spark):
    rows = [(0, [1e60, 0.0]), (1, [1e60, 0.0]), (2, [1e-60, 0.0]), (3, [1e-320, 0.0]), (4, [0.0, 1e300]), (5, [1e308, 1e307]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (8, [1.0]), (9, []), (10, [float("inf"), 0.0]), (11, [None, 1.0]), (12, [0.0, -1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{k: (4, 0) for k in (0, 1, 2, 3, 5)}, 6: (1, 6), 7: (1, 6), **{k: (0, k) for k in (4, 8, 9, 10, 11, 12)}}


def test_op6_large_leaf_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = (np.ones(8) + 0.02 * rng.standard_normal((2500, 8))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = forest.near_vectors(df, trees=2).agg(F.min("n_links"), F.max("component_id")).first()
    assert tuple(got) == (2499, 0)


def test_op7_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    special = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|>\n<|endoftext|> b<|endof text|>")], "doc_id long, text string")
    for df, padding in ((docs, True), (odd, False), (special, False)):
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
        pieces = packing.pack(df, packing.tokenizer_path()).collect()
        by, sequences = defaultdict(list), defaultdict(list)
        for p in pieces:
            by[p["doc_id"]].append(p)
            sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        for i, own in texts.items():
            assert sum(p["length"] for p in by[i]) == sum(map(len, own))
            if len(own) == 1:
                at = 0
                for p in sorted(by[i], key=lambda p: p["start"]):
                    assert p["start"] == at and p["doc_tokens"] == len(own[0]) and p["ids_crc32"] == zlib.crc32(own[0][at : at + p["length"]].tobytes())
                    at += p["length"]
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(odd.limit(0), packing.tokenizer_path()).count() == 0


def test_op7_ids_around_added_tokens():
    from tokenizers import Tokenizer

    code, t, rng = packing.codec(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path()), random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "\u3000", "a", "word", "it's", "9", ".", "<|end", "é"]
    texts = ["a\n\n<|endoftext|> b", *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(6000))]
    ids, bounds = code.encode(pa.array(texts))
    assert [i.tolist() for i in np.split(ids, bounds[1:-1])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_op7_latin_words_go_to_the_model(monkeypatch):
    import pyarrow as pa

    code, sent = packing.Codec(packing.tokenizer_path()), []
    whole = code._encode_all
    monkeypatch.setattr(code, "_encode_all", lambda pieces: (sent.extend(pieces), whole(pieces))[1])
    words = "plain Plain, \u00e9t\u00e9! \u0180\u024f\u01c5?! na\u00efve. don't a1b \u00d7 \u00f7, x\u00d7y \u03b1\u03b2\u03b3, \u0436\u0443\u043a. \u4e2d\u6587; \u0250a \U0001f600! ,. a,b \u00aa\u00ba e\u0301t plain! caf\u00e9".split()
    texts = [" ".join(words), *words, "\n".join(words), " ".join(reversed(words)), None, ""]
    for _ in range(2):  # new, then remembered
        ids, bounds = code.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == code.tokenizer.encode(text or "", add_special_tokens=False).ids
    stems = {"plain", "Plain", "\u00e9t\u00e9", "\u0180\u024f\u01c5", "na\u00efve", "caf\u00e9"}
    assert sent and not {x.strip().rstrip(".,;:!?") for x in sent} & stems
    assert {w for known in code.known for w in known} >= stems and "Plain," not in code.known[0]


def test_op8_equals_brute_force(spark):
    random.seed(8)
    base = ["".join(random.choice("abcdefgh ") for _ in range(50)).strip() + "x" * 3 for _ in range(12)]
    texts = {}
    for i in range(30):
        own = []
        for _ in range(4):
            s = random.choice(base)
            k = random.randrange(len(s))
            own.append(random.choice([s, s[:k] + "z" + s[k + 1 :], s[:k] + s[k + 1 :], "short"]))
        texts[i] = own
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()] + [(100, None), (101, ""), (None, base[0])], "doc_id long, text string").withColumn("place", F.lit(0))
    seen = sorted({s for x in texts.values() for s in x if len(s) >= 40})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, prev = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d)))
        return row[-1]

    cls = components(seen, [(a, b) for a in seen for b in seen if a < b and distance(a, b) <= 1])
    first = set()
    expected = {}
    for i, own in texts.items():
        left = []
        for s in own:
            if len(s) < 40 or cls[s] not in first:
                left.append(s)
            if len(s) >= 40:
                first.add(cls[s])
        expected[i] = "\n".join(left)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert {i: got[i] for i in texts} == expected and got[100] is None and got[101] == "" and got[None] == base[0]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_op8_short_lines_that_are_equal_go(spark, tmp_path):
    long = "a line of more than forty characters, told once only"
    texts = ["Menu\n \n" + long, "Menu\n \nok", "ok\nMenus\nMenu\n\n\t\n" + long, "\n\n\t\nMenu"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = ["Menu\n \n" + long, " \nok", "Menus\n\n\t", "\n\n\t"]
    assert [r["text"] for r in lines.op8_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == expected
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == expected


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_op8_bit_parallel_distance(spark, edits):
    random.seed(edits)
    rows = []
    for _ in range(300):
        a = "".join(random.choice("abc") for _ in range(random.randint(0, 20)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(b))
            b[k : k + random.randint(0, 1)] = random.choice(["", "a", "b"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.filter(lines.within(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0


def test_op9_held_out_accuracy(spark, docs, odd):
    got = language.identify(docs.withColumn("told", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "doc_id", "text", F.col("told"), F.col("source")).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id % 2 = 1").collect()
    assert sum(r["language"] == r["lang"] for r in got) / len(got) > 0.97
    assert sum(r["accepted"] for r in got) / len(got) > 0.97
    assert language.identify(odd, "doc_id", "text", F.col("lang"), F.col("source")).count() == 10
    assert language.identify(odd.limit(0), "doc_id", "text", F.col("lang"), F.col("source")).count() == 0


def test_op9_posterior_equals_brute_force(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "a"), (3, "the cat and der hund", "de", "a"), (4, "the dog", None, "b"), (5, "", "en", "b"), (6, "die katze", "xx", None), (7, "und", "de", "a"), (8, "the cat", "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify(df, "doc_id", "text", F.col("lang"), F.col("source")).collect()}
    names = sorted({r[2] for r in rows if r[2]})
    counts = np.full((len(names), language.PLACES), language.ADDED)
    for _, text, lang, _ in rows:
        if lang and len(text) > 2:
            np.add.at(counts[names.index(lang)], language._places(np.frombuffer(text.encode(), dtype=np.uint8)), 1)
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    draw = lambda own, up: [(c + language.PARENT_ROWS * p) / (sum(own) + language.PARENT_ROWS) for c, p in zip(own, up, strict=True)]
    whole = draw([sum(r[2] == n for r in rows) for n in names], [1 / len(names)] * len(names))
    for i, text, lang, source in rows:
        places = language._places(np.frombuffer(text.encode(), dtype=np.uint8)) if len(text) > 2 else []
        total = np.array([model[k][places].astype(np.float32).astype(float).mean() * min(len(places), language.ENOUGH) if len(places) else 0.0 for k in range(len(names))])
        if lang:
            total += [np.log(language.DECLARED_RIGHT if n == lang else (1 - language.DECLARED_RIGHT) / (len(names) - 1)) for n in names]
        if source:
            total += np.log(draw([sum(r[2] == n and r[3] == source for r in rows) - (n == lang) for n in names], whole))
        p = np.exp(total - total.max())
        assert got[i]["language"] == names[int(p.argmax())] and abs(got[i]["confidence"] - p.max() / p.sum()) < 1e-5


def test_op9_keeps_languages_that_are_rare(spark):
    rows = [(k, f"the cat sat on the mat and saw the dog {k}", "en", "s") for k in range(3000)]
    rows += [(5001, "der hund und die katze sehen das haus", "de", "s"), (5002, "das haus der katze und der hund", "de", "s"), (5003, None, "it", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in language.identify(docs, "doc_id", "text", F.col("lang"), F.col("source")).collect()}
    assert all(got[k]["language"] == "en" and got[k]["accepted"] for k in range(3000))
    assert all(got[k]["language"] == "de" and got[k]["accepted"] for k in (5001, 5002)) and not got[5003]["accepted"]
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").filter("doc_id > 5000").collect()} == {5001: "de", 5002: "de"}


def test_op9_pages(spark):
    got = Counter(r["language"] == r["declared"] for r in language.op9_language_id_pages(spark, SF).collect())
    assert got[True] >= 0.8 * sum(got.values())


def test_op10_rules(spark):
    urls = ["http://A.example.com/en/x", "http://www.example.com/en/?q", "http://x.com", "http://x.com/", "ftp://example.com/en", None, "no scheme", "http://a.net/fr/", "http://net/es/1", "http://badexample.com/en/", "x://y://z.com/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id long, url string").withColumn("host", F.lit("h"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rules_frame(spark, url_filter.RULES)).collect() if r["page_id"] is not None)
    assert len(got) == 12 and got[0] == (0, "a.example.com", "/en/x", "example.com/en/", "block") and got[1][3:] == ("www.example.com/en/", "allow")
    assert got[2] == (2, "x.com", "", None, "allow") and got[3] == got[4] and [r[3] for r in got if r[0] in (7, 8, 9)] == ["net/fr/", "net/es/", "com/"]
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, [])).count() == 0


def test_pipeline_near_dedup_tells_rows_with_nulls_apart(spark):
    rows = [(1, None, "x y", "s", 0), (1, "x y", None, "s", 0), (1, "x y", None, "s", 0), (2, None, None, None, None), (2, None, None, None, None), (2, None, None, None, 0)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, set(rows)))
