"""Conversation repair against brute force, and on nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import repair

SF = "/root/testdata/sf0.001"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INF = 10**9


def cheapest(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault) by all edits, tried from the end on."""
    best = [[(INF, "", ()) for _ in range(4)] for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for q in range(4):
            options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
            if i < len(rows):
                role, text, fault = rows[i]
                c, e, r = best[i + 1][q]
                options.append((c + 4, "D" + e, r))
                for edit, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if fault not in ("blank", "duplicate") and (q, new[:1]) in NEXT:
                        c, e, r = best[i + 1][NEXT[q, new[:1]]]
                        options.append((c + 3 * (edit == "R") + 3 * (fault == "truncated"), edit + e, ((new, text), *r)))
            best[i][q] = min(options, default=(INF, "", ()))
        for _ in range(4):
            for q, new in itertools.product(range(4), ("user", "assistant")):
                if (q, new[0]) in NEXT:
                    c, e, r = best[i][NEXT[q, new[0]]]
                    best[i][q] = min(best[i][q], (c + 3, "I" + e, ((new, ""), *r)))
    return best[0][0]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        told = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def expected(rows):
    """rows (turn, role, text) of a conversation, damaged -> the query's columns."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    own = faults([r[1:] for r in rows])
    cost, audit, out = cheapest([(*r[1:], f) for r, f in zip(rows, own, strict=True)])
    turns = {r[0] for r in rows} - {None}
    joints = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[own.count(f) for f in ("blank", "duplicate", "truncated")], sum(j not in ("su", "ua", "au") for j in joints), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(conv, turn, role, text):
    part = lambda v: " " if v is None else str(v)
    role, text = part(role), part(text)
    way = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
    if way == 0:
        return []
    text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
    return [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(damage(conv, turn, role, text))
    return {conv: expected(own) for conv, own in convs.items()}


def answers(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op12_equals_brute_force(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    want = brute(rows)
    assert answers(repair.op12_conversation_repair(spark, sf)) == want and any(v[5] for v in want.values())


def test_op12_on_odd_rows(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, *range(12)]), rnd.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool", "unknown", "User"]), rnd.choice([None, "", " \t", "a.", "a", "b! ", "c?\n", "é", "d. ", "e.", "f"])) for _ in range(150)]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"{'long ' * 20_000}{t}.") for t in range(4)] + [(10, None, "system", "s."), (11, 0, "assistant", None)]
    rows += [(20, t, rnd.choice(["user", "assistant"]), rnd.choice(["x.", "y"])) for t in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.selectExpr("*", "1 as row_no", "'x' as edit", "2 as conv", "3 as place").write.parquet(str(tmp_path / "conversations.parquet"))
    assert answers(repair.op12_conversation_repair(spark, str(tmp_path))) == brute(rows)


def test_op12_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op12_conversation_repair(spark, str(tmp_path)).collect() == []


def test_repairer_equals_brute_force_and_stays_small():
    rnd, machine = random.Random(3), repair.Repairer()
    for _ in range(3_000):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), "t", rnd.choice([None, None, "truncated", "blank"])) for _ in range(rnd.randrange(9))]
        cost, edits, _ = cheapest(rows)
        assert machine.edits(["x" if f == "blank" else r[0] + ("!" if f else "") for r, _, f in rows]) == (cost, edits)
    assert len(machine.vectors) < 60


def test_repaired_rows_follow_the_grammar(spark):
    _, _, rows = repair.repair(repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet")))
    told = {}
    for r in sorted(rows.collect(), key=lambda r: (r["conv"], r["place"])):
        told[r["conv"]] = told.get(r["conv"], "") + r["role"][0]
    assert told and all(re.fullmatch("s?(ua)+", t) for t in told.values())
