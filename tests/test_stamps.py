"""Stamp vectors against pixel by pixel arithmetic, through to groups, and on odd images; page labels and key cells."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as txt
from quire.operators import images, stamps
from quire.sources import layout


def line(values, side):
    """One row of pixels resampled, a pixel at a time."""
    n, out = len(values), []
    scale = n / side
    wide = max(1.0, scale)
    for k in range(side):
        centre = (k + 0.5) * scale
        low, high = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        w = []
        for x in range(low, high):
            t = (x - centre + 0.5) / wide
            w.append(1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3) if abs(t) < 3 else 0.0)
        whole = [int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
        out.append(min(255, max(0, (sum(a * b for a, b in zip(whole, values[low:high], strict=True)) + 2**21) >> 22)))
    return out


def brute(rgb, width, height, side):
    gray = [(19595 * rgb[i] + 38470 * rgb[i + 1] + 7471 * rgb[i + 2] + 32768) >> 16 for i in range(0, len(rgb), 3)]
    across = [line(gray[y * width : (y + 1) * width], side) for y in range(height)]
    down = [line([row[x] for row in across], side) for x in range(side)]
    flat = [down[x][y] for y in range(side) for x in range(side)]
    length = math.sqrt(sum(x * x for x in flat))
    return [x / length for x in flat] if length else flat


def test_vectors_equal_brute_force():
    rng = random.Random(1)
    for width, height in ((30, 41), (64, 64), (7, 150), (1, 1), (131, 3)):
        rgb = bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(3 * width * height))
        assert np.allclose(stamps.vector(rgb, width, height, 16), brute(rgb, width, height, 16), atol=1e-7)


def test_vectors_to_groups(spark):
    disc = lambda n, r: bytes(c for y in range(n) for x in range(n) for c in ((200, 20, 20) if math.hypot(x - n / 2, y - n / 2) < r * n else (0, 0, 0)))
    rows = [("d", 0, 60, 60, disc(60, 0.4)), ("d", 1, 90, 90, disc(90, 0.4)), ("d", 2, 60, 60, disc(60, 0.1)), ("e", 0, 60, 60, disc(60, 0.4)), ("d", 3, 60, 60, b"\0" * 10800), ("d", 4, 60, 60, b"short"), ("d", 5, None, 60, b""), ("d", 6, 0, 0, b""), ("d", 7, 60, 60, None)]
    df = spark.createDataFrame(rows, "doc_id string, img_no int, width int, height int, rgb binary").withColumn("v", F.lit(1))
    v = stamps.stamp_vectors(df)
    got = {(r["doc_id"], r["img_no"]): r["v"] for r in v.collect()}
    assert [k for k, x in got.items() if x is None] == [("d", k) for k in (4, 5, 6, 7)] and set(got["d", 3]) == {0.0} and len(got["d", 0]) == 64 * 64
    v = v.withColumnRenamed("img_no", "ord").filter("v is not null and not (doc_id = 'd' and ord = 3)")
    groups = images.stamp_groups(v, images.similar_pairs(v, 0.9)).collect()
    assert sorted(map(tuple, groups)) == [("d", 0, 0), ("d", 1, 0), ("d", 2, 2), ("e", 0, 0)]
    assert stamps.stamp_vectors(df.limit(0)).count() == 0


def test_page_labels_and_key_cells(spark):
    labels = {"13-26": 13, "13": 13, " 7 -8": 7, "1-2-3": 1, "-5": None, "x": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in labels], "x string").select("x", txt.first_page(F.col("x")).alias("p")).collect()
    assert {r["x"]: r["p"] for r in got} == labels
    cells = {"<tr><td>1</td><td></td></tr>": True, "<tr><td a='b'> \n　</td><td>x</td></tr>": False, "<TD\nrowspan=2>\na</TD>": True, "<td></td>": False, "<tr></tr>": False, "<td>open": False, "": False, None: False}
    got = spark.createDataFrame([(k,) for k in cells], "x string").select("x", txt.has_key_cell(F.col("x")).alias("p")).collect()
    assert {r["x"]: r["p"] for r in got} == cells


def test_blocks_of_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(images, "BLOCK", 8 * 40)  # 40 vectors a block
    rng = random.Random(2)
    rows = [(d, k, [rng.gauss(0, 1) for _ in range(8)]) for d in "ab" for k in range(150)]
    rows += [("a", 150 + k, list(rows[7][2])) for k in range(30)] + [("c", 0, [1.0] * 8), ("b", 200, None), ("b", 201, [1.0] * 7), ("b", 202, [1.0] * 7)]
    v = spark.createDataFrame(rows, "doc_id string, ord int, v array<double>")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    known = [r for r in rows if r[2] is not None]
    expected = {(d, m, n): dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) for d, m, x in known for e, n, y in known if d == e and m < n and len(x) == len(y)}
    expected = {k: round(c, 4) for k, c in expected.items() if c >= 0.8}
    got = images.similar_pairs(v, 0.8).collect()
    assert {tuple(r)[:3]: r["similarity"] for r in got} == expected and len(got) == len(expected)
    # pairs of copies are many, links are not, and connect the same stamps
    links = images.similar_links(v, 0.8)
    assert links.join(images.similar_pairs(v, 0.8), ["doc_id", "a", "b"], "left_anti").count() < links.count() < len(expected) / 2
    groups = [sorted(map(tuple, images.stamp_groups(v, p).collect())) for p in (links, images.similar_pairs(v, 0.8))]
    assert groups[0] == groups[1] and len(groups[0]) == len(known)


def test_vectors_at_once_equal_one_by_one():
    rng = random.Random(3)
    sizes = [(30 + k % 9, 40 + k % 7) for k in range(40)] + [(None, 4), (0, 0), (4, -4)]
    given = [(rng.randbytes(3 * (w or 0) * max(h, 0)), w, h) for w, h in sizes] + [(None, 3, 3), (b"short", 3, 3), (b"\0" * 27, 3, 3)]
    got = stamps.vectors(given, 16).to_pylist()
    for v, image in zip(got, given, strict=True):
        one = stamps.vector(*image, 16)
        assert v is None if one is None else v == one.tolist()
    assert stamps.vectors([], 16).to_pylist() == [] and stamps.vectors([(None, 1, 1)], 16).to_pylist() == [None]


def test_pixels_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(layout, "PARTS", 20)
    assert layout.stamp_pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 10
