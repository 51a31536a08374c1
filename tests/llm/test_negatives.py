"""Hard negatives against brute force, and on the odd cases."""

import math
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def plain(rows, anchors, positives=5, count=3, low=50, high=95):
    usable = [(i, v, la) for i, v, la in rows if i is not None and la is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    length = Counter(len(v) for _, v, _ in usable).most_common(1)[0][0]
    known = sorted({(i, la, tuple(math.floor(256 * x) for x in v)) for i, v, la in usable if len(v) == length and all(abs(x) < 1e5 for x in v)})
    matrix = np.array([v for *_, v in known], dtype=object)
    out = Counter()
    for a in known:
        if a[0] % anchors:
            continue
        scores = (matrix * np.array(a[2], dtype=object)).sum(axis=1)
        ranked = sorted(((s, r) for s, r in zip(scores, known, strict=True) if r != a), key=lambda x: (-x[0], x[1][0]))
        for ps, p in [x for x in ranked if x[1][1] == a[1]][:positives]:
            under = [(s, r) for s, r in ranked if r[1] != a[1] and low * ps <= 100 * s <= high * ps][:count]
            out.update((a[0], p[0], n + 1, r[0], ps, s) for n, (s, r) in enumerate(under))
    return out


def mined(spark, rows, anchors):
    frame = spark.createDataFrame([(i, v, la, "s", 9) for i, v, la in rows], SCHEMA).repartition(3)
    return negatives.mine(frame, frame.where(f"vec_id % {anchors} = 0"))


@pytest.mark.parametrize("kind", ["spread", "clustered", "few values"])
def test_against_brute_force(spark, kind):
    r = np.random.default_rng(len(kind))
    if kind == "spread":
        data = r.normal(size=(500, 16))
    elif kind == "clustered":
        data = np.repeat(r.normal(size=(12, 3)) * 5, 50, axis=0) + 0.05 * r.normal(size=(600, 3))
    else:
        data = r.integers(-1, 2, size=(400, 4)) / 2
    rows = [(i, [float(x) for x in v], int(r.integers(0, 4))) for i, v in enumerate(data)]
    rows += [(1_000 + i, [0.5] * data.shape[1], i % 2) for i in range(60)]  # one vector that many share
    rows += [rows[3], rows[3], (10, rows[3][1], 1), (10, rows[4][1], rows[10][2]), (20, rows[20][1], 3)]
    rows += [(2_000, None, 1), (2_010, [None] + [1.0] * (data.shape[1] - 1), 1), (2_020, rows[0][1], None), (None, rows[0][1], 1), (2_030, [float("nan")] * data.shape[1], 1), (2_040, [1.0], 1)]
    rows += [(2_050, [float("inf")] * data.shape[1], 1), (2_060, [1e300] * data.shape[1], 1), (2_070, [0.0] * data.shape[1], 1), (2_080, [], 1), (-10, rows[7][1], 2)]
    got = mined(spark, rows, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(x) for x in got.collect()) == plain(rows, 10)


def test_many_leaves_and_small_chunks(spark, monkeypatch):
    for name, value in (("FIRST_ROWS", 20), ("CHUNK_ROWS", 40), ("BLOCK_ROWS", 7), ("BLOCKS", 2)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], int(r.integers(0, 3))) for i, v in enumerate(r.normal(size=(700, 5)))]
    assert Counter(tuple(x) for x in mined(spark, rows, 9).collect()) == plain(rows, 9)


def test_the_tree_leaves_out_what_cannot_hold(spark):
    r = np.random.default_rng(6)
    points = (256 * (np.repeat(r.normal(size=(30, 8)), 100, axis=0) + 0.01 * r.normal(size=(3_000, 8)))).astype(np.int64)
    radius2 = int((points**2).sum(axis=1).max())
    tree = negatives.Tree(points, 60, radius2)
    leaf, tree.lo, tree.hi = tree.assign(points)
    near, most = tree.bounds(points[:50])
    scores = points[:50] @ points.T
    for i in range(50):
        low, high = np.sort(scores[i])[[-60, -20]]
        inner, outer = negatives._rims(np.array([(points[i] ** 2).sum()]), radius2, np.array([[high]]), np.array([[low]]), tree.slack)
        opened = list(tree.nearest_first(near[i].tolist(), most[i].tolist(), inner[0, 0], outer[0, 0]))
        inside = (scores[i] >= low) & (scores[i] <= high)
        assert set(leaf[inside].tolist()) <= set(opened) and len(opened) == len(set(opened)) < tree.leaves / 2


def test_large_scores_and_nothing(spark):
    rows = [(i, [1e4 * (i % 7) + i, -1e4 + i, float(i)], i % 2) for i in range(80)]
    assert Counter(tuple(x) for x in mined(spark, rows, 10).collect()) == plain(rows, 10)
    assert mined(spark, [], 10).count() == 0
    assert mined(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)], 10).count() == 0
    assert mined(spark, [(0, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)], 10).count() == 0
