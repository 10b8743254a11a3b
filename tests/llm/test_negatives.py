"""Hard negatives against a plain program over all pairs."""

import math

import numpy as np

from quirework.llm import negatives

KIND = "vec_id long, label int, embedding array<double>"


def cut(v):
    return max(-(2**63), min(2**63 - 1, v))


def brute(rows, anchors=lambda i: i % 100 == 0, low=80, high=100, k=5):
    own = {(i, lab, tuple(math.floor(max(-(2.0**56), min(2.0**56, 256 * x))) for x in v)) for i, lab, v in rows
           if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in own:
        if not anchors(a[0]):
            continue
        score = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in own if b != a and len(b[2]) == len(a[2])))
        for p, i, _ in [s for s in score if s[2] == a[1]][:k]:
            hard = [s for s in score if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(a[0], i, r + 1, s[1], cut(-p), cut(-s[0])) for r, s in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, kind=KIND, parts=4, **how):
    return sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, kind).repartition(parts), "vec_id % 100 = 0", **how).collect())


def grouped(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, d))
    return [(i, int(i % labels), (middle[0] + middle[i % labels] * 0.2 + rng.normal(size=d) * 0.3).tolist()) for i in range(n)]


def test_random_tables(spark):
    for seed, d in ((1, 3), (2, 16)):
        rows = [(i * 10, lab, v) for i, lab, v in grouped(300, d, seed)]
        want = brute(rows)
        assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, low=20, high=130, positives=2, negatives=3) == sorted(
        r for r in brute(rows, low=20, high=130) if r[2] <= 3 and r[1] in {p for _, p in _first_positives(rows, 2)[r[0]]})


def _first_positives(rows, k):
    out = {}
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    for a in own:
        if a[0] % 100 == 0:
            out[a[0]] = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0]) for b in own if b[0] != a[0] and b[1] == a[1])[:k]
    return out


def test_small_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "CHUNK", 33)
    rows = [(i * 5, lab, v) for i, lab, v in grouped(700, 8, 5)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, parts=7) == want


def test_odd_rows(spark):
    rows = [(i * 20, lab, v) for i, lab, v in grouped(120, 4, 9)]
    v = rows[7][2]
    rows += [(5000 + i, i % 3, v) for i in range(80)]  # a common vector under several labels
    rows += rows[:9] + [(0, 1, rows[1][2]), (0, 0, rows[2][2]), (300, None, v), (None, 1, v), (400, 1, None), (500, 1, [None] * 4), (600, 2, [float("nan")] * 4),
                        (700, 2, [float("inf"), 0.0, 0.0, 0.0]), (800, 1, [1.0]), (801, 1, [2.0]), (802, 2, [1.9]), (900, 2, []), (901, 2, []), (902, 3, [])]
    want = brute(rows)
    assert mined(spark, rows) == want and (800, 801, 1, 802, 256 * 512, 256 * 486) in want and (900, 901, 1, 902, 0, 0) in want


def test_signs_zeros_and_huge_entries(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0]), (2, 1, [-0.9, 0.0]), (100, 5, [0.0, 0.0]), (101, 5, [1.0, 1.0]), (102, 6, [2.0, 2.0]), (200, 7, [1e300, -1e300]), (201, 7, [1e300, 1.0]),
            (202, 8, [1e299, -3.0]), (300, 9, [3e9, 1.0]), (301, 9, [3e9, 2.0]), (302, 8, [2.9e9, 2.0])]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []
    rows = [(i * 25, lab, v, 1, "z") for i, lab, v in grouped(60, 3, 4)]
    assert mined(spark, rows, KIND + ", n int, x string") == brute([r[:3] for r in rows])


def test_tree_spans_and_bounds_save_work():
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(size=(1, 12)) * 200 + rng.normal(size=(40, 12)) * 4 for _ in range(5)]).astype(np.int64)
    order, depths, edges = negatives.tree(y)
    assert sorted(order.tolist()) == list(range(200)) and depths[0] == 1 and (np.diff(depths) <= 1).all()
    path = [np.zeros(12)]
    for i, deep, edge in zip(order, depths, edges):
        del path[deep:]
        assert np.isclose(np.linalg.norm(y[i] - path[-1]), edge)
        path.append(y[i])
    x = np.concatenate([rng.normal(size=(1, 12)) * 200 + rng.normal(size=(400, 12)) * 4 for _ in range(8)]).astype(np.int64)
    pack = lambda m, lab: negatives.Rows(m.shape[1], len(m), np.arange(len(m)).tobytes(), lab.tobytes(), *negatives._packed(m))
    own, anchors, asked = pack(x, np.zeros(len(x), np.int64)), pack(y[order], np.ones(200, np.int64)), 0

    def wanted(i, low, high):
        nonlocal asked
        exact = x @ y[order][i]
        assert (low <= exact).all() and (exact <= high).all()
        at = np.flatnonzero((high >= 300_000) & (low <= 320_000))
        asked += len(at)
        return at

    got = {(i, j) for i, at, score in negatives.visit(own, anchors, depths, edges, wanted) for j, s in zip(at.tolist(), score.tolist()) if 300_000 <= s <= 320_000}
    exact = x @ y[order].T
    want = {(i, j) for j, i in np.argwhere((exact >= 300_000) & (exact <= 320_000)).tolist()}
    assert got == want and asked < 0.35 * 200 * len(x)


def test_labels_move(spark):
    df = spark.createDataFrame([(7, 9), (14, 3), (1, 9), (None, 2), (21, None)], "vec_id long, label int")
    assert sorted(((r["vec_id"], r["label"]) for r in negatives.shifted_labels(df).collect()), key=str) == [(1, 9), (14, 4), (21, None), (7, 0), (None, 2)]
