"""Whitening against numpy over all rows at once, up to the sign of a component."""

import math

import numpy as np
import pytest

from quirework.llm import whiten

KIND = "vec_id long, embedding array<double>"


def sound(rows):
    own = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = max((sum(len(v) == n for _, v in own), n) for n in {len(v) for _, v in own})[1]
    return [(i, [math.floor(1024 * x) + 100000 for x in v]) for i, v in own if len(v) == d]


def brute(rows, weights="counts"):
    own = sound(rows)
    fit = [list(x) for x in {tuple(x) for _, x in own}] if weights == "one" else [x for _, x in own]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in own:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array([float(n * a - s) / n for a, s in zip(x, sums)]) @ u[:, :8]
        for c in range(min(8, len(x))):
            flat = e[c] <= 1e-13 * len(e) * max(e[0], 0)
            out.append((i, c + 1, n, dev, 0.0 if flat else z[c] / math.sqrt(e[c]), 0.0 if flat else e[c] / e.sum()))
    return out


def check(spark, rows, weights="counts", kind=KIND):
    got = whiten.whiten(spark.createDataFrame(rows, kind).repartition(4), weights=weights).collect()
    want = brute([r[:2] for r in rows], weights)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, abs(r[4]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    signs = {}
    for g, w in zip(got, want):
        assert (g[0], g[1], g[2]) == w[:3] and (g[3] == w[3] or w[3] >= 2**63 and g[3] is None)
        assert g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-8) or -g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-8)
        assert g[5] == pytest.approx(w[5], rel=1e-4)
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g[1], np.sign(g[4] / w[4])) == np.sign(g[4] / w[4])
    assert len({r[6] for r in got}) == 1 and got[0][6] <= 1e-4
    return got


def stretched(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * np.linspace(3, 0.2, d)


def test_given_table(spark, folder):
    t = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in t.collect()]
    got = check(spark, rows)
    assert len(got) == 8 * len(rows)


def test_odd_rows(spark):
    x = stretched(120, 10)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[3].tolist()) for i in range(90)]
    rows += [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] + [0.0] * 9), (904, [float("inf")] * 10), (905, [1.0, 2.0]), (None, x[4].tolist()), (7, x[7].tolist()), (7, x[8].tolist())]
    check(spark, rows)
    check(spark, rows, "one")


def test_hot_and_far(spark, monkeypatch):
    monkeypatch.setattr(whiten, "HEAVY", 8)
    x = stretched(60, 5, 3)
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[0].tolist())] * 100)
    check(spark, [(i, (v + 1e7).tolist()) for i, v in enumerate(x)])


def test_few_rows_and_flat_components(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]):
        check(spark, rows)
    assert whiten.whiten(spark.createDataFrame([], KIND)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None)], KIND)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_do_not_crash(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (3 * i), float(i)]) for i in range(12)]
    got = whiten.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 24 and all(math.isfinite(r["whitened"]) for r in got)


def test_clashing_columns(spark):
    rows = [(i, v.tolist(), "q", 5) for i, v in enumerate(stretched(20, 3))]
    check(spark, rows, kind=KIND + ", x string, copies int")
    check(spark, [r[:2] + (1,) for r in rows], kind="vec_id int, embedding array<float>, n int".replace("float", "double"))
