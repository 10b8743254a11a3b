"""Nearest neighbours against brute force."""

import numpy as np

from quirework.llm import nearest


def brute(rows, k=20):
    sound = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    sound = [r for r in sound if len(r[1]) == len(rows[0][1])]
    out = {}
    for q, v in sound:
        if q % 20 == 0:
            near = sorted(((-float(np.dot(v, w)), i) for i, w in sound if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_on_the_given_table(spark, folder):
    t = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in t.collect()]
    want = brute(rows)
    got = {}
    for r in nearest.search(t, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) / 20 for q in want]) >= 0.95
    for q, v in got.items():
        ranked = [v[i] for i in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))


def test_exact_when_every_bucket_is_probed(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(200, None), (201, [0.0] * 6), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (241, [float("inf")] * 6), (None, rows[1][1]), (260, [1.0, 2.0])]
    rows += [rows[3], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for hashes in (1, 2):
        got = {}
        for r in nearest.search(df, "vec_id % 20 = 0", tables=2, probes=10_000, hashes=hashes, axes=8, part=16).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        want = brute(rows)
        assert set(got) == set(want)
        for q, v in want.items():
            mine = [got[q][i + 1] for i in range(len(got[q]))]
            assert [i for i, _ in mine] == [i for i, _ in v] and np.allclose([s for _, s in mine], [s for _, s in v])


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.search(df, "vec_id % 20 = 0", probes=200).collect()] == [(0, 1, 1, 0.5)]
    assert nearest.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_registered_settings_on_few_rows_and_uneven_norms(spark, folder):
    given = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rng = np.random.default_rng(5)
    uneven = [(i, (np.array(v) * f).tolist()) for (i, v), f in zip(given, rng.lognormal(0, 1, len(given)))]
    one = [(i, [x * 100 for x in v]) if i == 3 else (i, v) for i, v in given]
    for rows, least in ((given[:15], 1.0), (given[:21], 1.0), (given[:90], 0.95), (uneven, 0.95), (one, 0.95)):
        got = {}
        for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = brute(rows)
        assert set(got) == set(want) and all(len(got[q]) == min(20, len(rows) - 1) for q in want)
        assert np.mean([len({i for i, _ in want[q]} & got[q]) / len(want[q]) for q in want]) >= least


def test_one_vec_id_with_several_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.1, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.search(df, "vec_id % 20 = 0").collect())
    assert got == sorted([(0, 1, 1, 0.9), (0, 2, 2, 0.5), (0, 3, 1, 0.1), (0, 4, 0, 0.0), (0, 1, 2, 0.5), (0, 2, 0, 0.0), (0, 3, 1, 0.0), (0, 4, 1, 0.0)])


def test_fewer_probes_on_a_larger_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(20 * i if i % 300 == 0 else 20 * i + 1, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids = np.array([i for i, _ in rows])
    want = {int(ids[q]): set(ids[np.argsort(-np.where(np.arange(9000) == q, -9, x @ x[q]))[:20]].tolist()) for q in range(0, 9000, 300)}
    assert set(got) == set(want) and np.mean([len(want[q] & got[q]) / 20 for q in want]) >= 0.9


def test_probes_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """A table of 8,200 rows, past which fewer buckets were looked into, is searched like a small one."""
    asked, buckets = [], nearest.buckets
    monkeypatch.setattr(nearest, "buckets", lambda rows, turn, ranges, probes: asked.append(probes) or buckets(rows, turn, ranges, probes))
    x = np.random.default_rng(4).normal(size=(8200, 8)).astype(np.float32)
    for n in (300, 8200):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "vec_id long, embedding array<float>")
        nearest.search(df, "vec_id % 2000 = 0")
    assert {p for p in asked if p is not None} == {nearest.PROBES}
