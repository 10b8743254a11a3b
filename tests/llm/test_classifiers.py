"""Learnt models: held-out accuracy on the given tables, edge rows, and what may not change a score."""

import os

import numpy as np
import pytest

from quirework.llm import langid, quality, toxicity

EDGE = [(10_001, None, None), (10_002, "", "en"), (10_003, " 12 ## ", None), (None, "the that with", "en"), (10_004, "x" * 300_000, "en")]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_language(spark, docs):
    rows = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(EDGE, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.report(rows).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert held and np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    for d in (10_001, 10_002, 10_003):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == docs.count() + len(EDGE)


def test_language_by_hand(frame):
    """Posterior against the textbook formula on the same buckets."""
    rows = [(i, t, x) for i, (t, x) in enumerate([("ab ba", "p"), ("bb", "p"), ("ca", "q"), ("cc ac", "q"), ("ba", "q")] * 3)]
    docs = frame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for d, text, _ in rows:
        logs = model.prior.astype(float).copy()
        t = f" {text} "
        for n in langid.ORDERS:
            for i in range(len(t) - n + 1):
                _, b = langid._buckets(np.frombuffer(t[i : i + n].encode("utf-32-le"), dtype=np.uint32), n)
                logs += model.logs[b[0]]
        p = np.exp(logs - logs.max())
        assert got[d]["lang_pred"] == model.langs[int(np.argmax(p))] and abs(got[d]["score"] - (p / p.sum()).max()) < 1e-6


def test_language_without_anything_to_learn(frame):
    out = langid.report(frame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert out[0]["lang_pred"] == "und" and langid.report(frame([], "doc_id long, text string, lang string")).count() == 0


def test_quality(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([x[:2] for x in EDGE], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in quality.report(rows, labels).collect()}
    assert len(got) == docs.count() + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert held and np.mean([a == b for a, b in held]) > 0.75


def test_machine_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)))
    at, x = np.array([3, 50, 900, 7]), rng.normal(size=4)
    slow = m.bias + (m.weights[at] * x).sum() + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.margins(at, x, np.array([0]))[0] - slow) < 1e-9


def test_quality_without_labels(frame):
    none = frame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.report(frame([(1, "a b")]), none).collect()] == [0.5]
    assert quality.report(frame([]), none).count() == 0


def test_toxicity(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([x[:2] for x in EDGE], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in toxicity.report(rows, labels).collect()}
    assert len(got) == docs.count() + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert held and np.mean([a == b for a, b in held]) > 0.85
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_toxic_documents_are_found(spark, folder):
    """The smallest folder has ten toxic examples, too few to learn from; the next one has forty-five."""
    larger = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a and b for a, b in held) >= 0.8 * sum(a for a, _ in held) and sum(b and not a for a, b in held) <= 0.02 * len(held)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    m, n = 40, 700
    dense = rng.random((n, m)) * (rng.random((n, m)) < 0.1)
    dense[50:60] = dense[50]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = toxicity.Index(np.arange(m, dtype=np.uint64), np.ones(m), list(range(n)), (rng.random(n) < 0.3).astype(int), (1.0, 1.0))
    index.fill([(np.flatnonzero(v), v[v > 0]) for v in dense])
    for v in dense[:200]:
        if v.any():
            cos = np.round(dense @ v, 12)
            want = [i for i in np.lexsort((np.arange(n), -cos))[: toxicity.NEAREST] if cos[i] > 0]
            ids, got = index.nearest(np.flatnonzero(v), v[v > 0])
            assert ids.tolist() == want and np.allclose(got, cos[want])


def test_toxicity_without_labels(frame):
    none = frame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.report(frame([(1, "a b")]), none).collect()] == [0.0]
    assert toxicity.report(frame([]), none).count() == 0


def test_numbers_are_no_letters(frame):
    from quirework.llm import chars
    assert chars.letters("½ ² ① Ⅷ") == "" and chars.letters("x²y, 3½ Ⅷb") == " x y b "
    got = langid.report(frame([(i, t, "en") for i, t in enumerate(["½ ² ① Ⅷ", "the words", "and more"])], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()}[0] == "und"
