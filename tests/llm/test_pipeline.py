"""Every stage against brute force on what it was given."""

import itertools

import corpus_pipeline
import pytest
from test_bpe import T
from test_near import brute as brute_near
from test_words_ops import brute_hits

from quirework.llm import toxicity
from quirework.session import cut_lineage


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], folder)))
    return [(d, d.collect()) for d in docs]


def test_columns(steps):
    assert all(d.columns == steps[0][0].columns for d, _ in steps[:-1])
    assert steps[-1][0].columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "decoded"]


def test_toxic_documents_go(spark, steps, folder):
    rated = toxicity.report(steps[0][0], spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert {r["doc_id"] for r in steps[1][1]} == {r["doc_id"] for r in rated if not r["predicted"]}


def test_one_line_of_each_kind_stays(steps):
    before, after = ({r["doc_id"]: r for r in s[1]} for s in steps[1:3])
    assert before.keys() == after.keys() and all(r["n_chars"] == len(r["text"]) for r in after.values())
    first, sets = {}, {}
    for doc in sorted(before):
        for pos, line in enumerate(before[doc]["text"].split("\n")):
            f = line.strip(" ").lower()
            if f:
                first.setdefault(f, (doc, pos))
                sets.setdefault(f, {f[i : i + 8] for i in range(len(f) - 7)})
    up = {f: f for f in first}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted((f for f in first if sets[f]), key=lambda f: len(sets[f]))
    for i, x in enumerate(order):
        for y in itertools.takewhile(lambda y: 100 * len(sets[x]) >= 80 * len(sets[y]), order[i + 1 :]):
            k = len(sets[x] & sets[y])
            if 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
                up[find(x)] = find(y)
    best = {}
    for f, at in first.items():
        best[find(f)] = min(best.get(find(f), at), at)
    wrong = total = 0
    for doc, r in before.items():
        kept = [x for i, x in enumerate(r["text"].split("\n")) if not x.strip(" ") or best[find(x.strip(" ").lower())] == (doc, i)]
        total += len(r["text"].split("\n"))
        wrong += "\n".join(kept) != after[doc]["text"]
    assert wrong <= 2 and total > 500


def test_one_of_each_near_copy_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2][1]]
    assert {r["doc_id"] for r in steps[3][1]} == {r[0] for r in brute_near(rows, 5) if r[3]}


def test_contaminated_documents_go(spark, steps, folder):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in steps[3][1]], items) if not r[5]}
    assert {r["doc_id"] for r in steps[4][1]} == want


def test_tokens(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4][1]}
    assert len(steps[5][1]) == len(texts)
    for r in steps[5][1]:
        assert r["token_ids"] == T.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == T.decode(r["token_ids"], skip_special_tokens=False)


def test_run(spark, folder, steps):
    assert corpus_pipeline.run(spark, folder).count() == len(steps[-1][1])


def test_null_and_empty_rows(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, 3), (3, "a text\n\na text", None, "s", 14)], steps_schema)
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = cut_lineage(stage(spark, some, folder))
        some.collect()


steps_schema = "doc_id long, text string, lang string, source string, n_chars long"
