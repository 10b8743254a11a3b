"""Near-duplicate components against brute force over all pairs."""

import itertools
import random
import re

import numpy as np
from conftest_llm import SPACE, lower

from quirework.llm import links, near, words


def brute(rows, size, similar=80):
    sets = []
    for doc, text in rows:
        ws = re.findall(SPACE, lower(text))
        sets.append({tuple(ws[i : i + size]) for i in range(max(len(ws) - size + 1, 1))} if ws else set())
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip([r[0] for r in rows], sets), 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= similar * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return [(doc, len(s), find(doc) if doc is not None else None, doc is None or find(doc) == doc) for (doc, _), s in zip(rows, sets)]


def family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rnd.randint(0, edits)):
            ws[rnd.randrange(len(ws))] = f"w{rnd.randint(0, 999)}"
        out.append(" ".join(ws))
    return out


def test_components(frame):
    rnd = random.Random(11)
    body = []
    for n in (6, 12, 60, 200):
        for _ in range(4):
            body += family(rnd, [f"W{rnd.randint(0, 500)}" for _ in range(n)], 12, max(2, n // 25))
    body += [f"{a} common ending here now" for a in "abcdefgh"] + ["one two", "ONE  two", "one two", "", None, " "] + [" ".join(f"v{rnd.randint(0, 9)}" for _ in range(40)) for _ in range(20)]
    rows = list(enumerate(body))
    rnd.shuffle(rows)
    rows = [(i + 5, t) for i, (_, t) in enumerate(rows)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (rows[3][0], rows[60][1])]
    for size in (4, 5):
        got = [tuple(r) for r in near.report(frame(rows), size).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, size), key=str)


def test_a_chain_of_near_copies(frame):
    """Neighbours are similar, ends are not: one component all the same."""
    ws = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(30):
        ws[3 * i] = f"x{i}"
        rows.append((i, " ".join(ws)))
    assert {r[2] for r in near.report(frame(rows), 4).collect()} == {r[2] for r in brute(rows, 4)}


def test_empty_table_and_columns(frame, spark):
    assert near.report(frame([]), 4).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", 3), (2, "a b c d e", 4), (3, None, 5)], "doc_id long, text string, component long")
    assert near.clean(docs, 5).columns == docs.columns and sorted(r[0] for r in near.clean(docs, 5).collect()) == [1, 3]


def test_estimates_follow_the_sets():
    rng = np.random.default_rng(3)
    for inter, own in ((800, 100), (500, 500), (30, 970)):
        a = words.mix(np.arange(inter + own, dtype=np.uint64))
        b = words.mix(np.concatenate([np.arange(inter), 10**6 + np.arange(own)]).astype(np.uint64))
        regs = [near.registers(np.unique(words.mix(x, s)))[None] for s in rng.integers(0, 10**6, 60).tolist() for x in (a, b)]
        n = np.array([inter + own])
        got = [near.estimate(x, y, n, n)[0][0] for x, y in zip(regs[::2], regs[1::2])]
        assert abs(np.mean(got) - inter / (inter + 2 * own)) < 0.03


def test_union_find(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rnd.randint(400, 900), rnd.randint(400, 900)) for _ in range(350)] + [(1000, x) for x in range(1001, 1400)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
