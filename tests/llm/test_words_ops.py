"""Substring dedup and decontamination against brute force."""

import hashlib
import random
import re

from conftest_llm import ALNUM, SPACE, lower

from quirework.llm import decontaminate, repeats


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_repeats(rows, window=20):
    seen, words = {}, []
    for doc, text in rows:
        ws = re.findall(SPACE, text or "")
        words.append((doc, ws))
        for p in range(len(ws) - window + 1):
            k, at = tuple(ws[p : p + window]), (doc if doc is not None else 2**63 - 1, p)
            seen[k] = min(seen.get(k, at), at)
    out = []
    for doc, ws in words:
        gone = set()
        for p in range(len(ws) - window + 1):
            if seen[tuple(ws[p : p + window])] < (doc if doc is not None else 2**63 - 1, p):
                gone.update(range(p, p + window))
        out.append((doc, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def brute_hits(docs, items, window=13):
    wins = {}
    for item, text in items:
        ws = re.findall(ALNUM, lower(text))
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1) if n else ():
            wins.setdefault(tuple(ws[p : p + n]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = re.findall(ALNUM, lower(text)), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(ws) - n + 1):
                if (k := tuple(ws[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= wins[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def texts(seed, n=120):
    rnd = random.Random(seed)
    vocab = [rnd.choice("abcdefg") * rnd.randint(1, 3) + rnd.choice(["", ",", "é", "Z", "7"]) for _ in range(300)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 19, 20, 21, 45]))] for _ in range(8)]
    out = []
    for _ in range(n):
        ws = []
        for _ in range(rnd.randint(0, 4)):
            ws += [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
            if rnd.random() < .6:
                p = rnd.choice(passages)
                ws += p[rnd.randint(0, 3):]
        out.append(rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", "\t", "\n"]).join(ws))
    out += [None, "", " \n", out[5], out[5], out[9], "x " * 70, "x " * 25]
    return out, [" ".join(p) for p in passages]


def test_repeats(frame):
    for seed in (1, 2):
        body, _ = texts(seed)
        rows = list(enumerate(body))
        rows += [rows[3], (None, body[4]), (7, body[30])]
        got = [tuple(r) for r in repeats.report(frame(rows)).collect()]
        assert sorted(got, key=str) == sorted(brute_repeats(rows), key=str)


def test_repeats_other_lengths(frame):
    body, _ = texts(3, 60)
    rows = list(enumerate(body))
    for window, start in ((7, 3), (9, 9), (20, 10)):
        got = [tuple(r) for r in repeats.report(frame(rows), window, start).collect()]
        assert sorted(got, key=str) == sorted(brute_repeats(rows, window), key=str)


def test_repeats_long_text_and_empty_table(frame, spark):
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["ab", "cd", "e", "fgh"]) + str(rnd.randint(0, 9)) for _ in range(1_500_000))
    rows = [(1, "y " * 30 + long[:900]), (2, long), (3, long[-500:])]
    got = {r[0]: tuple(r) for r in repeats.report(frame(rows)).collect()}
    assert got[2] == brute_repeats(rows)[1]
    assert repeats.report(frame([])).count() == 0


def test_decontamination(frame):
    body, passages = texts(4)
    items = [(i, p) for i, p in enumerate(passages)] + [(20, "one short item"), (21, "one short"), (22, None), (23, "..."), (None, passages[0]), (3, passages[3])]
    docs = [(i, t) for i, t in enumerate(body)] + [(900, "a ONE short item, here"), (901, "one short"), (None, passages[1]), (5, body[5])]
    for block in (500_000, 10):
        got = [tuple(r)[:6] for r in decontaminate.report(frame(docs), frame(items, "item_id long, text string"), block=block).collect()]
        assert sorted(got, key=str) == sorted(brute_hits(docs, items), key=str)


def test_decontamination_keeps_columns(frame, spark):
    docs = spark.createDataFrame([(1, "clean text of some words", "x", True), (2, "one short item", "y", None)], "doc_id long, text string, items string, contaminated boolean")
    out = decontaminate.clean(docs, frame([(1, "one short item")], "item_id long, text string"))
    assert out.columns == docs.columns and [r[0] for r in out.collect()] == [1]
    assert decontaminate.clean(docs, frame([], "item_id long, text string")).count() == 2
