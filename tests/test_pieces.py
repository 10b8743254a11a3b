"""Marks, commits and heads of files, with tasks that fail and files that are large."""

import os

import pytest
from pyspark.sql import functions as F

from quirework.operators import runs
from quirework.sources import pieces


@pytest.fixture
def files(spark):
    return spark.range(60).select((F.col("id") % 4).alias("run_id"), F.col("id").alias("ordinal"), F.concat(F.lit("a b "), "id", F.lit(".pdf")).alias("source"))


@pytest.fixture
def plain():
    def work(piece):  # inside a function, so it travels by value
        if piece["ordinal"] % 5 == 0:
            return "left-alone", None, "no gain"
        return "done", b"%PDF-1.7" + b"x" * piece["ordinal"], None
    return work


def test_a_run(spark, files, plain, tmp_path):
    path = f"{tmp_path}/run"
    pieces.work_through(files, plain, path)
    assert {(r["ordinal"], r["kind"], r["bytes"]) for r in pieces.results(spark, path).collect()} == {
        (i, "left-alone", None) if i % 5 == 0 else (i, "done", 8 + i) for i in range(60)}
    held = pieces.entries(spark, path)
    assert {(r["run_id"], r["name"], r["length"], bytes(r["head"])[:8]) for r in held.collect()} == {(i % 4, f"a b {i}.pdf", 8 + i, b"%PDF-1.7") for i in range(60) if i % 5}
    said = pieces.manifest(spark, path).agg(F.sum("pieces"), F.sum("done")).first()
    assert tuple(said) == (60, 48) and held.count() == 48
    assert pieces.unfinished(spark, path).count() == 0
    assert runs.reconcile(pieces.results(spark, path), held).where("not reconciles").count() == 0


def test_a_crash_leaves_its_mark_and_no_files(spark, files, plain, tmp_path):
    path = f"{tmp_path}/run"

    def work(piece):
        if piece["ordinal"] == 23:
            raise RuntimeError("crash")
        return plain(piece)

    with pytest.raises(Exception, match="crash"):
        pieces.work_through(files.coalesce(1), work, path)
    assert [tuple(r) for r in pieces.unfinished(spark, path).collect()] == [(3, 23)]
    marks = spark.read.schema(pieces.MARK).json(f"{path}/marks")
    assert marks.where("at = 'ended'").count() == 23 and marks.agg(F.max("ordinal")).first()[0] == 23
    assert os.listdir(f"{path}/files") and not os.path.exists(f"{path}/manifest")
    # The next run works on what is left; only what it commits counts.
    rest = files.join(pieces.unfinished(spark, path), ["run_id", "ordinal"], "left_anti")
    pieces.work_through(rest, work, path)
    assert pieces.results(spark, path).count() == 59 == pieces.manifest(spark, path).agg(F.sum("pieces")).first()[0]
    assert pieces.entries(spark, path).count() == 47
    assert [tuple(r) for r in pieces.unfinished(spark, path).collect()] == [(3, 23)]


def test_pieces_are_dealt_out(spark, files, plain, tmp_path):
    """Pieces of one source part are several tasks' work, and a run's folder is in few of their folders."""
    path = f"{tmp_path}/run"
    pieces.work_through(files.coalesce(1), plain, path, deal=True)
    tasks = [d for d, in pieces.manifest(spark, path).where("pieces > 0").select("attempt").collect()]
    assert len(tasks) > 4 and sum(len(os.listdir(f"{path}/files/{d}")) for d in tasks) < 4 + len(tasks)
    assert pieces.results(spark, path).count() == 60 and pieces.entries(spark, path).count() == 48


def test_one_lost_file_does_not_reconcile(spark, files, plain, tmp_path):
    path = f"{tmp_path}/run"
    pieces.work_through(files, plain, path)
    lost = pieces.results(spark, path).where("ordinal = 6").first()["file"]
    os.remove(f"{path}/{lost}")
    off = runs.reconcile(pieces.results(spark, path), pieces.entries(spark, path)).where("not reconciles").collect()
    assert [tuple(r) for r in off] == [(2, 12, 11, False)]


def test_a_store_that_cannot_append(spark, tmp_path):
    class Store:
        def __init__(self):
            self.files, self.root = pieces.store(str(tmp_path))

        def __getattr__(self, name):
            return getattr(self.files, name)

        def open_append_stream(self, path):
            raise NotImplementedError

    marks = pieces.Marks(Store(), f"{tmp_path}/marks", "a1")
    marks.add(1, 2, "started")
    marks.add(1, 3, "started")
    marks.add(1, 2, "ended", "done")
    marks.close()
    assert [tuple(r) for r in pieces.unfinished(spark, str(tmp_path)).collect()] == [(1, 3)]


def test_heads_read_a_bounded_number_of_bytes(tmp_path, monkeypatch):
    with open(f"{tmp_path}/large.pdf", "wb") as f:
        f.write(b"%PDF-1.7")
        f.truncate(3 << 30)  # sparse
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "small.txt").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    read = []
    files, root = pieces.store(str(tmp_path))

    class File:
        def __init__(self, inner):
            self.inner = inner

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

        def read_at(self, n, at):
            got = self.inner.read_at(n, at)
            read.append(len(got))
            return got

    class Store:
        def __getattr__(self, name):
            return getattr(files, name)

        def open_input_file(self, path):
            return File(files.open_input_file(path))

    monkeypatch.setattr(pieces, "store", lambda path: (Store(), root))
    reader = pieces.HeadReader(str(tmp_path), 16)
    rows = [r for share in reader.partitions() for b in reader.read(share) for r in b.to_pylist()]
    assert {(r["name"], r["length"], r["head"][:4]) for r in rows} == {("large.pdf", 3 << 30, b"%PDF"), ("small.txt", 3, b"abc"), ("empty.bin", 0, b"")}
    assert sorted(read) == [3, 16]


@pytest.mark.parametrize("folders, wide", [(1, 2), (64, 10_000)])
def test_every_file_is_listed_once(spark, tmp_path, monkeypatch, folders, wide):
    monkeypatch.setattr(pieces, "FOLDERS", folders)
    monkeypatch.setattr(pieces, "FILES", wide)
    want = set()
    for at in ("", "a", "a/b", "a/b/c", "d"):
        os.makedirs(f"{tmp_path}/{at}", exist_ok=True)
        for i in range(5):
            with open(f"{tmp_path}/{at}/f{i}", "w") as f:
                f.write("x" * i)
            want.add((os.path.normpath(f"{tmp_path}/{at}/f{i}"), i))
    got = [(r["path"], r["length"]) for r in pieces.read_heads(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {(os.path.normpath(p), n) for p, n in got} == want
    assert pieces.read_heads(spark, f"{tmp_path}/d/", 2).agg(F.max(F.length("head"))).first()[0] == 2


def test_one_bad_row_costs_few_calls():
    import pandas as pd

    calls = []

    def work(frame):
        calls.append(len(frame))
        if (frame["ordinal"] == 7321).any():
            raise ValueError("bad")
        return pd.DataFrame({"kind": ["done"] * len(frame), "bytes": frame["ordinal"], "reason": [None] * len(frame)})

    got = pd.concat(runs._bisected(work, pd.DataFrame({"ordinal": range(10_000)})), ignore_index=True)
    assert len(calls) < 40 and len(got) == 10_000
    assert got[got["kind"] == "failed"].index.tolist() == [7321] and got["reason"][7321] == "ValueError: bad"


@pytest.mark.parametrize("parts", [1, 7])
def test_a_stopped_run_names_every_file(spark, tmp_path, parts, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(runs, "SLICE_STOPPABLE", 5)
    stops = f"{tmp_path}/stops"
    files = spark.range(300).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("ordinal"), F.lit("f").alias("source")).repartition(parts)
    runs.stop(stops, 2, 50)  # somebody else's mark, from before

    def work(frame):
        if (frame["ordinal"] == 31).any():
            raise ValueError("bad")
        kind = ["interrupted" if o in (100, 130) else "done" for o in frame["ordinal"]]  # both of run 1
        return pd.DataFrame({"kind": kind, "bytes": frame["ordinal"], "reason": [None] * len(frame)})

    got = {r["ordinal"]: (r["kind"], r["bytes"]) for r in runs.apply_to_files(files, work, stops=stops).collect()}
    want = {}
    for i in range(300):
        at = {1: 100, 2: 50}.get(i % 3, 1000)
        want[i] = ("interrupted", None) if i == at else ("not-attempted", None) if i > at else ("failed", None) if i == 31 else ("done", i)
    assert got == want
    assert runs.stopped(stops) == {1: 100, 2: 50}
    none = runs.apply_to_files(files, lambda f: pd.DataFrame({"kind": ["done"] * len(f), "bytes": f["ordinal"], "reason": [None] * len(f)}), stops=f"{tmp_path}/none")
    assert none.where("kind = 'done'").count() == 300


def test_sound_halves_tell_of_the_others():
    import pandas as pd

    calls = []

    def work(frame):
        calls.append(len(frame))
        if (frame["ordinal"] % 10 == 3).any():
            raise ValueError("bad")
        return pd.DataFrame({"kind": ["done"] * len(frame), "bytes": frame["ordinal"], "reason": [None] * len(frame)})

    got = pd.concat(runs._bisected(work, pd.DataFrame({"ordinal": range(1000)})), ignore_index=True)
    assert len(calls) < 760 and got["kind"].tolist() == ["failed" if i % 10 == 3 else "done" for i in range(1000)]
    assert [b for b, k in zip(got["bytes"], got["kind"]) if k == "done"] == [i for i in range(1000) if i % 10 != 3]


@pytest.mark.parametrize("stoppable", [False, True])
def test_files_are_dealt_out(spark, tmp_path, stoppable):
    import pandas as pd
    from pyspark import TaskContext

    files = spark.range(4000).select((F.col("id") % 40).alias("run_id"), F.col("id").alias("ordinal"), F.lit("f").alias("source")).coalesce(1)

    def work(frame):
        return pd.DataFrame({"kind": "done", "bytes": TaskContext.get().partitionId(), "reason": None}, index=frame.index)

    got = runs.apply_to_files(files, work, stops=f"{tmp_path}/stops" if stoppable else None).collect()
    assert len(got) == 4000 and len({r["bytes"] for r in got}) > 1


def test_marks_of_other_runs_are_not_read(tmp_path, monkeypatch):
    stops = f"{tmp_path}/stops"
    for run in range(300):
        runs.stop(stops, run, run + 1)
    seen = []
    files, root = pieces.store(stops)

    class Counted:
        def get_file_info(self, selector):
            found = files.get_file_info(selector)
            seen.extend(found)
            return found

    monkeypatch.setattr(runs.pieces, "store", lambda path: (Counted(), root))
    assert runs.stopped(stops, [7, 263, 999]) == {7: 8, 263: 264} and len(seen) == 2
    assert runs.stopped(stops) == {r: r + 1 for r in range(300)}
