"""Batch runs: isolated work per file, names without collisions, counts that must reconcile."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut_lineage
from ..sources import pieces
from . import ordered
from .rules import first_match

KINDS = ["done", "failed", "left-alone", "not-attempted", "interrupted"]
RESULT = "run_id long, ordinal long, source string, kind string, bytes long, reason string"
NUMBERED = r"^(.*) \(([2-9]|[1-9][0-9]+)\)$"


SLICE = 10_000  # rows of one call of a caller's function
SLICE_STOPPABLE = 200  # the same where a run may be stopped meanwhile


def _bisected(work: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> list[pd.DataFrame]:
    """What ``work`` makes of the rows. Where it raises, the rows are halved until the one that it raises for stands alone:
    one bad row among n costs about two calls per halving, not n. Where the first half of rows that raise is sound, the
    other is halved at once. What comes back is kept as plain lists: with many bad rows most calls are for a few rows."""
    said: dict[str, list] = {"kind": [], "bytes": [], "reason": []}
    todo = [(0, len(rows), False, False)]  # from, to, the first of two halves, known to raise
    while todo:
        lo, hi, first, raises = todo.pop()
        if not raises or hi - lo == 1:
            try:
                out = work(rows.iloc[lo:hi].reset_index(drop=True))
                columns = [out[c].tolist() for c in said]
            except Exception as err:
                if hi - lo == 1:
                    for values, value in zip(said.values(), ("failed", None, f"{type(err).__name__}: {err}")):
                        values.append(value)
                    continue
            else:
                for values, column in zip(said.values(), columns):
                    values.extend(column)
                if first:
                    todo[-1] = (*todo[-1][:3], True)
                continue
        mid = (lo + hi) // 2
        todo += [(mid, hi, False, False), (lo, mid, True, False)]
    return [pd.DataFrame({c: pd.Series(values, dtype=object) for c, values in said.items()})]


SPREAD = 256  # folders that the runs' marks are spread over


def _marks_of(root: str, run: int) -> str:
    """A run's marks have a folder of their own, so that looking for them costs the same however many runs were stopped."""
    return f"{root}/{run % SPREAD}/{run}"


def stop(stops: str, run: int, ordinal: int) -> None:
    """Leaves a mark that a run was stopped while a file was worked on. Any process that reaches the folder may do so."""
    files, root = pieces.store(stops)
    folder = _marks_of(root, run)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/{run}_{ordinal}") as f:
        f.write(b"")


def stopped(stops: str, runs: Iterable[int] | None = None) -> dict[int, int]:
    """The earliest file at which each run (of ``runs``, or of all) was stopped, by the marks that are there now."""
    from pyarrow import fs

    files, root = pieces.store(stops)
    out: dict[int, int] = {}
    for folder in [root] if runs is None else [_marks_of(root, r) for r in runs]:
        for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if x.type == fs.FileType.File:
                run, ordinal = map(int, x.base_name.split("_"))
                out[run] = min(ordinal, out.get(run, ordinal))
    return out


def apply_to_files(files: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str = RESULT, stops: str | None = None) -> DataFrame:
    """Run a caller's function over file rows. One file's exception is its own failed row, never the job's end.

    ``work`` takes a frame of files and returns kind, bytes and reason for each, in order. A frame for which it raised
    is halved down to the file at fault. The files are dealt out over all tasks, however few their own files are; frames
    stream through.

    ``stops`` names a folder for stop marks (``stop``). A file that ``work`` calls interrupted marks its run; what comes
    behind a mark is not begun. Tasks have stretches of runs in order and look for the marks of the runs at hand. They see
    marks late, and a long run is several tasks', so the marks decide once more at the end: the marked file is interrupted, all of its run behind it are not attempted, finished or not, and all
    before it have their outcome. A stopped run names every file.
    """
    names = ["run_id", "ordinal", "source", "kind", "bytes", "reason"]
    step = SLICE_STOPPABLE if stops else SLICE

    def outcomes(rows: pd.DataFrame) -> pd.DataFrame:
        done = pd.concat(_bisected(work, rows), ignore_index=True)
        return pd.concat([rows[["run_id", "ordinal", "source"]], done], axis=1)

    def batches(frames):
        for frame in frames:
            for lo in range(0, len(frame), step):
                rows = frame.iloc[lo : lo + step].reset_index(drop=True)
                late = None
                if stops:
                    marks = stopped(stops, map(int, rows["run_id"].dropna().unique()))
                    behind = rows["ordinal"] > rows["run_id"].map(marks).fillna(float("inf"))
                    late = rows.loc[behind, ["run_id", "ordinal", "source"]].assign(kind="not-attempted", bytes=None, reason=None)
                    rows = rows[~behind].reset_index(drop=True)
                out = outcomes(rows) if len(rows) else late
                if stops and len(rows):
                    marks = out[out["kind"] == "interrupted"].dropna(subset=["run_id", "ordinal"])
                    for run, ordinal in marks.groupby("run_id")["ordinal"].min().items():
                        stop(stops, int(run), int(ordinal))
                    out = pd.concat([out, late], ignore_index=True) if len(late) else out
                yield out[names].astype({"bytes": "Int64"})

    # A fixed number: rows are few bytes and much work, so parts must not be put together by their size.
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if stops:
        files = files.repartitionByRange(width, "run_id", "ordinal").sortWithinPartitions("run_id", "ordinal")
    else:
        files = files.repartition(width, "run_id", "ordinal")
    results = files.mapInPandas(batches, schema)
    return settled(cut_lineage(results), stops) if stops else results


def settled(results: DataFrame, stops: str) -> DataFrame:
    """Results as the stop marks have them. One mark per stopped run counts, read where they are few or many."""
    marks = pieces.read_heads(results.sparkSession, stops, 0) if pieces.exists(stops) else None
    if marks is None:
        return results
    at = marks.select(*[F.split_part("name", F.lit("_"), F.lit(i)).cast("long").alias(c) for i, c in ((1, "run_id"), (2, "_at"))])
    d = results.join(at.groupBy("run_id").agg(F.min("_at").alias("_at")), "run_id", "left")
    kind = F.when(F.col("ordinal") == F.col("_at"), "interrupted").when(F.col("ordinal") > F.col("_at"), "not-attempted").otherwise(F.col("kind"))
    kept = F.col("_at").isNull() | (F.col("ordinal") < F.col("_at"))
    return d.select(*[{"kind": kind, "bytes": F.when(kept, F.col("bytes")), "reason": F.when(kept, F.col("reason"))}.get(c, F.col(c)).alias(c) for c in results.columns])


def outcome_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("files"), *[
        F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in KINDS])


def cancelled() -> Column:
    return (F.col("interrupted") > 0) | (F.col("not_attempted") > 0)


def run_head() -> Column:
    # The words of a run's result, here and below.
    done, files = F.col("done"), F.col("files")
    some = F.when(done == 1, F.lit(" file")).otherwise(F.lit(" files"))
    return first_match([
        ((done == 0) & cancelled(), "Stopped before any file was finished."), (done == 0, "Nothing was written."),
        (cancelled(), F.concat(F.lit("Stopped. "), done, some, F.lit(" finished before you did.")))],
        F.concat(done, F.lit(" of "), files, F.when(files == 1, F.lit(" file")).otherwise(F.lit(" files")), F.lit(" done.")))


def run_detail(label: str) -> Column:
    def part(name: str, words: str):
        return F.when(F.col(name) > 0, F.concat(F.col(name), F.lit(words)))
    text = F.concat_ws(". ", part("done", f" in the archive, with {label.lower()} applied"),
                       part("left_alone", " left alone, because there was nothing to gain"),
                       part("failed", " failed, each named below with the reason"),
                       part("interrupted", " stopped partway, with nothing of it kept"), part("not_attempted", " not attempted"))
    return F.when(text == "", text).otherwise(F.concat(text, F.lit(".")))


def reconcile(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries read back against files recorded as done, for runs on either side."""
    said = results.groupBy("run_id").agg(F.count_if(F.col("kind") == "done").alias("done"))
    held = manifest.groupBy("run_id").agg(F.count("*").alias("entries"))
    zero = F.lit(0).cast("long")
    d = said.join(held, "run_id", "full").select("run_id", F.coalesce("done", zero).alias("done"), F.coalesce("entries", zero).alias("entries"))
    return d.withColumn("reconciles", F.col("done") == F.col("entries"))


def retry_set(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Source files whose outcome was a failure, matched by name within the run."""
    failed = results.where("kind = 'failed'").select("run_id", "source").distinct()
    return sources.join(failed, ["run_id", "source"], "left_semi")


def unfinished(started: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return started.join(finished.select(*keys), keys, "left_anti")


def _split_name(name: Column, extension: str | None) -> tuple[Column, Column]:
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    has_dot = (F.instr(name, ".") > 0) & (dot > 1)
    base = F.when(has_dot, F.expr("substring(_clean, 1, length(_clean) - length(substring_index(_clean, '.', -1)) - 1)")).otherwise(name)
    own = F.when(has_dot, F.substring_index(name, ".", -1)).otherwise(F.lit("pdf"))
    return base, own if extension is None else F.lit(extension)


def allocate_names(done: DataFrame, run: str = "run_id", source: str = "source", order: str = "ordinal", extension: str | None = None) -> DataFrame:
    """Names unique within a run, given out in order: ``a.pdf``, ``a (2).pdf``, ``a (3).pdf`` …, where a number
    already taken by a file really called ``a (2).pdf`` is passed over.

    Set form of that sequential rule. Files of one clean name form a group; a group ``a (k)`` is a child of
    ``a``. A child's first file keeps its literal name exactly when it arrives before the parent's numbering
    reaches k, that is when (parent's files before it) + (smaller numbers already kept by children) < k.
    Otherwise the parent owns that name and the child starts at its own ``(2)``. So each level needs one count per
    distinct child name, not per file; which children keep their names is found by ``_keepers``, and files are numbered
    by the chunked counter. No parent's children or files are gathered anywhere.
    """
    d = S.once(done, "_clean", S.safe_name(source))
    base, ext = _split_name(F.col("_clean"), extension)
    d = S.once(d, "_n", F.struct(base.alias("b"), ext.alias("e"))).select("*", F.col("_n.b").alias("_base"), F.col("_n.e").alias("_ext")).drop("_n")
    group = [run, "_base", "_ext"]
    d = cut_lineage(ordered.number(d, group, [order], ordered.chunk_of(order), "_rank"))
    names = d.groupBy(*group).agg(F.min(order).alias("_first"))
    parent = F.when(F.col("_base").rlike(NUMBERED), F.regexp_extract("_base", NUMBERED, 1))
    names = names.withColumn("_parent", parent).withColumn("_k", F.when(parent.isNotNull(), F.regexp_extract("_base", NUMBERED, 2).try_cast("long")))
    # Children of a group that exists, with the number of that group's files that came before them.
    parents = names.select(run, F.col("_base").alias("_parent"), "_ext", F.lit(True).alias("_has"))
    children = cut_lineage(names.where("_k is not null").join(parents, [run, "_parent", "_ext"], "left_semi"))
    if children.isEmpty():
        return _named(d, group, None, None)
    marks = children.select(run, F.col("_parent").alias("_base"), "_ext", F.col("_first").alias("_at"), "_k", F.lit(0).cast("long").alias("_one"))
    files = d.join(marks.select(*group).distinct(), group, "left_semi").select(
        *group, F.col(order).alias("_at"), F.lit(None).cast("long").alias("_k"), F.lit(1).cast("long").alias("_one"))
    before = ordered.running(files.unionByName(marks), group, ["_at", "_one"], ordered.chunk_of("_at"), F.col("_one"), "_before")
    before = cut_lineage(before.where("_k is not null").select(run, F.col("_base").alias("_parent"), "_ext", "_k", "_before"))
    # Parents first: a name has one level per trailing number, so few rounds cover any real folder.
    extra = names.where("false").select(*group, F.lit(0).cast("long").alias("_extra"))
    kept = None
    level = cut_lineage(children.join(children.select(run, F.col("_base").alias("_parent"), "_ext"), [run, "_parent", "_ext"], "left_anti"))
    while not level.isEmpty():
        counted = level.join(before, [run, "_parent", "_ext", "_k"]).join(
            extra.select(run, F.col("_base").alias("_parent"), "_ext", F.col("_extra").alias("_px")), [run, "_parent", "_ext"], "left")
        ahead = F.col("_before") + F.when(F.col("_before") > 0, F.coalesce("_px", F.lit(0))).otherwise(0)
        counted = counted.withColumn("_ahead", ahead)
        decided = cut_lineage(_keepers(counted.select(run, "_parent", "_ext", "_base", "_k", "_ahead"), [run, "_parent", "_ext"]))
        # The j-th name kept lets the parent's files from k - (j - 1) on pass over one number more.
        marks = decided.where("_kept").select(run, F.col("_parent").alias("_base"), "_ext", (F.col("_k") - F.col("_before_it")).alias("_at"))
        kept = marks if kept is None else kept.unionByName(marks)
        extra = extra.unionByName(decided.where("not _kept").select(*group, F.lit(1).cast("long").alias("_extra")))
        level = cut_lineage(children.join(level.select(run, F.col("_base").alias("_parent"), "_ext"), [run, "_parent", "_ext"], "left_semi"))
    return _named(d, group, kept, extra)


FOLD = 4096  # children in one step map


def step_map(limits: list[int], most: int) -> tuple[int, list[int]]:
    """What a run of children does to the number of names kept before it, s in 0..most, as (always, places): s becomes
    s + always + (places above s). Each child turns s into s + 1 where s is below its limit, else leaves it; such maps
    are closed under composition."""
    always, places = 0, []

    def after(s: int) -> int:
        return s + always + len(places) - bisect.bisect_right(places, s)

    for limit in limits:
        if after(most) < limit:
            always += 1
        elif after(0) < limit:
            lo, hi = 0, most  # the first s that is not kept
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if after(mid) < limit else (lo, mid)
            bisect.insort(places, hi)
    return always, places


def _keepers(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (_k, _ahead) with the number of smaller ones that keep their names (_before_it) and whether each does (_kept).

    Chunks of a parent's children become step maps side by side; one pass over the maps, a chunk's in memory at a time,
    gives every chunk the number it starts from; then the chunks are gone through side by side again.
    """
    d = ordered.number(children, parent, ["_k"], ordered.chunk_of("_k"), "_i")
    d = cut_lineage(d.withColumn("_c", F.floor((F.col("_i") - 1) / FOLD)).withColumn("_limit", F.col("_k") - F.col("_ahead")))
    at = [*parent, "_c"]
    n, names = len(at), children.columns
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in at)

    # Frames hold many small chunks or part of a large one; rows come sorted, and what is held is one chunk's limits.
    def fold(frames):
        here, first, limits = None, 0, []
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[:n] != here:
                    if here is not None:
                        out.append((*here, *step_map(limits, first - 1)))
                    here, first, limits = row[:n], row[n], []
                limits.append(row[n + 1])
            yield pd.DataFrame(out, columns=[*at, "_always", "_places"])
        if here is not None:
            yield pd.DataFrame([(*here, *step_map(limits, first - 1))], columns=[*at, "_always", "_places"])

    def starts(frames):
        here, s = None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[: n - 1] != here:
                    here, s = row[: n - 1], 0
                out.append((*row[:n], s))
                s += row[n] + int((row[n + 1] > s).sum())
            yield pd.DataFrame(out, columns=[*at, "_s"])

    def decide(frames):
        here, s = None, 0
        for frame in frames:
            before, kept = [], []
            for row in frame[[*at, "_limit", "_s"]].itertuples(index=False, name=None):
                if row[:n] != here:
                    here, s = row[:n], row[n + 1]
                before.append(s)
                kept.append(s < row[n])
                s += s < row[n]
            yield frame.assign(_before_it=before, _kept=kept)[[*names, "_before_it", "_kept"]]

    d = d.repartition(*at).sortWithinPartitions(*at, "_k")
    maps = d.select(*at, "_i", "_limit").mapInPandas(fold, f"{head}, _always long, _places array<long>")
    first = maps.repartition(*parent).sortWithinPartitions(*at).mapInPandas(starts, f"{head}, _s long")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _before_it long, _kept boolean"
    return d.join(first, at).repartition(*at).sortWithinPartitions(*at, "_k").mapInPandas(decide, schema)


def _named(d: DataFrame, group: list[str], kept: DataFrame | None, extra: DataFrame | None) -> DataFrame:
    """Names from ranks: a file's number is its rank and the marks at or below it."""
    if kept is None:
        d = d.withColumn("_number", F.col("_rank"))
    else:
        d = cut_lineage(d.join(extra, group, "left").withColumn("_rank", F.col("_rank") + F.coalesce("_extra", F.lit(0))).drop("_extra"))
        marked = d.join(kept.select(*group).distinct(), group, "left_semi").withColumns({"_at": F.col("_rank"), "_one": F.lit(0).cast("long")})
        both = marked.unionByName(kept.withColumn("_one", F.lit(1).cast("long")), allowMissingColumns=True)
        passed = ordered.running(both, group, ["_at", F.desc("_one")], ordered.chunk_of("_at"), F.col("_one"), "_passed")
        passed = passed.where("_one = 0").withColumn("_number", F.col("_rank") + F.col("_passed")).drop("_at", "_one", "_passed")
        d = d.join(kept.select(*group).distinct(), group, "left_anti").withColumn("_number", F.col("_rank")).unionByName(passed)
    label = F.when(F.col("_rank") == 1, F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("_number"), F.lit(")")))
    d = d.withColumn("name", F.concat("_base", label, F.lit("."), "_ext"))
    return d.drop("_clean", "_base", "_ext", "_rank", "_number")
