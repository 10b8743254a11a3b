"""Measurements: request summaries, stage shares, and whether a measured ladder may give a number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered
from .rules import is_third_party, url_parts

USABLE_MS = 30_000
MIN_WORK_MS = 50
SIZE_SLACK = 0.25
FLAT_RATIO = 1.1


def host_summary(requests: DataFrame, own_origin: str) -> DataFrame:
    """Per phase and host: requests, kinds of request, kinds of block, first or third party.

    Requests fold to one row per URL before a URL is taken apart, and kinds to one row each before they are joined
    into text.
    """
    r = requests.groupBy("phase", "url", "rtype", "blocked").agg(F.count("*").alias("n"))
    r = r.select("phase", "rtype", "blocked", "n", url_parts("url")["host"].alias("host"), is_third_party("url", own_origin).alias("third"))
    per = r.groupBy("phase", "host", "rtype", "blocked").agg(F.sum("n").alias("n"), F.bool_or("third").alias("third"))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return per.groupBy("phase", "host").agg(F.sum("n").alias("requests"), text("rtype").alias("types"),
                                            text("blocked").alias("blocks"), F.bool_or("third").alias("third_party"))


def egress(requests: DataFrame, own_origin: str, keys: list[str]) -> DataFrame:
    """Bytes sent, sends, sends of unknown size, distinct third-party URLs. Empty bodies are not sends."""
    sent = F.col("bytes") != 0
    # One row per URL first: the distinct count then needs no set in memory, whatever one session holds.
    per = requests.groupBy(*keys, "url").agg(
        F.sum(F.greatest(F.col("bytes"), F.lit(0).cast("long"))).alias("_b"), F.count_if(sent).alias("_s"),
        F.count_if(F.col("bytes") < 0).alias("_u"))
    return per.groupBy(*keys).agg(F.sum("_b").alias("sent_bytes"), F.sum("_s").alias("sends"), F.sum("_u").alias("unmeasured"),
                                  F.count_if(is_third_party("url", own_origin)).alias("third_party_urls"))


def stage_shares(stages: DataFrame) -> DataFrame:
    """Each stage's part of its run's time. The total runs over folded rows: one per stage name of a run."""
    rows = stages.select("run", F.explode("stages").alias("stage", "ms"))
    per = rows.groupBy("run", "stage").agg(F.sum("ms").alias("ms"))
    per = per.withColumn("total", F.sum("ms").over(Window.partitionBy("run")))
    return per.select("run", "stage", "ms", "total", S.percent(F.col("ms") / F.col("total"), 1).alias("share"))


def verdict(rungs: DataFrame) -> DataFrame:
    """Largest usable size, first size that collapsed, first that did not survive."""
    ok = F.col("outcome") == "survived"
    slow = ok & (F.col("pipe_ms") > USABLE_MS)
    return rungs.groupBy("run").agg(
        F.max(F.when(ok & ~slow, F.col("mb"))).alias("largest_usable"),
        F.min(F.when(slow, F.col("mb"))).alias("first_collapsed"),
        F.min(F.when(~ok, F.col("mb"))).alias("first_failed"),
        F.min_by(F.when(~ok, F.col("phase")), F.when(~ok, F.col("mb"))).alias("failed_phase"))


def _survived(rungs: DataFrame) -> DataFrame:
    return rungs.where("outcome = 'survived'")


def ends(rungs: DataFrame) -> DataFrame:
    """Smallest and largest surviving rung of each run: two folds, no sort."""
    cols = F.struct("mb", "pipe_ms", "recompressed")
    return _survived(rungs).groupBy("run").agg(F.count("*").alias("n"), F.min_by(cols, "mb").alias("lo"), F.max_by(cols, "mb").alias("hi"))


def growth(rungs: DataFrame) -> DataFrame:
    """Time must grow with size: ratio of the ends against half the span, at least 1.5."""
    e = ends(rungs).where("n >= 3")
    e = e.select("run", "n", F.col("lo.mb").alias("from_mb"), F.col("hi.mb").alias("to_mb"), (F.col("hi.mb") / F.col("lo.mb")).alias("span"),
                 (F.coalesce("hi.pipe_ms", F.lit(0)) / F.greatest(F.coalesce("lo.pipe_ms", F.lit(0)), F.lit(1).cast("long"))).alias("ratio"))
    e = e.withColumn("expected", F.greatest(F.lit(1.5), F.col("span") * 0.5))
    return e.withColumn("grew", ~((F.col("span") >= 2) & (F.col("ratio") < F.col("expected"))))


def flat_suffix(rungs: DataFrame) -> DataFrame:
    """First suffix of three or more rungs that doubles in size and stays within 10 % in time.

    A suffix in size order is a prefix from the largest rung down, so running folds give every suffix at once.
    """
    ms = F.coalesce("pipe_ms", F.lit(0).cast("long"))
    down = _survived(rungs).select("run", "mb", (-F.col("mb")).alias("_down"), ms.alias("_ms"))
    d = ordered.running_many(down, ["run"], ["_down"], ordered.chunk_of("_down"), {
        "rungs": ("sum", F.lit(1).cast("long")), "_lo": ("max", -F.col("_ms")), "hi": ("max", F.col("_ms")), "to_mb": ("max", F.col("mb"))})
    d = d.withColumn("lo", -F.col("_lo"))
    hit = d.where((F.col("rungs") >= 3) & (F.col("to_mb") / F.col("mb") >= 2) & (F.col("hi") <= F.col("lo") * FLAT_RATIO))
    return hit.groupBy("run").agg(F.min_by(F.struct(F.col("mb").alias("from_mb"), "to_mb", "rungs", "lo", "hi"), "mb").alias("_f")).select("run", "_f.*")


def quantity(rungs: DataFrame) -> DataFrame:
    """The amount of work must grow when the size doubles."""
    e = ends(rungs.where("recompressed is not null")).where("n >= 2")
    return e.select("run", F.col("lo.mb").alias("from_mb"), F.col("hi.mb").alias("to_mb"), F.col("lo.recompressed").alias("first_count"),
                    F.col("hi.recompressed").alias("last_count"),
                    (~((F.col("hi.mb") >= F.col("lo.mb") * 2) & (F.col("hi.recompressed") <= F.col("lo.recompressed")))).alias("grew"))


def row_problems(rungs: DataFrame) -> DataFrame:
    """Rules that look at one rung: one pass, the list of broken rules exploded to rows."""
    def rule(cond: Column, name: str):
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    built_mb = F.col("built_bytes") / 1048576.0
    rules = F.array_compact(F.array(
        rule(F.col("built_bytes").isNull(), "no-fixture-size"),
        rule(F.abs(built_mb - F.col("mb")) / F.col("mb") > SIZE_SLACK, "fixture-size-off"),
        rule(F.coalesce("pipe_ms", F.lit(0)) < MIN_WORK_MS, "impossible-time"),
        rule((F.col("recompressed") == 0) & (F.col("skipped") > 0), "recompressed-nothing"),
        rule(F.col("pages_seen") == 0, "saw-no-pages"),
        rule(F.col("saved_bytes") / F.col("built_bytes") < 0.5, "did-not-survive-round-trip")))
    return _survived(rungs).select("run", "mb", F.explode(rules).alias("problem"))


def source_problems(images: DataFrame, rungs: DataFrame, smallest: int = 150 * 1024) -> DataFrame:
    """The drawn source images must differ in size and be no smaller than a real scan."""
    g = images.groupBy("run").agg(F.count("*").alias("n"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    d = _survived(rungs).select("run").distinct().join(g, "run", "full")
    rules = F.array_compact(F.array(
        F.when(F.col("n").isNull(), F.lit("no-source-sizes")), F.when(F.col("lo") == F.col("hi"), F.lit("sources-identical")),
        F.when(F.col("lo") < smallest, F.lit("sources-too-small"))))
    return d.select("run", F.lit(None).cast("long").alias("mb"), F.explode(rules).alias("problem"))


def validate(rungs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Every broken rule as a row; a run with none may give a number."""
    none = F.lit(None).cast("long").alias("mb")
    tables = [row_problems(rungs),
              growth(rungs).where("not grew").select("run", none, F.lit("time-did-not-grow").alias("problem")),
              flat_suffix(rungs).select("run", none, F.lit("times-flat").alias("problem")),
              quantity(rungs).where("not grew").select("run", none, F.lit("work-did-not-grow").alias("problem"))]
    if images is not None:
        tables.append(source_problems(images, rungs))
    return reduce(DataFrame.unionByName, tables)


def progress(done: DataFrame, key: str, order: str, micros: str) -> DataFrame:
    """After each finished item: how many are done, time per item so far, and time left at that rate."""
    d = ordered.number(done, [key], [order], ordered.chunk_of(order), "done")
    totals = done.groupBy(key).agg(F.count("*").alias("total"), F.min(micros).alias("_from"))
    d = d.join(totals, key)
    rate = S.div(F.col(micros) - F.col("_from"), F.col("done"))
    return d.select(order, key, "done", (F.col("total") - F.col("done")).alias("remaining"), rate.alias("rate_us"),
                    (rate * (F.col("total") - F.col("done"))).alias("eta_us"))
