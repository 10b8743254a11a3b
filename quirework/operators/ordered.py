"""Ordered operators whose work never sits in one task, however large one group grows.

A plain window over ``partitionBy(key)`` sends the whole of a hot key to one task. That is used while the largest
group, which is measured, fits one chunk. Past that every group is cut into chunks along its order: a chunk is a
monotone coarsening of the order columns (say ``page_index div 65536``), so rows of an earlier chunk always come
first. The window runs inside a chunk, one aggregated row per chunk carries what later chunks need, and a join on
``(key, chunk)`` puts the two together. Chunk summaries are a table of the same kind: they go through the same
operator, in coarser chunks, until they fit. Both ways give the same rows.

Each call reads its input twice (once folded to counts or summaries, combined before the shuffle); ask for
several results in one call rather than chaining calls, and cut the lineage of a costly input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 65_536
STEP = 1024  # chunks that go into one chunk of the level above
FOLDS = {"sum": F.sum, "max": F.max}


def chunk_of(order: str | Column, size: int = CHUNK) -> Column:
    """Chunk number for an integer order column: floor division keeps the order."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def running_many(df: DataFrame, keys: list[str], order: list, chunk: Column, wanted: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running folds along ``order`` within ``keys``: ``wanted`` maps an output to ("sum" | "max", value).

    ``chunk`` is a whole number that never falls along ``order``.
    """
    upto = (Window.unboundedPreceding, 0 if inclusive else -1)
    if largest_group(df, keys) <= CHUNK:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        folds = {o: FOLDS[k](v).over(whole) for o, (k, v) in wanted.items()}
        return df.withColumns({o: F.coalesce(f, F.lit(0)) if wanted[o][0] == "sum" else f for o, f in folds.items()})
    d = df.withColumn("__chunk", chunk).withColumns({f"__x_{o}": v for o, (_, v) in wanted.items()})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(*upto)
    local = d.withColumns({f"__l_{o}": FOLDS[k](f"__x_{o}").over(inside) for o, (k, _) in wanted.items()})
    summary = d.groupBy(*keys, "__chunk").agg(*[FOLDS[k](f"__x_{o}").alias(f"__s_{o}") for o, (k, _) in wanted.items()])
    before = running_many(summary.withColumnRenamed("__chunk", "__at"), keys, ["__at"], chunk_of("__at", STEP),
                          {f"__b_{o}": (k, F.col(f"__s_{o}")) for o, (k, _) in wanted.items()}, inclusive=False)
    before = before.select(*keys, F.col("__at").alias("__chunk"), *[f"__b_{o}" for o in wanted])
    out = {}
    for o, (kind, _) in wanted.items():
        here, earlier = F.col(f"__l_{o}"), F.col(f"__b_{o}")
        out[o] = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)) if kind == "sum" else F.greatest(here, earlier)
    drop = ["__chunk"] + [f"__{p}_{o}" for p in "xlb" for o in wanted]
    return local.join(before, [*keys, "__chunk"]).withColumns(out).drop(*drop)


def running(df: DataFrame, keys: list[str], order: list, chunk: Column, value: Column, out: str, kind: str = "sum", inclusive: bool = True) -> DataFrame:
    return running_many(df, keys, order, chunk, {out: (kind, value)}, inclusive)


def number(df: DataFrame, keys: list[str], order: list, chunk: Column, out: str) -> DataFrame:
    """1-based position of each row in its group."""
    return running(df, keys, order, chunk, F.lit(1).cast("long"), out)


def neighbours(df: DataFrame, keys: list[str], order: list, chunk: Column, value: Column, prev: str | None = None, nxt: str | None = None) -> DataFrame:
    """``value`` of the row before and after, each as a struct ``{v}`` so that a NULL value is still a row.

    The struct itself is NULL where there is no such row.
    """
    sides = [(o, step, edge) for o, step, edge in ((prev, F.lag, F.max_by), (nxt, F.lead, F.min_by)) if o]
    if largest_group(df, keys) <= CHUNK:
        whole = Window.partitionBy(*keys).orderBy(*order)
        d = df.withColumn("__x", F.struct(value.alias("v")))
        return d.withColumns({o: step("__x").over(whole) for o, step, _ in sides}).drop("__x")
    key = F.struct(*order)
    d = df.withColumn("__chunk", chunk).withColumn("__x", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    local = d.withColumns({f"__l_{o}": step("__x").over(inside) for o, step, _ in sides})
    edges = d.groupBy(*keys, "__chunk").agg(*[edge("__x", key).alias(f"__e_{o}") for o, _, edge in sides])
    for o, _, _ in sides:
        at = {"prev" if o == prev else "nxt": f"__b_{o}"}
        edges = neighbours(edges.withColumnRenamed("__chunk", "__at"), keys, ["__at"], chunk_of("__at", STEP), F.col(f"__e_{o}"), **at).withColumnRenamed("__at", "__chunk")
    edges = edges.select(*keys, "__chunk", *[F.col(f"__b_{o}.v").alias(f"__b_{o}") for o, _, _ in sides])
    out = {o: F.coalesce(f"__l_{o}", f"__b_{o}") for o, _, _ in sides}
    return local.join(edges, [*keys, "__chunk"]).withColumns(out).drop("__chunk", "__x", *[f"__{p}_{o}" for p in "lb" for o in out])


SKETCH = 800  # size of a rank sketch
GRID = 200  # ranks it is asked for
SALTS = 16


def _rank_error(k: int) -> float:
    """A normalised rank that such a sketch gives is hardly ever further off."""
    return 3.0 / k**0.9


def upper_medians(df: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """Per output column, the element at index ``n >> 1`` of the sorted values (the upper one of an even count).

    Exact and skew-safe. A group of at most one chunk is folded to its counted values and decided at once. A larger one
    is sketched (KLL, combined before the shuffle), and the sketch brackets the wanted rank; a second pass counts what
    lies below the bracket and folds equal values inside it. If the rank is inside and the values there fit a chunk, they
    decide; else the side that has the rank is sketched again. Nothing is put in order but one chunk's values. There are
    as many large groups as chunks of rows at most, so only their brackets are ever copied. NULLs do not count, NaN is
    the largest number.
    """
    values = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(o).alias("o"), v.cast("double").alias("v"))) for o, v in wanted.items()]))
    rows = df.dropna(subset=keys).select(*keys, F.explode(values).alias("__r")).select(*keys, F.col("__r.o").alias("__o"), F.col("__r.v").alias("__v"))
    by = [*keys, "__o"]
    none = F.lit(None).cast("double")
    wide = cut_lineage(rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > CHUNK))
    rank = (F.floor(F.col("__n") / 2) + 1).alias("__rank")
    if wide.isEmpty():
        return _columns(_pick(_ranked(rows, by, rank), by), keys, wanted)
    found = cut_lineage(_pick(_ranked(rows.join(wide.select(*by), by, "left_anti"), by, rank), by))
    todo = wide.select(*by, rank, F.lit(True).alias("__wide"), none.alias("__lo"), none.alias("__hi"))
    below, above = F.coalesce(F.col("__v") < F.col("__lo"), F.lit(False)), F.coalesce(F.col("__v") > F.col("__hi"), F.lit(False))
    while True:
        todo = cut_lineage(_brackets(_meet(rows, by, todo), by, ~below & ~above, below))
        side = F.when(below, -1).when(above, 1).otherwise(0)
        met = _meet(rows, by, todo)
        folded = cut_lineage(met.groupBy(*by, side.alias("__side"), F.when(side == 0, F.col("__v")).alias("__v")).agg(F.count("*").alias("__n")))
        seen = folded.groupBy(*by).agg(
            F.coalesce(F.sum(F.when(F.col("__side") < 0, F.col("__n"))), F.lit(0)).alias("__below"),
            F.coalesce(F.sum(F.when(F.col("__side") == 0, F.col("__n"))), F.lit(0)).alias("__in"), F.count_if(F.col("__side") == 0).alias("__values"))
        seen = cut_lineage(todo.join(seen, by))
        low, high = F.col("__rank") <= F.col("__below"), F.col("__rank") > F.col("__below") + F.col("__in")
        settled = ~low & ~high & (F.col("__values") <= CHUNK)
        found = found.unionByName(_pick(_gathered(folded.where("__side = 0"), seen.where(settled), by), by))
        left = seen.where(~settled)
        if left.isEmpty():
            break
        # The side that has the rank; inside, if its values are too many.
        lo = F.when(low, F.col("__lo0")).when(high, F.col("__hi")).otherwise(F.col("__lo"))
        hi = F.when(low, F.col("__lo")).when(high, F.col("__hi0")).otherwise(F.col("__hi"))
        todo = cut_lineage(left.select(*by, "__rank", lo.alias("__lo"), hi.alias("__hi")))
    return _columns(found, keys, wanted)


def _ranked(rows: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """The counted values of each group, with its wanted rank."""
    counted = rows.groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    total = counted.groupBy(*by).agg(F.sum("__n").alias("__n"), F.collect_list(F.struct("__v", "__n")).alias("__vs"))
    return total.select(*by, rank, F.array_sort("__vs").alias("__all"))


def _gathered(counted: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """The same for groups whose counted values inside the bracket are at hand."""
    d = counted.join(seen.select(*by, (F.col("__rank") - F.col("__below")).alias("__rank")), by)
    return d.groupBy(*by, "__rank").agg(F.array_sort(F.collect_list(F.struct("__v", "__n"))).alias("__all"))


def _columns(found: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__o") == o, F.col("__v"))).alias(o) for o in wanted])


def _meet(rows: DataFrame, by: list[str], brackets: DataFrame) -> DataFrame:
    """Rows with their group's bracket. There are few brackets: each stands in every part that its group's rows are cut into."""
    parts = brackets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")).join(parts, [*by, "__salt"]).drop("__salt")


def _brackets(met: DataFrame, by: list[str], inside: Column, below: Column) -> DataFrame:
    """(rank, lo, hi, and the bounds lo0, hi0 that held so far) of each group from a sketch of what lies between those."""
    d = met.groupBy(*by, "__rank", "__lo", "__hi").agg(
        F.kll_sketch_agg_double(F.when(inside, F.col("__v")), SKETCH).alias("__s"), F.count_if(inside).alias("__m"), F.count_if(below).alias("__b"))
    # A sketch answers for fixed ranks only: the grid points around the wanted one.
    at, off = (F.col("__rank") - F.col("__b")) / F.col("__m"), F.lit(_rank_error(SKETCH))
    grid = F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    d = d.withColumn("__g", F.when(F.col("__m") > 0, grid))
    lo = F.when(at > off, F.get("__g", F.floor((at - off) * GRID).cast("int")))
    hi = F.when(at + off < 1, F.get("__g", F.ceil((at + off) * GRID).cast("int")))
    return d.select(*by, "__rank", F.coalesce(lo, "__lo").alias("__lo"), F.coalesce(hi, "__hi").alias("__hi"), F.col("__lo").alias("__lo0"), F.col("__hi").alias("__hi0"))


def _pick(ranked: DataFrame, by: list[str]) -> DataFrame:
    """The value at each group's rank among at most a chunk of counted values."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("v"))
    pick = F.aggregate("__all", start, lambda a, x: F.when(a["upto"] >= F.col("__rank"), a).otherwise(F.struct((a["upto"] + x["__n"]).alias("upto"), x["__v"].alias("v"))))
    return ranked.select(*by, pick["v"].alias("__v"))


def text_in_order(df: DataFrame, keys: list[str], order: str, piece: Column, sep: str, out: str) -> DataFrame:
    """One text per group, pieces in order.

    Pieces meet inside their chunk first; the group then gathers one text per chunk, so what a task holds
    is a chunk's pieces or the finished text, never a group's rows.
    """
    def gather(position: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]), sep)
    d = df.select(*keys, F.col(order).alias("__o"), piece.alias("__t")).withColumn("__chunk", chunk_of("__o"))
    parts = d.groupBy(*keys, "__chunk").agg(gather("__o", "__t").alias("__t"))
    return parts.groupBy(*keys).agg(gather("__chunk", "__t").alias(out))
