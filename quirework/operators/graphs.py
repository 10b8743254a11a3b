"""Walks over parent edges and link graphs by repeated joins, with the lineage cut between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage, run_path


def climb(nodes: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """Follow parents by doubling: after k rounds a row knows the ancestor 2**k levels up.

    Adds ``top`` (the highest ancestor reached), ``hops`` and ``open``: true when no climb from here ends at a
    root, because the parents run in a circle or one of them is missing. Each round is one join on the ancestor's
    key, so depth d costs log2(d) joins rather than d. A climb can be no longer than its group has nodes, so rows
    still open when twice that has been climbed stay open.
    """
    most = nodes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    at = nodes.select(*keys, F.col(node).alias("_n"), F.coalesce(F.col(parent), F.col(node)).alias("top"),
                      F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("hops"),
                      F.col(parent).isNotNull().alias("open"))
    at, reach = cut_lineage(at), 1
    while reach < 2 * most and not at.where("open").isEmpty():
        reach *= 2
        up = at.select(*keys, F.col("_n").alias("top"), F.col("top").alias("_t"), F.col("hops").alias("_h"), F.col("open").alias("_o"))
        # Finished rows skip the join: the roots are where every climb ends, so they are the hot keys.
        moving = at.where("open").join(up, [*keys, "top"], "left")
        moving = moving.select(*keys, "_n", F.coalesce("_t", "top").alias("top"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
                               F.coalesce("_o", F.lit(True)).alias("open"))
        at = cut_lineage(at.where("not open").unionByName(moving))
    return at.withColumnRenamed("_n", node)


def outline_levels(outline: DataFrame) -> DataFrame:
    """Level of every bookmark that hangs from a root, which is 0. Circles are never reached."""
    at = climb(outline, ["doc_id"], "node_id", "parent_id")
    return at.where(~F.col("open")).select("doc_id", "node_id", F.col("hops").alias("level"))


def named_root(fields: DataFrame) -> DataFrame:
    """Topmost ancestor of a form field that is itself a field; an unnamed parent ends the climb. Fields whose
    parents run in a circle have none: NULL."""
    named = fields.select("doc_id", F.col("node_id").alias("parent_id"), F.col("is_field").alias("_f")).where("_f")
    edges = fields.join(named, ["doc_id", "parent_id"], "left").select(
        "doc_id", "node_id", F.when(F.col("_f"), F.col("parent_id")).alias("parent_id"))
    return climb(edges, ["doc_id"], "node_id", "parent_id").select("doc_id", "node_id", F.when(~F.col("open"), F.col("top")).alias("root_id"))


FILTER_MAPS = 4  # bitmaps of 32,768 bits: the filter of visited nodes is 16 KB, whatever the graph's size


def _bit(node: str) -> tuple[Column, Column]:
    """A node's bitmap and its place there."""
    h = F.pmod(F.xxhash64(node), F.lit(FILTER_MAPS * 32768))
    return F.floor(h / 32768), h % 32768


def _maybe_visited(node: str, maps: list[bytes]) -> Column:
    """Whether a node's bit is set: never wrong when it says no."""
    number, at = _bit(node)
    out = F.lit(0)
    for i, m in enumerate(maps):
        byte = F.conv(F.hex(F.substring(F.lit(m), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = F.when(number == i, F.getbit(byte, (at % 8).cast("int"))).otherwise(out) if any(m) else out
    return out == 1


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start`` (column ``node``), each once, with the fewest hops to it.

    Breadth first over two tables in the shared folder, the edges in buckets by source and the nodes found in the same
    buckets, one partition per hop. The last hop meets the edges bucket by bucket, so a round shuffles only the nodes it
    leads to, folded before. Those that a filter of all visited nodes does not know are new; it comes back with each
    write, at a fixed size. Only if it may know some are these held against the nodes found so far, again bucket by bucket
    and without a shuffle. So a round on a long chain reads its own hop alone, and a dense graph costs its edges once.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = run_path(spark, "reach"), f"reach_{uuid.uuid4().hex}"
    maps = [bytes(4096) for _ in range(FILTER_MAPS)]

    def save(d: DataFrame, what: str, key: str, *parts: str) -> None:
        d.write.format("parquet").mode("append").partitionBy(*parts).bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{what}").saveAsTable(f"{name}_{what}")

    def put(nodes: DataFrame, hop: int) -> tuple[int, int]:
        """Writes (node, sure) as a hop; how many of them are new for sure, how many are not. New ones enter the filter."""
        seen, (number, at) = Observation(), _bit("node")
        new = F.col("sure")
        watched = nodes.observe(seen, F.count_if(new).alias("new"), F.count_if(~new).alias("open"),
                                *[F.bitmap_construct_agg(F.when(new & (number == i), at)).alias(f"map_{i}") for i in range(FILTER_MAPS)])
        save(watched.withColumn("hop", F.lit(hop)), "nodes", "node", "hop", "sure")
        got = seen.get
        for i in range(FILTER_MAPS):
            m = got[f"map_{i}"]
            maps[i] = bytes(x | y for x, y in zip(maps[i], m)) if m else maps[i]
        return got["new"], got["open"]

    def held() -> DataFrame:
        return spark.table(f"{name}_nodes")

    sure = F.lit(True).alias("sure")
    try:
        save(edges.select("src", "dst"), "edges", "src")
        hop, (found, doubts) = 0, put(start.select("node").distinct().select("node", sure), 0)
        while found:
            frontier = held().where((F.col("hop") == hop) & F.col("sure")).select(F.col("node").alias("src"))
            step = spark.table(f"{name}_edges").join(frontier, "src").select(F.col("dst").alias("node")).where("node is not null").distinct()
            hop += 1
            before = held().where((F.col("hop") < hop) & F.col("sure")).select("node")
            maybe = _maybe_visited("node", maps)
            if doubts:  # where the last hop had some, all are held against the table at once
                asked = Observation()
                step = step.observe(asked, F.count_if(maybe).alias("open")).join(before, "node", "left_anti")
                found, doubts = put(step.select("node", sure), hop)[0], asked.get["open"]
                continue
            found, doubts = put(step.select("node", (~maybe).alias("sure")), hop)
            if doubts:
                doubtful = held().where((F.col("hop") == hop) & ~F.col("sure")).select("node")
                found += put(doubtful.join(before, "node", "left_anti").select("node", sure), hop)[0]
        return spark.read.schema(held().schema).parquet(f"{path}/nodes").where("sure").select("node", F.col("hop").cast("long").alias("hop"))
    finally:
        for what in ("edges", "nodes"):
            spark.sql(f"drop table if exists {name}_{what}")  # the names; the files stay in the shared folder


def keep_with_survivors(outline: DataFrame, valid: str) -> DataFrame:
    """Prune: a node stays when its own page is usable or a descendant's is; an unusable page becomes NULL.

    Marks climb by doubling: once every ancestor up to 2**k - 1 levels above a usable node is marked, the pointers
    that lead 2**k levels up mark as many again. Circles add nothing new and end the climb.
    """
    keys = ["doc_id", "node_id"]
    nodes = cut_lineage(outline)
    most = nodes.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    kept = cut_lineage(nodes.where(F.col(valid)).select(*keys).distinct())
    up, reach = nodes.where("parent_id is not null").select(*keys, F.col("parent_id").alias("up")), 1
    while reach < 2 * most and not up.isEmpty():
        marked = up.join(kept, keys, "left_semi").select("doc_id", F.col("up").alias("node_id"))
        kept = cut_lineage(kept.unionByName(marked).distinct())
        further = up.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"))
        up = cut_lineage(up.join(further, ["doc_id", "up"]).select(*keys, F.col("_up").alias("up")))
        reach *= 2
    return nodes.join(kept, keys, "left_semi").withColumn("page_index", F.when(F.col(valid), F.col("page_index")))
