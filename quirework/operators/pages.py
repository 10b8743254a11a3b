"""Page tables: split, merge, reorder, rotate, and the bookmarks that follow the pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered
from .rules import first_match

# What a reader is told, and the shape of one part of a typed range.
NO_RANGES = "none"
NO_PAGES = "Type which pages you want, for example 1-4, 7."
NOT_A_RANGE = "{part} is not a page or a range. Use numbers like 3 or 5-9."
BELOW_ONE = "Pages are numbered from 1."
PAST_THE_END = "This document has {pages} pages, so {page} does not exist."
BACKWARDS = "{part} runs backwards. Write it as {hi}-{lo}."
RANGE_PART = r"^(\d+)\s*(?:[-–—]\s*(\d+))?$"


def said(words: str, **values: Column) -> Column:
    """Fixed words with values in their places."""
    parts = re.split(r"\{(\w+)\}", words)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


# -- ranges -----------------------------------------------------------------------------------


def islands(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Runs of consecutive pages as (first, last). ``page - position`` is constant inside a run."""
    numbered = ordered.number(pages.select(*keys, page).distinct(), keys, [page], ordered.chunk_of(page), "_n")
    return (numbered.groupBy(*keys, (F.col(page) - F.col("_n")).alias("_run"))
            .agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_run"))


def range_label(first: Column, last: Column) -> Column:
    """One-based text for a zero-based run."""
    return F.when(first == last, (first + 1).cast("string")).otherwise(
        F.concat((first + 1).cast("string"), F.lit("-"), (last + 1).cast("string")))


def describe_ranges(pages: DataFrame, keys: list[str], page: str, out: str = "ranges", groups: DataFrame | None = None) -> DataFrame:
    """"1-3, 5" per group, from the runs already folded from pages; ``none`` for those of ``groups`` without a page."""
    text = ordered.text_in_order(islands(pages, keys, page), keys, "first", range_label(F.col("first"), F.col("last")), ", ", out)
    return text if groups is None else groups.join(text, keys, "left").select(*keys, F.coalesce(out, F.lit(NO_RANGES)).alias(out))


def parse_ranges(requests: DataFrame, key: str, text: str, page_count: str) -> tuple[DataFrame, DataFrame]:
    """Typed ranges -> (one row per request with its error, one row per wanted page in first-mention order).

    The first bad part decides the error, tested in the order a reader would meet it.
    """
    parts = requests.select(key, page_count, F.posexplode(F.split(S.js_trim(text), ",")).alias("part_no", "_p"))
    parts = parts.withColumn("part", S.js_trim("_p")).where("part <> ''").drop("_p")
    lo = F.regexp_extract("part", RANGE_PART, 1).try_cast("long")
    hi_text = F.regexp_extract("part", RANGE_PART, 2)
    parts = parts.withColumn("lo", lo).withColumn("hi", F.when(hi_text == "", lo).otherwise(hi_text.try_cast("long")))
    n = F.col(page_count)
    quoted = F.concat(F.lit('"'), F.col("part"), F.lit('"'))
    parts = parts.withColumn("error", first_match([
        (~F.col("part").rlike(RANGE_PART), said(NOT_A_RANGE, part=quoted)),
        ((F.col("lo") < 1) | (F.col("hi") < 1), BELOW_ONE),
        ((F.col("lo") > n) | (F.col("hi") > n), said(PAST_THE_END, pages=n.cast("string"), page=F.greatest("lo", "hi").cast("string"))),
        (F.col("hi") < F.col("lo"), said(BACKWARDS, part=quoted, hi=F.col("hi").cast("string"), lo=F.col("lo").cast("string")))]))
    seen = parts.groupBy(key).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part_no"))).alias("error"))
    status = requests.select(key).join(seen.withColumn("_some", F.lit(True)), key, "left").select(
        key, F.when(F.col("_some").isNull(), F.lit(NO_PAGES)).otherwise(F.col("error")).alias("error"))
    good = parts.join(status.where("error is null").select(key), key, "left_semi")
    # A range longer than the document cannot pass the rules above, so the sequence is bounded by page_count.
    wanted = good.select(key, "part_no", F.explode(F.sequence("lo", "hi")).alias("p"))
    wanted = wanted.groupBy(key, (F.col("p") - 1).alias("page_index")).agg(F.min(F.struct("part_no", "p")).alias("_at"))
    wanted = ordered.number(wanted.select(key, "page_index", "_at.part_no"), [key], ["part_no", "page_index"],
                            F.struct("part_no", F.floor(F.col("page_index") / ordered.CHUNK).alias("c")), "position")
    return status, wanted.select(key, "page_index", (F.col("position") - 1).alias("position"))


# -- split ------------------------------------------------------------------------------------


def split_every(pages: DataFrame, n: int) -> DataFrame:
    return pages.withColumn("part", F.floor(F.col("page_index") / n) + 1)


def bookmark_parts(outline: DataFrame, docs: DataFrame) -> DataFrame:
    """Parts that start at top-level bookmarks: (doc, start, end, title), front matter included.

    Bookmarks sharing a start make empty parts, which vanish; the part keeps the first one's title.
    """
    starts = (outline.where("parent_id is null and page_index is not null").groupBy("doc_id", F.col("page_index").alias("part_start"))
              .agg(F.min_by("title", "ordinal").alias("title")))
    front = (starts.groupBy("doc_id").agg(F.min("part_start").alias("_first")).where("_first > 0")
             .select("doc_id", F.lit(0).cast("long").alias("part_start"), F.lit("front").alias("title")))
    all_starts = starts.unionByName(front)
    nxt = ordered.neighbours(all_starts, ["doc_id"], ["part_start"], ordered.chunk_of("part_start"), F.col("part_start"), nxt="_next")
    return (nxt.join(docs.select("doc_id", "page_count"), "doc_id")
            .withColumn("part_end", F.coalesce(F.col("_next.v"), F.col("page_count")))
            .where("part_end > part_start").select("doc_id", "part_start", "part_end", "title"))


def page_to_part(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Which part covers each page. Parts tile the document, so the latest start at or before a page is
    the covering one: a running maximum over pages and starts together, with no range join."""
    marks = parts.select("doc_id", F.col("part_start").alias("page_index"), F.col("part_start").alias("_s"), F.lit(0).alias("_is_page"))
    rows = pages.select("doc_id", "page_index", F.lit(None).cast("long").alias("_s"), F.lit(1).alias("_is_page"))
    run = ordered.running(rows.unionByName(marks), ["doc_id"], ["page_index", "_is_page"], ordered.chunk_of("page_index"),
                          F.col("_s"), "part_start", kind="max")
    hit = run.where("_is_page = 1 and part_start is not null").select("doc_id", "page_index", "part_start")
    return hit.join(parts, ["doc_id", "part_start"]).where("page_index < part_end").select("doc_id", "page_index", "part_start", "title")


# -- merge and reorder ------------------------------------------------------------------------


def merge_offsets(files: DataFrame, run: str, order: str, page_count: str) -> DataFrame:
    """Pages before each file of a merge."""
    return ordered.running(files, [run], [order], ordered.chunk_of(order), F.col(page_count), "offset", inclusive=False)


def reorder_plan(pages: DataFrame, position: str, dropped: Column) -> DataFrame:
    """New index of every kept page, in the order asked for."""
    kept = pages.where(~dropped)
    n = ordered.number(kept, ["doc_id"], [position], ordered.chunk_of(position), "_n")
    return n.withColumn("new_index", F.col("_n") - 1).drop("_n")


def reorder_flags(pages: DataFrame, position: str, dropped: Column) -> DataFrame:
    moved = F.bool_or(F.col("page_index") != F.col(position))
    return pages.groupBy("doc_id").agg(moved.alias("moved"), (moved | F.bool_or(dropped)).alias("changed"),
                                       F.count_if(~dropped).alias("kept"))


def rename_clashes(fields: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """The n-th field of one name becomes "name (n)"; a name nobody asked for is not re-checked."""
    n = ordered.number(fields, [*keys, name], [order], ordered.chunk_of(order), "_n")
    return n.withColumn("new_name", F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" ("), F.col("_n"), F.lit(")")))
                        .otherwise(F.col(name))).withColumn("renamed", F.col("_n") > 1).drop("_n")


# -- bookmarks --------------------------------------------------------------------------------


def remap_outline(outline: DataFrame, page_map: DataFrame) -> DataFrame:
    """Bookmark pages through old -> new; a bookmark whose page is gone keeps NULL here."""
    return outline.join(page_map.select("doc_id", "page_index", "new_index"), ["doc_id", "page_index"], "left")


def resolve_destinations(dests: DataFrame, named: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Where a bookmark points: an explicit page reference, a name, or a bare number inside the document."""
    by_name = named.select("doc_id", F.col("name").alias("dest_name"), F.col("page_index").alias("_named"))
    by_ref = pages.select("doc_id", F.col("page_ref").alias("dest_ref"), F.col("page_index").alias("_ref"))
    number = F.col("dest_number")
    return (dests.join(by_name, ["doc_id", "dest_name"], "left").join(by_ref, ["doc_id", "dest_ref"], "left")
            .join(docs.select("doc_id", "page_count"), "doc_id", "left")
            .withColumn("page_index", F.when(F.col("dest_name").isNotNull(), F.col("_named"))
                        .when(F.col("dest_ref").isNotNull(), F.col("_ref"))
                        .when((number >= 0) & (number < F.col("page_count")), number))
            .drop("_named", "_ref", "page_count"))


def shift_outline(outline: DataFrame, offsets: DataFrame) -> DataFrame:
    """A merged file's bookmarks: one group per file, that file's own tree under it, pages shifted."""
    o = offsets.select("doc_id", "offset")
    groups = o.select("doc_id", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"),
                      F.concat(F.lit("file-"), F.col("doc_id")).alias("title"), F.col("offset").alias("page_index"))
    shifted = outline.join(o, "doc_id").select(
        "doc_id", "node_id", F.coalesce("parent_id", F.lit(-1).cast("long")).alias("parent_id"), "title",
        (F.col("page_index") + F.col("offset")).alias("page_index"))
    return groups.unionByName(shifted)


# -- shapes -----------------------------------------------------------------------------------


def shapes(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_index", S.page_shape("width_pt", "height_pt", "rotation").alias("s")).select("doc_id", "page_index", "s.*")


def orientation_minority(shaped: DataFrame) -> DataFrame:
    """Pages turned the other way from most of their document, when both ways occur."""
    per = shaped.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("landscape").alias("wide"))
    tall = F.col("pages") - F.col("wide")
    odd_is_wide = F.col("wide") < tall
    odd = F.when(odd_is_wide, F.col("wide")).otherwise(tall)
    return (per.withColumn("odd_is_landscape", odd_is_wide).withColumn("odd", odd)
            .where((F.col("wide") > 0) & (tall > 0) & (F.col("odd") <= F.col("pages") / 2))
            .select("doc_id", "pages", "odd", "odd_is_landscape"))


def size_labels(pages: DataFrame) -> DataFrame:
    """Distinct page sizes per document in the order first met. The set folds to one row per size before it is
    gathered."""
    first = pages.groupBy("doc_id", S.page_size_name("width_pt", "height_pt").alias("label")).agg(F.min("page_index").alias("at"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    return first.groupBy("doc_id").agg(F.array_join(labels, ", ").alias("sizes"))
