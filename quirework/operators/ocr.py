"""Recognised words and pages: usable words, page verdicts, document summaries, joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered
from .rules import whole_word

CONFIDENCE_FLOOR = 55
HAS_TEXT_CHARS = 12
PAGE = ["doc_id", "page_index"]
GLYPH_WIDTH = 500

# Fixed value: words that claim a file was written.
CLAIMS_A_FILE = "(?i)" + whole_word("searchable|written back|saved copy")


def usable_words(words: DataFrame) -> DataFrame:
    return words.where((S.js_trim("word") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def has_text(items: Column) -> Column:
    """More than twelve characters once every item is trimmed."""
    return F.aggregate(items, F.lit(0), lambda n, i: n + F.length(S.js_trim(i))) > HAS_TEXT_CHARS


def pages_to_read(pages: DataFrame, with_text: DataFrame) -> DataFrame:
    return pages.select(*PAGE).join(with_text.select(*PAGE), PAGE, "left_anti")


def recognised_pages(words: DataFrame, to_read: DataFrame) -> DataFrame:
    """One row per page handed to recognition: words, mean confidence (0 when none), why it is skipped."""
    kept = words.where(S.js_trim("word") != "").groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("total"))
    d = to_read.join(kept, PAGE, "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    confidence = F.when(n > 0, F.col("total") / n).otherwise(F.lit(0.0))
    return d.select(*PAGE, n.alias("words"), confidence.alias("confidence"), F.lit("ocr").alias("source"),
                    F.when(n == 0, F.lit("no-text")).when(confidence < CONFIDENCE_FLOOR, F.lit("low-confidence")).alias("skipped"))


def layer_results(layer: DataFrame) -> DataFrame:
    text = S.js_trim("text")
    return layer.select(*PAGE, F.lit(0).cast("long").alias("words"), F.lit(100.0).alias("confidence"), F.lit("layer").alias("source"),
                        F.when(text == "", F.lit("no-text")).alias("skipped"))


def all_results(recognised: DataFrame, layer: DataFrame) -> DataFrame:
    return recognised.unionByName(layer_results(layer))


def document_summary(results: DataFrame, rotations: DataFrame | None = None) -> DataFrame:
    """What a run read per document, what it skipped and why, and how sure it was."""
    d = results if rotations is None else results.join(rotations, PAGE, "left")
    if rotations is None:
        d = d.withColumn("rotation", F.lit(0))
    read = F.col("skipped").isNull()
    poor = F.coalesce(F.col("skipped") == "low-confidence", F.lit(False))
    turned = F.coalesce("rotation", F.lit(0)) != 0
    g = d.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(read).alias("pages_read"),
        F.count_if(read & (F.col("source") == "layer")).alias("from_layer"),
        F.coalesce(F.sum(F.when(read, F.col("words"))), F.lit(0)).alias("words"),
        F.count_if(F.col("skipped") == "no-text").alias("blank"),
        F.count_if(poor & turned).alias("sideways"), F.count_if(poor & ~turned).alias("unclear"),
        # Confidence sums stay whole numbers of 1e-6, so the total does not depend on task order.
        F.sum(F.when(read, S.js_round(F.col("confidence") * 1e6))).alias("_sum"),
        F.min(F.when(poor & ~turned, F.col("confidence"))).alias("_worst"))
    return (g.withColumn("mean_confidence", S.js_round(F.col("_sum") / F.when(F.col("pages_read") > 0, F.col("pages_read")) / 1e6))
            .withColumn("worst_unclear", S.js_round(F.col("_worst"))).drop("_sum", "_worst"))


def searchable_coverage(results: DataFrame) -> DataFrame:
    """Pages that would gain a text layer against pages that had one."""
    read = F.col("skipped").isNull()
    return results.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(read & (F.col("words") > 0)).alias("to_layer"),
        F.count_if(read & (F.col("source") == "layer")).alias("from_layer"))


def in_page_order(results: DataFrame) -> DataFrame:
    """Results as they were finished -> the place each takes in its document."""
    return ordered.number(results, ["doc_id"], ["page_index"], ordered.chunk_of("page_index"), "place")


def page_text(c: str | Column) -> Column:
    """Spaces before a line end go, three or more line ends become two, ends are trimmed."""
    t = F.regexp_replace(S.col(c), r"[ \t]+\n", "\n")
    return S.js_trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def joined_text(pages: DataFrame, text: str) -> DataFrame:
    """One text per document, pages in order under a marker line."""
    marked = F.concat(F.lit("--- page "), (F.col("page_index") + 1).cast("string"), F.lit(" ---\n"), F.col(text))
    return ordered.text_in_order(pages, ["doc_id"], "page_index", marked, "\n\n", "text")


def word_count(text: str | Column) -> Column:
    return F.size(F.filter(F.split(S.col(text), r"\s+"), lambda w: w != "")).cast("long")


def place_word(scale: float, width: Column, height: Column, rotation: Column) -> Column:
    """Where an invisible word goes on its page and how far it is stretched to fit the printed one."""
    box_w = (F.col("x1") - F.col("x0")) / scale
    box_h = (F.col("y1") - F.col("y0")) / scale
    natural = box_h * F.lit(GLYPH_WIDTH / 1000.0) * F.length("word")
    return F.struct(S.map_point(F.col("x0") / scale, F.col("y1") / scale, width, height, rotation).alias("at"),
                    S.text_stretch(box_w, natural).alias("stretch"), S.text_direction(rotation).alias("direction"))
