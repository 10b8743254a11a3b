"""Image facts: placements, eligibility, resolution and quality, and what compressing came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered
from .rules import first_match

MIN_PIXELS = 8000
FALLBACK_QUALITY = 0.85
MIN_SHARE = 0.03
MIN_SAVING_BYTES = 50 * 1024
USABLE_FILTERS = ["DCTDecode", "FlateDecode", "RunLengthDecode"]
BAD_FILTERS = ["JBIG2Decode", "CCITTFaxDecode", "JPXDecode", "ASCIIHexDecode", "ASCII85Decode"]
PLAIN_SPACES = ["DeviceRGB", "DeviceGray", "Indexed", "CalRGB", "CalGray"]

# The settings from mildest to harshest, as (dpi, quality).
LADDER = [(220, 0.85), (200, 0.80), (180, 0.76), (150, 0.72), (130, 0.66), (110, 0.58), (96, 0.52), (84, 0.47), (72, 0.42)]
FLOOR_STEP = len(LADDER) - 1
SMALLEST_DPI, SMALLEST_QUALITY = 72, 42

KEY = ["doc_id", "image_key"]


def placement_rollup(placements: DataFrame) -> DataFrame:
    """Largest drawn size and number of uses per image; page sets stay a table (placement_pages)."""
    return placements.groupBy(*KEY).agg(
        F.max(F.hypot("a", "b")).alias("width_pt"), F.max(F.hypot("c", "d")).alias("height_pt"),
        F.count("*").alias("uses"))


def placement_pages(placements: DataFrame) -> DataFrame:
    return placements.select(*KEY, "page_index").distinct()


def placed_images(images: DataFrame, placements: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with their placement (NULL = never drawn), effective dpi and soft-mask flag."""
    rolled = placement_rollup(placements)
    flags = masks.select(*KEY).distinct().withColumn("_mask", F.lit(True))
    return (images.join(rolled, KEY, "left").join(flags, KEY, "left")
            .withColumn("dpi", S.drawn_dpi(F.col("width"), F.col("width_pt")))
            .withColumn("is_soft_mask", F.coalesce("_mask", F.lit(False))).drop("_mask"))


def skip_reason() -> Column:
    """Why an image is left alone; NULL means it can be re-encoded. Rules in order, first one wins.

    The wording is fixed values: it is what a reader is shown.
    """
    filters, space, bpc = F.col("filters"), F.coalesce("color_space", F.lit("")), F.col("bpc")
    bad = F.try_element_at(F.filter(filters, lambda f: f.isin(BAD_FILTERS)), F.lit(1))
    bad_words = first_match([
        (bad.isin("JBIG2Decode", "CCITTFaxDecode"), F.concat(bad, F.lit(" bilevel scan — already far denser than JPEG could manage"))),
        (bad == "JPXDecode", "JPEG 2000 — this page ships no JPEG 2000 decoder")],
        F.concat(bad, F.lit(" wrapper that could not be read")))
    supported = (F.size(filters) == 0) | ((F.size(filters) == 1) & F.try_element_at(filters, F.lit(1)).isin(USABLE_FILTERS))
    space_ok = space.isin(PLAIN_SPACES) | space.startswith("ICCBased")
    depth_ok = (bpc == 8) | ((space == "Indexed") & bpc.isin(2, 4))
    return first_match([
        (F.col("is_mask") | (bpc == 1), "a 1-bit stencil — JPEG would make it larger, not smaller"),
        (F.col("is_soft_mask"), "a transparency mask — recompressing it would fringe the edges it masks"),
        ((F.col("width") == 0) | (F.col("height") == 0), "has no usable dimensions"),
        (F.col("width") * F.col("height") < MIN_PIXELS, "smaller than 8,000 pixels — already negligible"),
        (F.col("uses").isNull(), "never drawn on any page"),
        (bad.isNotNull(), bad_words),
        (~supported, F.concat(F.lit("filter chain "), F.array_join(filters, "+"), F.lit(" is not one we rebuild"))),
        (F.array_contains(filters, "DCTDecode"), F.lit(None).cast("string")),
        (~space_ok, F.concat(F.when(space == "", F.lit("unknown")).otherwise(space), F.lit(" colour space we do not convert"))),
        (~depth_ok, F.concat(bpc.cast("string"), F.lit("-bit samples we do not unpack"))),
    ])


def judged(images: DataFrame, placements: DataFrame, masks: DataFrame) -> DataFrame:
    d = placed_images(images, placements, masks).withColumn("skip_reason", skip_reason())
    return d.withColumn("recompressible", F.col("skip_reason").isNull())


def resolution_plan(target_dpi: int) -> Column:
    """Per image: NULL keeps it as it is, else the quality to write at the target resolution."""
    own = F.col("quality")
    quality = F.when(own > 0, F.least(own, F.lit(100)) / 100.0).otherwise(F.lit(FALLBACK_QUALITY))
    return F.when(F.col("dpi") > target_dpi, F.struct(F.lit(target_dpi).alias("dpi"), quality.alias("quality")))


def apply_plan(df: DataFrame, plan: Column) -> DataFrame:
    """Any caller's plan expression over the image columns: scale and size to write (NULL plan = keep)."""
    d = df.withColumn("plan", plan)
    scale = F.when(F.col("dpi") > F.col("plan.dpi"), F.col("plan.dpi") / F.col("dpi")).otherwise(F.lit(1.0))
    d = d.withColumn("scale", F.when(F.col("plan").isNotNull(), scale))
    return (d.withColumn("target_w", F.greatest(F.lit(1).cast("long"), S.js_round(F.col("width") * F.col("scale")).cast("long")))
            .withColumn("target_h", F.greatest(F.lit(1).cast("long"), S.js_round(F.col("height") * F.col("scale")).cast("long")))
            .withColumn("target_w", F.when(F.col("plan").isNotNull(), F.col("target_w")))
            .withColumn("target_h", F.when(F.col("plan").isNotNull(), F.col("target_h"))))


def outcome(planned: Column, new_bytes: Column, old_bytes: Column) -> Column:
    """A new stream takes the place of the old one only when it is smaller."""
    return first_match([(~planned, "kept"), (new_bytes.isNull(), "undecodable"), (new_bytes >= old_bytes, "not-smaller")], "replaced")


def worth_showing(before: Column, after: Column) -> Column:
    saved = before - after
    return (saved > 0) & (saved / before >= MIN_SHARE)


def worth_it(before: Column, after: Column) -> Column:
    return worth_showing(before, after) & (before - after >= MIN_SAVING_BYTES)


def document_rollup(judged_images: DataFrame) -> DataFrame:
    """One row per document: acted-on and skipped bytes, medians, and the leading skip reason."""
    ok = F.col("recompressible")
    base = judged_images.groupBy("doc_id").agg(
        F.count("*").alias("images"), F.count_if(ok).alias("recompressible"),
        F.coalesce(F.sum(F.when(ok, F.col("encoded_bytes"))), F.lit(0)).alias("actionable_bytes"),
        F.coalesce(F.sum(F.when(~ok, F.col("encoded_bytes"))), F.lit(0)).alias("skipped_bytes"),
        F.coalesce(F.bool_and(F.when(ok, F.array_contains("filters", "DCTDecode"))), F.lit(False)).alias("all_jpeg"))
    return base.join(medians(judged_images, ["doc_id"]), "doc_id", "left")


def medians(judged_images: DataFrame, keys: list[str]) -> DataFrame:
    """Upper medians of drawn dpi and of JPEG quality over the images that can be re-encoded."""
    jpeg = F.array_contains("filters", "DCTDecode") & (F.size("filters") == 1)
    m = ordered.upper_medians(judged_images.where("recompressible"), keys, {"median_dpi": F.col("dpi"), "median_quality": F.when(jpeg, F.col("quality"))})
    return m.withColumn("median_quality", F.col("median_quality").cast("long"))


def skip_histogram(judged_images: DataFrame) -> DataFrame:
    return (judged_images.where("not recompressible").groupBy("doc_id", "skip_reason")
            .agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "image_key")).alias("first_seen")))


def top_skip_reason(histogram: DataFrame) -> DataFrame:
    """Most frequent reason; on a tie the one met first. Needs no sort: a two-key maximum."""
    best = F.max_by("skip_reason", F.struct(F.col("n"), (-F.col("first_seen.ordinal")).alias("o"), (-F.col("first_seen.image_key")).alias("k")))
    return histogram.groupBy("doc_id").agg(best.alias("top_reason"), F.max("n").alias("n"))


def shared_bytes(resources: DataFrame, doc: str, ref: str, size: str) -> DataFrame:
    """Sum of a shared resource's bytes, each reference once per document."""
    once = resources.groupBy(doc, ref).agg(F.max(size).alias("_b"))
    return once.groupBy(doc).agg(F.sum("_b").alias("bytes"))


def resolution_buckets(judged_images: DataFrame, target_dpi: int, keys: list[str]) -> DataFrame:
    ok, dpi = F.col("recompressible"), F.col("dpi")
    return judged_images.groupBy(*keys).agg(
        F.count_if(ok & (dpi > target_dpi)).alias("above"), F.count_if(ok & (dpi <= target_dpi)).alias("at_or_below"),
        F.count_if(ok & dpi.isNull()).alias("unknown"), F.count_if(~ok).alias("cannot"))


def resolution_results(judged_images: DataFrame, outcomes: DataFrame, target_dpi: int) -> DataFrame:
    acted = judged_images.where(F.col("recompressible") & (F.col("dpi") > target_dpi)).join(outcomes.select(*KEY, "outcome"), KEY, "left")
    hit = F.coalesce(F.col("outcome") == "replaced", F.lit(False))
    return acted.groupBy("doc_id").agg(F.count_if(hit).alias("downscaled"), F.count_if(~hit).alias("stayed_above"))


def harder_lever(median_quality: Column, median_dpi: Column) -> Column:
    """What the harshest setting could still change. Unknown counts as "might help"."""
    q = median_quality.isNull() | (median_quality > SMALLEST_QUALITY)
    d = median_dpi.isNull() | (median_dpi > SMALLEST_DPI)
    return first_match([(q & d, "both"), (q, "quality"), (d, "dpi")], "none")


def size_search(measurements: DataFrame) -> DataFrame:
    """Mildest ladder step whose measured size fits the target; the harshest step is asked first."""
    fits = F.col("size") <= F.col("target")
    g = measurements.groupBy("file_id").agg(
        F.max("original").alias("original"), F.max("target").alias("target"),
        F.max(F.when(F.col("step") == FLOOR_STEP, F.col("size"))).alias("floor_size"),
        F.min(F.when(fits, F.col("step"))).alias("first_fit"), F.min_by(F.when(fits, F.col("size")), F.when(fits, F.col("step"))).alias("fit_size"))
    kind = first_match([(F.col("original") <= F.col("target"), "already"), (F.col("floor_size") > F.col("target"), "cannot")], "reached")
    g = g.withColumn("kind", kind)
    reached = F.col("kind") == "reached"
    return g.select("file_id", "kind", "target", "original", "floor_size",
                    F.when(reached, F.col("first_fit")).alias("step"), F.when(reached, F.col("fit_size")).alias("size"))


def estimate_quality(df: DataFrame, table: str, base: list[int], out: str = "quality") -> DataFrame:
    """The quality setting behind a 64-entry quantisation table, or NULL.

    Every entry between 2 and 254 gives a scale against the base table (at 1 and 255 it was clipped). Their upper
    median is tried as the one scale of all: entries further than one step or 15 % from it rule it out.
    """
    luma = F.array(*[F.lit(v) for v in base])
    pairs = F.filter(F.zip_with(table, luma, lambda q, b: F.struct(q.alias("q"), b.alias("b"))), lambda p: (p["q"] > 1) & (p["q"] < 255))
    d = S.once(df, "_pairs", pairs)
    scales = F.array_sort(F.transform("_pairs", lambda p: (p["q"] * 100 - 50) / p["b"]))
    d = S.once(d, "_scale", F.try_element_at(scales, (F.floor(F.size("_pairs") / 2) + 1).cast("int")))

    def residual(p):
        predicted = F.greatest(F.lit(1), F.least(F.lit(255), F.floor((p["b"] * F.col("_scale") + 50) / 100)))
        return F.abs(predicted - p["q"]) / F.greatest(F.lit(1.0), p["q"] * F.lit(0.15))

    d = S.once(d, "_worst", F.array_max(F.transform("_pairs", residual)))
    scale = F.col("_scale")
    quality = F.when(scale >= 100, F.lit(5000.0) / scale).otherwise((F.lit(200.0) - scale) / 2)
    usable = (F.size("_pairs") >= 8) & (scale > 0) & (F.col("_worst") <= 1)
    d = d.withColumn(out, F.when(usable, F.greatest(F.lit(1), F.least(F.lit(100), S.js_round(quality))).cast("long")))
    return d.drop("_pairs", "_scale", "_worst")
