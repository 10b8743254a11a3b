"""Aggregations (§D) and the sentences built on them (H23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sentences
from ..operators import audit, images, measure, ocr, ordered, pages, runs, survey
from .catalog_joins import HITS, document_hits, phrases
from .catalog_rules import OUTCOME, RECOGNISED, ROLLED, judged, recognised, with_outcomes
from .catalog_sources import HOSTS, OWN
from .facts import BASE_LUMA
from .registry import query
from .sqltext import fixed, fmt_bytes, js_round, page_name, plural, r6


def micro(c):
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)


@query("q_d01_placement_rollup", f"SELECT doc_id, image_key, {r6('max(sqrt(a * a + b * b))')} AS width_pt, {r6('max(sqrt(c * c + d * d))')} AS height_pt, count(*) AS uses FROM placements GROUP BY 1, 2")
def _(t):
    return images.placement_rollup(t.placements).select("doc_id", "image_key", micro("width_pt"), micro("height_pt"), "uses")


@query("q_d01_placement_pages", "SELECT DISTINCT doc_id, image_key, page_index FROM placements")
def _(t):
    return images.placement_pages(t.placements)


DOCS = """docs AS (SELECT doc_id, count(*) AS images, count(*) FILTER (recompressible) AS recompressible, coalesce(sum(encoded_bytes) FILTER (recompressible), 0)::bigint AS actionable_bytes,
  coalesce(sum(encoded_bytes) FILTER (NOT recompressible), 0)::bigint AS skipped_bytes, coalesce(bool_and(list_contains(filters, 'DCTDecode')) FILTER (recompressible), false) AS all_jpeg,
  list_sort(list(dpi) FILTER (recompressible AND dpi IS NOT NULL)) AS ds, list_sort(list(quality) FILTER (recompressible AND quality IS NOT NULL AND filters = ['DCTDecode'])) AS qs FROM j GROUP BY 1)"""


@query("q_d02_document_rollup", f"WITH {ROLLED}, {DOCS} SELECT doc_id, images, recompressible, actionable_bytes, skipped_bytes, all_jpeg, {r6('ds[len(ds) // 2 + 1]')} AS median_dpi, qs[len(qs) // 2 + 1] AS median_quality FROM docs")
def _(t):
    d = images.document_rollup(judged(t, reread=True))
    return d.select("doc_id", "images", "recompressible", "actionable_bytes", "skipped_bytes", "all_jpeg", micro("median_dpi"), "median_quality")


@query("q_d03_upper_median", "SELECT l_suppkey, v[len(v) // 2 + 1] AS median_price FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)")
def _(t):
    return ordered.upper_medians(t.lineitem, ["l_suppkey"], {"median_price": F.col("l_extendedprice")})


HIST = f"""{ROLLED}, hist AS (SELECT doc_id, skip_reason, count(*) AS n, min((ordinal, image_key)) AS first_seen FROM j WHERE NOT recompressible GROUP BY 1, 2)"""


@query("q_d04_skip_histogram", f"WITH {HIST} SELECT doc_id, string_agg(skip_reason || '=' || n, '; ' ORDER BY skip_reason) AS reasons, sum(n)::bigint AS skipped FROM hist GROUP BY 1")
def _(t):
    # The reasons are a fixed list of rules, so a document's map has at most that many entries.
    h = images.skip_histogram(judged(t))
    entries = F.array_sort(F.collect_list(F.struct("skip_reason", "n")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["skip_reason"], F.lit("="), e["n"])), "; ")
    return h.groupBy("doc_id").agg(text.alias("reasons"), F.sum("n").alias("skipped"))


@query("q_d05_shared_bytes", "SELECT doc_id, sum(b)::bigint AS bytes FROM (SELECT doc_id, font_ref, max(font_bytes) AS b FROM fonts GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return images.shared_bytes(t.fonts, "doc_id", "font_ref", "font_bytes")


@query("q_d06_page_confidence", f"WITH {RECOGNISED} SELECT doc_id, page_index, words, {r6('confidence')} AS confidence FROM ocr")
def _(t):
    return recognised(t).select("doc_id", "page_index", "words", micro("confidence"))


SUMMARY = """s AS (SELECT res.doc_id, count(*) AS pages, count(*) FILTER (skipped IS NULL) AS pages_read, count(*) FILTER (skipped IS NULL AND source = 'layer') AS from_layer,
   coalesce(sum(words) FILTER (skipped IS NULL), 0)::bigint AS words, count(*) FILTER (skipped = 'no-text') AS blank, count(*) FILTER (skipped = 'low-confidence' AND page_index % 3 = 2) AS sideways,
   count(*) FILTER (skipped = 'low-confidence' AND page_index % 3 <> 2) AS unclear,
   cast(floor(sum(floor(confidence * 1000000.0 + 0.5)) FILTER (skipped IS NULL) / count(*) FILTER (skipped IS NULL) / 1000000.0 + 0.5) AS bigint) AS mean_confidence,
   cast(floor(min(confidence) FILTER (skipped = 'low-confidence' AND page_index % 3 <> 2) + 0.5) AS bigint) AS worst_unclear FROM res GROUP BY 1)"""


def results(t):
    return ocr.all_results(recognised(t), t.layer_pages)


def summary(t):
    turned = t.doc_page_index.select("doc_id", "page_index", F.when(F.col("page_index") % 3 == 2, 90).otherwise(0).alias("rotation"))
    return ocr.document_summary(results(t), turned)


@query("q_d07_recognition_summary", f"WITH {RECOGNISED}, {SUMMARY} SELECT * FROM s")
def _(t):
    return summary(t)


RUNS = "r AS (SELECT run_id, count(*) AS files, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in runs.KINDS) + " FROM run_results GROUP BY 1)"
HEAD = """CASE WHEN done = 0 AND interrupted + not_attempted > 0 THEN 'Stopped before any file was finished.' WHEN done = 0 THEN 'Nothing was written.'
  WHEN interrupted + not_attempted > 0 THEN 'Stopped. ' || done || CASE WHEN done = 1 THEN ' file' ELSE ' files' END || ' finished before you did.' ELSE done || ' of ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END || ' done.' END"""


@query("q_d08_run_outcomes", f"""WITH {RUNS} SELECT *, {HEAD} AS head, concat_ws('. ', CASE WHEN done > 0 THEN done || ' in the archive, with compress applied' END, CASE WHEN left_alone > 0 THEN left_alone || ' left alone, because there was nothing to gain' END,
    CASE WHEN failed > 0 THEN failed || ' failed, each named below with the reason' END, CASE WHEN interrupted > 0 THEN interrupted || ' stopped partway, with nothing of it kept' END, CASE WHEN not_attempted > 0 THEN not_attempted || ' not attempted' END) || '.' AS detail FROM r""")
def _(t):
    c = runs.outcome_counts(t.run_results, ["run_id"])
    return c.withColumn("head", runs.run_head()).withColumn("detail", runs.run_detail("Compress"))


@query("q_d09_resolution_buckets", f"WITH {ROLLED} SELECT doc_id, count(*) FILTER (recompressible AND dpi > 150) AS above, count(*) FILTER (recompressible AND dpi <= 150) AS at_or_below, count(*) FILTER (recompressible AND dpi IS NULL) AS unknown, count(*) FILTER (NOT recompressible) AS cannot FROM j GROUP BY 1")
def _(t):
    return images.resolution_buckets(judged(t), 150, ["doc_id"])


@query("q_d10_resolution_results", f"WITH {ROLLED} SELECT doc_id, count(*) FILTER (o = 'replaced') AS downscaled, count(*) FILTER (o <> 'replaced') AS stayed_above FROM (SELECT *, {OUTCOME} AS o FROM j WHERE recompressible AND dpi > 150) GROUP BY 1")
def _(t):
    j = judged(t, reread=True)
    return images.resolution_results(j, with_outcomes(j), 150)


@query("q_d11_licence_counts", "SELECT licence, count(*) AS packages FROM packages GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return t.packages.groupBy("licence").agg(F.count("*").alias("packages")).orderBy(F.desc("packages"), "licence")


@query("q_d12_host_summary", HOSTS)
def _(t):
    return measure.host_summary(t.requests, OWN)


@query("q_d13_activity_window", "SELECT host, epoch_us(min(moment)) AS first_at, epoch_us(max(moment)) AS last_at, count(*) AS requests FROM requests WHERE phase = 'pay' GROUP BY 1")
def _(t):
    from ..operators.rules import url_parts
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    pay = t.requests.where("phase = 'pay'").groupBy(url_parts("url")["host"].alias("host"))
    return pay.agg(us(F.min("at")).alias("first_at"), us(F.max("at")).alias("last_at"), F.count("*").alias("requests"))


@query("q_d14_twice_defined", "SELECT p_name, count(*) AS times FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return audit.twice_defined(t.part, "p_name")


EGRESS = f"""SELECT session, sum(greatest(bytes, 0))::bigint AS sent_bytes, count(*) FILTER (bytes <> 0) AS sends, count(*) FILTER (bytes < 0) AS unmeasured,
    count(DISTINCT url) FILTER (split_part(url, '://', 1) || '://' || host <> '{OWN}') AS third_party_urls FROM requests GROUP BY 1"""


@query("q_d15_egress", EGRESS)
def _(t):
    return measure.egress(t.requests, OWN, ["session"])


STORED = """stored AS (SELECT lower(trim(email)) AS email, max_by(trim(profession), (moment, event_id)) AS profession FROM survey_checked WHERE verdict = 'recorded' GROUP BY 1)"""


@query("q_d16_people_per_profession", f"WITH {STORED} SELECT profession, count(*) AS people FROM stored GROUP BY 1")
def _(t):
    return survey.people_per_profession(survey.latest_answers(survey.cleaned(t.survey)))


@query("q_d17_size_labels", f"SELECT doc_id, array_to_string(list(label ORDER BY seen), ', ') AS sizes FROM (SELECT doc_id, {page_name('width_pt', 'height_pt')} AS label, min(page_index) AS seen FROM file_pages GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return pages.size_labels(t.file_pages)


MERGED = "m AS (SELECT p_brand, sum(size)::bigint AS before, cast(floor(sum(size) * (CASE WHEN p_brand LIKE '%2' THEN 102 ELSE 98 END) / 100) AS bigint) AS after FROM files JOIN part ON file_id = p_partkey GROUP BY 1)"


@query("q_d18_merged_size", f"""WITH {MERGED} SELECT p_brand, {fmt_bytes('before')} || ' in, ' || {fmt_bytes('after')} || ' out' AS fact, CASE WHEN after <= before THEN '' ELSE 'The merged file is ' || {fmt_bytes('(after - before)')} ||
    ' larger than the files you gave it add up to. Merging copies each page’s images and fonts exactly as they are, so it cannot win those bytes back — Compress is the tool that tries.' END AS note FROM m""")
def _(t):
    d = t.files.join(t.part.select(F.col("p_partkey").alias("file_id"), "p_brand"), "file_id").groupBy("p_brand").agg(F.sum("size").alias("before"))
    after = S.div(F.col("before") * F.when(F.col("p_brand").endswith("2"), 102).otherwise(98), 100)
    fact, note = sentences.merged_size(F.col("before"), F.col("after"))
    return d.withColumn("after", after).select("p_brand", fact.alias("fact"), note.alias("note"))


@query("q_d19_orientation_minority", """SELECT doc_id, pages, least(wide, pages - wide) AS odd, wide < pages - wide AS odd_is_landscape FROM (SELECT doc_id, count(*) AS pages,
    count(*) FILTER ((rotation IN (90, 270)) <> (width_pt > height_pt)) AS wide FROM file_pages GROUP BY 1) WHERE wide > 0 AND wide < pages""")
def _(t):
    return pages.orientation_minority(pages.shapes(t.file_pages))


IMAGESET = "s AS (SELECT doc_id, count(*) AS images, count(*) FILTER (NOT list_contains(filters, 'DCTDecode')) AS converted, max(width) AS max_w, max(height) AS max_h, count(*) FILTER (image_key % 5 = 0) AS had_metadata FROM images GROUP BY 1)"


def image_set(t):
    return t.images.groupBy("doc_id").agg(
        F.count("*").alias("images"), F.count_if(~F.array_contains("filters", "DCTDecode")).alias("converted"), F.max("width").alias("max_w"),
        F.max("height").alias("max_h"), F.count_if(F.col("image_key") % 5 == 0).alias("had_metadata"))


@query("q_d20_image_set", f"WITH {IMAGESET} SELECT * FROM s")
def _(t):
    return image_set(t)


@query("q_d21_probe_verdict", """SELECT run, max(mb) FILTER (outcome = 'survived' AND pipe_ms <= 30000) AS largest_usable, min(mb) FILTER (outcome = 'survived' AND pipe_ms > 30000) AS first_collapsed,
    min(mb) FILTER (outcome <> 'survived') AS first_failed, min_by(phase, mb) FILTER (outcome <> 'survived') AS failed_phase FROM rungs GROUP BY 1""")
def _(t):
    return measure.verdict(t.rungs)


@query("q_d22_outline_count", "SELECT doc_id, count(*) AS bookmarks FROM outline GROUP BY 1")
def _(t):
    return t.outline.groupBy("doc_id").agg(F.count("*").alias("bookmarks"))


@query("q_d23_page_weight", """WITH asset AS (SELECT href, length(href) * 100 AS size FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)),
    used AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT p.page_id, strlen(html) + coalesce(js, 0)::bigint + (SELECT sum(n_nationkey) * 1000 FROM nation)::bigint AS weight FROM pages p
    LEFT JOIN (SELECT page_id, sum(size) AS js FROM used JOIN asset USING (href) GROUP BY 1) u ON p.page_id = u.page_id""")
def _(t):
    """An asset's size follows from its own name here, so a page's links are weighed inside its row and nothing is joined."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    js = F.aggregate(hrefs, F.lit(0).cast("long"), lambda n, h: n + F.length(h) * 100)
    fonts = t.nation.agg((F.sum("n_nationkey") * 1000).cast("long")).scalar()
    return t.pages.select("page_id", (F.octet_length("html").cast("long") + js + fonts).alias("weight"))


MARKS, LINE = ["<nav>", "<article>", "<footer>"], "the "


@query("q_d24_worst_gap", r"""WITH p AS (SELECT page_id, regexp_replace(html, '\s+', ' ', 'g') AS html FROM pages),
    g AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, instr(html, '<nav>') - 1 AS lo, instr(html, '<footer>') - 1 + 8 AS hi, html FROM p WHERE contains(html, '<nav>') AND contains(html, '<article>') AND contains(html, '<footer>')),
    o AS (SELECT page_id, unnest(list_filter(range(1, length(html) - 3), lambda i: substr(html, i::bigint, 4) = 'the ')) - 1 AS i FROM g),
    gap AS (SELECT page_id, min(CASE WHEN i BETWEEN lo AND hi THEN 0 WHEN i < lo THEN lo - i ELSE i - hi END) AS gap FROM o JOIN g USING (page_id) GROUP BY 1)
    SELECT lang, max(gap) AS worst, max_by(page_id, (gap, page_id)) AS page_id FROM gap JOIN g USING (page_id) GROUP BY 1""")
def _(t):
    gap = audit.nearest_gap(t.pages, "page_id", "html", {"page": MARKS}, LINE).where("gap is not null")
    lang = t.pages.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))
    return gap.join(lang, "page_id").groupBy("lang").agg(F.max("gap").alias("worst"), F.max_by("page_id", F.struct("gap", "page_id")).alias("page_id"))


MERGE = f"""per AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  lab AS (SELECT DISTINCT o_custkey, {page_name('width_pt', 'height_pt')} AS label FROM file_pages JOIN orders ON doc_id = o_orderkey),
  g AS (SELECT o_custkey, count(*) AS files, sum(n)::bigint AS pages, string_agg(n, ' + ' ORDER BY o_orderkey) AS pages_text, count(*) FILTER (n > 2) AS bookmarks FROM per GROUP BY 1),
  z AS (SELECT o_custkey, count(*) AS n_sizes, string_agg(label, ' and ' ORDER BY label) AS sizes_text FROM lab GROUP BY 1)"""


def merged_files(t):
    """The pieces of every merge: one row per file with its pages."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.select("o_custkey", "o_orderkey").join(lines, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def merge_summary(t):
    """Counts fold per file; the text that names each of a run's files is put together for those who ask for it."""
    files = merged_files(t)
    text = ordered.text_in_order(files, ["o_custkey"], "o_orderkey", F.col("n").cast("string"), " + ", "pages_text")
    return merge_counts(t, files).join(text, "o_custkey").select("o_custkey", "files", "pages", "pages_text", "bookmarks", "n_sizes", "sizes_text")


def merge_counts(t, files):
    g = files.groupBy("o_custkey").agg(F.count("*").alias("files"), F.sum("n").alias("pages"), F.count_if(F.col("n") > 2).alias("bookmarks"))
    labels = t.file_pages.select(F.col("doc_id").alias("o_orderkey"), S.page_size_name("width_pt", "height_pt").alias("label")).distinct()
    labels = labels.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", "label").distinct()
    z = labels.groupBy("o_custkey").agg(F.count("*").alias("n_sizes"), F.array_join(F.array_sort(F.collect_list("label")), " and ").alias("sizes_text"))
    return g.join(z, "o_custkey", "left")


@query("q_d25_merge_pieces", f"WITH {MERGE} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, n AS pages FROM per")
def _(t):
    """The pieces in order, for runs of any number of files."""
    placed = ordered.number(merged_files(t), ["o_custkey"], ["o_orderkey"], ordered.chunk_of("o_orderkey"), "place")
    return placed.select("o_custkey", "o_orderkey", "place", F.col("n").alias("pages"))


@query("q_d25_merge_counts", f"WITH {MERGE} SELECT g.* EXCLUDE (pages_text), n_sizes, sizes_text FROM g LEFT JOIN z USING (o_custkey)")
def _(t):
    return merge_counts(t, merged_files(t))


@query("q_d25_merge_summary", f"WITH {MERGE} SELECT g.*, n_sizes, sizes_text FROM g LEFT JOIN z USING (o_custkey)")
def _(t):
    return merge_summary(t)


SPLIT = "part AS (SELECT doc_id, page_index // 3 + 1 AS no, count(*) AS n FROM doc_page_index GROUP BY 1, 2), sp AS (SELECT doc_id, count(*) AS parts, sum(n)::bigint AS pages, string_agg(n, ' + ' ORDER BY no) AS pages_text FROM part GROUP BY 1)"


def split_parts(t):
    return pages.split_every(t.doc_page_index, 3).groupBy("doc_id", "part").agg(F.count("*").alias("n"))


def split_summary(t):
    part = split_parts(t)
    text = ordered.text_in_order(part, ["doc_id"], "part", F.col("n").cast("string"), " + ", "pages_text")
    return part.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n").alias("pages")).join(text, "doc_id")


@query("q_d26_split_pieces", f"WITH {SPLIT} SELECT doc_id, no AS place, n AS pages FROM part")
def _(t):
    """The parts one by one, for documents of any number of them."""
    return split_parts(t).select("doc_id", F.col("part").cast("long").alias("place"), F.col("n").alias("pages"))


@query("q_d26_split_summary", f"WITH {SPLIT} SELECT * FROM sp")
def _(t):
    return split_summary(t)


def source_images(t):
    """Source image sizes per run; small for some runs, all alike for others."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    size = F.when(number % 5 == 0, F.lit(200000)).when(number % 4 == 0, F.col("p_partkey") * 10 + 1000).otherwise(F.col("p_partkey") + 200000)
    return t.part.where(number != 7).select(F.col("p_brand").alias("run"), size.cast("long").alias("bytes"))


SURVIVED = "ok AS (SELECT * FROM rungs WHERE outcome = 'survived')"
ENDS = "e AS (SELECT run, count(*) AS n, min(mb) AS lo, max(mb) AS hi, min_by(pipe_ms, mb) AS lo_ms, max_by(pipe_ms, mb) AS hi_ms, min_by(recompressed, mb) AS lo_n, max_by(recompressed, mb) AS hi_n FROM ok GROUP BY 1)"
FLAT = """flat AS (SELECT run, mb, to_mb, n, lo, hi FROM (SELECT run, mb, count(*) OVER w AS n, min(pipe_ms) OVER w AS lo, max(pipe_ms) OVER w AS hi, max(mb) OVER w AS to_mb FROM ok
  WINDOW w AS (PARTITION BY run ORDER BY mb ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE n >= 3 AND to_mb::double / mb >= 2 AND hi <= lo * 1.1::double)"""
GROWTH = "gr AS (SELECT *, hi::double / lo AS span, hi_ms::double / greatest(lo_ms, 1) AS ratio, greatest(1.5, hi::double / lo * 0.5) AS expected FROM e WHERE n >= 3)"


@query("q_d27_validity", f"""WITH {SURVIVED}, {ENDS}, {FLAT}, {GROWTH},
    src AS (SELECT p_brand AS run, CASE WHEN b % 5 = 0 THEN 200000 WHEN b % 4 = 0 THEN p_partkey * 10 + 1000 ELSE p_partkey + 200000 END AS bytes FROM (SELECT *, regexp_extract(p_brand, '(\\d+)$', 1)::bigint AS b FROM part) WHERE b <> 7),
    si AS (SELECT run, min(bytes) AS lo, max(bytes) AS hi FROM src GROUP BY 1), one AS (SELECT DISTINCT run FROM ok)
    SELECT run, mb, unnest(list_filter([CASE WHEN built_bytes IS NULL THEN 'no-fixture-size' END, CASE WHEN abs(built_bytes / 1048576.0::double - mb) / mb > 0.25 THEN 'fixture-size-off' END, CASE WHEN pipe_ms < 50 THEN 'impossible-time' END,
      CASE WHEN recompressed = 0 AND skipped > 0 THEN 'recompressed-nothing' END, CASE WHEN pages_seen = 0 THEN 'saw-no-pages' END, CASE WHEN saved_bytes::double / built_bytes < 0.5 THEN 'did-not-survive-round-trip' END], lambda x: x IS NOT NULL)) AS problem FROM ok
    UNION ALL SELECT run, NULL, 'time-did-not-grow' FROM gr WHERE span >= 2 AND ratio < expected
    UNION ALL SELECT DISTINCT run, NULL::bigint, 'times-flat' FROM flat UNION ALL SELECT run, NULL, 'work-did-not-grow' FROM e WHERE n >= 2 AND hi >= lo * 2 AND hi_n <= lo_n
    UNION ALL SELECT coalesce(one.run, si.run), NULL, unnest(list_filter([CASE WHEN lo IS NULL THEN 'no-source-sizes' END, CASE WHEN lo = hi THEN 'sources-identical' END, CASE WHEN lo < 153600 THEN 'sources-too-small' END], lambda x: x IS NOT NULL)) FROM one FULL JOIN si ON one.run = si.run""")
def _(t):
    return measure.validate(t.rungs, source_images(t))


SEARCH = """sz AS (SELECT file_id, max(original) AS original, max(target) AS target, max(size) FILTER (step = 8) AS floor_size, min(step) FILTER (size <= target) AS fit, min_by(size, step) FILTER (size <= target) AS fit_size FROM size_measurements GROUP BY 1),
  ans AS (SELECT *, CASE WHEN original <= target THEN 'already' WHEN floor_size > target THEN 'cannot' ELSE 'reached' END AS kind FROM sz)"""


@query("q_d28_size_search", f"WITH {SEARCH} SELECT file_id, kind, target, original, floor_size, CASE WHEN kind = 'reached' THEN fit END AS step, CASE WHEN kind = 'reached' THEN fit_size END AS size FROM ans")
def _(t):
    return images.size_search(t.size_measurements)


ESTIMATE = f"""pr AS (SELECT vec_id, origin, made_at, list_filter(list_transform(range(1, 65), lambda i: {{'q': tbl[i], 'b': ({BASE_LUMA})[i]}}), lambda p: p.q > 1 AND p.q < 255) AS ps FROM quant_tables),
  md AS (SELECT *, list_sort(list_transform(ps, lambda p: (p.q * 100 - 50)::double / p.b)) AS sc FROM pr), m2 AS (SELECT *, sc[len(sc) // 2 + 1] AS med FROM md),
  wr AS (SELECT *, list_max(list_transform(ps, lambda p: abs(greatest(1, least(255, floor((p.b * med + 50) / 100))) - p.q) / greatest(1.0::double, p.q * 0.15::double))) AS worst FROM m2),
  est AS (SELECT vec_id, origin, made_at, CASE WHEN len(ps) >= 8 AND med > 0 AND worst <= 1 THEN greatest(1, least(100, cast(floor(CASE WHEN med >= 100 THEN 5000.0::double / med ELSE (200.0::double - med) / 2 END + 0.5) AS bigint))) END AS quality FROM wr)"""


@query("q_d29_quality_estimate", f"WITH {ESTIMATE} SELECT origin, quality, count(*) AS tables, count(*) FILTER (quality = made_at) AS exact FROM est GROUP BY 1, 2")
def _(t):
    d = images.estimate_quality(t.quant_tables, "tbl", BASE_LUMA)
    return d.groupBy("origin", "quality").agg(F.count("*").alias("tables"), F.count_if(F.col("quality") == F.col("made_at")).alias("exact"))


@query("q_d30_searchable_coverage", f"WITH {RECOGNISED} SELECT doc_id, count(*) AS pages, count(*) FILTER (skipped IS NULL AND words > 0) AS to_layer, count(*) FILTER (skipped IS NULL AND source = 'layer') AS from_layer FROM res GROUP BY 1")
def _(t):
    return ocr.searchable_coverage(results(t))


@query("q_d31_text_metrics", r"SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), ocr.word_count("text").alias("words"))


@query("q_d32_rule_hits", f"WITH {HITS} SELECT phrase_id, count(*) AS pages, array_to_string(list_sort(list(doc_id))[1:4], ',') AS named FROM hits GROUP BY 1")
def _(t):
    return audit.hit_rollup(document_hits(t), "doc_id")


@query("q_d33_stage_shares", f"SELECT run, stage, ms, total, {fixed('n', 10, 1)} || '%' AS share FROM (SELECT *, cast(floor(ms::double / total * 1000.0 + 0.5) AS bigint) AS n FROM (SELECT run, stage, sum(ms)::bigint AS ms, (sum(sum(ms)) OVER (PARTITION BY run))::bigint AS total FROM stages GROUP BY 1, 2))")
def _(t):
    return measure.stage_shares(t.stages)


@query("q_d34_any_of", "SELECT l_suppkey AS doc_id, bool_or(l_linenumber % 7 = 0) AS has_text, bool_or(l_linenumber = 5 AND l_tax > 0.07) AS signed FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("doc_id")).agg(
        F.bool_or(F.col("l_linenumber") % 7 == 0).alias("has_text"), F.bool_or((F.col("l_linenumber") == 5) & (F.col("l_tax") > 0.07)).alias("signed"))


PRESETS = [150, 110, 72]


@query("q_d35_change_counts", f"WITH {ROLLED} SELECT doc_id, " + ", ".join(f"count(*) FILTER (recompressible AND dpi > {p}) AS above_{p}" for p in PRESETS) + " FROM j GROUP BY 1")
def _(t):
    return judged(t).groupBy("doc_id").agg(*[F.count_if(F.col("recompressible") & (F.col("dpi") > p)).alias(f"above_{p}") for p in PRESETS])


# -- sentences ---------------------------------------------------------------------------------


@query("q_h23_merged", f"""WITH {MERGE} SELECT o_custkey, pages_text || ' pages, in the order you set. ' || CASE WHEN bookmarks > 0 THEN {plural('bookmarks', 'bookmark')} || ' kept, in ' || {plural('files', 'group')} || '.' ELSE 'No bookmarks: none of the files had any.' END || ' ' ||
    CASE WHEN n_sizes > 1 THEN 'Page sizes ' || sizes_text || ', all kept as they were.' ELSE 'Page size ' || coalesce(sizes_text, 'unknown') || ', unchanged.' END || ' ' ||
    CASE WHEN files % 4 > 0 THEN {plural('(files % 4)', 'form field')} || ' kept' || CASE WHEN files % 4 > 2 THEN ', ' || (files % 4 - 2) || ' renamed to avoid a clash' ELSE '' END || '.' ELSE 'No form fields in these files.' END AS said FROM g LEFT JOIN z USING (o_custkey)""")
def _(t):
    c = F.col
    fields = c("files") % 4
    return merge_summary(t).select("o_custkey", sentences.merged(c("pages_text"), c("files"), c("bookmarks"), c("sizes_text"), c("n_sizes"), fields,
                                                                F.greatest(fields - 2, F.lit(0).cast("long"))).alias("said"))


@query("q_h23_split", f"WITH {SPLIT} SELECT doc_id, CASE WHEN parts = 1 THEN {plural('pages', 'page')} || ', ' || {fmt_bytes('(pages * 1000)')} || '.' ELSE pages_text || ' pages, ' || {fmt_bytes('(pages * 1000)')} || ' in total.' END || ' Your original file is untouched, on your disk, where it was.' AS said FROM sp")
def _(t):
    return split_summary(t).select("doc_id", sentences.split(F.col("pages_text"), F.col("parts"), F.col("pages"), S.format_bytes(F.col("pages") * 1000)).alias("said"))


@query("q_h23_images_to_pdf", f"""WITH {IMAGESET} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Every page is A4.' ELSE 'Each page matches its image.' END || ' Largest image ' || max_w || ' × ' || max_h || '; ' || converted || ' converted. ' ||
    CASE WHEN had_metadata = 0 THEN 'None of these carried photo EXIF.' WHEN doc_id % 3 = 0 THEN 'Photo EXIF (GPS coordinates, phone model, capture time) removed from ' || had_metadata || ' of ' || images || '.' ELSE 'Photo EXIF kept on ' || had_metadata || ' of ' || images || '.' END AS said FROM s""")
def _(t):
    c = F.col
    return image_set(t).select("doc_id", sentences.images_to_pdf(c("images"), c("converted"), c("max_w"), c("max_h"), c("had_metadata"), c("doc_id") % 3 == 0,
                                                                 F.when(c("doc_id") % 2 == 0, F.lit("A4"))).alias("said"))


DRIFT = "(CASE WHEN file_id % 2 = 0 THEN '+' ELSE '-' END || (file_id % 7) || '.0%')"


@query("q_h23_rotated_reordered", f"""SELECT file_id, 'Every page is still here, and no image was re-encoded. ' || {fmt_bytes('size')} || ' in, ' || {fmt_bytes('(size * 99 // 100)')} || ' out (' || {DRIFT} || ').' AS rotated,
    (file_id % 30 + 1) || ' → ' || (file_id % 30 + 1 - file_id % 2) || ' pages, and no image re-encoded. ' || {fmt_bytes('size')} || ' in, ' || {fmt_bytes('(size * 99 // 100)')} || ' out.' ||
    CASE WHEN file_id % 3 = 0 THEN '' WHEN file_id % 4 > 0 THEN ' ' || {plural('(file_id % 4)', 'bookmark')} || ' kept.' ELSE ' Bookmarks dropped: their pages are gone.' END AS reordered FROM files""")
def _(t):
    k = F.col("file_id")
    a, b = S.format_bytes("size"), S.format_bytes(S.div(F.col("size") * 99, 100))
    drift = F.concat(F.when(k % 2 == 0, "+").otherwise("-"), k % 7, F.lit(".0%"))
    return t.files.select("file_id", sentences.rotated(a, b, drift).alias("rotated"), sentences.reordered(a, b, k % 30 + 1, k % 30 + 1 - k % 2, k % 3 != 0, k % 4).alias("reordered"))


@query("q_h23_compressed", f"""WITH {ROLLED}, c AS (SELECT doc_id, count(*) FILTER (o = 'replaced') AS r, count(*) FILTER (o IN ('kept', 'not-smaller')) AS k, count(*) FILTER (o = 'undecodable') AS u, count(*) FILTER (o = 'replaced' AND image_key % 2 = 0) AS ds FROM (SELECT *, {OUTCOME} AS o FROM j WHERE recompressible) GROUP BY 1),
    p AS (SELECT *, concat_ws('; ', CASE WHEN r > 0 THEN {plural('r', 'image')} || ' re-encoded at quality 72' || CASE WHEN ds = 0 THEN '' WHEN ds = r THEN ' and downscaled to about 150 dpi' ELSE ', ' || ds || ' of them downscaled to about 150 dpi' END END,
      CASE WHEN k > 0 THEN {plural('k', 'image')} || ' left as ' || CASE WHEN k = 1 THEN 'it was' ELSE 'they were' END || ', because re-encoding would not have made ' || CASE WHEN k = 1 THEN 'it' ELSE 'them' END || ' smaller' END,
      CASE WHEN u > 0 THEN {plural('u', 'image')} || ' this browser could not read, left as ' || CASE WHEN u = 1 THEN 'it was' ELSE 'they were' END END) AS parts FROM c)
    SELECT doc_id, CASE WHEN parts = '' THEN 'No images to change.' ELSE parts || '.' END || ' Text, vectors and form fields copied byte-for-byte. ' || CASE WHEN doc_id % 2 = 0 THEN 'Author and timestamps removed.' ELSE 'Metadata kept as it was.' END AS said FROM p""")
def _(t):
    o, c = F.col("outcome"), F.col
    g = with_outcomes(judged(t)).groupBy("doc_id").agg(
        F.count_if(o == "replaced").alias("r"), F.count_if(o.isin("kept", "not-smaller")).alias("k"), F.count_if(o == "undecodable").alias("u"),
        F.count_if((o == "replaced") & (c("image_key") % 2 == 0)).alias("ds"))
    return g.select("doc_id", sentences.compressed(c("r"), F.lit(72), c("ds"), F.lit(150), c("k"), c("u"), c("doc_id") % 2 == 0).alias("said"))


@query("q_h23_recognised", f"""WITH {RECOGNISED}, {SUMMARY} SELECT doc_id, CASE WHEN pages_read = 0 THEN 'No text could be read from this document.' ELSE 'The text was read from ' || pages_read || ' of ' || pages || CASE WHEN pages = 1 THEN ' page.' ELSE ' pages.' END END AS head,
    CASE WHEN pages_read = 0 THEN 'No text could be read.' ELSE 'Text read from ' || pages_read || ' of ' || pages || ' pages.' || CASE WHEN from_layer > 0 THEN ' ' || from_layer || ' came from the document''s own text layer.' ELSE '' END END AS announce FROM s""")
def _(t):
    c = F.col
    return summary(t).select("doc_id", sentences.recognised_head(c("pages_read"), c("pages")).alias("head"),
                             sentences.recognised_announce(c("pages_read"), c("pages"), c("from_layer")).alias("announce"))


@query("q_h23_searchable", f"""WITH {RECOGNISED}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (skipped IS NULL AND words > 0) AS l, count(*) FILTER (skipped IS NULL AND source = 'layer') AS f FROM res GROUP BY 1)
    SELECT doc_id, CASE WHEN l = 0 THEN NULL WHEN f > 0 THEN (l + f) || ' of ' || n || CASE WHEN n = 1 THEN ' page is' ELSE ' pages are' END || ' searchable in the saved copy: ' || l || ' given a text layer here, ' || f || ' already had ' || CASE WHEN f = 1 THEN 'its' ELSE 'their' END || ' own.'
    ELSE l || ' of ' || n || CASE WHEN n = 1 THEN ' page is' ELSE ' pages are' END || ' now searchable.' END AS head FROM c""")
def _(t):
    return ocr.searchable_coverage(results(t)).select("doc_id", sentences.searchable_head(F.col("pages"), F.col("from_layer"), F.col("to_layer")).alias("head"))


@query("q_h23_resolution", f"""WITH {ROLLED}, c AS (SELECT doc_id, count(*) FILTER (recompressible AND dpi > 150 AND o = 'replaced') AS ds, count(*) FILTER (recompressible AND dpi > 150 AND o <> 'replaced') AS st, count(*) FILTER (recompressible AND dpi <= 150) AS lo,
      count(*) FILTER (recompressible AND dpi IS NULL) AS un, count(*) FILTER (NOT recompressible) AS ca FROM (SELECT *, {OUTCOME} AS o FROM j) GROUP BY 1)
    SELECT doc_id, concat_ws('; ', {plural('ds', 'image')} || ' brought down to 150 dpi', CASE WHEN lo > 0 THEN lo || ' already at or below it left as ' || CASE WHEN lo = 1 THEN 'it was' ELSE 'they were' END END, CASE WHEN un > 0 THEN un || ' with no measurable resolution left alone' END,
      CASE WHEN ca > 0 THEN ca || ' in a form this cannot re-encode left alone' END) || '.' || CASE WHEN st > 0 THEN ' ' || {plural('st', 'image')} || ' stayed above 150 dpi, because resizing ' || CASE WHEN st = 1 THEN 'it' ELSE 'them' END || ' would not have made the file smaller.' ELSE '' END AS said FROM c""")
def _(t):
    j = judged(t, reread=True)
    zero, c = F.lit(0).cast("long"), F.col
    d = images.resolution_buckets(j, 150, ["doc_id"]).join(images.resolution_results(j, with_outcomes(j), 150), "doc_id", "left")
    return d.select("doc_id", sentences.resolution(150, F.coalesce("downscaled", zero), c("at_or_below"), c("unknown"), c("cannot"), F.coalesce("stayed_above", zero)).alias("said"))


STEPS = "CASE fit " + " ".join(f"WHEN {i} THEN '{d} dpi, quality {int(q * 100 + 0.5)}'" for i, (d, q) in enumerate(images.LADDER)) + " END"


@query("q_h23_size_answer", f"""WITH {SEARCH} SELECT file_id, CASE kind WHEN 'already' THEN 'This file is already ' || {fmt_bytes('original')} || ' (' || format('{{:,}}', original) || ' bytes), which is under ' || {fmt_bytes('target')} || '. There is nothing to do.'
    WHEN 'cannot' THEN 'This file can''t be brought under ' || {fmt_bytes('target')} || ' here. At our harshest setting — 72 dpi, quality 42 — it comes to ' || {fmt_bytes('floor_size')} || ' (' || format('{{:,}}', floor_size) || ' bytes).'
    ELSE 'Under ' || {fmt_bytes('target')} || ': ' || {fmt_bytes('fit_size')} || ' (' || format('{{:,}}', fit_size) || ' bytes) at ' || {STEPS} || ' — the mildest setting that got there.' END AS said FROM ans""")
def _(t):
    c = F.col
    d = images.size_search(t.size_measurements).withColumn("shown", F.when(c("kind") == "already", c("original")).otherwise(c("size")))
    return d.select("file_id", sentences.size_answer(c("kind"), c("target"), c("shown"), c("floor_size"), c("step"), images.LADDER).alias("said"))


LEVER = "CASE WHEN (q IS NULL OR q > 42) OR (d IS NULL OR d > 72) THEN ' We could hand you a visibly worse file for a few kilobytes, but that is not an improvement, so we are telling you instead.' ELSE ' Our Smallest setting would not change it either: it targets quality 42 at 72 dpi, and this file is already at quality ' || q || ' and ' || cast(floor(d + 0.5) AS bigint) || ' dpi.' END"
FONT = f"(' ' || {fmt_bytes('fonts')} || ' of its ' || {fmt_bytes('total')} || ' is embedded fonts, which this tool does not rewrite. That is a limit of this tool, not a finding about the file.')"


@query("q_h23_no_gain", f"""WITH {HIST}, {DOCS}, top AS (SELECT doc_id, arg_max(skip_reason, (n, -first_seen[1], -first_seen[2])) AS reason FROM hist GROUP BY 1), f AS (SELECT doc_id, sum(b)::bigint AS fonts FROM (SELECT DISTINCT doc_id, font_ref, font_bytes AS b FROM fonts) GROUP BY 1),
    x AS (SELECT docs.*, ds[len(ds) // 2 + 1] AS d, qs[len(qs) // 2 + 1] AS q, reason, fonts, actionable_bytes + skipped_bytes + fonts AS total FROM docs LEFT JOIN top USING (doc_id) JOIN f USING (doc_id))
    SELECT doc_id, CASE WHEN recompressible = 0 THEN 'Its ' || CASE WHEN images = 1 THEN 'one image is' ELSE images || ' images are' END || ' ' || reason || '. Recompressing ' || CASE WHEN images = 1 THEN 'it' ELSE 'them' END || ' would add bytes rather than remove them.' || CASE WHEN fonts > skipped_bytes THEN {FONT} ELSE '' END
    ELSE 'Its ' || CASE WHEN recompressible = 1 THEN 'one image is' ELSE recompressible || ' images are' END || ' already ' || CASE WHEN all_jpeg THEN 'JPEG' ELSE 'compressed' END || CASE WHEN q IS NOT NULL THEN ' at quality ' || q ELSE '' END ||
    CASE WHEN d IS NOT NULL THEN CASE WHEN q IS NOT NULL THEN ' and ' ELSE ' at ' END || cast(floor(d + 0.5) AS bigint) || ' dpi' ELSE '' END || ' — close to what our Balanced setting would produce.' ||
    CASE WHEN fonts > actionable_bytes THEN {FONT} WHEN skipped_bytes > actionable_bytes THEN ' Most of its image data is in images this tool leaves alone.' ELSE '' END || {LEVER} END AS said FROM x""")
def _(t):
    c = F.col
    j = judged(t, reread=True)
    d = images.document_rollup(j).join(images.top_skip_reason(images.skip_histogram(j)).select("doc_id", "top_reason"), "doc_id", "left")
    d = d.join(images.shared_bytes(t.fonts, "doc_id", "font_ref", "font_bytes").withColumnRenamed("bytes", "fonts"), "doc_id")
    lever = images.harder_lever(c("median_quality"), c("median_dpi"))
    said = sentences.no_gain(c("images"), c("recompressible"), c("all_jpeg"), c("median_quality"), c("median_dpi"), c("skipped_bytes"), c("actionable_bytes"), c("top_reason"), lever, "Balanced",
                             images.SMALLEST_QUALITY, images.SMALLEST_DPI, c("fonts"), c("actionable_bytes") + c("skipped_bytes") + c("fonts"), F.lit(True))
    return d.select("doc_id", said.alias("said"))
