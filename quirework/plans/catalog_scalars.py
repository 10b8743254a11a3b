"""Scalar functions over whole tables (§H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, ocr, pages, rules
from .facts import Tables, choose
from .registry import query
from .sqltext import BODY, TITLE, error_bytes, fixed, fmt_bytes, js_round, normalise, page_name, plural, r6, readout

AMOUNT = "cast(floor(o_totalprice) AS bigint) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 WHEN 2 THEN 9973 ELSE 99991 END) // (CASE o_orderkey % 4 WHEN 0 THEN 1000 ELSE 1 END)"


def amounts(t: Tables):
    k = F.col("o_orderkey") % 4
    n = F.floor("o_totalprice").cast("long") * choose(k, [1, 97, 9973, 99991], "long")
    return t.orders.select("o_orderkey", F.when(k == 0, S.div(n, 1000)).otherwise(n).alias("n"))


@query("q_h01_format_bytes", f"SELECT o_orderkey, n, {fmt_bytes('n')} AS label, {fmt_bytes('n', True)} AS exact FROM (SELECT o_orderkey, {AMOUNT} AS n FROM orders)")
def _(t):
    return amounts(t).select("o_orderkey", "n", S.format_bytes("n").alias("label"), S.format_bytes("n", True).alias("exact"))


@query("q_h02_byte_variants", f"SELECT o_orderkey, {readout('n')} AS readout, {error_bytes('n')} AS card FROM (SELECT o_orderkey, {AMOUNT} AS n FROM orders)")
def _(t):
    return amounts(t).select("o_orderkey", S.readout_bytes("n").alias("readout"), S.error_bytes("n").alias("card"))


@query("q_h03_plural_percent_seconds", f"""SELECT o_orderkey, {plural('n', 'page')} AS pages, {fixed('n', 1000, 1)} || 's' AS took,
    floor(share * 100.0 + 0.5)::bigint || '%' AS pct FROM (SELECT o_orderkey, {AMOUNT} AS n, o_totalprice / 500000.0 AS share FROM orders)""")
def _(t):
    d = amounts(t).join(t.orders.select("o_orderkey", (F.col("o_totalprice") / 500000.0).alias("share")), "o_orderkey")
    return d.select("o_orderkey", S.plural("n", "page").alias("pages"), S.seconds("n").alias("took"), S.percent("share").alias("pct"))


@query("q_h04_suffix_name", r"SELECT file_id, regexp_replace(name, '\.[^.]+$', '') || '-small.pdf' AS name FROM files")
def _(t):
    return t.files.select("file_id", S.suffix_name("name", "-small").alias("name"))


@query("q_h05_safe_name", r"""SELECT doc_id, CASE WHEN n = '' THEN 'file' ELSE n END AS name FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(
    regexp_replace('../' || text, '[\\/:*?"<>|]', '-', 'g'), '[\x00-\x1f]', '', 'g'), '^\.+', '')) AS n FROM documents)""")
def _(t):
    return t.documents.select("doc_id", S.safe_name(F.concat(F.lit("../"), "text")).alias("name"))


@query("q_h06_page_size_name", f"SELECT label, count(*) AS pages FROM (SELECT {page_name('width_pt', 'height_pt + page_index')} AS label FROM file_pages) GROUP BY 1")
def _(t):
    h = F.col("height_pt") + F.col("page_index")
    return t.file_pages.groupBy(S.page_size_name("width_pt", h).alias("label")).agg(F.count("*").alias("pages"))


@query("q_h07_points_to_mm", f"SELECT DISTINCT l_linenumber, l_quantity, {js_round('l_quantity * l_linenumber / 72.0 * 25.4')} AS mm FROM lineitem")
def _(t):
    pt = F.col("l_quantity") * F.col("l_linenumber")
    return t.lineitem.select("l_linenumber", "l_quantity", S.points_to_mm(pt).alias("mm")).distinct()


@query("q_h08_rotation_shape", """SELECT rotation, width_pt, height_pt, width_pt > height_pt AS landscape, count(*) AS pages FROM (
    SELECT rot AS rotation, CASE WHEN rot IN (90, 270) THEN height_pt ELSE width_pt END AS width_pt, CASE WHEN rot IN (90, 270) THEN width_pt ELSE height_pt END AS height_pt
    FROM (SELECT *, ((rotation - 720) % 360 + 360) % 360 AS rot FROM file_pages)) GROUP BY ALL""")
def _(t):
    d = t.file_pages.withColumn("rotation", F.col("rotation") - 720)
    return pages.shapes(d).groupBy("rotation", "width_pt", "height_pt", "landscape").agg(F.count("*").alias("pages"))


@query("q_h09_word_placement", """SELECT doc_id, cast(sum(floor(x * 1000)) AS bigint) AS sx, cast(sum(floor(y * 1000)) AS bigint) AS sy, cast(sum(floor(stretch * 1000)) AS bigint) AS st,
    count(*) FILTER (direction = '0 1 -1 0') AS upright FROM (SELECT doc_id,
      CASE r WHEN 1 THEN y1 / 2.0 WHEN 2 THEN 595.0 - x0 / 2.0 WHEN 3 THEN 595.0 - y1 / 2.0 ELSE x0 / 2.0 END AS x,
      CASE r WHEN 1 THEN x0 / 2.0 WHEN 2 THEN y1 / 2.0 WHEN 3 THEN 842.0 - x0 / 2.0 ELSE 842.0 - y1 / 2.0 END AS y,
      CASE WHEN (y1 - y0) / 2.0 * 0.5 * length(word) > 0 THEN greatest(1.0, least(1000.0, (x1 - x0) / 2.0 / ((y1 - y0) / 2.0 * 0.5 * length(word)) * 100.0)) ELSE 100.0 END AS stretch,
      CASE r WHEN 1 THEN '0 1 -1 0' WHEN 2 THEN '-1 0 0 -1' WHEN 3 THEN '0 -1 1 0' ELSE '1 0 0 1' END AS direction
      FROM (SELECT *, page_index % 4 AS r FROM words WHERE trim(word) <> '' AND x1 > x0 AND y1 > y0)) GROUP BY doc_id""")
def _(t):
    w = ocr.usable_words(t.words).select("doc_id", ocr.place_word(2.0, F.lit(595.0), F.lit(842.0), F.col("page_index") * 90).alias("p"))
    thousandths = lambda c: F.sum(F.floor(F.col(c) * 1000)).cast("long")
    return w.groupBy("doc_id").agg(thousandths("p.at.x").alias("sx"), thousandths("p.at.y").alias("sy"), thousandths("p.stretch").alias("st"),
                                   F.count_if(F.col("p.direction") == "0 1 -1 0").alias("upright"))


@query("q_h10_fit_to_page", f"""SELECT doc_id, image_key, {r6('s')} AS scale, {r6('(595.0 - w * s) / 2')} AS x, {r6('(842.0 - h * s) / 2')} AS y FROM (
    SELECT doc_id, image_key, width::double AS w, height::double AS h, least((595.0::double - 48.0) / width, (842.0::double - 48.0) / height, 1.0) AS s FROM images WHERE width > 0)""")
def _(t):
    r = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long")
    d = t.images.where("width > 0").select("doc_id", "image_key", S.fit_to_page(F.col("width").cast("double"), F.col("height").cast("double"), 595.0, 842.0).alias("f"))
    return d.select("doc_id", "image_key", r("f.scale").alias("scale"), r("f.x").alias("x"), r("f.y").alias("y"))


@query("q_h11_drawn_dpi", f"SELECT doc_id, image_key, page_index, a, CASE WHEN a - 16 > 0.01 THEN {r6('600.0::double / (a - 16) * 72.0')} END AS dpi FROM placements")
def _(t):
    dpi = S.drawn_dpi(F.lit(600.0), F.col("a") - 16)
    return t.placements.select("doc_id", "image_key", "page_index", "a", F.floor(dpi * 1e6 + 0.5).cast("long").alias("dpi"))


TYPED = ["5", "4,5", " 2.5 ", "abc", "-1", "0", "1,2,3", ""]


@query("q_h12_parse_target", f"""SELECT p_partkey, typed, unit, CASE WHEN n > 0 THEN cast(floor(n * CASE unit WHEN 'KB' THEN 1024 ELSE 1048576 END) AS bigint) END AS bytes FROM (
    SELECT *, try_cast(regexp_replace(trim(typed), ',', '.') AS double) AS n FROM (SELECT p_partkey,
    CASE WHEN p_partkey % 9 = 8 THEN p_retailprice::decimal(18,2)::varchar ELSE CASE p_partkey % 9 {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(TYPED))} END END AS typed,
    CASE WHEN p_size % 2 = 0 THEN 'KB' ELSE 'MB' END AS unit FROM part))""")
def _(t):
    k = F.col("p_partkey") % 9
    typed = F.when(k == 8, F.col("p_retailprice").cast("decimal(18,2)").cast("string")).otherwise(choose(k, TYPED))
    d = t.part.select("p_partkey", typed.alias("typed"), F.when(F.col("p_size") % 2 == 0, "KB").otherwise("MB").alias("unit"))
    return d.withColumn("bytes", S.parse_target("typed", "unit"))


@query("q_h13_normalise", f"SELECT page_id, length(n) AS chars, md5(n) AS digest FROM (SELECT page_id, {normalise('html')} AS n FROM pages)")
def _(t):
    n = audit.normalise("html")
    return t.pages.select("page_id", n.alias("n")).select("page_id", F.length("n").cast("long").alias("chars"), F.md5("n").alias("digest"))


@query("q_h14_extractors", f"""SELECT page_id, {TITLE} AS title, md5({BODY}) AS body, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description, regexp_extract(html, '<meta name="build" content="([0-9a-f]+)"', 1) AS build FROM pages""")
def _(t):
    return t.pages.select("page_id", audit.title_of("html").alias("title"), F.md5(audit.body_of("html")).alias("body"),
                          F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"),
                          audit.meta_of("html", "description").alias("description"), audit.build_of("html", "build").alias("build"))


@query("q_h15_template_match", f"""WITH s AS (SELECT page_id, trim({normalise(TITLE)}) AS title, page_id % 30 AS k FROM pages)
    SELECT page_id, CASE WHEN n_nationkey IS NULL THEN false WHEN k % 5 = 0 THEN regexp_full_match(title, '.+?[.]') WHEN k % 5 = 1 THEN starts_with(title, substr(n_name, 1, 1)) AND length(title) > 1
      WHEN k % 5 = 2 THEN regexp_full_match(title, '.+? the .+?') WHEN k % 5 = 3 THEN regexp_full_match(title, 'T.+?e.+?') ELSE title = n_name END AS matches FROM s LEFT JOIN nation ON n_nationkey = k""")
def _(t):
    """Titles against the templates of another table, one per section; some sections have none."""
    letter = F.substring("n_name", 1, 1)
    k = F.col("n_nationkey") % 5
    source = (F.when(k == 0, "{{rest}}.").when(k == 1, F.concat(letter, F.lit("{{rest}}"))).when(k == 2, "{{a}} the {{b}}").when(k == 3, "T{{a}}e{{b}}").otherwise(F.col("n_name")))
    sources = t.nation.select(F.col("n_nationkey").cast("long").alias("section"), source.alias("source"))
    served = t.pages.select("page_id", (F.col("page_id") % 30).alias("section"), audit.title_of("html").alias("text"))
    return audit.matches_source(served, sources, "section").select("page_id", "matches")


@query("q_h16_slug", rf"SELECT page_id, regexp_replace(trim(regexp_replace(lower({TITLE}), '[^\w\s-]', '', 'g')), '\s', '-', 'g') AS slug FROM pages")
def _(t):
    return t.pages.select("page_id", S.slug(audit.title_of("html")).alias("slug"))


@query("q_h17_content_sha", "SELECT page_id, left(sha256(replace(html, chr(13) || chr(10), chr(10))), 16) AS sha FROM pages")
def _(t):
    return t.pages.select("page_id", S.content_sha("html").alias("sha"))


@query("q_h18_page_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', E'. \n\n\n\n '), '[ \t]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def _(t):
    spaced = F.replace("text", F.lit(". "), F.lit(". \n\n\n\n "))
    return t.documents.select("doc_id", F.md5(ocr.page_text(spaced)).alias("digest"))


@query("q_h19_body_bytes", "SELECT doc_id, strlen(text) AS bytes FROM documents")
def _(t):
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("q_h20_size_against", f"""SELECT file_id, CASE WHEN {error_bytes('size')} = '60.0 MB' THEN 'fractionally over 60.0 MB' ELSE {error_bytes('size')} END AS shown FROM files WHERE size > 62914560""")
def _(t):
    return t.files.where(F.col("size") > rules.CEILING_BYTES).select("file_id", S.size_against("size", rules.CEILING_BYTES).alias("shown"))


@query("q_h21_run_label", "SELECT event_id, 'batch-' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.zip' AS label FROM events")
def _(t):
    return t.events.select("event_id", S.run_label("batch", "ts").alias("label"))


@query("q_h22_base64url", "SELECT c_custkey, rtrim(translate(base64(encode(c_name || '?>~~' || c_mktsegment)), '+/', '-_'), '=') AS coded, c_name || '?>~~' || c_mktsegment AS back FROM customer")
def _(t):
    d = t.customer.select("c_custkey", F.concat("c_name", F.lit("?>~~"), "c_mktsegment").alias("p"))
    d = d.select("c_custkey", S.base64url(F.encode("p", "UTF-8")).alias("coded"))
    return d.withColumn("back", F.decode(S.from_base64url("coded"), "UTF-8"))


@query("q_h24_url_parts", r"""SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def _(t):
    p = rules.url_parts("url")
    return t.pages.select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"))


@query("q_h25_email_key", "SELECT event_id, nullif(lower(trim(email)), '') AS email, nullif(trim(profession), '') AS profession FROM survey")
def _(t):
    return t.survey.select("event_id", S.email_key("email").alias("email"), S.text_or_null("profession").alias("profession"))


REFERENCE = "'txn_' || CASE WHEN event_id % 20 = 0 THEN upper(substr(md5('a' || event_id), 1, 26)) WHEN event_id % 21 = 0 THEN substr(md5('a' || event_id), 1, 25) ELSE substr(md5('a' || event_id), 1, 26) END"


@query("q_h26_reference_shape", f"SELECT event_id, regexp_full_match({REFERENCE}, 'txn_[a-z0-9]{{26}}') AS well_formed FROM events")
def _(t):
    digest = F.md5(F.concat(F.lit("a"), F.col("event_id").cast("string")).cast("binary"))
    ref = F.concat(F.lit("txn_"), F.when(F.col("event_id") % 20 == 0, F.upper(F.substring(digest, 1, 26)))
                   .when(F.col("event_id") % 21 == 0, F.substring(digest, 1, 25)).otherwise(F.substring(digest, 1, 26)))
    return t.events.select("event_id", S.is_transaction_reference(ref).alias("well_formed"))
