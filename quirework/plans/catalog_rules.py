"""Projections, filters and rule chains (§B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, images, ocr, purchases, rules, survey
from ..session import cut_lineage
from .catalog_sources import OWN
from .facts import choose
from .registry import query
from .sqltext import TITLE, js_round, r6

SNIFF = """CASE WHEN head_hex LIKE '25504446%' THEN 'application/pdf' WHEN head_hex LIKE '504B0304%' THEN 'zip' WHEN head_hex LIKE 'D0CF11E0%' THEN 'ole'
  WHEN head_hex LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN head_hex LIKE '89504E47%' THEN 'image/png' WHEN head_hex LIKE '47494638%' THEN 'image/gif'
  WHEN head_hex LIKE '52494646%' AND substr(head_hex, 17, 8) = '57454250' THEN 'image/webp' WHEN head_hex LIKE '7B%' THEN 'text' END"""


@query("q_b01_sniff", f"SELECT file_id, {SNIFF} AS container FROM files")
def _(t):
    return t.files.select("file_id", rules.sniff("head").alias("container"))


@query("q_b02_container_name", f"""SELECT file_id, CASE WHEN c = 'zip' THEN CASE ext WHEN 'docx' THEN 'a Word document' WHEN 'xlsx' THEN 'a Excel workbook' WHEN 'odt' THEN 'an OpenDocument file'
    WHEN 'epub' THEN 'an EPUB book' ELSE 'a ZIP archive' END WHEN c = 'ole' THEN CASE ext WHEN 'doc' THEN 'an older Word document' WHEN 'xls' THEN 'an older Excel workbook' ELSE 'an old Microsoft Office file' END
    WHEN c LIKE 'image/%' THEN 'a ' || upper(substr(c, 7)) || ' image' ELSE 'a .' || ext || ' file' END AS what
    FROM (SELECT file_id, {SNIFF} AS c, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM files)""")
def _(t):
    return t.files.select("file_id", rules.container_name(rules.sniff("head"), "name").alias("what"))


@query("q_b03_intake", f"SELECT file_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 62914560 THEN 'too-big' WHEN coalesce({SNIFF}, '') <> 'application/pdf' THEN 'not-pdf' END AS refused FROM files")
def _(t):
    return t.files.select("file_id", rules.intake("size", "head").alias("refused"))


@query("q_b04_classify_error", """SELECT file_id, CASE WHEN error_name = 'PasswordException' THEN CASE WHEN error_code = 2 THEN 'wrong-password' ELSE 'locked' END
    WHEN error_name = 'InvalidPDFException' THEN 'damaged' WHEN error_name IN ('RangeError', 'QuotaExceededError') THEN 'out-of-memory'
    WHEN contains(error_message, 'is encrypted') THEN 'locked' WHEN contains(error_message, 'No PDF header') THEN 'not-pdf'
    WHEN regexp_matches(error_message, 'Failed to parse PDF document|Expected instance of PDFDict|Unbalanced parenthesis|Expected object number|stalled') THEN 'damaged' ELSE 'unknown' END AS kind FROM files""")
def _(t):
    return t.files.select("file_id", rules.classify_error(F.col("error_name"), F.col("error_code"), F.col("error_message")).alias("kind"))


@query("q_b05_survey_verdict", "SELECT event_id, verdict FROM survey_checked")
def _(t):
    return t.survey.select("event_id", survey.verdict().alias("verdict"))


def decisions(t):
    return purchases.decide(purchases.parse_events(t.deliveries), "pri_pro")


@query("q_b06_decide", "SELECT event_id, action, reason, uid, email FROM decisions")
def _(t):
    return decisions(t).select("event_id", "action", "reason", "uid", "email")


@query("q_b07_item_before_header", """SELECT event_id, item_type, CASE WHEN item_type = 'full' THEN 'revoke' WHEN item_type IS NOT NULL OR kind = 'partial' THEN 'ignore' ELSE 'revoke' END AS action
    FROM purchase_fields WHERE action = 'refund' AND status = 'approved' AND NOT broken AND has_time AND txn IS NOT NULL""")
def _(t):
    p = purchases.parse_events(t.deliveries)
    refund = p.where("parsed and e.data.action = 'refund' and e.data.status = 'approved' and try_to_timestamp(e.occurred_at) is not null and trim(e.data.transaction_id) <> ''")
    item = refund.select("event_id", F.try_element_at("e.data.items", F.lit(1))["type"].alias("item_type"))
    return purchases.decide(refund, "pri_pro").select("event_id", "action").join(item, "event_id")


SECRET = "fixture-secret"


def signed_deliveries(t):
    """Signed deliveries, some of them wrongly on purpose. The tests hold the signature against another implementation."""
    i = F.col("event_id")
    d = t.deliveries.select("event_id", "raw", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sent"))
    signed = F.concat(F.col("sent").cast("string"), F.lit(":"), F.col("raw"))
    d = d.withColumn("h1", F.when(i % 15 == 0, purchases.hmac_sha256("other-secret", signed)).otherwise(purchases.hmac_sha256(SECRET, signed)))
    h1 = F.concat(F.when(i % 4 == 0, F.lit("h1=deadbeef;")).otherwise(F.lit("")), F.lit("h1="), F.upper("h1"))
    header = F.when(i % 18 == 0, F.lit(None)).when(i % 19 == 0, h1).otherwise(F.concat(F.lit("ts="), "sent", F.lit(";"), h1))
    return d.select("event_id", F.when(i % 16 == 0, F.concat("raw", F.lit(" "))).otherwise(F.col("raw")).alias("body"), header.alias("header"),
                    (F.col("sent") + F.when(i % 17 == 0, 6).otherwise(i % 6)).alias("received_at"))


@query("q_b08_signature", """SELECT event_id, CASE WHEN event_id % 18 = 0 OR event_id % 19 = 0 THEN 'malformed-signature-header' WHEN event_id % 17 = 0 THEN 'timestamp-outside-tolerance'
    WHEN event_id % 15 = 0 OR event_id % 16 = 0 THEN 'signature-mismatch' ELSE 'ok' END AS verdict FROM events""")
def _(t):
    return signed_deliveries(t).select("event_id", purchases.signature_verdict("body", "header", SECRET, "received_at").alias("verdict"))


ROLLED = """rolled AS (SELECT doc_id, image_key, max(sqrt(a * a + b * b)) AS width_pt, max(sqrt(c * c + d * d)) AS height_pt, count(*) AS uses FROM placements GROUP BY 1, 2),
 placed AS (SELECT i.*, width_pt, height_pt, uses, CASE WHEN width_pt > 0.01 THEN width / width_pt * 72.0 END AS dpi, m.doc_id IS NOT NULL AS is_soft_mask
   FROM images i LEFT JOIN rolled r ON i.doc_id = r.doc_id AND i.image_key = r.image_key LEFT JOIN masks m ON i.doc_id = m.doc_id AND i.image_key = m.image_key),
 judged AS (SELECT *, CASE WHEN is_mask OR bpc = 1 THEN 'a 1-bit stencil — JPEG would make it larger, not smaller'
   WHEN is_soft_mask THEN 'a transparency mask — recompressing it would fringe the edges it masks' WHEN width = 0 OR height = 0 THEN 'has no usable dimensions'
   WHEN width * height < 8000 THEN 'smaller than 8,000 pixels — already negligible' WHEN uses IS NULL THEN 'never drawn on any page'
   WHEN len(filters) = 1 AND filters[1] IN ('JBIG2Decode', 'CCITTFaxDecode') THEN filters[1] || ' bilevel scan — already far denser than JPEG could manage'
   WHEN len(filters) = 1 AND filters[1] = 'JPXDecode' THEN 'JPEG 2000 — this page ships no JPEG 2000 decoder'
   WHEN len(filters) = 1 AND filters[1] = 'ASCII85Decode' THEN 'ASCII85Decode wrapper that could not be read'
   WHEN len(filters) > 1 THEN 'filter chain ' || array_to_string(filters, '+') || ' is not one we rebuild'
   WHEN list_contains(filters, 'DCTDecode') THEN NULL
   WHEN coalesce(color_space, '') NOT IN ('DeviceRGB', 'DeviceGray', 'Indexed', 'ICCBased') THEN coalesce(color_space, 'unknown') || ' colour space we do not convert'
   WHEN bpc <> 8 THEN bpc || '-bit samples we do not unpack' END AS skip_reason FROM placed),
 j AS (SELECT *, skip_reason IS NULL AS recompressible FROM judged)"""


def judged(t, reread: bool = False):
    """Images with their verdict; written once where several parts of a query read it."""
    j = images.judged(t.images, t.placements, t.masks)
    return cut_lineage(j) if reread else j


@query("q_b09_image_eligibility", f"WITH {ROLLED} SELECT doc_id, image_key, recompressible, skip_reason FROM j")
def _(t):
    return judged(t).select("doc_id", "image_key", "recompressible", "skip_reason")


PLAN = "CASE WHEN recompressible AND dpi > 150 THEN CASE WHEN quality > 0 THEN least(quality, 100) / 100.0::double ELSE 0.85::double END END"


@query("q_b10_resolution_plan", f"WITH {ROLLED} SELECT doc_id, image_key, {PLAN} IS NULL AS keep, {r6(PLAN)} AS quality FROM j WHERE recompressible")
def _(t):
    d = images.apply_plan(judged(t).where("recompressible"), images.resolution_plan(150))
    return d.select("doc_id", "image_key", F.col("plan").isNull().alias("keep"), F.floor(F.col("plan.quality") * 1e6 + 0.5).cast("long").alias("quality"))


@query("q_b11_downscale", f"""WITH {ROLLED} SELECT doc_id, image_key, CASE WHEN dpi > 150 THEN greatest(1, {js_round('width * (150 / dpi)')}) END AS target_w,
    CASE WHEN dpi > 150 THEN greatest(1, {js_round('height * (150 / dpi)')}) END AS target_h FROM j WHERE recompressible""")
def _(t):
    return images.apply_plan(judged(t).where("recompressible"), images.resolution_plan(150)).select("doc_id", "image_key", "target_w", "target_h")


# What a second encoding would come to: a stand-in for the encoder's answer, NULL where it cannot read the image.
NEW_BYTES = "CASE WHEN image_key % 17 = 0 THEN NULL ELSE cast(floor(encoded_bytes * (40 + image_key % 70) / 100.0) AS bigint) END"
OUTCOME = f"CASE WHEN {PLAN} IS NULL THEN 'kept' WHEN {NEW_BYTES} IS NULL THEN 'undecodable' WHEN {NEW_BYTES} >= encoded_bytes THEN 'not-smaller' ELSE 'replaced' END"


def with_outcomes(j):
    d = images.apply_plan(j.where("recompressible"), images.resolution_plan(150))
    k = F.col("image_key")
    new = F.when(k % 17 != 0, F.floor(F.col("encoded_bytes") * (F.lit(40) + k % 70) / 100.0).cast("long"))
    return d.withColumn("new_bytes", new).withColumn("outcome", images.outcome(F.col("plan").isNotNull(), F.col("new_bytes"), F.col("encoded_bytes")))


@query("q_b12_keep_improvements", f"WITH {ROLLED} SELECT doc_id, image_key, {OUTCOME} AS outcome FROM j WHERE recompressible")
def _(t):
    return with_outcomes(judged(t)).select("doc_id", "image_key", "outcome")


@query("q_b13_worth_it", """SELECT o_orderkey, before - after > 0 AND (before - after) / before::double >= 0.03 AS worth_showing,
    before - after > 0 AND (before - after) / before::double >= 0.03 AND before - after >= 51200 AS worth_it
    FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) + 1 AS before, cast(floor(o_totalprice * (80 + o_orderkey % 25) / 100.0) AS bigint) + 1 AS after FROM orders)""")
def _(t):
    before = F.floor("o_totalprice").cast("long") + 1
    after = F.floor(F.col("o_totalprice") * (F.lit(80) + F.col("o_orderkey") % 25) / 100.0).cast("long") + 1
    return t.orders.select("o_orderkey", images.worth_showing(before, after).alias("worth_showing"), images.worth_it(before, after).alias("worth_it"))


@query("q_b14_harder_lever", f"""WITH {ROLLED}, m AS (SELECT doc_id, list_sort(list(dpi) FILTER (recompressible AND dpi IS NOT NULL)) AS ds,
      list_sort(list(quality) FILTER (recompressible AND quality IS NOT NULL AND filters = ['DCTDecode'])) AS qs, image_key % 8 AS slice FROM j GROUP BY doc_id, slice)
    SELECT doc_id, slice, CASE WHEN (q IS NULL OR q > 42) AND (d IS NULL OR d > 72) THEN 'both' WHEN q IS NULL OR q > 42 THEN 'quality' WHEN d IS NULL OR d > 72 THEN 'dpi' ELSE 'none' END AS lever
    FROM (SELECT doc_id, slice, ds[len(ds) // 2 + 1] AS d, qs[len(qs) // 2 + 1] AS q FROM m)""")
def _(t):
    keys = ["doc_id", "slice"]
    j = judged(t, reread=True).withColumn("slice", F.col("image_key") % 8)
    m = j.select(*keys).distinct().join(images.medians(j, keys), keys, "left")
    return m.select(*keys, images.harder_lever(F.col("median_quality"), F.col("median_dpi")).alias("lever"))


@query("q_b15_usable_words", "SELECT doc_id, count(*) AS words FROM words WHERE trim(word) <> '' AND x1 > x0 AND y1 > y0 GROUP BY 1")
def _(t):
    return ocr.usable_words(t.words).groupBy("doc_id").agg(F.count("*").alias("words"))


@query("q_b16_page_has_text", r"SELECT doc_id, page_index, list_sum(list_transform(string_split(text, E'\n'), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')))) > 12 AS has_text FROM doc_pages")
def _(t):
    return t.doc_pages.select("doc_id", "page_index", ocr.has_text(F.split("text", "\n")).alias("has_text"))


RECOGNISED = """to_read AS (SELECT doc_id, page_index FROM doc_pages EXCEPT SELECT doc_id, page_index FROM layer_pages),
 kept AS (SELECT doc_id, page_index, count(*) AS n, sum(confidence) AS total FROM words WHERE word <> '' GROUP BY 1, 2),
 ocr AS (SELECT r.doc_id, r.page_index, coalesce(n, 0) AS words, CASE WHEN n > 0 THEN total::double / n ELSE 0.0::double END AS confidence, 'ocr' AS source FROM to_read r LEFT JOIN kept k ON r.doc_id = k.doc_id AND r.page_index = k.page_index),
 res AS (SELECT *, CASE WHEN words = 0 THEN 'no-text' WHEN confidence < 55 THEN 'low-confidence' END AS skipped FROM ocr
   UNION ALL SELECT doc_id, page_index, 0, 100.0::double, 'layer', CASE WHEN regexp_full_match(text, '\\s*') THEN 'no-text' END FROM layer_pages)"""


def recognised(t):
    return ocr.recognised_pages(t.words, ocr.pages_to_read(t.doc_page_index, t.layer_pages))


@query("q_b17_skip_reason", f"WITH {RECOGNISED} SELECT doc_id, page_index, skipped FROM res WHERE source = 'ocr'")
def _(t):
    return recognised(t).select("doc_id", "page_index", "skipped")


@query("q_b18_third_party", f"SELECT page_id, split_part(url, '://', 1) || '://' || regexp_extract(url, '://([^/?#]+)', 1) <> '{OWN}' AS third_party FROM pages")
def _(t):
    return t.pages.select("page_id", rules.is_third_party("url", OWN).alias("third_party"))


@query("q_b19_freshness", """SELECT event_id, ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 MINUTE AS handoff, ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 60 SECOND AS pending FROM events""")
def _(t):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", rules.is_fresh("ts", now, "10 minutes").alias("handoff"),
                           (rules.is_fresh("ts", now, "24 hours", "60 seconds") & (F.col("ts") != now - F.expr("INTERVAL 24 hours"))).alias("pending"))


MIXED = ["MIT AND Custom-1.0", "Custom-1.0 OR Other-2.0", "(GPL-3.0 OR MIT)", "(Custom-1.0 or Apache-2.0)", "UNKNOWN", "LGPL-2.1", "MIT", "Custom-1.0"]


@query("q_b20_licence_gate", f"""SELECT name, CASE WHEN regexp_matches(licence, '(^|[^A-Za-z])A?GPL') THEN 'forbidden' WHEN licence IN ('MIT', 'Apache-2.0', 'BSD-3-Clause') THEN 'allowed' ELSE 'unclear' END AS verdict FROM packages
    UNION ALL SELECT 'mixed-' || p_partkey, ['allowed', 'unclear', 'forbidden', 'allowed', 'unclear', 'unclear', 'allowed', 'unclear'][p_partkey % 8 + 1] FROM part""")
def _(t):
    """Single licences and expressions of several, some of them known in part."""
    mixed = t.part.select(F.concat(F.lit("mixed-"), "p_partkey").alias("name"), choose(F.col("p_partkey") % 8, MIXED).alias("licence"))
    return t.packages.select("name", "licence").unionByName(mixed).select("name", rules.licence_verdict("licence").alias("verdict"))


GOOD_TITLE, GOOD_DESCRIPTION = "A title of fitting length", "A description that is neither too short nor too long for a result list."
HEADS = [f'<title>{GOOD_TITLE}</title><meta name="description" content="{GOOD_DESCRIPTION}"><link rel="canonical" href="/"><meta property="og:title" content="x">',
         f'<title>Too short</title><meta name="description" content="{GOOD_DESCRIPTION}"><link rel="canonical" href="/"><meta property="og:title" content="x">',
         f'<title>{GOOD_TITLE}</title><meta name="description" content="Too short."><link rel="canonical" href="/"><meta property="og:title" content="x">',
         f'<title>{GOOD_TITLE}</title><meta name="description" content="{GOOD_DESCRIPTION}"><meta property="og:title" content="x">',
         f'<title>{GOOD_TITLE}</title><meta name="description" content="{GOOD_DESCRIPTION}"><link rel="canonical" href="/">', ""]


@query("q_b21_metadata_audit", f"""WITH p AS (SELECT page_id, {HEADS}[page_id % 6 + 1] || html AS html FROM pages),
    m AS (SELECT page_id, length({TITLE}) AS title_chars, length(regexp_extract(html, 'name="description" content="([^"]*)"', 1)) AS description_chars,
      contains(html, 'rel="canonical"') AS canonical, contains(html, 'property="og:title"') AS og, {js_round('strlen(html) / 1024.0::double')} AS kb FROM p)
    SELECT *, NOT (title_chars BETWEEN 15 AND 70 AND description_chars BETWEEN 50 AND 165 AND canonical AND og) AS flagged FROM m""")
def _(t):
    """A sixth of the pages carries all it should; the others each lack something."""
    return audit.metadata_audit(t.pages.withColumn("html", F.concat(choose(F.col("page_id") % 6, HEADS), F.col("html"))))


@query("q_b22_invariants", r"""SELECT page_id, unnest(list_filter(['missing a skip link', CASE WHEN NOT regexp_matches(html, '<main[^>]*id="main"') THEN 'missing a main landmark' END,
    CASE WHEN NOT contains(html, '<h1') THEN 'missing exactly one h1' END, 'missing a net readout', 'missing the instrumentation bundle',
    CASE WHEN len(regexp_extract_all(html, '<h1')) <> 1 THEN len(regexp_extract_all(html, '<h1')) || ' h1 elements' END,
    CASE WHEN regexp_matches(html, '(?i)\son(click|load|error|submit|change)=') THEN 'inline event handler' END], lambda x: x IS NOT NULL)) AS problem FROM pages""")
def _(t):
    return audit.invariant_problems(t.pages)


DATA = '<script type="application/ld+json">'
TAGS = ['<script src="/assets/net-ABCD1234.js"></script>', '<script defer src="https://cdn.example.net/x.js"></script><script src="/assets/own.js"></script>',
        '<script src="/assets/deep/own.js"></script><script>', ""]


@query("q_b23_foreign_scripts", """SELECT page_id, unnest(CASE page_id % 4 WHEN 1 THEN ['https://cdn.example.net/x.js'] WHEN 2 THEN ['/assets/deep/own.js', 'inline script'] WHEN 3 THEN CASE WHEN contains(html, '<script>') THEN ['inline script'] ELSE [] END ELSE [] END) AS script FROM pages""")
def _(t):
    """Own scripts and structured data pass; foreign ones and code inside the page do not."""
    k = F.col("page_id") % 4
    html = F.when(k < 3, F.concat(choose(k, TAGS), F.replace("html", F.lit("<script>"), F.lit(DATA)))).otherwise(F.col("html"))
    return audit.foreign_scripts(t.pages.withColumn("html", html))


CLAIM, NEGATED = r"\b(this|that|will|qui|der|la)\b", r"\b(not|never|nothing|no)\b"


@query("q_b24_claims_without_negation", rf"""SELECT doc_id, count(*) AS claims FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
    WHERE regexp_matches(s, '{CLAIM}') AND NOT regexp_matches(s, '{NEGATED}') GROUP BY 1""")
def _(t):
    return audit.claiming_sentences(t.documents, "doc_id", "text", rules.whole_word("this|that|will|qui|der|la")).groupBy("doc_id").agg(F.count("*").alias("claims"))


@query("q_b25_request_guard", f"""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'method-not-allowed' WHEN event_id % 4 <> 0 AND split_part(url, '://', 1) || '://' || host <> '{OWN}' THEN 'cross-origin'
    WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'bad-content-type' END AS refused FROM requests""")
def _(t):
    i = F.col("event_id")
    p = rules.url_parts("url")
    origin = F.when(i % 4 != 0, F.concat(p["scheme"], F.lit("://"), p["host"]))
    kind = F.when(i % 5 == 0, F.lit("text/plain")).when(i % 7 != 0, F.lit("application/json; charset=utf-8"))
    method = F.when(i % 6 == 0, F.lit("GET")).otherwise(F.lit("POST"))
    return t.requests.select("event_id", survey.guard(method, origin, F.lit(OWN), kind).alias("refused"))


@query("q_b26_claim_guard", """SELECT doc_id, doc_id % 50 = 0 AND n_pages > 1 AS claims_a_file FROM (SELECT doc_id, count(*) AS n_pages FROM doc_pages GROUP BY 1)""")
def _(t):
    per = t.doc_page_index.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    tail = F.when((F.col("doc_id") % 50 == 0) & (F.col("n_pages") > 1), F.lit(" A Searchable copy was kept.")).otherwise(F.lit(" Unsearchable pages stay."))
    said = F.concat(F.lit("Text read from "), F.col("n_pages"), F.lit(" pages."), tail)
    return per.select("doc_id", said.rlike(ocr.CLAIMS_A_FILE).alias("claims_a_file"))


TOKENS = [("script", "track("), ("script", "</article>"), ("page", "</article>"), ("page", 'lang="de"'), ("script", "eval(")]


@query("q_b27_scoped_tokens", """SELECT page_id, 'script' AS scope, 'track(' AS token FROM pages WHERE contains(array_to_string(regexp_extract_all(html, '<script[^>]*>([\\s\\S]*?)</script>', 1), ''), 'track(')
    UNION ALL SELECT page_id, 'page', '</article>' FROM pages WHERE contains(html, '</article>') UNION ALL SELECT page_id, 'page', 'lang="de"' FROM pages WHERE contains(html, 'lang="de"')""")
def _(t):
    return audit.scoped_hits(t.pages, TOKENS)


@query("q_b28_fact_consistency", r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS said, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS served,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) = regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS agree FROM pages""")
def _(t):
    said, served = F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.regexp_extract("url", r"://[^/]+/([a-z]+)", 1)
    return t.pages.select("page_id", said.alias("said"), served.alias("served"), (said == served).alias("agree"))


@query("q_b28_payload_fields", "SELECT event_id, NOT broken AND uid IS NOT NULL AS exact FROM purchase_fields WHERE event_type = 'transaction.completed'")
def _(t):
    keys = F.array_sort(F.json_object_keys(F.get_json_object("raw", "$.data.custom_data")))
    sales = t.purchase_fields.where("event_type = 'transaction.completed'").select("event_id")
    return t.deliveries.join(sales, "event_id", "left_semi").select("event_id", F.coalesce(keys == F.array(F.lit("email"), F.lit("uid")), F.lit(False)).alias("exact"))


@query("q_b29_required_fields", """SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 10 = 0 THEN 'title' END, CASE WHEN length(cast(floor(s_acctbal) AS bigint)::varchar) < 3 THEN 'body' END) AS absent
    FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    title = F.when(k % 10 == 0, F.lit(None)).when(k % 9 == 0, F.lit("  ")).otherwise(F.col("s_name"))
    d = t.supplier.select("s_suppkey", title.alias("title"), F.floor("s_acctbal").cast("string").alias("body"))
    return d.select("s_suppkey", audit.missing_fields(["title", "body"]).alias("absent"))
