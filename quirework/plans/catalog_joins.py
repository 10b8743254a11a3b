"""Joins (§C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, graphs, images, ocr, ordered, pages, purchases, runs
from .catalog_rules import RECOGNISED, ROLLED, decisions, recognised  # noqa: F401
from .catalog_sources import SNAP, snapshot_sides
from .facts import choose
from .registry import query
from .sqltext import TITLE, r6

KEPT = "kept AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS new_index FROM outline_pages WHERE page_index % 5 <> 3)"


def outline_page_map(t):
    return pages.reorder_plan(t.outline_pages, "page_index", F.col("page_index") % 5 == 3).select("doc_id", "page_index", "new_index")


@query("q_c01_remap_outline", f"WITH {KEPT} SELECT o.doc_id, node_id, o.page_index AS old_index, new_index FROM outline o LEFT JOIN kept k ON o.doc_id = k.doc_id AND o.page_index = k.page_index")
def _(t):
    d = pages.remap_outline(t.outline, outline_page_map(t))
    return d.select("doc_id", "node_id", F.col("page_index").alias("old_index"), "new_index")


@query("q_c02_destinations", """SELECT o.doc_id, node_id, CASE node_id % 4 WHEN 0 THEN CASE WHEN o.role <> 'system' THEN node_id END
    WHEN 1 THEN CASE WHEN node_id + 1 < page_count THEN node_id + 1 END WHEN 2 THEN CASE WHEN node_id * 3 - 4 BETWEEN 0 AND page_count - 1 THEN node_id * 3 - 4 END END AS page_index
    FROM outline o JOIN outline_docs d ON o.doc_id = d.doc_id""")
def _(t):
    n = F.col("node_id")
    dests = t.outline.select("doc_id", "node_id", F.when(n % 4 == 0, F.concat(F.lit("dest-"), n)).alias("dest_name"),
                             F.when(n % 4 == 1, F.concat(F.lit("ref-"), n + 1)).alias("dest_ref"), F.when(n % 4 == 2, n * 3 - 4).alias("dest_number"))
    named = t.outline.where("role <> 'system'").select("doc_id", F.concat(F.lit("dest-"), n).alias("name"), n.alias("page_index"))
    refs = t.outline_pages.select("doc_id", "page_index", F.concat(F.lit("ref-"), "page_index").alias("page_ref"))
    return pages.resolve_destinations(dests, named, refs, t.outline_docs).select("doc_id", "node_id", "page_index")


@query("q_c03_image_placement", f"WITH {ROLLED} SELECT doc_id, image_key, uses, {r6('width_pt')} AS width_pt, {r6('dpi')} AS dpi FROM placed")
def _(t):
    r = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)
    return images.placed_images(t.images, t.placements, t.masks).select("doc_id", "image_key", "uses", r("width_pt"), r("dpi"))


@query("q_c04_used_as_mask", "SELECT doc_id, image_key FROM images SEMI JOIN masks USING (doc_id, image_key)")
def _(t):
    return t.images.join(t.masks, ["doc_id", "image_key"], "left_semi").select("doc_id", "image_key")


def routes(t):
    """Declared routes: the pages a plan knew of, some with an older title, and some never built."""
    k = F.col("page_id")
    known = t.pages.where(~F.contains("url", F.lit("#"))).select(F.concat(F.lit("/p"), k).alias("route"), F.when(k % 7 == 0, F.lit("Old title")).otherwise(audit.title_of("html")).alias("want_title"))
    return known.unionByName(t.nation.select(F.concat(F.lit("/n"), "n_nationkey").alias("route"), F.col("n_name").alias("want_title")))


@query("q_c05_routes_reconcile", f"""WITH r AS (SELECT '/p' || page_id AS route, CASE WHEN page_id % 7 = 0 THEN 'Old title' ELSE {TITLE} END AS want FROM pages WHERE NOT contains(url, '#') UNION ALL SELECT '/n' || n_nationkey, n_name FROM nation),
    s AS (SELECT '/p' || page_id AS route, {TITLE} AS got, contains(html, 'noindex') AS noindex FROM pages)
    SELECT coalesce(r.route, s.route) AS route, concat_ws('; ', CASE WHEN s.route IS NULL THEN 'not served' END, CASE WHEN r.route IS NULL THEN 'not declared' END, CASE WHEN want <> got THEN 'title differs' END,
      CASE WHEN noindex THEN 'noindex' END) AS problems FROM r FULL JOIN s ON r.route = s.route""")
def _(t):
    served = t.pages.select(F.concat(F.lit("/p"), "page_id").alias("route"), audit.title_of("html").alias("title"), F.contains("html", F.lit("noindex")).alias("noindex"))
    d = routes(t).withColumn("_d", F.lit(True)).join(served.withColumn("_s", F.lit(True)), "route", "full")
    rules = F.array(F.when(F.col("_s").isNull(), "not served"), F.when(F.col("_d").isNull(), "not declared"),
                    F.when(F.col("want_title") != F.col("title"), "title differs"), F.when(F.col("noindex"), "noindex"))
    return d.select("route", F.array_join(F.array_compact(rules), "; ").alias("problems"))


def phrases(t):
    return t.benchmark.select(F.col("item_id").alias("phrase_id"), audit.folded("text").alias("phrase"))


FOLD = r"regexp_replace(lower({}), '\s+', ' ', 'g')"
HITS = f"hits AS (SELECT doc_id, item_id AS phrase_id FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents) JOIN (SELECT item_id, {FOLD.format('text')} AS p FROM benchmark) ON contains(t, p))"
META_PHRASES = ["the and", "en", "er ", "der"]


def document_hits(t, fits=None):
    return audit.phrase_hits(t.documents.select("doc_id", audit.folded("text").alias("text")), "doc_id", phrases(t), fits)


@query("q_c06_phrase_hits_body", f"WITH {HITS} SELECT * FROM hits")
def _(t):
    return document_hits(t)


@query("q_c06_phrase_hits_anchor_join", f"WITH {HITS} SELECT * FROM hits")
def _(t):
    """The path for a phrase list too large to broadcast."""
    return document_hits(t, fits=False)


@query("q_c06_phrase_hits_metadata", f"""SELECT page_id, i AS phrase_id FROM pages, (SELECT unnest(['the and', 'en', 'er ', 'der']) AS p, unnest([0, 1, 2, 3])::bigint AS i)
    WHERE contains(lower({TITLE} || ' ' || regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) || ' ' || regexp_extract(html, '<meta name="twitter:description" content="([^"]*)"', 1)), p)""")
def _(t):
    meta = F.lower(F.concat(audit.title_of("html"), F.lit(" "), audit.meta_of("html", "description"), F.lit(" "), audit.meta_of("html", "twitter:description")))
    rules = t.spark.createDataFrame(list(enumerate(META_PHRASES)), "phrase_id long, phrase string")
    return audit.phrase_hits(t.pages.select("page_id", meta.alias("text")), "page_id", rules, fits=True)


def used_elements(t):
    return t.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)))).alias("name"))


def styled_elements(t):
    css = F.array_join(F.regexp_extract_all("html", F.lit(r"<style[^>]*>([\s\S]*?)</style>"), F.lit(1)), "\n")
    return t.pages.select(F.explode(F.array_distinct(F.regexp_extract_all(css, F.lit(r"([a-z][\w-]*)\{"), F.lit(1)))).alias("name"))


USED = "used AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS name FROM pages), defined AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(html, '<style[^>]*>([\\s\\S]*?)</style>', 1), '([a-z][\\w-]*)\\{', 1)) AS name FROM pages)"


@query("q_c07_used_not_defined", f"""WITH {USED} SELECT name, count(*) AS pages, array_to_string(list_sort(list(page_id))[1:4], ',') AS first_pages FROM used WHERE name NOT IN (SELECT name FROM defined) GROUP BY 1""")
def _(t):
    return audit.missing_definitions(used_elements(t), styled_elements(t))


LINKS = r"regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', {})"


def link_words(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("name"))


@query("q_c08_not_in_any_producer", rf"""WITH made AS (SELECT unnest(string_split(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ')) AS name FROM pages UNION SELECT unnest(string_split(text, ' ')) FROM benchmark UNION SELECT unnest(string_split(text, ' ')) FROM conversations)
    SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS name FROM pages) WHERE name NOT IN (SELECT name FROM made)""")
def _(t):
    words = lambda df, c: df.select(F.explode(F.array_distinct(F.split(c, " "))).alias("name"))
    h1 = words(t.pages, F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1))
    producers = h1.unionByName(words(t.benchmark, F.col("text"))).unionByName(words(t.conversations, F.col("text"))).distinct()
    return link_words(t).select("name").distinct().join(producers, "name", "left_anti")


@query("q_c09_change_detection", SNAP)
def _(t):
    cur, stored = snapshot_sides(t)
    return audit.snapshot_update(cur, stored, "2024-02-01")


@query("q_c10_retry_set", "SELECT run_id, ordinal, source FROM run_results r WHERE (run_id, source) IN (SELECT run_id, source FROM run_results WHERE kind = 'failed')")
def _(t):
    return runs.retry_set(t.run_results.select("run_id", "ordinal", "source"), t.run_results).select("run_id", "ordinal", "source")


def people(t):
    u = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return u.select(F.concat(F.when(F.col("user_id") % 3 == 0, F.lit("n")).otherwise(F.lit("u")), "user_id").alias("uid"),
                    F.concat(F.lit("u"), "user_id", F.lit("@example.com")).alias("email"), (F.col("user_id") % 2 == 0).alias("email_verified"))


OWNERS = """people AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'n' ELSE 'u' END || user_id AS uid, 'u' || user_id || '@example.com' AS email, user_id % 2 = 0 AS verified FROM events),
 by_uid AS (SELECT uid, max_by(txn, (changed_at, txn)) FILTER (status = 'granted') AS t1 FROM purchases WHERE uid IS NOT NULL GROUP BY 1),
 by_email AS (SELECT email, max_by(txn, (changed_at, txn)) AS t2, max_by(coalesce(uid, ''), (changed_at, txn)) AS u2 FROM purchases WHERE status = 'granted' AND email IS NOT NULL GROUP BY 1),
 owners AS (SELECT p.uid, p.email, coalesce(t1, t2) AS txn, coalesce(t1, t2) IS NOT NULL AS pro, t1 IS NULL AND t2 IS NOT NULL AND u2 <> p.uid AS rebind,
   coalesce(t1, t2) IS NULL AND b.uid IS NOT NULL AS revoked FROM people p LEFT JOIN by_uid b ON p.uid = b.uid LEFT JOIN by_email e ON p.email = e.email AND p.verified)"""


def owners(t):
    return purchases.entitlements(people(t), purchases.purchase_state(decisions(t)))


@query("q_flagship_ownership", f"WITH {OWNERS} SELECT * FROM owners")
def _(t):
    """Who owns what, from raw out-of-order deliveries."""
    return owners(t)


@query("q_c11_entitlement_fallback", f"WITH {OWNERS} SELECT pro, rebind, revoked, count(*) AS people FROM owners GROUP BY ALL")
def _(t):
    return owners(t).groupBy("pro", "rebind", "revoked").agg(F.count("*").alias("people"))


@query("q_c11_rebinds", f"WITH {OWNERS} SELECT txn, uid FROM owners WHERE rebind")
def _(t):
    return purchases.rebinds(owners(t))


@query("q_c12_pages_to_read", "SELECT doc_id, page_index FROM doc_page_index WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return ocr.pages_to_read(t.doc_page_index, t.layer_pages)


@query("q_c13_reachable", "WITH RECURSIVE walk AS (SELECT 1::bigint AS node, 0::bigint AS hop UNION SELECT dst, hop + 1 FROM walk JOIN edges ON src = node) SELECT node, min(hop) AS hop FROM walk GROUP BY 1")
def _(t):
    start = t.pages.where("page_id = 1").select(F.col("page_id").alias("node"))
    return graphs.reachable(t.edges, start)


LEVELS = """levels AS (SELECT doc_id, node_id, 0::bigint AS level FROM outline WHERE parent_id IS NULL UNION ALL
    SELECT o.doc_id, o.node_id, level + 1 FROM outline o JOIN levels l ON o.doc_id = l.doc_id AND o.parent_id = l.node_id)"""


@query("q_c14_outline_levels", f"WITH RECURSIVE {LEVELS} SELECT * FROM levels")
def _(t):
    return graphs.outline_levels(t.outline)


def links(t):
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("n", "href"))


@query("q_c15_claim_vs_count", """SELECT page_id, claimed, counted, claimed = counted AS agrees FROM (SELECT page_id, (CASE WHEN page_id % 11 = 0 THEN 5 ELSE 6 END)::bigint AS claimed, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS counted FROM pages)""")
def _(t):
    claims = t.pages.select("page_id", F.when(F.col("page_id") % 11 == 0, 5).otherwise(6).cast("long").alias("claimed"))
    return audit.claim_vs_count(claims, links(t), "page_id")


@query("q_c16_run_reconcile", "SELECT run_id, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'done' AND bytes // 1000 <> 33) AS entries, count(*) FILTER (kind = 'done') = count(*) FILTER (kind = 'done' AND bytes // 1000 <> 33) AS reconciles FROM run_results GROUP BY 1")
def _(t):
    manifest = t.run_results.where((F.col("kind") == "done") & (F.floor(F.col("bytes") / 1000) != 33))  # entries lost on the way
    return runs.reconcile(t.run_results, manifest)


@query("q_c17_unfinished", "SELECT run, mb, phase FROM rungs WHERE outcome = 'started'")
def _(t):
    started = t.rungs.select("run", "mb", "phase")
    return runs.unfinished(started, t.rungs.where(F.col("outcome") != "started"), ["run", "mb"]).select("run", "mb", "phase")


STARTS = """starts AS (SELECT doc_id, page_index AS part_start, min_by(title, ordinal) AS title FROM outline WHERE parent_id IS NULL AND page_index IS NOT NULL GROUP BY 1, 2),
 every AS (SELECT * FROM starts UNION ALL SELECT doc_id, 0, 'front' FROM starts GROUP BY 1 HAVING min(part_start) > 0),
 parts AS (SELECT * FROM (SELECT e.doc_id, part_start, coalesce(lead(part_start) OVER (PARTITION BY e.doc_id ORDER BY part_start), page_count) AS part_end, title FROM every e JOIN outline_docs d ON e.doc_id = d.doc_id) WHERE part_end > part_start)"""


@query("q_c18_page_to_part", f"WITH {STARTS} SELECT p.doc_id, page_index, part_start, title FROM outline_pages p JOIN parts q ON p.doc_id = q.doc_id AND page_index >= part_start AND page_index < part_end")
def _(t):
    return pages.page_to_part(t.outline_pages, pages.bookmark_parts(t.outline, t.outline_docs))


@query("q_c19_named_root", """WITH RECURSIVE f AS (SELECT o.doc_id, o.node_id, CASE WHEN p.title LIKE '%e%' THEN o.parent_id END AS up FROM outline o LEFT JOIN outline p ON o.doc_id = p.doc_id AND o.parent_id = p.node_id),
    climb AS (SELECT doc_id, node_id, node_id AS spot, up FROM f UNION ALL SELECT c.doc_id, c.node_id, f.node_id, f.up FROM climb c JOIN f ON c.doc_id = f.doc_id AND c.up = f.node_id)
    SELECT doc_id, node_id, spot AS root_id FROM climb WHERE up IS NULL""")
def _(t):
    return graphs.named_root(t.outline.withColumn("is_field", F.col("title").contains("e")))


FEATURES = ["nav", "ul", "b", "footer"]


@query("q_c20_carries_all", f"WITH {USED} SELECT page_id, 5::bigint AS features FROM used WHERE name IN ('nav', 'li', 'b', 'footer', 'table') GROUP BY page_id HAVING count(*) = 5 UNION ALL SELECT page_id, 4 FROM used WHERE name IN ('nav', 'ul', 'b', 'footer') GROUP BY page_id HAVING count(*) = 4")
def _(t):
    carried = used_elements(t).withColumnRenamed("name", "feature")
    four = t.spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    five = t.spark.createDataFrame([(f,) for f in ["nav", "li", "b", "footer", "table"]], "feature string")
    return audit.carries_all(carried, five, "page_id").unionByName(audit.carries_all(carried, four, "page_id"))


@query("q_c21_either_orphan", """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), w AS (SELECT href FROM a WHERE NOT ends_with(href, '.') UNION SELECT '/extra-' || n_nationkey FROM nation)
    SELECT href, 'advertised-only' AS side FROM a WHERE href NOT IN (SELECT href FROM w) UNION ALL SELECT href, 'written-only' FROM w WHERE href NOT IN (SELECT href FROM a)""")
def _(t):
    advertised = links(t).select("href")
    written = advertised.where(~F.col("href").endswith(".")).unionByName(t.nation.select(F.concat(F.lit("/extra-"), "n_nationkey").alias("href")))
    return audit.either_orphan(advertised, written, "href")


IMPLIES = [('class="ad"', "<nav"), ("<table", "<nav"), ("track(", "<h1"), ('lang="fr"', "é"), ('lang="de"', "ß")]


@query("q_c22_implication", " UNION ALL ".join(f"SELECT '{a}' AS carrier, '{b}' AS needs, count(*) AS carriers, coalesce(bool_and(contains(html, '{b}')), false) AND count(*) > 0 AS holds FROM pages WHERE contains(html, '{a}')" for a, b in IMPLIES))
def _(t):
    return audit.implications(t.pages, "html", IMPLIES)


@query("q_c23_same_order", """SELECT page_id, differences = 0 AS equal, differences FROM (SELECT page_id, count(*) FILTER (a <> b) AS differences FROM (SELECT page_id, unnest(t) AS a, unnest(CASE WHEN page_id % 13 = 0 THEN list_reverse(h) ELSE h END) AS b
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS t, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS h FROM pages)) GROUP BY 1)""")
def _(t):
    texts = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="/[^"]*">([^<]*)</a>'), F.lit(1))).alias("n", "item"))
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)">'), F.lit(1))
    turned = F.when(F.col("page_id") % 13 == 0, F.reverse(hrefs)).otherwise(hrefs)
    return audit.same_order(texts, t.pages.select("page_id", F.posexplode(turned).alias("n", "item")), "page_id")
