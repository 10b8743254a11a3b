"""Ordered logic (§E), sorts and top-k (§F), set operations (§G), hooks (§J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, graphs, images, measure, ocr, ordered, pages, purchases, rules, runs, survey
from ..session import cut_lineage, run_path
from .catalog_aggs import ENDS, FLAT, GROWTH, HIST, MARKS, RECOGNISED, ROLLED, STORED, SURVIVED, recognised, results
from .catalog_joins import KEPT, STARTS, USED, decisions, links, outline_page_map, styled_elements, used_elements
from .catalog_rules import PLAN, judged
from .facts import choose
from .registry import query
from .sqltext import fixed, r6

# -- E: ordered logic ---------------------------------------------------------------------------

DONE = """d AS (SELECT run_id, ordinal, event_type AS base, event_id % 37 = 0 AS numbered FROM run_results JOIN events ON event_id = ordinal WHERE kind = 'done'),
  n AS (SELECT *, row_number() OVER (PARTITION BY run_id, base, numbered ORDER BY ordinal) AS r FROM d),
  c AS (SELECT run_id, base, min(ordinal) FILTER (numbered) AS first_lit FROM d GROUP BY 1, 2),
  b AS (SELECT n.*, first_lit, count(*) FILTER (NOT numbered AND ordinal < first_lit) OVER (PARTITION BY n.run_id, n.base) AS ahead,
          count(*) FILTER (NOT numbered) OVER (PARTITION BY n.run_id, n.base) AS plain FROM n JOIN c ON n.run_id = c.run_id AND n.base = c.base)"""


@query("q_e01_unique_names", f"""WITH {DONE} SELECT run_id, ordinal, base || CASE
    WHEN NOT numbered THEN CASE WHEN r = 1 THEN '' ELSE ' (' || (r + CASE WHEN first_lit IS NOT NULL AND ahead < 2 THEN 1 ELSE 0 END) || ')' END
    WHEN plain = 0 OR ahead < 2 THEN ' (2)' || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END
    ELSE ' (2) (' || (r + 1) || ')' END || '.pdf' AS name FROM b""")
def _(t):
    done = t.run_results.where("kind = 'done'").select("run_id", "ordinal", "source")
    return runs.allocate_names(done).select("run_id", "ordinal", "name")


@query("q_e02_rename_clashes", "SELECT doc_id, node_id, role || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS new_name, n > 1 AS renamed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY ordinal) AS n FROM outline)")
def _(t):
    return pages.rename_clashes(t.outline, ["doc_id"], "role", "ordinal").select("doc_id", "node_id", "new_name", "renamed")


@query("q_e03_split_every", "SELECT doc_id, page_index, page_index // 3 + 1 AS part FROM doc_page_index")
def _(t):
    return pages.split_every(t.doc_page_index, 3).select("doc_id", "page_index", "part")


@query("q_e04_bookmark_parts", f"WITH {STARTS} SELECT * FROM parts")
def _(t):
    return pages.bookmark_parts(t.outline, t.outline_docs)


@query("q_e05_describe_ranges", """SELECT d.doc_id, coalesce(ranges, 'none') AS ranges FROM (SELECT DISTINCT doc_id FROM file_pages) d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN lo = hi THEN (lo + 1)::varchar ELSE (lo + 1) || '-' || (hi + 1) END, ', ' ORDER BY lo) AS ranges FROM (
    SELECT doc_id, min(page_index) AS lo, max(page_index) AS hi FROM (SELECT doc_id, page_index, page_index - row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS g FROM file_pages WHERE rotation <> 0) GROUP BY doc_id, g) GROUP BY 1) r ON d.doc_id = r.doc_id""")
def _(t):
    every = cut_lineage(t.file_pages.select("doc_id", "page_index", "rotation"))
    return pages.describe_ranges(every.where("rotation <> 0"), ["doc_id"], "page_index", groups=every.select("doc_id").distinct())


@query("q_e05_islands", """SELECT doc_id, min(page_index) AS first, max(page_index) AS last FROM (SELECT doc_id, page_index, page_index - row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS g FROM file_pages WHERE rotation <> 0) GROUP BY doc_id, g""")
def _(t):
    return pages.islands(cut_lineage(t.file_pages.where("rotation <> 0")), ["doc_id"], "page_index")


OFFSETS = "f AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), off AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"offset\" FROM f)"


def merge_files(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.select("o_custkey", "o_orderkey").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("q_e06_merge_offsets", f"WITH {OFFSETS} SELECT o_custkey, o_orderkey, n, \"offset\" FROM off")
def _(t):
    return pages.merge_offsets(merge_files(t), "o_custkey", "o_orderkey", "n")


ORDERED = "o AS (SELECT *, CASE WHEN page_count % 7 <> 0 THEN page_index * 7 % page_count ELSE page_index END AS position, page_index % 5 = 4 AS dropped FROM doc_page_index)"


def reordered(t):
    pos = F.when(F.col("page_count") % 7 != 0, F.col("page_index") * 7 % F.col("page_count")).otherwise(F.col("page_index"))
    return t.doc_page_index.withColumn("position", pos)


def dropped():
    return F.col("page_index") % 5 == 4


@query("q_e07_reorder", f"WITH {ORDERED} SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS new_index FROM o WHERE NOT dropped")
def _(t):
    return pages.reorder_plan(reordered(t), "position", dropped()).select("doc_id", "page_index", "new_index")


@query("q_e07_reorder_flags", f"WITH {ORDERED} SELECT doc_id, bool_or(page_index <> position) AS moved, bool_or(page_index <> position OR dropped) AS changed, count(*) FILTER (NOT dropped) AS kept FROM o GROUP BY 1")
def _(t):
    return pages.reorder_flags(reordered(t), "position", dropped())


TYPED = ["1-4, 7, 9-12", "5-2", "1-99", "abc", " ", "3, 3, 3", "2,1-3, ,8–9", "0-3", "7, x, 5-2", "1"]
ASKED = "a AS (SELECT p_partkey AS id, p_size::bigint AS n, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(TYPED)) + " END AS typed FROM part)"
RANGES = ASKED + r""", p AS (SELECT id, n, part_no, trim(part) AS part FROM (SELECT id, n, unnest(string_split(typed, ',')) AS part, unnest(range(0, len(string_split(typed, ',')))) AS part_no FROM a) WHERE trim(part) <> ''),
  q AS (SELECT *, regexp_full_match(part, '\d+\s*([-–—]\s*\d+)?') AS ok, try_cast(regexp_extract(part, '^(\d+)', 1) AS bigint) AS lo, coalesce(try_cast(regexp_extract(part, '[-–—]\s*(\d+)$', 1) AS bigint), try_cast(regexp_extract(part, '^(\d+)', 1) AS bigint)) AS hi FROM p),
  e AS (SELECT *, CASE WHEN NOT ok THEN '"' || part || '" is not a page or a range. Use numbers like 3 or 5-9.' WHEN lo < 1 OR hi < 1 THEN 'Pages are numbered from 1.' WHEN lo > n OR hi > n THEN 'This document has ' || n || ' pages, so ' || greatest(lo, hi) || ' does not exist.'
     WHEN hi < lo THEN '"' || part || '" runs backwards. Write it as ' || hi || '-' || lo || '.' END AS error FROM q),
  st AS (SELECT a.id, CASE WHEN count(e.id) = 0 THEN 'Type which pages you want, for example 1-4, 7.' ELSE min_by(error, part_no) FILTER (error IS NOT NULL) END AS error FROM a LEFT JOIN e ON a.id = e.id GROUP BY 1),
  w AS (SELECT id, part_no, unnest(range(lo, hi + 1)) - 1 AS page_index FROM e WHERE id IN (SELECT id FROM st WHERE error IS NULL)),
  f AS (SELECT id, page_index, min(part_no) AS part_no FROM w GROUP BY 1, 2)"""


def asked(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n"), choose(F.col("p_partkey") % 10, TYPED).alias("typed"))


@query("q_e08_range_errors", f"WITH {RANGES} SELECT id, error FROM st")
def _(t):
    return pages.parse_ranges(asked(t), "id", "typed", "n")[0]


@query("q_e08_range_pages", f"WITH {RANGES} SELECT id, page_index, row_number() OVER (PARTITION BY id ORDER BY part_no, page_index) - 1 AS position FROM f")
def _(t):
    return pages.parse_ranges(asked(t), "id", "typed", "n")[1]


@query("q_e09_latest_status", "SELECT txn, status, uid, email, epoch_us(changed_at) AS changed_at, last_event FROM purchases")
def _(t):
    p = purchases.purchase_state(decisions(t))
    return p.select("txn", "status", "uid", "email", F.unix_micros("changed_at").alias("changed_at"), "last_event")


@query("q_e09_latest_answers", "SELECT lower(trim(email)) AS email, max_by((trim(profession), nullif(trim(coalesce(spends_too_long, '')), ''), nullif(trim(coalesce(cadence, '')), '')), (moment, event_id))[1] AS profession, max_by((trim(profession), nullif(trim(coalesce(spends_too_long, '')), ''), 1), (moment, event_id))[2] AS spends_too_long, max_by((1, nullif(trim(coalesce(cadence, '')), '')), (moment, event_id))[2] AS cadence FROM survey_checked WHERE verdict = 'recorded' GROUP BY 1")
def _(t):
    return survey.latest_answers(survey.cleaned(t.survey)).drop("at")


@query("q_e10_flat_suffix", f"WITH {SURVIVED}, {FLAT} SELECT run, min(mb) AS from_mb, min_by(to_mb, mb) AS to_mb, min_by(n, mb) AS rungs, min_by(lo, mb) AS lo, min_by(hi, mb) AS hi FROM flat GROUP BY 1")
def _(t):
    return measure.flat_suffix(t.rungs)


@query("q_e11_growth", f"WITH {SURVIVED}, {ENDS}, {GROWTH} SELECT run, n, lo AS from_mb, hi AS to_mb, {r6('span')} AS span, {r6('ratio')} AS ratio, {r6('expected')} AS expected, NOT (span >= 2 AND ratio < expected) AS grew FROM gr")
def _(t):
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)
    return measure.growth(t.rungs).select("run", "n", "from_mb", "to_mb", micro("span"), micro("ratio"), micro("expected"), "grew")


NUMBERED = "CASE WHEN conv_id % 7 = 0 AND turn >= 3 THEN turn ELSE turn + 1 END"


@query("q_e12_numbering", f"SELECT conv_id, turn, num AS number, expected FROM (SELECT conv_id, turn, {NUMBERED} AS num, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations) WHERE num <> expected")
def _(t):
    heads = t.conversations.select("conv_id", "turn", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 3), F.col("turn")).otherwise(F.col("turn") + 1).alias("number"))
    return audit.numbering_problems(heads, "conv_id", "number", "turn")


@query("q_e12_anchor_clashes", r"""SELECT conv_id, slug, count(*) AS times FROM (SELECT conv_id, regexp_replace(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\w\s-]', '', 'g')), '\s', '-', 'g') AS slug FROM conversations) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    d = t.conversations.select("conv_id", S.slug(F.substring_index("text", "\n", 1)).alias("slug"))
    return d.groupBy("conv_id", "slug").agg(F.count("*").alias("times")).where("times > 1")


@query("q_e13_marker_balance", r"""WITH m AS (SELECT page_id, unnest(cs) = '/' AS close, unnest(ks) AS kind, unnest(range(0, len(ks))) AS n FROM (SELECT page_id, regexp_extract_all(html, '<(/?)(p|b|ul|li|nav|div|article|footer)[ >]', 1) AS cs, regexp_extract_all(html, '<(/?)(p|b|ul|li|nav|div|article|footer)[ >]', 2) AS ks FROM pages)),
    x AS (SELECT *, lag(close) OVER w AS pc, lag(kind) OVER w AS pk, lead(n) OVER w AS nn FROM m WINDOW w AS (PARTITION BY page_id ORDER BY n)),
    y AS (SELECT page_id, n, kind, CASE WHEN NOT close AND pc = false THEN 'opened-inside' WHEN close AND coalesce(pc, true) THEN 'nothing-open' WHEN close AND pk <> kind THEN 'closes-other' WHEN NOT close AND nn IS NULL THEN 'never-closed' END AS problem FROM x)
    SELECT * FROM y WHERE problem IS NOT NULL""")
def _(t):
    get = lambda g: F.regexp_extract_all("html", F.lit(audit.TAGS), F.lit(g))
    m = t.pages.select("page_id", F.posexplode(F.arrays_zip(get(1).alias("c"), get(2).alias("k"))).alias("n", "m"))
    markers = m.select("page_id", F.col("n").cast("long").alias("n"), (F.col("m.c") == "/").alias("close"), F.col("m.k").alias("kind"))
    return audit.marker_problems(markers, "page_id")


@query("q_e14_rate_and_eta", """SELECT event_id, session, done, total - done AS remaining, us // done AS rate_us, us // done * (total - done) AS eta_us FROM (SELECT event_id, session, row_number() OVER (PARTITION BY session ORDER BY event_id) AS done,
    count(*) OVER (PARTITION BY session) AS total, epoch_us(moment) - min(epoch_us(moment)) OVER (PARTITION BY session) AS us FROM requests)""")
def _(t):
    d = t.events.select("event_id", F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return measure.progress(d, "session", "event_id", "us")


SHAPES = {"page": MARKS, "head": ["<title>", "<style>"], "list": ["<ul>", "<ol>"], "ends": ["<article>", "</html>"]}


@query("q_e15_nearest_gap", r"""WITH p AS (SELECT page_id, regexp_replace(html, '\s+', ' ', 'g') AS h FROM pages),
    g AS (SELECT page_id, h, 'page' AS shape, instr(h, '<nav>') - 1 AS lo, instr(h, '<footer>') + 7 AS hi FROM p WHERE contains(h, '<nav>') AND contains(h, '<article>') AND contains(h, '<footer>')
      UNION ALL SELECT page_id, h, 'head', instr(h, '<title>') - 1, instr(h, '<style>') + 6 FROM p WHERE contains(h, '<title>') AND contains(h, '<style>')
      UNION ALL SELECT page_id, h, 'list', least(instr(h, '<ul>'), instr(h, '<ol>')) - 1, greatest(instr(h, '<ul>'), instr(h, '<ol>')) + 3 FROM p WHERE contains(h, '<ul>') AND contains(h, '<ol>')
      UNION ALL SELECT page_id, h, 'ends', instr(h, '<article>') - 1, instr(h, '</html>') + 6 FROM p WHERE contains(h, '<article>') AND contains(h, '</html>')),
    o AS (SELECT page_id, shape, unnest(list_filter(range(1, length(h)), lambda i: substr(h, i::bigint, 8) = 'track(1)')) - 1 AS i FROM g),
    m AS (SELECT page_id, shape, min(CASE WHEN i BETWEEN lo AND hi THEN 0 WHEN i < lo THEN lo - i ELSE i - hi END) AS gap FROM o JOIN g USING (page_id, shape) GROUP BY 1, 2)
    SELECT page_id, shape, gap, coalesce(gap <= 100, false) AS near FROM g LEFT JOIN m USING (page_id, shape)""")
def _(t):
    return audit.nearest_gap(t.pages, "page_id", "html", SHAPES, "track(1)", near=100)


KNOWN = [r"and", r"qui"]


@query("q_e16_unknown_phrasings", r"""WITH o AS (SELECT doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i::bigint, 5) = 'with ')) - 1 AS i FROM documents WHERE contains(text, 'with ')),
    a AS (SELECT doc_id, i AS pos, substr(text, greatest(i - 60, 0) + 1, i + 30 - greatest(i - 60, 0)) AS around FROM o) SELECT doc_id, pos, around FROM a WHERE NOT (contains(around, 'and') OR contains(around, 'qui'))""")
def _(t):
    return audit.unknown_phrasings(t.documents, "doc_id", "text", "with ", KNOWN).withColumnRenamed("at", "pos")


@query("q_e17_quantity", f"WITH {SURVIVED}, {ENDS} SELECT run, lo AS from_mb, hi AS to_mb, lo_n AS first_count, hi_n AS last_count, NOT (hi >= lo * 2 AND hi_n <= lo_n) AS grew FROM e WHERE n >= 2")
def _(t):
    return measure.quantity(t.rungs)


@query("q_e18_page_order", """SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY done, page_index) AS finished, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS place
    FROM (SELECT doc_id, page_index, page_index * 7919 % 1009 AS done FROM doc_page_index)""")
def _(t):
    """Results in the order they were finished, and the place each takes among the pages."""
    done = t.doc_page_index.select("doc_id", "page_index", (F.col("page_index") * 7919 % 1009).alias("done"))
    done = ordered.number(done, ["doc_id"], ["done", "page_index"], ordered.chunk_of("done", 64), "finished")
    return ocr.in_page_order(done).select("doc_id", "page_index", "finished", "place")


@query("q_e19_prune", """WITH RECURSIVE o AS (SELECT o.doc_id, node_id, parent_id, page_index, coalesce(page_index >= 0 AND page_index < page_count, false) AS valid FROM outline o JOIN outline_docs d ON o.doc_id = d.doc_id),
    keep AS (SELECT doc_id, node_id, parent_id FROM o WHERE valid UNION SELECT o.doc_id, o.node_id, o.parent_id FROM o JOIN keep k ON o.doc_id = k.doc_id AND o.node_id = k.parent_id)
    SELECT o.doc_id, o.node_id, CASE WHEN valid THEN page_index END AS page_index FROM o JOIN keep k ON o.doc_id = k.doc_id AND o.node_id = k.node_id""")
def _(t):
    d = t.outline.join(t.outline_docs, "doc_id").withColumn("valid", F.coalesce((F.col("page_index") >= 0) & (F.col("page_index") < F.col("page_count")), F.lit(False)))
    return graphs.keep_with_survivors(d, "valid").select("doc_id", "node_id", "page_index")


DOC_OFFSETS = "off AS (SELECT doc_id, page_count, coalesce(sum(page_count) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"offset\" FROM outline_docs)"


def doc_offsets(t):
    d = t.outline_docs.withColumn("run", F.col("doc_id") % 10)
    return pages.merge_offsets(d, "run", "doc_id", "page_count")


@query("q_e20_shift_outline", f"WITH {DOC_OFFSETS} SELECT doc_id, -1::bigint AS node_id, NULL::bigint AS parent_id, 'file-' || doc_id AS title, \"offset\" AS page_index FROM off UNION ALL SELECT o.doc_id, node_id, coalesce(parent_id, -1), title, page_index + \"offset\" FROM outline o JOIN off ON o.doc_id = off.doc_id")
def _(t):
    return pages.shift_outline(t.outline, doc_offsets(t))


# -- F: sort, limit, top-k ------------------------------------------------------------------------


@query("q_f01_top_reason", f"WITH {HIST} SELECT doc_id, arg_max(skip_reason, (n, -first_seen[1], -first_seen[2])) AS top_reason, max(n) AS n FROM hist GROUP BY 1")
def _(t):
    return images.top_skip_reason(images.skip_histogram(judged(t)))


@query("q_f02_newest_unlock", "SELECT owner, max_by(event_id, (moment, event_id)) AS newest FROM stash_events WHERE what = 'stash' AND moment >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 HOUR GROUP BY 1")
def _(t):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    fresh = t.stash_events.where((F.col("what") == "stash") & rules.is_fresh("at", now, "10 hours"))
    return fresh.groupBy("owner").agg(F.max_by("event_id", F.struct("at", "event_id")).alias("newest"))


@query("q_f03_sorted_rungs", "SELECT run, mb, row_number() OVER (PARTITION BY run ORDER BY mb) AS place FROM rungs WHERE outcome = 'survived'")
def _(t):
    return ordered.number(t.rungs.where("outcome = 'survived'").select("run", "mb"), ["run"], ["mb"], ordered.chunk_of("mb"), "place")


@query("q_f04_first_four", "SELECT run_id, ordinal FROM (SELECT run_id, ordinal, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS rn FROM run_results WHERE kind = 'failed') WHERE rn <= 4")
def _(t):
    return audit.first_n(t.run_results.where("kind = 'failed'").select("run_id", "ordinal"), ["run_id"], "ordinal", 4)


# -- G: set operations ------------------------------------------------------------------------------


@query("q_g01_union_results", f"WITH {RECOGNISED} SELECT doc_id, page_index, words, source, skipped FROM res")
def _(t):
    return results(t).select("doc_id", "page_index", "words", "source", "skipped")


@query("q_g02_merged_pages", f"WITH {OFFSETS} SELECT o_custkey, doc_id, page_index, page_index + \"offset\" AS merged_index FROM file_pages JOIN off ON doc_id = o_orderkey")
def _(t):
    off = pages.merge_offsets(merge_files(t), "o_custkey", "o_orderkey", "n").select("o_custkey", F.col("o_orderkey").alias("doc_id"), "offset")
    return t.file_pages.join(off, "doc_id").select("o_custkey", "doc_id", "page_index", (F.col("page_index") + F.col("offset")).alias("merged_index"))


@query("q_g03_union_distinct", f"WITH {USED} SELECT name FROM used UNION SELECT name FROM defined UNION SELECT lower(n_name) FROM nation")
def _(t):
    return (used_elements(t).select("name").unionByName(styled_elements(t)).unionByName(t.nation.select(F.lower("n_name").alias("name")))).distinct()


@query("q_g04_except", f"WITH {USED} SELECT name FROM used EXCEPT SELECT name FROM defined")
def _(t):
    return used_elements(t).select("name").distinct().join(styled_elements(t).distinct(), "name", "left_anti")


DECLARED = ["id", "transaction_id", "action", "status", "custom_data", "currency"]


@query("q_g05_schema_drift", """WITH f AS (SELECT event_type, unnest(list_filter([CASE WHEN event_type = 'transaction.completed' AND event_id % 53 <> 0 OR event_type = 'transaction.completed' THEN 'id' END, CASE WHEN event_type <> 'transaction.completed' THEN 'transaction_id' END,
      CASE WHEN action IS NOT NULL THEN 'action' END, CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN kind IS NOT NULL THEN 'type' END, CASE WHEN item_type IS NOT NULL OR price_id IS NOT NULL THEN 'items' END,
      CASE WHEN event_type = 'transaction.completed' THEN 'custom_data' END], lambda x: x IS NOT NULL)) AS field FROM purchase_fields WHERE NOT broken),
    s AS (SELECT DISTINCT * FROM f), k AS (SELECT DISTINCT event_type FROM purchase_fields WHERE NOT broken),
    w AS (SELECT event_type, unnest(['id', 'transaction_id', 'action', 'status', 'custom_data', 'currency']) AS field FROM k)
    SELECT k.event_type, coalesce((SELECT string_agg(field, ',' ORDER BY field) FROM s WHERE s.event_type = k.event_type AND field NOT IN (SELECT field FROM w)), '') AS undeclared,
      coalesce((SELECT string_agg(field, ',' ORDER BY field) FROM w WHERE w.event_type = k.event_type AND field NOT IN (SELECT field FROM s WHERE s.event_type = k.event_type)), '') AS absent FROM k""")
def _(t):
    """Fields of the stored deliveries against the declared ones, per event type."""
    d = t.deliveries.select(F.get_json_object("raw", "$.event_type").alias("event_type"), F.get_json_object("raw", "$.data").alias("data"))
    return audit.schema_drift(d.where("data is not null"), "event_type", "data", DECLARED)


@query("q_g06_complement", "SELECT doc_id, page_index FROM doc_page_index EXCEPT SELECT doc_id, page_index FROM layer_pages WHERE length(text) >= 1000")
def _(t):
    gone = t.layer_pages.where(F.length("text") >= 1000)
    return ocr.pages_to_read(t.doc_page_index, gone)


@query("q_g07_equivalence", "SELECT page_id, contains(html, 'lang=\"fr\"') AS sells, contains(regexp_replace(html, '<style[\\s\\S]*?</style>', ' ', 'g'), 'ê') AS button FROM pages WHERE contains(html, 'lang=\"fr\"') <> contains(regexp_replace(html, '<style[\\s\\S]*?</style>', ' ', 'g'), 'ê')")
def _(t):
    content = F.regexp_replace("html", r"<style[\s\S]*?</style>", " ")
    d = t.pages.select("page_id", F.contains("html", F.lit('lang="fr"')).alias("sells"), F.contains(content, F.lit("ê")).alias("button"))
    return d.where(F.col("sells") != F.col("button"))


EXPECTED = [("the", True), ("und", True), ("zebra", False), ("and", False), ("unicorn", True)]


@query("q_g08_expected_phrases", " UNION ALL ".join(f"SELECT '{p}' AS phrase, {str(w).lower()} AS expected, bool_or(contains(html, '{p}')) AS found FROM pages" for p, w in EXPECTED))
def _(t):
    return audit.expected_phrases(t.pages, audit.normalise("html"), EXPECTED)


# -- J: hooks -----------------------------------------------------------------------------------------


@query("q_j01_caller_plan", f"WITH {ROLLED} SELECT doc_id, image_key, CASE WHEN dpi > 96 AND width > 1000 THEN greatest(1, cast(floor(width * (96 / dpi) + 0.5) AS bigint)) END AS target_w FROM j WHERE recompressible")
def _(t):
    plan = F.when((F.col("dpi") > 96) & (F.col("width") > 1000), F.struct(F.lit(96).alias("dpi"), F.lit(0.5).alias("quality")))
    return images.apply_plan(judged(t).where("recompressible"), plan).select("doc_id", "image_key", "target_w")


def _demo_work(files):
    """A caller's function over a frame of files: fails on some of them, leaves others alone."""
    import numpy as np
    import pandas as pd

    size = files["bytes"].to_numpy()
    if (size < 5000).any():
        raise ValueError("too small to read")
    small = size < 10000
    half = (size // 2).astype(object)
    half[small] = None
    return pd.DataFrame({"kind": np.where(small, "left-alone", "done"), "bytes": half, "reason": np.where(small, "nothing to gain", None)})


@query("q_j02_isolated_work", """SELECT run_id, ordinal, CASE WHEN bytes < 5000 THEN 'failed' WHEN bytes < 10000 THEN 'left-alone' ELSE 'done' END AS kind, CASE WHEN bytes >= 10000 THEN bytes // 2 END AS bytes,
    CASE WHEN bytes < 5000 THEN 'ValueError: too small to read' WHEN bytes < 10000 THEN 'nothing to gain' END AS reason FROM run_results""")
def _(t):
    files = t.run_results.select("run_id", "ordinal", "source", "bytes")
    return runs.apply_to_files(files, _demo_work).select("run_id", "ordinal", "kind", "bytes", "reason")


@query("q_j02_stopped_run", """WITH s AS (SELECT run_id, min(ordinal) FILTER (kind = 'interrupted') AS stop FROM run_results GROUP BY 1),
  r AS (SELECT run_id, ordinal, bytes, CASE WHEN ordinal = stop THEN 'interrupted' WHEN ordinal > stop THEN 'not-attempted' WHEN bytes < 5000 THEN 'failed' WHEN bytes < 10000 THEN 'left-alone' ELSE 'done' END AS kind FROM run_results JOIN s USING (run_id))
  SELECT run_id, ordinal, kind, CASE WHEN kind = 'done' THEN bytes // 2 END AS bytes, CASE kind WHEN 'failed' THEN 'ValueError: too small to read' WHEN 'left-alone' THEN 'nothing to gain' END AS reason FROM r""")
def _(t):
    """Runs that are stopped at a file: what came before it is finished, what comes after it is not begun."""
    def work(frame):
        done = _demo_work(frame)
        return done.assign(kind=done["kind"].where(~frame["stops"].to_numpy(), "interrupted"))

    files = t.run_results.select("run_id", "ordinal", "source", "bytes", (F.col("kind") == "interrupted").alias("stops"))
    return runs.apply_to_files(files, work, stops=run_path(t.spark, "stops")).select("run_id", "ordinal", "kind", "bytes", "reason")


@query("q_j03_measured_steps", "SELECT step, count(*) AS measured, count(*) FILTER (size <= target) AS fitting FROM size_measurements GROUP BY 1")
def _(t):
    return t.size_measurements.groupBy("step").agg(F.count("*").alias("measured"), F.count_if(F.col("size") <= F.col("target")).alias("fitting"))


@query("q_j04_injected_clock", "SELECT what, count(*) AS events, count(*) FILTER (moment >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY AND moment <= TIMESTAMP '2024-01-20 00:00:00') AS within FROM stash_events GROUP BY 1")
def _(t):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    within = rules.is_fresh("at", now, "3 days", "0 seconds")
    return t.stash_events.groupBy("what").agg(F.count("*").alias("events"), F.count_if(within).alias("within"))
