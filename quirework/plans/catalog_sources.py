"""Sources and sinks (§A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, measure, ocr, purchases, rules, runs
from ..session import run_path
from ..sources import pieces, scans, sinks
from .facts import choose
from .registry import query
from .sqltext import normalise

OWN = "https://m.therou.example.com"
PAGE_NAME = "CASE WHEN page_id % 40 = 0 THEN 'selftest.html' WHEN page_id % 40 = 1 THEN 'ocr-probe.html' ELSE 'page-' || page_id || '.html' END"


def named_pages(t):
    k = F.col("page_id") % 40
    name = F.when(k == 0, "selftest.html").when(k == 1, "ocr-probe.html").otherwise(F.concat(F.lit("page-"), F.col("page_id"), F.lit(".html")))
    return t.pages.withColumn("name", name)


@query("q_a01_file_facts", """SELECT name, size AS length, CASE WHEN head_hex LIKE '25504446%' THEN 'application/pdf' WHEN head_hex LIKE '504B0304%' THEN 'zip' WHEN head_hex LIKE 'D0CF11E0%' THEN 'ole'
    WHEN head_hex LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN head_hex LIKE '89504E47%' THEN 'image/png' WHEN head_hex LIKE '47494638%' THEN 'image/gif' WHEN head_hex LIKE '52494646%' AND substr(head_hex, 17, 8) = '57454250' THEN 'image/webp' WHEN head_hex LIKE '7B%' THEN 'text' END AS container,
    CASE WHEN size = 0 THEN 'empty' WHEN size > 62914560 THEN 'too-big' WHEN head_hex NOT LIKE '25504446%' THEN 'not-pdf' END AS refused FROM files""")
def _(t):
    """Every listed file's size and verdict, from its leading bytes."""
    return scans.file_facts(t.files, "name", "size", "head")


MAGIC = ["255044462D312E37", "504B030414000600", "D0CF11E0A1B11AE1", "FFD8FFE000104A46", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "7B226B", ""]
ENDING = ["pdf", "docx", "xls", "jpg", "png", "gif", "webp", "json", "txt"]


@query("q_a01_file_heads", f"""WITH f AS (SELECT 'doc-' || doc_id || '.' || {ENDING}[doc_id % 9 + 1] AS name, {MAGIC}[doc_id % 9 + 1] AS magic, CASE WHEN doc_id % 41 = 0 THEN 0 ELSE length({MAGIC}[doc_id % 9 + 1]) // 2 + strlen(text) END AS length, text FROM documents),
    g AS (SELECT name, length, CASE WHEN length = 0 THEN NULL WHEN magic = '25504446' || '2D312E37' THEN 'application/pdf' WHEN magic LIKE '504B%' THEN 'zip' WHEN magic LIKE 'D0CF%' THEN 'ole' WHEN magic LIKE 'FFD8%' THEN 'image/jpeg' WHEN magic LIKE '8950%' THEN 'image/png' WHEN magic LIKE '4749%' THEN 'image/gif'
      WHEN magic LIKE '5249%' THEN 'image/webp' WHEN magic LIKE '7B%' THEN 'text' END AS container FROM f)
    SELECT name, length, container, CASE WHEN length = 0 THEN 'empty' WHEN length > 40000 THEN 'too-big' WHEN container IS DISTINCT FROM 'application/pdf' THEN 'not-pdf' END AS refused FROM g""")
def _(t):
    """Files of the documents' texts behind a leading signature, told apart by their heads alone; the ceiling is 40 KB here."""
    k = F.col("doc_id") % 9
    content = F.when(F.col("doc_id") % 41 != 0, F.concat(F.unhex(choose(k, MAGIC)), F.encode("text", "UTF-8")))
    name = F.concat(F.lit("doc-"), "doc_id", F.lit("."), choose(k, ENDING))
    path = run_path(t.spark, "files")
    files = t.documents.select(F.lit(0).cast("long").alias("run_id"), F.col("doc_id").alias("ordinal"), name.alias("source"), content.alias("content"))
    pieces.work_through(files, lambda piece: ("done", piece["content"], None), path)
    return scans.file_facts(pieces.entries(t.spark, path), "name", "length", "head", 40_000)


@query("q_a02_page_corpus", f"SELECT name, length(html) AS chars FROM (SELECT *, {PAGE_NAME} AS name FROM pages) WHERE name NOT IN ('selftest.html', 'ocr-probe.html')")
def _(t):
    return audit.site_pages(named_pages(t), "name").select("name", F.length("html").cast("long").alias("chars"))


@query("q_a03_event_scan", """SELECT NOT broken AS parsed, CASE WHEN NOT broken THEN event_type END AS event_type, count(*) AS n,
    count(*) FILTER (NOT broken AND item_type IS NOT NULL OR NOT broken AND price_id IS NOT NULL) AS with_items FROM purchase_fields GROUP BY 1, 2""")
def _(t):
    p = purchases.parse_events(t.deliveries)
    ok = F.col("parsed")
    return p.groupBy("parsed", F.when(ok, F.col("e.event_type")).alias("event_type")).agg(
        F.count("*").alias("n"), F.count_if(ok & (F.size("e.data.items") > 0)).alias("with_items"))


@query("q_a04_keyed_scan", """SELECT c_custkey, concat_ws('; ', CASE WHEN c_name IS NULL THEN 'c_name is null' END, CASE WHEN c_acctbal < 0 THEN 'balance' END,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END) AS violations FROM customer""")
def _(t):
    rows = t.spark.read.schema(scans.CUSTOMERS).parquet(f"{t.folder}/customer.parquet")
    return scans.quality_violations(rows, ["c_custkey", "c_name"], {
        "balance": "c_acctbal >= 0", "segment": "c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"}).select("c_custkey", "violations")


@query("q_a05_run_output", "SELECT run_id, count(*) AS entries, sum(bytes)::bigint AS bytes FROM run_results WHERE kind = 'done' GROUP BY 1")
def _(t):
    path = run_path(t.spark, "runs")
    sinks.write_run_output(t.run_results, path)
    m = sinks.read_manifest(t.run_results, path)
    return m.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


@query("q_a06_read_back", """SELECT run_id, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'done' AND bytes // 1000 <> 33) AS entries,
    count(*) FILTER (kind = 'done') = count(*) FILTER (kind = 'done' AND bytes // 1000 <> 33) AS reconciles FROM run_results GROUP BY 1""")
def _(t):
    """What the runs said they had finished, against the files that are there. Some files were never written."""
    path = run_path(t.spark, "runs")

    def work(piece):
        return ("left-alone", None, "lost") if piece["bytes"] // 1000 == 33 else ("done", str(piece["bytes"]).encode(), None)

    pieces.work_through(t.run_results.where("kind = 'done'"), work, path, deal=True)
    return runs.reconcile(t.run_results, pieces.entries(t.spark, path))


@query("q_a07_joined_text", "SELECT doc_id, md5(string_agg('--- page ' || (page_index + 1) || E' ---\\n' || text, E'\\n\\n' ORDER BY page_index)) AS digest FROM doc_pages GROUP BY 1")
def _(t):
    path = run_path(t.spark, "texts")
    sinks.write_texts(ocr.joined_text(t.doc_pages, "text"), path)
    return t.spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"))


SNAP = """WITH cur AS (SELECT url || '#' || page_id AS key, left(sha256(replace(html, chr(13) || chr(10), chr(10))), 16) AS sha, page_id FROM pages),
 stored AS (SELECT key, CASE WHEN page_id % 3 = 0 THEN 'stale' ELSE sha END AS old, '2024-01-01' AS date FROM cur WHERE NOT contains(key, '?')
   UNION ALL SELECT 'gone-' || n_nationkey, 'kept', '2023-06-01' FROM nation)
 SELECT coalesce(cur.key, stored.key) AS key, coalesce(sha, old) AS sha, CASE WHEN sha IS NULL OR sha = old THEN date ELSE '2024-02-01' END AS date
 FROM cur FULL JOIN stored ON cur.key = stored.key"""


def snapshot_sides(t):
    cur = t.pages.select("page_id", F.concat("url", F.lit("#"), "page_id").alias("key"), S.content_sha("html").alias("sha"))
    known = ~F.contains("key", F.lit("?"))  # the pages an earlier run had seen
    old = cur.where(known).select("key", F.when(F.col("page_id") % 3 == 0, F.lit("stale")).otherwise(F.col("sha")).alias("sha"), F.lit("2024-01-01").alias("date"))
    gone = t.nation.select(F.concat(F.lit("gone-"), "n_nationkey").alias("key"), F.lit("kept").alias("sha"), F.lit("2023-06-01").alias("date"))
    return cur, old.unionByName(gone)


@query("q_a08_snapshot_sink", SNAP)
def _(t):
    cur, stored = snapshot_sides(t)
    path = run_path(t.spark, "snapshot")
    sinks.write_snapshot(audit.snapshot_update(cur, stored, "2024-02-01"), path)
    return t.spark.read.parquet(path)


HOSTS = f"""SELECT phase, host, count(*) AS requests, string_agg(DISTINCT rtype, ',' ORDER BY rtype) AS types,
    coalesce(string_agg(DISTINCT blocked, ',' ORDER BY blocked), '') AS blocks, bool_or(split_part(url, '://', 1) || '://' || host <> '{OWN}') AS third_party FROM requests GROUP BY 1, 2"""


@query("q_a09_report_sink", HOSTS)
def _(t):
    path = run_path(t.spark, "report")
    sinks.write_report(measure.host_summary(t.requests, OWN), path)
    return t.spark.read.schema("phase string, host string, requests long, types string, blocks string, third_party boolean").json(path)


@query("q_a10_package_scan", """SELECT p_name || '-' || p_partkey AS name, '1.' || p_size AS version,
    CASE p_partkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'ISC' WHEN 2 THEN 'MIT OR Apache-2.0' ELSE 'UNKNOWN' END AS licence FROM part""")
def _(t):
    licence = choose(F.col("p_partkey") % 4, ['"license":"MIT"', '"license":{"type":"ISC"}', '"licenses":["MIT",{"type":"Apache-2.0"}]', '"private":true'])
    text = F.concat(F.lit('{"name":"'), "p_name", F.lit("-"), "p_partkey", F.lit('","version":"1.'), "p_size", F.lit('",'), licence, F.lit("}"))
    return scans.package_licences(t.part.select(text.alias("value")), "value")


@query("q_a11_stage_marks", "SELECT run_id, ordinal FROM run_results WHERE kind = 'interrupted'")
def _(t):
    """Every attempted piece is marked before it is begun; those that never come back are found by their marks."""
    path = run_path(t.spark, "marks")

    def work(piece):
        return None if piece["kind"] == "interrupted" else ("left-alone" if piece["kind"] == "done" else piece["kind"], None, None)

    pieces.work_through(t.run_results.where("kind <> 'not-attempted'"), work, path, deal=True)
    return pieces.unfinished(t.spark, path)
