"""The same facts tables in DuckDB SQL, used only to check results."""

from __future__ import annotations

import re

from .facts import BASE_LUMA


def choose(index: str, values: list) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


_PAGES = "cast(greatest(1, ceil(length(text) / 1000.0)) as bigint)"

FACTS = {
    "doc_page_index": f"SELECT doc_id, {_PAGES} AS page_count, unnest(range(0, {_PAGES})) AS page_index FROM documents",
    "doc_pages": f"""SELECT doc_id, page_count, page_index, substr(text, page_index * 1000 + 1, 1000) AS text FROM (
        SELECT doc_id, text, {_PAGES} AS page_count, unnest(range(0, {_PAGES})) AS page_index FROM documents)""",
    "layer_pages": "SELECT * FROM doc_pages WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "words": r"""SELECT doc_id, page_index, ordinal, word, (length(word) * 17 + ordinal * 7) % 101 AS confidence,
        (ordinal % 10) * 50 AS x0, (ordinal // 10) * 30 AS y0, (ordinal % 10) * 50 + length(word) * 4 AS x1,
        (ordinal // 10) * 30 + (ordinal % 7) * 4 AS y1
        FROM (SELECT doc_id, page_index, unnest(ws) AS word, unnest(range(0, len(ws))) AS ordinal
              FROM (SELECT doc_id, page_index, regexp_split_to_array(text, '[^\p{L}]+') AS ws FROM doc_pages))""",
    "files": f"""SELECT p_partkey AS file_id,
        replace(p_name, ' ', '-') || '.' || {choose('p_partkey % 8', ["pdf", "docx", "xlsx", "odt", "epub", "doc", "xls", "bin"])} AS name,
        cast(CASE WHEN p_partkey % 41 = 0 THEN 0 ELSE floor(p_retailprice * 64000) END AS bigint) AS size,
        {choose('p_partkey % 9', ["255044462D312E37", "504B030414000600", "D0CF11E0A1B11AE1", "FFD8FFE000104A46", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "7B226B", "00010203"])} AS head_hex,
        {choose('p_partkey % 10', ["PasswordException", "InvalidPDFException", "RangeError", "QuotaExceededError"] + ["Error"] * 6)} AS error_name,
        cast(p_size % 3 AS bigint) AS error_code,
        {choose('p_partkey % 9', ["Input document is encrypted", "No PDF header found", "Failed to parse PDF document", "Expected instance of PDFDict", "Unbalanced parenthesis", "Expected object number", "the parser stalled", "something else", "Failed to parse PDF document: it is encrypted"])} AS error_message
        FROM part""",
    "file_pages": f"""SELECT l_orderkey AS doc_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS page_index,
        cast({choose('l_linenumber % 5', [595, 842, 612, 612, 420])} AS double) AS width_pt,
        cast({choose('l_linenumber % 5', [842, 595, 792, 1008, 595])} AS double) AS height_pt,
        90 * (l_partkey % 4) AS rotation FROM lineitem""",
    "placements": """SELECT l_suppkey AS doc_id, l_partkey AS image_key, cast(l_linenumber AS bigint) AS page_index,
        l_quantity * 8 AS a, 0.0::double AS b, 0.0::double AS c, l_quantity * 10 AS d FROM lineitem WHERE l_returnflag <> 'R'""",
    "masks": """SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS image_key FROM lineitem
        WHERE l_linestatus = 'O' AND l_returnflag = 'A' AND l_quantity <= 3""",
    "images": f"""SELECT doc_id, image_key, ordinal, encoded_bytes,
        cast(CASE WHEN image_key % 19 = 0 THEN 0 ELSE p_size * 60 END AS bigint) AS width, cast(p_size * 80 AS bigint) AS height,
        cast(CASE WHEN image_key % 11 = 0 THEN 1 WHEN image_key % 23 = 0 THEN 16 ELSE 8 END AS bigint) AS bpc,
        image_key % 29 = 0 AS is_mask,
        CASE WHEN image_key % 31 = 0 THEN ['FlateDecode', 'DCTDecode'] WHEN image_key % 7 = 5 THEN [] ELSE
          [{choose('image_key % 7', ["DCTDecode", "FlateDecode", "JBIG2Decode", "JPXDecode", "CCITTFaxDecode", "", "ASCII85Decode"])}] END AS filters,
        {choose('image_key % 6', ["DeviceRGB", "DeviceGray", "Indexed", "ICCBased", "DeviceCMYK"])} AS color_space,
        CASE WHEN image_key % 7 = 0 AND image_key % 5 <> 0 THEN image_key % 101 END AS quality
        FROM (SELECT l_suppkey AS doc_id, l_partkey AS image_key, cast(max(floor(l_extendedprice)) AS bigint) AS encoded_bytes,
              min(l_orderkey) AS ordinal FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = image_key""",
    "fonts": "SELECT l_suppkey AS doc_id, l_partkey % 40 AS font_ref, (l_partkey % 40) * 1000 + l_suppkey AS font_bytes FROM lineitem",
    "quant_tables": f"""SELECT vec_id, 'free' AS origin, cast(NULL AS integer) AS made_at,
        list_transform(embedding, lambda x: cast(floor(abs(x::double) * 200.0) AS integer) % 254 + 1) AS tbl FROM embeddings
        UNION ALL SELECT vec_id, 'scaled', q, list_transform({BASE_LUMA}, lambda b: least(255, greatest(1, (b * (CASE WHEN q < 50 THEN 5000 // q ELSE 200 - q * 2 END) + 50) // 100)))
        FROM (SELECT vec_id, cast(vec_id % 99 + 1 AS integer) AS q FROM embeddings)""",
    "size_measurements": f"""SELECT file_id, step, cast(floor(price * 1024.0 * (100 - (CASE WHEN file_id % 9 = 0 AND step = 3 THEN 4 WHEN file_id % 9 = 0 AND step = 4 THEN 3 ELSE step END) * 8) / 100.0) AS bigint) AS size,
        cast(floor(price * 1024.0) AS bigint) AS original,
        cast(floor(price * 1024.0 * cast({choose('file_id % 4', [110, 60, 40, 33])} AS double) / 100.0) AS bigint) AS target
        FROM (SELECT p_partkey AS file_id, p_retailprice AS price, unnest(range(0, 9)) AS step FROM part)""",
    "outline": """SELECT conv_id AS doc_id, turn AS node_id,
        CASE WHEN role = 'assistant' THEN turn - 1 WHEN role = 'user' AND turn % 4 = 2 THEN turn - 2 END AS parent_id,
        turn AS ordinal, split_part(text, chr(10), 1) AS title, CASE WHEN turn % 5 <> 4 THEN turn * 2 END AS page_index, role FROM conversations""",
    "outline_docs": "SELECT conv_id AS doc_id, count(*) * 2 - 2 AS page_count FROM conversations GROUP BY 1",
    "outline_pages": "SELECT doc_id, page_count, unnest(range(0, page_count)) AS page_index FROM outline_docs WHERE page_count > 0",
    "run_results": """SELECT user_id AS run_id, event_id AS ordinal, event_type || CASE WHEN event_id % 37 = 0 THEN ' (2).pdf' ELSE '.pdf' END AS source,
        CASE WHEN value < 5 THEN 'failed' WHEN value < 10 THEN 'left-alone' WHEN value < 11 THEN 'interrupted' WHEN value < 12 THEN 'not-attempted' ELSE 'done' END AS kind,
        cast(floor(value * 1000) AS bigint) AS bytes FROM events""",
    "purchase_fields": """SELECT event_id, event_id * 7919 % 1000003 + event_id // 1000003 * 1000003 AS arrival_seq, ts, user_id,
        CASE WHEN event_type = 'purchase' THEN 'transaction.completed' WHEN event_type = 'signup' THEN 'adjustment.updated'
             WHEN event_type = 'view' AND event_id % 2 = 1 THEN 'customer.created' ELSE 'adjustment.created' END AS event_type,
        NOT (event_id % 61 = 0 OR event_id % 67 = 0) AS has_time, event_id % 29 = 0 AS broken,
        CASE WHEN event_id % 53 <> 0 THEN 'txn_' || user_id END AS txn,
        CASE WHEN event_type IN ('error', 'signup') THEN 'refund' WHEN event_type = 'click' AND value < 20 THEN 'chargeback'
             WHEN event_type = 'click' THEN 'chargeback_reverse' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'credit' END AS action,
        CASE WHEN event_type = 'signup' THEN 'pending_approval' WHEN event_type = 'click' AND event_id % 5 = 0 THEN CASE WHEN value < 20 THEN 'reversed' ELSE 'rejected' END
             WHEN event_type <> 'purchase' THEN 'approved' END AS status,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 <> 0 OR event_id % 3 = 0 THEN 'partial' WHEN event_id % 3 = 1 THEN 'full' END END AS kind,
        CASE WHEN event_type = 'error' AND event_id % 7 <> 0 THEN CASE WHEN value < 20 THEN 'full' ELSE 'partial' END END AS item_type,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 23 = 0 THEN 'pri_other' ELSE 'pri_pro' END END AS price_id,
        CASE WHEN event_type = 'purchase' AND event_id % 10 <> 0 THEN 'u' || user_id END AS uid,
        CASE WHEN event_type = 'purchase' THEN 'u' || user_id || '@example.com' END AS email FROM events""",
    "decisions": """SELECT event_id, arrival_seq, ts, action, txn, uid, email, reason FROM (
        SELECT event_id, arrival_seq, ts, txn, CASE split_part(verdict, ':', 1) WHEN 'G' THEN 'grant' WHEN 'R' THEN 'revoke' ELSE 'ignore' END AS action,
          split_part(verdict, ':', 2) AS reason, CASE WHEN verdict = 'G:transaction-completed' THEN uid END AS uid,
          CASE WHEN verdict = 'G:transaction-completed' THEN email END AS email
        FROM (SELECT *, CASE
          WHEN broken THEN 'I:unparseable'
          WHEN NOT has_time THEN 'I:no-occurred-at'
          WHEN event_type = 'customer.created' THEN 'I:event-customer.created'
          WHEN txn IS NULL THEN 'I:no-transaction-id'
          WHEN event_type = 'transaction.completed' THEN CASE WHEN price_id = 'pri_pro' THEN 'G:transaction-completed' ELSE 'I:not-the-pro-price' END
          WHEN action = 'refund' AND status <> 'approved' THEN 'I:refund-' || status
          WHEN action = 'refund' AND item_type IS NOT NULL THEN CASE WHEN item_type = 'full' THEN 'R:refund-approved-item-full' ELSE 'I:partial-refund-items-' || item_type END
          WHEN action = 'refund' THEN CASE WHEN kind = 'partial' THEN 'I:partial-refund-no-items' ELSE 'R:refund-approved-' || coalesce(kind, 'no-type') END
          WHEN action = 'chargeback' THEN CASE WHEN status = 'reversed' THEN 'I:chargeback-reversed' ELSE 'R:chargeback' END
          WHEN action = 'chargeback_reverse' THEN CASE WHEN status = 'rejected' THEN 'I:chargeback-reverse-rejected' ELSE 'G:chargeback-reversed' END
          ELSE 'I:adjustment-' || action END AS verdict FROM purchase_fields))""",
    "purchases": """SELECT txn, max_by(CASE action WHEN 'grant' THEN 'granted' ELSE 'revoked' END, (ts, arrival_seq)) AS status,
        min_by(uid, arrival_seq) FILTER (uid IS NOT NULL) AS uid, min_by(email, arrival_seq) FILTER (email IS NOT NULL) AS email,
        max(ts) AS changed_at, max_by(event_id, (ts, arrival_seq)) AS last_event
        FROM decisions WHERE action <> 'ignore' GROUP BY txn""",
    "survey": f"""SELECT event_id, ts AS moment, ' U' || user_id || CASE WHEN event_id % 33 = 0 THEN '@bad ' ELSE '@Example.com ' END AS email,
        {choose('k % 6', [" ", "lawyer", "accountant", "architect", "teacher", "nurse "])} AS profession,
        CASE WHEN k % 4 <> 0 THEN 'task ' || k END AS spends_too_long,
        CASE WHEN k % 7 = 0 THEN repeat('x', 201) WHEN k % 3 = 0 THEN 'weekly' END AS cadence,
        CASE WHEN k % 25 = 0 THEN 'Acme' ELSE ' ' END AS company
        FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE event_type = 'signup')""",
    "survey_checked": """SELECT *, CASE WHEN trim(company) <> '' THEN 'ok-not-recorded'
        WHEN NOT regexp_full_match(trim(email), '[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}') OR length(trim(email)) > 254 THEN 'bad-email'
        WHEN trim(profession) = '' OR length(trim(profession)) > 200 THEN 'bad-profession'
        WHEN length(trim(coalesce(spends_too_long, ''))) > 1200 THEN 'bad-spends-too-long'
        WHEN length(trim(coalesce(cadence, ''))) > 200 THEN 'bad-cadence' ELSE 'recorded' END AS verdict FROM survey""",
    "requests": f"""SELECT event_id, user_id AS session, ts AS moment, {choose('event_id % 3', ["arrival", "open", "pay"])} AS phase, url,
        event_type AS rtype, cast(CASE WHEN event_id % 50 = 0 THEN -1 ELSE floor(value * 100) END AS bigint) AS bytes,
        CASE WHEN event_type = 'error' THEN 'policy' END AS blocked,
        split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host
        FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)""",
    "rungs": """SELECT run, mb, phase, CASE WHEN k % 29 = 0 THEN 'threw' WHEN k % 31 = 0 THEN 'started' ELSE 'survived' END AS outcome,
        cast(CASE WHEN k % 37 = 0 THEN 10 WHEN num % 3 = 0 THEN mb * 400 ELSE floor(price * 10) END AS bigint) AS pipe_ms, built AS built_bytes,
        CASE WHEN k % 47 = 0 THEN built // 3 ELSE built END AS saved_bytes, CASE WHEN k % 59 = 0 THEN 0 ELSE mb END AS pages_seen,
        CASE WHEN k % 13 = 0 THEN 0 WHEN num % 2 = 0 THEN 6 ELSE mb END AS recompressed, k % 5 AS skipped
        FROM (SELECT *, cast(CASE WHEN k % 43 = 0 THEN NULL WHEN k % 19 = 0 THEN mb * 524288 ELSE mb * 1048576 END AS bigint) AS built FROM (
          SELECT p_brand AS run, cast(p_size AS bigint) AS mb, min(p_partkey) AS k, min_by(p_retailprice, p_partkey) AS price,
          min_by(p_type, p_partkey) AS phase, cast(regexp_extract(p_brand, '(\\d+)$', 1) AS bigint) AS num FROM part GROUP BY p_brand, p_size))""",
    "packages": f"""SELECT p_name || '-' || p_partkey AS name, '1.' || p_size AS version,
        {choose('p_partkey % 7', ["MIT", "Apache-2.0", "(MIT OR GPL-3.0)", "GPL-3.0", "AGPL-3.0-only", "BSD-3-Clause", "Custom"])} AS licence FROM part""",
    "stages": """SELECT p_brand AS run, p_partkey AS rung, unnest(['parse', 'analyse', 'recompress', 'save']) AS stage,
        unnest([p_size::bigint * 3 + 1, p_partkey % 50 + 1, p_size::bigint * 20 + 7, p_partkey % 90 + 2]) AS ms FROM part""",
    "edges": """SELECT src, dst FROM (SELECT page_id AS src, page_id * 2 + 1 AS dst FROM pages UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages
        UNION ALL SELECT page_id, page_id + 7 FROM pages WHERE page_id % 25 = 0) WHERE dst IN (SELECT page_id FROM pages)""",
    "stash_events": """SELECT event_id, user_id AS owner, ts AS moment, CASE event_type WHEN 'view' THEN 'stash' WHEN 'click' THEN 'claim'
        WHEN 'purchase' THEN 'pending' WHEN 'error' THEN 'confirm' ELSE 'other' END AS what FROM events""",
}


def with_facts(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the facts it names, in dependency order."""
    known = {**FACTS, **(extra or {})}
    order: list[str] = []

    def visit(text: str):
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH RECURSIVE {ctes}" + (f",\n{sql[own.end():]}" if own else f"\n{sql}")
