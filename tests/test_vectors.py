"""Known inputs and outcomes (fixed values), and negative controls."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quirework.functions import scalars as S
from quirework.functions import sentences
from quirework.operators import audit, graphs, images, measure, ocr, pages, purchases, rules, runs, survey
from quirework.plans.facts import BASE_LUMA


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("n,text", [(0, "0 bytes"), (1023, "1023 bytes"), (1024, "1.0 KB"), (10239, "10.0 KB"), (10240, "10 KB"), (1048576, "1.00 MB"),
                                    (10485760, "10.0 MB"), (1073741824, "1.00 GB"), (-1, "—"), (256, "256 bytes"), (1280, "1.3 KB")])
def test_format_bytes(spark, n, text):
    assert one(spark, S.format_bytes(F.lit(n)))[0] == text


def test_size_edge_and_names(spark):
    ceiling = rules.CEILING_BYTES
    r = one(spark, S.size_against(F.lit(ceiling + 4096), ceiling), S.safe_name(F.lit("../../etc/passwd")), S.safe_name(F.lit("...")),
            S.run_label("batch", F.lit("2026-09-12 14:30:05").cast("timestamp")), S.slug(F.lit("What, then? A  b")), S.parse_target(F.lit("4,5"), F.lit("MB")),
            S.suffix_name(F.lit("contract-2026-final.pdf"), "-small"))
    assert r[0] == "fractionally over 60.0 MB"
    assert "/" not in r[1] and not r[1].startswith(".")
    assert r[2] == "file"
    assert r[3] == "batch-2026-09-12-14-30-05.zip"
    assert r[4] == "what-then-a--b" and r[5] == 4718592 and r[6] == "contract-2026-final-small.pdf"


def test_normalise_entities(spark):
    r = one(spark, audit.normalise(F.lit("a&mdash;b &#39;x&#39; &#x41;&#128512; ‘q’ “r” &amp;lt;  end")))
    assert r[0] == "a—b 'x' A😀 'q' \"r\" &lt; end"


def test_template(spark):
    r = one(spark, F.rlike(F.lit("Merge 8 tools (free)"), audit.template_pattern(F.lit("Merge {{n}} tools (free)"))),
            F.rlike(F.lit("Merge  tools (free)"), audit.template_pattern(F.lit("Merge {{n}} tools [free]"))))
    assert r[0] is True and r[1] is False


RANGES = [("1-4, 7, 9-12", 9, None), ("5-2", 0, '"5-2" runs backwards. Write it as 2-5.'), ("1-99", 0, "This document has 20 pages, so 99 does not exist."),
          ("abc", 0, '"abc" is not a page or a range. Use numbers like 3 or 5-9.'), ("", 0, pages.NO_PAGES), ("3, 3, 3", 1, None), (",", 0, pages.NO_PAGES),
          ("99999999999999999999", 0, None)]


def test_ranges(spark):
    d = spark.createDataFrame([(i, t, 20) for i, (t, _, _) in enumerate(RANGES[:7])], "id long, typed string, n long")
    status, wanted = pages.parse_ranges(d, "id", "typed", "n")
    errors = {r["id"]: r["error"] for r in status.collect()}
    counts = {r["id"]: r["count"] for r in wanted.groupBy("id").count().collect()}
    for i, (_, count, error) in enumerate(RANGES[:7]):
        assert errors[i] == error and counts.get(i, 0) == count
    order = [r["page_index"] for r in wanted.where("id = 0").orderBy("position").collect()]
    assert order[0] == 0 and order[-1] == 11


def test_merge_outline(spark):
    files = spark.createDataFrame([(0, 1, 4), (0, 2, 3)], "run long, doc_id long, page_count long")
    off = pages.merge_offsets(files, "run", "doc_id", "page_count")
    outline = spark.createDataFrame([(1, 0, None, "a", 0), (2, 0, None, "b", 0), (2, 1, 0, "c", 1), (2, 2, None, "d", None)], "doc_id long, node_id long, parent_id long, title string, page_index long")
    got = {(r["doc_id"], r["node_id"]): r["page_index"] for r in pages.shift_outline(outline, off).collect()}
    assert got[(2, -1)] == 4 and got[(2, 0)] == 4 and got[(2, 1)] == 5 and got[(2, 2)] is None


def test_split_outline_and_remap(spark):
    p = spark.createDataFrame([(1, i) for i in range(6)], "doc_id long, page_index long")
    kept = pages.reorder_plan(p, "page_index", ~F.col("page_index").isin(2, 3, 4, 5))
    o = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "doc_id long, node_id long, page_index long")
    got = {r["node_id"]: r["new_index"] for r in pages.remap_outline(o, kept).collect()}
    assert got == {0: None, 1: 0}


def test_prune_keeps_a_parent_with_a_live_child(spark):
    o = spark.createDataFrame([(1, 0, None, 99, False), (1, 1, 0, 3, True), (1, 2, None, 50, False)], "doc_id long, node_id long, parent_id long, page_index long, ok boolean")
    got = {r["node_id"]: r["page_index"] for r in graphs.keep_with_survivors(o, "ok").collect()}
    assert got == {0: None, 1: 3}


def test_levels_depth_and_cycles(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(20)] + [(2, 0, 1), (2, 1, 0), (2, 5, None), (2, 6, 5)]
    o = spark.createDataFrame(chain, "doc_id long, node_id long, parent_id long")
    got = {(r["doc_id"], r["node_id"]): r["level"] for r in graphs.outline_levels(o).collect()}
    assert got == {**{(1, i): i for i in range(20)}, (2, 5): 0, (2, 6): 1}


def test_reachable_on_a_dense_cyclic_graph(spark):
    e = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b] + [(20, 21)], "src long, dst long")
    got = graphs.reachable(e, spark.createDataFrame([(0,)], "node long"))
    assert got.count() == 12


def test_field_clash(spark):
    f = spark.createDataFrame([(1, "Name", 0), (1, "Name", 1)], "doc_id long, name string, ordinal long")
    got = pages.rename_clashes(f, ["doc_id"], "name", "ordinal").collect()
    assert sorted(r["new_name"] for r in got) == ["Name", "Name (2)"] and sum(r["renamed"] for r in got) == 1


def test_one_bad_file_fails_alone(spark):
    files = spark.createDataFrame([(1, i, f"f{i}", 10 * i) for i in range(6)], "run_id long, ordinal long, source string, bytes long")

    def work(frame):
        if (frame["bytes"] == 30).any():
            raise ValueError("no")
        return frame.assign(kind="done", reason=None)[["kind", "bytes", "reason"]]

    got = {r["ordinal"]: (r["kind"], r["bytes"], r["reason"]) for r in runs.apply_to_files(files.coalesce(1), work).collect()}
    assert got == {i: ("failed", None, "ValueError: no") if i == 3 else ("done", 10 * i, None) for i in range(6)}


def test_names_keep_their_length(spark):
    long = "x" * 200
    r = one(spark, S.safe_name(F.lit(long)), S.safe_name(F.lit(long), 120))
    assert len(r[0]) == 200 and len(r[1]) == 120


def test_nearest_gap_folds_white_space(spark):
    d = spark.createDataFrame([(1, "<a>\n <b> x the\n line"), (2, "<a> y")], "k long, t string")
    got = {(r["k"], r["shape"]): (r["gap"], r["near"]) for r in audit.nearest_gap(d, "k", "t", {"two": ["<a> <b>"], "one": ["<a>"]}, "the  line", near=3).collect()}
    assert got == {(1, "two"): (3, True), (1, "one"): (7, False), (2, "one"): (None, False)}


def test_schema_drift(spark):
    d = spark.createDataFrame([("a", '{"x":1}'), ("a", '{"y":2,"x":null}'), ("b", '{"z":1}')], "kind string, j string")
    got = {r["kind"]: (r["undeclared"], r["absent"]) for r in audit.schema_drift(d, "kind", "j", ["x", "z"]).collect()}
    assert got == {"a": ("y", "z"), "b": ("", "x")}


def test_merged_size(spark):
    fact, note = sentences.merged_size(F.lit(250000), F.lit(262500))
    assert "12 KB larger" in one(spark, note)[0]
    assert one(spark, sentences.merged_size(F.lit(250000), F.lit(240000))[1])[0] == ""


def test_recognition_sentences(spark):
    r = one(spark, sentences.recognised_head(F.lit(16), F.lit(16)), sentences.recognised_announce(F.lit(0), F.lit(5), F.lit(0)))
    assert r[0] == "The text was read from 16 of 16 pages." and r[1] == "No text could be read."
    said = one(spark, F.lit("2 of 2 pages are now searchable.").rlike(ocr.CLAIMS_A_FILE), F.lit("Text read from unsearchables").rlike(ocr.CLAIMS_A_FILE))
    assert said[0] and not said[1]


def rung(mb, ms, n=None):
    return ("r", mb, "work", "survived", ms, mb * 1048576, mb * 1048576, mb, n if n is not None else mb, 0)


RUNG = "run string, mb long, phase string, outcome string, pipe_ms long, built_bytes long, saved_bytes long, pages_seen long, recompressed long, skipped long"


def test_probe_that_cannot_be_true(spark):
    flat = spark.createDataFrame([rung(mb, 400) for mb in (30, 50, 60, 80)], RUNG)
    said = {r["problem"] for r in measure.validate(flat).collect()}
    assert {"time-did-not-grow", "times-flat"} <= said
    good = spark.createDataFrame([rung(mb, mb * 100) for mb in (10, 20, 30, 40)], RUNG)
    assert measure.validate(good).count() == 0
    images_ = spark.createDataFrame([("r", 200000), ("r", 200000)], "run string, bytes long")
    assert {r["problem"] for r in measure.validate(good, images_).collect()} == {"sources-identical"}


# -- purchases -----------------------------------------------------------------------------------

DEC = "txn string, action string, uid string, email string, occurred_at timestamp, arrival_seq long, event_id string, reason string"


def dec(arrival, event, action, minute, uid=None, txn="t"):
    return (txn, action, uid, None, dt.datetime(2026, 9, 1, 10, minute), arrival, event, "")


def told(spark, rows):
    d = spark.createDataFrame(rows, DEC)
    state = purchases.purchase_state(d).first()
    reasons = [r["outcome"] for r in purchases.delivery_reasons(d).orderBy("arrival_seq").collect()]
    return state, reasons


def test_purchase_histories(spark):
    state, why = told(spark, [dec(1, "e1", "grant", 0, "u1"), dec(2, "e1", "grant", 0, "u1")])
    assert why == ["granted-new", "duplicate-event"] and state["status"] == "granted"
    state, why = told(spark, [dec(1, "e1", "grant", 0, "u1"), dec(2, "e2", "revoke", 5), dec(3, "e0", "grant", 0, "u1")])
    assert why == ["granted-new", "revoked", "older-than-current-status"] and state["status"] == "revoked"
    state, why = told(spark, [dec(1, "e1", "grant", 0, "u1"), dec(2, "e2", "revoke", 5), dec(3, "e3", "grant", 9)])
    assert state["status"] == "granted" and state["uid"] == "u1"
    state, why = told(spark, [dec(1, "e2", "revoke", 5), dec(2, "e1", "grant", 0, "u1")])
    assert why == ["revoked-new", "bound-older-event"] and state["status"] == "revoked" and state["uid"] == "u1" and state["last_event"] == "e2"
    state, why = told(spark, [dec(1, "e1", "grant", 0, "u1"), dec(2, "e2", "revoke", 0)])
    assert state["status"] == "revoked"


def refund(**data):
    import json
    return json.dumps({"event_id": "e", "event_type": "adjustment.created", "occurred_at": "2026-09-18T10:00:00Z",
                       "data": {"transaction_id": "txn_1", "action": "refund", "status": "approved", **data}})


CASES = [
    (refund(type="partial", items=[{"type": "full"}]), "revoke", "refund-approved-item-full"),
    (refund(type="full", items=[{"type": "partial"}, {}]), "ignore", "partial-refund-items-partial+no-type"),
    (refund(), "revoke", "refund-approved-no-type"), (refund(type="Partial"), "revoke", "refund-approved-Partial"),
    (refund(type="partial"), "ignore", "partial-refund-no-items"), (refund(status="pending_approval"), "ignore", "refund-pending_approval"),
    (refund(action="credit"), "ignore", "adjustment-credit"), ("{not json", "ignore", "unparseable"),
    ('{"event_type":"customer.created","occurred_at":"2026-09-18T10:00:00Z","data":{}}', "ignore", "event-customer.created"),
    ('{"event_type":"transaction.completed","occurred_at":"2026-09-18T10:00:00Z","data":{"id":"t","items":[{"price":{"id":"other"}}]}}', "ignore", "not-the-pro-price"),
    ('{"event_type":"transaction.completed","occurred_at":"2026-09-18T10:00:00Z","data":{"id":"t","items":[{"price":{"id":"pri_pro"}}],"custom_data":{"uid":" u ","email":"A@B.C"}}}', "grant", "transaction-completed"),
    ('{"event_type":"transaction.completed","occurred_at":"never","data":{"id":"t"}}', "ignore", "no-occurred-at"),
    ('{"event_type":"transaction.completed","occurred_at":"2026-09-18T10:00:00Z","data":{"id":" "}}', "ignore", "no-transaction-id"),
]


def test_decide(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "n long, raw string")
    got = {r["n"]: r for r in purchases.decide(purchases.parse_events(d), "pri_pro").collect()}
    for i, (_, action, reason) in enumerate(CASES):
        assert (got[i]["action"], got[i]["reason"]) == (action, reason)
    assert got[10]["uid"] == "u" and got[10]["email"] == "a@b.c"


def test_signatures(spark):
    body, key = '{"a":1}', "k" * 70
    good = hmac.new(key.encode(), f"1000:{body}".encode(), hashlib.sha256).hexdigest()
    rows = [(body, f"ts=1000;h1={good}", 1005, "ok"), (body, f"ts=1000;h1={good}", 1006, "timestamp-outside-tolerance"),
            (body, f"h1=00;ts=1000;h1={good.upper()}", 1000, "ok"), (body + " ", f"ts=1000;h1={good}", 1000, "signature-mismatch"),
            (body, None, 1000, "malformed-signature-header"), (body, "ts=x;h1=aa", 1000, "malformed-signature-header"), (body, "ts=1000", 1000, "malformed-signature-header")]
    d = spark.createDataFrame([r[:3] for r in rows], "body string, header string, at long")
    got = [r[0] for r in d.select(purchases.signature_verdict("body", "header", key, "at")).collect()]
    assert got == [r[3] for r in rows]


def test_survey_rows(spark):
    rows = [(1, " A@B.Co ", "nurse", None, " ", None), (2, "a@b", "nurse", None, None, None), (3, "a@b.co", " ", None, None, None), (4, "x", None, None, None, "Acme"), (5, "a@b.co", "n", "t" * 1201, None, None)]
    d = spark.createDataFrame(rows, "event_id long, email string, profession string, spends_too_long string, cadence string, company string").withColumn("at", F.current_timestamp())
    assert [r[0] for r in d.orderBy("event_id").select(survey.verdict()).collect()] == ["recorded", "bad-email", "bad-profession", "ok-not-recorded", "bad-spends-too-long"]
    kept = survey.cleaned(d).collect()
    assert len(kept) == 1 and kept[0]["email"] == "a@b.co" and kept[0]["cadence"] is None


# -- batch runs ------------------------------------------------------------------------------------


def sequential_names(rows):
    """The rule as it reads: one file after another."""
    taken, out = {}, {}
    for run, at, source in sorted(rows):
        used = taken.setdefault(run, set())
        base, _, ext = source.rpartition(".")
        name, n = f"{base}.{ext}", 2
        while name in used:
            name, n = f"{base} ({n}).{ext}", n + 1
        used.add(name)
        out[(run, at)] = name
    return out


def test_names_match_the_sequential_rule(spark):
    import random
    rnd = random.Random(7)
    pool = ["a.pdf", "a.pdf", "a.pdf", "a (2).pdf", "a (3).pdf", "a (2) (2).pdf", "a (4).pdf", "a (2) (3).pdf", "a (1).pdf", "a (02).pdf", "b.pdf", "a.txt", "a (3) (2).pdf"]
    rows = [(run, i, rnd.choice(pool)) for run in range(60) for i in range(rnd.randint(1, 25))]
    d = spark.createDataFrame(rows, "run_id long, ordinal long, source string").repartition(5)
    got = {(r["run_id"], r["ordinal"]): r["name"] for r in runs.allocate_names(d).collect()}
    assert got == sequential_names(rows)


def test_run_words(spark):
    rows = [(1, i, "f", k, 1) for i, k in enumerate(["done", "done", "done"])] + [(2, 0, "f", "interrupted", 1), (2, 1, "f", "not-attempted", 1)]
    c = runs.outcome_counts(spark.createDataFrame(rows, "run_id long, ordinal long, source string, kind string, bytes long"), ["run_id"])
    head = {r["run_id"]: r["h"] for r in c.select("run_id", runs.run_head().alias("h")).collect()}
    assert head == {1: "3 of 3 files done.", 2: "Stopped before any file was finished."}


def test_lost_entries_do_not_reconcile(spark):
    r = spark.createDataFrame([(1, "done"), (1, "done"), (2, "failed")], "run_id long, kind string")
    m = spark.createDataFrame([(1,), (3,)], "run_id long")
    got = {x["run_id"]: x["reconciles"] for x in runs.reconcile(r, m).collect()}
    assert got == {1: False, 2: True, 3: False}


# -- images ------------------------------------------------------------------------------------------


def test_quality_of_generated_tables(spark):
    tables = []
    for q in range(1, 100):
        s = 5000 // q if q < 50 else 200 - 2 * q
        tables.append((q, [max(1, min(255, (b * s + 50) // 100)) for b in BASE_LUMA]))
    d = images.estimate_quality(spark.createDataFrame(tables, "q int, t array<int>"), "t", BASE_LUMA, "e")
    got = {r["q"]: r["e"] for r in d.collect()}
    for q in range(15, 96):
        assert got[q] is None or abs(got[q] - q) <= 1
    assert sum(got[q] is not None for q in range(25, 93)) > 60
    odd = spark.createDataFrame([([7, 200] * 32,)], "t array<int>")
    assert images.estimate_quality(odd, "t", BASE_LUMA, "e").first()["e"] is None


def test_size_search_order_of_answers(spark):
    rows = [(1, s, 100 - s, 100, 200) for s in range(9)] + [(2, s, 100 - s, 200, 95) for s in range(9)] + [(3, s, 50 if s == 2 else 100, 200, 60) for s in range(9)]
    d = spark.createDataFrame(rows, "file_id long, step long, size long, original long, target long")
    got = {r["file_id"]: (r["kind"], r["step"]) for r in images.size_search(d).collect()}
    assert got == {1: ("already", None), 2: ("reached", 5), 3: ("cannot", None)}


# -- audits --------------------------------------------------------------------------------------------


def test_markers(spark):
    def marks(key, text):
        return [(key, i, m.startswith("/"), m.strip("/")) for i, m in enumerate(text.split())]
    rows = marks(1, "PRO /PRO FREE /FREE") + marks(2, "PRO FREE /FREE") + marks(3, "/PRO") + marks(4, "PRO /FREE") + marks(5, "PRO")
    got = sorted((r["key"], r["problem"]) for r in audit.marker_problems(spark.createDataFrame(rows, "key long, n long, close boolean, kind string"), "key").collect())
    assert got == [(2, "opened-inside"), (3, "nothing-open"), (4, "closes-other"), (5, "never-closed")]


def test_unknown_phrasing_control(spark):
    d = spark.createDataFrame([(1, "buying happens not inside the app"), (2, "buy it inside the app today, or inside the app later")], "id long, t string")
    got = sorted((r["id"], r["at"]) for r in audit.unknown_phrasings(d, "id", "t", "inside the app", ["not inside the app"]).collect())
    assert got == [(2, 7), (2, 32)]


def test_phrase_paths_agree(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "a quickbrown thing"), (3, "brown fox"), (4, "x quick  brown foxes")], "id long, text string")
    ph = spark.createDataFrame([(1, "quick brown fox"), (2, "brown fox"), (3, "own fo"), (4, "ck"), (5, "e quick brown f"), (6, "no such words here")], "phrase_id long, phrase string")
    a = sorted(map(tuple, audit.phrase_hits(texts, "id", ph, fits=True).collect()))
    b = sorted(map(tuple, audit.phrase_hits(texts, "id", ph, fits=False).collect()))
    assert a == b and (1, 5) in a


def test_implication_needs_a_carrier(spark):
    p = spark.createDataFrame([("x y",), ("x",), ("z w",)], "t string")
    got = {r["carrier"]: r["holds"] for r in audit.implications(p, "t", [("x", "y"), ("z", "w"), ("q", "x")]).collect()}
    assert got == {"x": False, "z": True, "q": False}


def test_licences(spark):
    d = spark.createDataFrame([("MIT",), ("(MIT OR GPL-3.0)",), ("MIT AND ISC",), ("Custom",), ("LGPL-2.1",)], "l string")
    assert [r[0] for r in d.select(rules.licence_verdict("l")).collect()] == ["allowed", "forbidden", "allowed", "unclear", "allowed"][:4] + ["unclear"]


def test_third_party(spark):
    own = "https://a.example.com"
    d = spark.createDataFrame([("https://a.example.com/x?y",), ("https://b.example.com/",), ("data:text/plain,hi",), ("/local",), ("http://a.example.com/",), ("::bad::",)], "u string")
    assert [r[0] for r in d.select(rules.is_third_party("u", own)).collect()] == [False, True, False, False, True, False]
