"""Streams over the event files, drained to their end and read back (§I)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measure, purchases, survey
from ..operators.rules import is_third_party
from ..session import cut_lineage, run_path
from ..sources import scans
from ..streaming import flows, keyed
from .catalog_aggs import EGRESS, STORED
from .catalog_rules import decisions
from .catalog_sources import OWN
from .facts import Tables
from .registry import query


class StreamTables(Tables):
    """The same facts tables with the events arriving as a stream of files."""

    @cached_property
    def events(self) -> DataFrame:
        path = f"{self.folder}/events.parquet"
        return scans.event_files(self.spark, path, self.spark.read.parquet(path).schema)


def live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


REASONS = """x AS (SELECT *, max((epoch_us(ts), arrival_seq, event_id)) OVER w AS st, count(uid) OVER w AS uids, count(email) OVER w AS emails FROM decisions WHERE action <> 'ignore'
    WINDOW w AS (PARTITION BY txn ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  said AS (SELECT txn, event_id, CASE WHEN st IS NULL THEN CASE action WHEN 'grant' THEN 'granted-new' ELSE 'revoked-new' END WHEN epoch_us(ts) >= st[1] THEN CASE action WHEN 'grant' THEN 'granted' ELSE 'revoked' END
    WHEN (uid IS NOT NULL AND uids = 0) OR (email IS NOT NULL AND emails = 0) THEN 'bound-older-event' ELSE 'older-than-current-status' END AS outcome FROM x)"""


@query("q_i01_delivery_reasons", f"WITH {REASONS} SELECT * FROM said")
def _(t):
    return purchases.delivery_reasons(decisions(t)).select("txn", "event_id", "outcome")


@query("q_i01_stream_status", "SELECT txn, status, uid, email, last_event FROM purchases")
def _(t):
    path = run_path(t.spark, "status")
    flows.drain(flows.purchase_status(decisions(live(t))), flows.append_batches(path), run_path(t.spark, "cp"))
    return flows.latest_rows(t.spark, path, ["txn"]).select("txn", "status", "uid", "email", "last_event")


@query("q_i01_stream_ledger", f"WITH {REASONS} SELECT * FROM said")
def _(t):
    out, checkpoint = run_path(t.spark, "ledger"), run_path(t.spark, "cp")
    keyed.ledger(decisions(live(t)), out, checkpoint)
    return keyed.ledger_view(t.spark, out, checkpoint)


@query("q_i02_stream_upsert", "SELECT txn, status, uid, email, last_event FROM purchases")
def _(t):
    checkpoint = run_path(t.spark, "cp")
    flows.keep_in_state(flows.purchase_status(decisions(live(t))), checkpoint)
    return flows.stored_purchases(t.spark, checkpoint).select("txn", "status", "uid", "email", "last_event")


@query("q_i03_once_per_event", "SELECT action, count(*) AS events, sum(event_id)::bigint AS id_sum FROM decisions WHERE reason NOT IN ('unparseable', 'no-occurred-at') GROUP BY 1")
def _(t):
    """Every delivery sent twice, each event acted on once."""
    d = decisions(live(t)).where("occurred_at is not null").select("event_id", "action", "occurred_at", "reason").where("reason <> 'unparseable'")
    path = run_path(t.spark, "once")
    flows.drain(flows.once_per_event(d.unionByName(d), "event_id"), flows.append_batches(path), run_path(t.spark, "cp"), "append")
    return t.spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("events"), F.sum("event_id").alias("id_sum"))


@query("q_i04_stream_answers", f"WITH {STORED} SELECT email, profession FROM stored")
def _(t):
    checkpoint = run_path(t.spark, "cp")
    flows.keep_in_state(survey.latest_answers(survey.cleaned(live(t).survey)), checkpoint)
    return flows.stored_answers(t.spark, checkpoint).select("email", "profession")


@query("q_i05_stream_egress", f"SELECT session, sent_bytes, sends, unmeasured, third_party_urls = 0 AS clean, third_party_urls AS third_party_about FROM ({EGRESS})")
def _(t):
    """No session here has more URLs than a sketch counts exactly."""
    path = run_path(t.spark, "egress")
    flows.drain(flows.egress_counter(live(t).requests, OWN), flows.append_batches(path), run_path(t.spark, "cp"))
    about = flows.distinct_about("third_party").alias("third_party_about")
    return flows.latest_rows(t.spark, path, ["session"]).select("session", "sent_bytes", "sends", "unmeasured", "clean", about)


@query("q_i05_stream_sketches", f"""WITH u AS (SELECT DISTINCT phase, url FROM requests WHERE split_part(url, '://', 1) || '://' || host <> '{OWN}')
  SELECT a.phase, b.phase AS other, count(DISTINCT a.url) AS urls, true AS close FROM u a JOIN u b ON a.url = b.url AND a.phase <= b.phase GROUP BY 1, 2""")
def _(t):
    """Sketches kept per session and phase, merged over sessions, intersected over phases, against the exact counts."""
    path = run_path(t.spark, "sketches")
    flows.drain(flows.third_party_sketches(live(t).requests, OWN), flows.append_batches(path), run_path(t.spark, "cp"))
    phases = cut_lineage(flows.united(flows.latest_rows(t.spark, path, ["session", "phase"]), ["phase"]))  # three rows
    urls = t.requests.where(is_third_party("url", OWN)).select("phase", "url").distinct()
    exact = urls.join(urls.withColumnRenamed("phase", "other"), "url").where("phase <= other").groupBy("phase", "other").agg(F.count("*").alias("urls"))
    seen = urls.agg(F.count_distinct("url")).scalar()
    two = exact.join(phases, "phase").join(phases.select(F.col("phase").alias("other"), F.col("third_party").alias("second")), "other")
    return two.select("phase", "other", "urls", flows.close_enough(flows.shared_about("third_party", "second"), F.col("urls"), seen).alias("close"))


@query("q_i05_stream_third_party", f"SELECT session, third_party_urls FROM ({EGRESS}) WHERE third_party_urls > 0")
def _(t):
    path = run_path(t.spark, "urls")
    flows.drain(flows.third_party_urls(live(t).requests, OWN), flows.append_batches(path), run_path(t.spark, "cp"))
    return flows.latest_rows(t.spark, path, ["session", "url"]).groupBy("session").agg(F.count("*").alias("third_party_urls"))


CLAIMS = """a AS (SELECT *, epoch_us(moment) AS us, max(CASE WHEN what NOT IN ('stash', 'claim') THEN epoch_us(moment) END) OVER (PARTITION BY owner ORDER BY moment, event_id) AS swept FROM stash_events),
  b AS (SELECT *, lag(what) OVER w AS pw, lag(us) OVER w AS pu, lag(event_id) OVER w AS pe FROM a WHERE what IN ('stash', 'claim') WINDOW w AS (PARTITION BY owner ORDER BY us, event_id)),
  c AS (SELECT owner, event_id, CASE WHEN coalesce(pw, '') <> 'stash' THEN 'nothing' WHEN us - pu <= 600000000 THEN 'taken' WHEN swept - pu > 600000000 THEN 'nothing' ELSE 'expired' END AS outcome, pe FROM b WHERE what = 'claim')"""


@query("q_i06_stash_claims", f"WITH {CLAIMS} SELECT owner, event_id, outcome, CASE WHEN outcome = 'taken' THEN pe END AS stashed FROM c")
def _(t):
    return flows.stash_outcomes(t.stash_events)


@query("q_i06_stream_claims", f"WITH {CLAIMS} SELECT owner, event_id, outcome, CASE WHEN outcome = 'taken' THEN pe END AS stashed FROM c")
def _(t):
    out, checkpoint = run_path(t.spark, "claims"), run_path(t.spark, "cp")
    keyed.claims(live(t).stash_events, out, checkpoint)
    return keyed.claims_view(t.spark, out, checkpoint)


NOTES = """a AS (SELECT *, epoch_us(moment) AS us FROM stash_events), m AS (SELECT max(us) - 3600000000 AS now FROM a),
  b AS (SELECT *, lead(what) OVER w AS nw, lead(us) OVER w AS nu FROM a WHERE what IN ('pending', 'confirm') WINDOW w AS (PARTITION BY owner ORDER BY us, event_id)),
  c AS (SELECT owner, event_id, CASE WHEN us > (SELECT now FROM m) + 60000000 THEN 'refused' WHEN coalesce(nu, (SELECT now FROM m)) - us >= 86400000000 THEN 'expired' WHEN nw = 'confirm' THEN 'confirmed' WHEN nw = 'pending' THEN 'replaced' END AS outcome FROM b WHERE what = 'pending')"""


@query("q_i07_stream_pending", f"WITH {NOTES} SELECT * FROM c WHERE outcome IS NOT NULL")
def _(t):
    """The clock stands an hour before the last event, so the newest notes lie ahead of it."""
    out, checkpoint = run_path(t.spark, "notes"), run_path(t.spark, "cp")
    keyed.notes(live(t).stash_events, out, checkpoint)
    now = t.stash_events.agg(F.unix_micros(F.max("at").cast("timestamp")) - 3_600_000_000).scalar()
    return flows.pending_verdict(keyed.notes_view(t.spark, out, checkpoint), now).where("outcome is not null")


@query("q_i07_stream_expiry", """WITH a AS (SELECT *, epoch_us(moment) AS us FROM stash_events WHERE what IN ('pending', 'confirm')), w AS (SELECT epoch_us(max(moment)) // 1000 - 3600000 AS ms FROM stash_events WHERE what IN ('pending', 'confirm')),
  b AS (SELECT *, lead(what) OVER o AS nw, lead(us) OVER o AS nu FROM a WINDOW o AS (PARTITION BY owner ORDER BY us, event_id)),
  c AS (SELECT owner, event_id, CASE WHEN coalesce(nu - us >= 86400000000, true) THEN 'expired' WHEN nw = 'confirm' THEN 'confirmed' ELSE 'replaced' END AS outcome, least(coalesce(nu, us + 86400000000), us + 86400000000) AS us FROM b WHERE what = 'pending')
  SELECT owner, event_id, outcome, us FROM c WHERE us <= (SELECT ms * 1000 FROM w)""")
def _(t):
    """What the clock has ended: events may be an hour late, and a timer closes a note after its day."""
    path = run_path(t.spark, "expiry")
    flows.drain_keyed(keyed.expiring_notes(live(t).stash_events, "1 hour"), flows.append_batches(path), run_path(t.spark, "cp"), "append")
    return t.spark.read.option("basePath", path).parquet(path).drop("batch")


@query("q_i08_stream_timeline", "SELECT phase, host, rtype, count(*) AS requests, epoch_us(min(moment)) AS first_at, epoch_us(max(moment)) AS last_at FROM requests GROUP BY 1, 2, 3")
def _(t):
    path = run_path(t.spark, "timeline")
    flows.drain(flows.phase_timeline(live(t).requests), flows.append_batches(path), run_path(t.spark, "cp"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return flows.latest_rows(t.spark, path, ["phase", "host", "rtype"]).select("phase", "host", "rtype", "requests", us("first_at"), us("last_at"))
