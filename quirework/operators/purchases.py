"""Purchase events: parse, check signatures, decide, keep the latest status, answer who owns what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered
from .rules import first_match

EVENT = ("event_id string, event_type string, occurred_at string, data struct<id string, transaction_id string, action string, "
         "status string, type string, items array<struct<type string, price struct<id string>>>, "
         "custom_data struct<uid string, email string>>, _corrupt_record string")
TOLERANCE_SECONDS = 5
BLOCK = 64


def parse_events(deliveries: DataFrame, raw: str = "raw") -> DataFrame:
    """Nested event per delivery. A body that does not parse is kept and marked, not fatal."""
    d = S.once(deliveries, "e", F.from_json(raw, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return d.withColumn("parsed", F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex from the built-in sha2, so it stays in generated code."""
    key = secret.encode()
    if len(key) > BLOCK:
        import hashlib
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signature_parts(header: str | Column) -> Column:
    """``ts=…;h1=…`` as (ts text, list of h1); the last ts wins, every h1 is kept."""
    pairs = F.transform(F.filter(F.split(S.col(header), ";"), lambda p: F.instr(p, "=") > 0), lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    ts = F.try_element_at(F.filter(pairs, lambda p: p["k"] == "ts"), F.lit(-1))["v"]
    h1 = F.transform(F.filter(pairs, lambda p: p["k"] == "h1"), lambda p: F.lower(p["v"]))
    return F.struct(ts.alias("ts"), h1.alias("h1"))


def signature_verdict(body: str, header: str, secret: str, received_at: str) -> Column:
    p = signature_parts(header)
    sent = p["ts"].try_cast("long")
    bad = F.col(header).isNull() | p["ts"].isNull() | ~p["ts"].rlike(r"^\d+$") | (F.size(p["h1"]) == 0)
    mac = hmac_sha256(secret, F.concat(p["ts"], F.lit(":"), F.col(body)))
    return first_match([(F.coalesce(bad, F.lit(True)), "malformed-signature-header"),
                        (F.abs(F.col(received_at) - sent) > TOLERANCE_SECONDS, "timestamp-outside-tolerance"),
                        (F.array_contains(p["h1"], mac), "ok")], "signature-mismatch")


def decide(parsed: DataFrame, price_id: str) -> DataFrame:
    """What each event means for a purchase: grant, revoke or ignore, with the reason."""
    e, data = F.col("e"), F.col("e.data")
    kind = e["event_type"]
    when = S.text_or_null(e["occurred_at"])
    at = F.try_to_timestamp(when)
    sale = kind == "transaction.completed"
    txn = S.text_or_null(F.when(sale, data["id"]).otherwise(data["transaction_id"]))
    action, status = data["action"], data["status"]
    items = F.coalesce(data["items"], F.array().cast("array<struct<type string, price struct<id string>>>"))
    ours = F.exists(items, lambda i: F.coalesce(F.trim(i["price"]["id"]) == price_id, F.lit(False)))
    full = F.exists(items, lambda i: F.coalesce(F.trim(i["type"]) == "full", F.lit(False)))
    types = F.array_join(F.transform(items, lambda i: F.coalesce(S.text_or_null(i["type"]), F.lit("no-type"))), "+")

    def say(verb: str, *words):
        parts = [w if isinstance(w, Column) else F.lit(w) for w in words]
        return F.struct(F.lit(verb).alias("action"), F.concat(*parts).alias("reason"))

    # The recorded reasons.
    refund = first_match([
        (~F.coalesce(status == "approved", F.lit(False)), say("ignore", "refund-", F.coalesce(status, F.lit("unknown")))),
        ((F.size(items) > 0) & full, say("revoke", "refund-approved-item-full")),
        (F.size(items) > 0, say("ignore", "partial-refund-items-", types)),
        (data["type"] == "partial", say("ignore", "partial-refund-no-items"))],
        say("revoke", "refund-approved-", F.coalesce(S.text_or_null(data["type"]), F.lit("no-type"))))
    verdict = first_match([
        (~F.col("parsed"), say("ignore", "unparseable")),
        (at.isNull(), say("ignore", "no-occurred-at")),
        (~F.coalesce(kind.isin("transaction.completed", "adjustment.created", "adjustment.updated"), F.lit(False)),
         say("ignore", "event-", F.coalesce(kind, F.lit("unknown")))),
        (txn.isNull(), say("ignore", "no-transaction-id")),
        (sale & ~ours, say("ignore", "not-the-pro-price")),
        (sale, say("grant", "transaction-completed")),
        (action == "refund", refund),
        ((action == "chargeback") & status.isin("rejected", "reversed"), say("ignore", "chargeback-", status)),
        (action == "chargeback", say("revoke", "chargeback")),
        ((action == "chargeback_reverse") & (status == "rejected"), say("ignore", "chargeback-reverse-rejected")),
        (action == "chargeback_reverse", say("grant", "chargeback-reversed"))],
        say("ignore", "adjustment-", F.coalesce(action, F.lit("unknown"))))
    carried = [c for c in parsed.columns if c not in ("e", "parsed", "raw")]
    facts = F.struct(verdict.alias("v"), sale.alias("sale"), txn.alias("txn"), at.alias("at"),
                     S.text_or_null(data["custom_data"]["uid"]).alias("uid"), S.email_key(data["custom_data"]["email"]).alias("email"))
    d = S.once(parsed, "_f", facts)
    owner = F.col("_f.sale") & (F.col("_f.v.action") == "grant")
    return d.select(*carried, F.col("_f.v.action").alias("action"), F.col("_f.txn").alias("txn"),
                    F.when(owner, F.col("_f.uid")).alias("uid"), F.when(owner, F.col("_f.email")).alias("email"),
                    F.col("_f.at").alias("occurred_at"), F.col("_f.v.reason").alias("reason"))


def purchase_state(decisions: DataFrame) -> DataFrame:
    """Status per transaction, whatever order the events came in.

    The latest event sets the status (arrival breaks a tie); the first known owner by arrival stays.
    Maxima and minima fold before the shuffle, so a transaction with a third of all events is one
    small row per task.
    """
    acted = decisions.where("action <> 'ignore'")
    latest = F.struct("occurred_at", "arrival_seq")
    status = F.when(F.col("action") == "grant", F.lit("granted")).otherwise(F.lit("revoked"))
    return acted.groupBy("txn").agg(
        F.max_by(F.struct(status.alias("status"), F.col("event_id").alias("last_event")), latest).alias("_l"),
        F.max("occurred_at").alias("changed_at"),
        F.min_by("uid", F.when(F.col("uid").isNotNull(), F.col("arrival_seq"))).alias("uid"),
        F.min_by("email", F.when(F.col("email").isNotNull(), F.col("arrival_seq"))).alias("email"),
    ).select("txn", "_l.status", "uid", "email", "changed_at", "_l.last_event")


def delivery_reasons(decisions: DataFrame) -> DataFrame:
    """What each acted-on delivery did to its purchase when it arrived, by running facts over arrival order.

    The row that last set the status is the running maximum of (occurred, arrival): an event not older
    than it overwrites it, and the same event again changes nothing.
    """
    acted = decisions.where("action <> 'ignore'")
    d = ordered.running_many(acted, ["txn"], ["arrival_seq"], ordered.chunk_of("arrival_seq"), {
        "_set": ("max", F.struct(F.unix_micros("occurred_at").alias("us"), "arrival_seq", "event_id")),
        "_uids": ("sum", F.col("uid").isNotNull().cast("long")), "_emails": ("sum", F.col("email").isNotNull().cast("long"))}, inclusive=False)
    fills = (F.col("uid").isNotNull() & (F.col("_uids") == 0)) | (F.col("email").isNotNull() & (F.col("_emails") == 0))
    outcome = delivery_outcome(F.col("action"), F.unix_micros("occurred_at"), F.col("event_id"), F.col("_set.us"), F.col("_set.event_id"), fills)
    return d.withColumn("outcome", outcome).drop("_set", "_uids", "_emails")


def delivery_outcome(action: Column, us: Column, event: Column, set_us: Column, set_event: Column, fills: Column) -> Column:
    """What one delivery did, given when and by which event the status had been set, and whether it names an owner first."""
    status = F.when(action == "grant", F.lit("granted")).otherwise(F.lit("revoked"))
    # The recorded reasons.
    return first_match([
        (set_us.isNull(), F.concat(status, F.lit("-new"))), (set_event == event, "duplicate-event"),
        (us >= set_us, status), (fills, "bound-older-event")], "older-than-current-status")


def entitlements(people: DataFrame, purchases: DataFrame) -> DataFrame:
    """Who owns the product: newest granted purchase by uid, else by verified email (then re-bound).

    ``people`` has uid, email, email_verified.
    """
    newest = F.struct("changed_at", "txn")
    granted = purchases.where("status = 'granted'")
    by_uid = purchases.where("uid is not null").groupBy("uid").agg(
        F.max_by(F.when(F.col("status") == "granted", F.col("txn")), F.when(F.col("status") == "granted", newest)).alias("_t1"),
        F.lit(True).alias("_known"))
    by_email = granted.where("email is not null").groupBy("email").agg(F.max_by(F.struct("txn", "uid"), newest).alias("_e"))
    asked = people.withColumn("_email", F.when(F.col("email_verified"), F.col("email")))
    d = asked.join(by_uid, "uid", "left").join(by_email.withColumnRenamed("email", "_email"), "_email", "left")
    by_mail = F.col("_t1").isNull() & F.col("_e").isNotNull()
    return d.select(
        "uid", "email", F.coalesce(F.col("_t1"), F.col("_e.txn")).alias("txn"),
        (F.col("_t1").isNotNull() | by_mail).alias("pro"),
        (by_mail & ~F.col("_e.uid").eqNullSafe(F.col("uid"))).alias("rebind"),
        (F.col("_t1").isNull() & ~by_mail & F.coalesce("_known", F.lit(False))).alias("revoked"))


def rebinds(owners: DataFrame) -> DataFrame:
    """Update table: purchases that move to a person's new uid."""
    return owners.where("rebind").select("txn", "uid")
