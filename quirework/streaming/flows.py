"""Streams: purchase state, survey answers, egress counters, one-shot stashes and pending notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, purchases
from ..operators.rules import is_third_party, url_parts
from ..session import ROCKSDB, STATE_STORE

STASH_US = 10 * 60 * 1_000_000
PENDING_US = 24 * 60 * 60 * 1_000_000
CHUNK_US = 60 * 60 * 1_000_000
CLOCK_SLACK_US = 60 * 1_000_000


# -- running a stream to its end -------------------------------------------------------------------


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", store: str | None = None) -> None:
    """Process everything that has landed, batch by batch, then stop.

    ``store`` is the state store this one stream needs, whatever the session has; the session's own comes back.
    """
    conf = stream.sparkSession.conf
    own = conf.get(STATE_STORE, None)
    if store:
        conf.set(STATE_STORE, store)
    try:
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
    finally:  # a started query has a copy of the settings
        if store:
            conf.unset(STATE_STORE) if own is None else conf.set(STATE_STORE, own)
    q.awaitTermination()


def drain_keyed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """The same for ``transformWithState``, which keeps several variables and timers: only RocksDB can hold those."""
    drain(stream, write, checkpoint, mode, ROCKSDB)


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch goes to its own folder and overwrites it, so a retried batch leaves no second copy."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream: one fold, no sort."""
    d = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")


def stored(spark: SparkSession, checkpoint: str, schema: str, variable: str | None = None) -> DataFrame:
    """The keys and values a stream holds after its last batch, read from its state store; empty before the first.

    Values are taken by position, so ``schema`` (of key and value fields, in order) may name them as it likes.
    """
    reader = spark.read.format("statestore")
    if variable:
        reader = reader.option("stateVarName", variable)
    empty = spark.createDataFrame([], schema)
    try:
        held = reader.load(checkpoint)
    except PySparkException as err:
        if err.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":
            raise
        return empty
    n = len(held.schema["key"].dataType.fields)
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in empty.schema.fields[n:])
    names = empty.columns
    d = held.select("key.*", F.col("value").cast(f"struct<{kinds}>").alias("__v"))
    return d.select(*[F.col(c).alias(a) for c, a in zip(d.columns[:n], names)], *[F.col("__v")[a].alias(a) for a in names[n:]])


# -- declarative state -------------------------------------------------------------------------------


def purchase_status(decisions: DataFrame) -> DataFrame:
    """Latest status per transaction as a streaming aggregate.

    The same fold as the batch form: late and repeated events change nothing they should not, and
    events are combined before the shuffle, so a hot transaction stays small.
    """
    return purchases.purchase_state(decisions)


def once_per_event(decisions: DataFrame, event: str) -> DataFrame:
    """Each event id once, however late it comes again. The ids seen are keyed state, one small row each, spread
    over the cluster; a time limit on them would drop late first deliveries too."""
    return decisions.dropDuplicates([event])


SKETCH_BITS = 12  # up to 4,096 distinct values are counted exactly, beyond that within about 1.6 % (one standard error)


def egress_counter(requests: DataFrame, own_origin: str) -> DataFrame:
    """Bytes and sends per session while they happen; distinct third-party URLs as a sketch of bounded size, which
    ``distinct_about`` reads and ``united`` merges.

    A streaming aggregate cannot first fold to one row per URL; the batch form (measure.egress) is exact.
    """
    third = F.when(is_third_party("url", own_origin), F.col("url"))
    return requests.groupBy("session").agg(
        F.sum(F.greatest(F.col("bytes"), F.lit(0).cast("long"))).alias("sent_bytes"), F.count_if(F.col("bytes") != 0).alias("sends"),
        F.count_if(F.col("bytes") < 0).alias("unmeasured"), (F.count(third) == 0).alias("clean"), F.theta_sketch_agg(third, SKETCH_BITS).alias("third_party"))


def third_party_sketches(requests: DataFrame, own_origin: str) -> DataFrame:
    """The same sketch per session and phase."""
    third = F.when(is_third_party("url", own_origin), F.col("url"))
    return requests.groupBy("session", "phase").agg(F.theta_sketch_agg(third, SKETCH_BITS).alias("third_party"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to one per group of keys: what any of them has seen, each value once."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("third_party", SKETCH_BITS).alias("third_party"))


def distinct_about(sketch: str | Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def shared_about(a: str, b: str) -> Column:
    """Distinct values that both sketches have seen."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def close_enough(about: Column, exact: Column, of: Column) -> Column:
    """Whether an estimate is as good as it has to be: exact while all ``of`` values fit the sketch, else within three
    standard errors of the whole."""
    return F.when(of <= 1 << SKETCH_BITS, about == exact).otherwise(F.abs(about - exact) <= of * 3 / 2 ** (SKETCH_BITS / 2))


def third_party_urls(requests: DataFrame, own_origin: str) -> DataFrame:
    """Distinct third-party URLs per session, exactly: one state row per URL, spread over the cluster."""
    return requests.where(is_third_party("url", own_origin)).groupBy("session", "url").agg(F.count("*").alias("n"))


def phase_timeline(requests: DataFrame) -> DataFrame:
    """Requests per phase and host as they arrive."""
    return requests.groupBy("phase", url_parts("url")["host"].alias("host"), "rtype").agg(
        F.count("*").alias("requests"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


# -- keyed upserts -------------------------------------------------------------------------------------------
#
# The table is the state of an update-mode aggregate: a batch touches the keys it has, retries and restarts are Spark's
# own, and readers take the keys from the state store of the last finished batch.


def keep_in_state(stream: DataFrame, checkpoint: str) -> None:
    """Run an aggregate to the end of its input for the sake of its state; what changed goes nowhere else."""
    drain(stream, lambda batch, _: batch.write.format("noop").mode("overwrite").save(), checkpoint)


PURCHASES = ("txn string, last struct<status: string, last_event: bigint>, newest struct<occurred_at: timestamp, arrival_seq: bigint>, changed_at timestamp, "
             "uid string, uid_seq bigint, email string, email_seq bigint")


def stored_purchases(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows of ``purchase_status`` as its state store holds them."""
    d = stored(spark, checkpoint, PURCHASES)
    return d.select("txn", "last.status", "uid", "email", "changed_at", "last.last_event")


ANSWERS = ("email string, last struct<profession: string, spends_too_long: string, cadence: string, at: timestamp_ntz>, "
           "newest struct<at: timestamp_ntz, event_id: bigint>")


def stored_answers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows of ``survey.latest_answers`` as its state store holds them."""
    return stored(spark, checkpoint, ANSWERS).select("email", "last.*")


# -- order-dependent outcomes, in batch form (``keyed`` has the streams) ------------------------------------------


def claim_outcome(us: Column, what: Column, since: Column, swept: Column) -> Column:
    """What a claim gets after an act that did ``what`` at ``since``; ``swept`` says whether activity came too late."""
    return (F.when(F.coalesce(what != "stash", F.lit(True)), "nothing").when(us - since <= STASH_US, "taken")
            .when(swept, "nothing").otherwise("expired"))


def stash_outcomes(events: DataFrame) -> DataFrame:
    """One-shot hand-off: a claim takes what was put aside last and removes it, found or not. Ten minutes is
    the limit, and any activity after that sweeps it away."""
    e = events.withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    order, chunk = ["us", "event_id"], ordered.chunk_of("us", CHUNK_US)
    swept = F.when(~F.col("what").isin("stash", "claim"), F.col("us"))
    e = ordered.running(e, ["owner"], order, chunk, swept, "swept", kind="max")
    acts = e.where(F.col("what").isin("stash", "claim"))
    acts = ordered.neighbours(acts, ["owner"], order, chunk, F.struct("what", "us", "event_id"), prev="prev")
    p = F.col("prev.v")
    outcome = claim_outcome(F.col("us"), p["what"], p["us"], F.col("swept") - p["us"] > STASH_US)
    return acts.where("what = 'claim'").select(*[c for c in events.columns if c not in ("what", "at")], outcome.alias("outcome"),
                                               F.when(outcome == "taken", p["event_id"]).alias("stashed"))


def pending_notes(events: DataFrame) -> DataFrame:
    """Each reported purchase with what came next for its owner: (owner, event_id, us, next_what, next_us)."""
    e = events.where(F.col("what").isin("pending", "confirm")).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    e = ordered.neighbours(e, ["owner"], ["us", "event_id"], ordered.chunk_of("us", CHUNK_US), F.struct("what", "us"), nxt="next")
    return e.where("what = 'pending'").select("owner", "event_id", "us", F.col("next.v.what").alias("next_what"), F.col("next.v.us").alias("next_us"))


def pending_verdict(notes: DataFrame, now: Column) -> DataFrame:
    """A reported purchase stays pending until confirmed, replaced by a newer report, or a day old; one that lies
    more than a minute ahead of the clock is refused. A note still open at ``now`` has no outcome: NULL."""
    late = F.coalesce(F.col("next_us"), now) - F.col("us") >= PENDING_US
    outcome = (F.when(F.col("us") > now + CLOCK_SLACK_US, "refused").when(late, "expired")
               .when(F.col("next_what") == "confirm", "confirmed").when(F.col("next_what") == "pending", "replaced"))
    return notes.select("owner", "event_id", outcome.alias("outcome"))
