"""Order-dependent outcomes as keyed state.

What an event did depends on the order of its key's events, and files bring them in any order. A key's events are cut
into chunks along their order (an hour of an owner, a stretch of a transaction's deliveries); the state of a (key, chunk)
is its events, and a batch reads and writes the chunks it touches and hands on only outcomes that changed, so its work
follows the batch and not the history, and a key with a third of all events is many tasks. What a chunk cannot decide
alone hangs on the chunks before or behind it. Each chunk keeps an *edge* for that, a few values; ``*_view`` reads the
edges, of hand-offs from beside the outcomes, else from the state store, and settles what is open, for all keys at once,
with the operators of the batch form. So the result is that of the batch form, however the input is cut into files and
batches; the last outcome handed on for an event counts.

``expiring_notes`` is the form with a clock: events wait in state until the watermark passes them, are gone through in
order, and a timer ends what is still open after its time. Its state is what may still come late and one note per key.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import ordered, purchases
from . import flows

DELIVERIES = 65_536  # arrivals in one chunk of a transaction


def _maker(schema: str) -> Row:
    return Row(*[f.split()[0] for f in schema.split(", ")])


class Chunk(StatefulProcessor):
    """A chunk's events in order. Subclasses say what they decide and what their edge is."""

    ROWS = ""
    EDGE = ""
    OUTPUT = ""

    def init(self, handle) -> None:
        self.row = _maker(self.OUTPUT)
        names = [f.split() for f in self.ROWS.split(", ")]
        self.names = [n for n, _ in names]
        self.rows = handle.getValueState("rows", ", ".join(f"{n} array<{kind}>" for n, kind in names))
        self.edge = handle.getValueState("edge", self.EDGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.rows.get()
        old = list(zip(*held)) if held else []
        new = sorted({tuple(r[n] for n in self.names) for r in rows}.union(old), key=lambda e: e[:2])
        if len(new) == len(old):  # nothing but repeated deliveries
            return
        before = self.outcomes(old)
        self.rows.update(tuple(map(list, zip(*new))))
        self.edge.update(self.summary(new))
        for event, outcome in self.outcomes(new).items():
            if before.get(event) != outcome:
                yield self.row(*key, event, *outcome)

    def close(self) -> None:
        pass

    def outcomes(self, events: list[tuple]) -> dict:
        raise NotImplementedError

    def summary(self, events: list[tuple]) -> tuple:
        raise NotImplementedError


def chunked(stream: DataFrame, key: str, processor: Chunk, path: str, checkpoint: str) -> None:
    """Run the stream (with a column chunk) to its end; changed outcomes go to ``path``, one folder per batch."""
    changed = stream.groupBy(key, "chunk").transformWithState(processor, processor.OUTPUT, "update", "none")
    flows.drain_keyed(changed, flows.append_batches(path), checkpoint)


# -- what each delivery did ----------------------------------------------------------------------------------


class Deliveries(Chunk):
    """Per delivery: what the chunk's earlier deliveries had set (the latest of them; uid and email known)."""

    ROWS = "arrival_seq bigint, event_id bigint, us bigint, action string, uid boolean, email boolean"
    EDGE = "set_us bigint, set_seq bigint, set_event bigint, uids bigint, emails bigint"
    OUTPUT = "txn string, chunk long, event_id long, arrival_seq long, us long, action string, uid boolean, email boolean, set_us long, set_seq long, set_event long, uids long, emails long"

    def outcomes(self, events):
        latest, uids, emails, out = (None, None, None), 0, 0, {}
        for seq, event, us, action, uid, email in events:
            out[event] = (seq, us, action, uid, email, *latest, uids, emails)
            latest = max(latest, (us, seq, event)) if latest[0] is not None else (us, seq, event)
            uids, emails = uids + uid, emails + email
        return out

    def summary(self, events):
        *_, last = events
        return (*max((us, seq, event) for seq, event, us, *_ in events), sum(e[4] for e in events), sum(e[5] for e in events))


def ledger(decided: DataFrame, path: str, checkpoint: str) -> None:
    """The stream of decisions as what each delivery did; ``ledger_view`` reads it."""
    acted = decided.where("action <> 'ignore'").select(
        "txn", F.floor(F.col("arrival_seq") / DELIVERIES).alias("chunk"), "arrival_seq", "event_id", F.unix_micros("occurred_at").alias("us"), "action",
        F.col("uid").isNotNull().alias("uid"), F.col("email").isNotNull().alias("email"))
    chunked(acted, "txn", Deliveries(), path, checkpoint)


def ledger_view(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """(txn, event_id, outcome): what the chunk's own deliveries had set, and what all chunks before it had."""
    edges = flows.stored(spark, checkpoint, f"txn string, chunk long, {Deliveries.EDGE}", "edge")
    latest = F.when(F.col("set_us").isNotNull(), F.struct("set_us", "set_seq", "set_event"))
    earlier = ordered.running_many(edges, ["txn"], ["chunk"], ordered.chunk_of("chunk", ordered.STEP), {
        "b_set": ("max", latest), "b_uids": ("sum", F.col("uids")), "b_emails": ("sum", F.col("emails"))}, inclusive=False)
    d = flows.latest_rows(spark, path, ["txn", "event_id"]).withColumn("own", latest)
    d = d.join(earlier.select("txn", "chunk", "b_set", "b_uids", "b_emails"), ["txn", "chunk"])
    upto = F.greatest("own", "b_set")
    fills = (F.col("uid") & (F.col("uids") + F.col("b_uids") == 0)) | (F.col("email") & (F.col("emails") + F.col("b_emails") == 0))
    said = purchases.delivery_outcome(F.col("action"), F.col("us"), F.col("event_id"), upto["set_us"], upto["set_event"], fills)
    return d.select("txn", "event_id", said.alias("outcome"))


# -- one-shot hand-offs ----------------------------------------------------------------------------------------

EVENTS = "us bigint, event_id bigint, what string"
# A chunk stands for a few of its events; ``mark`` says which of them is the act that the chunk could not decide.
EDGES = "us array<bigint>, event_id array<bigint>, what array<string>, mark array<boolean>"


def _edge(events: list[tuple], mark: tuple | None) -> tuple:
    kept = sorted(set(events))
    return tuple(map(list, zip(*kept))) + ([e == mark for e in kept],) if kept else ([], [], [], [])


def _events(stream: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("at").cast("timestamp"))
    return stream.select("owner", us.alias("us"), "event_id", "what").withColumn("chunk", F.floor(F.col("us") / flows.CHUNK_US))


def _edge_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The edges of all chunks as events again."""
    held = flows.stored(spark, checkpoint, f"owner long, chunk long, {EDGES}", "edge")
    return held.select("owner", F.explode(F.arrays_zip("us", "event_id", "what", "mark")).alias("e")).select("owner", "e.*").withColumn("at", F.timestamp_micros("us"))


def _precedes(a: Column, b: Column) -> Column:
    return (a["us"] < b["us"]) | ((a["us"] == b["us"]) & (a["event_id"] < b["event_id"]))


def _said(acts: Column, others: Column) -> Column:
    """What each claim got that has an earlier act in the chunk."""
    def one(e: Column, i: Column) -> Column:
        p = F.get(acts, i - 1)
        swept = F.exists(others, lambda o: (o["us"] - p["us"] > flows.STASH_US) & _precedes(o, e))
        outcome = flows.claim_outcome(e["us"], p["what"], p["us"], swept)
        got = F.struct(e["event_id"].alias("event_id"), outcome.alias("outcome"), F.when(outcome == "taken", p["event_id"]).alias("stashed"))
        return F.when((e["what"] == "claim") & (i > 0), got)
    return F.filter(F.transform(acts, one), lambda o: o.isNotNull())


def _claims_edge(acts: Column, others: Column) -> Column:
    """The first and last act, the last activity before the first act, the last activity."""
    first, last = F.get(acts, F.lit(0)), F.get(acts, F.size(acts) - 1)
    before = F.filter(others, lambda o: _precedes(o, first))
    def kept(e: Column, mark: bool) -> Column:
        return F.when(e.isNotNull(), F.struct(e["us"].alias("us"), e["event_id"].alias("event_id"), e["what"].alias("what"), F.lit(mark).alias("mark")))
    n, m = F.size(before), F.size(others)
    return F.array_compact(F.array(kept(first, True), F.when(F.size(acts) > 1, kept(last, False)),
                                   kept(F.get(before, n - 1), False), F.when(m > n, kept(F.get(others, m - 1), False))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The value worked out once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decided(held: DataFrame) -> DataFrame:
    """(owner, chunk, edge, said, was): a chunk's edge, what its claims got, and what they had got before this batch."""
    # Repeated deliveries lie beside each other, the earliest first.
    rows = F.sort_array(F.transform("held", lambda e: F.struct(e["us"].alias("us"), e["event_id"].alias("event_id"), e["what"].alias("what"), (e["came"] == F.col("now")).alias("new"))))
    again = lambda e, p: e["us"].eqNullSafe(p["us"]) & e["event_id"].eqNullSafe(p["event_id"]) & e["what"].eqNullSafe(p["what"])
    act = lambda e: F.coalesce(e["what"].isin("stash", "claim"), F.lit(False))

    def told(acts: Column, others: Column) -> Column:
        old = lambda e: ~e["new"]
        said, any_old = _said(acts, others), F.exists(acts, old)
        was = F.when(any_old, _let(F.filter(acts, old), lambda a: _let(F.filter(others, old), lambda o: _said(a, o))))
        return F.struct(_claims_edge(acts, others).alias("edge"), said.alias("said"), was.alias("was"))

    once = lambda r: F.filter(r, lambda e, i: (i == 0) | ~again(e, F.get(r, i - 1)))
    split = lambda r: _let(F.filter(r, act), lambda a: _let(F.filter(r, lambda e: ~act(e)), lambda o: told(a, o)))
    # Exploded, not projected: the optimiser would copy the expression into each use.
    return held.select("owner", "chunk", F.inline(F.array(_let(rows, lambda r: _let(once(r), split)))))


def _edges_of(path: str) -> str:
    return f"{path.rstrip('/')}-edges"


def claims(events: DataFrame, path: str, checkpoint: str) -> None:
    """Changed outcomes go to ``path``, one folder per batch, and the edges of the chunks touched to a folder beside it.

    A chunk's events are one value of an aggregate's state, which Spark keeps without Python: most chunks hold an event or
    two, and a call from Python for each of them cost more than all the rest. An event carries the time of the batch that
    brought it, so a batch can tell what it changes.
    """
    batch_time = F.unix_micros(F.current_timestamp())
    came = _events(events).withColumn("came", batch_time)
    held = came.groupBy("owner", "chunk").agg(F.collect_set(F.struct("us", "event_id", "what", "came")).alias("held")).withColumn("now", batch_time)

    def write(batch: DataFrame, number: int) -> None:
        at = f"{_edges_of(path)}/batch={number}"
        decided = _decided(batch)
        decided.write.mode("overwrite").parquet(at)
        d = batch.sparkSession.read.schema(decided.schema).parquet(at)
        cols = ["owner", "chunk", "event_id", "outcome", "stashed"]
        said = d.select("owner", "chunk", F.col("was").isNull().alias("alone"), F.inline("said"))
        was = d.select("owner", "chunk", F.inline("was")).toDF(*[f"w_{c}" for c in cols])
        same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in cols]
        changed = said.where("alone").select(*cols).union(said.where("not alone").join(was, same, "left_anti").select(*cols))
        flows.append_batches(path)(changed, number)

    flows.drain_keyed(held, write, checkpoint)


def claims_view(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """(owner, event_id, outcome, stashed) of every claim; a chunk's first act is settled over the edges."""
    cols = ["owner", "event_id", "outcome", "stashed"]
    edges = flows.latest_rows(spark, _edges_of(path), ["owner", "chunk"]).select("owner", F.inline("edge")).withColumn("at", F.timestamp_micros("us"))
    first = flows.stash_outcomes(edges.select("owner", "event_id", "what", "at", "mark")).where("mark")
    return flows.latest_rows(spark, path, ["owner", "event_id"]).select(*cols).unionByName(first.select(*cols))


# -- pending notes -----------------------------------------------------------------------------------------------


class Notes(Chunk):
    """Per reported purchase that has a later act in its chunk: what came next."""

    ROWS, EDGE, OUTPUT = EVENTS, EDGES, "owner long, chunk long, event_id long, us long, next_what string, next_us long"

    def outcomes(self, events):
        return {a[1]: (a[0], b[2], b[0]) for a, b in zip(events, events[1:]) if a[2] == "pending"}

    def summary(self, events):
        return _edge(events[:1] + events[-1:], events[-1])


def notes(events: DataFrame, path: str, checkpoint: str) -> None:
    acts = _events(events).where(F.col("what").isin("pending", "confirm"))
    chunked(acts, "owner", Notes(), path, checkpoint)


def notes_view(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """(owner, event_id, us, next_what, next_us) of every reported purchase; a chunk's last is settled over the edges."""
    cols = ["owner", "event_id", "us", "next_what", "next_us"]
    edges = _edge_events(spark, checkpoint)
    open_ones = edges.where("mark").select("owner", "event_id")
    last = flows.pending_notes(edges.select("owner", "event_id", "what", "at")).join(open_ones, ["owner", "event_id"], "left_semi")
    return flows.latest_rows(spark, path, ["owner", "event_id"]).select(*cols).unionByName(last.select(*cols))


# -- with a clock --------------------------------------------------------------------------------------------------


class ExpiringNotes(StatefulProcessor):
    """One open note per owner. Events wait until the watermark has passed them; a timer ends a note after a day.

    A call of the state costs far more than what is done with it, and so does each element of an array in it. So what one
    batch brings waits in sorted blocks, each a text, and an owner has one timer, for the first moment at which there is
    something to do: then all that is due is gone through.
    """

    OUTPUT = "owner long, event_id long, outcome string, us long"
    BLOCK = 4096  # events in one value of the state

    def init(self, handle) -> None:
        self.handle, self.row = handle, _maker(self.OUTPUT)
        self.waiting = handle.getMapState("waiting", "block bigint", "events string")
        self.head = handle.getValueState("head", "wake bigint, blocks bigint")
        self.note = handle.getValueState("note", "us bigint, event_id bigint")

    def _wake(self, held: int | None, us: int) -> int:
        """The timer in milliseconds; one that an earlier one has replaced finds nothing to do."""
        ms = -(-us // 1000)
        if held is None or ms < held:
            self.handle.registerTimer(ms)
            return ms
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted(((r["us"], r["event_id"], r["what"]) for r in rows), key=lambda e: e[:2])
        wake, blocks = self.head.get() or (None, 0)
        for i in range(0, len(new), self.BLOCK):
            self.waiting.updateValue((blocks,), (json.dumps([*zip(*new[i : i + self.BLOCK])]),))
            blocks += 1
        self.head.update((self._wake(wake, new[0][0]), blocks))
        return iter(())

    def _due(self, now: int) -> tuple[dict, int | None]:
        """What waited up to ``now``, which leaves the state, and the moment of the first event behind it."""
        due, ahead = {}, []
        for (block,), (events,) in sorted(self.waiting.iterator()):
            us, event, what = json.loads(events)
            n = bisect.bisect_right(us, now)
            due.update(zip(zip(us[:n], event[:n]), what[:n]))
            if n == len(us):
                self.waiting.removeKey((block,))
                continue
            ahead.append(us[n])
            if n:
                self.waiting.updateValue((block,), (json.dumps([us[n:], event[n:], what[n:]]),))
        return due, min(ahead, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # whatever lies before it has come
        wake, blocks = self.head.get() or (None, 0)
        if wake is None or wake * 1000 > now:
            return
        due, ahead = self._due(now)
        note = held = self.note.get()
        for (us, event), what in sorted(due.items()):
            if note and us - note[0] >= flows.PENDING_US:
                yield self.row(*key, note[1], "expired", note[0] + flows.PENDING_US)
                note = None
            if note:
                yield self.row(*key, note[1], "confirmed" if what == "confirm" else "replaced", us)
            note = (us, event) if what == "pending" else None
        if note and now - note[0] >= flows.PENDING_US:
            yield self.row(*key, note[1], "expired", note[0] + flows.PENDING_US)
            note = None
        if note != held:
            self.note.update(note) if note else self.note.clear()
        then = [us for us in (ahead, note and note[0] + flows.PENDING_US) if us is not None]
        if then:
            self.head.update((self._wake(None, min(then)), blocks if ahead is not None else 0))
        else:
            self.head.clear()

    def close(self) -> None:
        pass


def expiring_notes(events: DataFrame, lateness: str) -> DataFrame:
    """(owner, event_id, outcome, us): how and when each note ended, as the watermark passes that moment.

    Events may come out of order by up to ``lateness``; later ones are dropped, as anywhere in Structured Streaming.
    """
    d = events.where(F.col("what").isin("pending", "confirm")).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    d = d.select("owner", "event_id", "what", "at", F.unix_micros("at").alias("us"))
    return d.groupBy("owner").transformWithState(ExpiringNotes(), ExpiringNotes.OUTPUT, "append", "eventTime")
