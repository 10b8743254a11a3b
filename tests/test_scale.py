"""The ordered operators on groups cut into many chunks, against plain windows; streams over several files."""

import datetime
import glob
import os
import random
import shutil
import time
import types

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.operators import audit, graphs, ordered, pages, purchases, runs, survey
from quirework.plans.catalog_rules import decisions
from quirework.plans.catalog_streams import StreamTables
from quirework.plans.facts import Tables
from quirework.session import fits_broadcast
from quirework.sources import scans
from quirework.streaming import flows, keyed


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows under one key."""
    d = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("k"), (F.col("id") * 7919 % 10007).alias("o"),
                                 F.when(F.col("id") % 5 != 0, F.col("id") % 101).alias("v"))
    return d.cache()


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.fixture(params=[ordered.CHUNK, 40])
def chunk_rows(request, monkeypatch):
    """Groups that fit a chunk, and groups of many chunks on several levels."""
    monkeypatch.setattr(ordered, "CHUNK", request.param)
    monkeypatch.setattr(ordered, "STEP", 16)


@pytest.mark.parametrize("size", [1, 97, 100000])
def test_running_and_number(skewed, size, chunk_rows):
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    chunk = ordered.chunk_of("o", size)
    v = F.coalesce("v", F.lit(0).cast("long"))
    assert same(ordered.number(skewed, ["k"], ["o"], chunk, "n").select("k", "o", "n"), skewed.select("k", "o", F.row_number().over(w).cast("long")))
    assert same(ordered.running(skewed, ["k"], ["o"], chunk, v, "s").select("k", "o", "s"), skewed.select("k", "o", F.sum(v).over(upto)))
    got = ordered.running(skewed, ["k"], ["o"], chunk, F.col("v"), "m", kind="max").select("k", "o", F.coalesce("m", F.lit(-1)))
    assert same(got, skewed.select("k", "o", F.coalesce(F.max("v").over(upto), F.lit(-1))))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(skewed, ahead, chunk_rows):
    w = Window.partitionBy("k").orderBy("o")
    want = skewed.select("k", "o", F.coalesce((F.lead if ahead else F.lag)(F.coalesce("v", F.lit(-5).cast("long"))).over(w), F.lit(-9)))
    got = ordered.neighbours(skewed, ["k"], ["o"], ordered.chunk_of("o", 97), F.col("v"), **({"nxt": "x"} if ahead else {"prev": "x"}))
    got = got.select("k", "o", F.when(F.col("x").isNull(), -9).otherwise(F.coalesce("x.v", F.lit(-5).cast("long"))))
    assert same(got, want)


@pytest.mark.parametrize("chunk, error", [(ordered.CHUNK, None), (3, None), (3, 0.0), (20, 0.3)])
def test_upper_median(skewed, monkeypatch, chunk, error):
    """Also with brackets that have to be narrowed, and with ones that miss the rank or are far too wide."""
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    if error is not None:
        monkeypatch.setattr(ordered, "_rank_error", lambda k: error)
    got = {r["k"]: r["m"] for r in ordered.upper_medians(skewed, ["k"], {"m": F.col("v")}).collect()}
    rows = {}
    for k, v in skewed.where("v is not null").select("k", "v").collect():
        rows.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in rows.items()}


@pytest.mark.parametrize("shape", ["sorted", "steep", "ties", "odd"])
def test_upper_median_of_one_large_group(spark, shape, monkeypatch):
    """All rows in one group; nothing is put in order but what one chunk holds."""
    monkeypatch.setattr(ordered, "CHUNK", 2000)
    d = spark.range(60_001)
    v = {"sorted": F.col("id") * 1.0, "steep": F.exp(F.col("id") / 100.0), "ties": F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) * 1.0),
         "odd": F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, float("inf")).otherwise(-1.0 * F.col("id"))}[shape]
    d = d.select(F.lit(1).alias("k"), v.alias("v")).cache()
    plan = ordered.upper_medians(d, ["k"], {"m": F.col("v")})
    want = sorted((r["v"] for r in d.collect()), key=lambda x: (x != x, x))[60_001 // 2]
    assert plan.first()["m"] == want
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_medians_of_many_groups_copy_no_brackets(spark, monkeypatch):
    """Only groups of more than a chunk have brackets, which stand in every part; the others would be a broadcast of millions of rows."""
    monkeypatch.setattr(ordered, "CHUNK", 50)
    met, meet = [], ordered._meet
    monkeypatch.setattr(ordered, "_meet", lambda rows, by, brackets: met.append(brackets.count()) or meet(rows, by, brackets))
    d = spark.range(4000).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 500).alias("k"), (F.col("id") * 31 % 997).alias("v")).cache()
    got = {r["k"]: r["m"] for r in ordered.upper_medians(d, ["k"], {"m": F.col("v")}).collect()}
    rows = {}
    for r in d.collect():
        rows.setdefault(r["k"], []).append(r["v"])
    assert got == {k: sorted(v)[len(v) // 2] for k, v in rows.items()} and len(got) == 500
    assert met and set(met) == {1}


def test_ranges_across_chunks(spark):
    d = spark.createDataFrame([(1, p) for p in [0, 1, 2, 4, 65534, 65535, 65536, 65537, 70000]], "d long, p long")
    assert pages.describe_ranges(d, ["d"], "p").first()["ranges"] == "1-3, 5, 65535-65538, 70001"


def test_broadcast_needs_a_measured_bound(spark, monkeypatch):
    from quirework import session
    small = spark.range(10).select(F.col("id").cast("string").alias("t"))
    assert fits_broadcast(small, ["t"])
    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    assert not fits_broadcast(small, ["t"])


LAYOUTS = ["one file", "folder", "in time order", "shuffled"]


@pytest.fixture(scope="module", params=LAYOUTS)
def live(request, spark, folder, tmp_path_factory):
    """The events as one file, as a folder, and as four files one per micro-batch, in time order and not."""
    out = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{folder}/events.parquet")
    at = f"{out}/events.parquet"
    if request.param == "one file":
        at = f"{folder}/events.parquet"
    elif request.param == "folder":
        e.repartition(3).write.parquet(at)
    else:
        order = "ts" if request.param == "in time order" else F.xxhash64("event_id")
        n = e.count() // 4 + 1
        ranked = e.withColumn("n", F.row_number().over(Window.orderBy(order, "event_id")) - 1).cache()
        for i in range(4):
            ranked.where(F.floor(F.col("n") / n) == i).drop("n").coalesce(1).write.mode("append").parquet(at)
            time.sleep(0.05)

    class Live(StreamTables):
        def __init__(self, spark, folder, at=at):
            super().__init__(spark, folder)
            self.at = at

        @property
        def events(self):
            return scans.event_files(self.spark, self.at, e.schema, files_per_batch=1)

    return Live(spark, folder)


@pytest.fixture(scope="module")
def whole(spark, folder):
    return Tables(spark, folder)


def halves(live, spark, run, tmp_path):
    """Runs a stream over the first two of the files alone and then, with the same checkpoint, over all of them."""
    files = sorted(glob.glob(f"{live.at}/*.parquet"), key=os.path.getmtime)
    if len(files) >= 4:
        os.makedirs(f"{tmp_path}/half/events.parquet")
        half = type(live)(spark, live.folder, f"{tmp_path}/half/events.parquet")
        for n in (2, len(files)):
            for f in files[:n]:
                at = f"{half.at}/{os.path.basename(f)}"
                if not os.path.exists(at):
                    shutil.copy(f, at)
                    time.sleep(0.02)
            run(half)
    else:
        run(live)
    run(half if len(files) >= 4 else live)  # a restart with nothing new


def test_purchase_streams(spark, live, whole, tmp_path):
    want = purchases.purchase_state(decisions(whole)).select("txn", "status", "uid", "email", "last_event")
    p = str(tmp_path)
    halves(live, spark, lambda t: flows.keep_in_state(flows.purchase_status(decisions(t)), f"{p}/c1"), tmp_path / "1")
    assert same(flows.stored_purchases(spark, f"{p}/c1").select(*want.columns), want)
    halves(live, spark, lambda t: keyed.ledger(decisions(t), f"{p}/out", f"{p}/c2"), tmp_path / "2")
    reasons = purchases.delivery_reasons(decisions(whole)).select("txn", "event_id", "outcome")
    assert same(keyed.ledger_view(spark, f"{p}/out", f"{p}/c2"), reasons)
    flows.drain(flows.purchase_status(decisions(live)), flows.append_batches(str(tmp_path / "s")), str(tmp_path / "c3"))
    assert same(flows.latest_rows(spark, str(tmp_path / "s"), ["txn"]).select(*want.columns), want)


def test_each_event_once(spark, live, whole, tmp_path):
    d = decisions(live).select("event_id", "action")
    flows.drain(flows.once_per_event(d.unionByName(d), "event_id"), flows.append_batches(str(tmp_path / "o")), str(tmp_path / "c"), "append")
    assert same(spark.read.parquet(str(tmp_path / "o")).select("event_id", "action"), decisions(whole).select("event_id", "action"))


def test_survey_answers(spark, live, whole, tmp_path):
    halves(live, spark, lambda t: flows.keep_in_state(survey.latest_answers(survey.cleaned(t.survey)), f"{tmp_path}/c"), tmp_path / "1")
    cols = ["email", "profession", "spends_too_long", "at"]
    assert same(flows.stored_answers(spark, f"{tmp_path}/c").select(*cols).fillna(""), survey.latest_answers(survey.cleaned(whole.survey)).select(*cols).fillna(""))


@pytest.mark.parametrize("deliveries", [keyed.DELIVERIES, 2])
def test_claims_and_notes(spark, live, whole, tmp_path, monkeypatch, deliveries):
    monkeypatch.setattr(keyed, "DELIVERIES", deliveries)
    if deliveries == 2:  # and long chunks of owners
        monkeypatch.setattr(flows, "CHUNK_US", 40 * flows.PENDING_US)
        keyed.ledger(decisions(live), f"{tmp_path}/o", f"{tmp_path}/c")
        assert same(keyed.ledger_view(spark, f"{tmp_path}/o", f"{tmp_path}/c"), purchases.delivery_reasons(decisions(whole)).select("txn", "event_id", "outcome"))
    p = str(tmp_path)
    halves(live, spark, lambda t: keyed.claims(t.stash_events, f"{p}/o1", f"{p}/c1"), tmp_path / "1")
    got = keyed.claims_view(spark, f"{p}/o1", f"{p}/c1")
    cols = ["owner", "event_id", "outcome", "stashed"]
    assert same(got.select(*cols).fillna(-1), flows.stash_outcomes(whole.stash_events).select(*cols).fillna(-1))
    halves(live, spark, lambda t: keyed.notes(t.stash_events, f"{p}/o2", f"{p}/c2"), tmp_path / "2")
    now = whole.stash_events.agg(F.unix_micros(F.max("at").cast("timestamp"))).scalar()
    got = flows.pending_verdict(keyed.notes_view(spark, f"{p}/o2", f"{p}/c2"), now)
    assert same(got.fillna("open"), flows.pending_verdict(flows.pending_notes(whole.stash_events), now).fillna("open"))


def test_a_batch_hands_on_what_it_changes(spark, tmp_path):
    """However much history there is: one more claim of an old owner changes one row."""
    at, p = f"{tmp_path}/in", str(tmp_path)
    hour = lambda h, m: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    kind = "owner long, event_id long, what string, at timestamp_ntz"
    history = [(o, o * 1000 + 3 * h + i, what, hour(h, 5 * i)) for o in range(4) for h in range(200) for i, what in enumerate(["stash", "claim", "claim"])]
    for rows in (history, [(1, 9_999, "claim", hour(7, 6))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(kind).parquet(at)
        keyed.claims(stream, f"{p}/out", f"{p}/cp")
    changed = spark.read.parquet(f"{p}/out/batch=1").collect()
    assert {(r["event_id"], r["outcome"]) for r in changed} == {(9_999, "nothing")} and len(changed) == 1
    whole = flows.stash_outcomes(spark.read.schema(kind).parquet(at))
    assert same(keyed.claims_view(spark, f"{p}/out", f"{p}/cp").fillna(-1), whole.select("owner", "event_id", "outcome", "stashed").fillna(-1))


def test_claims_are_decided_without_a_call_per_chunk(spark, tmp_path, monkeypatch):
    """Late and repeated deliveries: each batch hands on just what it changes, and no Python goes through the chunks."""
    monkeypatch.setattr("pyspark.sql.group.GroupedData.transformWithState", None)
    rnd, minute, kind = random.Random(9), 60_000_000, "owner long, event_id long, what string, at timestamp_ntz"
    events = [(rnd.choice([1, 1, 2, 3]), i, rnd.choice(["stash", "claim", "pending", "other"]), rnd.randrange(2 * flows.CHUNK_US // minute) * minute) for i in range(160)]
    rnd.shuffle(events)
    batches = [events[:70], events[60:120] + events[:5], events[110:] + events[110:115], events[30:60]]

    def got(seen):
        out = {}
        for owner, chunk in {(e[0], e[3] // flows.CHUNK_US) for e in seen}:
            act, swept = None, None
            for us, event, what in sorted((e[3], e[1], e[2]) for e in set(seen) if (e[0], e[3] // flows.CHUNK_US) == (owner, chunk)):
                if what not in ("stash", "claim"):
                    swept = us
                    continue
                if what == "claim" and act:
                    said = "nothing" if act[2] == "claim" else "taken" if us - act[0] <= flows.STASH_US else "nothing" if swept is not None and swept - act[0] > flows.STASH_US else "expired"
                    out[event] = (owner, chunk, event, said, act[1] if said == "taken" else None)
                act = (us, event, what)
        return out

    at, p, seen = f"{tmp_path}/in", str(tmp_path), []
    for n, rows in enumerate(batches):
        timed = [(o, i, what, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)) for o, i, what, us in rows]
        spark.createDataFrame(timed, kind).coalesce(1).write.mode("append").parquet(at)
        keyed.claims(spark.readStream.schema(kind).parquet(at), f"{p}/out", f"{p}/cp")
        before, seen = got(seen), seen + rows
        want = [r for event, r in got(seen).items() if before.get(event) != r]
        assert sorted(map(str, map(tuple, spark.read.parquet(f"{p}/out/batch={n}").collect()))) == sorted(map(str, want)) and bool(want) == (n < 3)
    whole = flows.stash_outcomes(spark.read.schema(kind).parquet(at).distinct())
    assert same(keyed.claims_view(spark, f"{p}/out", f"{p}/cp").fillna(-1), whole.select("owner", "event_id", "outcome", "stashed").fillna(-1))


def test_timers_end_notes(spark, tmp_path):
    """Late by less than allowed is put in order; a note's day ends by timer, in the batch whose watermark passes it."""
    at, p = f"{tmp_path}/in", str(tmp_path)
    when = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    kind = "owner long, event_id long, what string, at timestamp_ntz"
    files = [[(1, 1, "pending", when(0)), (2, 2, "pending", when(1)), (3, 3, "pending", when(1)), (4, 4, "confirm", when(1))],
             [(2, 6, "confirm", when(4)), (2, 5, "pending", when(3)), (9, 7, "confirm", when(6))],
             [(3, 8, "confirm", when(25.5)), (9, 9, "confirm", when(26))], [(9, 10, "confirm", when(40))], [(1, 11, "pending", when(41)), (9, 12, "confirm", when(90))]]
    for rows in files:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(kind).parquet(at)
        flows.drain(keyed.expiring_notes(stream, "2 hours"), flows.append_batches(f"{p}/out"), f"{p}/cp", "append")
    got = {(r["event_id"], r["outcome"], r["us"] // 3_600_000_000 - 473352) for r in spark.read.parquet(f"{p}/out").collect()}
    assert got == {(1, "expired", 24), (2, "replaced", 3), (3, "expired", 25), (5, "confirmed", 4), (11, "expired", 65)}
    left = flows.stored(spark, f"{p}/cp", "owner long, us long, event_id long", "note")
    assert left.count() == 0


class HeldState:
    """A key's state and timers in memory; counts what a processor asks of it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def _variable(self, name):
        held, handle = self.values.setdefault(name, {}), self

        class Variable:
            def __getattr__(self, what):
                handle.calls += 1
                return {"get": lambda: held.get(()), "update": lambda v: held.update({(): v}), "clear": held.clear, "getValue": held.get,
                        "updateValue": lambda k, v: held.update({k: v}), "removeKey": held.pop, "iterator": lambda: iter(list(held.items()))}[what]
        return Variable()

    def getValueState(self, name, schema):
        return self._variable(name)

    def getMapState(self, name, key, value):
        return self._variable(name)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


@pytest.mark.parametrize("block", [4096, 7])
def test_an_owner_asks_little_of_the_state(monkeypatch, block):
    """Calls follow batches and blocks, not events; outcomes are those of going through the events one by one."""
    monkeypatch.setattr(keyed.ExpiringNotes, "BLOCK", block, raising=False)
    rnd, day = random.Random(5), flows.PENDING_US
    events = [(rnd.randrange(40 * day), i, rnd.choice(["pending", "confirm"])) for i in range(600)]
    batches = [sorted(events)[i * 150 : i * 150 + 190] for i in range(4)]  # each has forty of the next one's as well
    state, notes, got = HeldState(), keyed.ExpiringNotes(), []
    notes.init(state)

    def fire(ms):
        for t in sorted(t for t in state.timers if t <= ms):
            got.extend(notes.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), None))
            state.timers.discard(t)

    for rows in batches:
        rnd.shuffle(rows)
        fire(min(rows)[0] // 1000 - 1)  # what the batch brings is not late
        list(notes.handleInputRows((1,), iter([dict(zip(("us", "event_id", "what"), r)) for r in rows]), None))
    fire(50 * day // 1000)
    want, note = [], None
    for us, event, what in [*sorted(events), (60 * day, None, "end")]:
        if note:
            late = us - note[0] >= day
            want.append((1, note[1], "expired" if late else "confirmed" if what == "confirm" else "replaced", note[0] + day if late else us))
        note = (us, event) if what == "pending" else None
    assert [tuple(r) for r in got] == want
    assert not state.timers and not any(state.values.values())
    assert state.calls <= 100 if block > 600 else state.calls <= 600


def test_state_before_the_first_batch(spark, tmp_path):
    assert flows.stored_purchases(spark, str(tmp_path / "none")).count() == 0


def test_counters(spark, live, whole, tmp_path):
    flows.drain(flows.phase_timeline(live.requests), flows.append_batches(str(tmp_path / "t")), str(tmp_path / "c"))
    got = flows.latest_rows(spark, str(tmp_path / "t"), ["phase", "host", "rtype"])
    want = flows.phase_timeline(whole.requests)
    assert same(got.select(*want.columns), want)


def test_deep_trees(spark):
    """Chains of any depth, and circles."""
    rows = []
    for doc, depth in ((1, 20), (2, 40), (3, 200)):
        rows += [(doc, i, i - 1 if i else None, i if i == depth - 1 else None) for i in range(depth)]
    rows += [(4, 0, None, None), (4, 1, 0, None), (4, 2, 3, 7), (4, 3, 4, None), (4, 4, 2, None)]
    d = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, page_index long")
    levels = {(r[0], r[1]): r[2] for r in graphs.outline_levels(d).collect()}
    assert levels == {(doc, i): i for doc, i, *_ in rows if doc < 4 or i < 2}
    kept = graphs.keep_with_survivors(d.withColumn("ok", F.col("page_index").isNotNull()), "ok").select("doc_id", "node_id").collect()
    assert {tuple(r) for r in kept} == {(doc, i) for doc, i, *_ in rows if doc < 4 or i >= 2}
    roots = {(r[0], r[1]): r[2] for r in graphs.named_root(d.withColumn("is_field", F.lit(True))).collect()}
    assert roots == {(doc, i): (0 if doc < 4 or i < 2 else None) for doc, i, *_ in rows}


def hops(edges, start):
    out, at = {s: 0 for s in start}, list(start)
    while at:
        at = [b for a in at for b in edges.get(a, ()) if b not in out and not out.update({b: out[a] + 1})]
    return out


@pytest.mark.parametrize("maps", [graphs.FILTER_MAPS, 1])
def test_reachable_nodes(spark, monkeypatch, maps):
    """A long chain, a dense graph and a random one with circles; also with a filter that knows nearly everything."""
    monkeypatch.setattr(graphs, "FILTER_MAPS", maps)
    rnd = random.Random(3)
    shapes = [([(a, b) for a in range(40) for b in range(40)], [0]), ([(rnd.randrange(400), rnd.randrange(400)) for _ in range(700)] + [(None, 1), (5, None)], [1, 2, 2])]
    if maps > 1:
        shapes.append(([(i, i + 1) for i in range(200)] + [(200, 0)], [0]))
    else:
        monkeypatch.setattr(graphs, "_maybe_visited", lambda node, held: F.col(node) % 2 == 0)  # half of all nodes are held against the table
        shapes[0] = ([(2 * a, 2 * b) for a in range(20) for b in range(20)] + [(2 * a, 2 * a + 1) for a in range(20)], [0])
        shapes[1] = ([(a, b) for a, b in shapes[1][0] if b is None or b % 2 == 0], [2, 4])
    for rows, start in shapes:
        by = {}
        for a, b in rows:
            if a is not None and b is not None:
                by.setdefault(a, []).append(b)
        got = graphs.reachable(spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([(s,) for s in start], "node long"))
        if maps > 1 or rows is shapes[1][0]:
            assert {r["node"]: r["hop"] for r in got.collect()} == hops(by, start) and got.count() == len(hops(by, start))


def test_a_hop_shuffles_the_frontier_alone(spark, monkeypatch):
    plans = []
    write = type(spark.range(1).write).saveAsTable
    monkeypatch.setattr(type(spark.range(1).write), "saveAsTable", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(30)], "src long, dst long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to be sent
    try:
        assert graphs.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    hop, check = plans[2], plans[3]
    assert hop.count("Exchange hashpartitioning(node") == 1 == hop.count("Exchange hashpartitioning") and "Bucketed: true" in hop
    assert "Exchange hashpartitioning" not in check and "Bucketed: true" in check


def test_phrases_join_on_equality_only(spark):
    texts = spark.createDataFrame([(1, "a bc def the ghi"), (2, "xyz"), (3, ""), (4, "the the")], "k long, text string")
    phrases = spark.createDataFrame([(1, "a"), (2, "bc d"), (3, "c def t"), (4, "yz"), (5, "e t"), (6, ""), (7, "the"), (8, "q")], "phrase_id long, phrase string")
    want = {(k, p) for k, t in texts.collect() for p, s in phrases.collect() if s and s in t}
    for fits in (True, False):
        d = audit.phrase_hits(texts, "k", phrases, fits)
        assert {tuple(r) for r in d.collect()} == want and d.count() == len(want)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_phrases_of_common_words(spark, monkeypatch):
    """100,000 phrases, all of ten words, over texts of the same ten words: pairs of words are the rarest grams, the
    common ones are cut into parts, and no part is much larger than the others."""
    monkeypatch.setattr(audit, "GRAM_ROWS", 200)
    words = ["the", "of", "and", "to", "in", "that", "is", "was", "for", "on"]
    pick = lambda seed, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(10)).cast("int"))), " ")
    phrases = spark.range(100_000).select(F.col("id").alias("phrase_id"), pick(1, F.lit(9)).alias("phrase")).cache()
    texts = spark.range(3000).select(F.col("id").alias("k"), pick(2, F.lit(40)).alias("text")).cache()
    phrases = phrases.unionByName(texts.where("k % 7 = 0").select((F.col("k") + 1_000_000).alias("phrase_id"), F.substring("text", 11, 60).alias("phrase"))).where("phrase like '% % % %'")
    keys = audit.keyed_phrases(texts, phrases, (False, True, [])).cache()
    assert keys.agg(F.max("salts")).first()[0] > 1
    load = [r[0] for r in audit._salted(texts, "k", keys, (False, True, [])).groupBy("gram", "salt").count().select("count").collect()]
    assert max(load) <= 3 * sorted(load)[len(load) // 2] and len(load) > 100
    want = {(r["k"], r["phrase_id"]) for r in audit.phrase_hits(texts, "k", phrases, True).collect()}
    assert len(want) > 300 and {tuple(r) for r in audit.phrase_hits(texts, "k", phrases, False).collect()} == want
    monkeypatch.setattr(audit, "KEYS_HELD", 10)
    assert {tuple(r) for r in audit.phrase_hits(texts, "k", phrases, False).collect()} == want


def test_ranges_of_an_empty_set(spark):
    d = spark.createDataFrame([(1, 3)], "d long, p long")
    got = pages.describe_ranges(d, ["d"], "p", groups=spark.createDataFrame([(1,), (2,)], "d long")).collect()
    assert {tuple(r) for r in got} == {(1, "4"), (2, "none")}


def test_limit_is_pushed_below_the_shuffle(skewed):
    d = audit.first_n(skewed, ["k"], "o", 4)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    w = Window.partitionBy("k").orderBy("o")
    assert same(d.select("k", "o"), skewed.withColumn("n", F.row_number().over(w)).where("n <= 4").select("k", "o"))


def test_plans_prune_and_push_down(spark, folder):
    t = Tables(spark, folder)
    plan = t.placements.select("doc_id", "a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan


def test_parse_runs_once_per_row(spark, folder):
    """The JSON parse and the rule chain stay in their own steps, however many columns read them."""
    p = purchases.purchase_state(decisions(Tables(spark, folder)))
    assert p._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def in_turn(files):
    """The sequential rule; what is taken only grows, so each name's numbering goes on where it stopped."""
    taken, upto, out = set(), {}, {}
    for i, source in files:
        base = source.removesuffix(".pdf")
        name, n = f"{base}.pdf", upto.get(base, 2)
        while name in taken:
            name, n = f"{base} ({n}).pdf", n + 1
        upto[base] = n
        taken.add(name)
        out[i] = name
    return out


@pytest.mark.parametrize("n, children, fold", [(150_000, 100_000, runs.FOLD), (3000, 900, 7)])
def test_names_of_one_parent_with_very_many_children(spark, monkeypatch, n, children, fold):
    monkeypatch.setattr(runs, "FOLD", fold)
    rnd = random.Random(n)
    numbers = rnd.sample(range(2, 3 * children // 2), children)
    files = [f"a ({k}).pdf" for k in numbers] + ["a.pdf"] * (n - children - 60) + [f"a ({k}) (2).pdf" for k in numbers[:30]] * 2
    rnd.shuffle(files)
    files = list(enumerate(files[: n // 2] + sorted(files[n // 2 :])))
    d = spark.createDataFrame(pd.DataFrame(files, columns=["ordinal", "source"])).withColumn("run_id", F.lit(1).cast("long"))
    got = {r["ordinal"]: r["name"] for r in runs.allocate_names(d).select("ordinal", "name").collect()}
    assert got == in_turn(files)


def test_step_maps_are_the_rule_for_every_start():
    rnd = random.Random(2)
    for _ in range(300):
        most, limits = rnd.randrange(12), [rnd.randrange(-3, 25) for _ in range(rnd.randrange(14))]
        always, places = runs.step_map(limits, most)
        for start in range(most + 1):
            s = start
            for limit in limits:
                s += s < limit
            assert s == start + always + sum(p > start for p in places)


def test_list_fingerprints(spark):
    lists = {1: ["a", "b", "c"], 2: ["a", "c", "b"], 3: ["a", "b", "c"], 4: ["a", None, "b"], 5: ["a", "b", None], 6: ["", "a"], 7: ["a"], 8: ["a", "a"], 9: ["x"] * 5000, 10: ["x"] * 5001}
    rows = spark.createDataFrame([(k, i, x) for k, v in lists.items() for i, x in enumerate(v)], "k long, n int, item string").repartition(5)
    got = {r["k"]: (r["length"], tuple(r["print"])) for r in audit.list_fingerprints(rows, "k").collect()}
    for a in lists:
        for b in lists:
            assert (got[a] == got[b]) == (lists[a] == lists[b])
    parts = audit.list_fingerprints(rows.withColumn("k", F.col("k") * 2 + (F.col("n") >= 2).cast("int")).withColumn("n", F.col("n") - F.when(F.col("n") >= 2, 2).otherwise(0)), "k")
    two = parts.where("k % 2 = 0").select(F.floor(F.col("k") / 2).alias("k"), "length", F.col("print").alias("p")).join(parts.where("k % 2 = 1").select(F.floor(F.col("k") / 2).alias("k"), F.col("print").alias("q")), "k")
    assert {(r["k"], tuple(r["whole"])) for r in two.select("k", audit.followed_by(F.col("length"), F.col("p"), F.col("q")).alias("whole")).collect()} == {(k, got[k][1]) for k in lists if len(lists[k]) > 2}


def test_equal_lists_are_not_joined_by_place(spark, monkeypatch):
    rows = [(k, i, f"{k}-{i}") for k in range(50) for i in range(20)]
    a = spark.createDataFrame(rows, "k long, n int, item string")
    b = spark.createDataFrame([(k, i, "other" if (k, i) in {(7, 3), (7, 4)} else x) for k, i, x in rows if k != 9] + [(51, 0, "z"), (8, 20, "z")], "k long, n int, item string")
    d = audit.same_order(a, b, "k")
    assert {tuple(r) for r in d.where("not equal").collect()} == {(7, False, 2), (8, False, 1), (9, False, 20), (51, False, 1)} and d.count() == 51
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("FullOuter") and plan.count("LeftSemi") == 2  # what meets by place went through the filter


def test_sketches_are_united_and_intersected(spark):
    d = spark.range(60_000).select((F.col("id") % 7).alias("session"), F.when(F.col("id") % 3 == 0, "open").otherwise("pay").alias("phase"), F.concat(F.lit("https://x"), F.col("id") % 20_000, F.lit(".test/")).alias("url"))
    d = d.unionByName(d.limit(500))
    by = flows.united(flows.third_party_sketches(d, "https://own.test"), ["phase"])
    about = {r["phase"]: r["n"] for r in by.select("phase", flows.distinct_about("third_party").alias("n")).collect()}
    exact = {r["phase"]: r["n"] for r in d.groupBy("phase").agg(F.count_distinct("url").alias("n")).collect()}
    assert all(abs(about[p] - exact[p]) < 0.05 * exact[p] for p in exact) and about != exact
    both = by.where("phase = 'open'").select(F.col("third_party").alias("a")).crossJoin(by.where("phase = 'pay'").select(F.col("third_party").alias("b")))
    shared = d.where("phase = 'open'").select("url").distinct().join(d.where("phase = 'pay'").select("url").distinct(), "url").count()
    row = both.select(flows.shared_about("a", "b").alias("n"), flows.close_enough(flows.shared_about("a", "b"), F.lit(shared), F.lit(20_000)).alias("ok"), flows.close_enough(F.lit(shared + 3000), F.lit(shared), F.lit(20_000)).alias("bad")).first()
    assert row["ok"] and not row["bad"]
    small = flows.egress_counter(d.where("url like '%1.test/'").withColumn("bytes", F.lit(1).cast("long")), "https://own.test")
    assert {(r["n"],) for r in small.select(flows.distinct_about("third_party").alias("n")).collect()} == {(r["n"],) for r in d.where("url like '%1.test/'").groupBy("session").agg(F.count_distinct("url").alias("n")).collect()}
