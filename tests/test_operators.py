"""Operators on small literal tables, and against sequential models of their rules."""

import random
from datetime import datetime
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyspan import cli, schema, scratch
from tallyspan.functions import scalars as sc
from tallyspan.operators import enqueue, inspect, metrics, resolve, schedule, select, workflow
from tallyspan.operators.ordered import Ordered
from tallyspan.sources import stores
from tallyspan.streaming import lifecycle, worker


def jobs(spark, rows):
    """Rows of dicts over defaults, in the schema of jobs."""
    base = {"seq": 0, "id": "", "receipt": None, "lane": "default", "priority": 0, "available_at": 0, "leased_until": None, "deliveries": 0, "kind": "ok", "payload": b"null", "attempts": 0, "max_attempts": 3, "unique_key": None, "trace_context": None}
    return spark.createDataFrame([tuple(({**base, "seq": i + 1, "id": f"j{i + 1}", **r})[f.name] for f in schema.JOBS.fields) for i, r in enumerate(rows)], schema.JOBS)


def at(n):
    return F.lit(n).cast("long")


def ids(df, *cols):
    cols = cols or ("id",)
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_visibility_bounds_are_inclusive(spark):
    j = jobs(spark, [{"available_at": 5}, {"available_at": 6}, {"leased_until": 5}, {"leased_until": 6}])
    assert ids(select.visible(j, at(5))) == ["j1", "j3"]


def test_reserve_takes_priority_then_due_time_then_order(spark):
    j = jobs(spark, [{"available_at": 2}, {"available_at": 1}, {"priority": 9, "available_at": 3}, {"available_at": 1}, {"lane": "b"}])
    assert ids(select.reserve(j, at(9)), "lane", "id") == [("b", "j5"), ("default", "j3")]
    assert ids(select.reserve(j, at(9), 3).where("lane = 'default'"), "rank", "id") == [(1, "j3"), (2, "j2"), (3, "j4")]
    assert select.reserve(j.limit(0), at(9)).count() == 0


def test_lease_sets_receipt_and_counts_the_delivery(spark):
    j = select.lease(jobs(spark, [{}, {"available_at": 99}]), at(1), lease_ns=10)
    a, b = sorted(j.collect(), key=lambda r: r.id)
    assert a.receipt and a.leased_until == 11 and a.deliveries == 1
    assert b.receipt is None and b.deliveries == 0
    assert select.reserve(j, at(5)).count() == 0
    assert ids(select.reserve(j, at(11))) == ["j1"]


@pytest.mark.parametrize("bound", [0, 1, 3])
def test_poison_sweep_matches_a_sequential_model(spark, bound):
    rng = random.Random(bound)
    rows = [{"lane": rng.choice("abc"), "deliveries": rng.choice([0, 1, 2, 3, 3, 3]), "priority": rng.randint(0, 2)} for _ in range(60)]
    got = ids(select.poison_sweep(jobs(spark, rows), at(0), bound, cap=3), "id", "action")
    want = []
    for lane in "abc":
        swept = 0
        for i, r in sorted(((i, r) for i, r in enumerate(rows) if r["lane"] == lane), key=lambda x: (-x[1]["priority"], x[0])):
            if r["deliveries"] + 1 <= bound:
                want.append((f"j{i + 1}", "reserve"))
                break
            want.append((f"j{i + 1}", "dead"))
            swept += 1
            if swept >= 3:
                break
    assert got == sorted(want)


def test_append_numbers_in_input_order(spark):
    j = jobs(spark, [{"seq": 41}])
    new = spark.createDataFrame([(i, f"n{i}") for i in random.Random(1).sample(range(500), 500)], "ord long, id string")
    assert [r.seq for r in enqueue.append(j, new).orderBy("ord").collect()] == list(range(42, 542))
    assert enqueue.append(j, new.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 64])
def test_append_of_many_rows_has_no_gap_and_no_repeat(spark, n):
    new = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("ord"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        got = enqueue.append(jobs(spark, [{"seq": 41}]), new).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.seq for r in got] == list(range(42, 50_042))


def test_running_values_match_a_sequential_model(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([None, rng.randint(-9, 9)]), rng.random() < 0.1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ord long, v long, cut boolean")
    o = Ordered(df, ["k"], ["ord"]).running("island", "sum", F.col("cut").cast("long"))
    o = o.running("s", "sum", F.col("v")).running("m", "max", F.col("v"), before=True).running("n", "count", F.col("v"), ["island"])
    got = {r.ord: (r.island, r.s, r.m, r.n) for r in o.result.collect()}
    state = {}
    for k, i, v, cut in rows:
        island, s, m, n = state.get(k, (0, 0, None, 0))
        island, n = (island + 1, 0) if cut else (island, n)
        s, n = s + (v or 0), n + (v is not None)
        assert got[i] == (island, s, m, n)
        state[k] = island, s, v if m is None else m if v is None else max(m, v), n
    assert Ordered(df.limit(0), ["k"], ["ord"]).running("s", "sum", F.col("v")).result.count() == 0


def test_requeue_moves_jobs_in_request_order(spark):
    dead = jobs(spark, [{"id": "a", "attempts": 2, "deliveries": 9}, {"id": "b", "unique_key": "k"}, {"id": "c", "unique_key": "k"}, {"id": "d"}])
    live = jobs(spark, [{"id": "d", "seq": 70}])
    asked = spark.createDataFrame([(1, "c"), (2, "b"), (3, "a"), (4, "a"), (5, "d"), (6, "?"), (7, "b")], "ord long, id string")
    now_live, left, outcomes = resolve.requeue(dead, live, asked, at(55))
    assert ids(outcomes, "ord", "outcome") == [(1, "ok"), (2, "key_held"), (3, "ok"), (4, "not_found"), (5, "live_conflict"), (6, "not_found"), (7, "key_held")]
    assert ids(now_live, "seq", "id") == [(70, "d"), (71, "c"), (72, "a")] and ids(left) == ["b", "d"]
    a = now_live.where("id = 'a'").first()
    assert (a.attempts, a.deliveries, a.available_at, a.receipt, a.leased_until) == (2, 0, 55, None, None)
    assert now_live.columns == live.columns


def test_watchers(spark):
    w = [("ready", 1, 3, 10, "cb", "l"), ("pend", 2, 3, 10, "cb", "l"), ("last", 3, 3, 10, "cb", "l"), ("dead", 1, 3, 10, "cb", "l"), ("gone", 1, 3, 10, "cb", "l")]
    w += [("", 1, 3, 10, "cb", "l"), ("none", 1, 3, 10, "cb", "l"), ("zero", 0, 3, 10, "cb", "l"), ("past", 4, 3, 10, "cb", "l"), ("kind", 1, 3, 10, "", "l"), ("lane", 1, 3, 10, "cb", " l"), ("twice", 1, 3, 10, "cb", "l"), ("poll", 1, 3, 0, "cb", "l")]
    watchers = spark.createDataFrame(w, "fanin_id string, generation int, max_generations int, poll_delay_s int, callback_kind string, callback_lane string")
    s = [("ready", 0, "x", b"kept"), ("ready", 1, "y", None), ("pend", 0, "live", None), ("pend", 1, "y", None), ("last", 0, "live", None), ("dead", 0, "y", None), ("dead", 1, "lost", None), ("dead", 2, "d", None), ("gone", 0, "lost", None), ("gone", 1, "d", None)]
    s += [(i, 0, "x", None) for i in ("", "zero", "past", "kind", "lane", "poll")] + [("twice", 0, "x", None), ("twice", 1, "x", None)]
    slots = spark.createDataFrame(s, "fanin_id string, slot int, dependency_id string, captured binary")
    live, dead = jobs(spark, [{"id": "live"}]), jobs(spark, [{"id": "d"}])
    results = spark.createDataFrame([("x", b"new", 1), ("y", b"Y", 1), ("y", b"Y2", 2), ("live", b"early", 1)], "job_id string, blob binary, write_seq long")
    got, seen = workflow.watch(watchers, slots, live, dead, results, at(5))
    rows = {r.fanin_id: r for r in got.collect()}
    assert [bytes(x) for x in rows["ready"].results] == [b"kept", b"Y2"] and rows["ready"].next_key == "fanin:ready:callback"
    assert (rows["pend"].outcome, rows["pend"].next_generation, rows["pend"].next_key, rows["pend"].next_at) == ("pending", 3, "fiw:pend:3", 10_000_000_005)
    assert rows["last"].outcome == "exhausted" and (rows["dead"].reason, rows["dead"].cause) == ("missing_result", "lost") and rows["gone"].cause == "lost"
    reasons = {i: rows[i].reason for i in ("", "none", "zero", "past", "kind", "lane", "twice", "poll")}
    assert reasons == {"": "empty_id", "none": "no_dependencies", "zero": "generation", "past": "past_last_generation", "kind": "empty_kind", "lane": "bad_lane", "twice": "duplicate_dependency", "poll": "poll_delay"}
    held = {(r.fanin_id, r.slot): r.captured and bytes(r.captured) for r in seen.collect()}
    assert held["pend", 1] == b"Y2" and held["pend", 0] is None and held["dead", 0] == b"Y2" and held["dead", 2] is None


def test_scheduler_rounds(spark):
    defs = spark.createDataFrame([("a", "0 0 * * * *", "UTC", 0), ("b", "0 0 0 * * *", "UTC", 0), ("never", "0 0 0 30 2 *", "UTC", 0)], "schedule_id string, cron string, tz string, after long")
    cursors = schedule.next_due(defs).drop("after")
    assert ids(cursors.na.fill(-1), "schedule_id", "due") == [("a", 3600), ("b", 86400), ("never", -1)]
    assert schedule.wake_up(cursors).first().due == 3600 and schedule.wake_up(cursors.limit(0)).first().due is None
    marks = spark.createDataFrame([("a", 3600)], "schedule_id string, mark long")
    fired, moved = schedule.fire_due(cursors, marks.limit(0), 10_000, after=11_000)  # 7200 is missed and never made up for
    assert ids(fired, "schedule_id", "occurrence", "claimed", "unique_key") == [("a", 3600, True, "a:3600")]
    assert ids(moved.na.fill(-1), "schedule_id", "due") == [("a", 14400), ("b", 86400), ("never", -1)]
    assert ids(schedule.fire_due(cursors, marks, 10_000)[0], "claimed") == [False]  # another scheduler had it
    twice = defs.unionByName(defs.where("schedule_id = 'a'")).unionByName(spark.createDataFrame([("bad", "* *", "UTC", 0)], defs.schema))
    assert set(ids(schedule.check_definitions(twice), "schedule_id", "outcome")) == {("a", "duplicate_id"), ("b", "ok"), ("never", "ok"), ("bad", "invalid_cron")}


def test_claim_check_and_cleanup(spark):
    j = jobs(spark, [{"payload": b"x" * 20}, {"payload": b"small"}, {"payload": None}, {"payload": b"y" * 20}])
    sent, blobs = enqueue.offload(j, 10)
    assert ids(blobs, "key") == ["j1", "j4"]
    got = {r.id: (r.payload and bytes(r.payload), r.error_class) for r in enqueue.fetch(sent, blobs.where("key = 'j1'")).collect()}
    assert got == {"j1": (b"x" * 20, None), "j2": (b"small", None), "j3": (None, None), "j4": (None, "handler")}
    refs = sent.withColumn("blob_key", sc.claim_key(F.col("payload")))
    assert ids(inspect.orphaned(blobs, refs.where("id = 'j1'"), refs.limit(0)), "key") == ["j4"]


def test_worker_round(spark):
    calls = []

    def loud(kind, payload, inner):
        calls.append(kind)
        return inner(payload) + 1

    def fails(_):
        raise RuntimeError("no")

    handlers = worker.register(("good", lambda p: p["n"]), ("bad", fails), ("odd", lambda _: 1j))
    rows = [{"kind": "good", "payload": b'{"n": 4}'}, {"kind": "bad", "payload": b"1"}, {"kind": "bad", "payload": b"1", "attempts": 2}, {"kind": "odd", "payload": b"1"}, {"kind": "good", "payload": b"{"}, {"kind": "what"}, {"available_at": 999}]
    done = worker.work_round(jobs(spark, rows), handlers, at(100), 10)
    got = {r.id: (r.outcome, r.error_class) for r in done["attempts"].collect()}
    assert got == {"j1": ("succeeded", None), "j2": ("retried", "handler"), "j3": ("failed", "handler"), "j4": ("retried", "output_encode"), "j5": ("failed", "decode"), "j6": ("failed", "unknown_kind")}
    left = {r.id: (r.attempts, r.available_at, r.leased_until, r.deliveries) for r in done["jobs"].collect()}
    assert left == {"j2": (1, 1_000_000_100, None, 1), "j4": (1, 1_000_000_100, None, 1), "j7": (0, 999, None, 0)}
    assert ids(done["died"]) == ["j3", "j5", "j6"] and [(r.job_id, bytes(r.blob)) for r in done["results"].collect()] == [("j1", b"4")]
    assert worker.chain("k", lambda p: p * 10, (loud, loud))(2) == 22 and calls == ["k", "k"]
    for bad in ((), (("a", fails), ("a", fails))):
        with pytest.raises(ValueError):
            worker.register(*bad)


def test_command_line(spark, tmp_path):
    stores.save_snapshot(jobs(spark, [{"id": "x", "lane": "q"}]), str(tmp_path / "jobs"), schema.JOBS)
    dead = jobs(spark, [{"id": f"d{i}", "lane": "q"} for i in range(3)]).select("seq", "id", "lane", "priority", "kind", "payload", "attempts", "max_attempts", F.repeat(F.lit("e"), 70).alias("error"), "unique_key", F.lit(1).cast("long").alias("dead_at"))
    stores.save_snapshot(dead, str(tmp_path / "dead"), schema.DEAD)
    run = lambda *a: cli.run(spark, [a[0], str(tmp_path), *a[1:]])
    code, lines = run("list", "q", "--limit", "2")
    assert code == 0 and len(lines) == 2 and '"id":"d0"' in lines[0]
    assert run("list", "q", "--format", "table")[1][0] == "d0\tok\tq\t0\t3\t" + "e" * 60 + "…"
    assert run("list", "other") == (0, []) and run("stats", "q")[1][1:] == ["Dead-letter count:  3", "Pending job count:  1"]
    assert run("purge", "q")[0] == 1 and run("requeue", "nothing", "--yes") == (1, ["not_found"])
    assert run("requeue", "d1", "--yes") == (0, ["ok"]) and ids(stores.read_snapshot(spark, str(tmp_path / "jobs-next"), schema.JOBS)) == ["d1", "x"]
    assert run("purge", "q", "--yes") == (0, ["removed 3"]) and stores.read_snapshot(spark, str(tmp_path / "dead-next"), schema.DEAD).count() == 0


def test_envelope_limits(spark):
    trace = lambda n, size: {f"k{i}": "v" * size for i in range(n)}
    j = jobs(spark, [{"trace_context": trace(34, 1)}, {"trace_context": trace(35, 1)}, {"trace_context": trace(1, 9000)}, {"payload": b"z" * 400}])
    got = {r.id: (r.outcome, r.envelope is None) for r in stores.encode_envelopes(j, 1000).collect()}
    assert got == {"j1": ("ok", False), "j2": ("trace_entries", True), "j3": ("trace_bytes", True), "j4": ("envelope_bytes", True)}


def test_results_are_upserted(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "job_id string, write_seq long, blob string")
    new = spark.createDataFrame([("a", 3, "z"), ("c", 4, "w")], old.schema)
    assert ids(stores.upsert_results(old, new), "job_id", "blob") == [("a", "z"), ("b", "y"), ("c", "w")]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        scratch.folder(Elsewhere)


def test_jitter_against_plain_integers(spark):
    mask, rng = (1 << 64) - 1, random.Random(8)
    rows = [(rng.randrange(1 << 40), rng.randrange(9), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(200)] + [(None, 1, 1), (5, None, 1), (5, 1, None), (0, 0, 0)]
    df = spark.createDataFrame(rows, "d long, a long, s long")
    got = df.select("*", sc.jittered_ns(F.col("d"), F.col("a"), F.col("s"), 0.5, 1 << 39).alias("got")).collect()
    for r in got:
        if None in (r.d, r.a, r.s):
            assert r.got is None
            continue
        z = (r.s & mask) ^ (r.a * 0x9E3779B97F4A7C15 & mask)
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        assert r.got == min(int(r.d * (1.0 - 0.5 * ((z >> 11) / (1 << 53)))), 1 << 39)


def test_unique_keys(spark):
    live = jobs(spark, [{"id": "h", "unique_key": "k"}])
    new = spark.createDataFrame([(1, "a", "k"), (2, "b", "x"), (3, "c", "x"), (4, "d", None), (5, "e", None)], "ord long, id string, unique_key string")
    assert ids(enqueue.resolve_keys(live, new), "id", "returned") == [("a", "h"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "e")]


def test_live_ids_are_not_stored_again(spark):
    new = spark.createDataFrame([(1, "j1"), (2, "n"), (3, "n")], "ord long, id string")
    assert ids(enqueue.first_by_id(jobs(spark, [{}]), new), "id", "ord") == [("n", 2)]


def test_saturation(spark):
    assert value(spark, enqueue.available_at(at(5), F.lit(schema.I64_MAX))) == schema.I64_MAX
    assert value(spark, enqueue.available_at(at(5), at(6))) == 11


def test_publish(spark):
    routes = spark.createDataFrame([("t", ["old"], 1), ("t", ["a", "b"], 2), ("e", [], 3)], "topic string, lanes array<string>, ord int")
    got = enqueue.publish(spark.createDataFrame([(1, "t"), (2, "e"), (3, "?")], "m long, topic string"), routes)
    assert sorted((r.m, r.lane or "", r.outcome) for r in got.collect()) == [(1, "a", "ok"), (1, "b", "ok"), (3, "", "unknown_topic")]


def test_fan_out_rejects_keys_with_several_lanes(spark):
    new = jobs(spark, [{"unique_key": "k"}, {}])
    got = enqueue.fan_out(new, F.array(F.lit("a"), F.lit("b")))
    assert sorted((r.id, r.to_lane or "", r.outcome) for r in got.collect()) == [("j1", "", "keyed_fan_out"), ("j2", "a", "ok"), ("j2", "b", "ok")]


def test_claims_match_a_sequential_model(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([0, -1000, -(1 << 63), 123, rng.randint(-5, 500)]), rng.random() < 0.1) for i in range(300)]
    got = {r.ord: r.claimed for r in schedule.claims(spark.createDataFrame(rows, "ord long, schedule_id string, occurrence long, reset boolean")).collect()}
    mark = {}
    for o, s, occ, reset in rows:
        want = False
        if reset:
            mark.pop(s, None)
        elif s not in mark or occ > mark[s]:
            mark[s], want = occ, True
        assert got[o] == want


def test_cron_and_daylight_saving():
    day = 86400
    assert next(schedule.Cron("0 0 12 * * *").after(0)) == day // 2
    assert next(schedule.Cron("0 0 12 * * *").after(day // 2)) == day // 2 + day
    spring = schedule.Cron("0 30 2 * * *").after(1710003600, "America/New_York")  # 2024-03-09 12:00 there
    assert next(spring) >= 1710003600 + 20 * 3600
    autumn = schedule.Cron("0 30 1 * * *").after(1730592000, "America/New_York")
    first, second = next(autumn), next(autumn)
    assert first == 1730611800 and second - first >= 23 * 3600  # of the hour that occurs twice the first one
    assert next(schedule.Cron("0 30 1 * * *").after(1730613600, "America/New_York")) == second  # between the two
    with pytest.raises(ValueError):
        schedule.Cron("* * * * *")
    with pytest.raises(ValueError):
        schedule.Cron("61 * * * * *")


def requests(spark, rows):
    return spark.createDataFrame(rows, "ord long, op string, receipt string, delay_ns long, error string")


def test_resolution(spark):
    rows = [{"receipt": f"r{i}", "leased_until": 10, "attempts": schema.I64_MAX if i == 2 else 1} for i in range(1, 7)]
    j = jobs(spark, rows)
    r = resolve.matched(j, requests(spark, [(1, "ack", "r1", 0, ""), (2, "retry", "r2", 5, ""), (3, "defer", "r3", 5, ""), (4, "extend", "r4", 30, ""), (5, "fail", "r5", 0, "boom"), (6, "ack", "zz", 0, "")]), at(9))
    assert ids(r, "ord", "outcome")[-1] == (6, "stale")
    out = {x.id: x for x in resolve.apply(j, r, at(9)).collect()}
    assert set(out) == {"j2", "j3", "j4", "j6"}
    assert (out["j2"].attempts, out["j2"].available_at, out["j2"].receipt) == (schema.I64_MAX, 14, None)
    assert (out["j3"].attempts, out["j3"].available_at, out["j3"].leased_until) == (1, 14, None)
    assert (out["j4"].leased_until, out["j4"].receipt) == (39, "r4")
    assert ids(resolve.died(j, r, at(9)), "id", "error", "dead_at") == [("j5", "boom", 9)]
    late = resolve.matched(j, requests(spark, [(1, "ack", "r1", 0, "")]), at(10))
    assert ids(late, "outcome") == ["stale"]


def test_retention_matches_a_sequential_model(spark):
    rng = random.Random(3)
    t, rows, kept = 0, [], {}
    for i in range(200):
        t += rng.randint(0, 5)
        lane = rng.choice("abc")
        rows.append((i, lane, t))
        kept[lane] = [x for x in [*kept.get(lane, []), (i, t)] if x[1] >= t - 40][-4:]
    dead = spark.createDataFrame(rows, "seq long, lane string, dead_at long")
    assert ids(resolve.retain(dead, 40, 4), "seq") == sorted(i for v in kept.values() for i, _ in v)
    assert resolve.retain(dead, max_count=0).count() == 0


def test_requeue_outcomes_in_order(spark):
    dead = jobs(spark, [{"id": "a"}, {"id": "b", "unique_key": "k"}, {"id": "c", "unique_key": "k"}])
    live = jobs(spark, [{"id": "b"}, {"id": "z", "unique_key": "k"}])
    got = resolve.requeue_outcomes(dead, live, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"))
    assert ids(got, "id", "outcome") == [("a", "ok"), ("b", "live_conflict"), ("c", "key_held"), ("d", "not_found")]


def test_inspection(spark):
    live, dead = jobs(spark, [{"lane": "a"}, {"lane": "a"}]), jobs(spark, [{"lane": "b", "id": "j1"}, {"lane": "b", "id": "x"}])
    assert ids(inspect.stats(live, dead), "lane", "pending", "dead") == [("a", 2, 0), ("b", 0, 2)]
    asked = spark.createDataFrame([("j1",), ("x",), ("?",)], "id string")
    assert ids(inspect.classify(asked, live, dead), "id", "state") == [("?", "completed_or_unknown"), ("j1", "live"), ("x", "dead_lettered")]
    results = spark.createDataFrame([("j1", 1), ("r", 1), ("r", 2), ("x", 1)], "job_id string, write_seq long")
    assert ids(inspect.gated(results, live, dead), "job_id", "write_seq") == [("r", 2)]
    left, counts = resolve.purge(dead, spark.createDataFrame([("b",), ("none",)], "lane string"))
    assert left.count() == 0 and ids(counts, "lane", "removed") == [("b", 2), ("none", 0)]


def test_fan_in(spark):
    s = [("r", 0, "done", True), ("r", 1, "done", True), ("p", 0, "live", False), ("p", 1, "done", True), ("i", 0, "live", False), ("i", 1, "done", False), ("i", 2, "dead", False)]
    got = workflow.adjudicate(spark.createDataFrame(s, "fanin_id string, slot long, state string, has_result boolean"))
    assert ids(got.na.fill(-1), "fanin_id", "decision", "cause_slot") == [("i", "impossible", 1), ("p", "pending", -1), ("r", "ready", -1)]
    g = workflow.next_generation(spark.createDataFrame([("pending", 1), ("pending", 3), ("ready", 1)], "decision string, generation long"), most=3)
    assert ids(g, "generation", "outcome") == [(2, "requeued"), (4, "exhausted")]


def test_breaker(spark):
    rows = [("k", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, True), (32, False), (33, True), (34, True)])]
    got = metrics.breaker_states(spark.createDataFrame(rows, "kind string, seq long, t double, ok boolean"), 2, 30.0)
    assert [r.decision for r in got.orderBy("seq").collect()] == ["admitted", "admitted", "rejected", "probing", "rejected", "rejected"]


def test_scalars(spark):
    v = lambda c: value(spark, c)
    for text, ok in (("a", True), ("", False), (" a", False), ("a ", False), ("a\tb", False), ("é" * 128, True), ("é" * 129, False), (None, False)):
        assert v(sc.lane_valid(F.lit(text).cast("string"))) == ok, text
    assert v(sc.redact(F.lit("x postgres://u:p@ss@h/db?password=abc&sig=d end"))) == "x postgres://***@h/db?password=***&sig=*** end"
    assert v(sc.redact(F.lit("http://h/path@v2 design=x"))) == "http://h/path@v2 design=x"
    assert v(sc.redact(F.lit("amqp://tok@h"))) == "amqp://***@h"
    assert v(sc.truncate_chars(F.lit("é" * 61))) == "é" * 60 + "…"
    assert v(sc.truncate_bytes(F.lit("é" * 5), 5)) == "éé..."
    assert [v(sc.backoff_ns(at(n), 10, 2, 35)) for n in (0, 1, 2, 99)] == [10, 20, 35, 35]
    assert [v(sc.backoff_ns(at(n), 10, 0, 35)) for n in (0, 1, 2)] == [10, 0, 0]
    assert [v(sc.idle_wait_ns(at(n), 10, 5)) for n in (0, 3)] == [10, 10]
    assert v(sc.heartbeat_ns(at(30))) == 50_000_000 and v(sc.heartbeat_ns(at(3_000_000_000))) == 1_000_000_000
    assert v(sc.jittered_ns(at(1000), at(1), at(7), float("nan"), 5000)) == 1000
    assert v(sc.heartbeat_ns(at(3 * 9007199254740993))) == 9007199254740993 and v(sc.heartbeat_ns(F.lit(None).cast("long"))) is None
    assert [v(sc.truncate_bytes(F.lit(x), 6)) for x in ("abcdef", "abcdefg", "🙂🙂", "aéééé", "")] == ["abcdef", "abcdef...", "🙂...", "aéé...", ""]
    assert v(sc.truncate_bytes(F.lit(None).cast("string"))) is None and v(sc.truncate_bytes(F.lit("🙂"), 2)) == "..."
    assert v(sc.is_uuid(F.lit("0" * 8 + "-aAbB-0000-1111-" + "f" * 12))) and not v(sc.is_uuid(F.lit("x")))
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p]) if k else F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("map<string,string>")
    assert v(sc.inject(m(a="1", b="2"), m(b="3"))) == {"a": "1", "b": "3"} and v(sc.inject(none, m())) is None and v(sc.inject(none, m(a="1"))) == {"a": "1"}
    assert v(sc.inject(m(a="1"), none)) == {"a": "1"} and v(sc.propagated(m(baggage="1", x="2"))) == {"baggage": "1"} and v(sc.trace_valid(none))
    assert 500 < v(sc.jittered_ns(at(1000), at(1), at(7), 0.5, 5000)) <= 1000
    assert v(sc.claim_key(F.lit(sc.CLAIM_PREFIX + b"abc"))) == "abc" and v(sc.claim_key(F.lit(b"abc"))) is None
    assert v(sc.claim_key(F.lit(sc.CLAIM_PREFIX + b"\xff"))) is None
    assert v(sc.bad_key_character(F.lit("a*b:"))) == "*" and v(sc.safe_identifier(F.lit("9a"))) is False


def test_heartbeats_of_leases_beyond_a_long(spark):
    top = schema.I64_MAX
    leases = [-(10**37), 0, 150_000_002, 150_000_003, top, top + 1, 3075 * 3000000000000001, 3 * top - 1, 3 * top, 3 * top + 3, 10**37]
    rows = spark.createDataFrame([(Decimal(n),) for n in leases] + [(None,)], "n decimal(38,0)").select("n", sc.heartbeat_ns(F.col("n")).alias("h"))
    assert dict(rows.dtypes)["h"] == "bigint"
    assert {r.n: r.h for r in rows.collect()} == {None: None, **{n: min(max(n // 3, 50_000_000), top) for n in leases}}


def test_envelopes_round_trip(spark):
    j = jobs(spark, [{"payload": b"\x00\xffz"}, {"payload": b""}]).drop("trace_context").withColumn("trace_context", F.create_map(F.lit("traceparent"), F.lit("x")))
    back = stores.decode_envelopes(stores.encode_envelopes(j).select("envelope")).orderBy("id").collect()
    assert [bytes(r.payload) for r in back] == [b"\x00\xffz", b""] and back[0].trace_context == {"traceparent": "x"}


def test_snapshots_check_their_version(spark, tmp_path):
    j = jobs(spark, [{}, {"lane": "b"}])
    stores.save_snapshot(j, str(tmp_path / "s"), schema.JOBS)
    assert ids(stores.read_snapshot(spark, str(tmp_path / "s"), schema.JOBS)) == ["j1", "j2"]
    spark.range(1).select(F.lit(2).alias("version")).write.mode("overwrite").parquet(str(tmp_path / "s/version"))
    with pytest.raises(ValueError):
        stores.read_snapshot(spark, str(tmp_path / "s"), schema.JOBS)


def test_handlers_catch_errors_by_row(spark):
    def boom(_):
        raise RuntimeError("no")

    got = worker.run_handlers(jobs(spark, [{"kind": "a"}, {"kind": "b"}, {"kind": "c"}]), {"a": lambda p: p, "b": boom})
    assert [(r.id, r.error_class) for r in got.orderBy("id").collect()] == [("j1", None), ("j2", "handler"), ("j3", "unknown_kind")]


def _stream(spark, tmp_path, df, make, name):
    for i, part in enumerate(df.randomSplit([1.0], 1)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_claim_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 9), ("t", 1, -1)], "schedule_id string, ord long, occurrence long")
    got = _stream(spark, tmp_path, rows, lifecycle.claim_stream, "claims")
    assert ids(got, "schedule_id", "ord", "claimed") == [("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, True)]


def test_lease_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "reserve", 0, 10), ("a", 2, "reserve", 5, 10), ("a", 3, "reserve", 10, 10), ("a", 4, "extend", 12, 10), ("a", 5, "ack", 22, 0), ("a", 6, "reserve", 22, 5), ("a", 7, "ack", 23, 0), ("a", 8, "reserve", 40, 1)], "id string, ord long, op string, t long, lease long")
    got = _stream(spark, tmp_path, rows, lifecycle.lease_stream, "leases")
    assert [x[1] for x in ids(got, "ord", "outcome")] == ["reserved", "held", "redelivered", "extended", "stale", "redelivered", "acked", "gone"]


def test_cron_query_returns_the_whole_range(spark):
    from tallyspan.plans import catalog

    start, until, minute = 1704067200, 1735689600, 60
    rules = {
        "noon": ("UTC", 1704067200, lambda t: (t.hour, t.minute) == (12, 0)),
        "spring": ("America/New_York", 1709942400, lambda t: (t.hour, t.minute) == (2, 30)),
        "autumn": ("America/New_York", 1730505600, lambda t: (t.hour, t.minute) == (1, 30)),
        "work": ("Europe/Berlin", 1704067200, lambda t: t.minute % 15 == 0 and 9 <= t.hour <= 17 and t.isoweekday() <= 5),
    }
    moments = range(start, until + 1, minute)
    want = sorted((name, x) for name, (tz, after, rule) in rules.items() for z in [ZoneInfo(tz)] for x in moments if x > after and rule(t := datetime.fromtimestamp(x, z)) and not t.fold)
    got = catalog.q45_cron(spark, "")
    assert sorted(map(tuple, got.collect())) == want and sum(name == "work" for name, _ in want) == 9432
    defs = spark.createDataFrame([("a", "0 0 0 1 1 *", "UTC", -6000000000), ("b", "0 0 0 30 2 *", None, 0)], "schedule_id string, cron string, tz string, after long")
    assert schedule.occurrences(defs, until).count() == 2025 - 1780 + 1  # over more than 101 years
    assert schedule.occurrences(defs, until, limit=7, chunk=3).count() == 7
