"""Queries over operators that take several tables or steps: requeue, fan-in watching, scheduler rounds, offload, envelopes, worker rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan.functions import scalars as sc
from tallyspan.operators import enqueue as enq
from tallyspan.operators import inspect as ins
from tallyspan.operators import resolve as res
from tallyspan.operators import schedule as sch
from tallyspan.operators import workflow as wf
from tallyspan.plans.catalog import _REQ, _VALID, DEAD, JE, je, leased, query, requests
from tallyspan.sources import stores
from tallyspan.streaming import worker

LATER = 7_000_000_000


@query(f"""with {JE}, d as (select *, case when seq % 3 = 0 then unique_key end k from je where {DEAD}), live as (select *, case when seq % 20 = 0 and not ({DEAD}) then unique_key end k from je where not ({DEAD}) or seq % 33 = 0),
free as (select *, row_number() over (partition by k order by seq) turn from d where id not in (select id from live) and (k is null or k not in (select k from live where k is not null))),
moved as (select * from free where k is null or turn = 1)
select id, seq, attempts, deliveries, seq available_at from live union all
select id, (select max(seq) from live) + row_number() over (order by seq), attempts, 0, {LATER} from moved""")
def q51_requeue_move(spark, sf_dir):
    """The live jobs after every dead job was asked back twice."""
    j = leased(spark, sf_dir)
    key = lambda when: F.when(when, F.col("unique_key")).alias("unique_key")
    columns = ["seq", "id", "receipt", "lane", "available_at", "leased_until", "deliveries", "attempts"]
    dead = j.where(DEAD).select("seq", "id", "lane", "attempts", key(F.col("seq") % 3 == 0))
    live = j.where(f"not ({DEAD}) or seq % 33 = 0").select(*columns, key((F.col("seq") % 20 == 0) & ~F.expr(DEAD)))
    asked = j.select("ord", "id").unionAll(j.select(F.col("ord") + F.lit(1 << 40), "id"))
    return res.requeue(dead, live, asked, F.lit(LATER))[0].select("id", "seq", "attempts", "deliveries", "available_at")


_SLOT = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


@query(f"""with x as (select l_orderkey o, {_SLOT} slot, l_linenumber n, l_returnflag f, l_linestatus t from lineitem),
s as (select o, slot, o || '/' || slot dep, n, n = 7 held, f = 'R' and n % 2 = 0 dead, not (f = 'R' and n % 2 = 0) and t = 'O' and n % 3 <> 0 live from x),
v as (select *, held or not dead and not live done, held or n <> 3 res from s),
g as (select o, count(*) members, count(*) filter (done and res) captured, min(slot) filter (dead and not held or done and not res) stop, string_agg(case when held then 'early' else dep end, ',' order by slot) results from v group by o),
b as (select *, case when o % 5 < 1 then 'generation' when o % 5 > 3 then 'past_last_generation' when o % 11 = 0 then 'bad_lane' end reason, o % 5 gen from g),
r as (select b.*, case when reason is not null then 'malformed' when stop is not null then 'impossible' when captured = members then 'ready' when gen >= 3 then 'exhausted' else 'pending' end outcome, v.dead c from b left join v on v.o = b.o and v.slot = b.stop)
select cast(o as varchar) fanin_id, outcome, case when outcome = 'impossible' then case when c then 'dead_lettered' else 'missing_result' end else reason end reason, case when outcome = 'impossible' then o || '/' || stop end cause,
case when outcome <> 'malformed' then captured end captured, case when outcome = 'ready' then results end results,
case outcome when 'pending' then 'fiw:' || o || ':' || (gen + 1) when 'ready' then 'fanin:' || o || ':callback' end next_key, case when outcome = 'pending' then {LATER} + 10000000000 end next_at from r""")
def q52_fan_in_watch(spark, sf_dir):
    """One poll of a fan-in for each order, whose lines are its dependencies."""
    x = stores.load(spark, sf_dir, "lineitem").withColumn("slot", F.expr(_SLOT))
    order, n = F.col("l_orderkey"), F.col("l_linenumber")
    dead = (F.col("l_returnflag") == "R") & (n % 2 == 0)
    dep = F.concat_ws("/", order.cast("string"), F.col("slot").cast("string"))
    slots = x.select(order.cast("string").alias("fanin_id"), "slot", dep.alias("dependency_id"), F.when(n == 7, F.encode(F.lit("early"), "UTF-8")).alias("captured"))
    w = x.select(order).distinct().select(
        order.cast("string").alias("fanin_id"), (order % 5).alias("generation"), F.lit(3).alias("max_generations"), F.lit(wf.POLL_DELAY_S).alias("poll_delay_s"),
        F.lit("sum").alias("callback_kind"), F.when(order % 11 == 0, " ").otherwise("default").alias("callback_lane"),
    )
    jobs = x.where(~dead & (F.col("l_linestatus") == "O") & (n % 3 != 0)).select(dep.alias("id"))
    results = x.where(n != 3).select(dep.alias("job_id"), F.encode(dep, "UTF-8").alias("blob"), F.lit(1).alias("write_seq"))
    got, _ = wf.watch(w, slots, jobs, x.where(dead).select(dep.alias("id")), results, F.lit(LATER))
    shown = F.array_join(F.transform("results", lambda b: F.decode(b, "UTF-8")), ",")
    return got.select("fanin_id", "outcome", "reason", "cause", "captured", shown.alias("results"), "next_key", "next_at")


@query("""with t as (select event_type schedule_id, cast(floor(epoch(ts)) as bigint) t from events), b as (select *, max(t) over (partition by schedule_id order by t rows between unbounded preceding and 1 preceding) before from t)
select schedule_id, t, case when (before // 900 + 1) * 900 <= t then (before // 900 + 1) * 900 end occurrence from b""")
def q53_scheduler_rounds(spark, sf_dir):
    """Quarter-hourly schedules of a scheduler that wakes at each event: one occurrence a wake-up, no backfill."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")
    ticks = stores.load(spark, sf_dir, "events").select(F.col("event_type").alias("schedule_id"), F.lit("0 */15 * * * *").alias("cron"), F.lit("UTC").alias("tz"), t)
    return sch.fired_at(ticks).select("schedule_id", "t", "occurrence")


@query("select doc_id, case when strlen(text) > 4096 and doc_id % 10 = 0 then null else strlen(text) end n, case when strlen(text) > 4096 and doc_id % 10 = 0 then 'handler' end error_class from documents")
def q54_claim_check_fetch(spark, sf_dir):
    """Large texts go to the blob store and come back; a tenth of the blobs are lost there."""
    d = stores.load(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("payload"))
    jobs, blobs = enq.offload(d, 4096)
    got = enq.fetch(jobs, blobs.where("cast(key as bigint) % 10 <> 0"))
    return got.select("doc_id", F.length("payload").cast("long").alias("n"), "error_class")


@query(f"""with {JE}, o as (select *, case when seq % 10 = 3 then 'trace_bytes' when seq % 40 > 34 then 'trace_entries' else 'ok' end outcome from je)
select 'o' || id as key, outcome, case when outcome = 'ok' then id end id, case when outcome = 'ok' then lane end lane, case when outcome = 'ok' then props end payload,
case when outcome = 'ok' then attempts end attempts, case when outcome = 'ok' then priority else 0 end priority, case when outcome = 'ok' then seq % 40 end n_trace from o""")
def q55_envelopes(spark, sf_dir):
    """Every event as an envelope and back; some have trace contexts over the limits."""
    n = F.col("seq") % 40
    keys = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("k"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    small = F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("v")))
    trace = F.when(F.col("seq") % 10 == 3, F.create_map(F.lit("big"), F.repeat(F.lit("x"), 9000))).otherwise(small)
    j = je(spark, sf_dir).withColumn("payload", F.encode("props", "UTF-8")).withColumn("priority", F.col("priority").cast("int")).withColumn("trace_context", trace)
    sent = stores.encode_envelopes(j).select(F.concat(F.lit("o"), F.col("id")).alias("key"), "outcome", "envelope")
    back = stores.decode_envelopes(sent)
    return back.select("key", "outcome", "id", "lane", F.decode("payload", "UTF-8").alias("payload"), "attempts", F.col("priority").cast("long").alias("priority"), F.cardinality("trace_context").cast("long").alias("n_trace"))


@query(f"""with {JE}, c as (select *, seq % 3 = 0 as none, seq % 4 = 0 as idle from je)
select id, case when not idle then 'new' || id when not none then 'old' || id end traceparent,
cast(case when none and idle then null when none then 2 when idle then 2 else 3 end as bigint) n, cast(case when none and idle then null when none then 2 when idle then 1 else 2 end as bigint) n_propagated, true valid from c""")
def q56_trace_inject(spark, sf_dir):
    pair = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    own = F.when(F.col("seq") % 3 != 0, pair("traceparent", F.concat(F.lit("old"), F.col("id")), "x", "y"))
    current = F.when(F.col("seq") % 4 != 0, pair("traceparent", F.concat(F.lit("new"), F.col("id")), "baggage", "b")).otherwise(F.create_map().cast("map<string,string>"))
    j = je(spark, sf_dir).withColumn("c", sc.inject(own, current))
    n = lambda c: F.cardinality(c).cast("long")
    return j.select("id", F.col("c")["traceparent"].alias("traceparent"), n(F.col("c")).alias("n"), n(sc.propagated(F.col("c"))).alias("n_propagated"), sc.trace_valid(F.col("c")).alias("valid"))


@query("select event_id, max(cast(floor(value * 100) as bigint)) over (order by event_id rows unbounded preceding) now from events")
def q57_clock(spark, sf_dir):
    e = stores.load(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ord"), F.floor(F.col("value") * 100).cast("long").alias("now"))
    return sch.non_decreasing(e).select("event_id", "now")


@query(f"with {JE} select seq, id, kind, lane, attempts, max_attempts, 'e' || id as error from je where attempts >= 5")
def q58_dead_snapshot(spark, sf_dir):
    return ins.dead_snapshot(je(spark, sf_dir).where("attempts >= 5").withColumn("error", F.concat(F.lit("e"), F.col("id"))))


@query(f"with {JE} select count(*) live, count(*) = 0 as empty from je where attempts < 5")
def q59_live_total(spark, sf_dir):
    return ins.total(je(spark, sf_dir).where("attempts < 5"))


@query(f"""with {JE}, f as (select *, row_number() over (partition by unique_key order by seq) nth from je), r as (select *, {_REQ}, {_VALID} ok from f where nth = 1),
held as (select unique_key k, id from r where not (ok and op in ('ack', 'fail')))
select 'n' || unique_key as id, coalesce(held.id, 'n' || unique_key) returned from (select distinct unique_key from je) u left join held on held.k = u.unique_key""")
def q60_key_release(spark, sf_dir):
    """The first job of each key holds it; where it was acked or failed, the key's next submission is stored."""
    j, t = leased(spark, sf_dir), F.lit(4).cast("long")
    first = j.groupBy("unique_key").agg(F.min("seq").alias("seq"))
    holders = j.join(first, ["unique_key", "seq"], "left_semi")
    left = res.apply(holders, res.matched(holders, requests(j), t), t)
    new = first.select(F.concat(F.lit("n"), F.col("unique_key")).alias("id"), F.col("seq").alias("ord"), "unique_key")
    return enq.resolve_keys(left, new).select("id", "returned")


def _double(payload):
    if payload["k"] % 3 == 0:
        raise ValueError("a multiple of three")
    return payload["k"] * 2


@query(f"""with {JE}, v as (select *, cast(json_extract_string(props, '$.k') as bigint) k, row_number() over (partition by lane order by priority desc, seq) rank from je),
c as (select *, case when kind = 'signup' then 'unknown_kind' when seq % 5 = 0 then 'decode' when k % 3 = 0 then 'handler' end e from v where rank <= 500),
o as (select *, case when e is null then 'succeeded' when e in ('unknown_kind', 'decode') then 'failed' when attempts + 1 < max_attempts then 'retried' else 'failed' end outcome from c)
select id, outcome, e error_class, cast(case when outcome = 'retried' then least(1000000000 * power(2, attempts), 60000000000) else 0 end as bigint) delay_ns, case when e is null then cast(k * 2 as varchar) end result from o""")
def q61_work_round(spark, sf_dir):
    """500 jobs of each lane through handlers; one kind has none, a fifth of the payloads are broken."""
    payload = F.when(F.col("seq") % 5 == 0, "not json").otherwise(F.col("props"))
    j = je(spark, sf_dir).withColumn("payload", F.encode(payload, "UTF-8")).withColumn("available_at", F.col("seq")).withColumn("receipt", F.lit(None).cast("string"))
    j = j.withColumn("leased_until", F.lit(None).cast("long")).drop("lease", "value", "props", "ord")
    handlers = worker.register(*[(kind, _double) for kind in ("click", "error", "purchase", "view")])
    done = worker.work_round(j, handlers, F.lit(1 << 50), 500)
    return done["attempts"].select("id", "outcome", "error_class", F.col("delay_ns").cast("long").alias("delay_ns"), F.decode("result", "UTF-8").alias("result"))


@query(f"""with {JE} select id, case when seq % 2 = 0 then 'default' else lane end lane, cast(case when seq % 5 = 0 then 9 else 5 end as bigint) max_attempts, case when seq % 3 = 0 then 0 else priority end priority,
case when seq % 7 = 0 then {LATER} else {LATER} + seq * 10 end available_at, cast(0 as bigint) deliveries from je""")
def q62_job_options(spark, sf_dir):
    unless = lambda k, c: F.when(F.col("seq") % k != 0, c)
    j = je(spark, sf_dir).select(
        "id", "seq", unless(2, F.col("lane")).alias("lane"), F.when(F.col("seq") % 5 == 0, F.lit(9).cast("long")).alias("max_attempts"),
        unless(3, F.col("priority")).alias("priority"), unless(7, F.col("seq") * 10).alias("delay_ns"),
    )
    return enq.prepare(j, F.lit(LATER)).select("id", "lane", "max_attempts", F.col("priority").cast("long").alias("priority"), "available_at", "deliveries")


@query(r"""select c_custkey, regexp_full_match(c_name, '[A-Za-z_][A-Za-z0-9_]{0,62}') safe, regexp_extract(k, '[:*?\[\]]') bad, regexp_full_match(u, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') uuid,
greatest(c_custkey * 3000000000000001 // 3, 50000000) heartbeat from (select *, c_name || case c_custkey % 4 when 0 then '*' when 1 then ':?' when 2 then ']' else '' end k,
case when c_custkey % 2 = 0 then '00000000-0000-0000-0000-' || lpad(cast(c_custkey as varchar), 12, '0') else c_name end u from customer)""")
def q63_identifiers(spark, sf_dir):
    """Identifier rules over customers; the SQL fails from key 3075 on, whose lease is beyond a long, here it is a decimal."""
    c = stores.load(spark, sf_dir, "customer")
    n, key = F.col("c_custkey"), F.col("c_custkey") % 4
    segment = F.concat("c_name", F.when(key == 0, "*").when(key == 1, ":?").when(key == 2, "]").otherwise(""))
    text = F.when(n % 2 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))).otherwise(F.col("c_name"))
    lease = n.cast("decimal(20,0)") * F.lit(3_000_000_000_000_001)
    return c.select("c_custkey", sc.safe_identifier(F.col("c_name")).alias("safe"), sc.bad_key_character(segment).alias("bad"), sc.is_uuid(text).alias("uuid"), sc.heartbeat_ns(lease).alias("heartbeat"))


@query(f"with {JE} select distinct seq % 4 schedule_id, case when seq % 4 = 3 then 'duplicate_id' when seq % 4 = 0 then 'invalid_cron' else 'ok' end outcome from je")
def q64_schedule_definitions(spark, sf_dir):
    """One definition for each rest of the event numbers modulo 4; the last one comes twice, the first one is no cron text."""
    n = (F.col("seq") % 4).alias("n")
    rows = je(spark, sf_dir).select(n).distinct()
    rows = rows.unionAll(rows.where("n = 3"))
    defs = rows.select(F.col("n").alias("schedule_id"), F.when(F.col("n") == 0, "every day").otherwise("0 0 * * * *").alias("cron"), F.lit("UTC").alias("tz"))
    return sch.check_definitions(defs).select("schedule_id", "outcome").distinct()
