"""Queries that apply the operators to the driver's tables, and SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions import scalars as sc
from tallyspan.operators import enqueue as enq
from tallyspan.operators import inspect as ins
from tallyspan.operators import metrics as met
from tallyspan.operators import resolve as res
from tallyspan.operators import schedule as sch
from tallyspan.operators import select as sel
from tallyspan.operators import workflow as wf
from tallyspan.schema import saturating_add
from tallyspan.sources.stores import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
JO_NOW, JE_NOW = "1996-06-01 00:00:00", "2024-01-20 00:00:00"
CUT = 7  # events whose id is a multiple of it are submitted anew


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def now(text: str):
    return F.lit(text).cast("timestamp_ntz")


def je(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs over ``events``."""
    e = load(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("seq"), n.cast("string").alias("id"), F.col("event_type").alias("lane"), F.col("event_type").alias("kind"), F.col("ts").alias("available_at"),
        F.col("user_id").cast("string").alias("unique_key"), (F.col("user_id") % 10).alias("priority"), (n % 6).alias("attempts"), (n % 4).alias("deliveries"),
        F.lit(5).cast("long").alias("max_attempts"), "value", "props", n.alias("ord"), F.when(n % 3 == 0, n % 11).alias("lease"), F.concat(F.lit("r"), n.cast("string")).alias("receipt"),
    )


JE = """je as (select event_id seq, cast(event_id as varchar) id, event_type lane, event_type kind, ts available_at, cast(user_id as varchar) unique_key,
 user_id % 10 priority, event_id % 6 attempts, event_id % 4 deliveries, cast(5 as bigint) max_attempts, value, props, event_id ord,
 case when event_id % 3 = 0 then event_id % 11 end lease, 'r' || event_id receipt from events)"""


def jo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs over ``orders``; many share a date."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("lane"), F.col("o_orderdate").alias("available_at"),
        (F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("long").alias("priority"), F.col("o_custkey").cast("string").alias("unique_key"),
    )


JO = """jo as (select o_orderkey seq, cast(o_orderkey as varchar) id, o_orderstatus lane, o_orderdate available_at,
 cast(5 - cast(substring(o_orderpriority, 1, 1) as int) as bigint) priority, cast(o_custkey as varchar) unique_key from orders)"""
DEAD = "lane = 'error'"


@query(f"with {JE}, old as (select * from je where seq % {CUT} <> 0), new as (select * from je where seq % {CUT} = 0) select id, (select max(seq) from old) + row_number() over (order by ord) seq from new")
def q01_enqueue(spark, sf_dir):
    j = je(spark, sf_dir)
    return enq.append(j.where(F.col("seq") % CUT != 0), j.where(F.col("seq") % CUT == 0).drop("seq")).select("id", "seq")


@query(f"with {JE} select id, cast(least(cast(seq as hugeint) * 1000000000000 + case when seq % 2 = 0 then 9223372036854775000 else 5 end, 9223372036854775807) as bigint) available_ns from je")
def q02_delay_saturation(spark, sf_dir):
    delay = F.when(F.col("seq") % 2 == 0, F.lit(9223372036854775000)).otherwise(F.lit(5).cast("long"))
    return je(spark, sf_dir).select("id", enq.available_at(F.col("seq") * F.lit(1000000000000), delay).alias("available_ns"))


@query(f"""with {JE}, live as (select id from je where seq % {CUT} <> 0), new as (select id, ord from je union all select id, case when seq % 2 = 0 then -ord - 1 else ord + 1000000000000 end from je)
select id, min(ord) ord from new where not exists (select 1 from live where live.id = new.id) group by id""")
def q03_id_idempotency(spark, sf_dir):
    """Every event is submitted twice, in both orders; those that are live already are replays."""
    j = je(spark, sf_dir)
    again = F.when(F.col("seq") % 2 == 0, -F.col("ord") - 1).otherwise(F.col("ord") + F.lit(1000000000000))
    new = j.select("id", "ord").unionAll(j.select("id", again.alias("ord")))
    return enq.first_by_id(j.where(F.col("seq") % CUT != 0).select("id"), new).select("id", "ord")


@query(f"with {JE} select id, first_value(id) over (partition by unique_key order by ord) returned, id = first_value(id) over (partition by unique_key order by ord) stored from je")
def q04_unique_key(spark, sf_dir):
    j = je(spark, sf_dir)
    return enq.resolve_keys(j.limit(0), j).select("id", "returned", "stored")


@query(f"""with {JE}, held as (select unique_key k, max(id) holder from je where cast(unique_key as bigint) % 2 = 0 group by unique_key),
new as (select *, case when seq % 9 = 0 then null else unique_key end k from je where not exists (select 1 from held where held.holder = je.id))
select new.id, coalesce(holder, case when new.k is null then new.id else first_value(new.id) over (partition by new.k order by new.ord) end) returned from new left join held on held.k = new.k""")
def q05_batch_keys(spark, sf_dir):
    """An event of each even key holds it; all others are the batch."""
    j = je(spark, sf_dir)
    held = j.where(F.col("unique_key").cast("long") % 2 == 0).groupBy("unique_key").agg(F.max("id").alias("id"))
    new = j.join(held.select("id"), "id", "left_anti").select("id", "ord", F.when(F.col("seq") % 9 != 0, F.col("unique_key")).alias("unique_key"))
    return enq.resolve_keys(held, new).select("id", "returned")


@query(f"""with {JO}, k as (select *, case when seq % 10 = 0 then unique_key end uk, case when seq % 4 = 0 then ['a'] else ['a', 'b', 'c'] end ls from jo)
select id, 'ok' outcome, ls[i + 1] to_lane, id || '/' || i new_id from k, unnest(range(len(ls))) u(i) where uk is null or len(ls) <= 1
union all select id, 'keyed_fan_out', null, null from k where uk is not null and len(ls) > 1""")
def q06_lane_fan_out(spark, sf_dir):
    j = jo(spark, sf_dir).withColumn("unique_key", F.when(F.col("seq") % 10 == 0, F.col("unique_key")))
    lanes = F.when(F.col("seq") % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abc")))
    return enq.fan_out(j, lanes).select("id", "outcome", "to_lane", "new_id")


_ROUTES = [("click", ["hot"], 1), ("click", ["hot", "audit"], 2), ("view", ["cold"], 3), ("error", ["alerts", "audit", "cold"], 4), ("purchase", [], 5)]
_ROUTES_SQL = "routes as (select * from (values ('click', ['hot', 'audit']), ('view', ['cold']), ('error', ['alerts', 'audit', 'cold']), ('purchase', cast([] as varchar[]))) t(topic, lanes))"


@query(f"""with {_ROUTES_SQL}, m as (select event_id, event_type topic, lanes from events left join routes on routes.topic = event_type)
select event_id, topic, l lane, 'ok' outcome from m, unnest(lanes) u(l) union all select event_id, topic, null, 'unknown_topic' from m where lanes is null""")
def q07_publish(spark, sf_dir):
    m = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("topic"))
    return enq.publish(m, spark.createDataFrame(_ROUTES, "topic string, lanes array<string>, ord int"))


@query(f"with {JE} select id, seq % 50 batch from je where seq % 50 not in (select seq % 50 from je where lane not in ('click', 'view', 'error') and seq % 50 < 25)  and not (seq % 50 < 25 and lane not in ('click', 'view', 'error')) and (seq % 50 < 25 or lane in ('click', 'view', 'error'))")
def q08_lane_allowlist(spark, sf_dir):
    j = je(spark, sf_dir).withColumn("batch", F.col("seq") % 50).where((F.col("batch") < 25) | F.col("lane").isin("click", "view", "error"))
    return enq.admit_batches(j, spark.createDataFrame([("click",), ("view",), ("error",)], "lane string")).select("id", "batch")


@query("select doc_id, strlen(text) > 4096 offload from documents")
def q09_claim_check(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", enq.offloaded(F.col("text"), 4096).alias("offload"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def q10_payload_decode(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""with c as (select 'sequence:' || conv_id || ':' || role k, turn ord, strlen(text) n from conversations)
select k, ord, n from (select *, row_number() over (partition by k order by ord) rn from c) where rn = 1""")
def q11_continuation(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    c = c.select(enq.continuation_key(F.col("conv_id").cast("string"), F.col("role")).alias("key"), F.col("turn").alias("ord"), F.octet_length("text").cast("long").alias("n"))
    return wf.continuations(c).select(F.col("key").alias("k"), "ord", "n")


_CLAIM = "max(case when not r then occ end) over (partition by lane, island order by ord rows between unbounded preceding and 1 preceding)"


@query(f"""with {JE}, c as (select lane, ord, cast(floor(value) as bigint) occ, false r, 0 island from je), m as (select *, {_CLAIM} mark from c)
select lane schedule_id, ord, occ occurrence, mark is null or occ > mark claimed from m""")
def q12_high_water(spark, sf_dir):
    c = je(spark, sf_dir).select(F.col("lane").alias("schedule_id"), "ord", F.floor("value").cast("long").alias("occurrence"))
    return sch.claims(c).select("schedule_id", "ord", "occurrence", "claimed")


@query(f"""with {JE}, c as (select lane, ord, cast(floor(value) as bigint) occ, seq % 97 = 0 r from je),
i as (select *, sum(cast(r as int)) over (partition by lane order by ord) island from c), m as (select *, {_CLAIM} mark from i)
select lane schedule_id, ord, not r and (mark is null or occ > mark) claimed from m""")
def q13_claims_with_resets(spark, sf_dir):
    c = je(spark, sf_dir).select(F.col("lane").alias("schedule_id"), "ord", F.floor("value").cast("long").alias("occurrence"), (F.col("seq") % 97 == 0).alias("reset"))
    return sch.claims(c).select("schedule_id", "ord", "claimed")


@query(f"with {JO} select id from jo where available_at <= timestamp '{JO_NOW}'")
def q14_visible(spark, sf_dir):
    return sel.visible(jo(spark, sf_dir), now(JO_NOW)).select("id")


@query(f"with {JE}, l as (select * from (values ('click'), ('view'), ('nothing')) t(lane)) select l.lane, count(je.id) pending from l left join je on je.lane = l.lane and je.kind <> 'error' group by l.lane")
def q15_pending(spark, sf_dir):
    lanes = spark.createDataFrame([("click",), ("view",), ("nothing",)], "lane string")
    return ins.counts(je(spark, sf_dir).where(f"not ({DEAD})"), lanes)


@query(f"with {JE} select lane, count(*) dead from je where attempts >= 5 group by lane")
def q16_dead_count(spark, sf_dir):
    return ins.counts(je(spark, sf_dir).where("attempts >= 5"), name="dead")


@query(f"with {JE} select lane, count(*) filter (attempts < 5) pending, count(*) filter (attempts >= 5) dead from je group by lane")
def q17_stats(spark, sf_dir):
    j = je(spark, sf_dir)
    return ins.stats(j.where("attempts < 5"), j.where("attempts >= 5"))


@query(f"""with {JE}, d as (select id, unique_key k from je where {DEAD}), live as (select id, case when seq % 20 = 0 and cast(unique_key as bigint) % 2 = 0 then unique_key end k from je where not ({DEAD}) or seq % 33 = 0),
held as (select distinct k from live where k is not null), r as (select id from je union all select 'x' || id from je)
select r.id, case when d.id is null then 'not_found' when live.id is not null then 'live_conflict' when held.k is not null then 'key_held' else 'ok' end outcome
from r left join d on d.id = r.id left join live on live.id = r.id left join held on held.k = d.k""")
def q18_requeue(spark, sf_dir):
    """Every id is asked for, and as many that don't exist; all that aren't dead are live."""
    j = je(spark, sf_dir)
    key = F.when((F.col("seq") % 20 == 0) & (F.col("unique_key").cast("long") % 2 == 0), F.col("unique_key"))
    live = j.where(f"not ({DEAD}) or seq % 33 = 0").select("id", key.alias("unique_key"))
    asked = j.select("id").unionAll(j.select(F.concat(F.lit("x"), F.col("id")).alias("id")))
    return res.requeue_outcomes(j.where(DEAD), live, asked)


@query(f"with {JE} select l.lane, count(je.id) removed from (values ('error'), ('nothing')) l(lane) left join je on je.lane = l.lane and attempts >= 5 group by l.lane")
def q19_purge(spark, sf_dir):
    return res.purge(je(spark, sf_dir).where("attempts >= 5"), spark.createDataFrame([("error",), ("nothing",)], "lane string"))[1]


_RANK = "row_number() over (partition by lane order by priority desc, available_at, seq)"


@query(f"with {JO}, v as (select id, lane, {_RANK} rank from jo where available_at <= timestamp '{JO_NOW}') select * from v where rank <= 16")
def q20_reserve(spark, sf_dir):
    return sel.reserve(jo(spark, sf_dir), now(JO_NOW), 16).select("id", "lane", "rank")


@query("""with r as (select cast(doc_id as varchar) job_id, quality, doc_id w from labels) select job_id, quality from r
where job_id not in (select cast(doc_id as varchar) from documents where doc_id % 5 = 0) and w % 7 <> 0""")
def q21_gated_result(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    r = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("job_id"), "quality", F.col("doc_id").alias("write_seq"))
    dead = r.where("write_seq % 7 = 0").select(F.col("job_id").alias("id"))
    return ins.gated(r, d.where("doc_id % 5 = 0"), dead).select("job_id", "quality")


@query("select event_id job_id from events where event_id % 13 = 0 or 5000 < event_id + event_id % 13 * 100")
def q22_result_ttl(spark, sf_dir):
    r = load(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_id").alias("stored_at"), (F.col("event_id") % 13 * 100).alias("ttl"))
    return ins.unexpired(r, F.lit(5000).cast("long")).select("job_id")


@query(f"with {JO} select id, {_RANK} rank from jo")
def q23_drain_order(spark, sf_dir):
    return sel.drain_order(jo(spark, sf_dir)).select("id", "rank")


@query(f"with {JE}, d as (select id, lane, row_number() over (partition by lane order by seq) rank from je where attempts >= 5) select * from d where rank <= 50")
def q24_list_dead(spark, sf_dir):
    return ins.list_dead(je(spark, sf_dir).where("attempts >= 5")).select("id", "lane", "rank")


@query("""with s as (select l_orderkey fanin_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) slot, l_returnflag f, l_linestatus t, l_linenumber n from lineitem),
g as (select fanin_id, count(*) members, count(*) filter (f <> 'R' and t <> 'O' and n <> 5) captured, bool_or(f = 'R' or (t <> 'O' and n = 5)) dead from s group by fanin_id)
select fanin_id, members, captured, case when dead then 'impossible' when captured = members then 'ready' else 'pending' end decision from g""")
def q25_fan_in(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    slot = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    state = F.when(F.col("l_returnflag") == "R", "dead").when(F.col("l_linestatus") == "O", "live").otherwise("done")
    s = x.select(F.col("l_orderkey").alias("fanin_id"), slot.alias("slot"), state.alias("state"), (F.col("l_linenumber") != 5).alias("has_result"))
    return wf.adjudicate(s).select("fanin_id", "members", "captured", "decision")


@query(f"""with {JE}, r as (select *, {_RANK} rank, deliveries >= 2 bad from je where available_at <= timestamp '{JE_NOW}'),
h as (select *, sum(case when bad then 0 else 1 end) over (partition by lane order by rank) ok from r)
select id, lane, rank, case when ok = 0 then 'dead' else 'reserve' end action from h where rank <= 128 and (ok = 0 or (ok = 1 and not bad))""")
def q26_poison_sweep(spark, sf_dir):
    return sel.poison_sweep(je(spark, sf_dir), now(JE_NOW), 2).select("id", "lane", "rank", "action")


@query(f"""with {JE}, c as (select id, 1 c from je where seq % 2 = 0 union all select id, 2 from je where seq % 3 = 0), m as (select id, min(c) c from c group by id)
select je.id, cast(coalesce(c, 0) as bigint) code, case coalesce(c, 0) when 1 then 'live' when 2 then 'dead_lettered' else 'completed_or_unknown' end state from je left join m on m.id = je.id""")
def q27_classify(spark, sf_dir):
    j = je(spark, sf_dir).select("id", "seq")
    return ins.classify(j.select("id"), j.where("seq % 2 = 0"), j.where("seq % 3 = 0"))


@query(r"""select doc_id, length(text) > 0 and strlen(text) <= 256 and not regexp_matches(text, '\p{Cc}') and not regexp_matches(text, '^\p{Z}|\p{Z}$') valid from documents
union all select -c_custkey, length(c_name) > 0 and strlen(c_name) <= 256 and not regexp_matches(c_name, '\p{Cc}') and not regexp_matches(c_name, '^\p{Z}|\p{Z}$') from customer""")
def q28_lane_validation(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", sc.lane_valid(F.col("text")).alias("valid"))
    return d.unionAll(load(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("doc_id"), sc.lane_valid(F.col("c_name")).alias("valid")))


@query("""select c_custkey, 'db://***@h/' || c_custkey || ' then http://h/path@v' || c_custkey || '?password=*** and SIG=***&x=1' redacted from customer""")
def q29_redaction(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    key, name = F.col("c_custkey").cast("string"), F.regexp_replace("c_name", r"[\s'\"]", "")
    text = F.concat(F.lit("db://user:"), name, F.lit("@h/"), key, F.lit(" then http://h/path@v"), key, F.lit("?password="), name, F.lit(" and SIG="), name, F.lit("&x=1"))
    return c.select("c_custkey", sc.redact(text).alias("redacted"))


@query("select doc_id, case when length(text) > 60 then substring(text, 1, 60) || '…' else text end shown from documents")
def q30_truncate_chars(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sc.truncate_chars(F.col("text")).alias("shown"))


_CLASS = "case when seq % 10 = 0 then 'unknown_kind' when seq % 10 = 1 then 'stale' when seq % 10 < 5 then 'handler' end"
_OUTCOME = f"case when {_CLASS} is null then 'succeeded' when {_CLASS} = 'unknown_kind' then 'failed' when {_CLASS} = 'stale' then 'stale' when attempts + 1 < max_attempts then 'retried' else 'failed' end"


def attempts(spark, sf_dir):
    return je(spark, sf_dir).withColumn("error_class", F.expr(_CLASS)).withColumn("outcome", sc.outcome(F.col("error_class"), F.col("attempts"), F.col("max_attempts")))


@query(f"with {JE}, a as (select lane, kind, {_OUTCOME} outcome from je) select lane, kind, outcome, count(*) jobs_total from a where outcome <> 'stale' group by all")
def q31_outcome_counter(spark, sf_dir):
    return met.outcomes(attempts(spark, sf_dir))


@query(f"with {JE}, b as (select * from (values ('1', 1.0), ('10', 10.0), ('100', 100.0), ('+Inf', 1e300)) t(le, b)) select lane, kind, le, count(*) filter (value <= b) n from je, b group by all")
def q32_duration_histogram(spark, sf_dir):
    return met.duration_buckets(je(spark, sf_dir).withColumn("seconds", F.col("value")), [1, 10, 100])


@query(f"""with {JE}, x as (select lane, kind, seq t, seq * 2 seq, 1 delta from je union all select lane, kind, seq + attempts * 10 + 1, seq * 2 + 1, -1 from je)
select lane, kind, seq, cast(sum(delta) over (partition by lane, kind order by t, seq) as bigint) in_flight from x""")
def q33_in_flight(spark, sf_dir):
    j = je(spark, sf_dir)
    start = j.select("lane", "kind", F.col("seq").alias("t"), (F.col("seq") * 2).alias("seq"), F.lit(1).alias("delta"))
    stop = j.select("lane", "kind", (F.col("seq") + F.col("attempts") * 10 + 1).alias("t"), (F.col("seq") * 2 + 1).alias("seq"), F.lit(-1).alias("delta"))
    return met.in_flight(start.unionByName(stop)).select("lane", "kind", "seq", "in_flight")


@query(f"with {JE}, t as (select id, cast(k as bigint) attempt, cast(least(1000000000 * power(2, k), 60000000000) as bigint) delay_ns from je, unnest(range(attempts + 1)) u(k)) select *, cast(sum(delay_ns) over (partition by id order by attempt) as bigint) total_ns from t")
def q34_retry_timeline(spark, sf_dir):
    t = je(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("attempts"))).alias("attempt"))
    t = t.withColumn("delay_ns", sc.backoff_ns(F.col("attempt"), 1_000_000_000, 2, 60_000_000_000))
    return t.withColumn("total_ns", F.expr("sum(delay_ns) over (partition by id order by attempt)"))


@query("select cast(i as bigint) empties, cast(least(250000000 * power(2, least(i, 40)), 5000000000) as bigint) wait_ns from range(200) r(i)")
def q35_idle_wait(spark, sf_dir):
    return spark.range(200).select(F.col("id").alias("empties"), sc.idle_wait_ns(F.col("id"), 250_000_000, 5_000_000_000).alias("wait_ns"))


@query(f"with {JE}, b as (select lane schedule_id, min(seq) a, max(seq) u from je group by lane) select schedule_id, cast(o as bigint) occurrence from b, unnest(range((a // 60 + 1) * 60, u + 1, 60)) t(o)")
def q36_fixed_step(spark, sf_dir):
    b = je(spark, sf_dir).groupBy(F.col("lane").alias("schedule_id")).agg(F.min("seq").alias("after"), F.max("seq").alias("until"))
    return sch.fixed_step(b, 60)


def requests(j: DataFrame) -> DataFrame:
    op = F.when(F.col("seq") % 5 == 0, "ack").when(F.col("seq") % 5 == 1, "retry").when(F.col("seq") % 5 == 2, "defer").when(F.col("seq") % 5 == 3, "extend").otherwise("fail")
    return j.where("seq % 2 = 0").select("ord", op.alias("op"), "receipt", (F.col("seq") % 17).alias("delay_ns"), F.concat(F.lit("e"), F.col("id")).alias("error"))


def leased(spark, sf_dir) -> DataFrame:
    """Jobs with numbers as clock: available since their number, a third of them under leases up to 10."""
    return je(spark, sf_dir).select("seq", "id", "receipt", "lane", "kind", "priority", F.col("seq").alias("available_at"), F.col("lease").alias("leased_until"), "deliveries", "attempts", "max_attempts", "unique_key", F.lit(None).cast("binary").alias("payload"), "ord")


_REQ = "case seq % 5 when 0 then 'ack' when 1 then 'retry' when 2 then 'defer' when 3 then 'extend' else 'fail' end op, seq % 17 delay"
_VALID = "seq % 2 = 0 and coalesce(lease > 4, false)"


@query(f"with {JE}, r as (select *, {_REQ}, {_VALID} ok from je) select id from r where not (ok and op in ('ack', 'fail'))")
def q37_ack(spark, sf_dir):
    j, t = leased(spark, sf_dir), F.lit(4).cast("long")
    return res.apply(j, res.matched(j, requests(j), t), t).select("id")


@query(f"""with {JE}, r as (select *, {_REQ}, {_VALID} ok from je)
select id, case when ok and op in ('retry', 'defer') then 4 + delay else seq end available_at, case when ok and op in ('retry', 'defer') then null when ok and op = 'extend' then 4 + delay else lease end leased_until,
 case when ok and op = 'retry' then attempts + 1 else attempts end attempts, case when ok and op in ('retry', 'defer') then null else receipt end receipt from r where not (ok and op in ('ack', 'fail'))""")
def q38_retry_defer_extend(spark, sf_dir):
    j, t = leased(spark, sf_dir), F.lit(4).cast("long")
    return res.apply(j, res.matched(j, requests(j), t), t).select("id", "available_at", "leased_until", "attempts", "receipt")


@query(f"with {JE}, r as (select *, {_REQ}, {_VALID} ok from je), d as (select id, lane, 'e' || id error, ord, row_number() over (partition by lane order by ord desc) rn from r where ok and op = 'fail') select id, lane, error from d where rn <= 20")
def q39_fail(spark, sf_dir):
    j, t = leased(spark, sf_dir), F.lit(4).cast("long")
    dead = res.died(j, res.matched(j, requests(j), t), t)
    return res.retain(dead, max_count=20).select("id", "lane", "error")


@query(f"""with {JE}, m as (select *, max(seq) over (partition by lane) last from je), a as (select * from m where seq >= last - 2000),
r as (select id, lane, row_number() over (partition by lane order by seq desc) rn from a) select id, lane from r where rn <= 300""")
def q40_retention(spark, sf_dir):
    return res.retain(je(spark, sf_dir).withColumn("dead_at", F.col("seq")), max_age=2000, max_count=300).select("id", "lane")


@query(f"with {JE} select id, {_OUTCOME} outcome from je")
def q41_failure_decision(spark, sf_dir):
    return attempts(spark, sf_dir).select("id", "outcome")


@query("""with a as (select user_id, event_id, event_type <> 'error' ok from events), i as (select *, sum(cast(ok as int)) over (partition by user_id order by event_id) island from a),
r as (select user_id kind, event_id seq, row_number() over (partition by user_id, island order by event_id) run from i where not ok) select * from r where run = 2""")
def q42_breaker_openings(spark, sf_dir):
    a = load(spark, sf_dir, "events").select(F.col("user_id").alias("kind"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return met.breaker_openings(a, 2).select("kind", "seq", "run")


_M64 = "18446744073709551616::uhugeint"


@query(f"""with {JE}, a as (select id, xor(seq::uhugeint, (attempts::uhugeint * 11400714819323198485::uhugeint) % {_M64}) z, least(1000000000 * power(2, attempts), 60000000000) d from je),
b as (select id, d, (xor(z, z // 1073741824::uhugeint) * 13787848793156543929::uhugeint) % {_M64} z from a), c as (select id, d, (xor(z, z // 134217728::uhugeint) * 10723151780598845931::uhugeint) % {_M64} z from b),
u as (select id, d, cast(xor(z, z // 2147483648::uhugeint) // 2048::uhugeint as double) / 9007199254740992 u from c) select id, cast(least(trunc(d * (1.0 - 0.5 * u)), 60000000000) as bigint) delay_ns from u""")
def q43_jitter(spark, sf_dir):
    j = je(spark, sf_dir)
    d = sc.backoff_ns(F.col("attempts"), 1_000_000_000, 2, 60_000_000_000)
    return j.select("id", sc.jittered_ns(d, F.col("attempts"), F.col("seq"), 0.5, 60_000_000_000).alias("delay_ns"))


@query("""with t as (select doc_id, text, list_max(list_filter(range(128, 513), lambda k: strlen(left(text, k)) <= 512)) k from documents)
select doc_id, case when strlen(text) <= 512 then text else left(text, k) || '...' end shown from t""")
def q44_truncate_bytes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sc.truncate_bytes(F.col("text")).alias("shown"))


@query("""with d as (select * from (values ('noon', 'UTC', 1704067200), ('spring', 'America/New_York', 1709942400), ('autumn', 'America/New_York', 1730505600), ('work', 'Europe/Berlin', 1704067200)) t(schedule_id, tz, a)),
m as (select schedule_id, x, timezone(tz, to_timestamp(x)) w from d, unnest(range(a + 60, 1735689600 + 1, 60)) u(x)),
k as (select * from m where case schedule_id when 'noon' then hour(w) = 12 and minute(w) = 0 when 'spring' then hour(w) = 2 and minute(w) = 30 when 'autumn' then hour(w) = 1 and minute(w) = 30
 else minute(w) % 15 = 0 and hour(w) between 9 and 17 and isodow(w) <= 5 end)
select schedule_id, min(x) occurrence from k group by schedule_id, w""")
def q45_cron(spark, sf_dir):
    defs = [("noon", "0 0 12 * * *", "UTC", 1704067200), ("spring", "0 30 2 * * *", "America/New_York", 1709942400), ("autumn", "0 30 1 * * *", "America/New_York", 1730505600), ("work", "0 */15 9-17 * * MON-FRI", "Europe/Berlin", 1704067200)]
    return sch.occurrences(spark.createDataFrame(defs, "schedule_id string, cron string, tz string, after long"), 1735689600)


@query(f"""with recursive {JE}, a as (select kind, seq, cast(seq as double) t, value > 100 ok, row_number() over (partition by kind order by seq) n from je),
s as (select kind, cast(0 as bigint) n, cast(null as bigint) seq, 0 fails, cast(null as double) ends, '' decision from (select distinct kind from a)
 union all select kind, n, seq, case when rejected then fails when ok then 0 when probe or fails + 1 >= 3 then 0 else fails + 1 end, case when rejected then ends when not ok and (probe or fails + 1 >= 3) then t + 30.0 end,
 case when rejected then 'rejected' when probe then 'probing' else 'admitted' end
 from (select a.*, s.fails, s.ends, coalesce(a.t < s.ends, false) rejected, s.ends is not null probe from s join a on a.kind = s.kind and a.n = s.n + 1))
select kind, seq, decision from s where seq is not null""")
def q46_breaker_states(spark, sf_dir):
    a = je(spark, sf_dir).select("kind", "seq", F.col("seq").cast("double").alias("t"), (F.col("value") > 100).alias("ok"))
    return met.breaker_states(a, 3, 30.0)


@query(f"""with {JE} select id, cast(least(seq + 9223372036854770000, 9223372036854775807) as bigint) leased_until from (select id, cast(seq as hugeint) seq from je)""")
def q47_lease_saturation(spark, sf_dir):
    return je(spark, sf_dir).select("id", saturating_add(F.col("seq"), F.lit(9223372036854770000)).alias("leased_until"))
