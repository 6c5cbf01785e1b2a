"""Resolution of reserved jobs, requeue, purge and retention. State moves by joins; no table is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.operators.enqueue import append
from tallyspan.schema import I64_MAX, saturating_add


def matched(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``requests`` with the id that their receipt holds and an outcome ``ok`` or ``stale``; a lease must still run."""
    held = jobs.where(F.col("leased_until") > now).select("receipt", F.col("id").alias("job_id"))
    return requests.join(held, "receipt", "left").withColumn("outcome", F.when(F.col("job_id").isNotNull(), "ok").otherwise("stale"))


def apply(jobs: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Jobs after ack, retry, defer, extend and fail: rows of ``resolved`` (op, job_id, delay_ns) with outcome ok."""
    r = resolved.where("outcome = 'ok'").select("job_id", "op", "delay_ns")
    j = jobs.join(r, jobs.id == r.job_id, "left").where("op is null or op not in ('ack', 'fail')")
    back = F.coalesce(F.col("op").isin("retry", "defer"), F.lit(False))
    longer = F.coalesce(F.col("op") == "extend", F.lit(False))
    due = saturating_add(now, F.coalesce("delay_ns", F.lit(0)))
    more = F.coalesce(F.try_add(F.col("attempts"), F.lit(1).cast("long")), F.lit(I64_MAX))
    new = {
        "available_at": F.when(back, due).otherwise(F.col("available_at")),
        "leased_until": F.when(longer, due).when(~back, F.col("leased_until")),
        "receipt": F.when(~back, F.col("receipt")),
        "attempts": F.when(F.coalesce(F.col("op") == "retry", F.lit(False)), more).otherwise(F.col("attempts")),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def died(jobs: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Dead-letter rows of the failed requests, numbered by request; ``dead_at`` is ``now``."""
    r = resolved.where("outcome = 'ok' and op = 'fail'").select("job_id", "error", F.col("ord").alias("seq"))
    return jobs.drop("seq", "error").join(r, jobs.id == r.job_id).select("seq", "id", "lane", "priority", "kind", "payload", "attempts", "max_attempts", "error", "unique_key", now.alias("dead_at"))


def retain(dead: DataFrame, max_age: int | None = None, max_count: int | None = None) -> DataFrame:
    """Dead letters left after each failure pruned its lane: by age of the lane's last failure, then the newest."""
    out = dead
    if max_age is not None:
        last = dead.groupBy("lane").agg(F.max("dead_at").alias("__last"))
        out = out.join(last, "lane").where(F.col("dead_at") >= F.col("__last") - max_age).drop("__last")
    if max_count is not None:
        out = out.withColumn("__rn", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("seq")))).where(F.col("__rn") <= max_count).drop("__rn")
    return out


def requeue_outcomes(dead: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (id) with an outcome, in this order: not_found, live_conflict, key_held, ok."""
    d = dead.select("id", F.col("unique_key").alias("key"), F.lit(True).alias("found"))
    live = jobs.select("id", F.lit(True).alias("live"))
    held = jobs.where("unique_key is not null").select(F.col("unique_key").alias("key"), F.lit(True).alias("held")).distinct()
    j = requests.join(d, "id", "left").join(live, "id", "left").join(held, "key", "left")
    code = F.when(F.col("found").isNull(), "not_found").when(F.col("live").isNotNull(), "live_conflict").when(F.col("held").isNotNull(), "key_held").otherwise("ok")
    return j.select(*requests.columns, code.alias("outcome"))


def requeue(dead: DataFrame, jobs: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live jobs, dead letters, ``requests`` (ord, id) with outcome) after requests in their order move dead jobs back.

    A moved job keeps its attempts, is due ``now``, has no deliveries and a new number, and takes its key again. Of several
    requests for one id the first moves it and the later ones don't find it; of several jobs with one key the first takes it.
    """
    asked = requests.groupBy("id").agg(F.min("ord").alias("__first"))
    keys = dead.select("id", F.col("unique_key").alias("__key"))
    judged = requeue_outcomes(dead, jobs, asked).join(keys, "id", "left")
    free = judged.where("outcome = 'ok' and __key is not null").groupBy("__key").agg(F.min("__first").alias("__wins"))
    judged = judged.join(free, "__key", "left")
    judged = judged.withColumn("outcome", F.when((F.col("outcome") == "ok") & (F.col("__first") > F.col("__wins")), "key_held").otherwise(F.col("outcome")))
    judged = judged.select("id", "__first", F.col("outcome").alias("__outcome"))
    again = (F.col("__outcome") == "ok") & (F.col("ord") > F.col("__first"))
    outcomes = requests.join(judged, "id").withColumn("outcome", F.when(again, "not_found").otherwise(F.col("__outcome"))).drop("__first", "__outcome")
    moved = dead.join(judged.where("__outcome = 'ok'").select("id", F.col("__first").alias("ord")), "id")
    fresh = {
        "available_at": now, "deliveries": F.lit(0).cast("long"), "receipt": F.lit(None).cast("string"),
        "leased_until": F.lit(None).cast(jobs.schema["leased_until"].dataType if "leased_until" in jobs.columns else "long"),
    }
    moved = append(jobs, moved.drop("seq"))
    columns = [fresh[c].alias(c) if c in fresh else F.col(c) if c in moved.columns else F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns]
    return jobs.unionByName(moved.select(*columns)), dead.join(judged.where("__outcome = 'ok'").select("id"), "id", "left_anti"), outcomes


def purge(dead: DataFrame, lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, lane and count of what is removed)."""
    removed = dead.join(lanes.select("lane"), "lane", "left_semi").groupBy("lane").agg(F.count(F.lit(1)).alias("removed"))
    counts = lanes.select("lane").distinct().join(removed, "lane", "left").select("lane", F.coalesce("removed", F.lit(0)).alias("removed"))
    return dead.join(lanes.select("lane"), "lane", "left_anti"), counts
