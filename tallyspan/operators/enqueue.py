"""Submission: sequence numbers, idempotency, unique keys, fan-out, routing, payload offload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.scalars import claim_key, claim_reference
from tallyspan.operators.ordered import Ordered
from tallyspan.schema import DEFAULT_LANE, DEFAULT_MAX_ATTEMPTS, OFFLOAD_BYTES, saturating_add


def available_at(now: Column, delay_ns: Column) -> Column:
    return saturating_add(now, delay_ns)


def append(jobs: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """``new`` with sequence numbers after the last of ``jobs``, in input order; no task sees all rows."""
    numbered = Ordered(new, [], [order]).running("__n", "count", F.lit(1)).result
    last = jobs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))  # one row
    return numbered.join(F.broadcast(last)).withColumn("seq", (F.col("__last") + F.col("__n")).cast("long")).drop("__n", "__last")


def first_by_id(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Submissions that are stored: the first of each id that is not live yet."""
    w = Window.partitionBy("id").orderBy("ord")
    return new.join(jobs.select("id"), "id", "left_anti").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def resolve_keys(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the id that each submission returns and whether it is stored.

    The live holder of a unique key wins, else the key's first submission; a null key never dedups. Ids of
    ``new`` are unique and not live, so that one window by key is exact.
    """
    holders = jobs.where("unique_key is not null").select(F.col("unique_key").alias("held"), F.col("id").alias("holder"))
    keyed = new.where("unique_key is not null")
    # Partial aggregates and a join, which Spark can split where a key is hot; a window could not be.
    first = keyed.groupBy(F.col("unique_key").alias("taken")).agg(F.min_by("id", "ord").alias("first"))
    known = first.join(holders, first.taken == holders.held, "left").select("taken", F.coalesce("holder", "first").alias("returned"))
    got = keyed.join(known, keyed.unique_key == known.taken).drop("taken")
    return got.unionByName(new.where("unique_key is null").withColumn("returned", F.col("id"))).withColumn("stored", F.col("returned") == F.col("id"))


def fan_out(new: DataFrame, lanes: Column) -> DataFrame:
    """A submission for each lane, with a fresh id; a unique key with several lanes is an error row.

    Column ``outcome`` is ``ok`` or ``keyed_fan_out``.
    """
    bad = F.col("unique_key").isNotNull() & (F.size(lanes) > 1)
    ok = new.where(~bad).select("*", F.posexplode(lanes).alias("slot", "to_lane")).withColumn("outcome", F.lit("ok"))
    err = new.where(bad).withColumn("slot", F.lit(None).cast("int")).withColumn("to_lane", F.lit(None).cast("string")).withColumn("outcome", F.lit("keyed_fan_out"))
    return ok.unionByName(err).withColumn("new_id", F.when(F.col("outcome") == "ok", F.concat_ws("/", "id", "slot")))


def publish(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """A row for each message and lane of its topic; unknown topics give one row with outcome ``unknown_topic``.

    An empty route gives no row. Of repeated routes the last one by ``ord`` holds.
    """
    last = routes.groupBy("topic").agg(F.max_by("lanes", "ord").alias("lanes"))
    j = messages.join(last, "topic", "left")
    known = j.where("lanes is not null").select(*messages.columns, F.explode("lanes").alias("lane"), F.lit("ok").alias("outcome"))
    return known.unionByName(j.where("lanes is null").select(*messages.columns, F.lit(None).cast("string").alias("lane"), F.lit("unknown_topic").alias("outcome")))


def admit_batches(new: DataFrame, allowed: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches with each lane in ``allowed``: one unknown lane rejects its batch as a whole."""
    bad = new.join(allowed.select("lane"), "lane", "left_anti").select(batch).distinct()
    return new.join(bad, batch, "left_anti")


def prepare(new: DataFrame, now: Column, lane: str = DEFAULT_LANE, max_attempts: int = DEFAULT_MAX_ATTEMPTS, priority: int = 0) -> DataFrame:
    """``new`` with a submitter's options: lane, attempts and priority where a row sets none, due after its ``delay_ns``."""
    fill = {"lane": F.lit(lane), "max_attempts": F.lit(max_attempts).cast("long"), "priority": F.lit(priority), "delay_ns": F.lit(0).cast("long")}
    cols = {k: F.coalesce(F.col(k), v) if k in new.columns else v for k, v in fill.items()}
    delay = cols.pop("delay_ns")
    fresh = {"attempts": F.lit(0).cast("long"), "deliveries": F.lit(0).cast("long"), "available_at": available_at(now, delay)}
    return new.select(*[c for c in new.columns if c not in cols and c not in fresh and c != "delay_ns"], *[v.alias(k) for k, v in (cols | fresh).items()])


def offload(jobs: DataFrame, threshold: int = OFFLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(jobs with large payloads replaced by references, blobs (key, blob)); a job's id is the key of its blob.

    The blobs are to be written before the jobs.
    """
    large = offloaded(F.col("payload"), threshold)
    blobs = jobs.where(large).select(F.col("id").alias("key"), F.col("payload").alias("blob"))
    return jobs.withColumn("payload", F.when(large, claim_reference(F.col("id"))).otherwise(F.col("payload"))), blobs


def fetch(jobs: DataFrame, blobs: DataFrame) -> DataFrame:
    """``jobs`` with the payloads that handlers see, and error_class ``handler`` where a reference has no blob."""
    held = blobs.select(F.col("key").alias("__key"), F.col("blob").alias("__blob"))
    j = jobs.withColumn("__claim", claim_key(F.col("payload")))
    plain = j.where("__claim is null").withColumn("error_class", F.lit(None).cast("string"))
    found = j.where("__claim is not null").join(held, F.col("__claim") == F.col("__key"), "left")
    found = found.withColumn("error_class", F.when(F.col("__blob").isNull(), "handler")).withColumn("payload", F.col("__blob")).drop("__key", "__blob")
    return plain.unionByName(found).drop("__claim")


def offloaded(payload: Column, threshold: int = OFFLOAD_BYTES) -> Column:
    """Whether a payload goes to the blob store: strictly over the threshold."""
    return F.octet_length(payload) > threshold


def continuation_key(parent: Column, kind: Column) -> Column:
    return F.concat(F.lit("sequence:"), parent, F.lit(":"), kind)
