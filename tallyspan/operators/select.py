"""Selection: visibility, reservation, drain order and the sweep of poison jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.operators.ordered import Ordered
from tallyspan.schema import LEASE_NS, MAX_SWEEP, saturating_add


def visible(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that are due and not under a lease; both bounds are inclusive."""
    free = F.col("leased_until").isNull() | (F.col("leased_until") <= now) if "leased_until" in jobs.columns else F.lit(True)
    return jobs.where((F.col("available_at") <= now) & free)


def in_order():
    """Order of a lane: highest priority, then longest due, then first in."""
    return Window.partitionBy("lane").orderBy(F.desc("priority"), "available_at", "seq")


def drain_order(jobs: DataFrame) -> DataFrame:
    """All jobs with their place in the lane; a lane of any size is spread over tasks."""
    return Ordered(jobs, ["lane"], [F.desc("priority"), "available_at", "seq"]).running("rank", "count", F.lit(1)).result


def first_in_order(jobs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` jobs of each lane with their rank; Spark limits each group before it shuffles."""
    return jobs.withColumn("rank", F.row_number().over(in_order()).cast("long")).where(F.col("rank") <= k)


def reserve(jobs: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The first ``k`` visible jobs of each lane with their rank."""
    return first_in_order(visible(jobs, now), k)


def lease(jobs: DataFrame, now: Column, k: int = 1, lease_ns: int = LEASE_NS) -> DataFrame:
    """Jobs after a reservation: the chosen ones have a receipt, a lease and one more delivery."""
    chosen = reserve(jobs, now, k).select(F.col("id").alias("chosen"))
    j = jobs.join(chosen, jobs.id == chosen.chosen, "left")
    hit = F.col("chosen").isNotNull()
    receipt = F.sha1(F.concat_ws("|", "id", (F.col("deliveries") + 1).cast("string"), now.cast("string")))
    return j.select(*[
        F.when(hit, receipt).otherwise(F.col(c)).alias(c) if c == "receipt"
        else F.when(hit, saturating_add(now, F.lit(lease_ns))).otherwise(F.col(c)).alias(c) if c == "leased_until"
        else (F.col(c) + hit.cast("long")).alias(c) if c == "deliveries"
        else F.col(c)
        for c in jobs.columns
    ])


def poison_sweep(jobs: DataFrame, now: Column, max_deliveries: int, cap: int = MAX_SWEEP) -> DataFrame:
    """What one reservation with a delivery bound does in each lane: rows with action ``dead`` or ``reserve``.

    In order, jobs already delivered ``max_deliveries`` times or more are dead-lettered up to the first one that is
    not, which is reserved; after ``cap`` of them nothing is reserved.
    """
    # At most ``cap`` jobs of a lane count, so no window sees more.
    ranked = first_in_order(visible(jobs, now), cap).withColumn("over", F.col("deliveries") >= max_deliveries)
    healthy = F.sum(F.when(F.col("over"), 0).otherwise(1)).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranked.withColumn("healthy", healthy)
        .withColumn("action", F.when(F.col("healthy") == 0, "dead").when((F.col("healthy") == 1) & ~F.col("over"), "reserve"))
        .where("action is not null").drop("over", "healthy")
    )
