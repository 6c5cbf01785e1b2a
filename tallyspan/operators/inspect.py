"""Inspection: states, counts, listings and result reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.schema import STATES, saturating_add


def counts(jobs: DataFrame, lanes: DataFrame | None = None, name: str = "pending") -> DataFrame:
    """Rows by lane; with ``lanes`` a row for each of them, 0 where there are none."""
    got = jobs.groupBy("lane").agg(F.count(F.lit(1)).alias(name))
    return got if lanes is None else lanes.select("lane").distinct().join(got, "lane", "left").select("lane", F.coalesce(name, F.lit(0)).alias(name))


def stats(jobs: DataFrame, dead: DataFrame) -> DataFrame:
    both = counts(jobs).join(counts(dead, name="dead"), "lane", "full_outer")
    return both.select("lane", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("dead", F.lit(0)).alias("dead"))


def classify(ids: DataFrame, jobs: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, code, state) for each requested id; live wins over dead."""
    codes = jobs.select("id", F.lit(1).alias("c")).unionByName(dead.select("id", F.lit(2).alias("c"))).groupBy("id").agg(F.min("c").alias("c"))
    code = F.coalesce("c", F.lit(0)).cast("long")
    name = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return ids.join(codes, "id", "left").select("id", code.alias("code"), F.element_at(name, code.cast("int")).alias("state"))


def list_dead(dead: DataFrame, n: int = 50) -> DataFrame:
    """The oldest ``n`` of each lane with their rank."""
    w = Window.partitionBy("lane").orderBy("seq")
    return dead.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def total(jobs: DataFrame) -> DataFrame:
    """One row: live jobs of all lanes, and whether there are none."""
    return jobs.agg(F.count(F.lit(1)).alias("live")).select("live", (F.col("live") == 0).alias("empty"))


def dead_snapshot(dead: DataFrame) -> DataFrame:
    """The dead letters of all lanes as they are listed, with their number for ordering."""
    return dead.select("seq", "id", "kind", "lane", "attempts", "max_attempts", "error")


def latest(results: DataFrame) -> DataFrame:
    """The last write of each job."""
    w = Window.partitionBy("job_id").orderBy(F.desc("write_seq"))
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def gated(results: DataFrame, jobs: DataFrame, dead: DataFrame) -> DataFrame:
    """Results of jobs that are neither live nor dead."""
    key = lambda df: df.select(F.col("id").alias("job_id"))
    return latest(results).join(key(jobs), "job_id", "left_anti").join(key(dead), "job_id", "left_anti")


def unexpired(results: DataFrame, now: Column) -> DataFrame:
    """Results whose time to live has not passed; null and zero mean that there is none."""
    none = F.col("ttl").isNull() | (F.col("ttl") <= 0)
    return results.where(none | (now < saturating_add(F.col("stored_at"), F.col("ttl"))))


def orphaned(blobs: DataFrame, jobs: DataFrame, dead: DataFrame) -> DataFrame:
    """Blobs that no live or dead job refers to by ``blob_key``."""
    used = jobs.select("blob_key").unionByName(dead.select("blob_key")).where("blob_key is not null")
    return blobs.join(used.withColumnRenamed("blob_key", "key"), "key", "left_anti")
