"""Fan-in: what a watcher finds about the jobs that it waits for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.scalars import lane_valid
from tallyspan.operators.inspect import classify, latest
from tallyspan.schema import saturating_add


def adjudicate(slots: DataFrame) -> DataFrame:
    """(fanin_id, members, captured, cause_slot, decision) from rows (fanin_id, slot, state, has_result).

    state is ``live``, ``dead`` or ``done``. A dead member, or a done one without result, makes the whole
    impossible; the first in slot order is the cause. Else it is ready if all are done, or pending.
    """
    fatal = (F.col("state") == "dead") | ((F.col("state") == "done") & ~F.col("has_result"))
    g = slots.groupBy("fanin_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if((F.col("state") == "done") & F.col("has_result")).alias("captured"),
        F.min(F.when(fatal, F.col("slot"))).alias("cause_slot"),
    )
    return g.withColumn("decision", F.when(F.col("cause_slot").isNotNull(), "impossible").when(F.col("captured") == F.col("members"), "ready").otherwise("pending"))


#: Default polling of a watcher, and its keys and its callback's.
POLL_DELAY_S, MAX_GENERATIONS = 10, 8640
WATCHER_KEY, CALLBACK_KEY = "fiw:{}:{}", "fanin:{}:callback"


def malformed(watchers: DataFrame, slots: DataFrame) -> DataFrame:
    """``watchers`` with column ``reason``: what is wrong with a watcher's payload, or null.

    Watchers are (fanin_id, generation, max_generations, poll_delay_s, callback_kind, callback_lane), slots (fanin_id, slot,
    dependency_id, captured).
    """
    per = slots.groupBy("fanin_id", "dependency_id").agg(F.count(F.lit(1)).alias("n")).groupBy("fanin_id").agg(F.max("n").alias("__most"))
    j = watchers.join(per, "fanin_id", "left")
    reason = (
        F.when(F.coalesce(F.col("fanin_id"), F.lit("")) == "", "empty_id").when(F.col("__most").isNull(), "no_dependencies")
        .when(F.col("poll_delay_s") < 1, "poll_delay").when(F.col("generation") < 1, "generation").when(F.col("generation") > F.col("max_generations"), "past_last_generation")
        .when(F.coalesce(F.col("callback_kind"), F.lit("")) == "", "empty_kind").when(~lane_valid(F.col("callback_lane")), "bad_lane").when(F.col("__most") > 1, "duplicate_dependency")
    )
    return j.withColumn("reason", reason).drop("__most")


def observe(slots: DataFrame, jobs: DataFrame, dead: DataFrame, results: DataFrame) -> DataFrame:
    """``slots`` with state and has_result of their dependencies; what is captured stays so, and new results are captured.

    A result counts only once its job is neither live nor dead. Nothing is captured past a fan-in's first fatal slot.
    """
    codes = classify(slots.select(F.col("dependency_id").alias("id")).distinct(), jobs, dead).select(F.col("id").alias("dependency_id"), "code")
    blobs = latest(results).select(F.col("job_id").alias("dependency_id"), F.col("blob").alias("__blob"))
    j = slots.join(codes, "dependency_id", "left").join(blobs, "dependency_id", "left")
    done = F.col("captured").isNotNull()
    state = F.when(done, "done").when(F.col("code") == 1, "live").when(F.col("code") == 2, "dead").otherwise("done")
    j = j.withColumn("state", state).withColumn("has_result", done | F.col("__blob").isNotNull())
    fatal = (F.col("state") == "dead") | ((F.col("state") == "done") & ~F.col("has_result"))
    first = j.where(fatal).groupBy("fanin_id").agg(F.min("slot").alias("__stop"))
    j = j.join(first, "fanin_id", "left")
    seen = (F.col("state") == "done") & (F.col("__stop").isNull() | (F.col("slot") < F.col("__stop")))
    return j.withColumn("captured", F.when(done, F.col("captured")).when(seen, F.col("__blob"))).drop("code", "__blob", "__stop")


def watch(watchers: DataFrame, slots: DataFrame, jobs: DataFrame, dead: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(one row a watcher, slots with what is captured now): one poll of each fan-in.

    outcome is malformed, impossible, ready, exhausted or pending. A pending watcher comes again with its next generation,
    key and time; a ready one gives its callback's key and the results in slot order. cause names the fatal dependency.
    """
    judged = malformed(watchers, slots)
    ok = judged.where("reason is null").drop("reason")
    seen = observe(slots.join(ok.select("fanin_id"), "fanin_id", "left_semi"), jobs, dead, results)
    fatal = (F.col("state") == "dead") | ~F.col("has_result") & (F.col("state") == "done")
    # A fan-in's results are the payload of one callback job.
    more = seen.groupBy("fanin_id").agg(
        F.min(F.when(fatal, F.struct("slot", "dependency_id", "state"))).alias("__cause"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "captured"))), lambda x: x["captured"]).alias("__results")
    )
    j = ok.join(adjudicate(seen).select("fanin_id", "members", "captured", "decision"), "fanin_id").join(more, "fanin_id")
    last = F.col("generation") >= F.col("max_generations")
    outcome = F.when((F.col("decision") == "pending") & last, "exhausted").otherwise(F.col("decision"))
    j = j.withColumn("outcome", outcome).withColumn("reason", F.when(F.col("outcome") == "impossible", F.when(F.col("__cause.state") == "dead", "dead_lettered").otherwise("missing_result")))
    j = j.withColumn("cause", F.when(F.col("outcome") == "impossible", F.col("__cause.dependency_id"))).withColumn("results", F.when(F.col("outcome") == "ready", F.col("__results")))
    out = j.unionByName(judged.where("reason is not null").withColumn("outcome", F.lit("malformed")), allowMissingColumns=True)
    pending, ready = F.col("outcome") == "pending", F.col("outcome") == "ready"
    generation = F.col("generation") + 1
    key = F.when(pending, F.format_string(WATCHER_KEY.replace("{}", "%s"), "fanin_id", generation.cast("string"))).when(ready, F.format_string(CALLBACK_KEY.replace("{}", "%s"), "fanin_id"))
    due = F.when(pending, saturating_add(now, F.col("poll_delay_s").cast("long") * F.lit(1_000_000_000)))
    out = out.withColumn("next_generation", F.when(pending, generation)).withColumn("next_key", key).withColumn("next_at", due)
    return out.select("fanin_id", "outcome", "reason", "cause", "members", "captured", "results", "next_generation", "next_key", "next_at"), seen.select(*slots.columns)


def next_generation(decided: DataFrame, generation: str = "generation", most: int = 8640) -> DataFrame:
    """Pending watchers with their next generation, or outcome ``exhausted`` past the last one."""
    g = F.col(generation) + 1
    return decided.where("decision = 'pending'").withColumn(generation, g).withColumn("outcome", F.when(g > most, "exhausted").otherwise("requeued"))


def continuations(steps: DataFrame) -> DataFrame:
    """The first row of each continuation ``key`` by ``ord``."""
    w = Window.partitionBy("key").orderBy("ord")
    return steps.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
