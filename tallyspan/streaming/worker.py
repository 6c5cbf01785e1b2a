"""A worker's round as tables: reserve, run handlers, route outcomes, store results, resolve."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.scalars import backoff_ns, outcome
from tallyspan.operators import resolve
from tallyspan.operators.enqueue import fetch
from tallyspan.operators.select import lease
from tallyspan.schema import LEASE_NS
from tallyspan.scratch import materialise

Handler = Callable[[Any], Any]
Middleware = Callable[[str, Any, Handler], Any]
_HANDLED = "id string, kind string, result binary, error_class string, error string"


def register(*pairs: tuple[str, Handler]) -> dict[str, Handler]:
    """Handlers by kind; a kind that comes twice, or none at all, is an error."""
    out: dict[str, Handler] = {}
    for kind, f in pairs:
        if kind in out:
            raise ValueError(f"handler of kind {kind!r} is registered twice")
        out[kind] = f
    if not out:
        raise ValueError("no handlers registered")
    return out


def chain(kind: str, handler: Handler, middleware: tuple[Middleware, ...] = ()) -> Handler:
    """``handler`` within ``middleware``, the first one outermost; each is called with kind, payload and what comes next."""
    return reduce(lambda inner, m: lambda payload: m(kind, payload, inner), reversed(middleware), handler)


def run_handlers(jobs: DataFrame, handlers: dict[str, Handler], middleware: tuple[Middleware, ...] = ()) -> DataFrame:
    """(id, kind, result, error_class, error) of each job: its JSON payload through its kind's handler.

    error_class is unknown_kind, decode, handler or output_encode, or null; an error is caught for its row. A job that comes
    with an ``error_class`` keeps it and is not run.
    """
    ready = {k: chain(k, f, middleware) for k, f in handlers.items()}
    src = jobs if "error_class" in jobs.columns else jobs.withColumn("error_class", F.lit(None).cast("string"))

    def one(kind, payload, known):
        if known is not None:
            return None, known, "payload is missing"
        if kind not in ready:
            return None, "unknown_kind", kind
        try:
            value = json.loads(payload)
        except (ValueError, TypeError) as e:
            return None, "decode", str(e)
        try:
            got = ready[kind](value)
        except Exception as e:  # of user code
            return None, "handler", str(e)
        try:
            return json.dumps(got).encode(), None, None
        except (ValueError, TypeError) as e:
            return None, "output_encode", str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [one(k, p, None if pd.isna(c) else c) for k, p, c in zip(pdf["kind"], pdf["payload"], pdf["error_class"], strict=True)]
            made = pd.DataFrame(got, columns=["result", "error_class", "error"], dtype=object)
            yield pd.concat([pdf[["id", "kind"]].reset_index(drop=True), made], axis=1)

    return src.select("id", "kind", "payload", "error_class").mapInPandas(run, _HANDLED)


def work_round(
    jobs: DataFrame, handlers: dict[str, Handler], now: Column, k: int = 1, lease_ns: int = LEASE_NS, blobs: DataFrame | None = None, middleware: tuple[Middleware, ...] = (),
    base_ns: int = 1_000_000_000, factor: int = 2, cap_ns: int = 60_000_000_000,
) -> dict[str, DataFrame]:
    """One round over the first ``k`` visible jobs of each lane: tables ``jobs``, ``died``, ``results`` and ``attempts``.

    ``results`` are to be written before ``jobs``, so that a job is gone only once its result is there. Handlers may run
    again if a task is lost; what they returned is written once and all tables follow from that.
    """
    leased = materialise(lease(jobs, now, k, lease_ns), "leased")
    held = leased.where((F.col("leased_until") > now) & F.col("receipt").isNotNull())
    before = jobs.select("id", F.col("receipt").alias("__was"))
    taken = held.join(before, "id").where(~F.col("receipt").eqNullSafe(F.col("__was"))).drop("__was")
    payloads = taken if blobs is None else fetch(taken, blobs)
    handled = materialise(run_handlers(payloads, handlers, middleware), "handled")
    j = taken.join(handled.drop("kind"), "id").withColumn("outcome", outcome(F.col("error_class"), F.col("attempts"), F.col("max_attempts")))
    op = F.when(F.col("outcome") == "succeeded", "ack").when(F.col("outcome") == "retried", "retry").otherwise("fail")
    delay = F.when(F.col("outcome") == "retried", backoff_ns(F.col("attempts"), base_ns, factor, cap_ns)).otherwise(0)
    attempts = j.select("id", "lane", "kind", "attempts", "receipt", "error_class", "error", "outcome", F.col("seq").alias("ord"), op.alias("op"), delay.alias("delay_ns"), "result")
    resolved = resolve.matched(leased, attempts.select("ord", "op", "receipt", "delay_ns", "error"), now)
    return {
        "jobs": resolve.apply(leased, resolved, now), "died": resolve.died(leased, resolved, now),
        "results": attempts.where("op = 'ack'").select(F.col("id").alias("job_id"), F.col("result").alias("blob")), "attempts": attempts,
    }
