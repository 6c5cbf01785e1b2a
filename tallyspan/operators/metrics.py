"""Metrics over attempt logs, and breaker openings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.operators.ordered import Ordered


def outcomes(attempts: DataFrame) -> DataFrame:
    """jobs_total by lane, kind and outcome; stale and deferred resolutions are not events."""
    return attempts.where("outcome not in ('stale', 'deferred')").groupBy("lane", "kind", "outcome").agg(F.count(F.lit(1)).alias("jobs_total"))


def duration_buckets(attempts: DataFrame, bounds: list[float]) -> DataFrame:
    """(lane, kind, le, n): cumulative counts of ``seconds`` up to each bound and to infinity, as ``+Inf``."""
    g = attempts.groupBy("lane", "kind").agg(*[F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("seconds").alias("b_all"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("n"))]
    return g.select("lane", "kind", F.explode(F.array(*rows)).alias("x")).select("lane", "kind", "x.*")


def in_flight(edges: DataFrame) -> DataFrame:
    """``edges`` (lane, kind, t, seq, delta) with the running gauge by lane and kind."""
    return Ordered(edges, ["lane", "kind"], ["t", "seq"]).running("in_flight", "sum", F.col("delta").cast("long")).result


def breaker_openings(attempts: DataFrame, threshold: int = 5) -> DataFrame:
    """Rows (kind, seq, ok) at which a run of failures reaches ``threshold``."""
    a = Ordered(attempts, ["kind"], ["seq"]).running("island", "sum", F.col("ok").cast("long"))
    a = a.running("run", "count", F.when(~F.col("ok"), 1), ["island"]).result
    return a.where(~F.col("ok") & (F.col("run") == threshold)).drop("island")


def breaker_states(attempts: DataFrame, threshold: int = 5, open_s: float = 30.0) -> DataFrame:
    """(kind, seq, decision): each attempt admitted, probing or rejected, by a state machine for each kind.

    Sequential by nature: rows (kind, seq, t seconds, ok) of one kind are sorted, which spills, and streamed through
    one task; it holds one batch and the state (failures in a row, end of the opening).
    """
    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fails, until = None, 0, None
        for b in batches:
            out = []
            for kind, t, ok in zip(*(b.column(c).to_pylist() for c in ("kind", "t", "ok")), strict=True):
                if kind != last:
                    last, fails, until = kind, 0, None
                if until is not None and t < until:
                    out.append("rejected")
                    continue
                probe = until is not None
                out.append("probing" if probe else "admitted")
                fails = 0 if ok else fails + 1
                until = t + open_s if not ok and (probe or fails >= threshold) else None
                if until is not None:
                    fails = 0
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("seq"), pa.array(out, pa.string())], names=["kind", "seq", "decision"])

    rows = attempts.select("kind", "seq", "t", "ok").repartition(n, "kind").sortWithinPartitions("kind", "seq")
    return rows.mapInArrow(run, "kind string, seq long, decision string")
