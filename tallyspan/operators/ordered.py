"""Running values over keys of any size.

A window by key puts all rows of a hot key into one task. Here rows are dealt by ranges of (key, order) and
written with the number of their range, so that everything below sees one deal. Within a range a window gives the local value.
Only a range's first key can have begun earlier, so one row a range is enough to carry what earlier ranges hold of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.scratch import materialise

PART = "__part"
_HOW = {"sum": F.sum, "max": F.max, "count": F.count}


class Ordered:
    """Rows dealt by ``keys`` and then ``order``, which together should order the rows of a key fully."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]):
        self.keys, self.order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *[F.col(k) for k in self.keys], *self.order)
        self.rows, self.written = materialise(dealt.withColumn(PART, F.spark_partition_id()), "ordered"), True

    def running(self, name: str, how: str, value: Column, more_keys: Sequence[str] = (), before: bool = False) -> Ordered:
        """The rows with column ``name``: sum, max or count of ``value`` up to each row, or up to the one ``before``.

        ``more_keys`` cut a key finer; they must never fall along the order. Sums and counts of nothing are 0, maxima null.
        """
        if not self.written:  # they are read three times below
            self.rows, self.written = materialise(self.rows, "running"), True
        keys = [*self.keys, *more_keys]
        key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__0"))
        f, base = _HOW[how], F.lit(None if how == "max" else 0)
        combine = F.greatest if how == "max" else lambda a, b: a + b
        frame = Window.partitionBy(PART, *keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        rows = self.rows.withColumn("__key", key).withColumn("__value", value)
        ends = rows.groupBy(PART).agg(F.min("__key").alias("lo"), F.max("__key").alias("hi"))
        # A row for each range from here on.
        last = rows.join(F.broadcast(ends), PART).where(F.col("__key").eqNullSafe(F.col("hi"))).groupBy(PART, "lo", "hi").agg(f("__value").alias("total"))
        asked = last.select(F.col("lo").alias("k"), PART, F.lit(0).alias("kind"), F.lit(None).cast(last.schema["total"].dataType).alias("total"))
        given = last.select(F.col("hi").alias("k"), PART, F.lit(1).alias("kind"), "total")
        so_far = (F.max if how == "max" else F.sum)("total").over(Window.partitionBy("k").orderBy(PART, "kind").rowsBetween(Window.unboundedPreceding, 0))
        carry = asked.unionByName(given).withColumn("carry", so_far).where("kind = 0").select(F.col(PART).alias("__at"), F.col("k").alias("__lo"), "carry")
        local = rows.withColumn("__local", f("__value").over(frame))
        out = local.join(F.broadcast(carry), (F.col(PART) == F.col("__at")) & F.col("__key").eqNullSafe(F.col("__lo")), "left")
        made = combine(F.coalesce("__local", base), F.coalesce("carry", base))
        other = Ordered.__new__(Ordered)
        other.keys, other.order = self.keys, self.order
        other.rows, other.written = out.select(*[F.col(c) for c in self.rows.columns], made.alias(name)), False
        return other

    @property
    def result(self) -> DataFrame:
        return self.rows.drop(PART)
