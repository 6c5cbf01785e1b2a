"""Schedules: high-water claims and cron occurrences."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from itertools import islice, product
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.operators.ordered import Ordered


def claims(attempts: DataFrame) -> DataFrame:
    """``attempts`` (ord, schedule_id, occurrence, optional reset) with whether each is claimed.

    Claimed if greater than all earlier occurrences of the schedule. A row with ``reset`` forgets the mark and
    claims nothing. The mark only rises, so it is the running maximum.
    """
    later = F.col("mark").isNull() | (F.col("occurrence") > F.col("mark"))
    if "reset" not in attempts.columns:
        a = Ordered(attempts, ["schedule_id"], ["ord"]).running("mark", "max", F.col("occurrence"), before=True).result
        return a.withColumn("claimed", later)
    a = Ordered(attempts.withColumn("__reset", F.coalesce(F.col("reset"), F.lit(False))), ["schedule_id"], ["ord"])
    a = a.running("__island", "sum", F.col("__reset").cast("long"))
    a = a.running("mark", "max", F.when(~F.col("__reset"), F.col("occurrence")), ["__island"], before=True).result
    return a.withColumn("claimed", ~F.col("__reset") & later).drop("__reset", "__island")


def non_decreasing(readings: DataFrame, clock: str = "now", order: str = "ord") -> DataFrame:
    """``readings`` of a clock in their order, each at least as late as all before it."""
    got = Ordered(readings, [], [order]).running("__now", "max", F.col(clock)).result
    return got.withColumn(clock, F.col("__now")).drop("__now")


def fixed_step(bounds: DataFrame, step_s: int) -> DataFrame:
    """(schedule_id, occurrence): each multiple of ``step_s`` seconds after ``after`` up to ``until``."""
    first = (F.floor(F.col("after") / step_s) + 1) * step_s
    return bounds.where(first <= F.col("until")).select("schedule_id", F.explode(F.sequence(first.cast("long"), F.col("until").cast("long"), F.lit(step_s).cast("long"))).alias("occurrence"))


_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7))
_NAMES = ({}, {}, {}, {}, {n: i for i, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}, {n: i for i, n in enumerate("SUN MON TUE WED THU FRI SAT".split(), 1)})


class Cron:
    """Six fields, seconds first: lists, ranges, steps, ``*`` and ``?``, names of months and days (1 is Sunday)."""

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) != 6:
            raise ValueError(f"six fields expected: {text!r}")
        self.sets = [self._field(f, *r, n) for f, r, n in zip(fields, _RANGES, _NAMES, strict=True)]

    @staticmethod
    def _field(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
        out: set[int] = set()
        number = lambda x: names.get(x.upper()[:3]) or int(x)
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span in "*?":
                a, b = low, high
            elif "-" in span:
                a, b = map(number, span.split("-"))
            else:
                a = number(span)
                b = high if step else a
            if not (low <= a <= b <= high) or step == "0":
                raise ValueError(f"bad field {text!r}")
            out.update(range(a, b + 1, int(step or 1)))
        return out

    @lru_cache(maxsize=64)  # noqa: B019
    def on(self, day: date, zone: str) -> tuple[int, ...]:
        """Unix seconds of a day's occurrences. Of a wall time that a zone has twice the first counts; one that it skips doesn't occur."""
        seconds, minutes, hours, days, months, weekdays = self.sets
        if day.month not in months or day.day not in days or day.isoweekday() % 7 + 1 not in weekdays:
            return ()
        tz, found = ZoneInfo(zone), []
        for h, m, s in product(sorted(hours), sorted(minutes), sorted(seconds)):
            t = datetime(day.year, day.month, day.day, h, m, s, tzinfo=tz)
            back = t.astimezone(UTC).astimezone(tz)
            if (back.hour, back.minute, back.second, back.date()) == (h, m, s, day):
                found.append(int(t.timestamp()))
        return tuple(sorted(found))

    def after(self, moment: int, zone: str = "UTC", until: int | None = None) -> Iterator[int]:
        """Unix seconds of the occurrences strictly after ``moment``, up to ``until``, or for 101 years if it is None."""
        tz = ZoneInfo(zone)
        day = datetime.fromtimestamp(moment, tz).date()
        days_on = 366 * 101 if until is None else (datetime.fromtimestamp(until, tz).date() - day).days + 1
        for _ in range(days_on):
            yield from (x for x in self.on(day, zone) if x > moment and (until is None or x <= until))
            day += timedelta(days=1)


def check_definitions(defs: DataFrame) -> DataFrame:
    """``defs`` (schedule_id, cron, tz) with an outcome: ok, duplicate_id or invalid_cron."""
    repeated = defs.groupBy("schedule_id").agg((F.count(F.lit(1)) > 1).alias("__twice"))

    @F.pandas_udf("boolean")
    def readable(crons: pd.Series) -> pd.Series:
        def one(text):
            try:
                Cron(text)
            except (ValueError, AttributeError):
                return False
            return True

        return crons.map(one).astype(bool)

    j = defs.join(repeated, "schedule_id")
    return j.withColumn("outcome", F.when(F.col("__twice"), "duplicate_id").when(~readable("cron"), "invalid_cron").otherwise("ok")).drop("__twice")


def next_due(defs: DataFrame, after: str = "after", until: str | None = None) -> DataFrame:
    """``defs`` with ``due``: the first occurrence strictly after the moment in column ``after``.

    Null where there is none, or none up to the moment in column ``until``.
    """
    schema = T.StructType([*defs.schema.fields, T.StructField("due", T.LongType())])

    def run(frames):
        made: dict[str, Cron] = {}
        for pdf in frames:
            stops = pdf[until] if until else [None] * len(pdf)
            due = []
            for text, tz, a, z in zip(pdf["cron"], pdf["tz"], pdf[after], stops, strict=True):
                cron = made.setdefault(text, Cron(text)) if text not in made else made[text]
                due.append(next(cron.after(int(a), tz or "UTC", None if z is None else int(z)), None))
            yield pdf.assign(due=pd.array(due, "Int64"))

    return defs.mapInPandas(run, schema)


def wake_up(cursors: DataFrame) -> DataFrame:
    """One row: the earliest ``due`` of all schedules, null if there is none."""
    return cursors.agg(F.min("due").alias("due"))


def fire_due(cursors: DataFrame, marks: DataFrame, now: int, after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round of the scheduler over (schedule_id, cron, tz, due): (fired, cursors after it).

    Each schedule that is due fires its ``due`` alone; what else it missed is skipped, as its cursor goes past the time
    ``after`` the round. A fire is claimed if it is later than the schedule's ``mark``. Its unique key is ``id:occurrence``.
    """
    due = cursors.where(F.col("due") <= now)
    fired = due.join(marks.select("schedule_id", "mark"), "schedule_id", "left").select(
        "schedule_id", F.col("due").alias("occurrence"), (F.col("mark").isNull() | (F.col("due") > F.col("mark"))).alias("claimed"),
        F.concat_ws(":", "schedule_id", F.col("due").cast("string")).alias("unique_key"),
    )
    moved = next_due(due.drop("due").withColumn("__after", F.lit(now if after is None else after).cast("long")), "__after").drop("__after")
    return fired, cursors.where(F.col("due").isNull() | (F.col("due") > now)).unionByName(moved)


def fired_at(ticks: DataFrame) -> DataFrame:
    """``ticks`` (schedule_id, cron, tz, t) of a running scheduler with the occurrence that each one fires, or null.

    A tick fires the first occurrence after the one before it if that is due; the first tick only sets the cursor.
    """
    pairs = Ordered(ticks, ["schedule_id"], ["t"]).running("__before", "max", F.col("t"), before=True).result
    known = next_due(pairs.where("__before is not null"), "__before", "t").withColumnRenamed("due", "occurrence")
    first = pairs.where("__before is null").withColumn("occurrence", F.lit(None).cast("long"))
    return known.unionByName(first).drop("__before")


def occurrences(defs: DataFrame, until: int, limit: int | None = None, chunk: int = 10_000) -> DataFrame:
    """(schedule_id, occurrence) for rows (schedule_id, cron, tz, after): all up to ``until``, or the first ``limit`` of them."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                found = islice(Cron(r.cron).after(int(r.after), r.tz or "UTC", until), limit)
                while rows := list(islice(found, chunk)):
                    yield pd.DataFrame({"schedule_id": r.schedule_id, "occurrence": rows})

    return defs.select("schedule_id", "cron", "tz", "after").mapInPandas(run, "schedule_id string, occurrence long")
