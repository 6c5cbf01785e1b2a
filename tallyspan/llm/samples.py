"""Bounded labelled samples for the fitted operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.llm.common import materialise, small


def fold(doc: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % of


def labelled(docs: DataFrame, labels: DataFrame, value: str, per_class: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of at most ``per_class`` labelled ids of each class: those with the smallest hash of the id.

    An id with several labels takes the smallest; null ids and labels are left out. The ids are
    ``per_class`` times the number of classes at most; they are broadcast if these are few.
    """
    ids = labels.select(F.col(doc).alias("id"), F.col(value).alias("label")).where("id is not null and label is not null")
    ids = ids.groupBy("id").agg(F.min("label").alias("label"))
    # A share of the ids by hash leaves about twice the number asked for of each class, whatever its size; these are ranked.
    share = ids.groupBy("label").agg((F.lit(2.0 * per_class) / F.count(F.lit(1))).alias("share"))
    share = materialise(share, "class-shares")
    ids = ids.withColumn("h", F.xxhash64("id")).join(small(share), "label").where(F.pmod("h", F.lit(1 << 31)) < F.col("share") * (1 << 31))
    order = Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 31)), "id")
    ids = ids.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_class)
    ids = materialise(ids.select("id", "label"), "sample")
    return docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(small(ids), "id").select("label", "text")
