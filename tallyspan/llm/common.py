"""Shared helpers: Arrow row mapping, size-checked broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyspan.scratch import discard, materialise

__all__ = ["discard", "materialise"]  # used from here by the operators
#: Rows, and bytes of their files, up to which a written table may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def small(df: DataFrame) -> DataFrame:
    """The written table ``df`` marked for broadcast if it is small in rows and bytes; else as it is, for Spark to plan."""
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    few = size <= BROADCAST_BYTES and df.limit(max(0, BROADCAST_ROWS) + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    out: T.StructType,
    make: Callable[[], Callable[..., Sequence[list]]],
) -> DataFrame:
    """Columns ``keep`` unchanged plus ``out``, computed by Arrow batch.

    ``make()`` runs once a task and gives a function from the input columns, as lists, to the output
    columns, as lists of the same length. Other columns of ``df``, whatever their names, are not read.
    """
    src = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(c, src.schema[c].dataType, True) for c in keep] + list(out.fields))
    types = [to_arrow_type(f.dataType) for f in out.fields]
    n = len(keep)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for s in slices(b, n):
                cols = f(*(s.column(n + i).to_pylist() for i in range(len(inputs))))
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(s.column(i) for i in range(n)), *made], names=names)

    return src.mapInArrow(run, schema)


def flat_map(df: DataFrame, cols: Sequence[str], out: T.StructType, make: Callable[[], Callable[..., Sequence[list]]]) -> DataFrame:
    """Like ``map_rows``, but the function may return any number of rows for a batch."""
    src = df.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(cols)])
    types, names = [to_arrow_type(f.dataType) for f in out.fields], out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for s in slices(b, 0):
                made = [pa.array(c, t) for c, t in zip(f(*(c.to_pylist() for c in s.columns)), types, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return src.mapInArrow(run, out)


#: Bytes of Arrow data that one call of a mapped function gets, unless a single row is larger.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES each, so that many long texts never meet in memory."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, rows * SLICE_BYTES // max(1, batch.nbytes))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


_KINDS = {"int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType}


def fields(**kinds: str | T.DataType) -> T.StructType:
    """A schema of nullable fields from names of plain types, or types; ``[long]`` is an array of long."""
    made = {k: v if isinstance(v, T.DataType) else T.ArrayType(_KINDS[v[1:-1]]()) if v[0] == "[" else _KINDS[v]() for k, v in kinds.items()}
    return T.StructType([T.StructField(k, v, True) for k, v in made.items()])


def id_type(df: DataFrame, doc: str) -> T.DataType:
    """The type in which ids are kept and compared: long for whole numbers, else text."""
    return T.LongType() if isinstance(df.schema[doc].dataType, T.IntegralType) else T.StringType()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root), written, for every node of ``edges`` (a long, b long): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each is an aggregate and a join, written to the shared
    folder. The edge set at most doubles, and no group is collected anywhere: a hub of any degree is
    reduced by a partial min and its edges are dealt by the join, whose skewed partitions AQE splits.
    """
    spark = edges.sparkSession
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    last = mark(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large)
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    out = materialise(roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    discard(e)
    return out
