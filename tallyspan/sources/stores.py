"""Reading and writing of job tables: Parquet snapshots, JDBC, JSON envelopes and command-line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.functions.scalars import bytes_from_ints, trace_valid, truncate_chars
from tallyspan.schema import MAX_ENVELOPE_BYTES, MAX_TRACE_ENTRIES, SCHEMA_VERSION, check_version, require


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_snapshot(df: DataFrame, path: str, schema: T.StructType) -> None:
    """A checked snapshot by lane, with its version beside it."""
    out = require(df, schema)
    (out.write.partitionBy("lane") if "lane" in schema.names else out.write).mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.range(1).select(F.lit(SCHEMA_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/version")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    check_version(spark.read.parquet(f"{path}/version"))
    return require(spark.read.schema(schema).parquet(f"{path}/rows"), schema)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType, **options: str) -> DataFrame:
    """A table of SQLite or PostgreSQL; their drivers must be on the class path."""
    return require(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), schema)


ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("lane", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("payload", T.ArrayType(T.IntegerType())), T.StructField("attempts", T.LongType()), T.StructField("max_attempts", T.LongType()),
    T.StructField("priority", T.IntegerType()), T.StructField("trace_context", T.MapType(T.StringType(), T.StringType())),
])


def decode_envelopes(raw: DataFrame, column: str = "envelope") -> DataFrame:
    """Envelope columns from JSON, priority 0 where absent, payload from its list of byte values; too large or broken: null id."""
    e = F.when(F.octet_length(column) <= MAX_ENVELOPE_BYTES, F.from_json(column, ENVELOPE))
    x = raw.withColumn("__e", e)
    return x.select(*raw.columns, "__e.id", "__e.lane", "__e.kind", bytes_from_ints(F.col("__e.payload")).alias("payload"), "__e.attempts", "__e.max_attempts", F.coalesce("__e.priority", F.lit(0)).alias("priority"), "__e.trace_context")


def encode_envelopes(jobs: DataFrame, most_bytes: int = MAX_ENVELOPE_BYTES) -> DataFrame:
    """``jobs`` with the JSON envelope and an outcome: ok, trace_entries, trace_bytes or envelope_bytes for what is over a limit.

    A null trace context is left out; where the outcome is not ok the envelope is null.
    """
    ints = F.transform(F.sequence(F.lit(1), F.length("payload")), lambda i: F.conv(F.hex(F.substring(F.col("payload"), i, F.lit(1))), 16, 10).cast("int"))
    payload = F.when(F.length("payload") > 0, ints).otherwise(F.array().cast("array<int>"))
    text = F.to_json(F.struct("id", "lane", "kind", payload.alias("payload"), "attempts", "max_attempts", "priority", "trace_context"))
    many = F.coalesce(F.cardinality("trace_context"), F.lit(0)) > MAX_TRACE_ENTRIES
    bad = F.when(many, "trace_entries").when(~trace_valid(F.col("trace_context")), "trace_bytes").when(F.octet_length(text) > most_bytes, "envelope_bytes")
    return jobs.withColumn("outcome", F.coalesce(bad, F.lit("ok"))).withColumn("envelope", F.when(bad.isNull(), text))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def table_lines(df: DataFrame, error: str = "error") -> DataFrame:
    """Lines of a listing: a row's columns between tabs, a long error cut."""
    cols = [truncate_chars(F.col(c)) if c == error else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws("\t", *cols).alias("line"))


def upsert_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """One row a job: its last write. Numbers of ``new`` come after those of ``results``."""
    from tallyspan.operators.inspect import latest

    return latest(results.unionByName(new))
