"""Record schemas, codes and saturating arithmetic of the job tables. Every operator takes ``now`` explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version that stored tables must carry.
SCHEMA_VERSION = 1
I64_MAX = 9223372036854775807
#: Defaults and limits of the job model.
DEFAULT_LANE, DEFAULT_MAX_ATTEMPTS, MAX_LANE_BYTES = "default", 5, 256
MAX_ENVELOPE_BYTES, OFFLOAD_BYTES = 64 << 20, 64 << 10
MAX_SWEEP, LEASE_NS = 128, 30_000_000_000
MAX_TRACE_ENTRIES, MAX_TRACE_BYTES = 34, 8 << 10
STATES = {1: "live", 2: "dead_lettered", 0: "completed_or_unknown"}


def _struct(ddl: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "binary": T.BinaryType(), "map": T.MapType(T.StringType(), T.StringType()), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k.rstrip("?")], k.endswith("?")) for n, k in (x.split(":") for x in ddl.split())])


JOBS = _struct(
    "seq:long id:string receipt:string? lane:string priority:int available_at:long leased_until:long? deliveries:long"
    " kind:string payload:binary? attempts:long max_attempts:long unique_key:string? trace_context:map?"
)
DEAD = _struct(
    "seq:long id:string lane:string priority:int kind:string payload:binary? attempts:long max_attempts:long error:string unique_key:string? dead_at:long"
)
REQUESTS = _struct("ord:long op:string receipt:string? id:string? delay_ns:long? error:string?")
SCHEDULES = _struct("schedule_id:string occurrence:long")
RESULTS = _struct("job_id:string blob:binary? write_seq:long stored_at:long ttl_ns:long?")
ROUTES = _struct("topic:string lanes:strings")


def saturating_add(a: Column, b: Column) -> Column:
    """a + b as long, or the largest long where it would overflow."""
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.lit(I64_MAX))


def check_version(stamp: DataFrame, column: str = "version") -> None:
    """Raise unless the one-row stamp of a stored table holds SCHEMA_VERSION; nothing is migrated."""
    rows = stamp.select(column).limit(2).collect()
    if len(rows) != 1 or rows[0][0] != SCHEMA_VERSION:
        raise ValueError(f"schema version {[r[0] for r in rows]}, expected {SCHEMA_VERSION}")


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns and types of ``schema``; raises where one is missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
