"""Scalar functions as columns; pandas only where bytes or wrapping arithmetic leave no other way."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspan.schema import I64_MAX, MAX_LANE_BYTES, MAX_TRACE_BYTES, MAX_TRACE_ENTRIES

SAFE_IDENT = r"^[A-Za-z_][A-Za-z0-9_]{0,62}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Query parameters whose values are hidden, trace headers that are passed on, first bytes of a stored reference.
SECRETS = ("password", "sslpassword", "passwd", "signature", "x-amz-credential", "x-amz-security-token", "awsaccesskeyid", "sig")
PROPAGATED = ("traceparent", "tracestate", "baggage")
CLAIM_PREFIX = b"\x00WLCC\x01"


def lane_valid(lane: Column) -> Column:
    """Not empty, at most 256 bytes, no control characters, no white space at the ends; null is not valid."""
    ok = (F.length(lane) > 0) & (F.octet_length(lane) <= MAX_LANE_BYTES) & ~lane.rlike(r"\p{Cc}") & ~lane.rlike(r"^\p{Z}|\p{Z}$")
    return F.coalesce(ok, F.lit(False))


def safe_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(SAFE_IDENT), F.lit(False))


def bad_key_character(segment: Column) -> Column:
    """The first of the characters ``: * ? [ ]``, or the empty string."""
    return F.regexp_extract(segment, r"[:*?\[\]]", 0)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def redact_userinfo(text: Column) -> Column:
    """Hide what stands before the last ``@`` of a URL, if it has a colon or no path, query or fragment sign."""
    return F.regexp_replace(text, r"""(://)(?:[^ \t\n"':]*:[^ \t\n"']*|[^ \t\n"'/?#]*)@(?![^ \t\n"']*@)""", "$1***@")


def redact_secrets(text: Column) -> Column:
    names = "|".join(SECRETS)
    return F.regexp_replace(text, rf"""(?i)(^|[^a-z0-9_])((?:{names})=)[^& \t\n"']*""", "$1$2***")


def redact(text: Column) -> Column:
    return redact_secrets(redact_userinfo(text))


def truncate_chars(text: Column, n: int = 60) -> Column:
    """Texts over ``n`` characters end after these with an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def truncate_bytes(text: Column, n: int = 512) -> Column:
    """Texts over ``n`` UTF-8 bytes end before the character that crosses them, with three dots."""
    data = F.encode(text, "UTF-8")
    # A character has four bytes at most, so one of these cuts falls between two.
    starts = [F.substring(data, 1, k) for k in range(n, max(n - 4, -1), -1)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), F.decode(x, "UTF-8")) for x in starts])
    return F.when(F.octet_length(text) > n, F.concat(whole, F.lit("..."))).otherwise(text)


def backoff_ns(attempts: Column, base_ns: int, factor: int, cap_ns: int) -> Column:
    """min(base * factor^attempts, cap), exact: the exponent stops where the cap is reached."""
    values = [min(base_ns, cap_ns)]
    while 0 < values[-1] < cap_ns and factor != 1:
        values.append(min(values[-1] * factor, cap_ns))
    table = F.array(*[F.lit(v).cast("long") for v in values])
    return F.element_at(table, F.least(attempts.cast("long"), F.lit(len(values) - 1)).cast("int") + 1)


def idle_wait_ns(empties: Column, poll_ns: int, cap_ns: int) -> Column:
    """min(poll * 2^empties, max(cap, poll))."""
    return backoff_ns(empties, poll_ns, 2, max(cap_ns, poll_ns))


def jittered_ns(delay_ns: Column, attempts: Column, seed: Column, jitter: float, cap_ns: int) -> Column:
    """delay * (1 - jitter * u) with u in [0, 1) mixed from (seed, attempts); no jitter unless finite and positive.

    Null where an argument is null.
    """
    if not (np.isfinite(jitter) and jitter > 0):
        return F.when(attempts.isNotNull() & seed.isNotNull(), delay_ns.cast("long"))

    @F.pandas_udf("long")
    def mix(d: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
        # The SplitMix64 constants.
        z = s.to_numpy(np.int64).view(np.uint64) ^ (a.to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
        return pd.Series(np.minimum((d.to_numpy(float) * (1.0 - min(jitter, 1.0) * u)).astype(np.int64), cap_ns))

    known = delay_ns.isNotNull() & attempts.isNotNull() & seed.isNotNull()
    zero = [F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in (delay_ns, attempts, seed)]
    return F.when(known, mix(*zero))


def heartbeat_ns(lease_ns: Column) -> Column:
    """A third of the lease, rounded down, and 50 ms at least; null for null.

    Exact for leases beyond a long too, as decimals; the largest long where a third is beyond it.
    """
    bounded = F.greatest(F.least(F.floor(lease_ns), F.lit(Decimal(3 * I64_MAX))), F.lit(150_000_000))
    return F.when(lease_ns.isNotNull(), F.call_function("div", bounded, F.lit(3)))


def claim_key(payload: Column) -> Column:
    """Key of an offloaded payload, or null if it is none or not valid UTF-8."""
    body = F.substring(payload, 7, 1 << 30).cast("string")
    return F.when((F.substring(payload, 1, 6) == F.lit(CLAIM_PREFIX)) & F.is_valid_utf8(body), body)


def claim_reference(key: Column) -> Column:
    """The payload that stands for the blob ``key``."""
    return F.concat(F.lit(CLAIM_PREFIX), F.encode(key, "UTF-8"))


def inject(context: Column, current: Column) -> Column:
    """A trace context with the entries of ``current``, which replace its own; unchanged where these are null or empty."""
    own = F.coalesce(context, F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(current, k)), current)
    return F.when(F.coalesce(F.cardinality(current), F.lit(0)) > 0, merged).otherwise(context)


def propagated(context: Column) -> Column:
    return F.map_filter(context, lambda k, _: k.isin(*PROPAGATED))


def trace_valid(context: Column) -> Column:
    """At most 34 entries and 8 KiB of keys and values; null is valid."""
    size = F.aggregate(F.map_entries(context), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return context.isNull() | ((F.cardinality(context) <= MAX_TRACE_ENTRIES) & (size <= MAX_TRACE_BYTES))


def outcome(error_class: Column, attempts: Column, max_attempts: Column) -> Column:
    """Outcome of an attempt: done, failed for good at once, retried while attempts are left, else failed."""
    return (
        F.when(error_class.isNull(), "succeeded")
        .when(error_class.isin("unknown_kind", "decode"), "failed")
        .when(error_class == "stale", "stale")
        .when(attempts + 1 < max_attempts, "retried")
        .otherwise("failed")
    )


def bytes_from_ints(items: Column) -> Column:
    """Binary from an array of byte values, the JSON form of payloads."""
    return F.unhex(F.array_join(F.transform(items, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
