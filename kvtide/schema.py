"""The one row shape of the engine: a version of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operations. BATCH exists in log frames only.
PUT, DELETE, BATCH = 1, 2, 3
OP_NAMES = {PUT: "PUT", DELETE: "DELETE", BATCH: "BATCH"}
MAX_KEY_BYTES, MAX_VALUE_BYTES = 10 << 20, 100 << 20

KV_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("expires_at_ms", T.LongType(), False),
    ]
)
KV_COLUMNS = KV_SCHEMA.names


def is_tombstone(op: Column | str = "op") -> Column:
    return (F.col(op) if isinstance(op, str) else op) == F.lit(DELETE)


def is_expired(as_of_ms: int | Column, expires: Column | str = "expires_at_ms") -> Column:
    """Expired from the very millisecond of its deadline on; 0 never expires."""
    e = F.col(expires) if isinstance(expires, str) else expires
    return (e > 0) & (F.lit(as_of_ms) >= e)


def deadline(now_ms: int | Column, ttl_ms: Column) -> Column:
    """Absolute deadline of a time to live; null, zero and negative ones are permanent."""
    return F.when(ttl_ms > 0, F.lit(now_ms) + ttl_ms).otherwise(F.lit(0)).cast("long")


def op_name(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in OP_NAMES.items():
        out = F.when(op == code, F.lit(name)).otherwise(out)
    return out
