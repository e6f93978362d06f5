"""Reading a log of versions: newest wins, then deletes and deadlines mask.

The order of the filters is the semantics: key range and sequence first, then
the newest version of each key, then tombstones and expiry. Any other order
brings masked versions back.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import is_expired, is_tombstone


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def _lit(key: bytes | str) -> Column:
    return F.lit(key if isinstance(key, str) else bytearray(key))


def in_range(lo: bytes | str | None = None, hi: bytes | str | None = None, key: str = "key") -> Column | None:
    """lo <= key < hi; a missing end is open, and an inverted range is empty."""
    out = None
    if lo is not None:
        out = F.col(key) >= _lit(lo)
    if hi is not None:
        upper = F.col(key) < _lit(hi)
        out = upper if out is None else out & upper
    return out


def visible(log: DataFrame, max_seq: int | None = None, lo: bytes | str | None = None, hi: bytes | str | None = None, key: str = "key") -> DataFrame:
    """The versions that a read may see, before any is chosen; both filters reach the scan."""
    if (r := in_range(lo, hi, key)) is not None:
        log = log.filter(r)
    return log if max_seq is None else log.filter(F.col("seq") <= F.lit(max_seq))


def latest_versions(log: DataFrame, key: str = "key") -> DataFrame:
    """The newest version of each key, tombstones and expired ones included.

    max(seq) by key is a hash aggregate with partial sums, and reads two columns;
    the rows themselves are then found by their unique seq, which can't be skewed
    however many versions one key has.
    """
    newest = log.groupBy(key).agg(F.max("seq").alias("seq")).select("seq")
    return log.join(newest, "seq", "left_semi").select(*log.columns)


def resolve(log: DataFrame, max_seq: int | None = None, as_of_ms: int | None = None, lo: bytes | str | None = None, hi: bytes | str | None = None, key: str = "key", unique: bool = False) -> DataFrame:
    """Live entries as of a sequence number and an instant. unique: each key is known to have one version, so none is chosen."""
    seen = visible(log, max_seq, lo, hi, key)
    newest = seen if unique else latest_versions(seen, key)
    return newest.filter(~is_tombstone()).filter(~is_expired(now_ms() if as_of_ms is None else as_of_ms))


def get(log: DataFrame, k: bytes | str, max_seq: int | None = None, as_of_ms: int | None = None, key: str = "key") -> DataFrame:
    """The live entry of one key: one row or none."""
    return resolve(log.filter(F.col(key) == _lit(k)), max_seq, as_of_ms, key=key)


def get_entry(log: DataFrame, k: bytes | str, max_seq: int | None = None, key: str = "key") -> DataFrame:
    """The newest version of one key as it is, tombstone or expired."""
    return latest_versions(visible(log.filter(F.col(key) == _lit(k)), max_seq, key=key), key)


def scan(log: DataFrame, lo: bytes | str | None = None, hi: bytes | str | None = None, max_seq: int | None = None, as_of_ms: int | None = None, limit: int | None = None, key: str = "key") -> DataFrame:
    """Live entries of [lo, hi) in key order. With a limit only so many are kept of each partition before they meet."""
    out = resolve(log, max_seq, as_of_ms, lo, hi, key).orderBy(key)
    return out if limit is None else out.limit(limit)


def scan_prefix(log: DataFrame, prefix: bytes | str, max_seq: int | None = None, as_of_ms: int | None = None) -> DataFrame:
    """Live entries whose key starts with a prefix, as a range that the scan can use. Keys are strings if the prefix is one."""
    if isinstance(prefix, str):  # the last code point that can be raised, past the surrogates
        head = prefix.rstrip("\U0010ffff")
        hi = head[:-1] + chr(0xE000 if ord(head[-1]) == 0xD7FF else ord(head[-1]) + 1) if head else None
    else:
        head = prefix.rstrip(b"\xff")
        hi = head[:-1] + bytes([head[-1] + 1]) if head else None
    return scan(log, prefix, hi, max_seq, as_of_ms)


def multi_get(log: DataFrame, request: DataFrame, max_seq: int | None = None, as_of_ms: int | None = None, key: str = "key") -> DataFrame:
    """request: (pos, key). Every request with its value, null if there is none; repeats stay.

    The log is first cut to the keys asked for; how (broadcast, bloom or
    shuffle) is left to the optimizer, since requests may be as many as keys.
    """
    asked = request.select(key).distinct()
    mine = resolve(visible(log, max_seq, key=key).join(asked, key, "left_semi"), None, as_of_ms, key=key)
    return request.join(mine.select(key, "value"), key, "left").select("pos", key, "value")


def history(log: DataFrame, key: str = "key") -> DataFrame:
    """All versions with the one each replaced and their number, newest first."""
    w = W.partitionBy(key).orderBy("seq")
    return log.withColumn("prev_seq", F.lag("seq").over(w)).withColumn("version", F.row_number().over(w))


def merge_runs(*runs: DataFrame, drop_tombstones: bool = True, as_of_ms: int | None = None, key: str = "key") -> DataFrame:
    """Newest version of each key over several runs, in any order of the runs."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    out = latest_versions(both, key).filter(~is_expired(now_ms() if as_of_ms is None else as_of_ms))
    return out.filter(~is_tombstone()) if drop_tombstones else out


def snapshot_diff(log: DataFrame, old_seq: int, new_seq: int, as_of_ms: int, key: str = "key") -> DataFrame:
    """Keys whose live value differs between two snapshots: added, removed or changed."""
    a = resolve(log, old_seq, as_of_ms, key=key).select(F.col(key), F.col("value").alias("old_value"), F.col("seq").alias("old_seq"))
    b = resolve(log, new_seq, as_of_ms, key=key).select(F.col(key).alias("k2"), F.col("value").alias("new_value"), F.col("seq").alias("new_seq"))
    j = a.join(b, F.col(key) == F.col("k2"), "full")
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").when(F.col("old_seq") != F.col("new_seq"), "changed")
    return j.withColumn("change", change).filter("change IS NOT NULL").select(F.coalesce(key, "k2").alias(key), "change", "old_value", "new_value")


def as_of(log: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """probes: (key, at_seq). The version of the key that each probe's snapshot sees, tombstones too (an as-of join).

    Versions and probes of a key are put in one order and the last version before each probe
    carried forward: one shuffle, no join, linear in the rows.
    """
    v = log.select(F.col(key), "seq", F.lit(None).cast("long").alias("at_seq"), F.struct("seq", "op", "value").alias("hit"))
    p = probes.select(F.col(key), F.col("at_seq").alias("seq"), "at_seq", F.lit(None).cast(v.schema["hit"].dataType).alias("hit"))
    w = W.partitionBy(key).orderBy("seq", F.col("at_seq").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = v.unionByName(p).withColumn("seen", F.last("hit", ignorenulls=True).over(w))
    return both.filter("at_seq IS NOT NULL").select(key, "at_seq", F.col("seen.seq").alias("seq"), F.col("seen.op").alias("op"), F.col("seen.value").alias("value"))


def validity(log: DataFrame, key: str = "key") -> DataFrame:
    """Each version with the interval of sequence numbers [seq, until) in which it is the newest; until is null for the last."""
    w = W.partitionBy(key).orderBy("seq")
    return log.withColumn("until", F.lead("seq").over(w))


def range_join(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """Points in half-open intervals [lo, hi) of whole numbers, of two frames without common columns.

    An interval goes to the buckets that it meets at the level whose width (a power of 8) is the first
    that isn't below its length, two at most; a point goes to its bucket of every level that any interval
    uses. So the join is by level and bucket, linear in both, however long intervals are.
    """
    size = F.col(hi) - F.col(lo)
    width = lambda level: F.expr(f"shiftleft(1L, CAST(3 * {level} AS INT))")
    level = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 3).cast("int")
    i = intervals.filter(size > 0).withColumn("_level", level)
    levels = [r[0] for r in i.select("_level").distinct().collect()]  # 22 at most, as a long has 64 bits
    first, last = F.floor(F.col(lo) / width("_level")), F.floor((F.col(hi) - 1) / width("_level"))
    spread = i.withColumn("_bucket", F.explode(F.sequence(first, last)))
    p = points.withColumn("_p_level", F.explode(F.array(*[F.lit(x).cast("int") for x in levels]) if levels else F.array().cast("array<int>")))
    p = p.withColumn("_p_bucket", F.floor(F.col(at) / width("_p_level")))
    j = p.join(spread, (F.col("_p_level") == F.col("_level")) & (F.col("_p_bucket") == F.col("_bucket")))
    return j.filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_level", "_bucket", "_p_level", "_p_bucket")
