"""Locks as relations: live foreign locks, lost locks, blocked commits, pattern matches, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An expiry of no or negative length means 14 days.
EXPIRY = 14 * 86400


def effective_expiry(seconds: int | None) -> int:
    return seconds if seconds and seconds > 0 else EXPIRY


def expired(since: Column, now: str, seconds: int | None = None) -> Column:
    """At the very end of the expiry a lock has expired."""
    at = F.lit(now).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", since.cast("timestamp_ntz"), at) >= effective_expiry(seconds) * 1_000_000


def foreign_live(locks: DataFrame, me: str | Column, now: str, seconds: int | None = None, enabled: bool = True) -> DataFrame:
    """Locks of others that haven't expired; none while locking is off."""
    if not enabled:
        return locks.limit(0)
    mine = F.lit(me) if isinstance(me, str) else me
    return locks.where((F.col("owner") != mine) & ~expired(F.col("since"), now, seconds))


def blocked(touched: DataFrame, foreign: DataFrame) -> DataFrame:
    """Touched paths that someone else has locked."""
    return touched.join(foreign.select("path", "owner"), "path")


def lost(held: DataFrame, locks: DataFrame, me: str) -> DataFrame:
    """C11: paths believed to be held whose lock is gone or someone else's, with who has it now."""
    met = held.select("path").join(locks.select("path", "owner"), "path", "left")
    return met.where(F.col("owner").isNull() | (F.col("owner") != me)).select("path", F.col("owner").alias("now_owner"))


def remember(held: DataFrame, got: DataFrame) -> DataFrame:
    return held.select("path").union(got.select("path")).distinct()


def forget(held: DataFrame, gone: DataFrame) -> DataFrame:
    return held.select("path").join(gone.select("path"), "path", "left_anti")


def read_only(scan: DataFrame, foreign: DataFrame) -> DataFrame:
    """Which files a foreign lock makes read-only."""
    flag = foreign.select("path").distinct().withColumn("_l", F.lit(True))
    return scan.join(flag, "path", "left").withColumn("read_only", F.coalesce("_l", F.lit(False))).drop("_l")
