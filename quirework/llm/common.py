"""Shared expressions of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of ASCII letters, digits and underscores, or one other character that is not ASCII white space.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^ \t\n\r\f\x0B]"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")


def squeeze(text: Column) -> Column:
    """Without white space around it, in lower case."""
    return F.lower(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""))


def clean_hash(text: Column) -> Column:
    """Hex digits of a hash; null for missing, malformed and empty-picture hashes (all digits equal)."""
    h = F.regexp_replace(squeeze(text), "^0x", "")
    return F.when(h.rlike("^[0-9a-f]+$") & ~h.rlike(r"^(.)\1*$"), h)


def spread_prefix_sum(df: DataFrame, group: str, order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Exclusive running sum of ``value`` per group without gathering a group in one task.

    Rows are ordered by (bucket of a hash of ``order``, then ``order``). Sums per (group, bucket) are small, their
    prefix is joined back, and the window runs within (group, bucket) only, so that a group that holds a third of
    all rows is spread over ``buckets`` windows. ``order`` must identify a row.
    """
    from pyspark.sql import Window

    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = b.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return b.join(sums, [group, "_b"]).withColumn(out, F.col("_base") + F.col("_own")).drop("_b", "_base", "_own")
