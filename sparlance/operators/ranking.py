"""Exact ranks and running totals in groups of any size.

A window over a group that holds a third of all rows would run in one task. Here the
group is cut by the top bits of a hash into 256 ordered buckets; bucket totals give each
bucket its offset, and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(df: DataFrame, groups: list[str], bucket: str, amount: Column) -> DataFrame:
    sums = df.groupBy(*groups, bucket).agg(F.sum(amount).alias("_amount"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*groups, bucket, F.coalesce(F.sum("_amount").over(before), F.lit(0)).cast("long").alias("_offset"))


def hashed_running(df: DataFrame, groups: list[str], keys: list[str], *, amount: Column | None = None, seed: int = 0, out: str = "rank") -> DataFrame:
    """Add `out`: the sum of `amount` over the rows before this one in its group, in hash order.

    With amount None this is the rank from 0. The order is by xxhash64(seed, keys), then the
    keys themselves, so it is the same in every run. Nulls in `amount` count as 0; a null in a
    group column forms a group of its own; an empty df gives an empty df. `keys` must identify
    a row within its group, else equal rows share an arbitrary order among themselves.
    """
    value = F.lit(1) if amount is None else F.coalesce(amount, F.lit(0))
    work = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).withColumn("_amount_of", value.cast("long"))
    work = work.withColumn("_bucket", F.shiftright("_h", 56))
    safe = [f"_g{i}" for i in range(len(groups))]
    for s, g in zip(safe, groups):
        work = work.withColumn(s, F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")))
    offsets = _offsets(work, safe, "_bucket", F.col("_amount_of"))
    within = Window.partitionBy(*safe, "_bucket").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = work.join(offsets, [*safe, "_bucket"])
    ranked = joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum("_amount_of").over(within), F.lit(0)))
    return ranked.drop("_h", "_bucket", "_offset", "_amount_of", *safe)


def ordered_rank(df: DataFrame, group: str, position: str, *, span: int = 65_536, out: str = "rank") -> DataFrame:
    """Rank from 0 within `group` by a whole-number `position`, cut into spans of positions."""
    work = df.withColumn("_bucket", F.floor(F.col(position) / span))
    offsets = _offsets(work, [group], "_bucket", F.lit(1))
    within = Window.partitionBy(group, "_bucket").orderBy(position)
    ranked = work.join(offsets, [group, "_bucket"]).withColumn(out, F.col("_offset") + F.row_number().over(within) - 1)
    return ranked.drop("_bucket", "_offset")
