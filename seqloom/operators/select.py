"""Exact order statistics by counting, without a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts per group and pass that reach the driver.
BUCKETS = 1024


def nth_smallest(rows: DataFrame, group: str, value: str, wanted: dict[object, int]) -> dict[object, int]:
    """Per group the n-th smallest whole number in `value`, n counted from 1 and given by `wanted`.

    Each pass counts the rows of some `BUCKETS` equal ranges between a group's bounds and goes on within the one
    that holds the n-th, so a 64-bit column takes seven passes at most, and what reaches the driver are counts.
    Groups with fewer rows than that are left out; nulls aren't counted.
    """
    spark = rows.sparkSession
    wanted = {g: n for g, n in wanted.items() if n > 0}
    if not wanted:
        return {}
    kind = rows.schema[group].dataType.simpleString()
    ends = rows.where(F.col(group).isin(*wanted)).groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).collect()
    bounds = {r[group]: (r["lo"], r["hi"], wanted[r[group]]) for r in ends if r["n"] >= wanted[r[group]]}
    found = {}
    while bounds:
        # the least shift that leaves few enough numbers; a shift, unlike a difference, can't overflow
        shift = {g: next(s for s in range(64) if (hi >> s) - (lo >> s) < BUCKETS) for g, (lo, hi, _) in bounds.items()}
        row = lambda g, lo, hi: F.struct(F.lit(g).cast(kind).alias(group), F.lit(lo).cast("long").alias("_lo"), F.lit(hi).cast("long").alias("_hi"), F.lit(shift[g]).alias("_shift"))
        table = spark.range(1).select(F.inline(F.array(*(row(g, lo, hi) for g, (lo, hi, _) in bounds.items()))))
        here = rows.join(F.broadcast(table), group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))  # one row per wanted group
        counts = here.groupBy(group, F.expr(f"shiftright({value}, _shift)").alias("_bucket")).count().collect()
        for g, (lo, hi, n) in list(bounds.items()):
            for bucket, count in sorted((r["_bucket"], r["count"]) for r in counts if r[group] == g):
                if n <= count:
                    break
                n -= count
            lo, hi = max(lo, bucket << shift[g]), min(hi, ((bucket + 1) << shift[g]) - 1)
            bounds[g] = (lo, hi, n)
            if lo == hi:
                found[g] = lo
                del bounds[g]
    return found
