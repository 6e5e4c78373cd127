"""GC content: equal-count bins, their profiles and tolerances."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import gc_content, gc_count, letter_count
from seqloom.operators.cut import written
from seqloom.operators.select import nth_smallest


def with_gc(seqs: DataFrame, decimals: int = 6) -> DataFrame:
    """Adds `gc`, the share of G and C, rounded so that ties are ties on any engine."""
    return seqs.withColumn("gc", F.round(gc_content(F.col("seq")), decimals))


def gc_bins(seqs: DataFrame, bins: int = 10, order: str = "interval_id") -> DataFrame:
    """Adds `bin` (1 to `bins`): equal counts after a stable sort by gc and `order`, a whole number; the first bins get the odd rows.

    Nothing is sorted: counts per gc, of which six decimals allow a million at most, show the gc at which
    each bin ends. Only where rows of that gc fall to both sides, the last `order` of the earlier bin is
    selected, again by counts.
    """
    rows = with_gc(seqs)
    narrow = rows.select("gc", order).persist()
    counts = narrow.groupBy("gc").count()
    upto = Window.orderBy("gc").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select("gc", "count", F.sum("count").over(upto).alias("upto")).withColumn("before", F.col("upto") - F.col("count"))
    n = narrow.count()
    small, extra = divmod(n, bins)
    ends = [i * (small + 1) if i <= extra else extra * (small + 1) + (i - extra) * small for i in range(1, min(bins, n))]
    at_edge = F.exists(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: (F.col("before") < e) & (e <= F.col("upto")))
    edges = steps.where(at_edge).collect() if ends else []  # a row per bin at most
    # gc at the edge, how many rows of that gc belong to the earlier bins, and whether others don't
    cuts = sorted((e, r["gc"], e - r["before"], r["upto"] > e) for r in edges for e in ends if r["before"] < e <= r["upto"])
    last = {}
    split = [c for c in cuts if c[3]]
    while split:  # one edge of a gc at a time; several bins may end within one
        now = {gc: n for _, gc, n, _ in reversed(split)}
        last |= {(gc, now[gc]): v for gc, v in nth_smallest(narrow, "gc", order, now).items()}
        split = [c for c in split if (c[1], c[2]) not in last]
    narrow.unpersist()
    bin_no = F.lit(1)
    for _, gc, place, tied in cuts:
        beyond = F.col("gc") > gc
        bin_no += F.when(beyond | (F.col("gc") == gc) & (F.col(order) > last[gc, place]) if tied else beyond, 1).otherwise(0)
    return rows.withColumn("bin", bin_no.cast("int"))


def global_rank(rows: DataFrame, order: list[str], name: str = "_rank") -> DataFrame:
    """Adds a dense 1-based row number over all rows in the given order, sorted range by range.

    The sorted ranges are written, as their bounds come from a sample that a second run might draw anew.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the id holds the range's number and the place in it
    ranged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")
    counts = sorted(tuple(r) for r in ranged.groupBy("_part").count().collect())  # one row per range
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    offsets = F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)))
    return ranged.withColumn(name, F.col("_in") + F.get(offsets, F.col("_part").cast("int"))).drop("_part", "_in")


def bin_profile(binned: DataFrame) -> DataFrame:
    """Per bin: rows, and the smoothed GC (sum + 0.1) / (length + 0.1)."""
    return binned.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.round((F.sum(gc_count(F.col("seq"))) + 0.1) / (F.sum(F.length("seq")) + 0.1), 6).alias("bin_gc"),
    )


def gc_tolerance(seqs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: least and largest gc, and half a bin's width."""
    gc = with_gc(seqs).agg(F.min("gc").alias("min_gc"), F.max("gc").alias("max_gc"))
    return gc.withColumn("tolerance", F.round((F.col("max_gc") - F.col("min_gc")) / (2 * bins), 6))


def mean_length(seqs: DataFrame) -> DataFrame:
    """One row: the mean length, cut to a whole number."""
    return seqs.agg(F.floor(F.sum(F.length("seq")) / F.count("*")).alias("mean_len"))


def few_ns(seqs: DataFrame, share: float, mean_len: int) -> DataFrame:
    """Rows with no more N than that share of the mean length."""
    return seqs.where(letter_count(F.col("seq"), "N") <= int(share * mean_len))


def background_report(binned: DataFrame) -> DataFrame:
    """Per bin: GC of the sampled background."""
    return binned.groupBy("bin").agg(F.round(F.sum(gc_count(F.col("seq"))) / (F.sum(F.length("seq")) + 1e-7), 6).alias("background_gc"), F.count("*").alias("n"))
