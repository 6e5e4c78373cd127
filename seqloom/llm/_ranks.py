"""Row numbers over all rows of a table, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import small, table

_BITS = 33  # of monotonically_increasing_id: the place within a partition


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with `rank`, 1 for the first in `order`.

    Rows are dealt to ranges and sorted there; a range's number and the place in it are written with the
    rows, so a second read finds the same ones. Only a count per range reaches the driver. Rows that are
    equal in `order` lie in one range: make the order unique where many may be. No rows give none.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(F.shiftright("_at", _BITS).alias("_part")).count().collect()  # one row per range
    before, offsets = 0, []
    for part, n in sorted(counts):
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "_part long, _before long")
    joined = placed.withColumn("_part", F.shiftright("_at", _BITS)).join(small(starts, len(offsets)), "_part")
    return joined.withColumn("rank", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + F.col("_before") + 1).drop("_at", "_part", "_before")
