"""Dated URL lists, joined as of the time of each capture.

Each dated entry of a pattern holds until the pattern's next one, so entries become validity
intervals. A pattern is a host, one of its parent domains, or a host and leading path segments. A
capture is joined by every pattern that its URL matches with the interval that holds at its fetch
time; the most specific pattern decides. Intervals are cut at periods of `PERIOD` time units, so a
capture meets only the entries of its own period, however long a pattern's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import let, small, table

PERIOD = 30 * 86400


def url_patterns(url: Column) -> Column:
    """array<struct<pattern, rank>>: parent domains and the host, then ever longer paths; rank grows with specificity."""
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/:?#]*)", 1))
    path = F.filter(F.split(F.regexp_extract(url, r"^\w+://[^/?#]*(/[^?#]*)", 1), "/"), lambda x: x != "")

    def keys(labels: Column, segments: Column) -> Column:
        n = F.size(labels)
        domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(labels, n - i + 1, i), ".").alias("pattern"), i.alias("rank")))
        full = F.array_join(labels, ".")
        paths = F.transform(
            F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.concat(full, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("pattern"), (n + i).alias("rank")),
        )
        return F.when(full != "", F.concat(domains, paths)).otherwise(F.array().cast("array<struct<pattern:string,rank:int>>"))

    return let(F.split(host, r"\."), lambda labels: let(path, lambda segments: keys(labels, segments)))


def validity_intervals(entries: DataFrame, *, pattern_col: str = "pattern", action_col: str = "action", since_col: str = "since") -> DataFrame:
    """`(pattern, action, valid_from, valid_to)`; valid_to is exclusive, null while no later entry follows.

    Of entries of one pattern and time the action that sorts last holds. Entries with a null pattern
    or time are void; a null action is `remove`, which ends the pattern. Times are longs.
    """
    from pyspark.sql import Window

    plain = entries.select(
        F.col(pattern_col).cast("string").alias("pattern"), F.col(since_col).cast("long").alias("valid_from"), F.coalesce(F.col(action_col).cast("string"), F.lit("remove")).alias("action")
    ).where("pattern IS NOT NULL AND valid_from IS NOT NULL")
    one = plain.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(order)).where("action <> 'remove'").select("pattern", "action", "valid_from", "valid_to")


def evaluate_captures(
    captures: DataFrame,
    entries: DataFrame,
    *,
    url_col: str = "url",
    time_col: str = "fetched_at",
    pattern_col: str = "pattern",
    action_col: str = "action",
    since_col: str = "since",
    period: int = PERIOD,
) -> DataFrame:
    """`captures` with `matched_pattern`, `matched_since` and `action` of the entry that decides, null where none holds.

    time_col and since_col are longs of one unit. A capture with a null URL or time, or a URL without
    a host, matches nothing. Repeated captures each get the verdict; columns of `captures` with one
    of the added names are replaced.
    """
    added = ("matched_pattern", "matched_since", "action")
    captures = captures.drop(*added)
    fetched = captures.select(F.col(url_col).cast("string").alias("_url"), F.col(time_col).cast("long").alias("_time")).where("_url IS NOT NULL AND _time IS NOT NULL").distinct()
    keys = (
        fetched.select("_url", "_time", F.explode(url_patterns(F.col("_url"))).alias("key"))
        .select("_url", "_time", "key.pattern", "key.rank", F.floor(F.col("_time") / period).alias("period"))
    )
    span = fetched.agg(F.min("_time"), F.max("_time")).first()
    first, last = ((span[0] or 0) // period, (span[1] or 0) // period)
    start = F.greatest(F.floor(F.col("valid_from") / period), F.lit(first))
    end = F.least(F.coalesce(F.floor((F.col("valid_to") - 1) / period), F.lit(last)), F.lit(last))
    intervals = validity_intervals(entries, pattern_col=pattern_col, action_col=action_col, since_col=since_col)
    intervals = table(intervals.where(start <= end).withColumn("period", F.explode(F.sequence(start, end))), "intervals")
    held = F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to"))
    verdicts = (
        keys.join(small(intervals, intervals.count()), ["pattern", "period"])
        .where((F.col("valid_from") <= F.col("_time")) & held)
        .groupBy("_url", "_time")
        .agg(F.max(F.struct("rank", "pattern", "valid_from", "action")).alias("best"))
        .select("_url", "_time", F.col("best.pattern").alias("matched_pattern"), F.col("best.valid_from").alias("matched_since"), F.col("best.action").alias("action"))
    )
    same = (F.col(url_col).cast("string") == F.col("_url")) & (F.col(time_col).cast("long") == F.col("_time"))
    return captures.join(verdicts, same, "left").drop("_url", "_time")
