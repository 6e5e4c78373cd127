"""Intervals against contigs and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import interval_id, usable_contig
from seqloom.operators.cut import cut

#: The sweep's blocks of so many places; a task holds the distinct places of one.
BLOCK = 1 << 16
#: Bin widths of the index, as powers of two; the last bin holds any place.
LEVELS = (*range(7, 41, 3), 62)


def filter_contigs(contigs: DataFrame, exclude: tuple[str, ...] = (), chrom_col: str = "chrom") -> DataFrame:
    """Without unplaced, random, alternative and excluded contigs."""
    out = contigs.where(usable_contig(F.col(chrom_col)))
    return out.where(~F.col(chrom_col).isin(*exclude)) if exclude else out


def extract_sequences(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """`(interval_id, chrom, st, en, seq_id, seq)`: bases [st - 1, en - 1) of each interval's contig, counted from 0.

    Unknown contigs, starts below 1 and empty stretches give no row; see `extraction_rejects`. Contigs are
    joined piece by piece, so no task needs a whole one.
    """
    return extract_from_chunks(intervals, chunk_contigs(contigs, BLOCK, 0), BLOCK, 0)


def extraction_rejects(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """The intervals that `extract_sequences` leaves out, with the reason."""
    known = intervals.join(contigs.select("chrom", F.length("seq").alias("size")), "chrom", "left")
    reason = F.when(F.col("size").isNull(), "unknown contig").when((F.col("st") < 1) | (F.col("en") <= F.col("st")), "bad coordinates").when(F.col("st") > F.col("size"), "beyond the end")
    return known.withColumn("reason", reason).where("reason IS NOT NULL").select("interval_id", "chrom", "st", "en", "reason")


def _targets(targets: DataFrame) -> DataFrame:
    """`(interval_id, chrom, st, en)` as half-open stretches [st - 1, en); empty ones and nulls go."""
    return targets.where("en > st - 1").select("interval_id", "chrom", (F.col("st") - 1).alias("st"), "en")


def _index(rows: DataFrame) -> DataFrame:
    """Adds `_level` and `_bin`: the narrowest bin that holds all of [st, en)."""
    last = F.col("en") - 1
    level = F.coalesce(*(F.when(F.shiftright("st", s) == F.shiftright(last, s), s) for s in LEVELS), F.lit(LEVELS[-1]))
    return rows.withColumn("_level", level).withColumn("_bin", F.expr("shiftright(st, _level)"))


def _above(rows: DataFrame, itself: bool) -> DataFrame:
    """A row per wider level, and per its own if asked for, with the bin there."""
    wider = F.filter(F.array(*map(F.lit, LEVELS)), lambda s: (s >= F.col("_level")) if itself else (s > F.col("_level")))
    return rows.withColumn("_level", F.explode(wider)).withColumn("_bin", F.expr("shiftright(st, _level)"))


def overlap_pairs(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """`(cand_id, interval_id)` of every candidate [st, en) and every target [st - 1, en) that touch on a contig.

    An index of nested bins: each interval lies in the narrowest bin that holds it. Of two that touch, the
    bin of one lies within the other's, so each side is looked up at the levels above its own: an interval
    of any length gives a dozen rows at most. Places are not negative.
    """
    here = _index(candidates.where("en > st AND st >= 0").select("cand_id", "chrom", "st", "en"))
    there = _index(_targets(targets))
    keys = ["chrom", "_level", "_bin"]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("cand_id", *keys, F.col("st").alias("_cs"), F.col("en").alias("_ce")).join(b, keys)
        return both.where("_cs < en AND _ce > st").select("cand_id", "interval_id")

    return joined(_above(here, True), there).unionByName(joined(here, _above(there, False)))


def overlap_counts(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """`(cand_id, overlaps)`: how many targets [st - 1, en) each candidate [st, en) touches.

    These are the targets that start before its end, less those that end before its start. Starts and ends
    are counted per place, and running sums over a block's places, with the sums of the blocks before it
    passed on, give both numbers: an interval is two rows however long it is, and no pair is made.
    Rows are dealt out by place before they are counted, so no task that reads a large split keeps all its
    places, and the sums are written once for all that reads them.
    """
    there = _targets(targets)
    point = lambda rows, pos, s, e: rows.select("chrom", F.col(pos).alias("pos"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    asked = candidates.where("en > st").select("cand_id", "chrom", F.col("st").alias("a"), (F.col("en") - 1).alias("b"))
    places = point(there, "st", 1, 0).unionByName(point(there, "en", 0, 1)).unionByName(point(asked, "a", 0, 0)).unionByName(point(asked, "b", 0, 0))
    places = places.repartition("chrom", "pos").groupBy("chrom", "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).withColumn("block", F.expr(f"floor(pos / {BLOCK})"))
    upto = Window.partitionBy("chrom", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut(places.select("chrom", "block", "pos", *(F.sum(c).over(upto).alias(c) for c in "se")))
    before = Window.partitionBy("chrom").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("chrom", "block").agg(F.max("s").alias("s"), F.max("e").alias("e"))  # running sums never fall
    blocks = blocks.select("chrom", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "se"))
    sums = sums.join(blocks, ["chrom", "block"]).select("chrom", "pos", (F.col("s") + F.col("s0")).alias("s"), (F.col("e") + F.col("e0")).alias("e"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(False).alias("begun")), F.struct(F.col("b").alias("pos"), F.lit(True).alias("begun"))))
    both = asked.select("cand_id", "chrom", ends.alias("x")).select("cand_id", "chrom", "x.pos", "x.begun").join(sums, ["chrom", "pos"])
    counts = both.groupBy("cand_id").agg(F.sum(F.when(F.col("begun"), F.col("s")).otherwise(-F.col("e"))).alias("overlaps"))
    return candidates.select("cand_id").join(counts, "cand_id", "left").select("cand_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def without_overlap(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates `(cand_id, chrom, st, en)` [st, en) that touch no target [st - 1, en) of their contig; ids are distinct."""
    taken = overlap_counts(candidates, targets).where("overlaps > 0").select("cand_id")
    return candidates.join(taken, "cand_id", "left_anti").select(*candidates.columns)


def chunk_contigs(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """`(chrom, chunk, offset, seq)`: pieces of `size` bases and `overlap` more, for contigs too long for one row."""
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("seq") / size) - 1, F.lit(0)))
    rows = contigs.select("chrom", "seq", F.explode(chunks).alias("chunk"))
    return rows.select("chrom", "chunk", (F.col("chunk") * size).alias("offset"), F.substring(F.col("seq"), (F.col("chunk") * size + 1).cast("int"), F.lit(size + overlap)).alias("seq"))


def extract_from_chunks(intervals: DataFrame, chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """`extract_sequences` over `chunk_contigs`. Intervals within a chunk and its overlap are cut from it; longer ones are put together from their chunks."""
    valid = intervals.where("st >= 1 AND en > st").select("interval_id", "chrom", "st", "en").withColumn("chunk", F.expr(f"(st - 1) div {size}"))
    inside = F.expr(f"en - 1 <= (chunk + 1) * {size} + {overlap}")
    named = lambda rows: rows.select("interval_id", "chrom", "st", "en", interval_id(F.col("chrom"), F.col("st"), F.col("en")).alias("seq_id"), "seq").where("seq <> ''")
    # where every letter is one byte, places are bytes and no letter before them is looked at
    near = valid.where(inside).join(chunks.withColumn("plain", F.octet_length("seq") == F.length("seq")), ["chrom", "chunk"])
    at, length = (F.col("st") - F.col("offset")).cast("int"), (F.col("en") - F.col("st")).cast("int")
    cut = F.when(F.col("plain"), F.substring(F.col("seq").cast("binary"), at, length).cast("string")).otherwise(F.substring("seq", at, length))
    far = valid.where(~inside).withColumn("last", F.expr(f"(en - 2) div {size}")).join(chunks.groupBy("chrom").agg(F.max("chunk").alias("most")), "chrom")
    pieces = far.where("chunk <= most").withColumn("chunk", F.explode(F.expr("sequence(chunk, least(last, most))"))).join(chunks, ["chrom", "chunk"])
    first = F.greatest(F.col("st") - F.col("offset"), F.lit(1))
    length = F.least(F.col("en") - 1 - F.col("offset"), F.lit(size)) - first + 1
    pieces = pieces.withColumn("seq", F.substring(F.col("seq"), first.cast("int"), length.cast("int")))
    whole = pieces.groupBy("interval_id", "chrom", "st", "en").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return named(near.withColumn("seq", cut)).unionByName(named(whole))
