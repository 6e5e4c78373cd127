"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources share a budget in proportion to their weights; a target that is above `most_repeats`
times its source stops there, and the excess is shared anew among the others until none is above.
Blocks: the budget is cut into blocks of `BLOCK` words. The highest quotients target / (2 k + 1) get a
block each, first over the sources and then, with a source's quota, over its shards by their size, so
every shard has a whole number of blocks to give. Documents are dealt to the shards of their source by
a hash and ordered in one by it; a shard's text in that order is cut into the same blocks. A shard gives
all of its blocks as often as its quota holds them, and the rest as a run of blocks from a seeded
place, round the end, so documents are cut at the two ends of the run only.

Shards are of some `SHARD_WORDS` words, so a source of any size is spread over many; what is ranked are
a few quotients per source and shard. Apart from totals nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._ranks import ranked
from seqloom.llm._scratch import small, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK = 16
SHARD_WORDS = 1 << 20
SEED = 2024
_SPACES = " \t\n\x0b\f\r"


def count_words(text: Column) -> Column:
    """Runs of anything but the six ASCII spaces; 0 for a null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most_repeats: int) -> DataFrame:
    """Adds `no`, `weight` and `target` to `sources (nul, source, source_size)`.

    Sources are numbered by code point, null last, and weigh `weights`, repeating. In each round, the
    sources whose share is above their limit are set to it; only sums over all sources reach the driver.
    """
    limit = F.lit(most_repeats) * F.col("source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = table(ranked(sources, [F.col("nul"), F.col("source")], "mix-order").withColumnRenamed("rank", "no").withColumn("weight", weight), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    above = F.lit(False)
    while True:
        sums = rows.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if sums["n"] == stopped or not sums["weight"]:
            break
        stopped, unit = sums["n"], (share * total - sums["held"]) / sums["weight"]
        above = F.lit(unit) * F.col("weight") > limit
    return rows.withColumn("target", F.least(F.lit(unit) * F.col("weight"), limit.cast("double")))


def apportion(cells: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds `quota` to `cells (<by>, id, votes, seats)`: of each group's `seats`, equal in all its rows, one goes to each of the highest quotients votes / (2 k + 1).

    Ties go to the smaller id, then the smaller k. A cell's quota is bounded from both sides by two
    divisors, and only the few quotients between are ranked. Cells without votes have none.
    """
    groups = cells.groupBy(*by).agg(F.sum("votes").alias("_all"), F.count_if(F.col("votes") > 0).alias("_n"))
    wide = cells.join(small(groups, groups.count()), by)
    at = lambda seats: F.floor(F.col("votes") * seats / F.col("_all") + 0.5)
    some = (F.col("votes") > 0) & (F.col("_all") > 0)
    sure = F.when(some, F.greatest(at(F.greatest(F.col("seats") - F.col("_n") / 2, F.lit(0.0))) - 1, F.lit(0))).otherwise(0)
    most = F.when(some, at(F.col("seats") + F.col("_n") / 2) + 1).otherwise(0)
    held = table(wide.select(*cells.columns, sure.cast("long").alias("_sure"), most.cast("long").alias("_most")), f"{name}-bounds")
    each = held.where("_most > _sure").select(*by, "id", "votes", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    each = each.withColumn("_quotient", F.col("votes") / (2 * F.col("_k") + 1))
    order = [*map(F.col, by), F.col("_quotient").desc(), F.col("id"), F.col("_k")]
    places = table(ranked(each, order, f"{name}-quotients"), f"{name}-ranks")
    firsts = places.groupBy(*by).agg(F.min("rank").alias("_first"))
    left = held.groupBy(*by).agg(F.first("seats").alias("_seats"), F.sum("_sure").alias("_given"))
    left = left.join(firsts, by).select(*by, (F.col("_first") + F.col("_seats") - F.col("_given")).alias("_end"))
    won = places.join(small(left, groups.count()), by).where("rank < _end").groupBy(*by, "id").agg(F.count("*").alias("_won"))
    return held.join(won, [*by, "id"], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_most", "_won")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_repeats: int = MOST_REPEATS,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: `(<id_col>, source, size, source_size, target, taken, first_word, run_words, repeats)`.

    size counts a document's words (null text: 0), target is the words that its source should give,
    taken the words that the mix takes of it: the whole text `repeats` times, and `run_words` words from
    word `first_word` on once more, round the end of the text where the run of blocks ends and begins in
    it. No document is taken more than `most_repeats` times. A null source is a source of its own, after
    all others. Rows that are equal in id and text are documents of their own, in any order; null ids are
    dealt out by their texts. Very long texts may lie in several blocks; extra columns are ignored; an
    empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    identity = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("nul"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        count_words(text).alias("size"),
        F.substring(identity, 1, 16).alias("h"),
    )
    sized = table(sized, "mix-sizes")
    totals = sized.groupBy("nul", "source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(totals, weights, share, most_repeats)
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    seats = F.lit(int(share * budget / block + 0.5)).cast("long")
    quotas = apportion(sources.withColumn("id", F.col("no")).withColumn("votes", F.col("target")).withColumn("seats", seats).withColumn("all", F.lit(0)), ["all"], "mix-source")
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1))
    sources = table(quotas.select("nul", "source", "no", "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards")), "mix-quotas")

    number = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.col("shards"))
    dealt = table(sized.join(small(sources, sources.count()), ["nul", "source"]).withColumn("shard", number), "mix-dealt")
    cells = dealt.groupBy("no", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("seats"))
    cells = apportion(cells.select("no", F.col("shard").alias("id"), F.col("words").cast("double").alias("votes"), "seats", "words"), ["no"], "mix-shard")
    blocks = F.ceil(F.col("words") / F.lit(block))
    given = F.least(F.col("quota"), blocks * most_repeats)
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("run"), F.col("no").cast("string"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
    runs = cells.where("words > 0").select(
        "no", F.col("id").alias("shard"), "words", blocks.alias("blocks"), F.expr(f"least(quota, ceil(words / {block}) * {most_repeats}) div ceil(words / {block})").alias("repeats"), F.pmod(given, blocks).alias("extra"), F.pmod(place, blocks).alias("begin")
    )
    order = Window.partitionBy("no", "shard").orderBy("h", "id")
    laid = dealt.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = laid.join(runs, ["no", "shard"], "left")
    begin, end = F.col("begin") * block, (F.col("begin") + F.col("extra")) * block
    last = F.col("start") + F.col("size")
    within = lambda a, b: F.greatest(F.least(last, b) - F.greatest(F.col("start"), a), F.lit(0))
    tail, head = within(begin, F.least(end, F.col("words"))), within(F.lit(0), end - F.col("blocks") * block)
    run = F.coalesce(tail + head, F.lit(0))
    repeats = F.coalesce("repeats", F.lit(0))
    first = F.when(tail > 0, F.greatest(begin - F.col("start"), F.lit(0))).otherwise(0)
    return joined.select(
        F.col("id").alias(id_col),
        F.when(~F.col("nul"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        (repeats * F.col("size") + run).alias("taken"),
        first.alias("first_word"),
        run.alias("run_words"),
        repeats.alias("repeats"),
    )
