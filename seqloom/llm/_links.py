"""From buckets of candidates to classes, without emitting all pairs of a group.

`classes` verifies members against the least members of their buckets, in three steps: each against the
least of its heads; one pair of any two components that are left; the other pairs of different components.
A bucket whose members are all in one component is settled, since further pairs would change no class. Of
the other buckets every pair of members in different components is verified, except those that `plausible`
or their lengths rule out, so classes are those of an exhaustive comparison of each bucket. Pairs are made only
between members outside a bucket's largest component and its other members, in cells of a grid, so that a large
bucket is shared by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import BROADCAST_KEYS, discard, small, table

#: Buckets of more members in the last step are compared where they meet, if that is possible.
FEW = 32
#: A bucket of n members is a grid of some n / CELL cells, whose rows and columns grow with the root of it.
CELL = 400


def shared(members: DataFrame, name: str) -> DataFrame:
    """The `members (bucket, id, ...)` that are not alone in their bucket; only bucket numbers are shuffled to find them."""
    buckets = table(members.groupBy("bucket").count().where("count > 1").select("bucket"), f"{name}-buckets")
    out = table(members.join(small(buckets, buckets.count(), BROADCAST_KEYS), "bucket", "left_semi"), f"{name}-members")
    discard(buckets)
    return out


def classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    info: DataFrame | None,
    name: str,
    known: DataFrame | None = None,
    *,
    similarity: float,
    plausible: Callable[[Column, Column], Column],
    prepare: Callable[[DataFrame], None] | None = None,
    at_once: tuple[int, Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column], Callable[[Column, Column, Column], Column]] | None = None,
) -> DataFrame:
    """`(id, component)` of every member that is linked to another; a component is named by its least id.

    members: distinct `(bucket, id)`, or `(bucket, id, info)`: then no pair is verified that its infos rule out.
    verify: takes distinct pairs `(a, b)`, a < b, and returns those that are linked. prepare: called before, once,
    with a table of the distinct ids (column `id`) that any later pair is made of. at_once: how the last step compares the members of
    large buckets without moving pairs: up to which length, `(id, detail)` of given ids of that length, whether two details are linked,
    and whether a bucket, of all that hold two members, is the one to compare them in, by it and their infos. info: `(id, info)` where
    members have none; such members may be alone in their buckets. Infos are structs with the length `n`. known: further links `(a, b)`. Of
    linked members, the shorter one has `similarity` of the longer one's length at least, and `plausible` of their
    infos, the shorter one's first, is true. Empty members give no rows.
    """
    may_link = lambda i, j: F.when(i["n"] <= j["n"], plausible(i, j)).otherwise(plausible(j, i))
    carried = "info" in members.columns
    if carried:
        groups = members.groupBy("bucket").agg(F.min(F.struct("id", "info")).alias("head"), F.max("id").alias("last"), F.count("*").alias("n"))
        groups = table(groups.select("bucket", F.col("head.id").alias("a"), F.col("head.info").alias("info_a"), "last", "n").where("a < last"), f"{name}-groups")
        star = members.join(small(groups, groups.count()), "bucket").where("id > a").withColumnRenamed("id", "b")
    else:
        # dealt out once, for the heads of the buckets and for the members that join them
        dealt = members.where("bucket IS NOT NULL AND id IS NOT NULL").select("bucket", "id").repartition("bucket")
        groups = dealt.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
        star = dealt.join(groups.hint("shuffle_hash"), "bucket").where("id > a").withColumnRenamed("id", "b")
        star = star.join(info.select(F.col("id").alias("a"), F.col("info").alias("info_a")), "a").join(info.select(F.col("id").alias("b"), "info"), "b")
    star = star.withColumn("may", may_link(F.col("info"), F.col("info_a"))).where("n > 2 OR may")
    star = table(star.select("bucket", "a", "b", "n", "may", "info"), f"{name}-star")
    if carried:
        discard(groups)
    if prepare:
        prepare(table(star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct(), f"{name}-ids"))
    pairs = table(star.where("may").select("a", "b").distinct(), f"{name}-pairs")

    def merged(found: DataFrame, links: DataFrame) -> DataFrame:
        """The components with more links; `found` itself if there are none."""
        links = table(links, f"{name}-links")
        out = found
        if links.limit(1).count():
            # only whole components are joined, so their names are the ends of the edges
            renamed = table(components(placed(links, found).select(F.col("p").alias("a"), F.col("q").alias("b")), name), f"{name}-renamed")
            new = renamed.select(F.col("id").alias("component"), F.col("component").alias("to"))
            old = found.join(small(new, renamed.count()), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            out = table(old.unionByName(renamed.join(found, "id", "left_anti").select("id", "component")), f"{name}-found")
            discard(found)
            discard(renamed)
        discard(links)
        return out

    def placed(of: DataFrame, found: DataFrame) -> DataFrame:
        """`of (a, b)` with their components p and q."""
        out = of.join(found.select(F.col("id").alias("a"), F.col("component").alias("p")), "a", "left").join(found.select(F.col("id").alias("b"), F.col("component").alias("q")), "b", "left")
        return out.select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))

    def apart(of: DataFrame, found: DataFrame) -> DataFrame:
        return placed(of, found).where("p <> q")

    # a member against the least of its heads, one pair of any two components, and then the rest of the pairs
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = table(verify(first), f"{name}-links")
    found = table(components(links if known is None else links.unionByName(known), name), f"{name}-found")
    discard(links)
    others = table(apart(pairs.join(first, ["a", "b"], "left_anti"), found), f"{name}-others")
    discard(pairs)
    one = table(_one_each(others), f"{name}-one")
    found = merged(found, verify(one))
    found = merged(found, verify(apart(others.select("a", "b").join(one, ["a", "b"], "left_anti"), found).select("a", "b")))
    discard(others)
    discard(one)
    larger = star.where("n > 2")  # the only pair of a smaller bucket has been verified
    heads = table(placed(larger.select("a", "b").distinct(), found), f"{name}-heads")
    open_buckets = table(larger.join(heads.where("p <> q"), ["a", "b"], "left_semi").select("bucket").distinct(), f"{name}-open")
    here = larger.join(open_buckets, "bucket", "left_semi").join(heads, ["a", "b"]).select("bucket", F.col("b").alias("id"), F.col("q").alias("component"), "info")
    here = table(here, f"{name}-here")
    for done in (star, heads, open_buckets):
        discard(done)
    if at_once is None:
        links = verify(_rest(here, similarity, may_link))
    else:
        longest, details, linked, here_only = at_once
        large = table(here.groupBy("bucket").count().where(F.col("count") > FEW).select("bucket"), f"{name}-large")
        large = small(large, large.count())
        many = here.join(large, "bucket", "left_semi")
        known = table(details(many.select("id").distinct()), f"{name}-details")
        links = _rest(many.join(known, "id"), similarity, may_link, linked, here_only)
        # pairs of small buckets, and those of large ones of which one is too long
        others = here.join(large, "bucket", "left_anti").withColumn("over", F.lit(0)).unionByName(many.withColumn("over", F.lit(longest)).where(F.col("info.n") > F.lit((similarity - 0.01) * longest)))
        links = verify(_rest(others, similarity, may_link)).unionByName(links)
    found = merged(found, links)
    discard(here)
    if at_once is not None:
        discard(known)
    return found


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of `pairs (a, b, p, q)` the least pair `(a, b)` of any two components p and q."""
    return pairs.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min(F.struct("a", "b")).alias("x")).select("x.a", "x.b")


def _rest(here: DataFrame, similarity: float, may_link: Callable[[Column, Column], Column], linked: Callable[[Column, Column], Column] | None = None, here_only: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """All pairs `(a, b)` of `here (bucket, id, component, info)` in a bucket but not in a component that may be linked.

    Of two members in different components one at least is outside the bucket's largest component, so those
    outside are joined with all, and a large group of copies isn't paired with itself. Lengths fall into ranges by
    powers of a ratio a little below `similarity`, so those of linked members lie in one range or in adjacent ones.
    A large bucket is a grid of cells, each joined by itself. With a column `over`, one of a pair is longer than that.
    linked: with a column `detail`, pairs are those that it holds for; it is tested in the join.
    """
    ratio = -math.log(similarity - 0.01) if similarity > 0.02 else math.inf
    at = F.floor(F.log(F.greatest(F.col("info.n"), F.lit(1)).cast("double")) / F.lit(ratio))
    sizes = here.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("x"), F.ceil(F.sqrt(F.sum("count") / CELL)).alias("cells")).select("bucket", F.col("x.component").alias("main"), "cells")
    placed = here.join(main, "bucket")
    row, cells = F.pmod(F.xxhash64("id"), F.col("cells")), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    more = [x for x in ("detail", "over") if x in here.columns]
    ends = placed.where("component <> main").select("bucket", F.col("id").alias("x"), F.col("component").alias("p"), F.col("info").alias("i"), *(F.col(m).alias(f"{m}_x") for m in more), at.alias("at"), row.alias("row"), F.explode(cells).alias("column"))
    ends = ends.withColumn("range", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))).drop("at")
    every = placed.select("bucket", F.col("id").alias("y"), F.col("component").alias("q"), F.col("info").alias("j"), *(F.col(m).alias(f"{m}_y") for m in more), (F.col("component") == F.col("main")).alias("inside"), at.alias("range"), row.alias("column"), F.explode(cells).alias("row"))
    # two members outside meet twice
    meet = (F.col("p") != F.col("q")) & (F.col("inside") | (F.col("x") < F.col("y"))) & may_link(F.col("i"), F.col("j"))
    if "over" in more:
        meet = meet & (F.greatest("i.n", "j.n") > F.col("over_x"))
    if linked:
        meet = F.when(meet & here_only(F.col("bucket"), F.col("i"), F.col("j")), linked(F.col("detail_x"), F.col("detail_y"))).otherwise(False)
    pairs = ends.join(every, ["bucket", "range", "row", "column"]).where(meet)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """`(id, component)` of each end of `edges (a, b)`; a component is named by its least id.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, and
    nothing but a count and a checksum reaches the driver. No edges give no rows.
    """
    now = table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        f"{name}-edges",
    )
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = (
            large.join(lows, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(lows.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before, now = now, table(step, f"{name}-edges")
        discard(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen == mark:
            break
        mark = seen
    ends = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return ends.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
