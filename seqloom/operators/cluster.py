"""Motif clusters: complete linkage, cuts, clades, consensus motifs and their names.

The linkage merges all pairs of reciprocal nearest neighbours at once, round by round, until few are left. Of two pairs the one with the
lower height goes first, then that of the least first members. A cluster is named by its least member while it grows, and
merging only raises heights, so a pair of reciprocal neighbours stays one until it is merged: the tree is that of
merging one least pair at a time. Pairs that aren't given are infinitely far apart, so a cut needs the pairs up to its height only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import safe_name
from seqloom.operators.align import merge
from seqloom.operators.cut import cut as checkpointed
from seqloom.operators.gc import global_rank


#: Most edges that are merged in memory, some 600 motifs of which all pairs are left; a round over more is a Spark job.
LOCAL_EDGES = 200_000


def dissimilarity(r: Column) -> Column:
    """1 - |r|, with r clipped to [-1, 1]; an undefined r is as far as can be."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return F.when(r.isNull() | F.isnan(r), F.lit(1.0)).otherwise(1 - F.abs(clipped))


def complete_linkage(n: int, pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float, int]]:
    """The tree from pairs in memory, in the order of the merges: `(a, b, height, size)`, the k-th merge makes cluster n + k."""
    name, out = list(range(n)), []
    for step, (i, j, height, size) in enumerate(_least_first([(i, j, d, 1, 1) for i, j, d in pairs])):
        out.append((min(name[i], name[j]), max(name[i], name[j]), height, size))
        name[i] = n + step
    return out


def _least_first(edges: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int]]:
    """`(lo, hi, height, size)` of edges `(i, j, d, n_i, n_j)` in memory, one least pair at a time."""
    size = {i: n for e in edges for i, n in ((e[0], e[3]), (e[1], e[4]))}
    ids = sorted(size)
    place = {x: k for k, x in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.inf)
    for i, j, x, *_ in edges:
        d[place[i], place[j]] = d[place[j], place[i]] = x
    out = []
    while len(ids) and np.isfinite(d.min()):
        i, j = sorted(map(int, np.unravel_index(int(d.argmin()), d.shape)))
        height, size[ids[i]] = float(d[i, j]), size[ids[i]] + size[ids[j]]
        out.append((ids[i], ids[j], height, size[ids[i]]))
        d[i, :] = d[:, i] = np.maximum(d[i, :], d[j, :])
        d[j, :] = d[:, j] = d[i, i] = np.inf
    return out


def _heights(pairs: DataFrame) -> DataFrame:
    """Clusters of one motif each: `(i, j, d, n_i, n_j)`, i < j; of repeated pairs the farthest counts."""
    ends = pairs.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round(dissimilarity(F.col("r")), 9).alias("d"))
    return ends.groupBy("i", "j").agg(F.max("d").alias("d")).select("i", "j", "d", F.lit(1).cast("long").alias("n_i"), F.lit(1).cast("long").alias("n_j"))


def merges(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """`(lo, hi, height, size, round)` of the complete linkage over `edges (i, j, d, n_i, n_j)`.

    lo and hi are the least members of the two clusters, lo < hi; the new cluster is lo. A round takes every pair
    that is the nearest of both its ends, so at least the least pair of all; once no more than `local` edges are left,
    they are merged in memory, to the same tree. Clusters without a common edge are never merged.
    """
    spark, kind = edges.sparkSession, edges.schema["i"].dataType.simpleString()
    done, number = None, 0
    while True:
        rest = edges.select("i", "j", "d", "n_i", "n_j").limit(local + 1).collect()  # bounded
        if len(rest) <= local:
            last = [(*m, number + k) for k, m in enumerate(_least_first([tuple(x) for x in rest]))]
            last = spark.createDataFrame(last, f"lo {kind}, hi {kind}, height double, size long, round int")
            return last if done is None else done.unionByName(last)
        key = F.struct("d", "i", "j").alias("key")
        nearest = edges.select(F.explode(F.array("i", "j")).alias("end"), key).groupBy("end").agg(F.min("key").alias("key"))
        mutual = nearest.groupBy("key").count().where("count = 2").select("key.i", "key.j", F.lit(True).alias("now"))
        marked = checkpointed(edges.join(mutual, ["i", "j"], "left"))
        now = marked.where("now").select(F.col("i").alias("lo"), F.col("j").alias("hi"), F.col("d").alias("height"), (F.col("n_i") + F.col("n_j")).alias("size"), F.lit(number).alias("round"))
        done = now if done is None else done.unionByName(now)
        edges, number = _contracted(marked.drop("now"), now), number + 1


def _contracted(edges: DataFrame, now: DataFrame) -> DataFrame:
    """The edges between the clusters after the merges `now`; two clusters keep one only if all pairs of their parts had one."""
    to = now.select(F.explode(F.array("lo", "hi")).alias("old"), F.col("lo").alias("new"), "size")
    for end, n in (("i", "n_i"), ("j", "n_j")):
        place = to.select(F.col("old").alias(end), F.col("new").alias(f"{end}_new"), F.col("size").alias(f"{n}_new"))
        edges = edges.join(place, end, "left").withColumn(f"parts_{end}", F.when(F.col(f"{end}_new").isNull(), 1).otherwise(2))
        edges = edges.withColumn(end, F.coalesce(f"{end}_new", end)).withColumn(n, F.coalesce(f"{n}_new", n)).drop(f"{end}_new", f"{n}_new")
    first = F.col("i") < F.col("j")
    both = edges.where("i <> j").select(
        F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d",
        F.when(first, F.col("n_i")).otherwise(F.col("n_j")).alias("n_i"), F.when(first, F.col("n_j")).otherwise(F.col("n_i")).alias("n_j"),
        (F.col("parts_i") * F.col("parts_j")).alias("parts"),
    )
    found = both.groupBy("i", "j").agg(F.max("d").alias("d"), F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"), F.max("parts").alias("parts"), F.count("*").alias("edges"))
    return found.where("edges = parts").drop("parts", "edges")


def linkage(pairs: DataFrame, motifs: DataFrame) -> DataFrame:
    """`(step, a, b, height, size)`: motifs are 0 to n - 1 in index order, step k makes cluster n + k of clusters a < b.

    Steps go by height, then size, then least members. No pairs, no rows.
    """
    n = motifs.count()
    steps = global_rank(merges(_heights(pairs)), ["height", "size", "lo", "hi"], "step").withColumn("step", (F.col("step") - 1).cast("int"))
    place = global_rank(motifs.select("motif_idx"), ["motif_idx"], "place").select(F.col("motif_idx").alias("cluster"), (F.col("place") - 1).cast("int").alias("place"))
    # what a cluster was before a merge: the merge that made it, as the last one under its name, or a motif
    uses = steps.select("step", "round", F.explode(F.array("lo", "hi")).alias("cluster"), F.col("lo").alias("made"))
    uses = uses.withColumn("before", F.lag("step").over(Window.partitionBy("cluster").orderBy("round"))).join(place, "cluster")
    names = uses.select("step", F.coalesce(F.col("before") + n, "place").alias("name")).groupBy("step").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return steps.join(names, "step").select("step", "a", "b", "height", F.col("size").cast("int").alias("size"))


def leaf_order(n: int, merges: list[tuple[int, int, float, int]]) -> list[int]:
    """Leaves of a tree in memory from left to right."""
    members = {i: [i] for i in range(n)}
    for k, (a, b, *_) in enumerate(merges):
        members[n + k] = members.pop(a) + members.pop(b)
    return [x for m in members.values() for x in m]


def leaf_places(tree: DataFrame, n: int) -> DataFrame:
    """`(place, motif)` of the leaves of a `linkage` tree of n motifs from left to right, a cluster's part a before its part b.

    A leaf's place is the sum of the sizes left of it on its way to the root; ways are halved with each round. Where
    the linkage left several trees, they follow one another by the numbers of their roots.
    """
    spark = tree.sparkSession
    made = tree.select((F.col("step") + n).alias("node"), "a", "b", F.col("size").cast("long").alias("size"))
    sizes = made.select("node", "size").unionByName(spark.range(n).select(F.col("id").cast("int").alias("node"), F.lit(1).cast("long").alias("size")))
    left = made.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("left")), "a")
    up = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).cast("long").alias("shift")), F.struct(F.col("b").alias("node"), F.col("left").alias("shift")))).alias("x"), F.col("node").alias("parent"))
    ways = checkpointed(sizes.select("node").join(up.select("x.node", "x.shift", "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("parent"), F.coalesce("shift", F.lit(0)).alias("shift")))
    while True:
        above = ways.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("shift").alias("more"))
        longer = checkpointed(ways.join(above, "parent").select("node", F.col("next").alias("parent"), (F.col("shift") + F.when(F.col("parent") == F.col("node"), 0).otherwise(F.col("more"))).alias("shift"), (F.col("next") != F.col("parent")).alias("moved")))
        ways = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return global_rank(ways.where(F.col("node") < n), ["parent", "shift"], "place").select((F.col("place") - 1).cast("int").alias("place"), F.col("node").cast("int").alias("motif"))


def _labelled(motifs: DataFrame, found: DataFrame) -> DataFrame:
    """`(motif_idx, head)`: the least member of each motif's cluster after the merges `found`."""
    heads = checkpointed(motifs.select("motif_idx").join(found.select(F.col("hi").alias("motif_idx"), F.col("lo").alias("to")), "motif_idx", "left").select("motif_idx", F.coalesce("to", "motif_idx").alias("head")))
    while True:  # a motif's way to its head is halved with each round
        next_ = heads.select(F.col("motif_idx").alias("head"), F.col("head").alias("to"))
        longer = checkpointed(heads.join(next_, "head").select("motif_idx", F.col("to").alias("head"), (F.col("to") != F.col("head")).alias("moved")))
        heads = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return heads


def cut(pairs: DataFrame, motifs: DataFrame, threshold: float) -> DataFrame:
    """`(motif_idx, cluster_id)`: merges up to the height 1 - threshold hold; clusters count from 0 by least member.

    Only pairs up to that height are read, since no higher one can be part of a merge.
    """
    heads = _labelled(motifs, merges(_heights(pairs).where(F.col("d") <= 1 - threshold + 1e-12)))
    number = global_rank(heads.where("motif_idx = head").select("head"), ["head"], "number")
    return heads.join(number, "head").select("motif_idx", (F.col("number") - 1).cast("int").alias("cluster_id"))


def clades(pairs: DataFrame, motifs: DataFrame, height: float) -> DataFrame:
    """`(motif_idx, place, clade)`: motifs as a dendrogram has them from left to right, and those under one branch below `height`.

    Clades count from 1 by their first place; a motif that no merge below `height` takes has none.
    """
    n = motifs.count()
    index = global_rank(motifs.select("motif_idx"), ["motif_idx"], "motif").withColumn("motif", (F.col("motif") - 1).cast("int"))
    places = leaf_places(linkage(pairs, motifs), n).join(index, "motif").select("motif_idx", "place")
    heads = _labelled(motifs, merges(_heights(pairs).where(F.col("d") < height))).join(places, "motif_idx")
    several = heads.groupBy("head").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    number = global_rank(several.select("head", "first"), ["first"], "clade").select("head", F.col("clade").cast("int").alias("clade"))
    return heads.join(number, "head", "left").select("motif_idx", "place", "clade")


def members(clusters: DataFrame, least: int = 2) -> DataFrame:
    """`(cluster_id, members)` of clusters of `least` motifs or more, members in index order."""
    return clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("motif_idx")).alias("members")).where(F.size("members") >= least)


def consensus_motifs(clusters: DataFrame, motifs: DataFrame) -> DataFrame:
    """`(cluster_id, pwm)` of every cluster of two or more."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        m = merge([np.array([*map(list, x)]) for x in f.sort_values("motif_idx")["pwm"]])
        rows = [] if m is None else [[list(map(float, c)) for c in m]]
        return pd.DataFrame({"cluster_id": f["cluster_id"].iloc[: len(rows)].to_numpy(), "pwm": pd.Series(rows, dtype=object)})

    return clusters.join(motifs.select("motif_idx", "pwm"), "motif_idx").groupBy("cluster_id").applyInPandas(run, "cluster_id int, pwm array<array<double>>")


def family_of(clusters: DataFrame, motifs: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(cluster_id, family, first_member)`: the family of the first member, by index, that has one; else Unknown."""
    known = with_metadata(clusters.join(motifs.select("motif_idx", "name"), "motif_idx"), metadata)
    first = F.min_by("family", F.when(F.col("family") != "Unknown", F.col("motif_idx")))
    return known.groupBy("cluster_id").agg(F.coalesce(first, F.lit("Unknown")).alias("family"), F.min("motif_idx").alias("first_member"))


def with_metadata(named: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds gene and family by name, Unknown where the name has none."""
    facts = metadata.select("name", F.col("gene").alias("_gene"), F.col("family").alias("_family"))
    out = named.join(facts, "name", "left")
    return out.withColumn("gene", F.coalesce("_gene", F.lit("Unknown"))).withColumn("family", F.coalesce("_family", F.lit("Unknown"))).drop("_gene", "_family")


def consensus_names(clusters: DataFrame, motifs: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(cluster_id, name, matrix_id, genes)` of clusters of two or more.

    Names are the family and a running number within it, by first member; ids and genes are joined
    in index order, genes distinct and sorted, ten at most.
    """
    several = clusters.join(members(clusters).select("cluster_id"), "cluster_id", "left_semi")
    number = F.row_number().over(Window.partitionBy("family").orderBy("first_member"))
    families = family_of(several, motifs, metadata).withColumn("name", safe_name(F.concat("family", F.lit("_"), number.cast("string"), F.lit("_merged"))))
    rows = with_metadata(several.join(motifs.select("motif_idx", "name", "matrix_id"), "motif_idx"), metadata)
    joined = rows.groupBy("cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("motif_idx", "matrix_id"))), lambda x: x["matrix_id"]), "|").alias("matrix_id"),
        F.array_join(F.slice(F.array_sort(F.collect_set("gene")), 1, 10), "_").alias("genes"),
    )
    return families.join(joined, "cluster_id").select("cluster_id", "name", "matrix_id", "genes")


def unmerged(clusters: DataFrame, motifs: DataFrame) -> DataFrame:
    """Motifs in no cluster of two or more."""
    taken = clusters.join(members(clusters).select("cluster_id"), "cluster_id", "left_semi")
    return motifs.join(taken.select("motif_idx"), "motif_idx", "left_anti")


def curated_library(clusters: DataFrame, motifs: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(name, matrix_id, merged, pwm)`: consensus motifs, the first of each name, and the motifs left alone."""
    named = consensus_names(clusters, motifs, metadata).join(consensus_motifs(clusters, motifs), "cluster_id")
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("cluster_id"))).where("_n = 1")
    left = unmerged(clusters, motifs).select("name", "matrix_id", F.lit(False).alias("merged"), "pwm")
    return first.select("name", "matrix_id", F.lit(True).alias("merged"), "pwm").unionByName(left)


def motif_list(clusters: DataFrame, motifs: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(place, name, matrix_id, gene, family)`: the curated library's motif list with its metadata, places from 0.

    First the consensus motifs by cluster, with the ids of their members; then the motifs left alone by
    name and index, with their name as id. An empty library gives no rows.
    """
    merged = consensus_names(clusters, motifs, metadata).join(family_of(clusters, motifs, metadata).select("cluster_id", "family"), "cluster_id")
    merged = merged.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.col("cluster_id").cast("long").alias("at"), "name", "matrix_id", F.col("genes").alias("gene"), "family")
    alone = with_metadata(unmerged(clusters, motifs).select("motif_idx", "name"), metadata)
    alone = alone.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.col("motif_idx").cast("long").alias("at"), "name", F.col("name").alias("matrix_id"), "gene", "family")
    placed = global_rank(merged.unionByName(alone), ["part", "key", "at"], "place")
    return placed.select((F.col("place") - 1).cast("int").alias("place"), "name", "matrix_id", "gene", "family")


def list_lines(listed: DataFrame) -> DataFrame:
    """`(number, name)` of a `motif_list` by name, counted from 1; equal names keep their places."""
    return global_rank(listed.select("name", "place"), ["name", "place"], "number").select(F.col("number").cast("int").alias("number"), "name")
