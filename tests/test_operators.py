"""Branches, properties and plain re-derivations of the sequence and motif operators."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import matrix as m
from seqloom.functions import sequence as s
from seqloom.operators import align, background, cluster, gc, intervals, learn, logistic, scan, select
from seqloom.operators.cut import cut
from seqloom.plans import fixtures as fx
from seqloom.plans import queries
from seqloom.plans.pipelines import with_pssm
from seqloom.sources import fasta_source, readers, writers
from seqloom.streaming.scan import stream_matches


SMALL = "/root/testdata/sf0.001"


def motif(spark, *columns, idx=0):
    return spark.createDataFrame([(idx, [list(map(float, c)) for c in columns])], "motif_idx int, pssm array<array<double>>")


A, C, G, T = [2, -1, -1, -1], [-1, 2, -1, -1], [-1, -1, 2, -1], [-1, -1, -1, 2]


@pytest.mark.parametrize(
    ("seq", "matrix", "want"),
    [
        ("CCACGTCC", (A, C, G, T), (8.0, 2, "-")),  # palindrome: a tie goes to the reverse strand
        ("CCAACC", (A, A), (4.0, 2, "+")),
        ("CCTTCC", (A, A), (4.0, 2, "-")),
        ("AACAACAA", (A, A), (4.0, 0, "+")),  # the first of equal places
        ("CCCC", (A, A), (0.0, -1, "?")),
        ("CAACN", (A, A), (0.0, -1, "?")),  # one N spoils the sequence
        ("AA", (A, A), (4.0, 0, "+")),
        ("aacc", (A, A), (4.0, 0, "+")),
        ("A", (A, A), (None, None, None)),
        ("", (A, A), (None, None, None)),
        (None, (A, A), (None, None, None)),
        ("CC", ([2, -math.inf, 0, 0], A), (0.0, -1, "?")),
    ],
)
def test_top_match(spark, seq, matrix, want):
    df = spark.createDataFrame([(1, seq)], "seq_ordinal long, seq string")
    assert tuple(scan.scan_top(df, motif(spark, *matrix)).first())[2:] == want


def test_skip_mode(spark):
    df = spark.createDataFrame([(1, "NAACN")], "seq_ordinal long, seq string")
    assert tuple(scan.scan_top(df, motif(spark, A, A), ambiguous="skip").first())[2:] == (4.0, 1, "+")


def naive(seq, matrix):
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    scores = [round(sum(row[code[b]] for row, b in zip(matrix, seq[i:], strict=False)), 6) for i in range(len(seq) - len(matrix) + 1)]
    return max(scores), scores.index(max(scores))


def test_scan_equals_a_naive_one(spark):
    r = random.Random(1)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_ordinal long, seq string")
    for parts in (1, 7):
        got = {(x.seq_ordinal, x.motif_idx): tuple(x)[2:] for x in scan.scan_top(df.repartition(parts), with_pssm(fx.motifs(spark, SMALL))).collect()}
        for i, pssm in scan.collect_matrices(with_pssm(fx.motifs(spark, SMALL))):
            for n, seq in enumerate(seqs):
                want = (None, None, None)
                if len(seq) >= len(pssm):
                    f, b = naive(seq, pssm.tolist()), naive(seq, pssm[::-1, ::-1].tolist())
                    want = (0.0, -1, "?") if max(f[0], b[0]) <= 0 else (*f, "+") if f[0] > b[0] else (*b, "-")
                assert got[n, i] == want


def test_scan_of_the_reverse_complement_scores_the_same(spark):
    seqs = fx.clean_sequences(spark, "/root/testdata/sf0.001")
    motifs = with_pssm(fx.motifs(spark, SMALL))
    a = scan.scan_top(seqs, motifs).select("seq_ordinal", "motif_idx", "score")
    b = scan.scan_top(seqs.withColumn("seq", s.reverse_complement(F.col("seq"))), motifs).select("seq_ordinal", "motif_idx", "score")
    assert a.exceptAll(b).count() == 0


def test_large_libraries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(scan, "MAX_CELLS", 4)
    with pytest.raises(ValueError):
        scan.collect_matrices(motif(spark, A, A))


def test_streams_scan_like_batches(spark, tmp_path):
    seqs = fx.clean_sequences(spark, "/root/testdata/sf0.001").repartition(3)
    motifs = with_pssm(fx.motifs(spark, SMALL))
    seqs.write.parquet(f"{tmp_path}/in")
    q = stream_matches(spark.readStream.schema(seqs.schema).parquet(f"{tmp_path}/in"), motifs, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(scan.scan_top(seqs, motifs)).count() == 0


def test_trimming(spark):
    clear, dull = [0.7, 0.1, 0.1, 0.1], [0.25] * 4
    rows = [([dull, clear, dull, clear, dull],), ([dull, dull],), ([clear],)]
    df = spark.createDataFrame(rows, "x array<array<double>>")
    got = df.select(F.size(m.trim_ambiguous(F.col("x"))), F.size(m.trim_ambiguous(F.col("x"), both=True))).collect()
    assert [tuple(r) for r in got] == [(4, 3), (0, 0), (1, 1)]
    assert [(len(align.trim_left(np.array(r[0]))), len(align.trim_left(np.array(r[0]), True))) for r in rows] == [(4, 3), (0, 0), (1, 1)]


def test_pseudocounts_are_cut_off(spark):
    ones = [[0.25] * 4] * 3
    df = spark.createDataFrame([(ones,)], "x array<array<double>>")
    assert df.select(m.pseudocount(F.col("x"), 0.01), m.pseudocount(F.col("x"), 0.04)).first() == (0.0, 1.0)


def test_interval_edges(spark):
    contigs = spark.createDataFrame([("c", "ACGTACGT", 8)], "chrom string, seq string, size long")
    rows = [(1, "c", 1, 4), (2, "c", 0, 4), (3, "c", 7, 20), (4, "c", 9, 12), (5, "d", 1, 3), (6, "c", 4, 4)]
    df = spark.createDataFrame(rows, "interval_id long, chrom string, st long, en long")
    got = {x.interval_id: x.seq for x in intervals.extract_sequences(df, contigs).collect()}
    assert got == {1: "ACG", 3: "GT"}
    assert {x.interval_id for x in intervals.extraction_rejects(df, contigs).collect()} == {2, 4, 5, 6}


def _some_intervals(r, n, longest):
    out = []
    for i in range(n):
        st = r.randrange(1, 300_000) if r.random() < 0.7 else r.choice([1, 65_536, 65_537, 131_072])
        out.append((i, r.choice(["c", "c", "c", "d", "e"]), st, st + r.choice([-3, 0, 1, 40, longest])))
    return out


def test_overlaps_equal_all_pairs(spark):
    """Empty and touching intervals, hot places, intervals as long as a contig."""
    r = random.Random(8)
    targets = _some_intervals(r, 300, 250_000) + [(900, "c", 1, 2**33), (901, "c", 2**33, 2**33 + 5), (902, None, 3, 9)]
    cands = _some_intervals(r, 300, 250_000) + [(900, "d", 0, 2**34), (901, "c", 2**33 + 1, 2**33 + 2), (902, "unknown", 3, 9), (903, None, 3, 9)]
    pairs = {(c[0], t[0]) for c in cands for t in targets if c[1] is not None and c[1] == t[1] and c[3] > c[2] and t[3] > t[2] - 1 and c[2] < t[3] and c[3] > t[2] - 1}
    a = spark.createDataFrame(cands, "cand_id long, chrom string, st long, en long").repartition(3)
    b = spark.createDataFrame(targets, "interval_id long, chrom string, st long, en long").repartition(4)
    got = intervals.overlap_pairs(a, b).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == pairs
    counts = {c[0]: sum(p[0] == c[0] for p in pairs) for c in cands}
    assert {x.cand_id: x.overlaps for x in intervals.overlap_counts(a, b).collect()} == counts
    assert {x.cand_id for x in intervals.without_overlap(a, b).collect()} == {c for c, n in counts.items() if not n}
    none = b.limit(0)
    assert intervals.overlap_pairs(a, none).count() == 0 and intervals.without_overlap(a, none).count() == len(cands)


def test_long_intervals_are_few_rows_of_the_index(spark):
    df = spark.createDataFrame([(1, "c", 5, 240_000_000)], "cand_id long, chrom string, st long, en long")
    assert intervals._above(intervals._index(df), True).count() <= len(intervals.LEVELS)


def test_extraction_across_chunks(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACGT") for _ in range(1000))
    contigs = spark.createDataFrame([("c", seq, 1000)], "chrom string, seq string, size long")
    rows = [(i, "c", r.randrange(1, 1100), 0) for i in range(80)]
    rows = [(i, c, st, st + r.choice([1, 10, 49, 50, 51, 300, 5000])) for i, c, st, _ in rows] + [(200, "c", 1, 1001), (201, "c", 50, 51)]
    df = spark.createDataFrame(rows, "interval_id long, chrom string, st long, en long")
    want = {i: seq[st - 1 : en - 1] for i, _, st, en in rows if seq[st - 1 : en - 1]}
    for overlap in (0, 20):
        chunks = intervals.chunk_contigs(contigs, 50, overlap)
        assert {x.interval_id: x.seq for x in intervals.extract_from_chunks(df, chunks, 50, overlap).collect()} == want


def test_nth_smallest(spark):
    r = random.Random(4)
    rows = [(g, r.choice([5, -(2**62), 2**62, r.randrange(-(10**15), 10**15), r.randrange(3000)])) for g in "ab" for _ in range(500)] + [("a", None), ("c", 7)]
    df = spark.createDataFrame(rows, "g string, v long")
    ordered = {g: sorted(v for x, v in rows if x == g and v is not None) for g in "abc"}
    for n in (1, 2, 250, 500):
        got = select.nth_smallest(df, "g", "v", {"a": n, "b": 501 - n, "c": 2, "d": 1})
        assert got == {"a": ordered["a"][n - 1], "b": ordered["b"][500 - n]}
    assert select.nth_smallest(df, "g", "v", {"c": 1}) == {"c": 7} and select.nth_smallest(df, "g", "v", {}) == {}


@pytest.mark.parametrize("bins", [1, 3, 10, 60])
def test_gc_bins_with_ties(spark, bins):
    r = random.Random(bins)
    rows = [(i * 7 % 1009, r.choice(["GGGG", "GATT", "AATT", "AATG", "GCAT", "GCAA"] + ["CATA"] * 9)) for i in range(50)]
    df = spark.createDataFrame(rows, "interval_id long, seq string").repartition(4)
    ordered = sorted(rows, key=lambda x: (sum(b in "GC" for b in x[1]) / 4, x[0]))
    want = {x[0]: i + 1 for i, part in enumerate(np.array_split(np.array(ordered, dtype=object), bins)) for x in part}
    binned = gc.gc_bins(df, bins)
    assert {x.interval_id: x.bin for x in binned.collect()} == want
    plan = binned._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan and "InMemory" not in plan


def test_background_keeps_its_promises(spark):
    sf = "/root/testdata/sf0.01"
    targets, contigs = fx.peaks(spark, sf), fx.contigs(spark, sf)
    chosen, report = background.random_background(targets, contigs, seed=2)
    rows = cut(chosen.select("cand_id", "chrom", "st", "en"))
    assert intervals.without_overlap(rows, targets).count() == rows.count() > 0
    assert rows.groupBy("cand_id").count().where("count > 1").count() == 0
    found = {x.bin: x[1] for x in chosen.groupBy("bin").count().collect()}
    assert all(x.found == found[x.bin] == x.need for x in report.collect())


@pytest.mark.parametrize("chunk", [1000, 1 << 16])
def test_background_draws_from_all_places(spark, chunk):
    """Every chosen place fits by brute force; where a bin needs more than fit, all are taken in turn; chunks change nothing."""
    r = np.random.default_rng(5)
    names = [("c1", 9_000), ("c2", 15_000), ("short", 40)]
    seqs = [(c, "".join(r.choice(list("ACGTN"), n, p=[0.3, 0.2, 0.2, 0.28, 0.02])), n) for c, n in names]
    of = dict((c, x) for c, x, _ in seqs)
    contigs = spark.createDataFrame(seqs, "chrom string, seq string, size long")
    at = r.integers(1, 8_000, 60)
    rows = [(i, f"c{i % 2 + 1}", int(x), int(x) + 50) for i, x in enumerate(at)] + [(70, "c2", 9_000, 9_050)]
    targets = spark.createDataFrame(rows, "interval_id long, chrom string, st long, en long")
    extra = targets.unionByName(spark.createDataFrame([(99, "c1", 9_500, 9_900)], "interval_id long, chrom string, st long, en long"))
    chosen, report = background.random_background(extra, contigs, ratio=40.0, bins=4, chunk=chunk)
    got = chosen.collect()
    assert all(x.need == x.found for x in report.collect()) and sorted(x.cand_id for x in got) == list(range(sum(x.need for x in report.collect())))
    taken = {c: np.zeros(n + 1000, bool) for c, n in names}
    for _, c, st, en in rows:
        taken[c][st - 1 : en] = True
    assert all(x.en - x.st == 50 and x.seq == of[x.chrom][x.st : x.en + 1] and len(x.seq) == 51 for x in got)
    assert not any(taken[x.chrom][x.st : x.en].any() for x in got)
    lengths = [len(of[c][st - 1 : en - 1]) for _, c, st, en in rows]
    assert set(lengths) == {50}
    gcs = sorted((round(sum(b in "GC" for b in of[c][st - 1 : en - 1]) / 50, 6), i) for i, c, st, en in rows)
    tolerance = round((gcs[-1][0] - gcs[0][0]) / 8, 6)
    for k, part in enumerate(np.array_split(np.array(gcs), 4)):
        mid = round((sum(round(g * 50) for g, _ in part) + 0.1) / (50 * len(part) + 0.1), 6)
        fits = {(c, p) for c, n in names for p in range(n - 50) if not taken[c][p : p + 50].any() and of[c][p : p + 51].count("N") <= 25 and abs(round(sum(b in "GC" for b in of[c][p : p + 51]) / 50, 6) - mid) <= tolerance}
        here = [(x.chrom, x.st) for x in got if x.bin == k + 1]
        assert set(here) <= fits and len(set(here)) == min(len(here), len(fits))
        times = Counter(here)
        assert max(times.values()) - min(times.values()) <= 1


def test_background_contigs_are_equally_likely(spark):
    r = np.random.default_rng(7)
    seqs = [(c, "".join(r.choice(list("ACGT"), n)), n) for c, n in (("a", 2_000), ("b", 60_000))]
    contigs = spark.createDataFrame(seqs, "chrom string, seq string, size long")
    targets = spark.createDataFrame([(i, "b", 100 + 7 * i, 130 + 7 * i) for i in range(40)], "interval_id long, chrom string, st long, en long")
    chosen, _ = background.random_background(targets, contigs, ratio=10.0, bins=1)
    by = {x.chrom: x[1] for x in chosen.groupBy("chrom").count().collect()}
    assert abs(by["a"] - by["b"]) < 0.25 * (by["a"] + by["b"])  # lengths are as 1 to 30


def test_background_without_room(spark):
    contigs = spark.createDataFrame([("c", "ACGT" * 30, 120)], "chrom string, seq string, size long")
    schema = "interval_id long, chrom string, st long, en long"
    chosen, report = background.random_background(spark.createDataFrame([(1, "c", 1, 120)], schema), contigs)
    assert chosen.count() == 0 and [tuple(x) for x in report.collect()] == [(1, 1, 0)]
    chosen, report = background.random_background(spark.createDataFrame([], schema), contigs)
    assert chosen.count() == 0 and report.count() == 0


def test_alignment_properties():
    r = np.random.default_rng(3)
    for _ in range(20):
        x = r.dirichlet([0.3] * 4, r.integers(4, 12))
        y = r.dirichlet([0.3] * 4, r.integers(4, 12))
        for f in (align.align_local, align.align_global):
            a, b = f(x, y)
            assert a.shape == b.shape and len(a) >= max(len(x), len(y))
        t = align.trim_left(x, both=True)
        if len(t):
            assert align.similarity(t, t) == pytest.approx(1)
            assert align.similarity(t, align.reverse_complement(t)) == pytest.approx(1)
    assert align.merge([x]) is None and align.merge([x, x]) == pytest.approx(align.trim_left(x))


def test_alignment_of_batches_equals_that_of_pairs():
    r = np.random.default_rng(11)
    pairs = [(r.dirichlet([0.3] * 4, r.integers(1, 14)), r.dirichlet([0.3] * 4, r.integers(1, 14))) for _ in range(align.BATCH + 40)]
    for a, _ in pairs[::7]:
        a[len(a) // 2] = 0.25  # a column that correlates with none
    pairs.append((np.full((3, 4), 0.25), pairs[0][1]))
    for mode, one in (("local", align.align_local), ("global", align.align_global)):
        for (a, b), got in zip(pairs, align.align_many(pairs, mode), strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(one(a, b), got, strict=True))
    assert np.array_equal(align.similarities(pairs), [align.similarity(a, b) for a, b in pairs], equal_nan=True)
    assert align.align_many([]) == [] and align.similarities([]) == []


def test_complete_linkage():
    r = np.random.default_rng(4)
    n = 30
    d = r.random((n, n))
    d = (d + d.T) / 2
    merges = cluster.complete_linkage(n, [(i, j, d[i, j]) for i in range(n) for j in range(i + 1, n)])
    groups = {i: [i] for i in range(n)}
    last = 0.0
    for k, (a, b, height, size) in enumerate(merges):
        x, y = groups.pop(a), groups.pop(b)
        assert height == max(d[i, j] for i in x for j in y) >= last and size == len(x) + len(y)
        assert all(height <= max(d[i, j] for i in p for j in q) for p in groups.values() for q in groups.values() if p is not q)
        groups[n + k], last = x + y, height
    assert sorted(cluster.leaf_order(n, merges)) == list(range(n))


@pytest.mark.parametrize("kind", ["distinct", "ties", "sparse", "empty"])
def test_linkage_by_rounds_equals_one_pair_at_a_time(spark, kind):
    r = np.random.default_rng(8)
    n = 0 if kind == "empty" else 9
    edges = [(3 * i + 1, 3 * j + 1, round(float(r.random()), 1 if kind == "ties" else 6), 1, 1) for i in range(n) for j in range(i + 1, n) if kind != "sparse" or r.random() < 0.6]
    frame = spark.createDataFrame(edges, "i int, j int, d double, n_i long, n_j long")
    # one pair at a time by plain sets; clusters without an edge between two of their members stay apart
    d = {(i, j): x for i, j, x, *_ in edges}
    far = lambda a, b: max(d.get((min(x, y), max(x, y)), math.inf) for x in a for y in b)
    groups, want = [{3 * i + 1} for i in range(n)], []
    while len(groups) > 1:
        height, _, _, a, b = min((far(a, b), min(a), min(b), a, b) for a in groups for b in groups if min(a) < min(b))
        if height == math.inf:
            break
        want.append((min(a), min(b), height, len(a | b)))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    for local in (0, 8, 1000):
        got = cluster.merges(frame, local).select("lo", "hi", "height", "size").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_cut_and_clades_without_pairs(spark):
    motifs = spark.createDataFrame([(7,), (2,), (4,)], "motif_idx int")
    pairs = spark.createDataFrame([(2, 4, -0.9), (4, 2, -0.9), (2, 7, None)], "i int, j int, r double")
    assert sorted(map(tuple, cluster.cut(pairs, motifs, 0.8).collect())) == [(2, 0), (4, 0), (7, 1)]
    assert sorted(map(tuple, cluster.cut(pairs.limit(0), motifs, 0.8).collect())) == [(2, 0), (4, 1), (7, 2)]
    assert sorted((x.motif_idx, x.clade) for x in cluster.clades(pairs, motifs, 0.5).collect()) == [(2, 1), (4, 1), (7, None)]
    assert cluster.linkage(pairs.limit(0), motifs).count() == 0
    assert sorted(map(tuple, cluster.leaf_places(cluster.linkage(pairs.limit(0), motifs), 3).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_motif_list_is_written_in_order(spark, tmp_path):
    motifs = spark.createDataFrame([(0, "b", "M0"), (1, "c", "M1"), (2, "a", "M2"), (3, "B", "M3")], "motif_idx int, name string, matrix_id string")
    clusters = spark.createDataFrame([(0, 5), (1, 4), (2, 3), (3, 5)], "motif_idx int, cluster_id int")
    metadata = spark.createDataFrame([("b", "G1", "ETS"), ("B", "G0", "ETS"), ("a", "G2", "Homeo")], "name string, gene string, family string")
    listed = cluster.motif_list(clusters, motifs, metadata)
    want = [(0, "ETS_1_merged", "M0|M3", "G0_G1", "ETS"), (1, "a", "a", "G2", "Homeo"), (2, "c", "c", "Unknown", "Unknown")]
    assert sorted(map(tuple, listed.collect())) == want
    assert sorted(map(tuple, cluster.list_lines(listed).collect())) == [(1, "ETS_1_merged"), (2, "a"), (3, "c")]
    writers.write_motif_list(listed, f"file://{tmp_path}/out")
    back = lambda part: [x for f in sorted((tmp_path / "out" / part).glob("part-*")) for x in f.read_text().splitlines()]
    assert back("list") == ["\t".join(x[1:3]) for x in want]
    assert [x for x in back("metadata") if x != "Name\tGene\tFamily"] == ["\t".join((x[1], x[3], x[4])) for x in want]
    assert cluster.motif_list(clusters.limit(0), motifs.limit(0), metadata).count() == 0


def test_sparse_model_meets_its_optimality_conditions():
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 6))
    y = (x[:, 0] - 2 * x[:, 1] + r.normal(size=200) > 0.3).astype(int)
    w = learn.fit_l1(x, y, tol=1e-10, rounds=20_000)
    a = np.column_stack([x, np.ones(200)])
    g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y)
    assert np.abs(g[w == 0]).max(initial=0) <= 1 + 1e-4
    assert g[w != 0] == pytest.approx(-np.sign(w[w != 0]), abs=1e-4)


def test_distributed_model_equals_the_local_one(spark):
    sf = "/root/testdata/sf0.01"
    rows = fx.features(spark, sf)
    data = rows.orderBy("key").collect()
    w = learn.fit_l1(np.array([x.x for x in data]), np.array([x.label for x in data]), tol=1e-10, rounds=20_000)
    coefficients, intercept = learn.fit_l1_distributed(rows)
    assert np.array([*coefficients, intercept]) == pytest.approx(w, abs=1e-6)


def _toy(spark, n=240, k=5, seed=11):
    """A table with a constant feature, a null row and two that are alike."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k)) * [1, 3, 0.2, 1, 10] + [0, 5, 0, 0, -3]
    x[:, 3] = 2.0
    y = (x[:, 0] + 0.3 * x[:, 1] - 1.5 + r.logistic(size=n) > 0).astype(int)
    rows = [(i, int(b), list(map(float, a))) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame([*rows, (n, 1, None)], "key long, label int, x array<double>").repartition(3)


def _trained(df, fraction, seed, i):
    last = learn.split_cuts(df, fraction, seed, [i])[i]
    rows = df.where("x IS NOT NULL").select("key", (learn._split_number("key", seed, i) > last).alias("t")).collect()
    return np.array([t for _, t in sorted(map(tuple, rows))])


@pytest.mark.parametrize("scale", [False, True])
def test_hold_out_equals_plain_fits(spark, scale):
    x, y, df = _toy(spark)
    got = {(r.iteration, r.motif): r for r in learn.train_classifier(df, list("abcde"), iterations=3, test_size=0.4, seed=7, scale=scale).collect()}
    assert len(got) == 15
    for i in range(3):
        t = _trained(df, 0.4, 7, i)
        assert (~t).sum() in (96, 97)  # the row without features may be one of the 97 tested
        unit = np.where(x[t].std(axis=0) > 1e-9, x[t].std(axis=0), 1)
        z = (x - x[t].mean(axis=0)) / unit if scale else x
        w = learn.fit_l1(z[t], y[t], tol=1e-12, rounds=200_000)
        p = learn.predict(z[~t], w)
        for j, name in enumerate("abcde"):
            r = got[i, name]
            assert r.coefficient == pytest.approx(w[j], abs=1e-6)
            assert (r.roc_auc, r.precision) == pytest.approx((learn.auc_of(y[~t], p), learn.precision_of(y[~t], p)), abs=1e-9)


def test_leave_one_out_equals_plain_fits(spark):
    x, y, df = _toy(spark, seed=12)
    got = {(r.iteration, r.motif): r for r in learn.feature_significance(df, list("abcde"), iterations=2, seed=3).collect()}
    for i in range(2):
        t = _trained(df, 0.2, 3, i)
        scaled = lambda base: (x - base.mean(axis=0)) / np.where(base.std(axis=0) > 1e-9, base.std(axis=0), 1)
        z, all_z = scaled(x[t]), scaled(x)
        likelihood = lambda w, a: float(np.log(np.where(y == 1, learn.predict(a, w), 1 - learn.predict(a, w))).sum())
        full = learn.fit_l1(z[t], y[t], tol=1e-12, rounds=200_000)
        for j, name in enumerate("abcde"):
            rest = [c for c in range(5) if c != j]
            w = learn.fit_l1(z[t][:, rest], y[t], tol=1e-12, rounds=200_000)
            want = -2 * (likelihood(w, all_z[:, rest]) - likelihood(full, all_z)) if full[j] else 0.0
            assert got[i, name].statistic == pytest.approx(want, abs=1e-4)
            assert got[i, name].p_value == pytest.approx(learn.chi2_survival(got[i, name].statistic), abs=1e-12)


def test_collinearity_equals_plain_regressions(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 6)) @ r.normal(size=(6, 6)) + 4
    got = {v.motif: v.vif for v in learn.variance_inflation(spark.createDataFrame([(list(map(float, a)),) for a in x], "x array<double>").repartition(3), list("abcdef"), limit=1e9).collect()}
    for j, name in enumerate("abcdef"):
        rest = np.column_stack([np.delete(x, j, axis=1), np.ones(300)])
        error = x[:, j] - rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
        assert got[name] == pytest.approx(x[:, j].var() / error.var(), rel=1e-6)


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7, 20, 64, 10**6])
def test_fasta_by_byte_ranges(spark, tmp_path, range_bytes):
    """Headers and lines cut at any byte, records without letters, text before a header, no last newline."""
    texts = {"a.fa": ">one two > three\nACGT\nAC\n\nGT\n>empty\n>last é\n" + "ACGTT\n" * 9 + "GG", "b.fa": ">x\r\nAC GT\r\n>y\r\n", "c.fa": ""}
    if range_bytes >= 7:
        texts["d.fa"] = "stray\n>z\nTT\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = []
    for name, text in texts.items():
        for i, record in enumerate(text.replace("\r", "").split("\n>" if not text.startswith(">") else ">")[1:] if name != "a.fa" else ["one two > three\nACGT\nAC\n\nGT\n", "empty\n", "last é\n" + "ACGTT\n" * 9 + "GG"]):
            head, _, body = record.partition("\n")
            want.append((name, i + 1, head.split()[0], "".join(body.split())))
    got = fasta_source.read_records(spark, str(tmp_path), range_bytes)
    assert sorted((x.file.rsplit("/", 1)[-1], x.record_no, x.seq_id, x.seq) for x in got.collect()) == sorted(want)
    if range_bytes == 7:
        tasks = fasta_source.read_stretches(spark, f"file://{tmp_path}/a.fa", 7).select("range_no").distinct().count()
        assert tasks > 5


@pytest.mark.parametrize(("range_bytes", "size", "overlap"), [(5, 4, 0), (17, 10, 6), (64, 7, 30), (10**6, 50, 10)])
def test_genome_chunks_equal_the_whole_file_reader(spark, tmp_path, range_bytes, size, overlap):
    r = random.Random(size)
    for name, n in (("chr1", 203), ("chr2", 40), ("chr3", 1)):
        seq = "".join(r.choice("acgtN") for _ in range(n))
        (tmp_path / f"{name}.fa").write_text(f">{name} some words\n" + "\n".join(seq[i : i + 9] for i in range(0, n, 9)) + "\n")
    want = intervals.chunk_contigs(readers.read_genome(spark, str(tmp_path)), size, overlap).collect()
    got = fasta_source.read_genome_chunks(spark, str(tmp_path), size, overlap, range_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_planted_feature_is_found(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3))
    y = (x[:, 1] * 3 + r.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, int(b), list(map(float, a))) for i, (a, b) in enumerate(zip(x, y, strict=True))], "key long, label int, x array<double>")
    rows = learn.train_classifier(df, ["a", "b", "c"], iterations=2, test_size=0.5).collect()
    assert all(x.roc_auc > 0.85 and x.coefficient > 0 for x in rows if x.motif == "b")
    found = {(x.iteration, x.motif): x.p_value for x in learn.feature_significance(df, ["a", "b", "c"], iterations=2).collect()}
    assert len(found) == 6 and all(found[i, "b"] < 1e-4 < found[i, "a"] for i in range(2))


def test_metrics(spark):
    y, p = np.array([1, 0, 1, 0, 1]), np.array([0.9, 0.9, 0.4, 0.4, 0.1])
    assert learn.auc_of(y, p) == pytest.approx(2.0 / 6 + 0.0) or learn.auc_of(y, p) == pytest.approx((0.5 + 1 + 0 + 0.5) / 6)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, score double")
    assert learn.roc_auc(df).first()[0] == pytest.approx(learn.auc_of(y, p))
    assert learn.average_precision(df).first()[0] == pytest.approx(learn.precision_of(y, p))
    assert spark.createDataFrame([(1, 0.0)], "y int, p double").select(learn.log_likelihood(F.col("y"), F.col("p"))).first()[0] == -math.inf
    assert learn.chi2_survival(-1) == 1 and learn.chi2_survival(3.841458820694124) == pytest.approx(0.05)


def test_collinearity_limits(spark):
    rows = [(i, [float(i), 2.0 * i + 1, 5.0, float(i * i % 7)]) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, x array<double>")
    got = {x.motif: x.vif for x in learn.variance_inflation(df, ["a", "b", "c", "d"]).collect()}
    assert got["a"] == got["b"] == got["c"] == 100 and 1 <= got["d"] < 2


def test_missing_genes(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "motif string, value double")
    facts = spark.createDataFrame([("x", "G", "F")], "name string, gene string, family string")
    assert {x.motif: x.genes for x in learn.annotate_genes(rows, facts, on_missing="unknown").collect()} == {"x": "G", "y": "Unknown"}
    with pytest.raises(Exception, match="no gene"):
        learn.annotate_genes(rows, facts).collect()


def test_readers_and_writers_round_trip(spark, tmp_path):
    (tmp_path / "p.bed").write_text("#track\nchr1\t5\t9\textra\nchr2 7 8\n\n")
    assert [tuple(x)[1:] for x in readers.read_bed(spark, str(tmp_path / "p.bed")).collect()] == [("chr1", 5, 9), ("chr2", 7, 8)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/chr1.fa").write_text(">chr1 x\nacgt\nAC\n")
    assert tuple(readers.read_genome(spark, str(tmp_path / "g")).first()) == ("chr1", "ACGTAC", 6)
    (tmp_path / "s.fa").write_text(">a b c\nAC\nGT\n>d\nTT\n")
    assert [(x.seq_id, x.seq) for x in readers.read_fasta(spark, str(tmp_path / "s.fa")).collect()] == [("a", "ACGT"), ("d", "TT")]
    motifs = fx.motifs(spark, SMALL)
    (tmp_path / "m").mkdir()
    texts = motifs.select("motif_idx", writers.jaspar_text(F.col("matrix_id"), F.regexp_replace("name", " .*", ""), F.col("counts")).alias("t")).collect()
    for x in texts:
        (tmp_path / f"m/{x.motif_idx}.motif").write_text(x.t + "\n")
    back = readers.read_jaspar(spark, str(tmp_path / "m")).orderBy("motif_idx").collect()
    assert [x.counts for x in back] == [x.counts for x in motifs.orderBy("motif_idx").collect()]
    (tmp_path / "f.tsv").write_text("\ta\tb.c\ns1\t1.5\t\ns2\t-inf\t2\n".replace("-inf", "-1"))
    assert {(x.seq_id, x.motif, x.score) for x in readers.read_features(spark, str(tmp_path / "f.tsv")).collect()} == {("s1", "a", 1.5), ("s1", "b.c", None), ("s2", "a", -1.0), ("s2", "b.c", 2.0)}
    (tmp_path / "l.txt").write_text("s1\t1\ns2 0\ns3 x\n")
    assert [x.label for x in readers.read_labels(spark, str(tmp_path / "l.txt")).collect()] == [1, 0, 0]
    seqs = spark.createDataFrame([("a:1-5", "ACGT")], "seq_id string, seq string")
    writers.write_fasta(seqs, str(tmp_path / "out"))
    assert readers.read_fasta(spark, str(tmp_path / "out")).select("seq_id", "seq").collect() == seqs.collect()


def test_names(spark):
    got = spark.createDataFrame([("a/b (c)", "dir/x.y.z")], "n string, p string").select(s.safe_name(F.col("n")), s.file_root(F.col("p"))).first()
    assert tuple(got) == ("ab_c_", "x")


# round 3's findings


def test_overlap_counts_read_their_candidates_few_times(spark):
    cands = spark.range(40).select(F.col("id").alias("cand_id"), F.lit("c").alias("chrom"), (F.col("id") * 3).alias("st"), (F.col("id") * 3 + 5).alias("en"))
    targets = spark.createDataFrame([(i, "c", 7 * i + 1, 7 * i + 1 + i % 9) for i in range(12)], "interval_id long, chrom string, st long, en long")
    counts = intervals.overlap_counts(cands, targets)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 40") == 2  # to ask and for the rows; the places are written by then. Before: 11
    spans = [(7 * i, 7 * i + 1 + i % 9) for i in range(12)]
    assert dict(map(tuple, counts.collect())) == {i: sum(a < 3 * i + 5 and b > 3 * i for a, b in spans) for i in range(40)}


def test_motifs_are_counted_within_their_tasks():
    seqs = ["TACGTA", None, "", "T", "ATACACACAC", "GCGCGC", "TA", "AGTCATCA"]
    batches = [pa.RecordBatch.from_pydict({"seq": pa.array([s and s.encode() for s in part], pa.binary())}) for part in (seqs[:3], seqs[3:], [])]
    want = Counter()
    for i, (_, _, anchor, width) in enumerate(fx.ANCHORS):
        for seq in filter(None, seqs):
            for p in range(len(seq)):
                site = seq[p : p + width]
                want.update((i, k, "ACGT".index(b)) for k, b in enumerate(site) if site.startswith(anchor) and len(site) == width)
    (out,) = fx._followers(iter(batches))
    assert {(r["motif_idx"], r["pos"], r["base"]): r["n"] for r in out.to_pylist()} == want


def test_scores_of_a_sequence_are_one_row(spark):
    seqs = fx.sequences(spark, SMALL).repartition(3)
    motifs = with_pssm(fx.motifs(spark, SMALL))
    top = {(r.seq_ordinal, r.motif_idx): r.score for r in scan.scan_top(seqs, motifs).collect()}
    rows = scan.scan_scores(seqs, motifs).collect()
    assert {(r.seq_ordinal, i): v for r in rows for i, v in enumerate(r.x)} == top and len(rows) == seqs.count()


def test_contigs_read_the_texts_once(spark, sf):
    """Intervals over contigs that are at hand read no text again."""
    contigs = fx.contigs(spark, sf)
    for rows in (fx.peaks(spark, sf, contigs), fx.background_intervals(spark, sf, contigs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "documents" not in plan and "seq#" not in plan
    assert sorted(map(tuple, fx.peaks(spark, sf, contigs).collect())) == sorted(map(tuple, fx.peaks(spark, sf).collect()))


def test_cut_from_texts_of_other_letters(spark):
    """Places are letters, not bytes, where a contig holds letters of several bytes."""
    contigs = spark.createDataFrame([("a", "AÄCGTé" * 5, 30), ("b", "ACGTN" * 6, 30)], "chrom string, seq string, size long")
    rows = [(i, c, st, st + 4) for i, (c, st) in enumerate((c, st) for c in "ab" for st in range(1, 32))]
    of = {"a": "AÄCGTé" * 5, "b": "ACGTN" * 6}
    got = {x.interval_id: x.seq for x in intervals.extract_sequences(spark.createDataFrame(rows, "interval_id long, chrom string, st long, en long"), contigs).collect()}
    assert got == {i: of[c][st - 1 : en - 1] for i, c, st, en in rows if of[c][st - 1 : en - 1]}


def test_model_passes_read_packed_rows(spark):
    """Rows are packed once, many to a block, and scores are counted in the task; the sums are those of the rows."""
    r = np.random.default_rng(3)
    x, y, trains = r.normal(size=(500, 3)), r.integers(0, 2, 500), r.random((500, 2)) < 0.5
    rows = spark.createDataFrame([(float(b), a.tolist(), t.tolist()) for a, b, t in zip(x, y, trains, strict=True)], "label double, x array<double>, trains array<boolean>").repartition(3)
    packed = logistic.blocks(rows)
    assert packed.count() == 3
    w, split = r.normal(size=(3, 4)), np.array([1, 0, 1])
    loss, g, h = logistic.loss_and_gradient(packed, w, split, logistic.no_scale(3, 2), True)
    one = np.column_stack([x, np.ones(500)])
    for m, s in enumerate(split):
        a, b = one[trains[:, s]], y[trains[:, s]]
        p = 1 / (1 + np.exp(-a @ w[m]))
        assert np.isclose(loss[m], -np.log(np.where(b == 1, p, 1 - p)).sum()) and np.allclose(g[m], a.T @ (p - b)) and np.allclose(h[m], a.T @ (a * (p * (1 - p))[:, None]))
    counts = {v[0]: (v[1], v[2]) for v in logistic.scored(packed, w[:2]).groupBy("iteration").sum("pos", "neg").collect()}
    assert counts == {i: (y[~trains[:, i]].sum(), (1 - y)[~trains[:, i]].sum()) for i in range(2)}


@pytest.mark.parametrize("name", ["features_wide", "features_union"])
def test_features_learn_and_scan_once(spark, sf, monkeypatch, name):
    calls, learn_motifs = [], fx.motifs
    monkeypatch.setattr(fx, "motifs", lambda *a: calls.append(a) or learn_motifs(*a))
    out = queries.QUERIES[name](spark, sf)
    assert len(calls) == 1 and out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2  # letters, scan
