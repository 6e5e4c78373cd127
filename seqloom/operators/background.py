"""Background regions with the GC content of the targets, drawn from all places that fit.

Contigs are cut into chunks. Running sums of G or C and of N give the content of the stretch at every
place of a chunk, and a running sum over the targets' ends tells whether a target covers any of it: an
end counts in the chunk where it lies, and sums of earlier chunks are passed on, so a target of any
length is two rows. A first pass counts, per bin and contig, the places that fit. A place's key is an
exponential number from a hash, times that count; the places with the least keys of a bin are drawn, so each
contig is equally likely and each place of it too, without replacement. The counts also say below which
key enough places will lie, so a second pass returns little more than what is drawn. A bin that has
fewer places than it needs repeats them in turn; only a bin without any stays short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.cut import written
from seqloom.operators.gc import bin_profile, gc_bins, gc_tolerance, global_rank, mean_length
from seqloom.operators.intervals import chunk_contigs, extract_sequences

#: Contigs are cut into pieces of so many bases before places are taken from them.
CHUNK = 1 << 16
#: Drawn places that a task holds before it hands them on, and one contig's chunk more.
MOST_ROWS = 50_000
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[ord("G"), ord("C")]] = 1
_LETTERS[ord("N")] = 2


def candidates(contigs: DataFrame, n: int, length: int, seed: int, round_no: int) -> DataFrame:
    """`(cand_id, chrom, st, en)`: n stretches [st, en) of `length` bases at hashed places.

    Numbers from a hash stand for a random draw, so any engine and any partitioning draws the same.
    """
    spark = contigs.sparkSession
    numbered = _numbered(contigs.where(F.col("size") > length))
    many = numbered.count()
    if not many:
        return spark.createDataFrame([], "cand_id long, chrom string, st long, en long")
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(round_no)), F.lit(what), F.col("cand_id").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = spark.range(n).withColumnRenamed("id", "cand_id").select("cand_id", F.pmod(draw("contig"), F.lit(many)).alias("no"), draw("start").alias("_at"))
    placed = drawn.join(F.broadcast(numbered) if many <= 100_000 else numbered, "no")
    return placed.select("cand_id", "chrom", F.pmod("_at", F.col("size") - length).alias("st"), (F.pmod("_at", F.col("size") - length) + length).alias("en"))


def _numbered(contigs: DataFrame) -> DataFrame:
    """`(chrom, size, no)` of the contigs in the order of their names; one row each."""
    return contigs.select("chrom", "size").withColumn("no", F.row_number().over(Window.orderBy("chrom")) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser in 64-bit numbers; SQL has the same from shifts, xor and a product."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B & 0xFFFFFFFF
    return (x >> 16) ^ x


def place_hash(places: np.ndarray, contig: int, bin_no: int, seed: int) -> np.ndarray:
    return mixed(places & 0xFFFFFFFF ^ mixed(np.int64((contig * 1009 + bin_no * 31 + seed) & 0xFFFFFFFF)))


def _fitting(length: int, most_n: int, ranges: list[tuple[int, int, int]]):
    """Places of a chunk that fit a bin; `ranges (bin, least, most)` are counts of G and C."""

    def of(seq: str, size: int, offset: int, chunk: int, cover: int, events: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = min(chunk, size - length - offset)
        if n <= 0:
            return
        letters = _LETTERS[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
        sums = lambda x: np.r_[0, np.cumsum(x)]
        gc, ns = sums(letters == 1), sums(letters == 2)
        gc, ns = gc[length + 1 : length + 1 + n] - gc[:n], ns[length + 1 : length + 1 + n] - ns[:n]
        steps = np.zeros(n + 1, np.int64)
        at = events % chunk
        np.add.at(steps, at[at < n], (events // chunk)[at < n])
        free = (cover + np.cumsum(steps[:n]) == 0) & (ns <= most_n)
        for bin_no, least, most in ranges:
            at = np.flatnonzero(free & (gc >= least) & (gc <= most))
            if len(at):
                yield bin_no, at

    return of


def covered_chunks(contigs: DataFrame, targets: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """`(chrom, no, size, chunk, offset, seq, cover, events)` of the contigs longer than `length`.

    A stretch [p, p + length) touches a target [st - 1, en) if st - length <= p < en. cover is the number of
    targets that hold back the places before the chunk and go on into it, events their changes within, each a
    whole number, step * chunk + place.
    """
    numbered = _numbered(contigs.where(F.col("size") > length))
    pieces = chunk_contigs(contigs, chunk, length + 1).join(numbered, "chrom")
    there = targets.where("en > st - 1 AND en > 0").select("chrom", F.greatest(F.col("st") - length, F.lit(0)).alias("a"), F.col("en").alias("b"))
    ends = there.select("chrom", F.col("a").alias("pos"), F.lit(1).alias("step")).unionByName(there.select("chrom", F.col("b").alias("pos"), F.lit(-1).alias("step")))
    steps = ends.groupBy("chrom", "pos").agg(F.sum("step").alias("step")).where("step <> 0")
    steps = steps.select("chrom", F.expr(f"pos div {chunk}").alias("chunk"), F.expr(f"CAST(pos % {chunk} AS INT)").alias("at"), "step")
    held = steps.groupBy("chrom", "chunk").agg(F.sum("step").alias("net"), F.collect_list(F.expr(f"step * {chunk} + at")).alias("events"))  # distinct places
    known = pieces.select("chrom", "chunk").join(held.select("chrom", "chunk", "net"), ["chrom", "chunk"], "left")
    before = Window.partitionBy("chrom").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    cover = known.select("chrom", "chunk", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("cover"))
    return pieces.join(cover, ["chrom", "chunk"]).join(held.select("chrom", "chunk", "events"), ["chrom", "chunk"], "left").select("chrom", "no", "size", "chunk", "offset", "seq", "cover", "events")


def _fits(batch: pa.RecordBatch, fitting, chunk: int) -> Iterator[tuple[int, str, int, int, np.ndarray]]:
    """`(row, seq, offset, bin, places)` of the pieces in a batch."""
    numbers = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("size", "offset", "cover"))
    events = batch.column("events")
    changes = events.flatten().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(events.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].tolist()
    for i, (seq, size, offset, cover) in enumerate(zip(batch.column("seq").to_pylist(), *numbers, strict=True)):
        for b, at in fitting(seq, size, offset, chunk, cover, changes[ends[i] : ends[i + 1]]):
            yield i, seq, offset, b, at


def _counted(fitting, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, b, len(at)) for i, _, _, b, at in _fits(batch, fitting, chunk)]
            rows, bins, fits = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(rows)), pa.array(bins.astype(np.int32)), pa.array(fits)], ["chrom", "bin", "fits"])

    return run


def _drawn(fitting, chunk: int, length: int, seed: int, cuts: dict[int, float]):
    def rows(batch: pa.RecordBatch, numbers: np.ndarray, parts: list, seqs: list[str]) -> pa.RecordBatch:
        row, bins, keys, places = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns = [pa.array(bins.astype(np.int32)), pa.array(keys), pa.array(numbers[row]), batch.column("chrom").take(pa.array(row)), pa.array(places), pa.array(seqs, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["bin", "key", "no", "chrom", "st", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("no").to_numpy(zero_copy_only=False).astype(np.int64)
            counts = [{x["bin"]: x["fits"] for x in c} for c in batch.column("counts").to_pylist()]
            parts, seqs = [], []
            for i, seq, offset, b, at in _fits(batch, fitting, chunk):
                n = counts[i][b]
                hashes = place_hash(at + offset, int(numbers[i]), b, seed)
                # only keys of hashes that may lie below the cut are worked out
                some = hashes >= 4294967296.0 * math.exp(-cuts[b] / n) - 2
                at, keys = at[some], -np.log((hashes[some] + 0.5) / 4294967296.0) * n
                at, keys = at[keys <= cuts[b]], keys[keys <= cuts[b]]
                parts.append((np.full(len(at), i), np.full(len(at), b), keys, at + offset))
                seqs += [seq[p : p + length + 1] for p in at.tolist()]
                if len(seqs) >= MOST_ROWS:
                    yield rows(batch, numbers, parts, seqs)
                    parts, seqs = [], []
            if parts:
                yield rows(batch, numbers, parts, seqs)

    return run


def _cuts(counts: DataFrame, need: dict[int, int]) -> dict[int, float]:
    """Per bin a key below which more places than it needs are expected, by six deviations; infinity where all are needed.

    A contig with n places has n * (1 - exp(-c / n)) keys below c on average.
    """
    tries = 48
    below = lambda c: F.sum(F.col("fits") * (1 - F.exp(-F.lit(c) / F.col("fits"))))
    rows = counts.groupBy("bin").agg(*(below(2.0**i / 16).alias(f"e{i}") for i in range(tries))).collect()  # a row per bin
    out = {}
    for r in rows:
        wanted = need[r["bin"]] + 6 * math.sqrt(need[r["bin"]]) + 20
        out[r["bin"]] = next((2.0**i / 16 for i in range(tries) if r[f"e{i}"] >= wanted), math.inf)
    return out


def random_background(
    targets: DataFrame,
    contigs: DataFrame,
    *,
    ratio: float = 1.0,
    bins: int = 10,
    n_share: float = 0.5,
    seed: int = 0,
    chunk: int = CHUNK,
    seqs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Background `(bin, cand_id, chrom, st, en, seq)` and the shortfall `(bin, need, found)` for targets `(interval_id, chrom, st, en)`.

    Each bin needs `ratio` times its targets, rounded up. A stretch [st, en) has the targets' mean length,
    touches no target and fits a bin if its GC is within the tolerance of the bin's; seq is one base longer, and
    its G, C and N count. No targets, or no contig longer than they are, give no background. seqs: what
    `extract_sequences` gives for the targets, where it has been written already.
    """
    spark = contigs.sparkSession
    seqs = written(extract_sequences(targets, contigs).select("interval_id", "seq")) if seqs is None else seqs
    profile = {r["bin"]: (r["n"], r["bin_gc"]) for r in bin_profile(gc_bins(seqs, bins)).collect()}  # one row per bin
    length = mean_length(seqs).first()[0] or 0
    tolerance = gc_tolerance(seqs, bins).first()["tolerance"] or 0.0
    need = {b: math.ceil(n * ratio) for b, (n, _) in profile.items()}
    shape = "bin int, cand_id long, chrom string, st long, en long, seq string"
    report = lambda found: spark.createDataFrame([(b, n, found.get(b, 0)) for b, n in sorted(need.items())], "bin int, need long, found long")
    # which counts of G and C a bin allows: whole numbers, so that any engine agrees
    gc = F.round(F.col("id") / F.lit(max(length, 1)), 6)
    allowed = F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(mid).alias("mid")) for b, (_, mid) in sorted(profile.items())))
    counts = spark.range(length + 2).select("id", F.explode(F.filter(allowed, lambda b: F.abs(gc - b["mid"]) <= tolerance)).alias("b")) if need else None
    ranges = [tuple(r) for r in counts.groupBy("b.bin").agg(F.min("id"), F.max("id")).collect()] if need else []  # one row per bin
    if not ranges:
        return spark.createDataFrame([], shape), report({})

    fitting = _fitting(length, int(n_share * length), sorted(ranges))
    pieces = written(covered_chunks(contigs, targets, length, chunk))
    fits = written(pieces.mapInArrow(_counted(fitting, chunk), "chrom string, bin int, fits long").groupBy("chrom", "bin").agg(F.sum("fits").alias("fits")))
    cuts = _cuts(fits, need)
    all_fits = {r["bin"]: r["n"] for r in fits.groupBy("bin").agg(F.sum("fits").alias("n")).collect()}
    keyed = pieces.join(fits.groupBy("chrom").agg(F.collect_list(F.struct("bin", "fits")).alias("counts")), "chrom")
    while True:
        rows = written(keyed.mapInArrow(_drawn(fitting, chunk, length, seed, cuts), "bin int, key double, no long, chrom string, st long, seq string"))
        got = {r["bin"]: r["count"] for r in rows.groupBy("bin").count().collect()}
        short = [b for b, n in all_fits.items() if got.get(b, 0) < min(n, need[b])]
        if not short:
            break
        cuts |= {b: cuts[b] * 2 for b in short}  # never seen: beyond six deviations
    ranked = global_rank(rows, ["bin", "key", "no", "st"])
    before, numbered, first = 0, 0, {}
    for b in sorted(got):
        first[b] = (before, numbered, got[b], need[b])
        before, numbered = before + got[b], numbered + need[b]
    part = lambda i: F.create_map(*(F.lit(x) for b, v in first.items() for x in (b, v[i])))[F.col("bin")]
    place = F.col("_rank") - 1 - part(0)
    times = F.when(place < part(3), F.expr("sequence(0L, (_need - 1 - _place) div _found)"))
    drawn = ranked.withColumn("_place", place).withColumn("_found", part(2)).withColumn("_need", part(3)).withColumn("_turn", F.explode(times))
    chosen = drawn.select("bin", (part(1) + F.col("_place") + F.col("_turn") * F.col("_found")).alias("cand_id"), "chrom", "st", (F.col("st") + length).alias("en"), "seq")
    return chosen, report({b: need[b] for b in got})


def background_ids(chosen: DataFrame, seed: int = 0) -> DataFrame:
    """Adds `seq_id`, `bg_<r>_<n>`: a hashed number below 100,000 and the place in the list, which makes it unique."""
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cand_id").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(100_000))
    return chosen.withColumn("seq_id", F.concat(F.lit("bg_"), drawn.cast("string"), F.lit("_"), F.col("cand_id").cast("string")))
