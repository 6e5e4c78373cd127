"""Motif scan: the best match of every motif in every sequence, over positions and both strands.

Motif matrices are few and narrow and go to the executors by broadcast; sequences stay where they
are. An Arrow batch of sequences is one array of base codes, and each matrix passes over it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most cells (motifs x positions x 4) that are collected and broadcast.
MAX_CELLS = 4_000_000
DECIMALS = 6


def collect_matrices(motifs: DataFrame, column: str = "pssm") -> list[tuple[int, np.ndarray]]:
    """`(motif_idx, W x 4 array)` of each motif, in index order; refuses libraries too large to broadcast."""
    cells = motifs.agg(F.sum(F.size(column) * 4)).first()[0] or 0
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} motif cells; at most {MAX_CELLS} are broadcast, scan the library in parts")
    rows = motifs.select("motif_idx", column).orderBy("motif_idx").collect()
    return [(r[0], np.array([[float("-inf") if x is None else x for x in col] for col in r[1]], float).reshape(-1, 4)) for r in rows]


_CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _CODES[_b + 32] = _i


#: So many letters of a window are looked up at once.
SPELT = 8
#: Letters of the sequences that are scanned together; longer ones go alone.
LETTERS = 1 << 18


def _parts(seqs: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last sequence of each part of a batch, codes of its sequences with a separator after each, their starts and lengths."""
    data = [(s or "").encode("ascii", "replace") for s in seqs]
    lengths = np.array([len(x) for x in data], np.int64)
    part = np.cumsum(lengths + 1) // LETTERS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(data)] if data else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        codes = _CODES[np.frombuffer(b".".join(data[a:b]) + b".", np.uint8)]
        yield a, b, codes, np.r_[0, np.cumsum(lengths[a:b] + 1)][:-1], lengths[a:b]


def _spelt(codes: np.ndarray, widths: set[int]) -> dict[int, np.ndarray]:
    """Per width up to `SPELT` that the motifs need, the number that the letters from each place on spell; `4 ** width` where one isn't A, C, G or T."""
    widths, out = {min(w, SPELT) for w in widths}, {}
    numbers, odd = np.zeros(len(codes), np.int32), np.zeros(len(codes), bool)
    for k in range(max(widths, default=-1) + 1):
        if k in widths:
            out[k] = np.where(odd, np.int32(4**k), numbers)
        n = max(0, len(codes) - k)
        numbers[:n] = numbers[:n] * 4 + codes[k:]
        odd[:n] |= codes[k:] == 4
        odd[n:] = True
    return out


def window_scores(codes: np.ndarray, matrix: np.ndarray, spelt: dict[int, np.ndarray] | None = None, decimals: int | None = None) -> np.ndarray:
    """Sum of log-odds of the window at each place, rounded if asked for; one with another letter, or that the end cuts, scores minus infinity."""
    width = len(matrix)
    first = min(width, SPELT)
    table = np.zeros(1)
    for row in matrix[:first]:  # letter by letter, so sums are added up in the order of places
        table = (table[:, None] + row).ravel()
    if decimals is not None and width == first:
        table = np.round(table, decimals)
    out = np.append(table, -np.inf)[(spelt or _spelt(codes, {width}))[first]]
    for k in range(first, width):
        n = max(0, len(codes) - k)
        out[:n] += np.append(matrix[k], -np.inf)[codes[k:]]
        out[n:] = -np.inf
    return out if decimals is None or width == first else np.round(out, decimals)


def _best(scores: tuple[np.ndarray, np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sequence the best score over both strands, its first place and whether it is the forward one's, which has to be better."""
    forward, backward = (np.maximum.reduceat(x, starts) for x in scores)
    plus = forward > backward
    best = np.where(plus, forward, backward)
    whole = lambda x: np.repeat(x, lengths + 1)
    top = np.flatnonzero(np.where(whole(plus), *scores) == whole(best))
    at = np.append(top, 0)[np.searchsorted(top, starts)] - starts
    return best, at, plus


def _matches(matrices: list[tuple[int, np.ndarray]], seqs: list[str | None], ambiguous: str, decimals: int) -> Iterator[tuple[int, int, int, tuple[np.ndarray, ...]]]:
    """Per part of a batch and motif: first and last sequence, motif, and the matches' scores, places, strands and whether the sequence is too short."""
    for a, b, codes, starts, lengths in _parts(seqs):
        bad = np.zeros(len(lengths), bool)
        if ambiguous == "poison":
            odd = np.add.reduceat((codes == 4).astype(np.int64), starts)
            bad = odd > 1  # its separator is one
        spelt = _spelt(codes, {len(m) for _, m in matrices})
        for index, matrix in matrices:
            best, at, plus = _best(tuple(window_scores(codes, m, spelt, decimals) for m in (matrix, matrix[::-1, ::-1])), starts, lengths)
            use = ~bad & (best > 0)
            yield a, b, index, (np.where(use, best, 0.0), np.where(use, at, -1).astype(np.int32), np.where(use, np.where(plus, "+", "-"), "?"), lengths < len(matrix))


def scan_top(seqs: DataFrame, motifs: DataFrame, *, ambiguous: str = "poison", decimals: int = DECIMALS, column: str = "pssm") -> DataFrame:
    """`(seq_ordinal, motif_idx, score, start, strand)`: best match of each motif in each sequence.

    Scores are rounded before they are compared. The forward strand wins only if it is strictly
    better; of equal places the first wins; without a score above 0 the match is (0, -1, '?'). With
    ambiguous="poison" a letter other than A, C, G and T spoils its sequence for every motif; with
    "skip" only the windows that hold it. A sequence shorter than the motif has a null score.
    """
    matrices = seqs.sparkSession.sparkContext.broadcast(collect_matrices(motifs, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_ordinal")
            for a, b, index, (score, start, strand, short) in _matches(matrices.value, batch.column("seq").to_pylist(), ambiguous, decimals):
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b],
                        pa.array(np.full(b - a, index, np.int32)),
                        pa.array(score, pa.float64(), mask=short),
                        pa.array(start, mask=short),
                        pa.array(strand.astype(object), pa.string(), mask=short),
                    ],
                    ["seq_ordinal", "motif_idx", "score", "start", "strand"],
                )

    return seqs.select(F.col("seq_ordinal").cast("long"), "seq").mapInArrow(run, "seq_ordinal long, motif_idx int, score double, start int, strand string")


def scan_scores(seqs: DataFrame, motifs: DataFrame, *, ambiguous: str = "poison", decimals: int = DECIMALS, column: str = "pssm") -> DataFrame:
    """`(seq_ordinal, x array<double>)`: the scores of `scan_top`, all motifs of a sequence in one row, in index order."""
    matrices = seqs.sparkSession.sparkContext.broadcast(collect_matrices(motifs, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(matrices.value)
            x, odd = np.zeros((batch.num_rows, k)), np.zeros((batch.num_rows, k), bool)
            found = _matches(matrices.value, batch.column("seq").to_pylist(), ambiguous, decimals)
            for i, (a, b, _, (score, _, _, short)) in enumerate(found):  # the motifs of each part in turn
                x[a:b, i % k], odd[a:b, i % k] = score, short
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), pa.array(x.ravel(), mask=odd.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("seq_ordinal"), lists], ["seq_ordinal", "x"])

    return seqs.select(F.col("seq_ordinal").cast("long"), "seq").mapInArrow(run, "seq_ordinal long, x array<double>")


def scan_tracks(seqs: DataFrame, motifs: DataFrame, *, decimals: int = DECIMALS, column: str = "pssm") -> DataFrame:
    """`(seq_ordinal, motif_idx, strand, scores array<double>)`: the score of every window on both strands.

    Windows with other letters than A, C, G and T have null scores; shorter sequences have empty arrays.
    """
    matrices = seqs.sparkSession.sparkContext.broadcast(collect_matrices(motifs, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_ordinal")
            for a, b, codes, starts, lengths in _parts(batch.column("seq").to_pylist()):
                spelt = _spelt(codes, {len(m) for _, m in matrices.value})
                left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(codes))  # letters from each place to its sequence's end
                for index, matrix in matrices.value:
                    counts = np.maximum(0, lengths - len(matrix) + 1)
                    inside = left >= max(len(matrix), 1)
                    odd = window_scores(codes, np.zeros_like(matrix), spelt)[inside] == -np.inf
                    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                    for strand, m in (("+", matrix), ("-", matrix[::-1, ::-1])):
                        lists = pa.ListArray.from_arrays(offsets, pa.array(window_scores(codes, m, spelt, decimals)[inside], pa.float64(), mask=odd))
                        yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(np.full(b - a, index, np.int32)), pa.array([strand] * (b - a)), lists], ["seq_ordinal", "motif_idx", "strand", "scores"])

    return seqs.select(F.col("seq_ordinal").cast("long"), "seq").mapInArrow(run, "seq_ordinal long, motif_idx int, strand string, scores array<double>")


def features_wide(matches: DataFrame, motifs: DataFrame, value: str = "score") -> DataFrame:
    """One column per motif, by name, one row per sequence."""
    names = [r[0] for r in motifs.select("name").orderBy("motif_idx").collect()]  # one row per motif
    named = matches.join(F.broadcast(motifs.select("motif_idx", "name")), "motif_idx")
    return named.groupBy("seq_ordinal").pivot("name", names).agg(F.first(value))


def union_features(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both tables, columns matched by name, missing ones null, with label 1 and 0."""
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)), allowMissingColumns=True)
