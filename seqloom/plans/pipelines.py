"""From peaks to models: sequences, background, features, classifier and significance in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.matrix import log_odds, normalize_columns, pseudocount
from seqloom.operators.background import random_background
from seqloom.operators.cut import written
from seqloom.operators.intervals import extract_sequences
from seqloom.operators.learn import feature_significance, train_classifier
from seqloom.operators.scan import scan_scores


def with_pssm(motifs: DataFrame, argument: float = 0.01) -> DataFrame:
    """Adds `pwm` (no pseudocount) and `pssm` (with it)."""
    return motifs.withColumn("pwm", normalize_columns(F.col("counts"))).withColumn("pssm", log_odds(normalize_columns(F.col("counts"), pseudocount(F.col("counts"), argument))))


def create_features(positive: DataFrame, negative: DataFrame, motifs: DataFrame, argument: float = 0.01) -> DataFrame:
    """`(key, label, x)`: best scores of all motifs, in index order, of sequences `(seq_ordinal, seq)` of both labels.

    A motif that is longer than the sequence scores 0.
    """
    both = positive.select("seq_ordinal", "seq", F.lit(1).alias("label")).unionByName(negative.select("seq_ordinal", "seq", F.lit(0).alias("label")))
    keyed = both.withColumn("key", F.col("seq_ordinal") * 2 + F.col("label"))
    scored = scan_scores(keyed.select(F.col("key").alias("seq_ordinal"), "seq"), with_pssm(motifs, argument))
    x = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    return scored.select(F.col("seq_ordinal").alias("key"), F.pmod("seq_ordinal", F.lit(2)).cast("int").alias("label"), x.alias("x"))


def _models(features: DataFrame, motifs: DataFrame, significance: bool, iterations: int, test_size: float, seed: int) -> dict[str, DataFrame]:
    names = [r[0] for r in motifs.select("name").orderBy("motif_idx").collect()]
    features = written(features)
    out = {"features": features, "coefficients": train_classifier(features, names, iterations=iterations, test_size=test_size, seed=seed)}
    if significance:
        out["significance"] = feature_significance(features, names, iterations=iterations, seed=seed)
    return out


def peaks_vs_background(
    peaks: DataFrame, contigs: DataFrame, motifs: DataFrame, *, significance: bool = False, iterations: int = 5, test_size: float = 0.8, seed: int = 0, **sampling
) -> dict[str, DataFrame]:
    """Peaks against sampled background: `features`, `coefficients` (with performance), and `significance` if asked for.

    The plan is lazy; `explain()` of the parts is the dry run.
    """
    seqs = written(extract_sequences(peaks, contigs).select("interval_id", "seq"))
    positive = seqs.select(F.col("interval_id").alias("seq_ordinal"), "seq")
    background, report = random_background(peaks, contigs, seed=seed, seqs=seqs, **sampling)
    out = _models(create_features(positive, background.select(F.col("cand_id").alias("seq_ordinal"), "seq"), motifs), motifs, significance, iterations, test_size, seed)
    return out | {"background": background, "shortfall": report}


def peaks_vs_peaks(
    first: DataFrame, second: DataFrame, contigs: DataFrame, motifs: DataFrame, *, significance: bool = True, iterations: int = 5, test_size: float = 0.8, seed: int = 0
) -> dict[str, DataFrame]:
    """Two sets of peaks against each other, the first labelled 1."""
    sides = [extract_sequences(p, contigs).select(F.col("interval_id").alias("seq_ordinal"), "seq") for p in (first, second)]
    return _models(create_features(*sides, motifs), motifs, significance, iterations, test_size, seed)
