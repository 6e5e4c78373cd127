"""Splits, standardisation, sparse logistic models, metrics, significance and collinearity.

Features are long for storage and an array column `x` per row for models; `key` identifies a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import logistic
from seqloom.operators.cut import cut, written
from seqloom.operators.select import nth_smallest


def _split_number(key: str, seed: int, iteration: int) -> Column:
    """60 bits of md5(seed:iteration:key)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(iteration)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def split_cuts(rows: DataFrame, fraction: float, seed: int, iterations: list[int], key: str = "key") -> dict[int, int]:
    """Per iteration the last number that is tested: of ceil(fraction * n) rows, found by counts instead of a sort."""
    return _number_cuts(written(rows.select(*(_split_number(key, seed, i).alias(f"n{i}") for i in iterations))), fraction, iterations)


def _number_cuts(numbered: DataFrame, fraction: float, iterations: list[int]) -> dict[int, int]:
    """The same of numbers `n<iteration>` that have been written, since each of the passes over them would hash again."""
    n_test = math.ceil(fraction * numbered.count() - 1e-9)
    numbers = F.explode(F.array(*(F.struct(F.lit(i).alias("iteration"), F.col(f"n{i}").alias("number")) for i in iterations)))
    found = nth_smallest(numbered.select(numbers.alias("x")).select("x.*"), "iteration", "number", dict.fromkeys(iterations, n_test))
    return {i: found.get(i, -1) for i in iterations}


def train_test_split(rows: DataFrame, fraction: float, seed: int = 0, iteration: int = 0, key: str = "key") -> DataFrame:
    """Adds `is_test`: ceil(fraction * n) rows, those that come first by md5(seed:iteration:key); keys are distinct."""
    last = split_cuts(rows, fraction, seed, [iteration], key)[iteration]
    return rows.withColumn("is_test", _split_number(key, seed, iteration) <= last)


def standardize(features: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Adds `z`: less the mean, over the population deviation; a constant feature becomes 0."""
    stats = features.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    return features.join(stats, by).withColumn("z", (F.col(column) - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)).drop("_mean", "_std")


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row `auc` of `(label, score)`: pairs ranked right, ties half; equal scores are grouped first."""
    groups = scores.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    ranked = _running(groups, ["neg"], [F.col("score").asc()])
    right = F.sum(F.col("pos") * (F.col("_neg") - F.col("neg") / 2))
    return ranked.agg(F.try_divide(right, F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row `average_precision`: precision at each distinct threshold, weighted by the recall gained there."""
    groups = scores.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    ranked = _running(groups, ["pos", "n"], [F.col("score").desc()])
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * F.col("_pos") / F.col("_n")), F.sum("pos")).alias("average_precision"))


def _running(groups: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Adds running sums `_<column>` in `order`: within ranges in parallel, then offsets of one row per range."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(groups.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_o_{c}") for c in columns))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *(F.coalesce(F.sum(f"_o_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns))
    for c in columns:
        ranged = ranged.withColumn(f"_{c}", F.sum(c).over(within))
    out = ranged.join(F.broadcast(sums), "_part")
    for c in columns:
        out = out.withColumn(f"_{c}", F.col(f"_{c}") + F.col(f"_o_{c}"))
    return out


def log_likelihood(label: Column, p: Column) -> Column:
    """Sum of log(p) of the ones and log(1 - p) of the zeros; minus infinity if one of them is 0."""
    hit = F.when(label == 1, p).otherwise(1 - p)
    return F.sum(F.when(hit <= 0, F.lit(float("-inf"))).otherwise(F.log(hit)))


def fit_l1(x: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-8, start: np.ndarray | None = None, rounds: int = 5000) -> np.ndarray:
    """Minimises sum |w| + c * sum log-loss; the last weight is the intercept, penalised like the others.

    Accelerated proximal gradient with restarts; x has no constant column.
    """
    a = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y > 0, 1.0, -1.0)
    step = 1 / max(c * np.linalg.norm(a, 2) ** 2 / 4, 1e-12)
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        g = -c * a.T @ (sign / (1 + np.exp(np.clip(sign * (a @ v), -500, 500))))
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step, 0)
        if (v - new) @ (new - w) > 0:
            t = 1.0
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        change = np.abs(new - w).max()
        w = new
        if change < tol:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


def _packed(rows: DataFrame, trains: Column) -> DataFrame:
    """What a pass reads: `(label, x, trains array<boolean>)`; rows without features or label take no part."""
    return rows.where("x IS NOT NULL AND label IS NOT NULL").select(F.col("label").cast("double").alias("label"), "x", trains.alias("trains"))


def fit_l1_distributed(rows: DataFrame, c: float = 1.0, tol: float = 1e-9) -> tuple[list[float], float]:
    """`fit_l1` over partitioned `rows (x array<double>, label)`: coefficients and intercept."""
    k = rows.select(F.max(F.size("x"))).first()[0] or 0
    data = logistic.blocks(_packed(rows, F.array(F.lit(True)))).persist()
    w, _ = logistic.fit(data, np.zeros(1, int), logistic.no_scale(k, 1), c=c, tol=tol)
    data.unpersist()
    return [float(v) for v in w[0, :-1]], float(w[0, -1])


def _blocks(rows: DataFrame, fraction: float, seed: int, iterations: int) -> DataFrame:
    """`logistic.blocks` of the rows, with whether a row trains, for each iteration."""
    numbered = written(rows.select("label", "x", *(_split_number("key", seed, i).alias(f"n{i}") for i in range(iterations))))
    last = _number_cuts(numbered, fraction, list(range(iterations)))
    return logistic.blocks(_packed(numbered, F.array(*(F.col(f"n{i}") > last[i] for i in range(iterations)))))


def train_classifier(rows: DataFrame, names: list[str], *, iterations: int = 5, test_size: float = 0.8, seed: int = 0, scale: bool = False) -> DataFrame:
    """`(iteration, motif, coefficient, roc_auc, precision)`: repeated hold-out of the sparse model.

    `rows (key, label, x array<double>)`, keys distinct. The models of all iterations are fitted together over
    partitioned rows. Features are used as they are unless `scale`, by the training rows.
    """
    spark, k = rows.sparkSession, len(names)
    data = _blocks(rows, test_size, seed, iterations).persist()
    units = logistic.train_scale(data, k, iterations) if scale else logistic.no_scale(k, iterations)
    w, _ = logistic.fit(data, np.arange(iterations), units)
    raw = units.raw(w, np.arange(iterations))
    quality = _metrics(logistic.scored(data, raw))
    weights = spark.createDataFrame([(i, n, float(w[i, j])) for i in range(iterations) for j, n in enumerate(names)], "iteration int, motif string, coefficient double")
    out = cut(weights.join(F.broadcast(quality), "iteration", "left").select("iteration", "motif", "coefficient", "roc_auc", "precision"))  # a row per iteration
    data.unpersist()
    return out


def _metrics(scores: DataFrame) -> DataFrame:
    """`(iteration, roc_auc, precision)` of `(iteration, score, pos, neg)`, counts of labels, as `roc_auc` and `average_precision` define them; NaN without both labels.

    All iterations are one running sum, from the highest score down; what earlier iterations add is taken off.
    """
    groups = written(scores.groupBy("iteration", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    ranked = _running(groups, ["pos", "neg"], [F.col("iteration"), F.col("score").desc()])
    totals = groups.groupBy("iteration").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    before = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)  # a row per iteration
    totals = totals.select("iteration", "all_pos", "all_neg", *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in ("pos", "neg")))
    rows = ranked.join(F.broadcast(totals), "iteration").withColumn("tp", F.col("_pos") - F.col("off_pos")).withColumn("fp", F.col("_neg") - F.col("off_neg"))
    below = F.col("all_neg") - F.col("fp") + F.col("neg") / 2
    out = rows.groupBy("iteration").agg(
        F.try_divide(F.sum(F.col("pos") * below), F.first("all_pos") * F.first("all_neg")).alias("roc_auc"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("all_pos")).alias("precision")
    )
    return out.select("iteration", *(F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("roc_auc", "precision")))


def auc_of(y: np.ndarray, p: np.ndarray) -> float:
    order = pd.Series(p).rank().to_numpy()
    n, m = (y == 1).sum(), (y == 0).sum()
    return float((order[y == 1].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


def precision_of(y: np.ndarray, p: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.r_[p[1:] < p[:-1], True] if len(p) else np.zeros(0, bool)
    hits = np.cumsum(y)[last]
    n = np.flatnonzero(last) + 1
    return float((np.diff(np.r_[0, hits]) * hits / n).sum() / hits[-1]) if len(hits) and hits[-1] else float("nan")


def chi2_survival(stat: float) -> float:
    """P(chi-square with one degree > stat); 1 for a negative or undefined statistic."""
    return math.erfc(math.sqrt(stat / 2)) if stat > 0 else 1.0


def chi2_survival_column(stat: Column) -> Column:
    """The same over a column, in Arrow batches; equal statistics are computed once."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)  # nulls and NaN get -1
        return pd.Series(np.array([*map(chi2_survival, values), np.nan])[codes], index=s.index).where(codes >= 0)

    return run(stat)


def feature_significance(rows: DataFrame, names: list[str], *, iterations: int = 5, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """`(iteration, motif, statistic, p_value)`: likelihood-ratio test of each feature by leaving it out.

    Fits use training rows standardised by themselves; likelihoods use all rows, standardised by all rows.
    The full models of all iterations are fitted first. Then all reduced models, one per feature whose full
    weight isn't 0, are columns of one weight matrix: each step reads the rows once, whatever the number
    of features. Leaving out a feature of weight 0 changes nothing.
    """
    k = len(names)
    data = _blocks(rows, test_size, seed, iterations).persist()
    units, whole = logistic.train_scale(data, k, iterations), logistic.train_scale(data, k, iterations, everything=True)
    full, curvatures = logistic.fit(data, np.arange(iterations), units, tol=1e-7)
    left_out = [(i, j) for i in range(iterations) for j in range(k) if full[i, j] != 0]
    statistics = np.zeros((iterations, k))
    if left_out:
        split, feature = np.array(left_out).T
        live = np.ones((len(split), k + 1), bool)
        live[np.arange(len(split)), feature] = False
        reduced, _ = logistic.fit(data, split, units, tol=1e-7, start=full[split], live=live, curvatures=curvatures)
        both = logistic.likelihoods(data, np.vstack([full, reduced]), np.r_[np.arange(iterations), split], whole)
        statistics[split, feature] = -2 * (both[iterations:] - both[:iterations][split])
    data.unpersist()
    out = rows.sparkSession.createDataFrame([(i, names[j], float(statistics[i, j])) for i in range(iterations) for j in range(k)], "iteration int, motif string, statistic double")
    return out.withColumn("p_value", chi2_survival_column(F.col("statistic")))


def _second_moments(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariances (k x k) and deviations of `rows (x array<double>)`; only sums of features and of their products, k * (k + 3) / 2 numbers, reach the driver."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(k), np.zeros((k, k))
        for f in frames:
            x = np.array([*map(list, f["x"])], float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [[q[i, j] for i, j in cells]]})

    parts = rows.select("x").where("x IS NOT NULL").mapInPandas(sums, "n long, s array<double>, q array<double>").where("n > 0")
    places = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q"))).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    values = np.array([r.v for r in places]) if places else np.zeros(1 + k + len(cells))
    n, s = max(values[0], 1), values[1 : k + 1]
    q = np.zeros((k, k))
    for (i, j), v in zip(cells, values[k + 1 :], strict=True):
        q[i, j] = q[j, i] = v
    cov = q / n - np.outer(s / n, s / n)
    return cov, np.sqrt(np.maximum(np.diag(cov), 0))


def feature_correlation(rows: DataFrame, k: int) -> DataFrame:
    """`(i, j, r)` of every two of the k features, i < j, to six decimals, from one pass over the rows; null where one is constant. Rows without features take no part."""
    cov, std = _second_moments(rows, k)
    r = [(i, j, float(round(cov[i, j] / (std[i] * std[j]), 6)) if min(std[i], std[j]) > 1e-12 else None) for i in range(k) for j in range(i + 1, k)]
    return rows.sparkSession.createDataFrame(r, "i int, j int, r double")


def variance_inflation(rows: DataFrame, names: list[str], limit: float = 100.0) -> DataFrame:
    """`(motif, vif)`: 1 / (1 - R2) of each feature on the others, from one pass over the rows.

    Exact collinearity, and a constant feature, give `limit`. All come from one eigendecomposition. `rows (x array<double>)`; only sums of
    features and of their products, k * (k + 3) / 2 numbers, reach the driver.
    """
    k = len(names)
    cov, std = _second_moments(rows, k)
    out = np.full(k, limit)
    live = np.flatnonzero(std > 1e-12)
    # one factorization for all features: the diagonal of the inverse, and who takes part in a direction without variance
    values, vectors = np.linalg.eigh(cov[np.ix_(live, live)] / np.outer(std[live], std[live]))
    null = values < 1e-10 * max(1, len(live))
    free = (vectors[:, null] ** 2).sum(axis=1) < 1e-9
    out[live[free]] = (vectors[free][:, ~null] ** 2 / values[~null]).sum(axis=1)
    return rows.sparkSession.createDataFrame(list(zip(names, map(float, out), strict=True)), "motif string, vif double")


def annotate_genes(results: DataFrame, metadata: DataFrame, *, on_missing: str = "error", name: str = "motif") -> DataFrame:
    """Adds `genes`, the gene of each motif, after its name; a missing one is an error or "Unknown"."""
    gene = F.col("_gene") if on_missing == "keep" else F.coalesce("_gene", F.lit("Unknown") if on_missing == "unknown" else F.raise_error(F.concat(F.lit("no gene for "), F.col(name))))
    facts = metadata.select(F.col("name").alias("_name"), F.col("gene").alias("_gene"))
    rest = [c for c in results.columns if c not in (name, "genes")]
    return results.join(facts, F.col(name) == F.col("_name"), "left").select(name, gene.alias("genes"), *rest)
