"""Sparse logistic models over partitioned rows: many models in one pass.

Models are columns of one weight matrix. A pass reads every row once and returns, for all models, the loss,
its gradient and, if asked for, its curvature, summed per partition and then over partitions; so what
reaches the driver depends on features and models, never on rows. On the driver a step minimises the
quadratic model with the L1 term by coordinate descent (proximal Newton), for all models of a curvature at
once. A model whose objective rose goes back half the way. Reduced models keep the curvature of the
full one that they come from and start at its weights.

Features are used as they are or standardised; since that is affine per feature, rows are never copied:
weights are turned into those of the raw features before a pass, gradients back after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 200


def blocks(rows: DataFrame) -> DataFrame:
    """`(x, label, trains)` of `rows (label, x, trains)`, packed: a row of bytes per batch, so that no pass turns numbers into Arrow's again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            if batch.num_rows:
                packed = flat("x").astype(float), batch.column("label").to_numpy(zero_copy_only=False).astype(float), flat("trains").astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in packed], ["x", "label", "trains"])

    return rows.mapInArrow(run, "x binary, label binary, trains binary")


def _arrays(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features (n x k), labels and train marks (n x splits) of each block."""
    for x, y, trains in zip(*(batch.column(c) for c in ("x", "label", "trains")), strict=True):
        y = np.frombuffer(y.as_buffer(), float)
        yield np.frombuffer(x.as_buffer(), float).reshape(len(y), k), y, np.frombuffer(trains.as_buffer(), bool).reshape(len(y), -1)


def _summed(rows: DataFrame, k: int, of_batch, cells: int) -> np.ndarray:
    """Sum over all `blocks` of `of_batch(x, y, trains)`, an array of `cells` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            for block in _arrays(batch, k):
                total += of_batch(*block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "value"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


@dataclass
class Scale:
    """Per split, mean and deviation of each feature: z = (x - mean) / std."""

    mean: np.ndarray
    std: np.ndarray

    def raw(self, w: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Weights of raw features, intercept last, of weights of standardised ones."""
        a = w[:, :-1] / self.std[split]
        return np.column_stack([a, w[:, -1] - (a * self.mean[split]).sum(axis=1)])

    def back(self, g: np.ndarray, split: np.ndarray) -> np.ndarray:
        """The gradient in standardised features."""
        return np.column_stack([(g[:, :-1] - self.mean[split] * g[:, -1:]) / self.std[split], g[:, -1]])

    def curved(self, h: np.ndarray, split: int) -> np.ndarray:
        k = h.shape[0] - 1
        t = np.zeros((k + 1, k + 1))  # raw row [x, 1] times t is [z, 1]
        t[:k, :k] = np.diag(1 / self.std[split])
        t[k, :k] = -self.mean[split] / self.std[split]
        t[k, k] = 1
        return t.T @ h @ t


def no_scale(k: int, splits: int) -> Scale:
    return Scale(np.zeros((splits, k)), np.ones((splits, k)))


def train_scale(rows: DataFrame, k: int, splits: int, *, everything: bool = False) -> Scale:
    """Mean and population deviation over each split's training rows, or over all rows; a constant feature keeps its unit."""

    def sums(x, y, trains):
        t = np.ones_like(trains, float) if everything else trains.astype(float)
        return np.concatenate([t.sum(axis=0), (t.T @ x).ravel(), (t.T @ (x * x)).ravel()])

    got = _summed(rows, k, sums, splits * (1 + 2 * k))
    n, s, q = got[:splits, None], got[splits : splits * (1 + k)].reshape(splits, k), got[splits * (1 + k) :].reshape(splits, k)
    mean = s / np.maximum(n, 1)
    variance = q / np.maximum(n, 1) - mean**2
    return Scale(mean, np.where(variance > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(variance, 0)), 1.0))


def loss_and_gradient(rows: DataFrame, w: np.ndarray, split: np.ndarray, scale: Scale, curvature: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log-loss (models), its gradient (models x features + 1) and curvatures over each model's training rows."""
    m, k, split = w.shape[0], w.shape[1] - 1, np.asarray(split)
    raw = scale.raw(w, split)

    def sums(x, y, trains):
        loss, gx, g1, curves = np.zeros(m), np.zeros((m, k)), np.zeros(m), np.zeros((m if curvature else 0, k + 1, k + 1))
        for s in np.unique(split):
            at, here = np.flatnonzero(split == s), trains[:, s]
            xs, ones = x[here], (y[here] > 0)[:, None]
            z = xs @ raw[at, :-1].T + raw[at, -1]
            small = np.exp(-np.abs(z))
            loss[at] = (np.maximum(np.where(ones, -z, z), 0) + np.log1p(small)).sum(axis=0)
            p = np.where(z >= 0, 1.0, small) / (1 + small)
            r = p - ones
            gx[at], g1[at] = r.T @ xs, r.sum(axis=0)
            if curvature:
                one = np.column_stack([xs, np.ones(len(xs))])
                d = p * (1 - p)
                for j, i in enumerate(at):
                    curves[i] = (one * d[:, [j]]).T @ one
        return np.concatenate([loss, gx.ravel(), g1, curves.ravel()])

    got = _summed(rows, k, sums, m * (k + 2) + curvature * m * (k + 1) ** 2)
    g = np.column_stack([got[m : m + m * k].reshape(m, k), got[m + m * k : m * (k + 2)]])
    hs = got[m * (k + 2) :].reshape(-1, k + 1, k + 1) if curvature else []
    return got[:m], scale.back(g, split), [scale.curved(h, split[i]) for i, h in enumerate(hs)]


def _directions(w: np.ndarray, g: np.ndarray, h: np.ndarray, live: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """Per model the minimiser d of g d + d h d / 2 + |w + d|, by coordinate descent over all models at once."""
    d, hd = np.zeros_like(w), np.zeros_like(w)
    diagonal = np.diag(h)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(w.shape[1]):
            if diagonal[j] <= 1e-12:
                new = np.zeros(len(w))
            else:
                at = w[:, j] + d[:, j] - (g[:, j] + hd[:, j]) / diagonal[j]
                new = np.sign(at) * np.maximum(np.abs(at) - 1 / diagonal[j], 0)
            step = np.where(live[:, j], new - w[:, j] - d[:, j], 0.0)
            if step.any():
                d[:, j] += step
                hd += step[:, None] * h[j][None, :]
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-13:
            break
    return d


def fit(rows: DataFrame, split: np.ndarray, scale: Scale, *, c: float = 1.0, tol: float = 1e-8, start: np.ndarray | None = None, live: np.ndarray | None = None, curvatures: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Weights (models x features + 1) that minimise sum |w| + c * log-loss over each model's split, and the last curvature per split.

    rows: `blocks` of `(label, x, trains)`. The intercept comes last and is penalised like the others. live marks the
    weights that may differ from 0. With `curvatures` (per split) none is computed.
    """
    split = np.asarray(split)
    k = scale.mean.shape[1]
    w = np.zeros((len(split), k + 1)) if start is None else start.copy()
    live = np.ones_like(w, bool) if live is None else live
    w = np.where(live, w, 0.0)
    best, kept, d = np.full(len(split), np.inf), w.copy(), np.zeros_like(w)
    held, open_ = dict(curvatures or {}), np.ones(len(split), bool)
    for _ in range(ROUNDS):
        now = np.flatnonzero(open_)
        if not len(now):
            break
        loss, g, hs = loss_and_gradient(rows, w[now], split[now], scale, curvatures is None)
        value = c * loss + np.abs(w[now]).sum(axis=1)
        better = value <= best[now] + 1e-12 * np.abs(value)
        for i in now[~better]:  # half the way back
            d[i] /= 2
            w[i] = kept[i] + d[i]
            open_[i] = np.abs(d[i]).max() >= tol * 1e-2
        good = now[better]
        best[good], kept[good] = value[better], w[good]
        if curvatures is None:
            for i, m in enumerate(now):
                if better[i]:
                    held[int(split[m])] = hs[i]
        for key in sorted({int(s) for s in split[good]}):
            group = [i for i in range(len(now)) if better[i] and split[now[i]] == key]
            at = now[group]
            if curvatures is None:
                for i, m in zip(group, at, strict=True):
                    d[[m]] = _directions(w[[m]], c * g[[i]], c * hs[i], live[[m]])
            else:
                d[at] = _directions(w[at], c * g[group], c * held[key], live[at])
        w[good] = kept[good] + d[good]
        open_[good] = np.abs(d[good]).max(axis=1) >= tol
    return kept, held


def scored(rows: DataFrame, raw: np.ndarray) -> DataFrame:
    """`(iteration, score, pos, neg)`: labels by score of the rows that an iteration's model (row of `raw`, weights of raw features) is tested on, counted per block."""
    k = raw.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, trains in _arrays(batch, k):
                for i, w in enumerate(raw):
                    xs, ys, z = x[~trains[:, i]], y[~trains[:, i]], w[-1]
                    for j in range(k):  # a sum over features, in their order
                        z = z + xs[:, j] * w[j]
                    with np.errstate(over="ignore"):
                        score, at = np.unique(1 / (1 + np.exp(-z)) * np.ones(len(ys)), return_inverse=True)
                    pos, neg = (np.bincount(at, weights=v, minlength=len(score)) for v in (ys, 1 - ys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(score), pa.array(pos), pa.array(neg)], ["iteration", "score", "pos", "neg"])

    return rows.mapInArrow(run, "iteration int, score double, pos double, neg double")


def likelihoods(rows: DataFrame, w: np.ndarray, split: np.ndarray, scale: Scale) -> np.ndarray:
    """Log-likelihood of all rows under each model; minus infinity where a row has probability 0."""
    m, k = w.shape[0], w.shape[1] - 1
    raw = scale.raw(w, np.asarray(split))

    def sums(x, y, trains):
        p = 1 / (1 + np.exp(-np.clip(x @ raw[:, :-1].T + raw[:, -1], -500, 500)))
        with np.errstate(divide="ignore"):
            return np.log(np.where((y > 0)[:, None], p, 1 - p)).sum(axis=0)

    return _summed(rows, k, sums, m)
