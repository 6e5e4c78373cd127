"""Toxicity by a classifier chain over hashed word features.

Categories are predicted in order. The model of each is a logistic regression on the presence of
words and of word beginnings (four and five letters) that are tied to the category, with a z-score of
`LEAST_Z` or more, and on the probabilities of the categories before it. In training those
probabilities are out of fold: each row's come from models that haven't seen it. Models are fitted on
at most `MAX_TRAIN` labelled rows, those with the least hashed ids; every row of the table is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import let

MAX_TRAIN = 12_000
PREFIXES = (4, 5)
FOLDS = 4
ROUNDS = 80
RIDGE = 1e-5
LEAST_ROWS = 8
LEAST_Z = 5.0


def features(text: Column) -> Column:
    """Distinct hashed features of a whole text: words and word beginnings, in lower case."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))
    beginning = lambda n: lambda w: F.hash(F.substring(w, 1, n), F.lit(n))
    return let(words, lambda ws: F.array_distinct(F.concat(F.transform(ws, lambda w: F.hash(w)), *(F.transform(ws, beginning(n)) for n in PREFIXES))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """Weights of some features (in ascending order), of the earlier probabilities, and the bias."""

    features: np.ndarray
    words: np.ndarray
    chain: np.ndarray
    bias: float

    def scores(self, ids: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(starts) - 1)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, ids), len(self.features) - 1)
            hit = np.flatnonzero(self.features[at] == ids)
            sums = np.bincount(np.searchsorted(starts, hit, "right") - 1, self.words[at[hit]], len(sums))
        return _sigmoid(sums + earlier @ self.chain + self.bias)


def minimise(f, w: np.ndarray, rounds: int = ROUNDS, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f returns value and gradient."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d -= a * y
            kept.append(a)
        if past:
            d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += (a - y @ d / (s @ y)) * s
        slope, step = g @ d, 1.0
        if slope < 1e-12:
            break
        while step > 1e-10:
            new, new_g = f(w - step * d)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * d, new_g - g
        if s @ y > 1e-14:
            past = [*past, (s, y)][-memory:]
        w, value, g = w + s, new, new_g
    return w


def fit(ids: np.ndarray, starts: np.ndarray, earlier: np.ndarray, y: np.ndarray, n: int) -> Linear:
    """Ridge logistic regression on the features, 0 to n - 1, that are tied to y."""
    rows, k = len(y), earlier.shape[1]
    row = np.repeat(np.arange(rows), np.diff(starts))
    rate = y.mean() if rows else 0.0
    bias = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    if not 0 < rate < 1:
        return Linear(np.zeros(0, int), np.zeros(0), np.zeros(k), bias)
    total, hits = np.bincount(ids, minlength=n), np.bincount(ids, y[row], n)
    chosen = np.abs(hits - rate * total) >= LEAST_Z * np.sqrt(rate * (1 - rate) * np.maximum(total, 1) * (1 - total / rows) + 1e-9)
    place, use = np.cumsum(chosen) - 1, chosen[ids]
    at, row, m = place[ids[use]], row[use], int(chosen.sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[at], rows) + earlier @ w[m : m + k] + w[-1]
        error = (_sigmoid(z) - y) / rows
        value = np.mean(np.logaddexp(0, z) - y * z) + RIDGE / 2 * (w[:-1] @ w[:-1])
        return value, np.r_[np.bincount(at, error[row], m), earlier.T @ error, error.sum()] + RIDGE * np.r_[w[:-1], 0]

    w = minimise(loss, np.r_[np.zeros(m + k), bias])
    return Linear(np.flatnonzero(chosen), w[:m], w[m : m + k], float(w[-1]))


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    cutoffs: list[float] = field(default_factory=list)

    def probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts) - 1, 0))
        for model in self.models:
            out = np.column_stack([out, model.scores(ids, starts, out)])
        return out


def best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The probability between two rows that separates best (F1); above 1 if nothing is positive."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.r_[p[order][1:] < p[order][:-1], True]
    at = int(np.where(last, f1, -1).argmax())
    after = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + after) / 2)


def fit_chain(lists: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """lists: each row's features; labels: rows x categories of 0 and 1; folds: each row's fold."""
    flat = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
    sizes = np.array([len(x) for x in lists], np.int64)
    names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts >= LEAST_ROWS
    use = common[at]
    owner = np.repeat(np.arange(len(lists)), sizes)[use]
    ids, sizes = (np.cumsum(common) - 1)[at[use]], np.bincount(owner, minlength=len(lists))
    names, starts, n = names[common], np.r_[0, np.cumsum(sizes)], int(common.sum())

    def rows(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids[np.repeat(mask, sizes)], np.r_[0, np.cumsum(sizes[mask])]

    chain, earlier = Chain(categories), np.zeros((len(lists), 0))
    for j in range(len(categories)):
        y, out = labels[:, j].astype(float), np.zeros(len(lists))
        for k in np.unique(folds):
            a, b = folds != k, folds == k
            out[b] = fit(*rows(a), earlier[a], y[a], n).scores(*rows(b), earlier[b])
        model = fit(ids, starts, earlier, y, n)
        chain.models.append(Linear(names[model.features], model.words, model.chain, model.bias))
        chain.cutoffs.append(best_cutoff(out, y))
        earlier = np.column_stack([earlier, out])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Chain:
    """Fits the chain on the `max_train` labelled documents with the least hashed ids.

    categories: name to a boolean column over `labels`, in chain order. Rows with a null label, id or
    text aren't used, repeated labels of an id once. Without labels all probabilities are small.
    """
    named = labels.select(F.col(id_col).alias("_id"), *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())))
    picked = named.dropna().groupBy("_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories)))).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .where("_text IS NOT NULL")
        .join(F.broadcast(picked), "_id")
        .select("_id", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).alias("fold"), *(f"y{i}" for i in range(len(categories))), features(F.col("_text")).alias("features"))
    )
    found = rows.toArrow().sort_by("_id")
    lists = [np.array(x.values.to_numpy()) for x in found.column("features")]
    y = np.column_stack([found.column(f"y{i}").to_numpy() for i in range(len(categories))])
    return fit_chain(lists, y, found.column("fold").to_numpy(), tuple(categories))


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(<id_col>, p_<category> ..., <category> ... )` of each row: probabilities, and whether they reach the cutoffs.

    A null or wordless text has no features and gets the rates of the bias; its flags are false.
    Rows with a null id are scored too, repeated rows alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories] + list(chain.categories)
    kinds = [pa.float64()] * len(chain.categories) + [pa.bool_()] * len(chain.categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lists = batch.column("features")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            p = model.probabilities(ids, starts)
            some = np.diff(starts) > 0
            columns = [p[:, j] for j in range(p.shape[1])] + [(p[:, j] >= model.cutoffs[j]) & some for j in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), features(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("features"))
    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{n} {'double' if n.startswith('p_') else 'boolean'}" for n in names)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
