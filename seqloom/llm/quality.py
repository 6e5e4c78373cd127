"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

A rule is a score per document; documents above its cutoff are rejected. The cutoff of each stratum
(the language) is the smallest one of a fixed list for which an exact binomial bound on a labelled
holdout shows that no more than `risk / rules` of the good documents are rejected. Counting every
(stratum, rule, cutoff) as a test of its own, the error level is divided by their number
(Bonferroni), so all guarantees hold together with probability `1 - error`, and a stratum's rules
reject `risk` of its good documents together at most. A stratum whose holdout is too small to show
that keeps everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import let, small, table

WINDOW = 8
RISK = 0.02
ERROR = 0.05
#: rule: (numerator, denominator, cutoffs from strict to mild)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols", "n_words", (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words", (0.005, 0.01, 0.02, 0.05, 0.1)),
    "repeated_share": ("n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15, 0.2)),
    "word_length": ("word_chars", "n_words", (7.0, 8.0, 10.0, 12.0, 15.0)),
}
_SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more, first occurrences included.

    Windows are compared by a 64-bit hash. Their start positions, sorted by hash, show the repeated
    ones; sorted by position again, each covers the words up to the next start, `window` at most.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def repeats(ordered: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ordered, i)["hash"] == F.get(ordered, j)["hash"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return let(F.array_sort(F.transform(at, lambda i: F.get(ordered, i)["at"])), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(pairs), repeats))

    def windows(hashed: Column) -> Column:
        # by place: slice() would copy the whole array for every window
        each = F.transform(F.sequence(F.lit(0), F.size(hashed) - window), lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(window))))
        return F.when(F.size(hashed) <= window, F.lit(0)).otherwise(let(each, counted))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """`(<id_col>, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)` per row.

    Words are runs of anything but the six ASCII spaces, in the whole text. A null or empty text has
    none and fails; a null stratum is named "unknown". Repeated rows stay; no row of an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("unknown")) if stratum_col else F.lit("all")
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    return (
        docs.select(F.col(id_col), stratum.alias("stratum"), text.alias("text"))
        .select(
            id_col,
            "stratum",
            F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"),
            counts.alias("counts"),
        )
        .select(
            id_col,
            "stratum",
            F.col("counts.n").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            F.col("counts.repeated").cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def _score(rule: str, rules: dict) -> Column:
    above, below, _ = rules[rule]
    return F.try_divide(F.col(above).cast("double"), F.col(below).cast("double"))


def most_rejections(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level, or -1: k rejections of n good documents
    or fewer show that the rate is `risk` at most (the exact upper bound of Clopper and Pearson)."""
    odds = math.log(risk / (1 - risk))
    start = F.struct((n * F.lit(math.log1p(-risk))).alias("term"), F.lit(float("-inf")).alias("sum"), F.lit(-1).alias("best"))

    def add(state: Column, i: Column) -> Column:
        high, low = F.greatest(state["sum"], state["term"]), F.least(state["sum"], state["term"])
        total = high + F.log1p(F.exp(low - high))
        return let(
            total,
            lambda t: F.struct(
                (state["term"] + F.coalesce(F.log((n - i) / (i + F.lit(1.0))), F.lit(float("-inf"))) + F.lit(odds)).alias("term"),
                t.alias("sum"),
                F.when(t <= F.log(level), i).otherwise(state["best"]).alias("best"),
            ),
        )

    steps = F.sequence(F.lit(0), F.ceil(n * F.lit(risk)).cast("int"))
    return F.aggregate(steps, start, add, lambda s: s["best"])


def risk_controlled_cutoffs(
    features: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    good_col: str = "quality",
    rules: dict = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum with good labels: `(stratum, n_good, cutoffs map<rule, cutoff>)`.

    The holdout is every labelled good row that the base rules keep. A rule without a cutoff that
    passes is absent from the map. Null labels count as unlabelled, repeated labels of an id once.
    """
    names = [(r, c) for r in rules for c in sorted(rules[r][2])]
    good = labels.where(F.col(good_col) == 1).select(F.col(id_col).alias("_good")).where("_good IS NOT NULL").distinct()
    hits = [F.sum(F.when(_score(r, rules) > c, 1).otherwise(0)).alias(f"h{i}") for i, (r, c) in enumerate(names)]
    held = (
        features.where("NOT base_failed")
        .join(good, F.col(id_col) == F.col("_good"), "left_semi")
        .groupBy("stratum")
        .agg(F.count("*").cast("double").alias("n"), *hits)
    )
    held = table(held, "holdout")
    level = F.lit(error / (max(1, held.count()) * len(names)))
    tested = held.withColumn("most", most_rejections(F.col("n"), risk / len(rules), level))
    each = F.map_from_entries(
        F.filter(
            F.array(
                *(
                    F.struct(
                        F.lit(r).alias("rule"),
                        F.array_min(
                            F.filter(
                                F.array(*(F.when(F.col(f"h{i}") <= F.col("most"), F.lit(float(c))) for i, (x, c) in enumerate(names) if x == r)),
                                lambda v: v.isNotNull(),
                            )
                        ).alias("cutoff"),
                    )
                    for r in rules
                )
            ),
            lambda x: x["cutoff"].isNotNull(),
        )
    )
    return tested.select("stratum", F.col("n").cast("long").alias("n_good"), each.alias("cutoffs"))


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str | None = "lang",
    good_col: str = "quality",
    rules: dict = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """The base features of each row, `rejected_by` (the rules above their cutoffs) and `kept`.

    Nulls, empty tables and repeated rows as in `base_features`; without labels only the base rules act.
    """
    features = table(base_features(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "quality")
    cutoffs = table(risk_controlled_cutoffs(features, labels, id_col=id_col, good_col=good_col, rules=rules, risk=risk, error=error), "cutoffs")
    over = F.filter(
        F.array(*(F.when(_score(r, rules) > F.col("cutoffs")[r], F.lit(r)) for r in rules)),
        lambda x: x.isNotNull(),
    )
    return (
        features.join(small(cutoffs, cutoffs.count()), "stratum", "left")
        .withColumn("rejected_by", over)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("cutoffs", "n_good")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged. Rows of one id go only if each of them is rejected."""
    verdicts = quality_verdicts(docs, labels, id_col=id_col, **options)
    out = table(verdicts.groupBy(id_col).agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col(id_col).alias("_out")), "rejected")
    rows = out.count()
    return docs.join(small(out, rows), F.col(id_col).eqNullSafe(F.col("_out")), "left_anti")
