"""Importance resampling towards a target text by hashed features, with explode-free scoring.

Each document becomes an array of bucket numbers (crc32 of its words, or runs of words, modulo
`BUCKETS`), written once. Counts per bucket are summed where the arrays are read, so at most `BUCKETS`
totals a task are shuffled. A bucket's gain is the scaled logarithm of its smoothed share in the target
over that in the corpus; the gains are one literal array in the plan, and a document's weight is an
aggregate over `element_at` of it. A Gumbel number per document, from a seeded hash of its id, is added,
and the highest scores are drawn, which is sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._ranks import ranked
from seqloom.llm._scratch import table

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: all of ASCII but letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z, and nothing else, in lower case."""
    low = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != ""), low)


def features_of(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        # by place: slice() would copy the whole array for every run
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))

    return F.concat(words, *map(runs, range(2, longest + 1))) if longest > 1 else words


def bucket_arrays(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """`(id, n_words, buckets array<int>)` of `rows (id, text)`."""
    words = rows.select("id", words_of(F.col("text")).alias("words"))
    bucket = lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int")
    return words.select("id", F.size("words").alias("n_words"), F.transform(features_of(F.col("words"), longest), bucket).alias("buckets"))


def bucket_counts(arrays: DataFrame) -> dict[int, int]:
    """How many features each bucket holds: a row per bucket at most, whatever the size of the corpus."""
    counts = arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    return {r["bucket"]: r["count"] for r in counts.collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int, scale: int) -> list[int]:
    """Per bucket floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))."""
    total_s, total_t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1) * (total_s + buckets) / float((corpus.get(b, 0) + 1) * (total_t + buckets))
    return [math.floor(scale * math.log(ratio(b))) for b in range(buckets)]


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    scale: int = SCALE,
) -> DataFrame:
    """One row per row of `docs`: `(<id_col>, n_features, weight, score, rank)`, all long.

    weight is the mean gain of a document's features, rounded down, and 0 without features; score adds
    the scaled Gumbel number. Of the N documents with `least_words` words or more, floor(percent * N / 100)
    have a rank, 1 for the highest score, ties by the smaller id; the others' is null. A null text has
    no words; a null id is hashed as an empty string and comes before others in ties. Rows that repeat an
    id are documents of their own with the same Gumbel number. Whole texts are read, however long; extra
    columns are ignored; an empty table gives no rows, an empty target a corpus-only gain.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    arrays = table(bucket_arrays(rows, buckets, longest), "dsir-buckets")
    wanted = bucket_arrays(target.select(F.lit(0).alias("id"), F.col(target_col).cast("string").alias("text")), buckets, longest)
    gains = gains_of(bucket_counts(arrays), bucket_counts(wanted), buckets, scale)

    literal = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-scale * F.log(-F.log((F.col("h") + 0.5) / 4294967296.0)))
    weighed = arrays.select("id", "n_words", n.alias("n_features"), total.alias("total"), h.alias("h"))
    floor_mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    scored = weighed.select("id", "n_words", "n_features", floor_mean.alias("weight"), gumbel.alias("gumbel"))
    scored = table(scored.select("id", "n_words", "n_features", "weight", (F.col("weight") + F.col("gumbel")).alias("score"), F.monotonically_increasing_id().alias("row_no")), "dsir-scores")

    enough = F.col("n_words") >= least_words
    # scores are whole numbers between bounds that do not depend on the rows: the extreme gains and the Gumbel numbers of 32 bits
    counts = sorted(((r["score"], r["count"]) for r in scored.where(enough).groupBy("score").count().collect()), reverse=True)
    drawn = percent * sum(c for _, c in counts) // 100
    least, seen = None, 0
    for least, c in counts:
        seen += c
        if seen >= drawn:
            break
    may = enough & (F.col("score") >= (least if drawn else math.inf))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    first = ranked(scored.where(may), [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row_no")], "dsir-drawn")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return first.select(*columns, rank.alias("rank")).unionByName(scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
