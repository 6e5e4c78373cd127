import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_features_equal_brute_force(spark, sf):
    r = random.Random(6)
    odd = [None, "", " \t\n\x0b\x0c\r", "a " * 9, "a\n" * 30, "   x", "#*$%&|<>é", "\x1c\x85 b"]
    odd += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(100)]
    odd += ["\n".join(r.choice(["x y", " x y", "", "#"]) for _ in range(r.randrange(30))) for _ in range(50)] + ["w " * 30000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    whole = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang")
    rows = df.unionByName(whole)
    got = {x.doc_id: tuple(x)[2:] for x in quality.base_features(rows).collect()}
    assert got == {x.doc_id: brute(x.text) for x in rows.collect()}


def binomial(n, p, k):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


@pytest.mark.parametrize("n", [0, 1, 50, 600, 5000, 200_000])
def test_most_rejections_is_the_exact_bound(spark, n):
    for risk, level in ((0.005, 1e-4), (0.05, 0.01)):
        k = spark.range(1).select(quality.most_rejections(F.lit(float(n)), risk, F.lit(level))).first()[0]
        assert k == -1 or binomial(n, risk, k) <= level
        assert binomial(n, risk, k + 1) > level


def labelled(spark, n):
    """Good rows without symbols but for one in a thousand, bad rows with many."""
    text = "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', id * 31 + i)))"
    rows = spark.range(n).withColumn("bad", F.expr("id % 10 = 0"))
    rows = rows.withColumn("text", F.expr(f"if(bad or id % 1000 = 7, replace({text}, 'w', '#w'), {text})"))
    docs = rows.select(F.col("id").alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(1).alias("kept"))
    return docs, rows.select(F.col("id").alias("doc_id"), (~F.col("bad")).cast("int").alias("quality"))


def test_cutoffs_keep_the_risk_and_catch_bad_rows(spark):
    docs, labels = labelled(spark, 20_000)
    got = quality.quality_verdicts(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = {x[0]: x[1] for x in got}
    assert kept[1] >= 1 - quality.RISK and kept[0] == 0


def test_small_holdouts_keep_everything(spark):
    docs, labels = labelled(spark, 200)
    assert quality.quality_verdicts(docs, labels).where("NOT kept").count() == 0
    assert quality.quality_verdicts(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_bound_holds_for_each_stratum(spark):
    """Cutoffs equal those of a plain search over the labelled rows."""
    docs, labels = labelled(spark, 20_000)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 500 == 1, None).otherwise("b"))
    rows = [x.asDict() for x in quality.base_features(docs).join(labels, "doc_id").collect()]
    found = quality.risk_controlled_cutoffs(quality.base_features(docs), labels).collect()
    strata = {x["stratum"] for x in rows if x["quality"] == 1}
    level = quality.ERROR / (len(strata) * sum(len(r[2]) for r in quality.RULES.values()))
    for x in found:
        good = [y for y in rows if y["stratum"] == x.stratum and y["quality"] == 1 and not y["base_failed"]]
        assert x.n_good == len(good)
        for rule, (a, b, cutoffs) in quality.RULES.items():
            passing = [c for c in cutoffs if binomial(len(good), quality.RISK / len(quality.RULES), sum(y[a] / y[b] > c for y in good)) <= level]
            assert x.cutoffs.get(rule) == (min(passing) if passing else None)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a", "x"), (None, "a " * 5, "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert [x.kept for x in quality.quality_verdicts(df, labels).collect()] == [False] * 3
    assert quality.keep_good(df, labels).count() == 0
    assert quality.quality_verdicts(df.limit(0), labels).count() == 0
