import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from seqloom.llm.importance import importance_sample
from seqloom.llm.queries import op11_importance

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    """Brute force: (doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, longest)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc, text in docs:
        n_words, fs = features(text, longest)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = op11_importance(spark, sf)
    assert [t for _, t in df.select("doc_id", "n_features", "weight", "score", "rank").dtypes] == ["bigint"] * 5
    assert found(df) == expected(docs, target)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 64), (3, 7)])
def test_any_text(spark, longest, buckets):
    """Nulls, empty and very long texts, letters beyond ASCII (only A-Z are lowered), repeated rows, clashing columns."""
    r = random.Random(1)
    pool = ["Ärger", "ÄRGER", "straße", "İz", "x9", "ABC", "abc", "日本", "a b", "q" * 300]
    texts = [None, "", " .,;:\n", "One two", "\x1cA\x7fB", " ".join(r.choices(pool, k=40_000)), *(" ".join(r.choices(pool, k=r.randrange(60))) for _ in range(150))]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(7, texts[40], 0, "x"), (7, texts[40], 0, "x"), (None, texts[41], 1, None), (None, None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, buckets string").repartition(5)
    target = ["abc straße", None, "", "日本 x9 x9"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (0, 10, 100):
        got = importance_sample(docs, wanted, percent=percent, longest=longest, buckets=buckets, least_words=5)
        assert found(got) == expected([x[:2] for x in rows], target, percent, buckets, longest, 5)


def test_ties_go_to_the_smaller_id(spark):
    """With one bucket all weights are equal, and so many documents that scores repeat at the cut."""
    rows = [(i, "w " * 20) for i in range(3000)]
    got = importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string"))
    assert found(got) == expected(rows, ["w"])


def test_draws_what_resembles_the_target(spark):
    rows = [(i, ("apple pear plum " if i % 10 == 0 else "stone iron lead ") * 10) for i in range(500)]
    got = importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("apple plum",)], "text string"))
    drawn = [x.doc_id for x in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 50 and sum(d % 10 == 0 for d in drawn) > 25


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance_sample(none, some).count() == 0
    assert found(importance_sample(some, none, least_words=1, percent=100)) == expected([(1, "a b")], [], 100, least=1)
