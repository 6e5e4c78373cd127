import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import near_dup
from seqloom.llm.near_dup import alike, drop_near_duplicates, edit_distance, near_duplicate_classes, order_minhash


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(8))
def test_banded_distance_equals_the_plain_one(seed):
    r = random.Random(seed)
    for _ in range(150):
        a = [r.randrange(3 + seed) for _ in range(r.randrange(40))]
        b = [x for x in a if r.random() > 0.1] if r.random() < 0.6 else [r.randrange(4) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.randrange(5))
        most = r.randrange(0, 25)
        assert edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_sketch_is_sensitive_to_order():
    import numpy as np

    x = np.arange(1, 60, dtype=np.uint64)
    a, b = order_minhash(x, 1, 50, 3), order_minhash(x[::-1].copy(), 1, 50, 3)
    assert (a == order_minhash(x, 1, 50, 3)).all()
    assert (a == b).mean() < 0.4


def brute(rows, similarity=0.8):
    import re

    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    text = dict(rows)
    root = {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(text)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = text[i] is not None and text[i] == text[j]
            if same or (words[i] and words[j] and text[i] is not None and text[j] is not None and alike(words[i], words[j], similarity)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, 6)):
            text = [x if r.random() > 0.01 else r.choice(vocabulary) for x in base]
            rows.append((k, " ".join(text)))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[5][1]), (k + 2, ""), (k + 3, ""), (k + 4, None), (k + 5, None), (k + 6, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(df).collect()}
    assert got == brute(rows)


def test_whole_table_equals_brute_force_within_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 4000)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(docs).collect()}
    want = brute(rows)
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (2, None, None), (3, "A b c, d e f g!", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(((x.doc_id, x.class_id, x.keep) for x in near_duplicate_classes(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (None, None, True)]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["1", "2", "None"]
    assert near_duplicate_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [8, 12, 20, 45, 52, 60, 100, 400])
@pytest.mark.parametrize("rate", [0.05, 0.13, 0.18, 0.2])
def test_sketches_find_edited_texts(n, rate):
    """Of pairs that alignment links, words replaced at random, nine in ten share a sketch, short texts included."""
    import numpy as np

    from seqloom.llm import near_dup

    np.seterr(over="ignore")
    r = random.Random(n)

    sketches = lambda words: set(near_dup.text_sketches(np.array(words, np.uint64)).tolist())
    hits = linked = 0
    while linked < 100:
        a = [r.randrange(1, 10**9) for _ in range(n)]
        b = [x if r.random() > rate else r.randrange(1, 10**9) for x in a]
        if alike(a, b, 0.8):
            linked += 1
            hits += bool(sketches(a) & sketches(b))
    assert hits >= 90


def test_very_long_texts(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    near = [w if r.random() > 0.05 else "other" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(r.sample(words, len(words))))]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_counters_never_rule_out_a_link(spark):
    """Packed counters, full ones too, bound the shared words from above; unlike texts are told apart by them."""
    r = random.Random(6)
    rows = []
    for n in (5, 40, 300, 20_000):
        base = [r.choice(("w", "v", "the")) + str(r.randrange(400)) for _ in range(n)]
        rows += [(" ".join(base), " ".join(w if r.random() > 0.15 else "x" for w in base)) for _ in range(2)]
    rows += [("a " * 90_000, "a " * 88_000 + "b " * 2000)]
    docs = [(2 * i + k, t) for i, pair in enumerate(rows) for k, t in enumerate(pair)]
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(rows)))


def test_members_are_shuffled_for_repeated_rows_only(spark, monkeypatch):
    plans, classes = [], near_dup.classes

    def seen(members, *args, **options):
        plans.append(members._jdf.queryExecution().optimizedPlan().toString())
        return classes(members, *args, **options)

    monkeypatch.setattr(near_dup, "classes", seen)
    text = "one two three four five six seven eight nine ten"
    for rows in ([(1, text), (2, text + " more")], [(1, text), (1, text), (2, text + " more")]):
        got = near_dup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {x.class_id for x in got} == {1} and len(got) == len(rows)
    assert ["Aggregate" in x for x in plans] == [False, True]
