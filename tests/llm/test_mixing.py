import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing
from seqloom.llm.queries import op12_mixture


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Brute force: the target of each source of {source: size}, by rounds."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        each = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if each[s] > most * sizes[s]]
        if not over:
            return fixed | each
        for s in over:
            fixed[s] = most * sizes[s]
            rest -= fixed[s]


def check(rows, got, block=16, shards=1):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want, taken = targets(sizes), defaultdict(int)
    assert sorted((x.doc_id, x.size) for x in got if x.doc_id is not None) == sorted((d, words(t)) for d, t, _ in rows if d is not None)
    assert len(got) == len(rows)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source], rel=1e-9, abs=1e-6)
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.repeats * x.size + x.run_words and x.run_words <= x.size and 0 <= x.first_word <= x.size
        taken[x.source] += x.taken
    for s, n in taken.items():  # half a block in the source, and the short last block of each shard
        assert abs(n - want[s]) <= block * (1 + shards), (s, n, want[s])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    assert sorted((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in got) == sorted(map(tuple, op12_mixture(spark, sf).collect()))


@pytest.mark.parametrize("shard_words", [50, 400, 1 << 20])
def test_any_table(spark, shard_words):
    """Null and empty sources and texts, a source with most rows, a very long text, repeated rows and null ids; any partitioning gives the same."""
    r = random.Random(3)
    text = lambda n: r.choice([" ", "\t", "\n", ""]) + " \x0b".join("wé" for _ in range(n))
    rows = [(i, text(r.randrange(120)), r.choice(["a", "big", "big", "big", "é", "Z", "", None])) for i in range(400)]
    rows += [(900, text(30_000), "b"), (901, None, "b"), (902, "", "nothing"), (903, None, None), (904, "   ", "c")]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(None, "x y z", "a"), (None, "x y", "a"), (None, None, "a")]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(docs, shard_words=shard_words).collect()
    most = max(sum(words(t) for _, t, s in rows if s == source) for source in {x[2] for x in rows})
    check(rows, got, shards=-(-most // shard_words))
    again = mixing.mix(docs.repartition(7, F.rand(5)), shard_words=shard_words).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, again)))


def test_apportion_is_sainte_lague(spark):
    """Against the quotients in exact arithmetic, one seat after the other."""
    r = random.Random(9)
    cells, want = [], {}
    for g in range(25):
        seats, n = r.choice([0, 1, 2, 7, 100, 999]), r.randrange(1, 12)
        votes = [float(r.choice([0, 0, 1, 1, 5, r.randrange(1, 10**6)])) for _ in range(n)]
        cells += [(g, i, v, seats) for i, v in enumerate(votes)]
        won = [0] * n
        for _ in range(seats if any(votes) else 0):
            i = max(range(n), key=lambda i: (Fraction(int(votes[i]), 2 * won[i] + 1), -i))
            won[i] += 1
        want |= {(g, i): w for i, w in enumerate(won)}
    df = spark.createDataFrame(cells, "g long, id long, votes double, seats long")
    assert {(x.g, x.id): x.quota for x in mixing.apportion(df, ["g"], "test").collect()} == want


def test_runs_keep_documents_whole(spark):
    """Of a source that is taken in part, two documents at most are cut."""
    rows = [(i, "w " * 50, "a" if i < 100 else "b") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1), share=0.4).collect()
    for source in "ab":
        assert sum(x.taken % x.size > 0 for x in got if x.source == source) <= 2
    assert {x.taken for x in got} > {0, 50}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
