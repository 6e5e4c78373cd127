"""Classes of large buckets equal those of all pairs."""

from pyspark.sql import functions as F

from seqloom.llm import _links


def test_pairs_beyond_the_neighbours_are_verified(spark):
    """1001 and 2000 are linked; between them lie more members of the head's component than a round compares."""
    ids = [*range(1000, 1041), 2000]
    length = {i: 100 + (i - 1000) // 4 for i in ids} | {1000: 101, 1001: 100, 2000: 120}
    links = {(1000, i) for i in range(1001, 1041)} | {(1001, 2000)}
    members = spark.createDataFrame([(7, i) for i in ids], "bucket long, id long")
    info = spark.createDataFrame([(i, n) for i, n in length.items()], "id long, n int").select("id", F.struct("n").alias("info"))
    allowed = spark.createDataFrame(sorted(links), "a long, b long")
    found = _links.classes(members, lambda pairs: pairs.join(allowed, ["a", "b"]), info, "test", similarity=0.8, plausible=lambda x, y: x["n"] * 5 >= y["n"] * 4)
    assert {x.id: x.component for x in found.collect()} == dict.fromkeys(ids, 1000)


def test_links_of_a_large_bucket_are_all_found(spark):
    """Sixty members, each linked to the one thirty places on only."""
    members = spark.createDataFrame([(7, i) for i in range(60)], "bucket long, id long")
    info = spark.createDataFrame([(i, 100) for i in range(60)], "id long, n int").select("id", F.struct("n").alias("info"))
    allowed = spark.createDataFrame([(i, i + 30) for i in range(30)], "a long, b long")
    for carried in (members, members.join(info, "id")):
        asked = []
        found = _links.classes(carried, lambda pairs: pairs.join(allowed, ["a", "b"]), info, "test", similarity=0.8, plausible=lambda x, y: F.lit(True), prepare=asked.append)
        assert {x.id: x.component for x in found.collect()} == {i: i % 30 for i in range(60)}
        assert {x.id for x in asked[0].collect()} == set(range(60))


def test_large_buckets_are_compared_where_they_meet(spark):
    """Members of a large bucket that aren't longer than the limit are never asked for as pairs; all classes are those of every pair."""
    rows = [(b, 1000 * b + i, 10 + (b == 3) * (i % 40 == 0) * 90) for b, n in ((1, 900), (2, 6), (3, 80)) for i in range(n)]
    members = spark.createDataFrame([x[:2] for x in rows] + [(9, -5)], "bucket long, id long")
    info = spark.createDataFrame([(i, n) for _, i, n in rows] + [(-5, 10)], "id long, n int").select("id", F.struct("n").alias("info")).distinct()
    length = {i: n for _, i, n in rows}
    asked = []

    def verify(pairs):
        asked.extend((x.a, x.b) for x in pairs.select("a", "b").collect())
        return pairs.where("(b - a) % 7 = 0")

    at_once = (50, lambda ids: ids.select("id", F.struct("id").alias("detail")).join(info.where("info.n <= 50"), "id").select("id", "detail"), lambda x, y: (y["id"] - x["id"]) % 7 == 0, lambda *_: F.lit(True))
    plausible = lambda x, y: x["n"] * 5 >= y["n"] * 4
    found = {x.id: x.component for x in _links.classes(members, verify, info, "test", similarity=0.8, plausible=plausible, at_once=at_once).collect()}
    last = asked[-1:]
    want = {x.id: x.component for x in _links.classes(members, lambda p: p.where("(b - a) % 7 = 0"), info, "test", similarity=0.8, plausible=plausible).collect()}
    assert found == want and len(want) > 900
    # heads aside, pairs are those of the small bucket and of the long members
    heads = {1: 1000, 2: 2000, 3: 3000}
    assert last and all(a in heads.values() or a // 1000 == 2 or max(length[a], length[b]) > 50 for a, b in asked)
