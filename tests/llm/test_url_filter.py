import random
import re

import duckdb

from seqloom.llm import url_filter
from seqloom.llm.queries import ORACLE_SQL, op10_url_filter


def patterns(url):
    m = re.match(r"\w+://([^/:?#]*)", url or "")
    if not m or not m[1]:
        return []
    labels = m[1].lower().split(".")
    path = re.match(r"\w+://[^/?#]*(/[^?#]*)?", url)[1] or ""
    segments = [s for s in path.split("/") if s]
    return [".".join(labels[-i:]) for i in range(1, len(labels) + 1)] + [".".join(labels) + "/" + "/".join(segments[:i]) for i in range(1, len(segments) + 1)]


def brute(url, time, entries):
    best = (None, None, None)
    for p in patterns(url) if time is not None else []:
        before = [(s, a or "remove") for q, a, s in entries if q == p and s is not None and s <= time]
        if before and max(before)[1] != "remove":
            best = (p, *max(before))
    return best


def test_equals_brute_force(spark):
    r = random.Random(9)
    hosts = ["a.example.org", "B.example.org", "example.org", "x.net"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p", "/p/q?z=1", ":80/p//q#t")] + ["nothing", "http:///p", None]
    keys = sorted({k for u in urls for k in patterns(u)})
    entries = [(r.choice(keys), r.choice(["block", "allow", "remove", None]), r.randrange(0, 1000)) for _ in range(150)] + [(None, "block", 1), ("org", "block", None)]
    captures = [(i, r.choice(urls), r.choice([None, *range(0, 1200, 7)]), "was") for i in range(400)]
    captures.append(captures[0])
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at long, action string")
    listed = spark.createDataFrame(entries, "pattern string, action string, since long")
    for period in (50, 10_000):
        got = url_filter.evaluate_captures(df, listed, period=period).collect()
        want = [(i, u, t, *brute(u, t, entries)) for i, u, t, _ in captures]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.evaluate_captures(df.limit(0), listed).count() == 0
    assert url_filter.evaluate_captures(df, listed.limit(0)).where("action IS NOT NULL").count() == 0


def test_whole_table_equals_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rows = op10_url_filter(spark, sf)
    want = db.sql(ORACLE_SQL["op10_url_filter"])
    assert rows.columns == want.columns
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want.fetchall()))
