import hashlib
import random

from seqloom.llm import warc
from seqloom.llm._scratch import new_path
from seqloom.llm.queries import op7_warc


def expected(rows):
    """Brute force: (page, payload length, digest, type, refers_to) of (page, html) rows."""
    first, out = {}, []
    for page, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    for page, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        revisit = page is not None and refers is not None and refers < page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


def test_loser_tree_merges():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted((r.randrange(20), i) for _ in range(r.randrange(12))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_whole_table(spark, sf):
    rows = [(x.page_id, x.html) for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op7_warc(spark, sf).collect()), key=str) == expected(rows)


def test_index_is_globally_ordered_and_revisits_resolve(spark):
    r = random.Random(7)
    body = ["é" * 60, "x" * 99, "y" * 100, "", None]
    rows = [(i, f"https://{r.choice('ab')}.Example.org/{r.choice(['', 'p q', 'z?x=1'])}", r.choice(body), "extra") for i in range(300)]
    rows += [(None, None, "y" * 100, ""), (5, "http://b.example.org/", "y" * 100, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(6)
    folder = new_path(spark, "warc")
    runs = warc.write_archives(df, folder, archive_bytes=5000, run_rows=20, range_rows=40)
    index = sorted(warc.merge_index(runs).collect(), key=lambda x: (x.range_no, x.ordinal))
    keys = [(x.url_key, x.ts, -1 if x.page_id is None else x.page_id) for x in index]
    assert keys == sorted(keys) and len(keys) == len(rows) and len({x.path for x in index}) > 6
    got = warc.read_archives(warc.merge_index(runs), folder, with_payload=True).collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == expected([x[0:3:2] for x in rows])
    assert all((x.record_type == "revisit") == (not x.payload and x.payload_bytes > 0) for x in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    runs = warc.write_archives(df, folder)
    assert warc.read_archives(warc.merge_index(runs), folder).count() == 0
