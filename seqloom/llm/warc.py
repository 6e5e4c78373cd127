"""Web archives with a globally ordered capture index.

Tasks write gzipped WARC records into archive files of bounded size and sort the captures of each
bounded run by URL key, time and page. A run is cut at range boundaries that hold for all runs; the
segments of a range are then merged by a loser tree, so ranges in order, and captures in order
within each, are the ordered index. Archives are read back from the index, file by file.

Boundaries come from a sample of keys and only balance the ranges. Files go to a folder that all
executors share; their names hold the task attempt, and only what a finished attempt returned is
ever read, so a lost executor leaves at most unused files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import small, table

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20
RUN_ROWS = 50_000
RANGE_ROWS = 200_000
SAMPLES_PER_RANGE = 20
_ENTRY = pa.struct(
    [("url_key", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_ENTRY_SQL = "struct<url_key:string,ts:timestamp,page_id:bigint,path:string,offset:bigint,length:bigint>"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then the rest in lower case."""
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/:?#]*)", 1))
    rest = F.regexp_replace(url, r"^\w+://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest))


class LoserTree:
    """Merges sorted iterables; equal heads come out in the order of the iterables."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        winners = [0] * k + list(range(k))
        self.losers = [0] * max(1, k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.losers[0] = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        k = len(self.runs)
        while True:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + k) // 2
            while node:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page}/{digest}'.encode()).hexdigest()[:32])}>"


def _line(value: str) -> str:
    """A header's value: controls and spaces percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def warc_record(page, url: str | None, when: datetime, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit has the HTTP head of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {when.strftime('%Y-%m-%dT%H:%M:%S.%f')}Z",
        f"WARC-Target-URI: {_line(url) if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page is None else [f"X-Page-Id: {page}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Page, type, reference, payload length and payload digest of one gzip member; a response's are taken from its payload."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("damaged record")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "payload": payload,
    }


def _written(folder: str, bounds: list[tuple], archive_bytes: int, run_rows: int):
    schema = pa.schema([("range_no", pa.int32()), ("run", pa.string()), ("entries", pa.list_(_ENTRY))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:12]}"
        out, path, at, files, runs = None, "", 0, 0, 0
        held: list[tuple] = []

        def sorted_run() -> pa.RecordBatch:
            nonlocal runs
            held.sort(key=lambda e: e[:3])
            parts: dict[int, list[dict]] = {}
            for key, ts, page, *where in held:
                parts.setdefault(bisect_right(bounds, (key, ts, page)), []).append(
                    dict(zip(("url_key", "ts", "page_id", "path", "offset", "length"), (key, ts, None if page == _NO_PAGE else page, *where), strict=True))
                )
            held.clear()
            rows = [{"range_no": r, "run": f"{name}-{runs:06d}", "entries": e} for r, e in parts.items()]
            runs += 1
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        try:
            for batch in batches:
                for page, url, key, ts, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "url_key", "ts", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, at = f"{root}/{name}-{files:05d}.warc.gz", 0
                        out, files = fs.open_output_stream(path, compression=None), files + 1
                    data = warc_record(page, url, ts, html.encode(), digest, refers)
                    out.write(data)
                    held.append((key, ts, _NO_PAGE if page is None else page, path, at, len(data)))
                    at += len(data)
                    if len(held) >= run_rows:
                        yield sorted_run()
        finally:
            if out is not None:
                out.close()
        if held:
            yield sorted_run()

    return run


_NO_PAGE = -(1 << 63)


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    page_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ts_col: str | None = None,
    least_payload: int = LEAST_PAYLOAD,
    archive_bytes: int = ARCHIVE_BYTES,
    run_rows: int = RUN_ROWS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Writes a record per row below `folder` and returns the sorted runs `(range_no, run, entries)`.

    Of rows whose payloads are equal and of `least_payload` bytes or more, those with the least page
    id are responses, the others revisits of it. A null html is an empty payload, a null url an
    unknown one; rows with a null page id are responses. Without ts_col, or where it is null, the
    capture time is the page id in seconds from 2024-01-01. No rows give no archives.
    """
    spark = pages.sparkSession
    page = F.col(page_col).cast("long")
    derived = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(1 << 32)))
    captures = pages.select(
        page.alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(url_key(F.col(url_col).cast("string")), F.lit("")).alias("url_key"),
        (F.coalesce(F.col(ts_col).cast("timestamp"), derived) if ts_col else derived).alias("ts"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    keys = table(captures.select("page_id", "url_key", "ts", "digest", F.octet_length("html").alias("bytes")), "captures")
    firsts = keys.where(F.col("bytes") >= least_payload).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    revisits = table(keys.where(F.col("bytes") >= least_payload).join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")

    n = keys.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))
    every = max(1, n // (SAMPLES_PER_RANGE * ranges))
    sample = keys.where(F.pmod(F.xxhash64("url_key", "ts", "page_id"), F.lit(every)) == 0).select("url_key", F.unix_micros("ts").alias("us"), "page_id")
    rows = sorted((r[0], datetime.fromtimestamp(r[1] / 1e6, UTC), _NO_PAGE if r[2] is None else r[2]) for r in sample.collect())
    bounds = sorted({rows[i * len(rows) // ranges] for i in range(1, ranges)}) if rows else []
    out = captures.join(small(revisits, revisits.count()), ["page_id", "digest"], "left").select("page_id", "url", "url_key", "ts", "html", "digest", "refers_to")
    return table(out.mapInArrow(_written(folder, bounds, archive_bytes, run_rows), f"range_no int, run string, entries array<{_ENTRY_SQL}>"), "runs")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("range_no", pa.int32()), ("ordinal", pa.int64()), *_ENTRY])
    now, runs = None, []

    def entries(segment) -> Iterator[tuple]:
        for e in segment:
            e = e.as_py()
            yield e["url_key"], e["ts"], _NO_PAGE if e["page_id"] is None else e["page_id"], e["path"], e["offset"], e["length"]

    def merged() -> Iterator[pa.RecordBatch]:
        rows = []
        for i, (key, ts, page, *where) in enumerate(LoserTree([entries(r) for r in runs])):
            rows.append(dict(zip(schema.names, (now, i, key, ts, None if page == _NO_PAGE else page, *where), strict=True)))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for number, segment in zip(batch.column("range_no").to_pylist(), batch.column("entries"), strict=True):
            if number != now:
                if runs:
                    yield from merged()
                now, runs = number, []
            runs.append(segment.values)
    if runs:
        yield from merged()


def merge_index(runs: DataFrame) -> DataFrame:
    """The index ordered by `(range_no, ordinal)`, which is the order of URL key, time and page:
    `(range_no, ordinal, url_key, ts, page_id, path, offset, length)`."""
    columns = "range_no int, ordinal long, url_key string, ts timestamp, page_id long, path string, offset long, length long"
    return runs.repartition("range_no").sortWithinPartitions("range_no", "run").mapInArrow(_merged, columns)


def _read(folder: str, with_payload: bool):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        try:
            for batch in batches:
                rows, size = [], 0
                for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                    if path != name:
                        if file is not None:
                            file.close()
                        name, file = path, fs.open_input_file(path)
                    record = parse_record(file.read_at(length, at))
                    size += len(record["payload"]) * with_payload
                    rows.append({k: record[k] for k in schema.names})
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if file is not None:
                file.close()

    return run


def read_archives(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """`(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])` of each index entry, read from the archives."""
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    ordered = index.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(_read(folder, with_payload), columns)
