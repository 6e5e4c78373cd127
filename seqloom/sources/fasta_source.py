"""FASTA files read by byte ranges, so that one file, and one record of any length, is read in several tasks.

A range returns its stretches of records. A header belongs to the range in which its line begins, which
reads on to the line's end; a range that begins within a header looks back to see that and skips the rest. The
number of headers in earlier ranges, a row per range, then tells which record a stretch belongs to, and
the lengths of earlier stretches of a record tell its place there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
_BACK = 1 << 12


@dataclass
class ByteRange(InputPartition):
    path: str
    number: int
    first: int
    last: int


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder; hidden ones and markers are left out."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def _begins_in_header(file, at: int) -> tuple[bool, bool]:
    """Whether the place lies within a line, and whether that line is a header."""
    if at == 0:
        return False, False
    end = at
    tail = b""
    while end > 0:
        begin = max(0, end - _BACK)
        tail = file.read_at(end - begin, begin) + tail
        cut = tail.rfind(b"\n")
        if cut >= 0:
            line = tail[cut + 1 :]
            return bool(line), line.startswith(b">")
        end = begin
    return True, tail.startswith(b">")


def stretches(file, size: int, first: int, last: int) -> Iterator[tuple[int, str | None, str]]:
    """`(record, header, letters)` of a byte range: record counts the headers met so far, letters before any have 0 and no header."""
    data = file.read_at(last - first, first)
    within, header = _begins_in_header(file, first)
    if header:
        cut = data.find(b"\n")
        if cut < 0:
            return
        data, within = data[cut + 1 :], False
    start = data.rfind(b"\n") + 1
    if data[start : start + 1] == b">" and not (within and start == 0):
        at = last
        while at < size and not data.endswith(b"\n"):
            more = file.read_at(min(_BACK, size - at), at)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            at += len(more)
    record, name, letters = 0, None, []
    for i, line in enumerate(data.split(b"\n")):
        if line.startswith(b">") and not (within and i == 0):
            if record or any(letters):
                yield record, name, b"".join(letters).decode("utf-8", "replace")
            record, name, letters = record + 1, line[1:].decode("utf-8", "replace").strip(), []
        else:
            letters.append(b"".join(line.split()))
    if record or any(letters):
        yield record, name, b"".join(letters).decode("utf-8", "replace")


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(p, i, a, min(size, a + self.bytes)) for p, size in _files(self.path) for i, a in enumerate(range(0, size, self.bytes))]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if part is None or not hasattr(part, "path"):  # no file
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        with fs.open_input_file(part.path) as file:
            for record, header, letters in stretches(file, file.size(), part.first, part.last):
                yield part.path, part.number, record, header, letters


class FastaSource(DataSource):
    """`spark.read.format("seqloom_fasta").option("rangeBytes", n).load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "seqloom_fasta"

    def schema(self) -> str:
        return "file string, range_no int, record int, header string, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def read_stretches(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`(file, record_no, range_no, header, seq)`: stretches with the number of their record in the file, 1 for the first; text before any header has 0."""
    spark.dataSource.register(FastaSource)
    rows = spark.read.format("seqloom_fasta").option("rangeBytes", range_bytes).load(path)
    before = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("file", "range_no").agg(F.max("record").alias("n")).select("file", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.join(heads, ["file", "range_no"]).select("file", (F.col("_before") + F.col("record")).alias("record_no"), "range_no", "header", "seq")


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`(file, record_no, seq_id, seq)` of every record, put together from its stretches; the id is the header's first word."""
    rows = read_stretches(spark, path, range_bytes).where("record_no > 0")
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "seq"))), lambda x: x["seq"]), "")
    whole = rows.groupBy("file", "record_no").agg(F.max("header").alias("header"), seq.alias("seq"))
    return whole.select("file", "record_no", F.regexp_extract("header", r"^(\S*)", 1).alias("seq_id"), "seq")


def read_genome_chunks(spark: SparkSession, path: str, size: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`chunk_contigs` of `read_genome`, with no contig in one row: `(chrom, chunk, offset, seq)`.

    One contig per file, named like it up to the first dot; headers are dropped, letters are upper case. A
    stretch is dealt to the chunks, and their overlaps, that it reaches into.
    """
    rows = read_stretches(spark, path, range_bytes).select(F.substring_index(F.substring_index("file", "/", -1), ".", 1).alias("chrom"), "record_no", "range_no", F.upper("seq").alias("seq"))
    order = Window.partitionBy("chrom").orderBy("range_no", "record_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = rows.select("chrom", "range_no", "record_no", F.length("seq").cast("long").alias("n"))
    places = lengths.select("chrom", "range_no", "record_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("at"))
    ends = lengths.groupBy("chrom").agg(F.sum("n").alias("whole"))
    pieces = rows.join(places, ["chrom", "range_no", "record_no"]).join(ends, "chrom")
    last = F.greatest(F.expr(f"(whole + {size} - 1) div {size} - 1"), F.lit(0))
    chunks = F.sequence(F.greatest(F.expr(f"(at - {size + overlap}) div {size}"), F.lit(0)), F.least(F.expr(f"(at + length(seq)) div {size}"), last))
    cut = pieces.select("chrom", "at", "seq", F.explode(chunks).alias("chunk"))
    first = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
    upto = F.least(F.col("chunk") * size + size + overlap - F.col("at"), F.length("seq"))
    cut = cut.withColumn("part", F.substring(F.col("seq"), (first + 1).cast("int"), F.greatest(upto - first, F.lit(0)).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return cut.groupBy("chrom", "chunk").agg(joined.alias("seq")).select("chrom", "chunk", (F.col("chunk") * size).alias("offset"), "seq")
