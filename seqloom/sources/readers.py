"""Readers of intervals, genomes, sequences, motifs and result tables; all lazy and splittable by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import file_root


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """`(interval_id, chrom, st, en)` of white-space separated rows; lines that begin with # are skipped.

    interval_id follows file and line order but isn't dense. Rows with too few columns are dropped.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("NOT startswith(value, '#')").select(F.monotonically_increasing_id().alias("interval_id"), parts.alias("p")).where("size(p) >= 3")
    return rows.select("interval_id", F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("st"), F.col("p")[2].cast("long").alias("en"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """`(chrom, seq, size)`: one contig per file, named like it; the header line is dropped, letters are upper case."""
    rows = spark.read.text(path, wholetext=True).select(file_root(F.input_file_name()).alias("chrom"), F.regexp_replace("value", "^[^\n]*\n?", "").alias("body"))
    rows = rows.select("chrom", F.upper(F.regexp_replace("body", r"\s", "")).alias("seq"))
    return rows.withColumn("size", F.length("seq").cast("long"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """`(seq_ordinal, seq_id, seq)` of every record; the id is the header's first word."""
    rows = spark.read.text(path, lineSep=">").where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("seq_ordinal"), "value")
    head = F.regexp_extract("value", r"^\s*(\S*)[^\n]*", 1)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), r"\s", "")
    return rows.select("seq_ordinal", head.alias("seq_id"), body.alias("seq"))


def _numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(r"[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+"), F.lit(0)), lambda x: x.cast("double"))


def _indexed(rows: DataFrame) -> DataFrame:
    """Adds `motif_idx` in the order of the paths; libraries are a few thousand motifs."""
    from pyspark.sql import Window

    return rows.withColumn("motif_idx", F.row_number().over(Window.orderBy("path")) - 1)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))


def _named(header: Column) -> tuple[Column, Column]:
    """Matrix id and name of a `>id name` header; the name is the rest of the line, or the id."""
    matrix_id, name = (F.regexp_extract(header, r"^>\s*(\S*)\s*(.*?)\s*$", i) for i in (1, 2))
    return matrix_id, F.when(name == "", matrix_id).otherwise(name)


def parse_jaspar(rows: DataFrame) -> DataFrame:
    """`(path, matrix_id, name, counts)` of `(path, value)`: a header and one line per base, brackets or not."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    found = rows.select("path", lines.alias("l"))
    matrix_id, name = _named(F.col("l")[0])
    base = lambda i: _numbers(F.regexp_replace(F.col("l")[i], "^[ACGT]", ""))
    cells = found.select("path", matrix_id.alias("matrix_id"), name.alias("name"), F.arrays_zip(base(1).alias("a"), base(2).alias("c"), base(3).alias("g"), base(4).alias("t")).alias("z"))
    return cells.select("path", "matrix_id", "name", F.transform("z", lambda x: F.array(x["a"], x["c"], x["g"], x["t"])).alias("counts"))


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """`(motif_idx, path, matrix_id, name, counts)`, one motif per file, in the order of the paths."""
    return _indexed(parse_jaspar(_whole(spark, path)))


def parse_homer(rows: DataFrame) -> DataFrame:
    """`(path, matrix_id, name, threshold, counts)`: a tabbed header and one row of four numbers per position."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    head = F.split(F.regexp_replace(F.col("l")[0], "^>", ""), "\t")
    rows = rows.select("path", lines.alias("l"))
    return rows.select(
        "path",
        F.trim(head[0]).alias("matrix_id"),
        F.trim(F.coalesce(F.get(head, F.lit(1)), head[0])).alias("name"),
        F.expr("try_cast(get(split(regexp_replace(l[0], '^>', ''), '\t'), 2) AS double)").alias("threshold"),
        F.transform(F.slice("l", F.lit(2), F.size("l") - 1), _numbers).alias("counts"),
    )


def read_homer(spark: SparkSession, path: str) -> DataFrame:
    return _indexed(parse_homer(_whole(spark, path)))


def parse_meme(rows: DataFrame) -> DataFrame:
    """`(path, matrix_id, name, counts)`: the MOTIF line's name and id, and the rows after the matrix header with more than one number."""
    motif = F.split(F.trim(F.regexp_extract("value", r"(?m)^MOTIF[ \t]+(.*)$", 1)), r"\s+")
    body = F.regexp_extract("value", r"(?s)letter-probability matrix[^\n]*\n(.*)", 1)
    cells = F.filter(F.transform(F.split(body, "\n"), _numbers), lambda x: F.size(x) > 1)
    return rows.select("path", F.coalesce(F.get(motif, F.lit(1)), motif[0]).alias("matrix_id"), motif[0].alias("name"), cells.alias("counts"))


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    return _indexed(parse_meme(_whole(spark, path)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """`(seq_id, motif, score)` of a wide table whose first column is the sequence id."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *motifs = wide.columns
    cast = wide.select(F.col(f"`{first}`").alias("seq_id"), *(F.col(f"`{m}`").cast("double").alias(m) for m in motifs))
    return cast.unpivot("seq_id", [f"`{m}`" for m in motifs], "motif", "score")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """`(seq_id, label)`: "1" is 1, all else 0."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("seq_id"), (parts[1] == "1").cast("int").alias("label"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """`(name, gene, family)` of a table with the header Name, Gene, Family."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("Name").alias("name"), F.col("Gene").alias("gene"), F.col("Family").alias("family"))


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """`(name_i, name_j, r)` of a square table with names on both axes."""
    long = read_features(spark, path)
    return long.select(F.col("seq_id").alias("name_i"), F.col("motif").alias("name_j"), F.col("score").alias("r"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """`(motif, iteration, value)` of a motif x iteration table."""
    long = read_features(spark, path)
    return long.select(F.col("seq_id").alias("motif"), F.col("motif").alias("iteration"), F.col("score").alias("value"))
