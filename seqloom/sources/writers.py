"""Writers and text forms of sequences, motifs and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.matrix import normalize_columns

MEME_HEAD = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"


def fasta_text(seq_id: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), seq)


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(fasta_text(F.col("seq_id"), F.col("seq")).alias("value")).write.text(path)


def write_bed(intervals: DataFrame, path: str) -> None:
    intervals.select("chrom", F.col("st").cast("string"), F.col("en").cast("string")).write.csv(path, sep="\t")


def write_wide(long: DataFrame, key: str, column: str, value: str, path: str) -> None:
    """A tab-separated table with one column per distinct `column` (motifs or iterations), one row per key."""
    long.groupBy(key).pivot(column).agg(F.first(value)).write.csv(path, sep="\t", header=True)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", header=True)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Score tracks as Parquet, a folder per motif."""
    tracks.write.partitionBy("motif_idx").parquet(path)


def _row(numbers: Column, form: str) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.format_string(form, x)), " ")


def _by_base(matrix: Column, base: int) -> Column:
    return F.transform(matrix, lambda col: col[base])


def jaspar_text(matrix_id: Column, name: Column, counts: Column) -> Column:
    """A header and a bracketed line per base, two decimals."""
    lines = [F.concat(F.lit(f"{b} ["), _row(_by_base(counts, i), "%6.2f"), F.lit("]")) for i, b in enumerate("ACGT")]
    return F.concat_ws("\n", F.concat(F.lit(">"), matrix_id, F.lit(" "), name), *lines)


def jaspar_counts_text(matrix_id: Column, name: Column, pwm: Column) -> Column:
    """Frequencies as whole counts of ten thousand, cut off."""
    whole = lambda i: F.array_join(F.transform(_by_base(pwm, i), lambda x: F.floor(x * 10000 + 1e-9).cast("long").cast("string")), " ")
    lines = [F.concat(F.lit(f"{b} [ "), whole(i), F.lit(" ]")) for i, b in enumerate("ACGT")]
    return F.concat_ws("\n", F.concat(F.lit(">"), matrix_id, F.lit("\t"), name), *lines)


def homer_text(matrix_id: Column, name: Column, counts: Column, threshold: float) -> Column:
    """A tabbed header with the threshold, and a normalised row per position."""
    rows = F.transform(normalize_columns(counts), lambda col: F.array_join(F.transform(col, lambda x: F.format_string("%.6f", F.bround(x, 6))), "\t"))
    return F.concat(F.concat_ws("\t", F.concat(F.lit(">"), matrix_id), name, F.lit(str(threshold))), F.lit("\n"), F.array_join(rows, "\n"))


def meme_text(matrix_id: Column, name: Column, pwm: Column) -> Column:
    rows = F.transform(pwm, lambda col: F.array_join(F.transform(col, lambda x: F.format_string("%.6f", F.bround(x, 6))), "\t"))
    head = F.format_string("letter-probability matrix: alength= 4 w= %d nsites= 20 E= 0", F.size(pwm))
    return F.concat(F.lit(MEME_HEAD + "\nMOTIF "), name, F.lit(" "), matrix_id, F.lit("\n\n"), head, F.lit("\n"), F.array_join(rows, "\n"))


def write_motifs(motifs: DataFrame, text: Column, path: str) -> None:
    """One text record per motif."""
    motifs.select(text.alias("value")).write.text(path, lineSep="\n\n")


def write_motif_list(listed: DataFrame, path: str) -> None:
    """The `motif_list` of a library as two tables in its order: names with ids, without a header, and names with genes and families."""
    ordered = listed.repartitionByRange("place").sortWithinPartitions("place")
    ordered.select("name", "matrix_id").write.csv(f"{path}/list", sep="\t")
    ordered.select(F.col("name").alias("Name"), F.col("gene").alias("Gene"), F.col("family").alias("Family")).write.csv(f"{path}/metadata", sep="\t", header=True)
