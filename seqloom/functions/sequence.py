"""String functions on nucleotide sequences and names; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_count(seq: Column, letter: str) -> Column:
    """How often a letter occurs."""
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter)))


def gc_count(seq: Column) -> Column:
    return letter_count(seq, "G") + letter_count(seq, "C")


def gc_content(seq: Column) -> Column:
    """Share of G and C; N counts as a letter, an empty sequence has none (null)."""
    return F.try_divide(gc_count(seq).cast("double"), F.length(seq).cast("double"))


def normalize_sequence(text: Column) -> Column:
    """Upper case; letters other than A, C, G, T and N are dropped."""
    return F.regexp_replace(F.upper(text), "[^ACGTN]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def interval_id(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def start_text(start: Column, strand: Column) -> Column:
    """`<start> <strand>`, the text form of a match's place."""
    return F.concat_ws(" ", start.cast("string"), strand)


def safe_name(name: Column) -> Column:
    """A name fit for files: no slash; blanks and brackets become underscores; one pass over doubled ones."""
    out = F.replace(name, F.lit("/"))
    for c in " ()":
        out = F.replace(out, F.lit(c), F.lit("_"))
    return F.replace(out, F.lit("__"), F.lit("_"))


def file_root(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def usable_contig(chrom: Column) -> Column:
    """False for unplaced, random and alternative contigs."""
    return ~chrom.rlike("chrUn|random|alt")
