"""Motif format converters: parse one text form, write another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources import readers as r
from seqloom.sources import writers as w


def _columns():
    return F.col("matrix_id"), F.col("name"), F.col("counts")


def homer_to_jaspar(rows: DataFrame) -> DataFrame:
    """`(path, value)` texts to `(path, value)` texts, as the other converters."""
    return r.parse_homer(rows).select("path", w.jaspar_counts_text(*_columns()).alias("value"))


def homer_to_meme(rows: DataFrame) -> DataFrame:
    return r.parse_homer(rows).select("path", w.meme_text(*_columns()).alias("value"))


def jaspar_to_homer(rows: DataFrame, threshold: float) -> DataFrame:
    return r.parse_jaspar(rows).select("path", w.homer_text(*_columns(), threshold).alias("value"))


def meme_to_homer(rows: DataFrame, threshold: float) -> DataFrame:
    return r.parse_meme(rows).select("path", w.homer_text(*_columns(), threshold).alias("value"))
