"""Motif matches over a stream of sequences: the scan keeps no state, so it is the batch operator on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.scan import scan_top


def stream_matches(seqs: DataFrame, motifs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the best match of every motif in every arriving sequence to Parquet."""
    return scan_top(seqs, motifs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
