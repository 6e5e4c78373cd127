"""Sequences, contigs, intervals, motifs and features derived from the driver's whole tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.cut import cut, written
from seqloom.operators.gc import global_rank

#: name, matrix id, anchor and width of each motif of the library that is learnt from `documents`.
ANCHORS = [
    ("TALE1", "M1", "TA", 6),
    ("ETS/X (1)", "M2", "AG", 6),
    ("SEA", "M3", "GC", 4),
    ("NEAT", "M4", "CA", 8),
    ("TEA", "M5", "TC", 4),
    ("EAST", "M6", "AT", 5),
]
#: The widest motif.
WIDEST = max(w for *_, w in ANCHORS)
FEATURES = 64
#: Letters of a peak at least, and of a candidate.
SHORTEST, CANDIDATE = 10, 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(spark: SparkSession, sf_dir: str, kept: bytes, written: bytes, least: int = 0) -> DataFrame:
    """`(seq_ordinal, seq)`: of each text in upper case the letters `kept`, as they are `written`; with `least`, only sequences that long.

    The letters are ASCII, so texts are cut byte by byte: no byte of another character is one of them.
    """
    table, dropped = bytes.maketrans(kept, written), bytes(set(range(256)) - set(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_ordinal")
            seqs = pa.array([None if t is None else t.translate(table, dropped) for t in batch.column("text").to_pylist()], pa.binary())
            if least:
                long = pa.array([s is not None and len(s) >= least for s in seqs.to_pylist()], pa.bool_())
                ids, seqs = ids.filter(long), seqs.filter(long)
            yield pa.RecordBatch.from_arrays([ids, seqs.cast(pa.string())], ["seq_ordinal", "seq"])

    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_ordinal"), F.upper("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "seq_ordinal long, seq string")


def sequences(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """`(seq_ordinal, seq)`: the letters A, C, G, T of each document, and N for each Q."""
    return _letters(spark, sf_dir, b"ACGTQ", b"ACGTN", least)


def clean_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without N."""
    return _letters(spark, sf_dir, b"ACGT", b"ACGT")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(chrom, seq, size)` of the sequences of 1000 letters or more, named by their number.

    The texts are read once; the sequences are written, and what reads names and sizes doesn't read letters.
    """
    long = written(sequences(spark, sf_dir, 1000).withColumn("size", F.length("seq").cast("long")))
    return global_rank(long, ["seq_ordinal"]).select(F.concat(F.lit("chr"), F.col("_rank").cast("string")).alias("chrom"), "seq", "size")


def _intervals(spark: SparkSession, sf_dir: str, known: DataFrame | None, unknown: int) -> DataFrame:
    """Every event with a contig of `known`, `unknown` of all contigs' numbers beyond the last, and its size."""
    known = (contigs(spark, sf_dir) if known is None else known).select("chrom", "size")
    n = known.count()
    known = F.broadcast(known) if n <= 100_000 else known
    name = F.concat(F.lit("chr"), (F.col("user_id") % F.lit(max(n + unknown, 1)) + 1).cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", name.alias("chrom")).join(known, "chrom", "left")


def peaks(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """`(interval_id, chrom, st, en)` of every event, anywhere on its contig; some on an unknown one. known: `contigs`, where they are at hand."""
    e, size = F.col("event_id"), F.coalesce("size", F.lit(1000))
    st = e * 37 % size + 1
    return _intervals(spark, sf_dir, known, 1).select(e.alias("interval_id"), "chrom", st.alias("st"), (st + SHORTEST + e % 20).alias("en"))


def background_intervals(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """`(cand_id, chrom, st, en)` of every event."""
    e = F.col("event_id")
    st = e * 53 % (F.col("size") - CANDIDATE)
    return _intervals(spark, sf_dir, known, 0).select(e.alias("cand_id"), "chrom", st.alias("st"), (st + CANDIDATE).alias("en"))


def _anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(ANCHORS)], "motif_idx int, name string, matrix_id string, anchor string, width int")


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(motif_idx, pos, base, n)`: the letters at each place of the sites in a task's sequences, a site being an anchor that its motif's width of letters follows."""
    counts = np.zeros((len(ANCHORS), WIDEST, 5), np.int64)
    code = np.full(256, 4, np.uint8)
    code[list(b"ACGT")] = range(4)
    for batch in batches:
        ends = b"." * WIDEST  # no site goes on into the next sequence
        codes = code[np.frombuffer(ends.join([*(s for s in batch.column("seq").to_pylist() if s), b""]) + ends, np.uint8)]
        for i, (_, _, anchor, width) in enumerate(ANCHORS):
            a, b = code[list(anchor.encode())]
            at = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
            at = at[codes[at + width - 1] < 4] if len(at) else at
            for pos in range(width if len(at) else 0):
                counts[i, pos] += np.bincount(codes[at + pos], minlength=5)
    rows = np.argwhere(counts[:, :, :4])
    columns = [pa.array(rows[:, j].astype(np.int32)) for j in range(3)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[tuple(rows.T)])], ["motif_idx", "pos", "base", "n"])


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(motif_idx, name, matrix_id, counts)`: counts of the letters that follow each place of a motif's anchor, over all documents.

    Each task counts its own texts, so a row per motif, place and letter leaves it; the six rows are written once.
    """
    seqs = clean_sequences(spark, sf_dir).select(F.col("seq").cast("binary").alias("seq"))
    cells = seqs.mapInArrow(_followers, "motif_idx int, pos int, base int, n long")
    counts = [F.array(*(F.sum(F.when(F.expr(f"pos = {i} AND base = {b}"), F.col("n")).otherwise(0)).cast("double") for b in range(4))) for i in range(WIDEST)]
    rows = _anchors(spark).join(cells.groupBy("motif_idx").agg(F.array(*counts).alias("c")), "motif_idx", "left")
    none = F.array(*[F.array(*[F.lit(0.0)] * 4)] * WIDEST)
    return cut(rows.select("motif_idx", "name", "matrix_id", F.slice(F.coalesce("c", none), F.lit(1), F.col("width")).alias("counts")).coalesce(1))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(motif_idx, name, width, n)`: how many sites each motif was learnt from."""
    total = F.aggregate(F.col("counts")[0], F.lit(0.0), lambda a, x: a + x).cast("long")
    return motifs(spark, sf_dir).select("motif_idx", "name", F.size("counts").alias("width"), total.alias("n"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(motif_idx, cluster_id)`: motifs with an even and with an odd number of sites; those of five letters stay alone."""
    return _sites(spark, sf_dir).select("motif_idx", F.expr("CASE WHEN width = 5 THEN 100 + motif_idx ELSE CAST(n % 2 AS INT) END").alias("cluster_id"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(name, gene, family)` from the numbers of sites; one motif has none, and one name is no motif's."""
    known = _sites(spark, sf_dir).where("motif_idx <> 1").select("name", F.expr("concat('GENE_', n % 4)").alias("gene"), F.expr("CASE n % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Homeo' ELSE 'Basic (b)/zip' END").alias("family"))
    return known.unionByName(spark.createDataFrame([("ELSE", "GENE_E", "Other")], "name string, gene string, family string"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(key, label, x array<double>)`: all embedding values, and whether the label is odd."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") % 2).alias("label"), x.alias("x"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(label, score)`: a fixed logistic score, rounded to two decimals so that there are ties."""
    z = sum(F.col("x")[i] * w for i, w in enumerate((3.0, -2.0, 1.5, 4.0)))
    return features(spark, sf_dir).select("label", F.round(1 / (1 + F.exp(-z)), 2).alias("score"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def sql(body: str) -> str:
    """`body` after the same fixtures in SQL."""
    names = [(i, *a) for i, a in enumerate(ANCHORS)]
    return f"""
WITH seqs AS (SELECT doc_id AS seq_ordinal, regexp_replace(translate(upper(text), 'NQ', '-N'), '[^ACGTN]', '', 'g') AS seq FROM documents),
clean AS (SELECT doc_id AS seq_ordinal, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
contigs AS (SELECT concat('chr', row_number() OVER (ORDER BY seq_ordinal)) AS chrom, seq, length(seq) AS size FROM seqs WHERE length(seq) >= 1000),
known AS MATERIALIZED (SELECT chrom, size FROM contigs),
peaks AS MATERIALIZED (SELECT interval_id, chrom, st, st + {SHORTEST} + interval_id % 20 AS en FROM (SELECT event_id AS interval_id, e.chrom, event_id * 37 % coalesce(size, 1000) + 1 AS st
  FROM (SELECT event_id, concat('chr', user_id % ((SELECT count(*) FROM known) + 1) + 1) AS chrom FROM events) e LEFT JOIN known k ON k.chrom = e.chrom)),
cands AS MATERIALIZED (SELECT event_id AS cand_id, e.chrom, event_id * 53 % (size - {CANDIDATE}) AS st, event_id * 53 % (size - {CANDIDATE}) + {CANDIDATE} AS en
  FROM (SELECT event_id, concat('chr', user_id % greatest((SELECT count(*) FROM known), 1) + 1) AS chrom FROM events) e LEFT JOIN known k ON k.chrom = e.chrom),
ext AS (SELECT interval_id, chrom, st, en, concat(chrom, ':', st, '-', en) AS seq_id, substr(seq, st, en - st) AS seq FROM peaks JOIN contigs USING (chrom) WHERE substr(seq, st, en - st) <> ''),
gcs AS (SELECT *, length(seq) - length(replace(seq, 'G', '')) + length(seq) - length(replace(seq, 'C', '')) AS n_gc FROM ext),
binned AS (SELECT *, round(n_gc / length(seq), 6) AS gc, ntile(10) OVER (ORDER BY round(n_gc / length(seq), 6), interval_id) AS bin FROM gcs),
motifs(motif_idx, name, matrix_id, anchor, width) AS (VALUES {_values(names)}),
sites AS (SELECT substr(seq, p, {WIDEST}) AS site, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq))) AS p FROM clean) GROUP BY site),
sited AS MATERIALIZED (SELECT motif_idx, site, n FROM sites JOIN motifs ON substr(site, 1, 2) = anchor AND length(site) >= width),
cells AS MATERIALIZED (
  SELECT motif_idx, CAST(pos AS INTEGER) AS pos, base, CAST(coalesce(sum(n) FILTER (WHERE substr(site, pos + 1, 1) = base), 0) AS DOUBLE) AS value
  FROM (SELECT motif_idx, unnest(range(width)) AS pos FROM motifs) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) LEFT JOIN sited USING (motif_idx) GROUP BY motif_idx, pos, base),
learnt AS (SELECT motif_idx, name, width, CAST(sum(value) AS BIGINT) AS n FROM cells JOIN motifs USING (motif_idx) WHERE pos = 0 GROUP BY ALL),
clusters AS (SELECT motif_idx, CASE WHEN width = 5 THEN 100 + motif_idx ELSE CAST(n % 2 AS INTEGER) END AS cluster_id FROM learnt),
metadata AS (SELECT name, concat('GENE_', n % 4) AS gene, CASE n % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Homeo' ELSE 'Basic (b)/zip' END AS family FROM learnt WHERE motif_idx <> 1
  UNION ALL SELECT 'ELSE', 'GENE_E', 'Other'),
pc AS (SELECT motif_idx, floor(0.25 * sqrt(sum(value) / (max(pos) + 1))) AS pc FROM cells GROUP BY motif_idx),
pwm AS (SELECT motif_idx, pos, base, (value + pc) / sum(value + pc) OVER (PARTITION BY motif_idx, pos) AS p FROM cells JOIN pc USING (motif_idx)),
plain AS (SELECT motif_idx, pos, base, value / sum(value) OVER (PARTITION BY motif_idx, pos) AS p FROM cells),
plain2 AS (SELECT motif_idx, pos, base, p / sum(p) OVER (PARTITION BY motif_idx, pos) AS p FROM (SELECT motif_idx, pos, base, CAST(printf('%.6f', p) AS DOUBLE) AS p FROM plain)),
pssm AS (SELECT motif_idx, pos, base, CASE WHEN p <= 0 THEN CAST('-inf' AS DOUBLE) ELSE log2(p / 0.25) END AS s FROM pwm),
feats AS (SELECT vec_id AS key, label % 2 AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
scores AS (SELECT label, round(1 / (1 + exp(-(x[1] * 3.0 + x[2] * -2.0 + x[3] * 1.5 + x[4] * 4.0))), 2) AS score FROM feats)
{body}
"""


#: Every window's score, per strand: base s at position k of the forward matrix, of the reverse one its mirror.
SCAN_SQL = """,
letters AS (SELECT seq_ordinal, unnest(range(length(seq))) AS place, seq FROM {source} WHERE seq <> ''),
bases AS (SELECT seq_ordinal, place, substr(seq, place + 1, 1) AS base, length(seq) AS n FROM letters),
both_strands AS (
  SELECT motif_idx, '+' AS strand, pos, base, s FROM pssm
  UNION ALL SELECT motif_idx, '-', width - 1 - pos, translate(base, 'ACGT', 'TGCA'), s FROM pssm JOIN motifs USING (motif_idx)),
windows AS (
  SELECT seq_ordinal, motif_idx, strand, b.place - c.pos AS start, count(*) AS known, round(sum(s), 6) AS score
  FROM bases b JOIN both_strands c ON c.base = b.base JOIN motifs m USING (motif_idx)
  WHERE b.place - c.pos >= 0 AND b.place - c.pos + m.width <= b.n
  GROUP BY ALL),
best AS (
  SELECT seq_ordinal, motif_idx, strand, max(score) AS score, arg_min(start, struct_pack(a := -score, b := start)) AS start
  FROM windows JOIN motifs USING (motif_idx) WHERE known = width GROUP BY ALL),
pairs AS (
  SELECT q.seq_ordinal, m.motif_idx, length(q.seq) < m.width AS short, contains(q.seq, 'N') AS has_n,
         f.score AS fs, f.start AS fp, r.score AS rs, r.start AS rp
  FROM {source} q CROSS JOIN motifs m
  LEFT JOIN best f ON f.seq_ordinal = q.seq_ordinal AND f.motif_idx = m.motif_idx AND f.strand = '+'
  LEFT JOIN best r ON r.seq_ordinal = q.seq_ordinal AND r.motif_idx = m.motif_idx AND r.strand = '-'),
hits AS (
  SELECT seq_ordinal, motif_idx,
    CASE WHEN short THEN NULL WHEN {use} THEN CASE WHEN fs > rs THEN fs ELSE rs END ELSE 0.0 END AS score,
    CASE WHEN short THEN NULL WHEN {use} THEN CASE WHEN fs > rs THEN fp ELSE rp END ELSE -1 END AS start,
    CASE WHEN short THEN NULL WHEN {use} THEN CASE WHEN fs > rs THEN '+' ELSE '-' END ELSE '?' END AS strand
  FROM pairs)
"""


def scan_sql(body: str, source: str = "seqs", poison: bool = True) -> str:
    use = "(coalesce(fs, 0) > 0 OR coalesce(rs, 0) > 0)" + (" AND NOT has_n" if poison else "")
    return sql("SELECT 1").replace("SELECT 1\n", SCAN_SQL.format(source=source, use=use) + body)
