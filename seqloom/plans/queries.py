"""The registered queries of the sequence and motif operators, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import matrix as m
from seqloom.functions import sequence as s
from seqloom.operators import align, background, cluster, gc, intervals, learn, scan
from seqloom.operators.cut import written
from seqloom.plans import fixtures as fx
from seqloom.plans.fixtures import scan_sql, sql
from seqloom.plans.pipelines import peaks_vs_background, peaks_vs_peaks, with_pssm
from seqloom.sources import convert, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pssm(fx.motifs(spark, sf_dir))


def _cells(rows: DataFrame, column: str, value: str) -> DataFrame:
    """One row per motif, position and base."""
    long = rows.select("motif_idx", F.posexplode(column).alias("pos", "c"))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col("c")[i].alias(value)) for i, b in enumerate("ACGT"))))
    return long.select("motif_idx", "pos", each.alias("e")).select("motif_idx", "pos", "e.base", F.round(f"e.{value}", 6).alias(value))


def _ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = fx.contigs(spark, sf_dir)
    return intervals.extract_sequences(fx.peaks(spark, sf_dir, contigs), contigs)


# sequences and intervals


@query(sql("SELECT seq_ordinal, seq FROM seqs"))
def seq_normalize(spark, sf_dir):
    return fx.sequences(spark, sf_dir)


@query(sql("SELECT seq_ordinal, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seqs"))
def reverse_complement(spark, sf_dir):
    return fx.sequences(spark, sf_dir).select("seq_ordinal", s.reverse_complement(F.col("seq")).alias("seq"))


_NAMED = "concat(chrom, CASE size % 4 WHEN 0 THEN '_random' WHEN 1 THEN '_alt' ELSE '' END)"


@query(sql(f"SELECT {_NAMED} AS chrom, size FROM contigs WHERE NOT regexp_matches({_NAMED}, 'chrUn|random|alt')"))
def contig_filter(spark, sf_dir):
    return intervals.filter_contigs(fx.contigs(spark, sf_dir).select(F.expr(_NAMED).alias("chrom"), "size"))


@query(sql("SELECT chrom, size FROM contigs WHERE chrom NOT IN ('chr1', 'chr7')"))
def chrom_exclude(spark, sf_dir):
    return intervals.filter_contigs(fx.contigs(spark, sf_dir).select("chrom", "size"), ("chr1", "chr7"))


@query(sql("SELECT interval_id, chrom, st, en, seq_id, seq FROM ext"))
def extract_sequences(spark, sf_dir):
    return _ext(spark, sf_dir)


@query(sql("SELECT interval_id, chrom, st, en, seq_id, seq FROM ext"))
def extract_from_chunks(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return intervals.extract_from_chunks(fx.peaks(spark, sf_dir, contigs), intervals.chunk_contigs(contigs, 400, 200), 400, 200)


@query(
    sql("""SELECT * FROM (SELECT interval_id, p.chrom, st, en, CASE WHEN size IS NULL THEN 'unknown contig' WHEN st < 1 OR en <= st THEN 'bad coordinates'
  WHEN st > size THEN 'beyond the end' END AS reason FROM peaks p LEFT JOIN contigs c ON c.chrom = p.chrom) WHERE reason IS NOT NULL""")
)
def extract_rejects(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return intervals.extraction_rejects(fx.peaks(spark, sf_dir, contigs), contigs)


@query(sql("SELECT concat('>', seq_id, chr(10), seq) AS record FROM ext"))
def fasta_records(spark, sf_dir):
    return _ext(spark, sf_dir).select(writers.fasta_text(F.col("seq_id"), F.col("seq")).alias("record"))


@query(sql("SELECT interval_id, round(n_gc / length(seq), 6) AS gc FROM gcs"))
def gc_content(spark, sf_dir):
    return gc.with_gc(_ext(spark, sf_dir)).select("interval_id", "gc")


@query(sql("SELECT interval_id, gc, CAST(bin AS INTEGER) AS bin FROM binned"))
def gc_bins(spark, sf_dir):
    return gc.gc_bins(_ext(spark, sf_dir)).select("interval_id", "gc", "bin")


@query(sql("SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round((sum(n_gc) + 0.1) / (sum(length(seq)) + 0.1), 6) AS bin_gc FROM binned GROUP BY bin"))
def gc_bin_profile(spark, sf_dir):
    return gc.bin_profile(gc.gc_bins(_ext(spark, sf_dir)))


@query(sql("SELECT min(gc) AS min_gc, max(gc) AS max_gc, round((max(gc) - min(gc)) / 20, 6) AS tolerance FROM binned"))
def gc_tolerance(spark, sf_dir):
    return gc.gc_tolerance(_ext(spark, sf_dir))


@query(sql("SELECT CAST(bin AS INTEGER) AS bin, round(sum(n_gc) / (sum(length(seq)) + 1e-7), 6) AS background_gc, count(*) AS n FROM binned GROUP BY bin"))
def background_gc_report(spark, sf_dir):
    return gc.background_report(gc.gc_bins(_ext(spark, sf_dir)))


@query(sql("SELECT CAST(floor(sum(length(seq)) / count(*)) AS BIGINT) AS mean_len FROM ext"))
def mean_target_length(spark, sf_dir):
    return gc.mean_length(_ext(spark, sf_dir))


@query(sql("SELECT seq_ordinal FROM seqs WHERE length(seq) - length(replace(seq, 'N', '')) <= 1"))
def n_fraction_filter(spark, sf_dir):
    return gc.few_ns(fx.sequences(spark, sf_dir), 0.01, 100).select("seq_ordinal")


_OVERLAP = "p.chrom = c.chrom AND c.st < p.en AND c.en > p.st - 1"


@query(sql(f"SELECT cand_id, chrom, st, en FROM cands c WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE {_OVERLAP})"))
def overlap_anti_join(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return intervals.without_overlap(fx.background_intervals(spark, sf_dir, contigs), fx.peaks(spark, sf_dir, contigs))


@query(sql(f"SELECT c.cand_id, count(p.interval_id) AS overlaps FROM cands c LEFT JOIN peaks p ON {_OVERLAP} GROUP BY c.cand_id"))
def overlap_count(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return intervals.overlap_counts(fx.background_intervals(spark, sf_dir, contigs), fx.peaks(spark, sf_dir, contigs))


@query(sql(f"SELECT c.cand_id, p.interval_id FROM cands c JOIN peaks p ON {_OVERLAP}"))
def overlap_pairs(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return intervals.overlap_pairs(fx.background_intervals(spark, sf_dir, contigs), fx.peaks(spark, sf_dir, contigs))


_DRAW = "CAST(concat('0x', substr(md5(concat('3:0:{}:', id)), 1, 12)) AS BIGINT)"


@query(
    sql(f"""SELECT id AS cand_id, chrom, {_DRAW.format("start")} % (size - 75) AS st, {_DRAW.format("start")} % (size - 75) + 75 AS en
FROM (SELECT unnest(range(2000)) AS id) JOIN (SELECT chrom, size, row_number() OVER (ORDER BY chrom) - 1 AS n, count(*) OVER () AS many FROM contigs WHERE size > 75)
ON n = {_DRAW.format("contig")} % many""")
)
def background_candidates(spark, sf_dir):
    return background.candidates(fx.contigs(spark, sf_dir), 2000, 75, 3, 0)


def _mixed_sql(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def _background_sql(body: str, seed: int = 1) -> str:
    """`body` after `need (bin, mid, need)` and `chosen (bin, cand_id, chrom, st, en, seq)`: every place of every contig, tested and ranked."""
    steps = f""",
need AS MATERIALIZED (SELECT CAST(bin AS INTEGER) AS bin, round((sum(n_gc) + 0.1) / (sum(length(seq)) + 0.1), 6) AS mid, count(*) AS need FROM binned GROUP BY ALL),
whole AS MATERIALIZED (SELECT CAST(floor(sum(length(seq)) / count(*)) AS BIGINT) AS len, round((max(gc) - min(gc)) / 20, 6) AS tolerance FROM binned),
places AS MATERIALIZED (
  SELECT chrom, no, st, len, tolerance, substr(seq, st + 1, len + 1) AS seq FROM (
    SELECT chrom, seq, no, len, tolerance, unnest(range(size - len)) AS st FROM (SELECT chrom, seq, size, row_number() OVER (ORDER BY chrom) - 1 AS no, len, tolerance FROM contigs, whole WHERE size > len))),
taken AS MATERIALIZED (SELECT DISTINCT chrom, unnest(range(greatest(st - len, 0), en)) AS st FROM peaks, whole),
free AS MATERIALIZED (
  SELECT *, round((2 * length(seq) - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) / len, 6) AS gc FROM places ANTI JOIN taken USING (chrom, st)
  WHERE length(seq) - length(replace(seq, 'N', '')) <= floor(len * 0.5)),
fits AS MATERIALIZED (SELECT f.*, bin, need, count(*) OVER (PARTITION BY bin, chrom) AS n FROM free f JOIN need ON abs(gc - mid) <= tolerance),
salted AS (SELECT *, xor(st & 4294967295, {_mixed_sql(f"((no * 1009 + bin * 31 + {seed}) & 4294967295)")}) AS x FROM fits),
hashed AS MATERIALIZED (SELECT *, {_mixed_sql("x")} AS h FROM salted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY -ln((h + 0.5) / 4294967296.0) * n, no, st) - 1 AS place, count(*) OVER (PARTITION BY bin) AS found FROM hashed),
filled AS MATERIALIZED (SELECT bin, max(need) AS need FROM fits GROUP BY bin),
numbered AS (SELECT bin, sum(need) OVER (ORDER BY bin) - need AS first FROM filled),
chosen AS (
  SELECT bin, CAST(first + place + turn * found AS BIGINT) AS cand_id, chrom, st, st + len AS en, seq
  FROM (SELECT *, unnest(range((need - 1 - place) // found + 1)) AS turn FROM ranked WHERE place < need) JOIN numbered USING (bin))
"""
    return sql("SELECT 1").replace("SELECT 1\n", steps.lstrip("\n") + body)


def _background(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contigs = fx.contigs(spark, sf_dir)
    return background.random_background(fx.peaks(spark, sf_dir, contigs), contigs, seed=1)


@query(_background_sql("SELECT bin, cand_id, chrom, st, en, seq FROM chosen"))
def background_select(spark, sf_dir):
    chosen, _ = _background(spark, sf_dir)
    return chosen


@query(_background_sql("SELECT bin, need, coalesce(f.need, 0) AS found FROM need LEFT JOIN (SELECT bin, need FROM filled) f USING (bin)").replace("SELECT bin, need, coalesce", "SELECT need.bin, need.need, coalesce"))
def background_shortfall(spark, sf_dir):
    _, report = _background(spark, sf_dir)
    return report


@query(
    _background_sql(
        "SELECT CAST(bin AS INTEGER) AS bin, concat('bg_', CAST(concat('0x', substr(md5(concat('1:', cand_id)), 1, 12)) AS BIGINT) % 100000, '_', cand_id) AS seq_id, concat_ws(chr(9), chrom, st, en) AS place FROM chosen"
    )
)
def background_bed(spark, sf_dir):
    chosen, _ = _background(spark, sf_dir)
    return background.background_ids(chosen, 1).select("bin", "seq_id", F.concat_ws("\t", "chrom", "st", "en").alias("place"))


# motif matrices


@query(sql("SELECT motif_idx, pc FROM pc"))
def pseudocounts(spark, sf_dir):
    return fx.motifs(spark, sf_dir).select("motif_idx", m.pseudocount(F.col("counts")).alias("pc"))


@query(sql("SELECT motif_idx, pos, base, round(p, 6) AS p FROM plain"))
def pwm_normalize(spark, sf_dir):
    return _cells(_motifs(spark, sf_dir), "pwm", "p")


@query(sql("SELECT motif_idx, pos, base, round(s, 6) AS s FROM pssm"))
def pssm_from_counts(spark, sf_dir):
    return _cells(_motifs(spark, sf_dir), "pssm", "s")


@query(sql("SELECT motif_idx, CAST(width - 1 - pos AS INTEGER) AS pos, translate(base, 'ACGT', 'TGCA') AS base, round(p, 6) AS p FROM plain JOIN motifs USING (motif_idx)"))
def revcomp_motif(spark, sf_dir):
    return _cells(_motifs(spark, sf_dir).withColumn("r", m.reverse_complement(F.col("pwm"))), "r", "p")


@query(
    sql("""SELECT motif_idx, CAST(pos - first AS INTEGER) AS pos, base, round(p, 6) AS p
FROM plain JOIN (SELECT motif_idx, min(pos) AS first FROM plain WHERE p > 0.4 GROUP BY motif_idx) USING (motif_idx) WHERE pos >= first""")
)
def clean_matrix(spark, sf_dir):
    return _cells(_motifs(spark, sf_dir).withColumn("t", m.trim_ambiguous(F.col("pwm"))), "t", "p")


@query(sql("SELECT motif_idx, string_agg(base, '' ORDER BY pos) AS consensus FROM (SELECT motif_idx, pos, arg_max(base, struct_pack(p := p, b := -ascii(base))) AS base FROM plain GROUP BY motif_idx, pos) GROUP BY motif_idx"))
def motif_consensus(spark, sf_dir):
    return _motifs(spark, sf_dir).select("motif_idx", m.consensus(F.col("pwm")).alias("consensus"))


def _column_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of equal place of every two motifs i < j."""
    long = _motifs(spark, sf_dir).select("motif_idx", F.posexplode("pwm").alias("pos", "c"))
    a, b = (long.select(F.col("motif_idx").alias(i), "pos", F.col("c").alias(c)) for i, c in (("i", "a"), ("j", "b")))
    return a.join(b, "pos").where("i < j")


_PAIRS = "FROM plain x JOIN plain y ON x.pos = y.pos AND x.base = y.base AND x.motif_idx < y.motif_idx"


@query(sql(f"SELECT x.motif_idx AS i, y.motif_idx AS j, x.pos, round(corr(x.p, y.p), 6) AS r {_PAIRS} GROUP BY ALL HAVING stddev_pop(x.p) > 0 AND stddev_pop(y.p) > 0"))
def motif_column_pearson(spark, sf_dir):
    return _column_pairs(spark, sf_dir).select("i", "j", "pos", F.round(m.column_pearson(F.col("a"), F.col("b")), 6).alias("r")).where("r IS NOT NULL")


@query(sql(f"SELECT x.motif_idx AS i, y.motif_idx AS j, x.pos, round(2 * sum(x.p * y.p) - sum(x.p) * sum(y.p), 6) AS score {_PAIRS} GROUP BY ALL"))
def column_match_score(spark, sf_dir):
    return _column_pairs(spark, sf_dir).select("i", "j", "pos", F.round(m.column_match_score(F.col("a"), F.col("b")), 6).alias("score"))


def _equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.motif_pairs(_motifs(spark, sf_dir)).where("size(a) = size(b)")


_SAME = "JOIN motifs a ON a.motif_idx = x.motif_idx JOIN motifs b ON b.motif_idx = y.motif_idx AND a.width = b.width"


@query(
    sql(f"""SELECT i, j, round(sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)), 6) AS r FROM (SELECT x.motif_idx AS i, y.motif_idx AS j, x.p - 0.25 AS dx, y.p - 0.25 AS dy
{_PAIRS} {_SAME}) GROUP BY ALL""")
)
def aligned_correlation(spark, sf_dir):
    return _equal_width(spark, sf_dir).select("i", "j", F.round(m.aligned_correlation(F.col("a"), F.col("b")), 6).alias("r"))


@query(sql(f"SELECT x.motif_idx AS i, y.motif_idx AS j, round(sqrt(sum((x.p - y.p) * (x.p - y.p))) / 4, 6) AS distance {_PAIRS} {_SAME} GROUP BY ALL"))
def motif_distance(spark, sf_dir):
    return _equal_width(spark, sf_dir).select("i", "j", F.round(m.matrix_distance(F.col("a"), F.col("b")), 6).alias("distance"))


# scans and features


def _top(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scan.scan_top(fx.sequences(spark, sf_dir), _motifs(spark, sf_dir), **options)


@query(scan_sql("SELECT seq_ordinal, motif_idx, score, start, strand FROM hits"))
def motif_scan_top(spark, sf_dir):
    return _top(spark, sf_dir)


@query(scan_sql("SELECT seq_ordinal, motif_idx, score, start, strand FROM hits", poison=False))
def motif_scan_ambiguous(spark, sf_dir):
    return _top(spark, sf_dir, ambiguous="skip")


@query(scan_sql("SELECT seq_ordinal, motif_idx, concat_ws(' ', start, strand) AS start FROM hits", source="clean"))
def motif_starts_text(spark, sf_dir):
    hits = scan.scan_top(fx.clean_sequences(spark, sf_dir), _motifs(spark, sf_dir))
    return hits.select("seq_ordinal", "motif_idx", s.start_text(F.col("start"), F.col("strand")).alias("start"))


@query(scan_sql("SELECT seq_ordinal, motif_idx, strand, start, score FROM windows JOIN motifs USING (motif_idx) WHERE known = width"))
def motif_scan_tracks(spark, sf_dir):
    tracks = scan.scan_tracks(fx.sequences(spark, sf_dir), _motifs(spark, sf_dir))
    rows = tracks.select("seq_ordinal", "motif_idx", "strand", F.posexplode("scores").alias("start", "score"))
    return rows.where("score IS NOT NULL").withColumn("start", F.col("start").cast("long"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`features_wide` with a library that is learnt once."""
    motifs = fx.motifs(spark, sf_dir)
    return scan.features_wide(scan.scan_top(fx.sequences(spark, sf_dir), with_pssm(motifs)), motifs)


@query(scan_sql("SELECT seq_ordinal, " + ", ".join(f"max(CASE WHEN motif_idx = {i} THEN score END) AS \"{n}\"" for i, (n, *_) in enumerate(fx.ANCHORS)) + " FROM hits GROUP BY seq_ordinal"))
def features_wide(spark, sf_dir):
    return _features(spark, sf_dir)


@query(
    scan_sql("""SELECT seq_ordinal, max(CASE WHEN motif_idx = 2 THEN score END) AS SEA, max(CASE WHEN motif_idx = 4 THEN score END) AS TEA, 1 AS label FROM hits GROUP BY seq_ordinal
UNION ALL SELECT seq_ordinal, max(CASE WHEN motif_idx = 2 THEN score END), NULL, 0 FROM hits GROUP BY seq_ordinal""")
)
def features_union(spark, sf_dir):
    wide = written(_features(spark, sf_dir).select("seq_ordinal", "SEA", "TEA"))  # both sides read it
    return scan.union_features(wide, wide.select("seq_ordinal", "SEA"))


@query(sql("SELECT seq_id, 1 AS label FROM ext UNION ALL SELECT concat('bg_', cand_id), 0 FROM cands"))
def labels_union(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    negative = fx.background_intervals(spark, sf_dir, contigs).select(F.concat(F.lit("bg_"), F.col("cand_id").cast("string")).alias("seq_id"), F.lit(0).alias("label"))
    return intervals.extract_sequences(fx.peaks(spark, sf_dir, contigs), contigs).select("seq_id", F.lit(1).alias("label")).union(negative)


# motif texts


def _as_text(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    rows = _motifs(spark, sf_dir).select(F.col("name").alias("path"), text.alias("value"))
    return rows


_JASPAR = """concat('>', matrix_id, ' ', name, (SELECT string_agg(concat(chr(10), base, ' [', line, ']'), '' ORDER BY base)
  FROM (SELECT base, string_agg(printf('%6.2f', value), ' ' ORDER BY pos) AS line FROM cells c WHERE c.motif_idx = m.motif_idx GROUP BY base)))"""


@query(sql(f"SELECT name AS path, {_JASPAR} AS value FROM motifs m"))
def jaspar_text(spark, sf_dir):
    return _as_text(spark, sf_dir, writers.jaspar_text(F.col("matrix_id"), F.col("name"), F.col("counts")))


_HOMER = """concat('>', matrix_id, chr(9), name, chr(9), '7.5', (SELECT string_agg(concat(chr(10), line), '' ORDER BY pos)
  FROM (SELECT pos, string_agg(printf('%.6f', p), chr(9) ORDER BY base) AS line FROM plain c WHERE c.motif_idx = m.motif_idx GROUP BY pos)))"""


@query(sql(f"SELECT name AS path, {_HOMER} AS value FROM motifs m"))
def jaspar_to_homer(spark, sf_dir):
    return convert.jaspar_to_homer(jaspar_text(spark, sf_dir), 7.5)


_WHOLE = """concat('>', matrix_id, chr(9), name, (SELECT string_agg(concat(chr(10), base, ' [ ', line, ' ]'), '' ORDER BY base)
  FROM (SELECT base, string_agg(CAST(CAST(floor(round(p, 6) * 10000 + 1e-9) AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS line FROM plain c WHERE c.motif_idx = m.motif_idx GROUP BY base)))"""


@query(sql(f"SELECT name AS path, {_WHOLE} AS value FROM motifs m"))
def homer_to_jaspar(spark, sf_dir):
    return convert.homer_to_jaspar(jaspar_to_homer(spark, sf_dir))


#: A text's numbers are rounded, and the HOMER writer normalises them again: plain2.
_MEME = f"""concat('{writers.MEME_HEAD}', chr(10), 'MOTIF ', name, ' ', matrix_id, chr(10), chr(10), 'letter-probability matrix: alength= 4 w= ', width, ' nsites= 20 E= 0',
  (SELECT string_agg(concat(chr(10), line), '' ORDER BY pos)
  FROM (SELECT pos, string_agg(printf('%.6f', p), chr(9) ORDER BY base) AS line FROM plain c WHERE c.motif_idx = m.motif_idx GROUP BY pos)))"""


@query(sql(f"SELECT name AS path, {_MEME} AS value FROM motifs m"))
def homer_to_meme(spark, sf_dir):
    return convert.homer_to_meme(jaspar_to_homer(spark, sf_dir))


@query(sql(f"SELECT name AS path, {_HOMER.replace('FROM plain c', 'FROM plain2 c')} AS value FROM motifs m WHERE name NOT LIKE '% %'"))
def meme_to_homer(spark, sf_dir):
    return convert.meme_to_homer(homer_to_meme(spark, sf_dir).where("path NOT LIKE '% %'"), 7.5)


# similarity and clusters


@query(sql("SELECT a.motif_idx AS i, b.motif_idx AS j FROM motifs a JOIN motifs b ON a.motif_idx < b.motif_idx"))
def motif_pairs(spark, sf_dir):
    return align.motif_pairs(_motifs(spark, sf_dir)).select("i", "j")


@query()
def motif_local_align(spark, sf_dir):
    return align.aligned_motifs(_motifs(spark, sf_dir))


@query()
def motif_global_align(spark, sf_dir):
    return align.aligned_motifs(_motifs(spark, sf_dir), "global")


@query()
def motif_similarity(spark, sf_dir):
    return align.motif_similarity(_motifs(spark, sf_dir))


#: A similarity that SQL has too: the closeness of consecutive motif widths and indices.
_R = "round(1 - abs(a.width - b.width) / 8.0 - (b.motif_idx - a.motif_idx) / 50.0, 6)"
_R_SQL = f"SELECT a.motif_idx AS i, b.motif_idx AS j, {_R} AS r FROM motifs a JOIN motifs b ON a.motif_idx < b.motif_idx"
_FULL = f"sim AS ({_R_SQL}), both_ways AS (SELECT * FROM sim UNION ALL SELECT j, i, r FROM sim UNION ALL SELECT motif_idx, motif_idx, 1.0 FROM motifs)"


def _sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _motifs(spark, sf_dir).select("motif_idx", F.size("pwm").alias("width"))
    return wide.alias("a").join(wide.alias("b"), F.expr("a.motif_idx < b.motif_idx")).select(F.expr("a.motif_idx").alias("i"), F.expr("b.motif_idx").alias("j"), F.expr(_R.replace("8.0", "8D").replace("50.0", "50D")).alias("r"))


def _with(body: str, extra: str) -> str:
    return sql("SELECT 1").replace("SELECT 1\n", f", {extra} {body}")


@query(_with("SELECT i, j, r FROM both_ways", _FULL))
def similarity_symmetric(spark, sf_dir):
    return align.symmetric(_sim(spark, sf_dir), _motifs(spark, sf_dir))


@query(
    _with(
        "SELECT CAST(CASE WHEN hi > lo THEN least(20, floor((r - lo) / ((hi - lo) / 20)) + 1) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM sim, (SELECT min(r) AS lo, max(r) AS hi FROM sim) GROUP BY 1",
        _FULL,
    )
)
def similarity_histogram(spark, sf_dir):
    return align.histogram(_sim(spark, sf_dir))


@query(_with("SELECT * FROM (SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY r DESC, j) AS INTEGER) AS rank, j, r FROM both_ways) WHERE rank <= 3", _FULL))
def related_top(spark, sf_dir):
    return align.related(align.symmetric(_sim(spark, sf_dir), _motifs(spark, sf_dir)), 3)


_TOP = "top AS (SELECT * FROM (SELECT i, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) AS rank, j FROM both_ways) WHERE rank <= 3)"


@query(_with("SELECT a.i, CAST(a.rank AS INTEGER) AS row_rank, CAST(b.rank AS INTEGER) AS column_rank, v.r FROM top a JOIN top b ON a.i = b.i JOIN both_ways v ON v.i = a.j AND v.j = b.j", f"{_FULL}, {_TOP}"))
def related_matrix(spark, sf_dir):
    return align.related_matrix(align.symmetric(_sim(spark, sf_dir), _motifs(spark, sf_dir)), 3)


@query(_with("SELECT i, j, r, CAST(round(r / (SELECT max(r) FROM both_ways) * 100) AS INTEGER) AS percent FROM both_ways", _FULL))
def heat_percent(spark, sf_dir):
    return align.heat_percent(align.symmetric(_sim(spark, sf_dir), _motifs(spark, sf_dir)))


#: Complete linkage in SQL, one least pair at a time, over `edges (i, j, d)` between `leaves (idx)`: `tree` as `linkage` has it.
_LINKAGE = """state(k, i, j, d, n_i, n_j) AS (
  SELECT 0, i, j, d, 1, 1 FROM edges
  UNION ALL
  SELECT k + 1, least(x, y), greatest(x, y), max(d), max(CASE WHEN x < y THEN n_x ELSE n_y END), max(CASE WHEN x < y THEN n_y ELSE n_x END)
  FROM (SELECT k, d, CASE WHEN i = hi THEN lo ELSE i END AS x, CASE WHEN j = hi THEN lo ELSE j END AS y,
               CASE WHEN i IN (lo, hi) THEN size ELSE n_i END AS n_x, CASE WHEN j IN (lo, hi) THEN size ELSE n_j END AS n_y
        FROM state, (SELECT p.i AS lo, p.j AS hi, p.n_i + p.n_j AS size FROM (SELECT arg_min({'i': i, 'j': j, 'n_i': n_i, 'n_j': n_j}, {'d': d, 'i': i, 'j': j}) AS p FROM state)))
  WHERE x <> y GROUP BY k, least(x, y), greatest(x, y)),
merged AS (SELECT k, p.i AS lo, p.j AS hi, p.d AS height, p.n AS size FROM (SELECT k, arg_min({'i': i, 'j': j, 'd': d, 'n': n_i + n_j}, {'d': d, 'i': i, 'j': j}) AS p FROM state GROUP BY k)),
steps AS (SELECT *, row_number() OVER (ORDER BY height, size, lo, hi) - 1 AS step FROM merged),
places AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS place, count(*) OVER () AS n FROM leaves),
named AS (SELECT step, coalesce(lag(step) OVER (PARTITION BY c ORDER BY k) + n, place) AS name FROM (SELECT step, k, unnest([lo, hi]) AS c FROM steps) JOIN places ON idx = c),
tree AS (SELECT CAST(step AS INTEGER) AS step, CAST(min(name) AS INTEGER) AS a, CAST(max(name) AS INTEGER) AS b, height, CAST(size AS INTEGER) AS size FROM named JOIN steps USING (step) GROUP BY step, height, size),
paths(node, path) AS (
  SELECT (SELECT max(n) FROM places) + max(step), CAST([] AS INTEGER[]) FROM tree
  UNION ALL SELECT unnest([a, b]), unnest([list_append(path, 0), list_append(path, 1)]) FROM paths JOIN tree ON node = step + (SELECT max(n) FROM places)),
ordered AS (SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS place, CAST(node AS INTEGER) AS motif FROM paths WHERE node < (SELECT max(n) FROM places)),
chain(idx, head) AS (SELECT idx, idx FROM leaves UNION ALL SELECT c.idx, lo FROM chain c JOIN merged ON hi = head AND height {below}),
heads AS (SELECT idx, min(head) AS head FROM chain GROUP BY idx)"""


def _linkage_sql(pairs: str, leaves: str, body: str, below: str = "<= 2") -> str:
    edges = f"edges AS (SELECT i, j, CASE WHEN r IS NULL OR isnan(r) THEN 1 ELSE round(1 - abs(r), 9) END AS d FROM ({pairs}))"
    return _with(body, f"{edges}, leaves AS ({leaves}), {_LINKAGE.replace('{below}', below)}").replace("WITH seqs", "WITH RECURSIVE seqs", 1)


_LEAVES = "SELECT motif_idx AS idx FROM motifs"
_CUT = "SELECT idx AS motif_idx, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INTEGER) AS cluster_id FROM heads"
_TREE = "SELECT step, a, b, height, size FROM tree"


@query(_linkage_sql(_R_SQL, _LEAVES, "SELECT place, motif FROM ordered"))
def leaf_order(spark, sf_dir):
    motifs = _motifs(spark, sf_dir)
    return cluster.leaf_places(cluster.linkage(_sim(spark, sf_dir), motifs), motifs.count())


@query(_linkage_sql(_R_SQL, _LEAVES, _TREE))
def linkage(spark, sf_dir):
    return cluster.linkage(_sim(spark, sf_dir), _motifs(spark, sf_dir))


@query(_linkage_sql(_R_SQL, _LEAVES, _CUT, "<= 1 - 0.8 + 1e-12"))
def cluster_cut(spark, sf_dir):
    return cluster.cut(_sim(spark, sf_dir), _motifs(spark, sf_dir), 0.8)


#: The same over all features, by how they go together in all rows.
_FEATURE_R = f"SELECT a.i, b.i AS j, round(corr(x[a.i + 1], x[b.i + 1]), 6) AS r FROM feats, range({fx.FEATURES}) a(i), range({fx.FEATURES}) b(i) WHERE a.i < b.i GROUP BY a.i, b.i"
_FEATURE_LEAVES = f"SELECT i AS idx FROM range({fx.FEATURES}) t(i)"


def _feature_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = spark.range(fx.FEATURES).select(F.col("id").cast("int").alias("motif_idx"))
    return learn.feature_correlation(fx.features(spark, sf_dir), fx.FEATURES), ids


@query(sql(f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, r FROM ({_FEATURE_R})"))
def feature_correlation(spark, sf_dir):
    return _feature_pairs(spark, sf_dir)[0]


@query(_linkage_sql(_FEATURE_R, _FEATURE_LEAVES, _TREE))
def feature_linkage(spark, sf_dir):
    return cluster.linkage(*_feature_pairs(spark, sf_dir))


@query(_linkage_sql(_FEATURE_R, _FEATURE_LEAVES, _CUT.replace("idx AS", "CAST(idx AS INTEGER) AS"), "<= 1 - 0.1 + 1e-12"))
def feature_clusters(spark, sf_dir):
    return cluster.cut(*_feature_pairs(spark, sf_dir), 0.1)


@query(
    _linkage_sql(
        _FEATURE_R,
        _FEATURE_LEAVES,
        """, sized AS (SELECT CAST(idx AS INTEGER) AS motif_idx, o.place, min(o.place) OVER w AS first, count(*) OVER w AS n FROM heads JOIN places p USING (idx) JOIN ordered o ON o.motif = p.place WINDOW w AS (PARTITION BY head))
SELECT motif_idx, place, CAST(CASE WHEN n > 1 THEN (SELECT count(DISTINCT x.first) FROM sized x WHERE x.n > 1 AND x.first <= s.first) END AS INTEGER) AS clade FROM sized s""",
        "< 0.9",
    )
)
def feature_clades(spark, sf_dir):
    return cluster.clades(*_feature_pairs(spark, sf_dir), 0.9)


@query(sql("SELECT cluster_id, string_agg(CAST(motif_idx AS VARCHAR), ',' ORDER BY motif_idx) AS members FROM clusters GROUP BY cluster_id HAVING count(*) > 1"))
def cluster_members(spark, sf_dir):
    found = cluster.members(fx.clusters(spark, sf_dir))
    return found.select("cluster_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


_FAMILY = """fam AS (SELECT c.cluster_id, c.motif_idx, m.name, m.matrix_id, coalesce(d.family, 'Unknown') AS family, coalesce(d.gene, 'Unknown') AS gene
  FROM clusters c JOIN motifs m USING (motif_idx) LEFT JOIN metadata d ON d.name = m.name),
families AS (SELECT cluster_id, coalesce(arg_min(family, motif_idx) FILTER (WHERE family <> 'Unknown'), 'Unknown') AS family, min(motif_idx) AS first_member FROM fam GROUP BY cluster_id)"""


@query(_with("SELECT * FROM families", _FAMILY))
def cluster_family(spark, sf_dir):
    return cluster.family_of(fx.clusters(spark, sf_dir), fx.motifs(spark, sf_dir), fx.metadata(spark, sf_dir))


@query(
    _with(
        """SELECT f.cluster_id, replace(replace(replace(replace(replace(concat(f.family, '_', row_number() OVER (PARTITION BY f.family ORDER BY f.first_member), '_merged'), '/', ''), ' ', '_'), '(', '_'), ')', '_'), '__', '_') AS name,
  (SELECT string_agg(matrix_id, '|' ORDER BY motif_idx) FROM fam x WHERE x.cluster_id = f.cluster_id) AS matrix_id,
  (SELECT string_agg(gene, '_' ORDER BY gene) FROM (SELECT DISTINCT gene FROM fam x WHERE x.cluster_id = f.cluster_id ORDER BY gene LIMIT 10)) AS genes
FROM families f WHERE (SELECT count(*) FROM clusters c WHERE c.cluster_id = f.cluster_id) > 1""",
        _FAMILY,
    )
)
def consensus_names(spark, sf_dir):
    return cluster.consensus_names(fx.clusters(spark, sf_dir), fx.motifs(spark, sf_dir), fx.metadata(spark, sf_dir))


#: `listed`: names of clusters of two or more as `consensus_names` has them, and then the motifs left alone.
_LISTED = f"""{_FAMILY},
large AS (SELECT cluster_id FROM clusters GROUP BY cluster_id HAVING count(*) > 1),
listed AS (
  SELECT CAST(row_number() OVER (ORDER BY part, key, nr) - 1 AS INTEGER) AS place, name, matrix_id, gene, family FROM (
    SELECT 0 AS part, '' AS key, f.cluster_id AS nr,
      replace(replace(replace(replace(replace(concat(f.family, '_', row_number() OVER (PARTITION BY f.family ORDER BY f.first_member), '_merged'), '/', ''), ' ', '_'), '(', '_'), ')', '_'), '__', '_') AS name,
      (SELECT string_agg(matrix_id, '|' ORDER BY motif_idx) FROM fam x WHERE x.cluster_id = f.cluster_id) AS matrix_id,
      (SELECT string_agg(gene, '_' ORDER BY gene) FROM (SELECT DISTINCT gene FROM fam x WHERE x.cluster_id = f.cluster_id ORDER BY gene LIMIT 10)) AS gene, f.family
    FROM families f SEMI JOIN large USING (cluster_id)
    UNION ALL SELECT 1, name, motif_idx, name, name, gene, family FROM fam ANTI JOIN large USING (cluster_id)))"""


@query(_with("SELECT * FROM listed", _LISTED))
def motif_list(spark, sf_dir):
    return cluster.motif_list(fx.clusters(spark, sf_dir), fx.motifs(spark, sf_dir), fx.metadata(spark, sf_dir))


@query(_with("SELECT CAST(row_number() OVER (ORDER BY name, place) AS INTEGER) AS number, name FROM listed", _LISTED))
def motif_list_lines(spark, sf_dir):
    return cluster.list_lines(motif_list(spark, sf_dir))


@query(sql("SELECT motif_idx, name FROM motifs WHERE motif_idx NOT IN (SELECT motif_idx FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM clusters GROUP BY cluster_id HAVING count(*) > 1))"))
def unmerged(spark, sf_dir):
    return cluster.unmerged(fx.clusters(spark, sf_dir), fx.motifs(spark, sf_dir)).select("motif_idx", "name")


@query()
def consensus_motifs(spark, sf_dir):
    return _cells(cluster.consensus_motifs(fx.clusters(spark, sf_dir), _motifs(spark, sf_dir)).withColumnRenamed("cluster_id", "motif_idx"), "pwm", "p").withColumnRenamed("motif_idx", "cluster_id")


@query()
def library_union(spark, sf_dir):
    return cluster.curated_library(fx.clusters(spark, sf_dir), _motifs(spark, sf_dir), fx.metadata(spark, sf_dir)).select("name", "matrix_id", "merged", F.size("pwm").alias("width"))


@query(sql("SELECT name AS motif, coalesce(gene, 'Unknown') AS genes, width FROM motifs LEFT JOIN metadata USING (name)"))
def annotate_unknown(spark, sf_dir):
    rows = _motifs(spark, sf_dir).select(F.col("name").alias("motif"), F.size("pwm").alias("width"))
    return learn.annotate_genes(rows, fx.metadata(spark, sf_dir), on_missing="unknown")


@query(sql("SELECT name AS motif, gene AS genes, width FROM motifs JOIN metadata USING (name)"))
def annotate_genes(spark, sf_dir):
    rows = _motifs(spark, sf_dir).join(fx.metadata(spark, sf_dir).select("name"), "name", "left_semi").select(F.col("name").alias("motif"), F.size("pwm").alias("width"))
    return learn.annotate_genes(rows, fx.metadata(spark, sf_dir))


# learning


@query(
    sql("SELECT key, CAST(row_number() OVER (ORDER BY md5(concat('5:2:', key)), key) <= ceil(0.3 * (SELECT count(*) FROM feats) - 1e-9) AS INTEGER) AS is_test FROM feats")
)
def train_test_split(spark, sf_dir):
    return learn.train_test_split(fx.features(spark, sf_dir), 0.3, 5, 2).select("key", F.col("is_test").cast("int").alias("is_test"))


@query(
    sql("""SELECT key, feature, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1 END, 6) + 0.0 AS z
FROM (SELECT key, unnest(x) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS feature FROM feats) WINDOW w AS (PARTITION BY feature)""")
)
def standardize_features(spark, sf_dir):
    long = fx.features(spark, sf_dir).select("key", F.posexplode("x").alias("feature", "value"))
    return learn.standardize(long, ["feature"]).select("key", "feature", (F.round("z", 6) + 0.0).alias("z"))


@query(
    sql("""SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score))""")
)
def roc_auc(spark, sf_dir):
    return learn.roc_auc(fx.scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(
    sql("""SELECT round(sum(pos * tp / n_all) / sum(pos), 9) AS average_precision FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n_all
  FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM scores GROUP BY score))""")
)
def average_precision(spark, sf_dir):
    return learn.average_precision(fx.scores(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


_LL = "sum(CASE WHEN (CASE WHEN label = 1 THEN score ELSE 1 - score END) <= 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-300)) END)"


@query(sql(f"SELECT round({_LL}, 6) AS ll FROM scores"))
def log_likelihood(spark, sf_dir):
    return fx.scores(spark, sf_dir).agg(F.round(learn.log_likelihood(F.col("label"), F.col("score")), 6).alias("ll"))


@query(sql("SELECT round(-2 * (sum(ln(CASE WHEN label = 1 THEN base ELSE 1 - base END)) - sum(ln(CASE WHEN label = 1 THEN p ELSE 1 - p END))), 6) AS statistic FROM (SELECT label, greatest(0.01, least(0.99, score)) AS p, (SELECT avg(label) FROM scores) AS base FROM scores)"))
def lrt_statistic(spark, sf_dir):
    scores = fx.scores(spark, sf_dir).select("label", F.greatest(F.lit(0.01), F.least(F.lit(0.99), "score")).alias("p"))
    base = scores.agg(F.avg("label").alias("base"))
    both = scores.join(F.broadcast(base))  # one row
    ll = both.agg(learn.log_likelihood(F.col("label"), F.col("p")).alias("full"), learn.log_likelihood(F.col("label"), F.col("base")).alias("reduced"))
    return ll.select(F.round(-2 * (F.col("reduced") - F.col("full")), 6).alias("statistic"))


@query()
def lrt_pvalue(spark, sf_dir):
    stats = fx.features(spark, sf_dir).select("key", (F.col("x")[0] * 20).alias("statistic"))
    return stats.select("key", learn.chi2_survival_column(F.col("statistic")).alias("p_value"))


@query(sql("SELECT round(1 / (1 - regr_r2(x[1], x[2])), 6) AS vif FROM feats"))
def vif_pairwise(spark, sf_dir):
    rows = fx.features(spark, sf_dir).select(F.slice("x", 1, 2).alias("x"))
    return learn.variance_inflation(rows, ["a", "b"]).where("motif = 'a'").select(F.round("vif", 6).alias("vif"))


@query(
    sql("""SELECT round((1 - bc * bc) / (1 - ab * ab - ac * ac - bc * bc + 2 * ab * ac * bc), 6) AS vif
FROM (SELECT corr(x[1], x[2]) AS ab, corr(x[1], x[3]) AS ac, corr(x[2], x[3]) AS bc FROM feats)""")
)
def vif_three(spark, sf_dir):
    rows = fx.features(spark, sf_dir).select(F.slice("x", 1, 3).alias("x"))
    return learn.variance_inflation(rows, ["a", "b", "c"]).where("motif = 'a'").select(F.round("vif", 6).alias("vif"))


def _names() -> list[str]:
    return [f"f{i}" for i in range(fx.FEATURES)]


#: The correlations are swept by each feature in turn, which leaves the negative inverse.
_VIF_SQL = f""", swept AS (
  WITH RECURSIVE places AS (SELECT unnest(range(1, {fx.FEATURES} + 1)) AS i),
  pairs AS (SELECT a.i, b.i AS j, corr(x[a.i], x[b.i]) AS r FROM feats, places a, places b GROUP BY a.i, b.i),
  steps AS (
    SELECT 0 AS k, list(line ORDER BY i) AS m FROM (SELECT i, list(r ORDER BY j) AS line FROM pairs GROUP BY i)
    UNION ALL
    SELECT k + 1, list_transform(m, lambda line, i: list_transform(line, lambda v, j: CASE
      WHEN i = k + 1 AND j = k + 1 THEN -1 / v
      WHEN i = k + 1 OR j = k + 1 THEN v / m[k + 1][k + 1]
      ELSE v - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM steps WHERE k < {fx.FEATURES})
  SELECT m FROM steps WHERE k = {fx.FEATURES})
SELECT concat('f', i - 1) AS motif, round(-m[i][i], 6) AS vif FROM swept, (SELECT unnest(range(1, {fx.FEATURES} + 1)) AS i)"""


@query(sql("SELECT 1").replace("SELECT 1\n", _VIF_SQL + "\n"))
def vif_all(spark, sf_dir):
    return learn.variance_inflation(fx.features(spark, sf_dir), _names()).withColumn("vif", F.round("vif", 6))


@query()
def train_l1_logistic(spark, sf_dir):
    return learn.train_classifier(fx.features(spark, sf_dir), _names())


@query()
def coefficients_mean(spark, sf_dir):
    rows = learn.train_classifier(fx.features(spark, sf_dir), _names(), iterations=3)
    return rows.groupBy("motif").agg(F.avg("coefficient").alias("coefficient"), F.avg("roc_auc").alias("roc_auc"), F.avg("precision").alias("precision"))


@query()
def feature_significance(spark, sf_dir):
    return learn.feature_significance(fx.features(spark, sf_dir), _names(), iterations=2)


@query()
def pipeline_peaks_vs_background(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    return peaks_vs_background(fx.peaks(spark, sf_dir, contigs), contigs, fx.motifs(spark, sf_dir), iterations=2)["coefficients"]


@query()
def pipeline_peaks_vs_peaks(spark, sf_dir):
    contigs = fx.contigs(spark, sf_dir)
    second = fx.background_intervals(spark, sf_dir, contigs).select(F.col("cand_id").alias("interval_id"), "chrom", (F.col("st") + 1).alias("st"), (F.col("en") + 1).alias("en"))
    return peaks_vs_peaks(fx.peaks(spark, sf_dir, contigs), second, contigs, fx.motifs(spark, sf_dir), iterations=2)["significance"]
