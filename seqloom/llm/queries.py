"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import chat, decontaminate, html_text, importance, line_dedup, mixing, near_dup, packing, prefix_trie, quality, toxicity, url_filter, warc
from seqloom.llm._scratch import new_path, table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class (the least doc_id of the group) and whether it stays."""
    return near_dup.near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op3_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the benchmark items they contain."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one more, read back from the rendered form."""
    text = "\\### Assistant: </turn> ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_log(rows.unionByName(more)))


#: Order of a conversation's rows, and how much longer escaping makes a string: one for a backslash and for a control string.
_TURNS = "turn NULLS FIRST, role, text"
_OP4_SQL = rf"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (SELECT *, list_sum(list_transform([role, text], lambda x: length(x) + len(regexp_extract_all(x, '\\|</?turn>')))) AS chars,
  length(role) - length(replace(role, chr(10), '')) AS newlines FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY {_TURNS})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY {_TURNS}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + newlines + {len(chat.OPEN) + len(chat.CLOSE) + 2}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and flags of every document."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    chain = toxicity.train_chain(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return toxicity.score(docs, chain)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed into sequences of 4096 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to web archives and read back by the merged index."""
    folder = new_path(spark, "warc")
    runs = warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    index = table(warc.merge_index(runs), "index")
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP7_SQL = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM firsts
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features and verdict of every document."""
    found = quality.quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.withColumn("rejected_by", F.array_join("rejected_by", ","))


def _op8_sql() -> str:
    """Base features by lists and windows; cutoffs by the binomial sum of each (stratum, rule, cutoff)."""
    rules = [(r, f"CAST({a} AS DOUBLE) / {b}", sorted(c)) for r, (a, b, c) in quality.RULES.items()]
    tests = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, CAST({c} AS DOUBLE) AS cutoff, count(*) AS n, count(*) FILTER (WHERE {x} > {c}) AS k FROM good GROUP BY stratum" for r, x, cs in rules for c in cs)
    over = ", ".join(f"CASE WHEN {x} > (SELECT cutoff FROM cutoffs c WHERE c.stratum = f.stratum AND c.rule = '{r}') THEN '{r}' END" for r, x, _ in rules)
    risk = quality.RISK / len(rules)
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, 'unknown') AS stratum FROM documents),
words AS (SELECT r, list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '') AS ws FROM docs),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) > 8)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space[1:]}')) AS ls FROM docs),
features AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
    SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM docs JOIN words USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r))),
good AS (SELECT * FROM features WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS ({tests}),
cutoffs AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tests
  WHERE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
        <= {quality.ERROR} / ((SELECT count(DISTINCT stratum) FROM good) * {sum(len(c) for _, _, c in rules)})
  GROUP BY stratum, rule),
judged AS (SELECT *, concat_ws(',', {over}) AS rejected_by FROM features f)
SELECT stratum, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, NOT base_failed AND rejected_by = '' AS kept FROM judged
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return line_dedup.drop_duplicate_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


#: The list of op10 comes from the pages: of each host, and of some of its parts, dated entries.
URL_LIST = """
SELECT host AS pattern, 'block' AS action, CAST(1704067200 + (length(host) * 11 % 120) * 86400 AS BIGINT) AS since FROM hosts
UNION ALL SELECT host, 'allow', CAST(1704067200 + (length(host) * 11 % 120 + 60) * 86400 AS BIGINT) FROM hosts
UNION ALL SELECT host, 'remove', CAST(1704067200 + (length(host) * 11 % 120 + 200) * 86400 AS BIGINT) FROM hosts
UNION ALL SELECT concat(host, '/en'), 'block', CAST(1704067200 + 40 * 86400 AS BIGINT) FROM hosts
UNION ALL SELECT concat(host, '/en'), 'remove', CAST(1704067200 + 300 * 86400 AS BIGINT) FROM hosts
UNION ALL SELECT 'example.net', 'block', CAST(1704067200 + 90 * 86400 AS BIGINT)
UNION ALL SELECT 'example.net', 'remove', CAST(1704067200 + 150 * 86400 AS BIGINT)
UNION ALL SELECT 'org', 'allow', CAST(1704067200 + 10 * 86400 AS BIGINT)
"""
_FETCHED = "CAST(1704067200 + (page_id * 7919) % 31536000 AS BIGINT)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the list entry that held for it when it was fetched."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched_at"))
    hosts = pages.select(F.lower(F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1)).alias("host")).where("host <> ''").distinct()
    return url_filter.evaluate_captures(pages, spark.sql(f"WITH hosts AS (SELECT * FROM {{hosts}}) {URL_LIST}", hosts=hosts))


_OP10_SQL = f"""
WITH captures AS (SELECT page_id, url, {_FETCHED} AS fetched_at FROM pages),
hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^\\w+://([^/:?#]*)', 1)) AS host FROM captures WHERE lower(regexp_extract(url, '^\\w+://([^/:?#]*)', 1)) <> ''),
entries AS ({URL_LIST}),
intervals AS (
  SELECT pattern, action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until
  FROM (SELECT pattern, since, max(action) AS action FROM entries GROUP BY pattern, since)
),
parts AS (
  SELECT DISTINCT url, string_split(lower(regexp_extract(url, '^\\w+://([^/:?#]*)', 1)), '.') AS labels,
         list_filter(string_split(regexp_extract(url, '^\\w+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS segments
  FROM captures WHERE url IS NOT NULL
),
keys AS (
  SELECT url, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: {{'pattern': array_to_string(labels[len(labels) - i + 1:], '.'), 'rank': i}}),
    list_transform(range(1, len(segments) + 1), lambda i: {{'pattern': array_to_string(labels, '.') || '/' || array_to_string(segments[:i], '/'), 'rank': len(labels) + i}})), recursive := true)
  FROM parts
),
ranked AS (
  SELECT c.url, c.fetched_at, i.pattern, i.since, i.action,
         row_number() OVER (PARTITION BY c.url, c.fetched_at ORDER BY k.rank DESC) AS n
  FROM (SELECT DISTINCT url, fetched_at FROM captures) c JOIN keys k ON k.url = c.url
  JOIN intervals i ON i.pattern = k.pattern AND i.since <= c.fetched_at AND (i.until IS NULL OR c.fetched_at < i.until) AND i.action <> 'remove'
)
SELECT c.page_id, c.url, c.fetched_at, r.pattern AS matched_pattern, r.since AS matched_since, r.action
FROM captures c LEFT JOIN ranked r ON r.url = c.url AND r.fetched_at = c.fetched_at AND r.n = 1
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark texts, and the rank of the drawn ones."""
    return importance.importance_sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, byte by byte with `steps.list` of a one-row table in scope."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST(concat('0x', substr(hex(encode({text})), i, 2)) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(steps.list[xor(c & 255, b) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


#: What the low byte of a crc32 adds in one step.
_CRC_STEPS = """steps AS MATERIALIZED (SELECT list(x ORDER BY i) AS list FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, i) AS x FROM (SELECT unnest(range(256)) AS i)))"""


def _op11_sql() -> str:
    x, words = importance, r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    split = lambda rows: f"(SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{x.UPPER}', '{x.LOWER}'), {words}) AS ws FROM {rows})"
    return f"""
WITH {_CRC_STEPS},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, ws FROM {split("documents")}),
target AS (SELECT unnest(ws) AS w FROM {split("benchmark")}),
words AS (SELECT r, unnest(ws) AS w FROM docs),
hashed AS MATERIALIZED (SELECT w, {_crc32_sql("w")} % {x.BUCKETS} AS bucket FROM (SELECT w FROM words UNION SELECT w FROM target), steps),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT b AS bucket, CAST(floor({x.SCALE} * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {x.BUCKETS}) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {x.BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({x.BUCKETS})) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
sums AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-{x.SCALE} * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) > 0 THEN (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) ELSE 0 END AS weight,
          CAST(concat('0x', substr(sha256(concat('{x.SEED}:', doc_id)), 1, 8)) AS BIGINT) AS h FROM docs LEFT JOIN sums USING (r))),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {x.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= {x.LEAST_WORDS}) OVER () AS enough FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {x.LEAST_WORDS} AND place <= {x.PERCENT} * enough // 100 THEN place END AS rank FROM placed
"""


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op12_sql() -> str:
    x = mixing
    seats = "(SELECT CAST(floor({0} * sum(size) / {1} + 0.5) AS BIGINT) FROM sized)".format(x.SHARE, x.BLOCK)
    return f"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(concat('{x.SEED}:', doc_id, ':', md5(coalesce(text, '')))), 1, 16) AS h FROM documents),
sources AS MATERIALIZED (
  SELECT *, [{", ".join(map(str, x.WEIGHTS))}][(no - 1) % {len(x.WEIGHTS)} + 1] AS weight, {x.MOST_REPEATS} * source_size AS most
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source)),
stops AS (
  SELECT no, weight, most, row_number() OVER (ORDER BY most / weight, no) AS place,
         (CAST({x.SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS unit
  FROM sources WINDOW before AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS MATERIALIZED (
  SELECT *, least(weight * (SELECT arg_min(unit, place) FROM stops WHERE unit * weight <= most), CAST(most AS DOUBLE)) AS target FROM sources),
quotas AS MATERIALIZED (
  SELECT no, count(*) AS quota FROM (SELECT no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no, k) AS place FROM (SELECT no, target, unnest(range({seats})) AS k FROM targets WHERE target > 0))
  WHERE place <= {seats} GROUP BY no),
dealt AS MATERIALIZED (
  SELECT r, s.doc_id, s.size, t.no, t.source_size, t.target, h, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % greatest(CAST(ceil(t.source_size / {x.SHARD_WORDS}) AS BIGINT), 1) AS shard
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cells AS MATERIALIZED (SELECT no, shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / {x.BLOCK}) AS BIGINT) AS blocks, coalesce(any_value(quota), 0) AS seats FROM dealt LEFT JOIN quotas USING (no) GROUP BY no, shard HAVING sum(size) > 0),
given AS (
  SELECT no, shard, count(*) AS quota FROM (SELECT no, shard, seats, row_number() OVER (PARTITION BY no ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(seats)) AS k FROM cells))
  WHERE place <= seats GROUP BY no, shard),
runs AS (
  SELECT no, shard, words, blocks, least(coalesce(quota, 0), {x.MOST_REPEATS} * blocks) // blocks AS repeats, least(coalesce(quota, 0), {x.MOST_REPEATS} * blocks) % blocks AS extra,
         CAST(concat('0x', substr(md5(concat('{x.SEED}:run:', no, ':', shard)), 1, 12)) AS BIGINT) % blocks AS first FROM cells LEFT JOIN given USING (no, shard)),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY no, shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last FROM dealt),
cut AS (
  SELECT doc_id, size, source_size, target, last - size AS start, last, coalesce(repeats, 0) AS repeats, coalesce(first, 0) * {x.BLOCK} AS a, least((first + extra) * {x.BLOCK}, words) AS b, (first + extra - blocks) * {x.BLOCK} AS c
  FROM laid LEFT JOIN runs USING (no, shard)),
parts AS (
  SELECT *, coalesce(greatest(least(last, b) - greatest(start, a), 0), 0) AS tail, coalesce(greatest(least(last, c) - start, 0), 0) AS head FROM cut)
SELECT doc_id, size, source_size, target, CAST(repeats * size + tail + head AS BIGINT) AS taken FROM parts
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations with shared starts."""
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    return f"""
WITH {_CRC_STEPS},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         {{'k': md5(concat(strlen(coalesce(role, '')), ':', role, text)), 'n': CAST(strlen(coalesce(text, '')) AS BIGINT)}} AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, list(t ORDER BY i) AS ts FROM turns GROUP BY conv_id),
hashed AS (SELECT conv_id, ts, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % {prefix_trie.MOST_SHARED + 1} AS h FROM convs, steps),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:h], c.ts[h + 1:]) AS ts FROM hashed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS MATERIALIZED (
  SELECT conv_id, d AS depth, len(ts) = d AS ends, array_to_string(list_transform(ts[1:d], lambda x: x.k), ' ') AS path,
         CASE WHEN d > 0 THEN array_to_string(list_transform(ts[1:d - 1], lambda x: x.k), ' ') END AS above, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS bytes
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT path, depth, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY path, depth),
children AS (SELECT above AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path, depth)),
above AS (
  SELECT array_to_string(string_split(path, ' ')[1:d], ' ') AS path, d AS depth, (n_convs - 1) * bytes AS saved, n_children = 0 AS leaf
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM whole)),
sums AS (SELECT path, depth, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY path, depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM whole n JOIN sums USING (path, depth) LEFT JOIN whole p ON p.path = n.above AND p.depth = n.depth - 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_main_text": op2_main_text,
    "op3_contaminated": op3_contaminated,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_importance": op11_importance,
    "op12_mixture": op12_mixture,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": _OP4_SQL,
    "op7_warc": _OP7_SQL,
    "op8_quality": _op8_sql(),
    "op10_url_filter": _OP10_SQL,
    "op11_importance": _op11_sql(),
    "op12_mixture": _op12_sql(),
    "op13_prefix_trie": _op13_sql(),
}
