"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its runs of five words, each labelled with how often it has occurred so
far. Under each of `sketches` hash functions the `picks` smallest labelled k-mers are taken and put
back in text order; the ordered tuple is a sketch. There are `EDITED_SKETCHES` sketches of runs of three words
besides, since random edits all over a text spare few runs of five. A text of up to `SHORT` words, of whose few k-mers one
edit can change all, has sketches of runs of two words, too. Two documents become candidates if one
sketch agrees, and are linked if the edit similarity of their word sequences, 1 - distance / longer
length, is `similarity` or more. With n sketches of 2 picks a pair that shares a part s of its k-mers
becomes a candidate with a probability of 1 - (1 - s * s) ** n. Where every fifth word is replaced at random, which is
the edit similarity of 0.8, s is some 0.2 for five words and 0.34 for three, but varies from pair to pair; the tests
measure what is found there. Raise `picks` with the corpus: each further pick divides chance meetings by ten or so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._links import classes, shared
from seqloom.llm._scratch import BROADCAST_KEYS, discard, let, small, table

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 32
PICKS = 2
#: Sketches of shorter k-mers, which a text with edits all over keeps.
EDITED_WORDS, EDITED_SKETCHES = 3, 24
#: Texts of up to so many words have sketches of still shorter ones.
SHORT, SHORT_WORDS, SHORT_SKETCHES = 40, 2, 16
#: Counters of a text's words by their hashes, which bound the words that two texts share. Seven lie in a long, each of
#: eight bits below a spare one; one that is full counts for any number.
COUNTERS, LANES, FULL = 126, 7, 255
_SPARE = sum(1 << 9 * i + 8 for i in range(LANES))
_EVEN = sum(511 << 18 * i for i in range(3))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labelled_kmers(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of (k-mer, occurrence number) in text order; a shorter text is one k-mer."""
    k = min(k, len(tokens))
    n = len(tokens) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mixed(h * _ODD + tokens[i : i + n])
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.r_[True, run[1:] != run[:-1]]
    if first.all():
        return h
    starts = np.flatnonzero(first)
    seen = np.empty(n, np.uint64)
    seen[order] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    return np.where(seen > 0, _mixed(h + seen * _ODD), h)


def order_minhash(tokens: np.ndarray, k: int, sketches: int, picks: int, first_seed: int = 1) -> np.ndarray:
    """One 64-bit value per sketch; none for a text without words."""
    if not len(tokens):
        return np.empty(0, np.uint64)
    h = labelled_kmers(tokens, k)
    picks = min(picks, len(h))
    out = []
    step = max(1, 2_000_000 // len(h))
    for s in range(0, sketches, step):
        seeds = np.arange(s, min(s + step, sketches), dtype=np.uint64) + np.uint64(first_seed)
        x = _mixed(h[None, :] ^ (seeds * _ODD)[:, None])
        at = np.sort(np.argpartition(x, picks - 1, axis=1)[:, :picks], axis=1)
        value = seeds
        for i in range(picks):
            value = _mixed(value * _ODD + h[at[:, i]])
        out.append(value)
    return np.concatenate(out)


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or `most + 1` if it is larger: a band of 2 * most + 1 diagonals.

    Equal ends are cut off. The band of a column is held as bits of whole numbers, one bit a cell:
    `up` and `down` mark where the cell below is one more or one less.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    m, n = len(a), len(b)
    if not n:
        return m if m <= most else most + 1
    band = min(most, m)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask = (1 << 2 * band + 1) - 1
    top = 1 << 2 * band
    up, down, score = ((1 << band + 1) - 1) << band, 0, band
    for j in range(1, n + 1):
        same = where.get(b[j - 1], 0)
        shift = j - band - 1
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        row = m - j + band
        if row >= 2 * band:
            score += not diagonal & top
        else:
            score += (right_up >> row & 1) - (right_down >> row & 1)
        diagonal >>= 1
        up, down = (right_down | ~(diagonal | right_up)) & mask, diagonal & right_up
    return score if score <= most else most + 1


def alike(a: list, b: list, similarity: float) -> bool:
    """Edit similarity of `similarity` or more; word counts rule out most other pairs before."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    if longer - (Counter(a) & Counter(b)).total() > most:
        return False
    return edit_distance(a, b, most) <= most


def text_sketches(tokens: np.ndarray, k: int = WORDS, sketches: int = SKETCHES, picks: int = PICKS, similarity: float = SIMILARITY) -> np.ndarray:
    """All sketches of a text: of runs of k words, of three, and of two if it is short."""
    # the longer text of a pair whose shorter one is short has this many words at most
    short = SHORT / similarity if similarity else np.inf
    found = [order_minhash(tokens, k, sketches, picks), order_minhash(tokens, EDITED_WORDS, EDITED_SKETCHES, picks, 1 << 33)]
    if len(tokens) <= short:
        found.append(order_minhash(tokens, SHORT_WORDS, SHORT_SKETCHES, picks, 1 << 32))
    return np.concatenate(found)


def _sketched(k: int, sketches: int, picks: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(np.r_[0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
            values = [text_sketches(flat[i:j], k, sketches, picks, similarity) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)))
            counts = [np.bincount((flat[i:j] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            bag = np.minimum(np.concatenate([np.empty(0, np.int64), *counts]), FULL).reshape(-1, LANES) @ (1 << 9 * np.arange(LANES))
            bags = pa.FixedSizeListArray.from_arrays(pa.array(bag, pa.int64()), COUNTERS // LANES).cast(pa.list_(pa.int64()))
            columns = {"id": batch.column("id"), "text_hash": batch.column("text_hash"), "n_words": pa.array(np.diff(ends), pa.int32()), "bag": bags, "sketches": column}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("words_a"), batch.column("words_b")
            linked = [alike(x.as_py().split(), y.as_py().split(), similarity) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def near_duplicate_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    sketches: int = SKETCHES,
    picks: int = PICKS,
) -> DataFrame:
    """One row per row of `docs`: `(<id_col>, class_id, keep)`.

    class_id is the least id of the documents joined by links; keep marks that document's row.
    Words are runs of letters and digits, in lower case. Equal texts (empty ones too) are one class
    from the start and are compared once. A null text is a class of its own; a null id gets a null
    class and is kept. Rows of one id are one document and share its class. Very long texts are
    aligned whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    tokens = F.transform(F.filter(F.split("plain", " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    sketched = table(
        rows.select("id", F.coalesce(F.md5("text"), F.concat(F.lit("null "), F.col("id").cast("string"))).alias("text_hash"), plain.alias("plain"))
        .select("id", "text_hash", tokens.alias("tokens"))
        .mapInArrow(_sketched(words, sketches, picks, similarity), "id long, text_hash string, n_words int, bag array<long>, sketches array<long>"),
        "omh-sketches",
    )
    texts = sketched.where("id IS NOT NULL").groupBy("text_hash").agg(F.min("id").alias("first"))
    info = F.struct(F.col("n_words").alias("n"), "bag")
    members = (
        sketched.where("id IS NOT NULL")
        .join(texts.select(F.col("first").alias("id"), "text_hash"), ["id", "text_hash"], "left_semi")
        .select("id", info.alias("info"), F.explode(F.array_distinct("sketches")).alias("bucket"))
    )
    members = shared(members, "omh")

    held = {}

    def prepare(ids: DataFrame) -> None:
        """Words of all documents that are ever compared, once."""
        words_of = rows.where("text IS NOT NULL").join(small(ids, ids.count(), BROADCAST_KEYS), "id", "left_semi").select("id", F.struct(F.md5("text"), plain.alias("words")).alias("x"))
        held["ids"] = ids
        held["words"] = table(words_of.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.words"), "omh-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = table(pairs, "omh-pairs")
        sides = pairs.join(held["words"].select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
        sides = sides.join(held["words"].select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
        return sides.select("a", "b", "words_a", "words_b").mapInArrow(_verified(similarity), "a long, b long")

    # rows of one id with several texts are one document
    # (verify takes the text with the least hash)
    same_id = sketched.where("id IS NOT NULL").join(texts, "text_hash").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    several = sketched.where("id IS NOT NULL").groupBy("id").agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).where("x <> y").select("id")
    known = same_id.join(several.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")

    def plausible(short, long):
        """The bounds of `alike`, by counters instead of words."""
        most = F.floor(F.lit(1 - similarity) * long["n"] + 1e-9)

        def fewer(x, y):
            """The lesser of each two counters, by their spare bits."""
            more = x.bitwiseOR(F.lit(_SPARE)) - y
            more = more.bitwiseAND(F.lit(_SPARE))
            return x.bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(more - F.shiftrightunsigned(more, 8)))

        counters = F.zip_with(short["bag"], long["bag"], fewer)
        full = F.exists(counters, lambda x: (x + F.lit(_SPARE >> 8)).bitwiseAND(F.lit(_SPARE)) != 0)
        pairs = F.aggregate(counters, F.lit(0).cast("long"), lambda n, x: n + x.bitwiseAND(F.lit(_EVEN)) + F.shiftrightunsigned(x, 9).bitwiseAND(F.lit(_EVEN)) + F.shiftrightunsigned(x, 54))
        words_shared = let(pairs, lambda x: sum(F.shiftrightunsigned(x, 18 * i).bitwiseAND(F.lit((1 << 18) - 1)) for i in range(3)))
        fits = long["n"] - short["n"] <= most
        return F.when(fits, (long["n"] - words_shared <= most) | full).otherwise(False)

    # rows that are repeated count once; members are many, so they are shuffled for it only if there are such rows
    repeated = sketched.where("id IS NOT NULL").groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    found = classes(members.distinct() if repeated else members, verify, None, "omh", known, similarity=similarity, plausible=plausible, prepare=prepare)
    for done in (members, held["ids"], held["words"]):
        discard(done)
    first = texts.join(found, texts["first"] == found["id"], "left").select("text_hash", F.coalesce("component", "first").alias("class_id"))
    return (
        sketched.select("id", "text_hash")
        .join(first, "text_hash", "left")
        .select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("keep"))
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose document stands for its class, all columns kept; repeated rows of an id once."""
    found = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options)
    out = table(found.where("NOT keep").select(id_col).distinct(), "omh-out")
    kept = docs.join(small(out, out.count()), id_col, "left_anti")
    several = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    return kept if not several else kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
