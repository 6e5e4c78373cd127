"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, units after numbers and names (capitalised words within a sentence) become typed slots.
Windows of eight canonical words of each benchmark item are joined by hash with those of every
document: with names as slots, with names as words, and with all words as they are, so verbatim copies
are found however many numbers, units and names they hold. Matches are gathered per document,
item and offset between them; where slots were filled anew, the same benchmark value has to
correspond to the same document value throughout, and the other way round. A template has to agree
in literal words, too: in `literal_share` of a window's words, be they of one window or of several, or in all
literal words of an item where the match covers 13 of its words. A document is
contaminated by an item if the accepted matches cover 13 of the item's words, or all of a shorter item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._scratch import let, small, table

WINDOW = 8
COVERED = 13
#: A template agrees in so large a part of a window's words, counted over the whole match: eight words, five of them literal.
LITERAL_SHARE = 0.6
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds ounce ounces oz "
    "ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks month months "
    "year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre "
    "kilometres mph kph watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb bytes bits"
).split()
_WORD = r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*"
_TOKEN = _WORD + r"|[.!?\n]"
_ENDS = (".", "!", "?", "\n")
#: A text without a match has no numbers, and so no units; the other one finds every text that may have names.
_MAY_COUNT = r"[0-9]|\b(?:" + "|".join(NUMBER_WORDS) + r")\b"
_MAY_NAME = r"[\p{L}\p{M}\p{N}][^\p{L}\p{M}\p{N}.!?\n]+\p{Lu}\p{Ll}|\p{N}\p{Lu}\p{Ll}"


def _number(low: Column) -> Column:
    """Of lower-case tokens: ASCII digits, which alone sort between 0 and :, and number words."""
    return (low >= "0") & (low < ":") | low.isin(*NUMBER_WORDS)


def _marked(text: Column) -> Column:
    """array<struct<kind, low>> of a text's words: kind w(ord), n(umber), u(nit) or p(roper name)."""

    def mark(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            low, before = F.lower(t), F.get(tokens, i - 1)
            return F.struct(
                F.when(t.isin(*_ENDS), ".")
                .when(_number(low), "n")
                .when(low.isin(*UNITS) & F.coalesce(_number(F.lower(before)), F.lit(False)), "u")
                .when((t != low) & (i > 0) & ~before.isin(*_ENDS) & t.rlike(r"^\p{Lu}\p{Ll}+$"), "p")
                .otherwise("w")
                .alias("kind"),
                low.alias("low"),
            )

        return F.filter(F.transform(tokens, one), lambda x: x["kind"] != ".")

    return let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), mark)


def _slots_hashed(text: Column) -> Column:
    """Hashes of a text's words, numbers and units as slots, names as words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    slow = lambda ts: F.transform(
        ts,
        lambda t, i: F.xxhash64(F.when(_number(t), "<num>").when(t.isin(*UNITS) & F.coalesce(_number(F.get(ts, i - 1)), F.lit(False)), "<unit>").otherwise(t)),
    )
    return F.when(F.lower(text).rlike(_MAY_COUNT), let(tokens, slow)).otherwise(F.transform(tokens, lambda t: F.xxhash64(t)))


def _names_hashed(text: Column) -> Column:
    """The same with names as slots."""
    slot = lambda x: F.when(x["kind"] == "n", "<num>").when(x["kind"] == "u", "<unit>").when(x["kind"] == "p", "<name>").otherwise(x["low"])
    return F.transform(_marked(text), lambda x: F.xxhash64(slot(x)))


def _exact_hashed(text: Column) -> Column:
    """Hashes of a text's words, all of them as words."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda t: F.xxhash64(t))


def _each(hashes: Column, window: int) -> Column:
    """array<struct<at, hash>> of the windows of a text's hashed words; at counts from 0."""
    return F.when(
        F.size(hashes) >= window,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(hashes, i + 1, window)).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def _windows(text: Column, window: int) -> Column:
    """The windows of a text with names as words; where it has names, those with names as slots, too; where it has numbers, those of its exact words."""
    each = lambda hashes: _each(hashes, window)

    def all_ways(plain: Column) -> Column:
        other = lambda hashes: F.filter(let(hashes, each), lambda x, i: x["hash"] != F.get(plain, i)["hash"])
        out = F.when(text.rlike(_MAY_NAME), F.concat(plain, other(_names_hashed(text)))).otherwise(plain)
        return F.when(F.lower(text).rlike(_MAY_COUNT), F.concat(out, other(_exact_hashed(text)))).otherwise(out)

    return let(let(_slots_hashed(text), each), all_ways)


def _words(rows: DataFrame, key: str) -> DataFrame:
    """`(key, at, kind, low)` of every word of `rows (key, text)`."""
    return rows.select(key, F.posexplode_outer(_marked(F.col("text"))).alias("at", "x")).where("at IS NOT NULL").select(key, "at", "x.kind", "x.low")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    covered: int = COVERED,
    literal_share: float = LITERAL_SHARE,
) -> DataFrame:
    """`(<id_col>, item_id, matched_words, item_words, slots, reparameterised)` for each contaminated pair.

    Items shorter than a window are compared as one window of their own length. Null texts and ids
    take no part; rows of one id are one document, repeated items one item. Whole texts are read.
    Windows without any literal word, such as a row of numbers, are found as exact words only.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    words = table(_words(items, "item").distinct(), "items")
    lengths = words.groupBy("item").agg((F.max("at") + 1).alias("item_words"), F.sum(F.col("kind").isin("w", "p").cast("long")).alias("item_literals"))
    short = lengths.where(F.col("item_words") < window).select("item_words").distinct()
    sizes = sorted([window, *(r[0] for r in short.collect())])  # fewer than `window` numbers
    literal = lambda kinds: F.size(F.filter(F.slice("m", F.col("w.at") + 1, F.col("size")), lambda x: x["kind"].isin(*kinds)))
    #: windows, and the kinds of words that stay words in them
    ways = ((_slots_hashed, "wp"), (_names_hashed, "w"), (_exact_hashed, "wpnu"))
    keys = None
    for size in sizes:
        for hashed, kinds in ways:
            part = (
                items.select("item", "text", _marked(F.col("text")).alias("m"))
                .where(F.size("m") >= window if size == window else F.size("m") == size)
                .select("item", "m", F.lit(size).alias("size"), F.explode(_each(hashed(F.col("text")), size)).alias("w"))
                .where(literal(kinds) >= 1)
                .select(
                    "item",
                    "size",
                    F.col("w.at").alias("item_at"),
                    F.col("w.hash").alias("hash"),
                    F.lit(hashed is _exact_hashed).alias("exact"),
                    (literal(kinds) >= literal_share * size).alias("rich"),
                    (literal("w") >= literal_share * size).alias("strict"),
                )
            )
            keys = part if keys is None else keys.unionByName(part)
    keys = table(keys.distinct(), "item-windows")
    n_keys = keys.count()

    found = None
    for size in sizes:
        here = small(keys.where(F.col("size") == size).select("item", "size", "item_at", "hash", "exact", "rich", "strict"), n_keys)
        part = (
            # an outer explode: for the inner one the optimizer would compute the windows again in a filter
            docs.select("doc", F.explode_outer(_windows(F.col("text"), size)).alias("w"))
            .select("doc", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"))
            .join(here, "hash")
            .select("doc", "item", (F.col("at") - F.col("item_at")).alias("offset"), "item_at", "size", "exact", "rich", "strict")
        )
        found = part if found is None else found.unionByName(part)
    matches = table(found.distinct(), "windows-found")

    # windows rich in literal words are judged alone, too, first without names as such words, so that poorer ones beside them only add
    judged = F.when(F.col("exact"), F.array(F.lit("exact"))).when(F.col("strict"), F.array(F.lit("strict"), F.lit("rich"), F.lit("all"))).when(F.col("rich"), F.array(F.lit("rich"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    matches = matches.withColumn("way", F.explode(judged))
    places = matches.select("doc", "item", "offset", "way", "size", F.explode(F.sequence("item_at", F.col("item_at") + F.col("size") - 1)).alias("at")).distinct()
    ids = table(matches.select("doc").distinct(), "docs-found")
    theirs = _words(docs.join(small(ids, ids.count()), "doc", "left_semi"), "doc").select("doc", F.col("at").alias("doc_at"), F.col("low").alias("doc_low")).distinct()
    slots = (
        places.join(small(words.where("kind <> 'w'"), words.count()), ["item", "at"])
        .withColumn("doc_at", F.col("at") + F.col("offset"))
        .join(theirs, ["doc", "doc_at"])
        .groupBy("doc", "item", "offset", "way")
        .agg(
            F.countDistinct("at").alias("slots"),
            F.countDistinct("kind", "low").alias("values"),
            F.countDistinct("kind", "doc_low").alias("doc_values"),
            F.countDistinct("kind", "low", "doc_low").alias("couples"),
            F.max((F.col("low") != F.col("doc_low")).cast("int")).alias("changed"),
            F.countDistinct(F.when((F.col("kind") == "p") & (F.col("low") == F.col("doc_low")), F.col("at"))).alias("names_kept"),
        )
    )
    covers = places.groupBy("doc", "item", "offset", "way").agg(F.collect_set("at").alias("at"), F.max("size").alias("size"))  # an item's words at most
    literals = F.size("at") - F.coalesce("slots", F.lit(0)) + F.coalesce("names_kept", F.lit(0))
    told = (literals >= F.lit(literal_share) * F.col("size")) | ((literals >= F.col("item_literals")) & (F.size("at") >= covered))
    one_to_one = F.col("slots").isNull() | (F.col("changed") == 0) | ((F.col("couples") == F.col("values")) & (F.col("couples") == F.col("doc_values")))
    accepted = covers.join(slots, ["doc", "item", "offset", "way"], "left").join(small(lengths, n_keys), "item").where((F.col("way") == "exact") | (told & one_to_one))
    return (
        accepted.select("doc", "item", "item_words", "slots", "changed", F.explode("at").alias("at"))
        .groupBy("doc", "item", "item_words")
        .agg(F.countDistinct("at").alias("matched_words"), F.max(F.coalesce("slots", F.lit(0))).alias("slots"), F.max(F.coalesce("changed", F.lit(0))).alias("changed"))
        .where(F.col("matched_words") >= F.least(F.lit(covered), F.col("item_words")))
        .select(
            F.col("doc").alias(id_col),
            F.col("item").alias("item_id"),
            "matched_words",
            F.col("item_words").cast("long").alias("item_words"),
            "slots",
            (F.col("changed") == 1).alias("reparameterised"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose document no item contaminates, all columns unchanged."""
    out = table(contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return docs.join(small(out, out.count()), id_col, "left_anti")
