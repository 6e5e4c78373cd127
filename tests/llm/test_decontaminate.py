import random
import re

from seqloom.llm import decontaminate as d
from seqloom.llm.queries import op3_contaminated


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(x.doc_id, x.item_id): x for x in d.contaminated(docs, items, **options).collect()}


ITEM = "A train leaves at noon and Maria drives 120 km to the north while Peter walks 15 miles home. Maria rests 3 hours before she returns."


def test_reparameterised_questions_are_caught(spark):
    other = ITEM.replace("Maria", "Zoe").replace("Peter", "Karl").replace("120", "77").replace("15", "2,5").replace(" km", " meters")
    clean = "A train may leave at any time but the north is cold, and 120 km is far while walking home is slow in winter."
    got = found(spark, [(1, f"Intro text. {ITEM} More."), (2, f"Note: {other} End"), (3, clean), (4, ITEM.upper())], [(9, ITEM)])
    assert set(got) == {(1, 9), (2, 9), (4, 9)}
    assert not got[1, 9].reparameterised and got[2, 9].reparameterised
    assert got[1, 9].matched_words == got[1, 9].item_words


def test_inconsistent_slots_are_rejected(spark):
    item = "Then Sam gives four apples to Tom and then Sam gives two pears to Tom again today."
    swapped = "Then Ann gives four apples to Bob and then Bob gives two pears to Ann again today."
    renamed = "Then Ann gives four apples to Bob and then Ann gives two pears to Bob again today."
    got = found(spark, [(1, f"Well. {swapped}"), (2, f"Well. {renamed}")], [(1, item)])
    assert set(got) == {(2, 1)}


def test_short_items_and_odd_rows(spark):
    items = [(1, "only five words in here"), (2, ""), (3, None), (None, ITEM), (4, "12 13 14 15 16 17 18 19 20"), (1, "only five words in here")]
    docs = [(1, "We say only five words, in here."), (2, None), (None, ITEM), (3, "12 13 14 15 16 17 18 19 20"), (4, "x " * 50_000 + "only five words in here"), (1, "")]
    assert set(found(spark, docs, items)) == {(1, 1), (3, 4), (4, 1)}  # a row of numbers as it is
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_drop_keeps_other_rows(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, "fine", 6), (None, ITEM, 7), (2, "fine", 6)], "doc_id long, text string, item_id int")
    kept = d.drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("coalesce(doc_id, 0) <> 1").collect()))


def test_whole_table_equals_brute_force(spark, sf):
    words = lambda t: re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", (t or "").lower())
    items = {x.item_id: words(x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for x in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = words(x.text)
        runs = {tuple(text[i : i + 13]) for i in range(len(text) - 12)}
        for item, ws in items.items():
            n = min(13, len(ws))
            if any(tuple(ws[i : i + n]) in runs for i in range(len(ws) - n + 1)):
                want.add((x.doc_id, item))
    got = {(x.doc_id, x.item_id) for x in op3_contaminated(spark, sf).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1


def test_items_dense_in_slots_are_found_verbatim(spark):
    numbers, names = "12 13 14 15 16 17 18 19 20", "Alice Smith and Bob Jones met Carol White in Paris on Monday"
    edge = "Add 12 km 15 kg 7 and 9 then tell the class which of them is the larger"
    items = [(1, numbers), (2, names), (3, edge)]
    docs = [(1, f"So: {numbers}."), (2, f"They say {names} again."), (3, "21 22 23 24 25 26 27 28 29"), (4, f"Now {edge}"), (5, "So " + edge.replace("12", "31").replace(" 9", " 8"))]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (4, 3), (5, 3)}


def test_poor_windows_do_not_undo_rich_ones(spark):
    item = ITEM + " He notes 4 kg 16 cm 4 lb then"
    doc = item.replace("Maria", "Zoe").replace("120", "77").replace("4 kg 16 cm 4 lb", "5 kg 16 cm 8 lb")
    assert set(found(spark, [(1, doc)], [(1, item)])) == {(1, 1)}


DENSE = "Pack 12 kg 7 cm 3 lb with 9 mg 14 km 2 g over 5 h 8 min then 21 ml"


def test_items_dense_in_numbers_are_found_with_other_numbers(spark):
    """No window of the item has five literal words; those of the whole match count."""
    other = DENSE.replace("12", "40").replace(" 7", " 71").replace("14", "33").replace(" 2 ", " 6 ")
    mixed_up = other.replace("71", "40")  # two values become one
    numbers = " ".join(str(i) for i in range(100, 120))
    docs = [(1, f"Well, {other} again"), (2, f"Well, {mixed_up} again"), (3, numbers), (4, other.replace("Pack", "Bring").replace("over", "under"))]
    assert set(found(spark, docs, [(1, DENSE), (2, " ".join(str(i) for i in range(20)))])) == {(1, 1)}


def _kinds(text):
    """(kind, lower word) of each word, by plain rules."""
    out, low_before, first = [], None, True
    for t in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]", text):
        low = t.lower()
        number = low[0].isdigit() or low in d.NUMBER_WORDS
        if t in ".!?\n":
            low_before, first = t, True
            continue
        counted = low_before is not None and (low_before[0].isdigit() or low_before in d.NUMBER_WORDS)
        name = not first and re.fullmatch("[A-Z][a-z]+", t)
        out.append(("n" if number else "u" if low in d.UNITS and counted else "p" if name else "w", low))
        low_before, first = low, False
    return out


def test_templates_equal_brute_force(spark):
    """Items against documents that hold them with slots filled anew, some inconsistently; names are slots throughout."""
    draw = random.Random(5)
    plain, names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)], ["Ada", "Bo", "Cy", "Dee", "Eve", "Flo", "Gus"]
    items, docs = [], []
    for i in range(40):
        words = [draw.choice(plain) for _ in range(24)]
        for at in draw.sample(range(1, 24), 8):
            words[at] = draw.choice(names) if draw.random() < 0.5 else str(draw.randrange(2, 60))
        items.append((i, " ".join(words)))
        used = sorted({w for w in words if w in names}), sorted({w for w in words if w.isdigit()})
        swap = dict(zip(used[0], draw.sample([n + "x" for n in names], len(used[0])), strict=True)) | dict(zip(used[1], map(str, draw.sample(range(100, 900), len(used[1]))), strict=True))
        if i % 3 == 0 and len(used[1]) > 1:
            swap[used[1][0]] = swap[used[1][1]]
        docs.append((i, "See " + " ".join(swap.get(w, w) for w in words) + " end"))

    def hit(item, doc):
        a, b = _kinds(item), _kinds(doc)
        slot = lambda x: x if x[0] == "w" else (x[0], None)
        whole = 0
        for offset in range(-len(a), len(b)):
            at = set()
            for i in range(len(a) - 7):
                if 0 <= i + offset and i + offset + 8 <= len(b) and all(slot(a[i + k]) == slot(b[i + k + offset]) for k in range(8)):
                    at |= set(range(i, i + 8))
            couples = {(a[i], b[i + offset]) for i in at if a[i][0] != "w"}
            fits = len({x for x, _ in couples}) == len({y for _, y in couples}) == len(couples)
            if fits and sum(a[i][0] == "w" for i in at) >= 5:
                whole = max(whole, len(at))
        return whole >= min(13, len(a))

    want = {(n, i) for n, doc in docs for i, item in items if hit(item, doc)}
    got = set(found(spark, docs, items))
    assert {(i, i) for i in range(40) if i % 3} <= want
    # windows rich in literal words are judged alone besides, so an inconsistent slot elsewhere need not clear a document
    assert want <= got and all(a == b for a, b in got)
