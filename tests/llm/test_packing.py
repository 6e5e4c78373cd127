import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm.packing import WordEncoder, pack, pack_documents
from seqloom.llm.queries import op6_packing, tokenizer_path


def held(pieces, lengths, capacity):
    """Every token once, no sequence too long or with a gap; only powers of two aren't full."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        assert n > 0
        docs[doc].append((start, n))
        sequences[sequence].append((offset, n))
    assert {d: sum(n for _, n in x) for d, x in docs.items()} == {d: n for d, n in enumerate(lengths) if n}
    for part in [*docs.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(part):
            assert start == at
            at += n
    sizes = [sum(n for _, n in x) for x in sequences.values()]
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes)
    return sizes


@pytest.mark.parametrize("seed", range(30))
def test_packing_is_complete(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, r.randrange(1, 100), r.randrange(1, 5000)]) for _ in range(r.randrange(1, 60))]
    held(pack(lengths, 256), lengths, 256)


def test_costs_are_balanced():
    r = random.Random(5)
    lengths = [int(min(4000, r.expovariate(1 / 300))) + 1 for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, sequence, _ in pack(lengths, 4096, 1, 1 / 500):
        cost[sequence] += n + n * n / 500
    full = np.array(list(cost.values()))[: sum(lengths) // 4096]
    in_order, at = defaultdict(float), 0
    for n in lengths:
        in_order[at // 4096] += n + n * n / 500
        at += n
    assert full.std() < 0.7 * np.array(list(in_order.values())).std()


def test_word_encoder_equals_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    r = random.Random(2)
    letters = " \n\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　aB'st,.!1é́ñßİΣς😀<|endoftext|>中"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(2000)] + ["it's I'LL don't ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ"]
    for text, data in zip(texts, encoder.batch(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_whole_table(spark, sf):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {x.doc_id: [*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 2] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_packing(spark, sf).collect()
    order = sorted(ids)
    place = {d: i for i, d in enumerate(order)}
    for x in rows:
        assert x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
    sizes = held([(place[x.doc_id], x.start, x.length, x.sequence_id, x.offset) for x in rows], [len(ids[d]) for d in order], 4096)
    assert sum(sizes) == sum(map(len, ids.values()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "word " * 9000, 2)], "doc_id long, text string, start int")
    rows = pack_documents(df, tokenizer_path(), with_ids=True).collect()
    assert sorted(x.doc_tokens for x in rows if x.doc_id == 1) == [1, 1]
    assert sum(x.length for x in rows) == 9003 and all(len(x.ids) == 4 * x.length for x in rows)
    assert pack_documents(df.limit(0), tokenizer_path()).count() == 0
