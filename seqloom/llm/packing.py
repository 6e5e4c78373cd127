"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A piece of n tokens costs `linear * n + quadratic * n * n` (attention within the piece). Of each
bounded group of documents, whole sequences are cut off the long ones; what is left goes, in
descending length, to the sequence of lowest cost that has room. Pieces that fit nowhere are cut
over the remaining room, again by lowest cost. The tokens beyond the last full sequence form
sequences whose lengths are powers of two, which need no padding either.

Groups are runs of a partition's rows of about `GROUP_TOKENS` tokens, so nothing is shuffled and a
task holds one group, whatever the size of the corpus.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
GROUP_TOKENS = 4_000_000
LINEAR = 1.0
QUADRATIC = 1 / 12288  # 6 * a model width of 2048
END_ID = 2
CACHED_WORDS = 800_000
TEXTS_AT_ONCE = 2000
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    The tokenizer drops white space and never joins across it, so the distinct stretches between spaces
    of some thousand texts are looked up, and each text's ids are gathered from theirs. The tokenizer
    lowers case letter by letter and parts a word from the marks after it, so ASCII stretches are learnt
    in lower case, and a word apart from its closing marks. After every `CACHED_WORDS` words that were
    learnt or met anew, those that were not met since the last time are forgotten.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        """All texts in one call; each is a word of its own to the tokenizer, and tokens carry its number."""
        if not texts:
            return []
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        ends = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(texts) + 1))).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        low = word.lower() if word.isascii() and "<" not in word else word  # < may begin a special token
        core = low.rstrip(".,;:!?")
        if core == low:
            return (low,)
        letters = core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())
        return (core, low[len(core) :]) if letters else (low,)

    def _learn(self, words: list[str]) -> None:
        """Adds distinct `words` to the known ones."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        again = {w: older[w] for w in new if w in older}
        known.update(again)
        parts = {w: self._parts(w) for w in new if w not in again}
        pieces = list({p for ps in parts.values() for p in ps if p not in known})
        known.update(zip(pieces, self._encode(pieces), strict=True))
        for w, ps in parts.items():
            if len(ps) > 1 or ps[0] != w:
                known[w] = b"".join(map(known.__getitem__, ps))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            # splitting also parts at U+001C to U+001F, which the tokenizer doesn't take for spaces
            odd = {k: t for k, t in enumerate(texts[i : i + TEXTS_AT_ONCE]) if _ODD_SPACE.search(t)}
            lists = pc.utf8_split_whitespace(pa.array(["" if k in odd else t for k, t in enumerate(texts[i : i + TEXTS_AT_ONCE])], pa.large_string()))
            met = lists.flatten().dictionary_encode()
            words = met.dictionary.to_pylist()
            self._learn([*words, *odd.values()])
            each = [self.known[w] for w in words]
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
            starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(each), "<u4")
            at = met.indices.to_numpy()
            n = sizes[at]
            ends = np.cumsum(n)
            ids = flat[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                yield self.known[odd[k]] if k in odd else ids[a:b].tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process, so that the tasks of a worker share what it knows."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """`(document, start, length, sequence, offset)` of each piece; sequences count from 0."""
    n_full = sum(lengths) // capacity
    pieces, short, used = [], [], 0
    for doc, n in enumerate(lengths):
        cut = min(n // capacity, n_full - used)
        for i in range(cut):
            pieces.append((doc, i * capacity, capacity, used, 0))
            used += 1
        if n > cut * capacity:
            short.append((n - cut * capacity, doc, cut * capacity))
    short.sort(key=lambda x: (-x[0], x[1]))
    room = np.full(n_full - used, capacity)
    cost = np.zeros(n_full - used)

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, used + at, int(capacity - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    left = []
    for n, doc, start in short:
        fits = np.where(room >= n, cost, np.inf)
        at = int(fits.argmin()) if len(fits) else -1
        if at >= 0 and np.isfinite(fits[at]):
            put(doc, start, n, at)
        else:
            left.append((n, doc, start))
    tail, offset = n_full, 0
    rest = sum(lengths) - n_full * capacity
    for n, doc, start in left:
        while n and (room > 0).any():
            at = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[at]))
            put(doc, start, take, at)
            n, start = n - take, start + take
        while n:  # all full: binary digits of the rest, largest first
            size = 1 << (rest.bit_length() - 1)
            take = min(n, size - offset)
            pieces.append((doc, start, take, tail, offset))
            n, start, offset = n - take, start + take, offset + take
            if offset == size:
                tail, offset, rest = tail + 1, 0, rest - size
    return pieces


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _packed(path: str, end_id: int, capacity: int, group_tokens: int, linear: float, quadratic: float, with_ids: bool):
    schema = _PIECES if with_ids else pa.schema(list(_PIECES)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path), np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        ids: list[bytes] = []
        size, first = 0, TaskContext.get().partitionId() << 32

        def group() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) // 4 for x in ids]
            pieces = pack(lengths, capacity, linear, quadratic)
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            doc, start, length, sequence, offset = zip(*pieces, strict=True)
            columns = [
                [docs[d] for d in doc],
                start,
                length,
                [zlib.crc32(x) for x in cut],
                [lengths[d] for d in doc],
                [first + s for s in sequence],
                offset,
                *([cut] if with_ids else []),
            ]
            first += max(sequence) + 1
            docs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, data in zip(batch.column("id").to_pylist(), words.batch(texts), strict=True):
                docs.append(doc)
                ids.append(data + end)
                size += len(data) // 4 + 1
                if size >= group_tokens:
                    yield group()
                    size = 0
        if docs:
            yield group()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: `(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`.

    Each row of `docs` is a document: the ids of its whole text and then `end_id`; a null or empty
    text is that id alone. ids is the piece as little-endian unsigned 32-bit numbers. Null ids stay
    null, rows of one id are packed each; an empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_packed(tokenizer_path, end_id, capacity, group_tokens, linear, quadratic, with_ids), schema + (", ids binary" if with_ids else ""))
