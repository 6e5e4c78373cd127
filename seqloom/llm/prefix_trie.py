"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a sequence of turns, each a 16-byte digest of role and text and the size of its text.
Where conversations are read, bounded runs of them are sorted and front-coded: each holds the number of
turns that it shares with the one before it (its LCP) and only the turns after those. Runs are cut at
bounds that hold for all of them, and the segments of a range are merged by a loser tree that compares
two heads by their LCPs with the last winner and, only where these are equal, by turns from there on, so
a shared turn is never compared again. The merged stream pops finished nodes from a stack that holds the
path of the last conversation.

A range's stack begins and ends with nodes that the ranges beside it share: those on its first path up to
the LCP with its lower bound, and on its last path up to that with its upper bound. They leave as
fragments and are put together by their path, a few rows per range. A bound is a conversation's
turns and its id, so copies of one conversation are spread over ranges too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._ranks import ranked
from seqloom.llm._scratch import small, table

SIZE = 16
RUN_TURNS = 1_000_000
RANGE_TURNS = 400_000
SAMPLES_PER_RANGE = 20
#: Turns of a bound; copies of a longer conversation are one range.
BOUND_TURNS = 256
MOST_SHARED = 8
NO_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()
_RUNS = pa.schema([("range_no", pa.int32()), ("run", pa.string()), ("convs", pa.list_(pa.int64())), ("lcps", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("turns", pa.binary()), ("sizes", pa.list_(pa.int64()))])
_RUNS_SQL = "range_no int, run string, convs array<long>, lcps array<int>, ends array<int>, turns binary, sizes array<long>"


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two packed sequences begin with alike, `known` of them for certain."""
    n, i = min(len(a), len(b)), known * SIZE
    while i < n and a[i : i + SIZE] == b[i : i + SIZE]:
        i += SIZE
    return i // SIZE


def _runs(bounds: list[tuple[bytes, int]], run_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, list[int]]] = []
        turns = 0

        def segments() -> pa.RecordBatch:
            held.sort(key=lambda x: x[:2])
            rows: list[dict] = []
            now, before, row = None, b"", None
            for key, conv, sizes in held:
                at = bisect_right(bounds, (key, conv))
                if at != now:
                    row = {"range_no": at, "run": hashlib.sha256(key + b"%d" % conv).hexdigest(), "convs": [], "lcps": [], "ends": [], "turns": [], "sizes": []}
                    rows.append(row)
                    now, lcp = at, 0
                else:
                    lcp = shared_turns(before, key)
                row["convs"].append(conv)
                row["lcps"].append(lcp)
                row["ends"].append(len(key) // SIZE)
                row["turns"].append(key[lcp * SIZE :])
                row["sizes"] += sizes[lcp:]
                before = key
            for row in rows:
                row["turns"] = b"".join(row["turns"])
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_RUNS)

        for batch in batches:
            for conv, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "sizes")), strict=True):
                held.append((b"".join(digests), conv, sizes))
                turns += len(sizes) + 1
                if turns >= run_turns:
                    yield segments()
                    turns = 0
        if held:
            yield segments()

    return run


class _Head:
    """The conversation that a segment has come to: its id, LCP with the last winner, and turns after `skip` shared ones."""

    __slots__ = ("at", "conv", "end", "lcp", "place", "sizes", "skip", "spare", "turns", "_row")

    def __init__(self, row: dict):
        self._row, self.place, self.at = row, -1, 0
        self.next()

    def next(self) -> None:
        row = self._row
        self.place += 1
        if self.place == len(row["convs"]):
            self.conv = None
            return
        self.conv, self.skip, self.end = row["convs"][self.place], row["lcps"][self.place], row["ends"][self.place]
        self.lcp, n = self.skip, self.end - self.skip
        self.turns, self.sizes = row["turns"][self.at * SIZE : (self.at + n) * SIZE], row["sizes"][self.at : self.at + n]
        self.at += n

    def turn(self, i: int) -> bytes:
        return self.turns[(i - self.skip) * SIZE : (i - self.skip + 1) * SIZE]


class LcpLoserTree:
    """Merges front-coded segments; yields the head of the winner, whose `lcp` is that with the head before.

    `compared` counts the turns that were looked at.
    """

    def __init__(self, segments: list[dict]):
        self.heads = [_Head(s) for s in segments]
        self.compared = 0
        k = len(segments)
        winners = [0] * k + list(range(k))
        self.losers = [0] * max(1, k)
        for node in range(k - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.losers[0] = winners[1] if k > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x.conv is None or y.conv is None:
            return (b, a) if x.conv is None else (a, b)
        if x.lcp != y.lcp:  # the one that shares more with the last winner comes first, and the other's LCP stays
            return (a, b) if x.lcp > y.lcp else (b, a)
        i, n = x.lcp, min(x.end, y.end)
        while i < n and x.turn(i) == y.turn(i):
            i += 1
        self.compared += i - x.lcp + (i < n)
        if i < n:
            first = x.turn(i) < y.turn(i)
        else:
            first = (x.end, x.conv) < (y.end, y.conv)
        (y if first else x).lcp = i
        return (a, b) if first else (b, a)

    def __iter__(self) -> Iterator[_Head]:
        k = len(self.heads)
        while k:
            winner = self.losers[0]
            if self.heads[winner].conv is None:
                return
            yield self.heads[winner]
            self.heads[winner].next()
            node = (winner + k) // 2
            while node:
                winner, self.losers[node] = self._match(winner, self.losers[node])
                node //= 2
            self.losers[0] = winner


class _Node:
    """An open node. What its open children hold isn't in it yet."""

    __slots__ = ("border", "children", "convs", "depth", "digest", "end", "ends", "key", "leaves", "least", "saved", "size", "waiting")

    def __init__(self, depth: int, digest: bytes, size: int, border: bool):
        self.depth, self.digest, self.size, self.border = depth, digest, size, border
        self.convs = self.children = self.leaves = self.saved = 0
        self.least, self.end, self.ends, self.key, self.waiting = None, None, None, None, []

    def add_end(self, conv: int) -> None:
        self.convs += 1
        self.least = conv if self.least is None else min(self.least, conv)
        if self.ends is None:
            self.end, self.ends = conv, []
        self.ends.append(conv)


_NODES = pa.schema(
    [
        *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
        ("ends_sha256", pa.string()),
        ("parent_key", pa.binary()),
        ("node_key", pa.binary()),
        ("path", pa.list_(pa.binary())),
        ("size", pa.int64()),
        ("range_no", pa.int32()),
        ("ends_text", pa.string()),
    ]
)
_NODES_SQL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "parent_key binary, node_key binary, path array<binary>, size long, range_no int, ends_text string"
)
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _joined(ends: list[int] | None) -> str:
    return ",".join(map(str, ends or ()))


class _Stack:
    """The open path of a range; `rows` holds what has left it."""

    def __init__(self, range_no: int):
        self.range_no, self.rows = range_no, []
        self.path = [_Node(0, b"", 0, True)]

    def _key(self, depth: int) -> bytes:
        """Name of an open node: a digest over its path."""
        node = self.path[depth]
        if node.key is None:
            node.key = hashlib.sha256(self._key(depth - 1) + node.digest).digest()[:SIZE] if depth else b""
        return node.key

    def _waiting(self, node: _Node, parent_conv: int | None, parent_key: bytes | None) -> None:
        for row in node.waiting:
            row["parent_conv_id"], row["parent_key"] = parent_conv, parent_key
            self.rows.append(row)

    def pop(self) -> None:
        node = self.path[-1]
        if node.border:
            key = self._key(node.depth)
            names = [self._key(i) for i in range(node.depth + 1)]
            self._waiting(node, None, key)
            self.rows.append(
                {"conv_id": node.least, "depth": node.depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
                | {"node_key": key, "path": names, "size": node.size, "range_no": self.range_no, "ends_text": _joined(node.ends)}
            )
            self.path.pop()
            return
        saved = node.saved + (node.convs - 1) * node.size
        leaves = node.leaves if node.children else 1
        self._waiting(node, node.least, None)
        digest = hashlib.sha256(_joined(node.ends).encode()).hexdigest() if node.ends else EMPTY
        row = {"conv_id": node.least, "depth": node.depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digest}
        self.path.pop()
        above = self.path[-1]
        above.waiting.append(row)
        above.convs += node.convs
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        above.least = node.least if above.least is None else min(above.least, node.least)

    def add(self, head: _Head, border: int) -> None:
        """The next conversation; of its new nodes those up to the depth `border` are shared with another range."""
        while len(self.path) - 1 > head.lcp:
            self.pop()
        for i in range(head.lcp, head.end):
            self.path.append(_Node(i + 1, head.turn(i), head.sizes[i - head.skip], i + 1 <= border))
        self.path[-1].add_end(head.conv)

    def finish(self, border: int) -> None:
        for node in self.path[1 : border + 1]:
            node.border = True
        while self.path:
            self.pop()


def merge_range(range_no: int, segments: list[dict], bounds: list[tuple[bytes, int]]) -> Iterator[list[dict]]:
    """Rows of the nodes of one range, some thousand at a time."""
    stack, first = _Stack(range_no), True
    for head in LcpLoserTree(segments):
        border = 0
        if first and range_no:
            border, first = shared_turns(bounds[range_no - 1][0], head.turns), False
        stack.add(head, border)
        if len(stack.rows) > 10_000:
            yield stack.rows
            stack.rows = []
    last = b"".join(n.digest for n in stack.path[1:])
    stack.finish(shared_turns(last, bounds[range_no][0]) if range_no < len(bounds) else 0)
    yield stack.rows


def _merged(bounds: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segments = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["range_no"] != now:
                    if segments:
                        for rows in merge_range(now, segments, bounds):
                            yield pa.RecordBatch.from_pylist(rows, schema=_NODES)
                    now, segments = row["range_no"], []
                segments.append(row)
        if segments:
            for rows in merge_range(now, segments, bounds):
                yield pa.RecordBatch.from_pylist(rows, schema=_NODES)

    return run


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, joined by commas in the order in which they come."""
    schema = pa.schema([("node_key", pa.binary()), ("ends_sha256", pa.string())])
    key, digest, empty = None, None, True
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("node_key").to_pylist(), batch.column("ends_text").to_pylist(), strict=True):
            if digest is None or name != key:
                if digest is not None:
                    rows.append({"node_key": key, "ends_sha256": digest.hexdigest()})
                key, digest, empty = name, hashlib.sha256(), True
            if text:
                digest.update(text.encode() if empty else b"," + text.encode())
                empty = False
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"node_key": key, "ends_sha256": digest.hexdigest()}], schema=schema)


def conversation_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`(conv_id, turns array<struct<d binary, n long>>)`: digest and text size of each turn, in order.

    Ordered by turn, null first; ties by role and then by digest, so repeated rows are turns of their
    own. A null role or text is empty; rows with a null conversation are left out. Texts aren't shuffled;
    a conversation, however long, is one row of some 24 bytes a turn.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, SIZE)
    each = F.struct(F.col(turn_col).cast("long").alias("t"), role.alias("role"), digest.alias("d"), F.octet_length(text).cast("long").alias("n"))
    grouped = rows.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("turns"))


def with_shared_start(turns: DataFrame, every: int = 5, most: int = MOST_SHARED + 1) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % most, and goes on with its own after its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    keyed = turns.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    none = F.array().cast("array<struct<d:binary,n:bigint>>")
    begin = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def _bounds(turns: DataFrame, ranges: int, n: int) -> list[tuple[bytes, int]]:
    """Of a hashed sample, ranked by Spark, one conversation per range; only these reach the driver."""
    if ranges < 2:
        return []
    digests = lambda c: F.transform(c, lambda x: x["d"])
    every = max(1, n // (SAMPLES_PER_RANGE * ranges))
    sample = turns.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0)
    rows = ranked(sample.select(digests(F.slice("turns", 1, BOUND_TURNS)).alias("key"), F.when(F.size("turns") <= BOUND_TURNS, F.col("conv_id")).alias("conv")), [F.col("key"), F.col("conv").asc_nulls_first()], "trie-sample")
    step = max(1, rows.count() // ranges)
    found = rows.where(F.pmod("rank", F.lit(step)) == 0).select("key", "conv").collect()
    return sorted({(b"".join(map(bytes, r["key"])), NO_ID if r["conv"] is None else r["conv"]) for r in found})


def prefix_trie(turns: DataFrame, *, run_turns: int = RUN_TURNS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per node of the trie of `turns (conv_id, turns)`, a distinct sequence of the first d turns, from the root with d = 0.

    `(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`: the
    least member and depth, which name the node; the parent's least member (root: null); members;
    children; childless nodes of the subtree; (members - 1) times the bytes of the last text, summed over
    the subtree; the SHA-256 of the ids that end here, ascending and joined by commas. Turns are equal
    if their digests are. Conversations without turns end at the root; an empty table gives no rows.
    Ids are distinct and not null.
    """
    spark = turns.sparkSession
    n, all_turns = turns.agg(F.count("*"), F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()
    ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_turns // range_turns)), max(n, 1))
    bounds = _bounds(turns, ranges, n)
    split = turns.select("conv_id", F.transform("turns", lambda x: x["d"]).alias("digests"), F.transform("turns", lambda x: x["n"]).alias("sizes"))
    runs = table(split.mapInArrow(_runs(bounds, run_turns), _RUNS_SQL), "trie-runs")
    nodes = table(runs.repartition("range_no").sortWithinPartitions("range_no", "run").mapInArrow(_merged(bounds), _NODES_SQL), "trie-nodes")

    fragments = nodes.where("node_key IS NOT NULL")
    joint = table(_joint(fragments), "trie-joint")
    parents = joint.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("_conv"))
    closed = nodes.where("node_key IS NULL")
    done = closed.where("parent_key IS NULL").select(*_COLUMNS)
    below = closed.where("parent_key IS NOT NULL").join(small(parents, joint.count()), "parent_key").withColumn("parent_conv_id", F.col("_conv")).select(*_COLUMNS)
    return done.unionByName(below).unionByName(joint.select(*_COLUMNS))


def _joint(fragments: DataFrame) -> DataFrame:
    """Whole nodes from the fragments of ranges; a fragment holds what ends in it and what its closed children hold."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    own = fragments.groupBy("node_key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("path").alias("path"), F.first("size").alias("size"), *sums)
    own = table(own, "trie-own")
    above = own.select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens", F.posexplode("path").alias("at", "anc"))
    up = above.groupBy(F.col("anc").alias("node_key")).agg(
        F.min("conv_id").alias("_conv"), F.sum("n_convs").alias("_convs"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"), F.count_if(F.col("depth") == F.col("at") + 1).alias("_open")
    )
    full = table(own.join(up, "node_key"), "trie-up")
    counted = full.select("path", ((F.col("_convs") - 1) * F.col("size")).alias("here"), F.when(F.col("n_children") + F.col("_open") == 0, 1).otherwise(0).alias("leaf"))
    more = counted.select("here", "leaf", F.explode("path").alias("node_key")).groupBy("node_key").agg(F.sum("here").alias("_here"), F.sum("leaf").alias("_leaf"))
    ends = fragments.select("node_key", "range_no", "ends_text").repartition("node_key").sortWithinPartitions("node_key", "range_no").mapInArrow(_hashed_ends, "node_key binary, ends_sha256 string")
    parent = full.select(F.col("node_key").alias("_parent"), F.col("_conv").alias("parent_conv_id"))
    out = full.withColumn("_parent", F.when(F.col("depth") > 0, F.element_at("path", F.col("depth").cast("int")))).join(more, "node_key").join(ends, "node_key").join(parent, "_parent", "left")
    return out.select(
        "node_key",
        F.col("_conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("_convs").alias("n_convs"),
        (F.col("n_children") + F.col("_open")).alias("n_children"),
        (F.col("_leaves") + F.col("_leaf")).alias("n_leaves"),
        (F.col("_saved") + F.col("_here")).alias("saved_tokens"),
        "ends_sha256",
    )


def conversation_trie(rows: DataFrame, **columns: str) -> DataFrame:
    """`prefix_trie` of conversations with shared starts; see `conversation_turns` and `with_shared_start`."""
    turns = table(conversation_turns(rows, **columns), "trie-turns")
    return prefix_trie(table(with_shared_start(turns), "trie-rebuilt"))
