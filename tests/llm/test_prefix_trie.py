import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from seqloom.llm import prefix_trie
from seqloom.llm.queries import op13_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(convs):
    """Brute force: the rows of the trie of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = {n: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))) for n, m in members.items()}
    return sorted(
        (
            (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
            for n, m in members.items()
        ),
        key=str,
    )


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, sf)) == trie(rebuilt(rows))


def test_any_rows(spark):
    """Nulls, repeated rows, ties, turnless rebuilt conversations, a very long text and conversation, clashing columns."""
    r = random.Random(2)
    rows = []
    for c in [*range(60), 10**12, 10**12 + 1, 10**12 + 4]:
        for t in range(r.randrange(1, 12)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "a", "é", "日本"])))
    rows += [(61, None, "user", "first"), (61, 0, "user", "x" * 200_000), (62, 1, "u", "tie"), (62, 1, "u", "tie"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"t{t}") for c in (70, 71, 72) for t in range(700)]
    df = spark.createDataFrame([(*x, "n", 0) for x in rows], "conv_id long, turn long, role string, text string, turns string, d int").repartition(6)
    assert found(prefix_trie.conversation_trie(df)) == trie(rebuilt(rows))


@pytest.mark.parametrize("range_turns", [3, 40, 10**6])
def test_nodes_shared_by_many_ranges(spark, range_turns):
    """Hot starts, hot copies and hot ends are split over ranges and put together again."""
    r = random.Random(range_turns)
    convs = {i: [("u", "hot"), ("a", "hot too")] for i in range(0, 300, 3)}
    convs |= {i: [("u", "hot"), *((r.choice("ua"), r.choice(["x", "yy"])) for _ in range(r.randrange(7)))] for i in range(1, 300, 3)}
    convs |= {i: [("u", r.choice("abc")) for _ in range(r.randrange(5))] for i in range(2, 300, 3)}
    rows = [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = prefix_trie.conversation_turns(df)
    here = {c: t for c, t in convs.items() if t}
    assert found(prefix_trie.prefix_trie(turns, run_turns=50, range_turns=range_turns)) == trie(here)


def test_loser_tree_orders_and_looks_at_shared_turns_once():
    r = random.Random(5)
    digest = {x: hashlib.sha256(x.encode()).digest()[:16] for x in "abc"}
    convs = [(b"".join(digest[r.choice("ab" if i < 30 else "c")] for i in range(r.randrange(30, 40))), i, None) for i in range(200)]
    stem = b"".join(digest[r.choice("ab")] for _ in range(30))
    convs = [(stem + key[16 * 25 :], i, [1] * (30 + len(key) // 16 - 25)) for key, i, _ in convs]
    segments = []
    for k in range(8):
        (batch,) = prefix_trie._runs([], 10**9)(iter([_batch(convs[k::8])]))
        segments += batch.to_pylist()
    tree = prefix_trie.LcpLoserTree(segments)
    got, before = [], b""
    want = sorted((key, i) for key, i, _ in convs)
    for head, (key, conv) in zip(tree, want, strict=True):
        assert head.conv == conv and head.lcp == prefix_trie.shared_turns(before, key)
        got.append(head.conv)
        before = key
    # all share 30 turns: they are looked at once for each segment at most, not once for each comparison
    assert tree.compared < 8 * 30 + len(want) * 3 * 12


def _batch(convs):
    import pyarrow as pa

    digests = [[key[i : i + 16] for i in range(0, len(key), 16)] for key, _, _ in convs]
    return pa.RecordBatch.from_pydict({"conv_id": [c for _, c, _ in convs], "digests": digests, "sizes": [s for _, _, s in convs]})


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
