import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from seqloom.llm import chat
from seqloom.llm.queries import op4_chat_format


@given(st.text(), st.text(alphabet="\\<>/turn \na") | st.text())
def test_rendering_is_reversible(role, text):
    assert chat.parse(chat.render(role, text)) == (role, text)
    assert chat.render(role, text).count(chat.CLOSE) == chat.render(role, text).count(chat.OPEN) == 1


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)) for r, t in turns)


def test_whole_table_equals_brute_force(spark, sf):
    turns = {}
    for x in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda x: (x.conv_id, x.turn)):
        turns.setdefault(x.conv_id, []).append((x.role or "", x.text or ""))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {x[0]: tuple(x[1:]) for x in op4_chat_format(spark, sf).collect()}
    assert got == {k: digests(v) for k, v in turns.items()}


def fold(events):
    """Plain fold of one conversation's sorted events."""
    out = []
    for message, kind, role, text in events:
        at = next((i for i, m in enumerate(out) if m[0] == message), None)
        if kind == "message":
            out = [m for m in out if m[0] != message] + [[message, role, text]]
            continue
        if at is None:
            at = len(out)
            out.append([message, role, ""])
        if kind == "regenerate":
            out = out[: at + 1]
        out[at][2] = text if kind in ("edit", "regenerate") else out[at][2] + text
    return [(r, t) for _, r, t in out]


def test_events_fold(spark):
    r = random.Random(1)
    rows, want = [], {}
    for conv in range(30):
        events = [(f"m{r.randrange(6)}", r.choice(["message", "delta", "delta", "edit", "regenerate"]), "r", f"{n}é;") for n in range(r.randrange(1, 40))]
        events = [(m, k, f"role{m}", t) for m, k, _, t in events]
        rows += [(conv, n, *e) for n, e in enumerate(events)]
        want[conv] = fold(events)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, message string, kind string, role string, text string").repartition(7)
    out = chat.format_log(df, kind_col="kind", message_col="message").collect()
    got = {}
    for x in sorted(out, key=lambda x: (x.conv_id, x.position)):
        got.setdefault(x.conv_id, []).append(chat.parse(x.segment))
    assert got == {k: v for k, v in want.items() if v}


def test_spool_moves_to_disk(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPOOL_BYTES", 10)
    c = chat._Conversation()
    for i in range(5):
        c.fold(i, "message", "user", "x" * 50)
    assert [t for _, t in c.texts()] == ["x" * 50] * 5
    c.close()


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "hi"), (2, None, "assistant", "x" * 300_000), (2, 3, "user", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x[0]: tuple(x[1:]) for x in chat.conversation_digests(chat.format_log(df)).collect()}
    assert got == {1: digests([("", ""), ("", "")]), None: digests([("assistant", "hi")]), 2: digests([("assistant", "x" * 300_000), ("user", "</turn>")])}
    assert chat.conversation_digests(chat.format_log(df.limit(0))).count() == 0
