"""Chat formatting from event logs.

A log is partitioned by conversation and sorted by sequence number; streamed deltas, edits and
regenerations are folded into final messages, which are rendered with a template and can be read
back from it exactly. A conversation's text lies in a spool that moves to disk beyond `SPOOL_BYTES`,
and it is written message by message, so its length isn't bounded by a task's memory.

Events: `message` begins a message with a text, `delta` adds to it (and begins it where it is new),
`edit` replaces its text, `regenerate` empties it and drops every message that began after it.

Template: a message is `<turn>`, the role, a newline, the text, `</turn>` and a newline. Inside, a
backslash is doubled, `<turn>` and `</turn>` get one after their first character, so neither is ever
found in a text, and a newline in a role is a backslash and an n. The loss mask covers the texts of
the `assistant` role.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOOL_BYTES = 32 << 20
BATCH_CHARS = 4 << 20
KINDS = ("message", "edit", "regenerate", "delta")
OPEN, CLOSE = "<turn>", "</turn>"
_CONTROL = re.compile(r"\\|<(?=/?turn>)")
_ESCAPED = re.compile(r"\\\\|\\n|<\\(?=/?turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[0] == "\\n" else m[0][0], text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{CLOSE}\n"


def parse(segment: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE + "\n")):
        raise ValueError("not a rendered message")
    role, text = segment[len(OPEN) : -len(CLOSE) - 1].split("\n", 1)
    return unescape(role), unescape(text)


class _Conversation:
    """Messages of one conversation; each holds the places of its parts in the spool."""

    def __init__(self):
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115  closed by close()
        self.messages: dict = {}  # in the order in which they began
        self.end = 0

    def put(self, text: str) -> tuple[int, int]:
        data = text.encode("utf-8", "surrogatepass")
        self.spool.write(data)
        self.end += len(data)
        return self.end - len(data), len(data)

    def fold(self, key, kind: str, role: str, text: str) -> None:
        if kind not in KINDS:
            return
        if kind == "message":
            self.messages.pop(key, None)
        if key not in self.messages:
            self.messages[key] = (role, [])
        parts = self.messages[key][1]
        if kind in ("edit", "regenerate"):
            parts.clear()
        if kind == "regenerate":
            later = list(self.messages)
            for other in later[later.index(key) + 1 :]:
                del self.messages[other]
        if text:
            parts.append(self.put(text))

    def texts(self) -> Iterator[tuple[str, str]]:
        for role, parts in self.messages.values():
            out = []
            for at, size in parts:
                self.spool.seek(at)
                out.append(self.spool.read(size))
            yield role, b"".join(out).decode("utf-8", "surrogatepass")

    def close(self) -> None:
        self.spool.close()


def _reconstruct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events in, rendered messages out."""
    held, size, now, key = [], 0, None, None

    def flush():
        rows = pa.RecordBatch.from_pylist(held, schema=_SEGMENTS)
        held.clear()
        return rows

    def finished():
        nonlocal size
        for n, (role, text) in enumerate(now.texts()):
            held.append({"conv_id": key, "position": n, "segment": render(role, text), "in_loss": role == "assistant"})
            size += len(text)
            if size > BATCH_CHARS or len(held) >= 5000:
                size = 0
                yield flush()
        now.close()

    serial = 0
    for batch in batches:
        for e in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")), strict=True):
            if now is None or e[0] != key:
                if now is not None:
                    yield from finished()
                now, key = _Conversation(), e[0]
            serial += 1
            now.fold(serial if e[1] is None else ("id", e[1]), *e[2:])
    if now is not None:
        yield from finished()
    yield flush()


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("in_loss", pa.bool_())])


def format_log(
    events: DataFrame,
    *,
    conv_col: str = "conv_id",
    seq_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    kind_col: str | None = None,
    message_col: str | None = None,
) -> DataFrame:
    """Rendered messages `(conv_id, position, segment, in_loss)`, in order within a conversation.

    Without kind_col every row is a `message`, without message_col a message of its own, as are rows
    with a null message id. Ties in the sequence are ordered by kind (message, edit, regenerate,
    delta), role and text; repeated rows stay. A null role or text is empty, a null kind a `message`, an unknown kind is passed over,
    a null sequence number comes first, and rows with a null conversation are one conversation. A
    conversation without live messages gives no rows. Extra columns are ignored.
    """
    kind = F.coalesce(F.lower(F.col(kind_col).cast("string")), F.lit("message")) if kind_col else F.lit("message")
    plain = events.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(seq_col).alias("seq"),
        (F.col(message_col).cast("string") if message_col else F.lit(None).cast("string")).alias("message"),
        kind.alias("kind"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("kind_no", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind_no", "role", "text")
    return ordered.mapInArrow(_reconstruct, "conv_id long, position long, segment string, in_loss boolean")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted messages in, a row per conversation out; the state is two running hashes."""
    rows: list[dict] = []
    key, turns, loss, n, loss_chars, chars = None, None, None, 0, 0, 0

    def row():
        return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    for batch in batches:
        for conv, segment, in_loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "in_loss")), strict=True):
            if turns is None or conv != key:
                if turns is not None:
                    rows.append(row())
                key, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = parse(segment)
            n += 1
            chars += len(segment)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if in_loss:
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_chars += len(text)
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)
        rows = []
    if turns is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=_DIGESTS)


_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Reads rendered messages back and returns, per conversation, digests of its turns and of the text under the loss mask.

    `(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`.
    """
    ordered = segments.select("conv_id", "position", "segment", "in_loss").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
