"""Conversations as training text with a loss mask, assembled column by column.

The template, with ``{...}`` for what is filled in:

    <|turn|>{role}<|text|>{text}<|end|>

Every ``<`` and ``[`` inside a role or text is followed by an inserted ``\\``. No control
string of this template, or of others that start with these characters, can then occur
inside a turn, and removing the character after each ``<`` and ``[`` restores the
original. A missing role reads ``<|none|>``.

Per Arrow batch the bytes are assembled in numpy: the lengths of all headers, texts and
footers, their cumulative offsets in the output, and one scatter into a preallocated buffer
that becomes an Arrow string column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END, NO_ROLE = "<|turn|>", "<|text|>", "<|end|>", "<|none|>"
LEARNED_ROLE = "assistant"
#: Bytes of turns assembled together, or of one conversation, and bytes whose scatter indices are held at once.
TOGETHER, SCATTERED = 16 << 20, 1 << 20
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(values: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(values, "<", "<\\"), "[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without NULLs."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Byte b of a column's segment i goes to starts[i] + (b - offsets[i]); indices are held for SCATTERED bytes at a time."""
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCATTERED, side="right")) - 1)
        used = data[offsets[at]:offsets[to]]
        if to == at + 1:  # a long segment needs no indices
            out[starts[at]:starts[at] + lengths[at]] = used
        else:
            target = np.repeat(starts[at:to] - (offsets[at:to] - offsets[at]), lengths[at:to])
            target += np.arange(len(used))
            out[target] = used
        at = to


def assemble(role: pa.Array, text: pa.Array, conversation: np.ndarray, total: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One string per conversation, and where each turn's text lies in it (start, end in bytes).

    ``role`` and ``text`` hold one value per turn, ``conversation`` (ascending) the number of its conversation.
    """
    none = pc.is_null(role)
    role = pc.if_else(none, pa.scalar(NO_ROLE, role.type), escape(role))
    header = pc.binary_join_element_wise(pa.scalar(TURN, role.type), role, pa.scalar(TEXT, role.type), pa.scalar("", role.type))
    parts = [_flat(header), _flat(escape(pc.fill_null(text, ""))), _flat(pa.array([END] * len(role), pa.large_string()))]
    lengths = np.stack([np.diff(o) for _, o in parts], 1)  # turns x 3
    ends = np.cumsum(lengths).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for j, (data, offsets) in enumerate(parts):
        _scatter(out, data, offsets, starts[:, j], lengths[:, j])
    per_conversation = np.bincount(conversation, lengths.sum(1), total).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(per_conversation)))
    formatted = pa.Array.from_buffers(pa.large_string(), total, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    base = offsets[:-1][conversation]
    return formatted, starts[:, 1] - base, ends[:, 1] - base


def _bounded(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes, or of one row; halves of halves, so long rows do not meet by chance."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.nbytes <= most or part.num_rows <= 1:
                yield part
            else:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bounded(batches):
        turns = batch.column("turns")
        counts = pc.list_value_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        conversation = np.repeat(np.arange(len(batch)), counts)
        role, text = flat.field("role"), flat.field("text")
        formatted, start, end = assemble(
            role.cast(pa.large_string()), text.cast(pa.large_string()), conversation, len(batch))
        learned = pc.fill_null(pc.equal(role, LEARNED_ROLE), False).to_numpy(zero_copy_only=False)
        spans = pa.StructArray.from_arrays([pa.array(start[learned]), pa.array(end[learned])], ["start", "end"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(conversation[learned], minlength=len(batch))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), spans)],
            ["conv_id", "formatted", "loss_spans"])


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` ([start, end) in UTF-8 bytes of each learned text).

    Turns are ordered by number (missing first), then role, then text; repeated rows are turns of their own. A missing
    text is empty; a missing role is kept apart from an empty one. Rows without a conversation id belong to
    no conversation: each is formatted alone, with a NULL id. An empty table gives no rows; other columns are ignored.

    A conversation becomes one string, so its turns meet in one task and must fit there; that is
    the result's own size, whatever the number of conversations. Beside it and its turns, memory holds indices for
    SCATTERED bytes.
    """
    id_type = turns.schema[conv_id].dataType.simpleString()
    row = turns.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("t"))
    grouped = row.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    alone = row.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns"))
    ready = grouped.unionByName(alone).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    return ready.mapInArrow(
        _batches, f"conv_id {id_type}, formatted string, loss_spans array<struct<start:long,end:long>>")


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Role and text of every turn, as they were before formatting."""
    found = _TURN.findall(formatted)
    if sum(len(r) + len(t) + len(TURN + TEXT + END) for r, t in found) != len(formatted):
        raise ValueError("not a formatted conversation")
    return [(None if r == NO_ROLE else unescape(r), unescape(t)) for r, t in found]


def digest(formatted: str, loss_spans: list[dict]) -> dict:
    """What the text and its mask say, read back: turns and learned text, with their digests."""
    turns = parse(formatted)
    data = formatted.encode()
    learned = "".join(unescape(data[s["start"]:s["end"]].decode()) for s in loss_spans)
    said = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
    return {
        "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
        "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
        "formatted_chars": len(formatted),
    }


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and ``digest`` of every formatted conversation."""
    def run(batches):
        for batch in batches:
            rows = [
                {"conv_id": c, **digest(f, s)}
                for c, f, s in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_spans")))]
            yield pa.RecordBatch.from_pylist(rows, schema)
    id_field = chats.schema["conv_id"]
    schema = pa.schema([
        ("conv_id", {"bigint": pa.int64(), "int": pa.int32()}.get(id_field.dataType.simpleString(), pa.string())),
        ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64())])
    return chats.mapInArrow(run, (
        f"conv_id {id_field.dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long,"
        " loss_sha256 string, formatted_chars long"))
