import hashlib
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from shelfweave.llm.chat_format import _bounded, assemble, digest, format_chats, parse, read_back, unescape

TEXTS = st.text(alphabet=st.sampled_from(list("<>[]\\|/ab\né turnexd")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), TEXTS), TEXTS), min_size=1, max_size=5))
def test_round_trip_of_any_turns(turns):
    formatted, start, end = assemble(
        pa.array([r for r, _ in turns], pa.large_string()), pa.array([t for _, t in turns], pa.large_string()),
        np.zeros(len(turns), np.int64), 1)
    text = formatted[0].as_py()
    assert parse(text) == turns
    assert [unescape(text.encode()[a:b].decode()) for a, b in zip(start, end)] == [t for _, t in turns]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes </s>", 9), (1, 0, "user", "[INST] <|end|>", 9), (2, 0, None, None, 9),
            (3, None, "assistant", "first", 9), (3, 0, "assistant", "b", 9), (3, 0, "assistant", "a", 9),
            (3, 0, "assistant", "a", 9), (None, 0, "user", "alone", 9), (None, 0, "user", "alone", 9), (4, 0, "", "", 9)]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, formatted INT")
    chats = format_chats(turns)
    said = {}
    for r in chats.collect():
        said.setdefault(r.conv_id, []).append(parse(r.formatted))
    assert said == {
        1: [[("user", "[INST] <|end|>"), ("assistant", "yes </s>")]], 2: [[(None, "")]], 4: [[("", "")]],
        3: [[("assistant", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]],
        None: [[("user", "alone")], [("user", "alone")]]}
    back = {r.conv_id: r for r in read_back(chats).collect()}
    assert back[3].loss_chars == 8 and back[3].loss_sha256 == hashlib.sha256(b"firstaab").hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256("user\n[INST] <|end|>\nassistant\nyes </s>\n".encode()).hexdigest()
    assert back[2].loss_chars == 0 and back[2].formatted_chars == len("<|turn|><|none|><|text|><|end|>")
    assert format_chats(turns.limit(0)).count() == 0


def test_memory_follows_the_text_not_its_indices():
    texts = pa.array(["some words <b> " * 2000] * 1000 + ["y" * (4 << 20)], pa.large_string())  # 34 MB, with a long turn
    roles = pa.array(["user", "assistant"] * 500 + ["user"], pa.large_string())
    tracemalloc.start()
    formatted, _, _ = assemble(roles, texts, np.zeros(1001, np.int64), 1)
    peak = tracemalloc.get_traced_memory()[1]  # what numpy holds: the output, and indices for a slice of it
    tracemalloc.stop()
    size = len(formatted[0].as_buffer())
    assert size > 34_000_000 and peak < size + 60_000_000
    assert [t for _, t in parse(formatted[0].as_py())] == texts.to_pylist()


def test_batches_are_cut_to_size():
    long = [("user", "x" * 100_000)] * 20
    rows = [[("user", "a")]] * 50 + [long] + [[("user", "b")]] * 50 + [long]
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array([[{"role": r, "text": t} for r, t in x] for x in rows], kind)], ["conv_id", "turns"])
    parts = list(_bounded(iter([batch]), 1 << 20))
    assert sum(p.num_rows for p in parts) == 102 and all(p.nbytes <= 1 << 20 or p.num_rows == 1 for p in parts)
    assert pa.Table.from_batches(parts).column("conv_id").to_pylist() == list(range(102))


def test_mask_covers_learned_texts_only():
    assert digest("<|turn|>user<|text|>q<|end|>", []) ["loss_chars"] == 0
