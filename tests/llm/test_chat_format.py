import hashlib
import tracemalloc

from hypothesis import given
from hypothesis import strategies as st
import pyarrow as pa

from lattis.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string, fragment long"


def run(spark, rows, **how):
    return {r["conv_id"]: r for r in C.digests(C.format_conversations(spark.createDataFrame(rows, TURNS), **how)).collect()}


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_read_back(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", odd, 0),
        (1, 1, "assistant", odd, 0),
        (2, 0, None, None, None),
        (2, None, "tool: x###</turn>", "é</turn", 0),
        (3, 1, "assistant", "", 0),
        (3, 0, "assistant", "\\h\\e\\\\", 0),
        (None, 0, "assistant", "no id", 0),
    ]
    found = run(spark, rows)
    for conv, turns in {1: [("user", odd), ("assistant", odd)], 2: [("tool: x###</turn>", "é</turn"), (None, None)], 3: [("assistant", "\\h\\e\\\\"), ("assistant", "")], None: [("assistant", "no id")]}.items():
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)


def test_a_conversation_in_many_fragments_equals_one_in_a_piece(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} ### </turn> \\ é" * (k % 7), 0) for k in range(300)]
    whole, cut = run(spark, rows), run(spark, rows, batch_bytes=200)
    assert whole == cut
    assert whole[1]["turns_sha256"] == expected([(r[2], r[3]) for r in rows])[1]
    fragments = C.format_conversations(spark.createDataFrame(rows, TURNS), batch_bytes=200).collect()
    assert [r["fragment"] for r in fragments] == list(range(len(fragments))) and len(fragments) > 5


def test_no_turns(spark):
    assert run(spark, []) == {}


@given(st.lists(st.text(alphabet="\\#</turn>heé\n:= a", max_size=20), min_size=1, max_size=6))
def test_escapes_are_reversible_and_hide_the_template(texts):
    coded = C.escape(pa.array(texts, pa.string())).to_pylist()
    assert [C.unescape(x) for x in coded] == texts
    assert not any("###" in x or "</turn>" in x for x in coded)
    assert [C.role_of(C.role_label(x)) for x in texts] == texts


def test_assembly_copies_every_segment():
    heads, contents = pa.array(["a", "", "ccc"]), pa.array(["", "éé", "x"])
    buffer, rows, _ = C.assemble(heads, contents, b"|")
    assert buffer.to_pybytes().decode() == "a|éé|cccx|" and rows.tolist() == [0, 2, 7, 12]


@given(st.lists(st.integers(0, 9), max_size=12))
def test_long_rows_between_short_ones(sizes):
    texts = [str(i) * n for i, n in enumerate(sizes)]
    whole = C.assemble(pa.array(["é"] * len(texts), pa.string()), pa.array(texts, pa.string()), b"|")
    usual = C.LONG
    C.LONG = 4
    try:
        cut = C.assemble(pa.array(["é"] * len(texts), pa.string()), pa.array(texts, pa.string()), b"|")
    finally:
        C.LONG = usual
    assert whole[0].to_pybytes() == cut[0].to_pybytes() == "".join(f"é{t}|" for t in texts).encode()
    assert whole[1].tolist() == cut[1].tolist()


def test_a_very_long_turn_takes_no_indices(spark):
    text = "\\### é </turn> " * 1_000_000
    heads, contents = pa.array(["a", "b", "c"]), pa.array(["x", text, "y"])
    tracemalloc.start()
    buffer, rows, _ = C.assemble(heads, contents, b"|")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20 and buffer.size == rows[-1] == len(text.encode()) + 8
    found = run(spark, [(1, 0, "user", "?", 0), (1, 1, "assistant", text, 0), (1, 2, "assistant", "", 0)])[1]
    assert (found["n_turns"], found["turns_sha256"], found["loss_chars"], found["loss_sha256"]) == expected([("user", "?"), ("assistant", text), ("assistant", "")])
