import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from blobtrail.llm import chat

TRICKY = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "\\", "\n", "<", "|", "ok", "é", ""])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_concatenated_turns_parse_back(turns):
    segments = [chat.render_turn(r, t) for r, t in turns]
    assert chat.parse("".join(s[0] for s in segments)) == turns
    for (_, text), (seg, a, b, _) in zip(turns, segments):
        assert chat.unescape_text(seg[a:b]) == text


def test_only_conflicts_are_escaped():
    assert chat.render_turn("user", "plain <b> \\ text")[0] == "<|im_start|>user\nplain <b> \\ text<|im_end|>\n"
    assert chat.render_turn("user", chat.HOSTILE)[3] == 1


def test_parser_refuses_what_is_not_in_the_grammar():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u\na<|im_start|>v\nb<|im_end|>\n"):
        assert chat.parse(bad) is None


def test_conversations_with_nulls_ties_and_clashing_columns(spark):
    rows = [
        (1, 0, "user", "hi", "s"),
        (1, 1, "assistant", None, "s"),
        (1, 1, "assistant", "b", "s"),
        (1, 1, "assistant", "b", "s"),
        (2, None, None, chat.HOSTILE, "s"),
        (None, 0, "assistant", "lone", "s"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, None}
    want = "user\nhi\nassistant\n\nassistant\nb\nassistant\nb\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df)).count() == 0
