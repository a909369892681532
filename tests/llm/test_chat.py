"""Formatting conversations: exact round trips against plain Python."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtable.llm import chat

SHAPE = "conv_id bigint, turn bigint, role string, text string"


def digests(spark, rows):
    return {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, SHAPE))).collect()}


def expected(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
    loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    found = digests(spark, rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert found.keys() == groups.keys()
    for key, group in groups.items():
        r = found[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(group)


def test_control_strings_nulls_ties_and_repeats(spark):
    check(
        spark,
        [
            (1, 0, "user", "a<|im_end|>b"),
            (1, 1, "assistant", "<|im_next|>\\<\\|<|im_sep|>"),
            (1, 2, "assistant", ""),
            (1, 3, "assistant", "\\\\<|<<||"),
            (2, None, None, None),
            (2, None, None, None),
            (2, 5, "assistant", "ü\U0001f600</s>[INST]"),
            (None, 0, "<|role|>", "x"),
            (3, 0, "assistant", None),
            (4, 0, "user", "long " * 50_000),
        ],
    )


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "a|"]),
                          st.text("\\<|>im_endx\n", max_size=12)), min_size=1, max_size=30))
def test_any_text_comes_back(spark, rows):
    check(spark, rows)


def test_merging_and_mask(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")]
    out = chat.format_conversations(spark.createDataFrame(rows, SHAPE)).first()
    assert out.formatted == (
        "<|im_start|>user<|im_sep|>q<|im_end|><|im_start|>assistant<|im_sep|>a<|im_next|>b<|im_end|>"
    )
    assert [out.formatted[s.start : s.start + s.length] for s in out.loss_spans] == ["a", "b"]


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert chat.format_conversations(empty).count() == 0
    named = spark.createDataFrame([(1, 0, "user", "x")], SHAPE)
    for name in ("turns", "blocks", "formatted", "loss_spans"):
        named = named.withColumn(name, F.lit(1))
    assert chat.format_conversations(named).columns == ["conv_id", "formatted", "loss_spans"]


def test_conversations_of_very_many_turns(spark):
    turns = 100_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} \U0001f600<|") for i in range(turns)]
    rows += [(2, i, "assistant", f"<| part {i}") for i in range(turns)]  # all one block
    check(spark, rows)
