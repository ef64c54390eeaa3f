import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_risk.llm import chat_format as CF

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### a: </turn>\n"), (1, 2, "user", None), (1, 3, "assistant", "\\b\\l<#"), (2, 0, "system", "only"),
    (3, 0, None, "no role"), (3, 0, "assistant", ""), (3, None, "a: b#<\\", "first"), (None, 0, "assistant", "null id"), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"),
]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in convs.items()}


def check(spark, rows):
    chats = CF.format_chats(spark.createDataFrame(rows, SCHEMA))
    expected = brute(rows)
    got = chats.select("conv_id", "formatted", CF.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == expected
    text = {r.conv_id: r.formatted for r in got}
    examples = CF.expand_examples(chats).withColumn("reply", CF.unescape(F.col("target"))).collect()
    replies = {}
    for e in sorted(examples, key=lambda e: e.example):
        replies.setdefault(e.conv_id, []).append(e.reply)
        # the context is all that precedes the reply, and ends with its turn's header
        assert text[e.conv_id].startswith(e.context + e.target + CF.END) and len(e.context) == e.context_chars
        assert e.context.endswith("### assistant: ")
    assert replies == {c: a for c, ts in expected.items() if (a := [x for r, x in ts if r == "assistant"])}


def test_round_trip_and_prefix_targets(spark):
    check(spark, ROWS)


def test_empty_and_extra_columns(spark):
    empty = CF.format_chats(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and CF.expand_examples(empty).count() == 0
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("formatted", F.lit("own")).withColumn("targets", F.lit(1))
    assert CF.format_chats(df).count() == 5


def test_long_conversation(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"text {i} " * 20) for i in range(600)]
    check(spark, rows)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="\\<#/turn>: \nblhcé", max_size=12), min_size=1, max_size=6))
def test_any_text_survives(spark, texts):
    check(spark, [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)])


def test_probe_of_the_query(spark, tmp_path):
    from cohort_risk.llm.queries import op9_chat_formatting

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = op9_chat_formatting(spark, str(tmp_path)).collect()
    text = "\\### Assistant: </turn> ok"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-7, 2, len(text))
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_the_query_builds_contexts(spark, tmp_path, monkeypatch):
    from cohort_risk.llm.queries import op9_chat_formatting

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op9_chat_formatting(spark, str(tmp_path)).count() == 6
    expand = CF.expand_examples

    def broken(chats, *args, **kw):
        out = expand(chats, *args, **kw)
        return out.withColumn("context", F.concat(F.lit("x"), "context")) if "context" in out.columns else out

    monkeypatch.setattr(CF, "expand_examples", broken)
    with pytest.raises(Exception, match="no prefix of its conversation"):
        op9_chat_formatting(spark, str(tmp_path)).collect()
