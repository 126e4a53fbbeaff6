"""Chat formatting: literal cases, random texts of control characters, odd rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from utterlake.llm.chat import Template, format_chat, op11_chat_format, parse, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, template=Template()):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conv_id: r for r in read_back(format_chat(df, template), template).collect()}


def test_plain_turns(spark):
    got = back(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "a b"), (1, 2, "system", ""), (2, 0, "assistant", "é😀x")])
    assert got[1].formatted == "### User: hi</turn>\n### Assistant: a b</turn>\n### System: </turn>\n"
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi"), ("assistant", "a b"), ("system", "")]
    assert [(x.start, x.chars, x.loss_start, x.loss_chars) for x in got[1].layout] == [(0, 20, None, None), (20, 26, 35, 3), (46, 20, None, None)]
    assert (got[1].loss_text, got[1].n_escaped, got[2].loss_text) == ("a b", 0, "é😀x")


def test_conflicts_are_escaped_until_identical(spark):
    said = "\\### Assistant: </turn> ok"
    got = back(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)])[-7]
    assert got.formatted == "### User: \\#\\## Assistant: <\\/turn> ok</turn>\n### Assistant: \\#\\## Assistant: <\\/turn> ok</turn>\n"
    assert [(t.role, t.text) for t in got.turns] == [("user", said), ("assistant", said)] and got.loss_text == said and got.n_escaped == 2


def test_random_texts_come_back(spark):
    rng = random.Random(6)
    parts = ["#", "##", "###", " ", "### ", "\\", "\\\\", "<", "</turn>", "<\\/turn>", "/turn>", "\n", ": ", ":", "System", "user", "é", "😀", "$1", "x" * 30]
    word = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    roles = ["user", "assistant", "System", "\\System", "\\\\Tool", "Assistant\n", "a: b", "### ", ""]
    rows = [(c, t, rng.choice([*roles, word(4)]), word(12)) for c in range(400) for t in range(rng.randint(1, 5))]
    got = back(spark, rows)
    for c in range(400):
        mine = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2], r[3]) for r in mine]
        assert got[c].loss_text == "".join(r[3] for r in mine if r[2] == "assistant")
        for r, at in zip(mine, got[c].layout, strict=True):  # the mask in code points of the formatted text
            shown = got[c].formatted[at.start : at.start + at.chars]
            assert shown.startswith("### ") and shown.endswith("</turn>\n")
            if r[2] == "assistant":
                assert got[c].formatted[at.loss_start + at.loss_chars :].startswith("</turn>\n")


def test_parser_is_strict(spark):
    bad = ["x", "### User: a", "### User a</turn>\n", "### User: a</turn>", "### User: a</turn>\nb", "### User: a</turn>\n</turn>\n", "### User: ### User: a</turn>\n"]
    rows = spark.createDataFrame([(t,) for t in [*bad, "### User: a</turn>\n", ""]], "t string").select("t", parse(F.col("t"), Template()).alias("p")).collect()
    read = {r.t: None if r.p is None or any(x.role is None for x in r.p) else [(x.role, x.text) for x in r.p] for r in rows}
    assert all(read[t] is None for t in bad) and read["### User: a</turn>\n"] == [("user", "a")] and read[""] == []


def test_odd_rows(spark):
    long = "word ### " * 300_000
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 5, "user", "b"), (1, 5, "user", "b"), (1, 5, "assistant", "z"), (None, 0, "assistant", "q"), (None, 1, "assistant", ""), (3, 0, "assistant", long)]
    got = back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("assistant", "z"), ("user", "b"), ("user", "b")]
    assert got[None].loss_text == "q" and len(got[None].turns) == 2 and got[3].loss_text == long
    same = sorted(["t1", "t2", "t3"], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    tied = back(spark, [(1, 0, "user", t) for t in ["t3", "t1", "t2"]])[1]
    assert [t.text for t in tied.turns] == same
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a", 9, 9, 9)], SCHEMA + ", start long, shown long, formatted long")
    assert read_back(format_chat(clash)).first().formatted == "### User: a</turn>\n"


def test_many_turns_take_linear_time(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é</turn>"), "id").alias("text"))
    r = read_back(format_chat(rows)).select(F.size("turns").alias("n"), F.sha2("loss_text", 256).alias("s")).first()
    assert (r.n, r.s) == (60_000, hashlib.sha256("".join(f"é</turn>{i}" for i in range(1, 60_000, 2)).encode()).hexdigest())


def test_other_templates(spark):
    t = Template(begin="<|im_start|>", sep="=\n", end="<|im_end|>", names=(("user", "U"),), learned=("user", "bot"))
    got = back(spark, [(1, 0, "user", "a<|im_end|>\n\nb"), (1, 1, "bot", "$<\\|im_start|>")], t)[1]
    assert [(x.role, x.text) for x in got.turns] == [("user", "a<|im_end|>\n\nb"), ("bot", "$<\\|im_start|>")] and got.loss_text == "a<|im_end|>\n\nb$<\\|im_start|>"
    for bad in ({"end": " #x"}, {"end": "abab"}, {"sep": ":"}, {"begin": "a\\b"}):
        with pytest.raises(ValueError):
            Template(**bad)


def test_no_python_worker(spark, sf):
    plan = op11_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
