"""Chat formatting: what is written can be read back, and the machine judges the order of roles."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rowlens.llm.chat import Template, escaped, format_chats, loss_text, read_turns, unescaped

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "\\a", "\\b", "### Assistant:", "### System: ", "### User:", "</turn>", "</turn>\n", "### (",
          "): ", "###", "</tur", "n>", " ", "\n", "é", "日本", "ok", ""]


def awkward_rows():
    pick = random.Random(3)
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi </turn>"),
        (2, None, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
        (3, 0, None, "no role"), (3, 1, "tool): x", "\\### (a): "), (3, 2, "", "empty role"),
        (4, 0, "assistant", "first"), (None, 0, "user", "no id"), (None, 0, "assistant", "no id"),
        (5, 0, "user", "only"), (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "</turn>\n" * 20_000),
    ]
    for conv in range(100, 160):
        for turn in range(pick.randrange(1, 7)):
            text = "".join(pick.choice(PIECES) for _ in range(pick.randrange(8)))
            rows.append((conv, turn, pick.choice(["system", "user", "assistant", "tool", "### (x):"]), text))
    return rows


def plain_order(rows):
    """Turns (role, text) of each conversation."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def plain_break(roles):
    """The first turn out of order, the number of turns if the end is missing, None if all is well."""
    follows = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    before = None
    for k, role in enumerate(roles):
        if role not in follows.get(before, ()):
            return k
        before = role
    return None if roles and roles[-1] == "assistant" else len(roles)


def test_read_back_what_was_written(spark):
    rows = awkward_rows()
    pick = random.Random(5)
    shuffled = pick.sample(rows, len(rows))
    table = spark.createDataFrame(shuffled, SCHEMA).repartition(4)
    found = format_chats(table).select(
        "conv_id", "formatted", "valid", "broken_at", read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("learned"), F.col("segments.loss").alias("loss"),
    ).collect()
    plain = plain_order(rows)
    assert {r["conv_id"] for r in found} == set(plain) and len(found) == len(plain)
    for row in found:
        turns = plain[row["conv_id"]]
        assert [tuple(t) for t in row["turns"]] == turns
        assert row["learned"] == "".join(text for role, text in turns if role == "assistant")
        assert sum(row["loss"]) == sum(role == "assistant" for role, _ in turns)
        assert row["formatted"].count("</turn>") == len(turns)
        at = plain_break([role for role, _ in turns])
        assert (row["valid"], row["broken_at"]) == (at is None, at)


def test_escaping_leaves_no_control_string(spark):
    template = Template()
    pick = random.Random(7)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randrange(12))) for _ in range(500)]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, safe, back in table.select(
        "text", escaped(F.col("text"), template), unescaped(escaped(F.col("text"), template), template)
    ).collect():
        assert back == text
        assert not any(control in safe for control in template.controls)


def test_own_template_clashing_names_and_empty_table(spark):
    template = Template(
        openings={"human": "<h>", "bot": "<b>"}, other=("<?", ">"), after_opening="", closing="<end>",
        after_closing="", learned=("bot", "human"), moves={("start", "bot"): "done"}, ends=("done",),
    )
    rows = [(1, 0, "bot", "a<h>b", "x", "y"), (2, 0, "human", "c", "x", "y"), (2, 1, "third", "d", "x", "y")]
    table = spark.createDataFrame(
        rows, "formatted long, turn long, role string, text string, conv string, segments string"
    )
    found = format_chats(table, template, conv="formatted").toDF("id", "segments", "whole", "valid", "broken_at")
    rows = {r["id"]: r for r in found.select("*", read_turns(F.col("whole"), template).alias("turns")).collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [("bot", "a<h>b")] and rows[1]["valid"]
    assert [tuple(t) for t in rows[2]["turns"]] == [("human", "c"), ("third", "d")] and rows[2]["broken_at"] == 0
    assert format_chats(table.limit(0), template, conv="formatted").count() == 0


@pytest.mark.parametrize("wrong", [
    {"closing": "</t\\"}, {"closing": "aba", "after_closing": ""}, {"openings": {"a": "##", "b": "###"}, "after_opening": ""},
])
def test_template_that_cannot_be_read_back(wrong):
    with pytest.raises(ValueError):
        Template(**wrong)


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame(awkward_rows()[:3], SCHEMA).select("conv_id", "turn", "role", "text")
    found = format_chats(table).select(read_turns(F.col("formatted")), loss_text(F.col("segments")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_query_on_written_table(spark, tmp_path):
    from rowlens.llm.queries import CONTROL_TEXT, QUERIES

    rows = awkward_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plain = plain_order([*rows, (-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)])
    found = {r["conv_id"]: r for r in QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()}
    assert found.keys() == plain.keys()
    for conv, turns in plain.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        lines = "".join(f"{role}\n{text}\n" for role, text in turns)
        row = found[conv]
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(learned)
        assert row["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
