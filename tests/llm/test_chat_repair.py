"""Conversation repair against all edits (short ones) and against a plain search with whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rowlens.llm.chat_repair import (
    Automaton,
    Repair,
    Weights,
    damaged_turns,
    judged_turns,
    repair_chats,
    repaired_turns,
)
from rowlens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
#: What a plain automaton does with an initial, by state: start, told, asked, answered.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 0
        if not body:
            fault = 1
        elif (role, text) in seen:
            fault = 2
        elif body[-1] not in ".!?":
            fault = 3
        faults.append(fault)
        seen.add((role, text))
    return faults


def all_edits(rows, faults):
    """The cheapest (cost, audit) by trying everything with at most two inserts at a place."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for (role, _), fault in zip(rows, faults):
        own = [("D", "", 4)]
        if fault not in (1, 2):
            more = 3 if fault == 3 else 0
            own += [("K", role[:1], more)] + [("R", c, 3 + more) for c in "ua"]
        choices.append(own)
    best = None
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            initials = "".join(a + e[1] for a, e in zip(added, edits)) + added[-1]
            if re.fullmatch(r"(s?(ua)+)?", initials):
                cost = sum(e[2] for e in edits) + 3 * sum(map(len, added))
                audit = "".join("I" * len(a) + e[0] for a, e in zip(added, edits)) + "I" * len(added[-1])
                best = min(best or (cost, audit), (cost, audit))
    return best


def plain_repair(rows, faults):
    """The cheapest (cost, audit, repaired) over states, with whole audits and texts."""
    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit, kept) in list(states.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    after = NEXT.get((state, c))
                    new = (cost + 3, audit + "I", [*kept, role + ":"])
                    if after is not None and new[:2] < states.get(after, (10**9,))[:2]:
                        states[after] = new
        return states

    states = {0: (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        found = {}
        for state, (cost, audit, kept) in inserted(states).items():
            options = [(state, (cost + 4, audit + "D", kept))]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                options.append((NEXT.get((state, role[:1])), (cost + more, audit + "K", [*kept, f"{role}:{text}"])))
                for c, given in (("u", "user"), ("a", "assistant")):
                    options.append(
                        (NEXT.get((state, c)), (cost + more + 3, audit + "R", [*kept, f"{given}:{text}"]))
                    )
            for after, new in options:
                if after is not None and new[:2] < found.get(after, (10**9,))[:2]:
                    found[after] = new
        states = found
    ends = inserted(states)
    cost, audit, kept = min(ends[s] for s in (0, 3) if s in ends)
    return cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def repaired(rows, faults):
    run = Repair(Automaton(), Weights())
    for (role, text), fault in zip(rows, faults):
        run.row(role, text, fault)
    cost, steps, digest = run.result()
    return cost, "".join(letters for letters, _, _ in steps), digest


def some_rows(pick, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", "umpire"]
    texts = ["Fine.", "Cut", "", "  ", "Other!", "More? "]
    return [(pick.choice(roles), pick.choice(texts)) for _ in range(pick.randrange(most + 1))]


def test_against_all_edits():
    pick = random.Random(1)
    for _ in range(150):
        rows = some_rows(pick, 3)
        faults = plain_faults(rows)
        assert repaired(rows, faults)[:2] == all_edits(rows, faults), rows


def test_against_plain_search():
    pick = random.Random(2)
    for _ in range(600):
        rows = some_rows(pick, 14)
        faults = plain_faults(rows)
        assert repaired(rows, faults) == plain_repair(rows, faults), rows


def test_other_grammar():
    """One turn of a system, then any number of users."""
    automaton = Automaton((("S", "sQ"), ("Q", ""), ("Q", "Qu")))
    run = Repair(automaton, Weights())
    for role in ("system", "assistant", "user"):
        run.row(role, "Fine.", 0)
    cost, steps, _ = run.result()
    assert (cost, "".join(letters for letters, _, _ in steps)) == (3, "KRK")


def plain_conversations(rows):
    """What the query has to return, by conversation."""
    found = {}
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows = [r[1:] for r in own]
        faults = plain_faults(rows)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, *plain_repair(rows, faults))
    return out


@pytest.fixture(scope="module")
def conversations():
    pick = random.Random(4)
    rows = [
        (1, None, "user", "Fine."), (1, None, None, None), (2, 5, None, "x."), (None, 0, "user", "A."),
        (None, 0, "user", "A."), (None, 3, "assistant", "Fine."), (3, 1, "user", "A."), (3, 1, "assistant", "B."),
        (3, 9, "user", "y" * 200_000 + "."),
    ]
    rows += [(4, turn, "user" if turn % 2 else "assistant", f"Text {turn % 700}.") for turn in range(3000)]
    for conv in range(10, 400):
        for turn, said in enumerate(some_rows(pick, 9)):
            rows.append((conv, turn * pick.choice([1, 1, 2]), *said))
    return rows


def test_query(spark, conversations, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(conversations, SCHEMA).write.parquet(path)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "37")
    try:
        found = QUERIES["op13_chat_repair"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(batch, before)
    plain = plain_conversations(conversations)
    assert len(found) == len(plain)
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain


def test_repaired_turns_have_the_digest(spark, conversations):
    judged = damaged_turns(spark.createDataFrame(conversations, SCHEMA))
    digests = {r["conv"]: r["repaired_sha256"] for r in repair_chats(judged).collect()}
    lines = {}
    for row in sorted(repaired_turns(judged).collect(), key=lambda r: r["at"]):
        lines.setdefault(row["conv"], []).append(f"{row['role']}:{row['text']}")
    for conv, digest in digests.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest


def test_clashing_names_and_empty_table(spark):
    rows = [("a", 0, "user", "Hi.", 1, 2, 3), ("a", 1, "assistant", "Yes.", 1, 2, 3)]
    table = spark.createDataFrame(rows, "place string, fault long, role string, text string, conv long, gone long, copy long")
    judged = judged_turns(table, "place", "fault")
    found = repair_chats(judged).collect()
    assert [(r["conv"], r["cost"], r["audit"]) for r in found] == [("a", 0, "KK")]
    assert repair_chats(judged_turns(table.limit(0), "place", "fault")).count() == 0
    assert repaired_turns(judged_turns(table.limit(0), "place", "fault")).count() == 0


def test_conversation_whose_rows_are_all_gone(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")], SCHEMA)
    judged = judged_turns(table, dropped=F.col("conv_id") == 1)
    found = {r["conv"]: tuple(r)[1:] for r in repair_chats(judged).collect()}
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found[2][5:7] == (3, "KI")
