"""Chat formatting by a finite-state machine over roles, with column expressions only.

A declarative template says how turns are marked, which roles are learned and which role may follow
which. The machine walks over the roles of a conversation and tells where the order breaks; every turn
becomes three text segments (opening, escaped text, closing), of which only the text of a learned role
carries the loss. Control strings inside texts are escaped, so what was written can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.session import column

ESCAPE = "\\"
#: State of the machine once a turn had no transition.
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """How a conversation is written.

    ``openings`` holds the mark of each known role; any other role is named between the two strings of
    ``other``. ``moves`` holds (state, role) -> next state; a conversation has to end in one of ``ends``.
    """

    openings: dict[str, str] = field(
        default_factory=lambda: {
            "system": "### System:", "user": "### User:", "assistant": "### Assistant:",
        }
    )
    other: tuple[str, str] = ("### (", "):")
    after_opening: str = " "
    closing: str = "</turn>"
    after_closing: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        controls = self.controls
        if any(not c or ESCAPE in c for c in (*controls, self.other[1])):
            raise ValueError("control strings must not be empty or hold the escape character")
        if len(controls) + 2 > len(ascii_lowercase):
            raise ValueError("too many control strings")
        marks = [*(o + self.after_opening for o in self.openings.values()), self.other[0]]
        if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < len(marks):
            raise ValueError("an opening must not begin with another one")
        end = self.closing + self.after_closing
        if any(end.startswith(end[k:]) for k in range(1, len(end))):
            raise ValueError("the closing must not begin with its own end")

    @property
    def controls(self) -> tuple[str, ...]:
        """Strings that must not stand in a text as they are, longer ones first."""
        return tuple(sorted({*self.openings.values(), self.other[0], self.closing}, key=lambda c: (-len(c), c)))


def _codes(template: Template, naming: bool) -> list[tuple[str, str]]:
    """Strings and what stands for them, the escape character first.

    A code is the escape character and one letter. Each escape character of an escaped text so begins
    a code, and plain replacements, in the other order, undo it.
    """
    strings = [ESCAPE, *template.controls] + ([template.other[1]] if naming else [])
    return [(s, ESCAPE + letter) for s, letter in zip(strings, ascii_lowercase)]


def escaped(text: Column, template: Template, naming: bool = False) -> Column:
    for string, code in _codes(template, naming):
        text = F.replace(text, F.lit(string), F.lit(code))
    return text


def unescaped(text: Column, template: Template, naming: bool = False) -> Column:
    for string, code in reversed(_codes(template, naming)):
        text = F.replace(text, F.lit(code), F.lit(string))
    return text


def _segments(turn: Column, template: Template) -> Column:
    """Opening, text and closing of one turn, each with its loss flag."""
    opening = F.concat(
        F.lit(template.other[0]), escaped(turn["role"], template, naming=True), F.lit(template.other[1])
    )
    for role, mark in template.openings.items():
        opening = F.when(turn["role"] == role, F.lit(mark)).otherwise(opening)
    parts = [
        (F.concat(opening, F.lit(template.after_opening)), F.lit(False)),
        (escaped(turn["text"], template), turn["role"].isin(*template.learned)),
        (F.lit(template.closing + template.after_closing), F.lit(False)),
    ]
    return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])


def _walk(turns: Column, template: Template) -> Column:
    """State after the last turn and the place of the first turn without a transition (else null)."""
    moves = F.create_map(
        *[F.lit(v) for (state, role), after in template.moves.items() for v in (f"{state} {role}", after)]
    )

    def step(at: Column, turn: Column) -> Column:
        after = F.try_element_at(moves, F.concat(at["state"], F.lit(" "), turn["role"]))
        breaks = after.isNull() & at["broken_at"].isNull()
        return F.struct(
            F.coalesce(after, F.lit(BROKEN)).alias("state"), (at["place"] + 1).alias("place"),
            F.when(breaks, at["place"]).otherwise(at["broken_at"]).alias("broken_at"),
        )

    begin = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("place"),
        F.lit(None).cast("long").alias("broken_at"),
    )
    return F.aggregate(turns, begin, step)


def format_chats(
    turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: its id, ``segments`` (text, loss), ``formatted`` (all segments joined),
    ``valid`` and ``broken_at``.

    Rows come in the order of their turn, nulls first; ties go by role, then text. ``valid`` says whether
    the machine takes the order of roles and ends well; ``broken_at`` is the number (from 0) of the
    first turn that it refuses, or the number of turns if only the end is wrong. Conversations it
    refuses are formatted all the same. Null texts and null roles are empty; a null id is a conversation
    of its own; repeated rows are turns of their own. Further columns are left out, whatever their names.
    An empty table gives an empty table. A formatted conversation is one value, so it has to stay
    below Spark's 2 GB for a value; its length is not bounded otherwise.
    """
    template = template or Template()
    rows = turns.select(
        column(conv).alias("conv"),
        F.struct(
            column(turn).alias("turn"), F.coalesce(column(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    walked = whole.select(
        "conv", F.size("turns").cast("long").alias("n"), _walk(F.col("turns"), template).alias("end"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    )
    ends_well = F.col("end.broken_at").isNull() & F.col("end.state").isin(*template.ends)
    return walked.select(
        "conv", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        ends_well.alias("valid"),
        F.when(~ends_well, F.coalesce("end.broken_at", "n")).alias("broken_at"),
    ).withColumnRenamed("conv", conv)


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted conversation was written from, unescaped."""
    template = template or Template()
    end = re.escape(template.closing + template.after_closing)
    pieces = F.split(formatted, end)

    def turn(piece: Column) -> Column:
        # The name of another role lies between the two strings; its own ones are escaped.
        first = len(template.other[0])
        last = F.locate(template.other[1] + template.after_opening, piece)
        name = unescaped(piece.substr(F.lit(first + 1), last - F.lit(first + 1)), template, naming=True)
        rest = piece.substr(last + len(template.other[1] + template.after_opening), F.length(piece))
        found = F.struct(name.alias("role"), unescaped(rest, template).alias("text"))
        for role, opening in template.openings.items():
            mark = opening + template.after_opening
            body = unescaped(piece.substr(F.lit(len(mark) + 1), F.length(piece)), template)
            known = F.struct(F.lit(role).alias("role"), body.alias("text"))
            found = F.when(F.startswith(piece, F.lit(mark)), known).otherwise(found)
        return found

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss, in order, nothing between, unescaped."""
    learned = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"])
    return unescaped(F.array_join(learned, ""), template or Template())
