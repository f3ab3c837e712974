"""Repair of conversation structure by generalised LR over the role grammar.

Roles are read by their initials. The grammar's LR automaton runs over a conversation with a
graph-structured stack: every row may be kept, get another role or be deleted, and turns may be inserted
before it, each at a weight. Stacks with equal tops are merged by the smallest (cost, audit), so a row
costs the same however long the conversation is. The rows of a conversation stream through a task in
the order of their turns; what is held per row of the present conversation is its edits, not its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import extended
from rowlens.session import column

#: Productions; small letters stand for rows by the initial of their role. The first name is the start.
ROLE_GRAMMAR = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "ua"), ("P", "Pua"))
#: Roles that a row may get and that may be inserted, by initial.
GIVEN_ROLES = {"u": "user", "a": "assistant"}
#: Adjacent initials that are in order.
IN_ORDER = frozenset({"su", "ua", "au"})
SPACE = r"\x20\x09-\x0D"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Weights:
    """Costs of the edits; a row cut off costs more unless it is deleted."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Automaton:
    """The LR automaton of a grammar without lookahead, and its stacks as linked, shared nodes.

    A stack is a number; ``push`` gives the stacks after a terminal and any reductions. Left recursion
    keeps the number of different stacks small.
    """

    def __init__(self, grammar=ROLE_GRAMMAR):
        self.grammar = grammar
        self.names = {left for left, _ in grammar}
        self.terminals = "".join(sorted({c for _, right in grammar for c in right} - self.names))
        self._state_of: dict[frozenset, int] = {}
        self._items: list[frozenset] = []
        self._stack_of: dict[tuple[int, int], int] = {}
        self._stacks: list[tuple[int, int]] = []
        self._pushed: dict[tuple[int, str], tuple[int, ...]] = {}
        self._ends: dict[int, bool] = {}
        left = grammar[0][0]
        first = self._state(frozenset((k, 0) for k, (name, _) in enumerate(grammar) if name == left))
        self.empty = self._stack(first, -1)
        self.begin = self._useful(self._settled(self.empty)[0])

    def _state(self, kernel: frozenset) -> int:
        items, waiting = set(kernel), list(kernel)
        while waiting:
            k, dot = waiting.pop()
            for name in self.grammar[k][1][dot : dot + 1]:
                more = {(j, 0) for j, (left, _) in enumerate(self.grammar) if left == name} - items
                items |= more
                waiting += more
        whole = frozenset(items)
        if whole not in self._state_of:
            self._state_of[whole] = len(self._items)
            self._items.append(whole)
        return self._state_of[whole]

    def _stack(self, state: int, below: int) -> int:
        if (state, below) not in self._stack_of:
            self._stack_of[state, below] = len(self._stacks)
            self._stacks.append((state, below))
        return self._stack_of[state, below]

    def _after(self, stack: int, symbol: str) -> int | None:
        """The stack with a terminal or a name on top, if the automaton goes on there."""
        items = self._items[self._stacks[stack][0]]
        kernel = {(k, dot + 1) for k, dot in items if self.grammar[k][1][dot : dot + 1] == symbol}
        return self._stack(self._state(frozenset(kernel)), stack) if kernel else None

    def _reduced(self, stack: int) -> Iterator[tuple[int, str]]:
        """Stack and name of each production that ends here, before the name is put on top."""
        for k, dot in sorted(self._items[self._stacks[stack][0]]):
            name, right = self.grammar[k]
            if dot == len(right):
                under = stack
                for _ in right:
                    under = self._stacks[under][1]
                yield under, name

    def _settled(self, stack: int) -> tuple[set[int], bool]:
        """Stacks that reductions make of this one, itself included, and whether the start is found."""
        found, waiting, ends = {stack}, [stack], False
        while waiting:
            for under, name in self._reduced(waiting.pop()):
                ends |= under == self.empty and name == self.grammar[0][0]
                after = self._after(under, name)
                if after is not None and after not in found:
                    found.add(after)
                    waiting.append(after)
        return found, ends

    def push(self, stack: int, terminal: str) -> tuple[int, ...]:
        if (stack, terminal) not in self._pushed:
            after = self._after(stack, terminal)
            found = self._settled(after)[0] if after is not None else ()
            self._pushed[stack, terminal] = self._useful(found)
        return self._pushed[stack, terminal]

    def _useful(self, stacks: Iterable[int]) -> tuple[int, ...]:
        """Those that take a terminal, and one that ends the sentence if none of these does."""
        useful = sorted(s for s in stacks if any(self._after(s, t) is not None for t in self.terminals))
        if not any(map(self.ends, useful)):
            useful += sorted(s for s in stacks if self.ends(s))[:1]
        return tuple(useful)

    def ends(self, stack: int) -> bool:
        """Whether all read so far is a sentence of the grammar."""
        if stack not in self._ends:
            self._ends[stack] = self._settled(stack)[1]
        return self._ends[stack]


@dataclass(slots=True)
class _Top:
    """The cheapest way to a stack.

    ``rank`` orders the audits of all tops: those of equal cost differ before one of them ends, and each
    row adds inserts and one other letter, so comparing what rows add, row by row, compares whole audits.
    ``trail`` links (before, letters, inserted initials, initial of the row); ``digest`` has
    everything kept so far.
    """

    cost: int
    rank: int
    trail: tuple | None
    digest: object
    inserted: str = ""


class Repair:
    """One conversation: rows go in, the cheapest edits come out."""

    def __init__(self, automaton: Automaton, weights: Weights):
        self.automaton, self.weights = automaton, weights
        self.tops = {stack: _Top(0, 0, None, None) for stack in automaton.begin}

    def _with_inserts(self) -> dict[int, _Top]:
        """All tops that inserted turns lead to, the present ones included."""
        best, waiting = dict(self.tops), list(self.tops)
        while waiting:
            stack = waiting.pop()
            top = best[stack]
            cost = top.cost + self.weights.insert
            for initial in GIVEN_ROLES:
                for after in self.automaton.push(stack, initial):
                    known = best.get(after)
                    if known is None or (cost, top.rank) < (known.cost, known.rank):
                        best[after] = _Top(cost, top.rank, top.trail, top.digest, top.inserted + initial)
                        waiting.append(after)
        return best

    def row(self, role: str, text: str, fault: int) -> None:
        """Take the next row in."""
        weights, initial = self.weights, role[:1]
        found: dict[int, tuple] = {}

        def offer(after: int, cost: int, top: _Top, letter: str, kept: str) -> None:
            key = (cost, top.rank, "I" * len(top.inserted) + letter)
            if after not in found or key < found[after][0]:
                found[after] = key, top, kept

        for stack, top in self._with_inserts().items():
            offer(stack, top.cost + weights.delete, top, "D", "")
            if fault in (BLANK, DUPLICATE):
                continue
            cost = top.cost + (weights.truncated if fault == TRUNCATED else 0)
            if initial and initial in self.automaton.terminals:
                for after in self.automaton.push(stack, initial):
                    offer(after, cost, top, "K", initial)
            for given in GIVEN_ROLES:
                if given != initial:
                    for after in self.automaton.push(stack, given):
                        offer(after, cost + weights.rerole, top, "R", given)
        ranks = {key: k for k, key in enumerate(sorted({key[1:] for key, _, _ in found.values()}))}
        tops = {}
        for stack, (key, top, kept) in found.items():
            digest = _inserted(top)
            if kept:
                digest = _added(digest, f"{role if key[2][-1] == 'K' else GIVEN_ROLES[kept]}:{text}")
            tops[stack] = _Top(key[0], ranks[key[1:]], (top.trail, key[2], top.inserted, kept), digest)
        self.tops = tops

    def result(self) -> tuple[int, list[tuple[str, str, str]], str]:
        """Cost, per row (and once after the last) letters, inserted initials and the row's initial, and
        the SHA-256 of the repaired turns."""
        ends = {s: t for s, t in self._with_inserts().items() if self.automaton.ends(s)}
        top = min(ends.values(), key=lambda t: (t.cost, t.rank, len(t.inserted)))
        steps = [("I" * len(top.inserted), top.inserted, "")]
        trail = top.trail
        while trail is not None:
            trail, letters, inserted, kept = trail
            steps.append((letters, inserted, kept))
        digest = _inserted(top)
        return top.cost, steps[::-1], (digest or hashlib.sha256()).hexdigest()


def _added(digest, line: str):
    """A digest with one more line; the one before stays as it is."""
    after = hashlib.sha256() if digest is None else digest.copy()
    after.update(("" if digest is None else "\n").encode() + line.encode())
    return after


def _inserted(top: _Top):
    digest = top.digest
    for initial in top.inserted:
        digest = _added(digest, f"{GIVEN_ROLES[initial]}:")
    return digest


def judged_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    dropped: Column | None = None, copies: Column | None = None,
) -> DataFrame:
    """Rows (conv, place, turn, role, text, gone, fault) with the first fault of each.

    Rows are placed by turn (nulls first), then role and text. ``dropped`` marks rows that only tell that
    there is such a conversation; ``copies`` is how often a row comes. Null roles and texts are
    one blank. Rows of one conversation lie in one partition, in order.
    """
    named = turns.select(
        column(conv).alias("conv"), column(turn).alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(False) if dropped is None else dropped).alias("gone"),
        (F.lit(1) if copies is None else copies).alias("copies"),
    )
    rows = named.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).repartition("conv")
    # Of equal rows of one turn the first is the one not seen before.
    order = Window.partitionBy("conv").orderBy("turn", "role", "text", "gone", "before")
    seen = Window.partitionBy("conv", "gone", "role", "text").orderBy("turn", "copy")
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK)
        .when(F.col("before") > 1, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED)
        .otherwise(FINE)
    )
    return (
        rows.withColumn("before", F.row_number().over(seen))
        .withColumn("place", F.row_number().over(order).cast("long"))
        .select("conv", "place", "turn", "role", "text", "gone", fault.alias("fault"))
    )


@dataclass
class _Conversation:
    """Counts over the rows of one conversation, beside its repair."""

    conv: object
    repair: Repair
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    first: int | None = None
    last: int | None = None
    turns: int = 0
    initial: str | None = None
    places: list[int] = field(default_factory=list)

    def row(self, place: int, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in IN_ORDER:
            self.illegal += 1
        self.initial = role[:1]
        self.places.append(place)
        self.repair.row(role, text, fault)

    def facts(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, steps, digest = self.repair.result()
        audit = "".join(letters for letters, _, _ in steps)
        return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit, digest

    def edits(self) -> Iterator[tuple]:
        """(conv, place of the row, inserts after it?, edit, role given), in order."""
        _, steps, _ = self.repair.result()
        at = 0
        for place, (letters, inserted, kept) in zip([*self.places, None], steps):
            for initial in inserted:
                yield self.conv, None, at, "I", GIVEN_ROLES[initial]
                at += 1
            if place is not None:
                edit = letters[-1]
                yield self.conv, place, at, edit, GIVEN_ROLES[kept] if edit == "R" else None
                at += 1


def _conversations(
    batches: Iterator[pa.RecordBatch], grammar, weights: Weights
) -> Iterator[tuple[bool, _Conversation | None]]:
    """Every finished conversation of a stream of ordered rows; None at the end of each batch."""
    automaton, now = Automaton(grammar), None
    for batch in batches:
        for conv, place, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                now = _Conversation(conv, Repair(automaton, weights))
            if not gone:
                now.row(place, turn, role, text, fault)
        yield None
    if now is not None:
        yield now
        yield None


FACTS = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
EDITS = "place long, at long, edit string, given string"


def _streamed(judged: DataFrame, more: str, rows_of, grammar, weights: Weights) -> DataFrame:
    schema = extended(judged.select("conv").schema, more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, ready = None, []

        def typed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = kinds or batch.schema.field(0).type
                yield batch

        for conversation in _conversations(typed(batches), grammar, weights):
            if conversation is not None:
                ready.extend(rows_of(conversation))
            if ready and (conversation is None or len(ready) >= 50_000):
                columns = [pa.array(values) for values in zip(*ready)]
                types = [kinds] + [_ARROW[kind.simpleString()] for kind in (f.dataType for f in schema.fields[1:])]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(kind) for c, kind in zip(columns, types)], schema.names
                )
                ready = []

    return judged.mapInArrow(work, schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def repair_chats(
    judged: DataFrame, grammar=ROLE_GRAMMAR, weights: Weights = Weights()
) -> DataFrame:
    """One row per conversation of ``judged_turns``: ``conv``, counts of faults, the cheapest edits.

    ``gaps`` counts missing turn numbers, ``illegal`` adjacent roles out of order; ``audit`` has one
    letter per edit (Keep, Rerole, Delete, Insert), of several cheapest the smallest;
    ``repaired_sha256`` is of the repaired turns (``role:text``, joined by line breaks). Blank and
    duplicate rows have to go. A conversation of which all rows are gone has zeros and empty texts; a
    null id is a conversation; an empty table gives an empty table. Very long conversations take time in
    proportion to their rows, and stream: no task holds their texts.
    """
    return _streamed(judged, FACTS, lambda c: [c.facts()], grammar, weights)


def repaired_turns(
    judged: DataFrame, grammar=ROLE_GRAMMAR, weights: Weights = Weights()
) -> DataFrame:
    """The repaired conversations: ``conv``, ``at`` (order within), ``edit``, ``role``, ``text``.

    Deleted rows are left out, inserted ones have an empty text. The edits are found without the texts
    and joined with them by the places of the rows.
    """
    without_text = judged.withColumn("text", F.lit(""))
    edits = _streamed(without_text, EDITS, lambda c: c.edits(), grammar, weights).where("edit != 'D'")
    rows = judged.where(~F.col("gone")).select(
        F.col("conv").alias("of"), F.col("place").alias("row"), F.col("role").alias("own"), "text"
    )
    met = edits.join(rows, F.col("conv").eqNullSafe(F.col("of")) & (F.col("place") == F.col("row")), "left")
    return met.select(
        "conv", "at", "edit", F.coalesce("given", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def damage(conv: str = "conv_id", turn: str = "turn", kinds: int = 20) -> Column:
    """crc32 of ``conv:turn`` modulo ``kinds``; a null is one blank."""
    named = [F.coalesce(column(n).cast("string"), F.lit(" ")) for n in (conv, turn)]
    return F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % kinds


def damaged_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Judged rows of a table whose rows are damaged on purpose, by ``damage``: 0 drops a row, 1 empties
    its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it the user's."""
    kind = damage(conv, turn)
    whole = turns.select(
        column(conv).alias("conv"), column(turn).alias("turn"), kind.alias("kind"),
        F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text"),
    )
    hurt = whole.select(
        "conv", "turn", "kind",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, F.lit(""))
        .when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )
    return judged_turns(
        hurt, "conv", dropped=F.col("kind") == 0, copies=F.when(F.col("kind") == 3, 2).otherwise(1)
    )
