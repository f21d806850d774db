"""Repair of conversations by a generalised LR parse of their roles.

The role grammar is ``(s?(ua)+)?``: an optional system row, then pairs of user
and assistant rows. Each row may be kept, reroled to user or assistant, or
deleted, and rows without text may be inserted; each edit has a cost. The parse
runs all choices at once over a graph-structured stack: after each row it holds
the possible stacks, and equal stacks are merged to the one of minimum
(cost, audit), the audit being the edits' initials so far.

Audits are not copied along. The stacks of a level are kept in the order of
their audits, which two facts make enough: an audit fixes its stack, so two
stacks never have the same one, and all end in the edit of the same row, so none
is the beginning of another. Levels that differ only in total cost go on alike;
each step between such levels is worked out once and then looked up.

Long conversations are parsed in slices. Rows are range-partitioned in their
order, so one conversation may span many tasks; a slice reports, for each stack
it may begin with, the best way to each stack it may end with. Only these small
reports meet per conversation. The digest of a repaired text is a stream by
nature: rows of a conversation that spans slices are hashed in order by one
task, which holds none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.session import store_stage

GRAMMAR = (("C", ""), ("C", "B"), ("B", "ua"), ("B", "sua"), ("B", "Bua"))
START = "C"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Rows and characters of a slice; longer conversations have several.
SLICE_ROWS = 1 << 16
SLICE_CHARS = 1 << 24

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

Stack = tuple[int, ...]


class RoleParser:
    """LR(0) tables of the grammar. A stack is a tuple of states; a complete
    production is reduced at once."""

    def __init__(self, grammar=GRAMMAR, start: str = START) -> None:
        self._grammar = grammar
        self._heads = {head for head, _ in grammar}
        first = self._closure({(i, 0) for i, (head, _) in enumerate(grammar) if head == start})
        self._states, self._goto = [first], {}
        for state in self._states:  # grows while it is read
            for symbol in {x for x in map(self._next, state) if x}:
                to = self._closure({(i, at + 1) for i, at in state if self._next((i, at)) == symbol})
                if to not in self._states:
                    self._states.append(to)
                self._goto[self._states.index(state), symbol] = self._states.index(to)
        self._start = start

    def _next(self, item: tuple[int, int]) -> str:
        return self._grammar[item[0]][1][item[1]:item[1] + 1]

    def _closure(self, items: set) -> frozenset:
        found = list(items)
        for item in found:
            if self._next(item) in self._heads:
                found += [
                    new for i, (head, _) in enumerate(self._grammar)
                    if head == self._next(item) and (new := (i, 0)) not in found
                ]
        return frozenset(found)

    def shift(self, stack: Stack, symbol: str) -> Stack | None:
        """The stack after one more symbol and all reductions; None where it does not fit."""
        to = self._goto.get((stack[-1], symbol))
        if to is None:
            return None
        stack = (*stack, to)
        done = [i for i, at in self._states[to] if at == len(self._grammar[i][1])]
        if len(self._states[to]) == 1 and done and self._grammar[done[0]][0] != self._start:
            head, body = self._grammar[done[0]]
            return self.shift(stack[:-len(body)], head)
        return stack

    def accepts(self, stack: Stack) -> bool:
        """Whether the input may end here."""
        return any(
            self._grammar[i][0] == self._start and at == len(self._grammar[i][1])
            for i, at in self._states[stack[-1]]
        )

    def stacks(self, symbols: str = "sua") -> list[Stack]:
        """All stacks, the empty input's first. Here they are few, as each
        reduction leads back to the bottom."""
        found = [(0,)]
        for stack in found:
            found += [
                to for x in symbols if (to := self.shift(stack, x)) and to not in found
            ]
        return found


PARSER = RoleParser()
STACKS = PARSER.stacks()


class Step(NamedTuple):
    """From one level to the next, both in the order of audits."""

    level: tuple[tuple[int, int], ...]  # (stack, cost above the least)
    paid: int  # by which the least cost rose
    parents: tuple[int, ...]
    letters: tuple[str, ...]


_steps: dict[tuple, Step] = {}
_after = {
    (k, x): STACKS.index(to) for k, stack in enumerate(STACKS) for x in "sua"
    if (to := PARSER.shift(stack, x))
}
_final = {k for k, stack in enumerate(STACKS) if PARSER.accepts(stack)}


def _with_inserts(level: tuple[tuple[int, int], ...]) -> dict[int, tuple[int, int, str]]:
    """Best (cost, parent, letters) of each stack before the next row's edit."""
    best: dict[int, tuple[int, int, str]] = {}
    todo = [(cost, parent, "", stack) for parent, (stack, cost) in enumerate(level)]
    while todo:
        cost, parent, letters, stack = todo.pop()
        if stack in best and best[stack] <= (cost, parent, letters):
            continue
        best[stack] = (cost, parent, letters)
        todo += [
            (cost + INSERT, parent, letters + "I", to)
            for x in ROLES if (to := _after.get((stack, x))) is not None
        ]
    return best


def step(level: tuple[tuple[int, int], ...], row: str) -> Step:
    """One row's edits. ``row`` is its role's initial, in capitals where it is
    truncated, ``-`` for another role, ``+`` for such a one that is truncated,
    and ``x`` where it has to go."""
    found = _steps.get((level, row))
    if found:
        return found
    extra = TRUNCATED if row.isupper() or row == "+" else 0
    best: dict[int, tuple[int, int, str]] = {}
    for stack, (cost, parent, letters) in _with_inserts(level).items():
        ways = [(DELETE, "D", stack)]
        if row != "x":
            ways.append((extra, "K", _after.get((stack, row.lower()))))
            ways += [(REROLE + extra, "R", _after.get((stack, x))) for x in ROLES]
        for more, letter, to in ways:
            way = (cost + more, parent, letters + letter)
            if to is not None and (to not in best or way < best[to]):
                best[to] = way
    order = sorted(best, key=lambda to: best[to][1:])
    least = min(cost for cost, _, _ in best.values())
    found = _steps[level, row] = Step(
        tuple((to, best[to][0] - least) for to in order), least,
        tuple(best[to][1] for to in order), tuple(best[to][2] for to in order),
    )
    return found


def finish(level: tuple[tuple[int, int], ...]) -> tuple[int, int, str]:
    """(cost above the level's least, place in the level, letters) of the best end."""
    ways = _with_inserts(level)
    return min(way for stack, way in ways.items() if stack in _final)


def walk(entry: int, rows: str) -> tuple[int, list[Step]]:
    """The steps over ``rows`` from one stack, and the least cost after them."""
    level, paid, steps = ((entry, 0),), 0, []
    for row in rows:
        found = _steps.get((level, row)) or step(level, row)
        steps.append(found)
        level, paid = found.level, paid + found.paid
    return paid, steps


def audit_of(steps: list[Step], place: int) -> str:
    """The letters that lead to one place of the last level."""
    letters = []
    for found in reversed(steps):
        letters.append(found.letters[place])
        place = found.parents[place]
    return "".join(reversed(letters))


def repaired(audit: str, rows: Iterator[tuple[str, str]], role: str = "u") -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows. ``role`` is the one that the grammar
    asks for first."""
    want = role
    for letter in audit:
        if letter == "I":
            yield ROLES[want], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            yield (role if letter == "K" else ROLES[want]), text
            if letter == "K" and role[:1] == "s":
                continue
        want = "a" if want == "u" else "u"


# --- tables -------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the test damage, decided by
    crc32 of ``conv_id:turn``; nulls are one space. A dropped row has no copies,
    so its conversation stays known."""
    def spelt(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn"))) % 20
    text = F.when(fate.isin(0, 1), "").when(
        fate == 2, F.regexp_replace(spelt("text"), "[.!?]", "")
    ).otherwise(spelt("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(fate == 0, "").when(fate == 4, "user").otherwise(spelt("role")).alias("role"),
        text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def as_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of undamaged conversations."""
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.lit(1).cast("bigint").alias("copies"),
    )


ORDER = (F.asc_nulls_first, "conv_id"), (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "text")


def ordered_columns() -> list:
    return [direction(name) for direction, name in ORDER]


def classify(rows: DataFrame) -> DataFrame:
    """The rows with ``state``, the parser's letter for them, and ``fault``.
    Equal rows become one with a number of copies, in a map-side aggregate."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = store_stage(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumn("same", same), "conversation-rows",
    )
    # Only contents that come in several turns need their first turn.
    again = (
        rows.where("copies > 0").groupBy("conv_id", "same")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1").select(
            F.struct("conv_id", "same").alias("again"), F.col("first.turn").alias("first_turn")
        )
    )
    joined = rows.join(
        again, F.col("again.conv_id").eqNullSafe(rows["conv_id"]) & (F.col("again.same") == rows["same"]), "left"
    )
    blank = ~F.col("text").rlike(NOT_BLANK)
    repeat = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    ended = F.col("text").rlike(ENDED)
    fault = (
        F.when(blank, "blank").when(repeat, "duplicate").when(~ended, "truncated").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    state = (
        F.when(fault.isin("blank", "duplicate"), "x")
        .when(fault == "truncated", F.translate(known, "sua-", "SUA+")).otherwise(known)
    )
    return joined.select(
        "conv_id", "turn", "copies", known.alias("initial"), state.alias("state"), fault.alias("fault"),
        "role", "text",
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")
SIZE = len(STACKS)


class _Slice:
    """Counts of a run of rows, the rows themselves and their states."""

    def __init__(self, conv, first: bool) -> None:
        self.conv, self.first = conv, first
        self.counts = dict.fromkeys(COUNTS, 0)
        self.states: list[str] = []
        self.lines: list[tuple[str, str]] = []
        self.chars = 0
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.opened, self.closed = "", ""

    def add(self, turn, copies, initial, state, fault, role, text) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.closed and self.closed + initial not in LEGAL:
            self.counts["illegal"] += 1
        if initial + initial not in LEGAL:
            self.counts["illegal"] += copies - 1
        if fault:
            self.counts[fault] += 1
        # A copy of a blank row is blank, of any other row a duplicate.
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        self.opened, self.closed = self.opened or initial, initial
        self.states += [state, *"x" * (copies - 1)]
        self.lines += [(role, text)] * copies
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.states) >= rows or self.chars >= SLICE_CHARS

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0

    def report(self) -> dict:
        """What other slices need: by entry and exit stack the cost, the order of
        audits and the audits."""
        costs, order, audits = ([None] * SIZE**2 for _ in range(3))
        for entry in [0] if self.first else range(SIZE):
            paid, steps = walk(entry, self.states)
            for place, (stack, cost) in enumerate(steps[-1].level if steps else ((entry, 0),)):
                at = entry * SIZE + stack
                costs[at], order[at], audits[at] = paid + cost, place, audit_of(steps, place)
        return {
            **self.counts, "turns": self.turns, "first_turn": self.first_turn,
            "last_turn": self.last_turn, "opened": self.opened, "closed": self.closed,
            "costs": costs, "places": order, "audits": audits,
        }

    def result(self) -> dict:
        """The repair of a conversation that lies wholly in this slice."""
        paid, steps = walk(0, self.states)
        cost, place, letters = finish(steps[-1].level if steps else ((0, 0),))
        audit = audit_of(steps, place) + letters
        return {**self.counts, "gaps": self.gaps(), "cost": paid + cost, "audit": audit}


RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)
REPORT = (
    "slice bigint, turns bigint, first_turn bigint, last_turn bigint, opened string, closed string, "
    "costs array<bigint>, places array<int>, audits array<string>"
)


def digest_of(lines: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of ``role:text`` lines joined by newlines."""
    digest, between = hashlib.sha256(), b""
    for role, text in lines:
        digest.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return digest.hexdigest()


def _typed(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row.get(field.name) for row in rows], field.type) for field in schema],
        schema=schema,
    )


def _arrow_schema(key: pa.DataType, ddl: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    fields = [part.split(" ") for part in ddl.split(", ")]
    return pa.schema([("conv_id", key), *((name, kinds[kind]) for name, kind in fields)])


def _sliced(sorted_rows: DataFrame, key: str, slice_rows: int) -> DataFrame:
    """One row for each slice: the result where the conversation lies in it
    (``slice`` null), else its report."""
    ddl = f"{RESULT}, repaired_sha256 string, {REPORT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        part, schema, out = None, None, []
        # The partition's first conversation may have begun in another one.
        begun_here = False
        for batch in batches:
            schema = schema or _arrow_schema(batch.schema.field(0).type, ddl)
            names = ("conv_id", "turn", "copies", "initial", "state", "fault", "role", "text")
            for conv, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if part is None:
                    part = _Slice(conv, False)
                elif conv != part.conv or part.full(slice_rows):
                    same = conv == part.conv
                    if same or not begun_here:
                        out.append({"conv_id": part.conv, "slice": (task << 32) + number, **part.report()})
                        number += 1
                    else:
                        out.append({
                            "conv_id": part.conv, **(found := part.result()),
                            "repaired_sha256": digest_of(repaired(found["audit"], iter(part.lines))),
                        })
                    begun_here = not same
                    part = _Slice(conv, begun_here)
                part.add(*row)
            if len(out) >= 1000 or (out and part.chars > SLICE_CHARS >> 3):
                yield _typed(out, schema)
                out = []
        if part:
            out.append({"conv_id": part.conv, "slice": (task << 32) + number, **part.report()})
            yield _typed(out, schema)

    return sorted_rows.mapInArrow(run, f"conv_id {key}, {ddl}")


def fold(reports: list[dict]) -> tuple[dict, list[tuple[int, int]]]:
    """The result of a conversation from its slices' reports in order, its audit
    aside, and the (entry, exit) stacks of each slice. ``tail`` has the letters
    after the last row."""
    total = dict.fromkeys(COUNTS, 0)
    turns, first_turn, last_turn, closed = 0, None, None, ""
    level, paid, backs = [(0, 0)], 0, []
    for x in reports:
        for name in COUNTS:
            total[name] += x[name]
        if closed and x["opened"]:
            total["illegal"] += closed + x["opened"] not in LEGAL
        closed = x["closed"] or closed
        if x["turns"]:
            turns += x["turns"] - (x["first_turn"] == last_turn)
            first_turn = x["first_turn"] if first_turn is None else first_turn
            last_turn = x["last_turn"]
        best: dict[int, tuple[int, int, int]] = {}
        for rank, (entry, cost) in enumerate(level):
            for to in range(SIZE):
                more = x["costs"][entry * SIZE + to]
                if more is not None:
                    way = (cost + more, rank, x["places"][entry * SIZE + to])
                    if to not in best or way < best[to]:
                        best[to] = way
        order = sorted(best, key=lambda to: best[to][1:])
        backs.append([(level[best[to][1]][0], best[to][1], to) for to in order])
        least = min(way[0] for way in best.values())
        level, paid = [(to, best[to][0] - least) for to in order], paid + least
    cost, place, letters = finish(tuple(level))
    path = []
    for back in reversed(backs):
        entry, before, to = back[place]
        path.append((entry, to))
        place = before
    gaps = last_turn - first_turn + 1 - turns if turns else 0
    return {**total, "gaps": gaps, "cost": paid + cost, "tail": letters}, path[::-1]


def _folded(reports: DataFrame, key: str) -> DataFrame:
    """(conv_id, slice, counts, way, tail): the way of the best repair through
    each slice, as a place in ``audits``."""
    counts = ["gaps", *COUNTS, "cost"]
    names = ["turns", "first_turn", "last_turn", "opened", "closed", "costs", "places", *COUNTS]

    def run(group: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("slice")
        # Integers with nulls come as floats; as objects they stay exact.
        rows = [
            {n: None if v is None or v is pd.NA else v for n, v in zip(names, row, strict=True)}
            for row in found[names].itertuples(index=False)
        ]
        for row in rows:
            for n in ("first_turn", "last_turn"):
                row[n] = None if row[n] is None else int(row[n])
            for n in ("costs", "places"):
                row[n] = [None if v is None or v != v else int(v) for v in row[n]]
        total, path = fold(rows)
        return pd.DataFrame({
            "conv_id": [group[0]] * len(path), "slice": found["slice"].to_numpy(),
            **{n: [int(total[n])] * len(path) for n in counts},
            "way": [entry * SIZE + to for entry, to in path], "tail": [total["tail"]] * len(path),
        })

    texts = reports.select(
        "conv_id", "slice", *(F.col(n) for n in names if n not in ("first_turn", "last_turn")),
        # Nulls of whole numbers would pass as floats.
        *(F.col(n).cast("string").alias(n) for n in ("first_turn", "last_turn")),
    )
    return texts.groupBy("conv_id").applyInPandas(
        run, f"conv_id {key}, slice bigint, {', '.join(f'{n} bigint' for n in counts)}, way int, tail string"
    )


def _streamed(rows: DataFrame, pieces: DataFrame, key: str, emit: Callable, ddl: str) -> DataFrame:
    """``emit`` over the repaired lines of each conversation in ``pieces``
    (conv_id, slice, audit), one after the other in one stream."""
    kind = F.lit(1).alias("kind")
    wanted = pieces.select(F.struct("conv_id").alias("asked")).distinct()
    lines = rows.where("copies > 0").join(
        wanted, F.col("asked.conv_id").eqNullSafe(rows["conv_id"]), "left_semi"
    ).select("conv_id", kind, F.lit(None).cast("bigint").alias("slice"), "turn", "role", "text", "copies")
    letters = pieces.select(
        "conv_id", F.lit(0).alias("kind"), "slice", F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"),
    )
    stream = letters.unionByName(lines).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "kind", "slice", F.asc_nulls_first("turn"), "role", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def read() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = schema or _arrow_schema(batch.schema.field(0).type, ddl)
                yield from zip(*(batch.column(n).to_pylist() for n in (
                    "conv_id", "kind", "role", "text", "copies")), strict=True)

        source = read()
        row = next(source, None)
        while row is not None:
            conv, audit = row[0], []
            while row is not None and row[0] == conv and row[1] == 0:
                audit.append(row[3])
                row = next(source, None)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == conv and row[1] == 1:  # noqa: B023
                    for _ in range(row[4]):
                        yield row[2], row[3]
                    row = next(source, None)

            mine = own()
            for found in emit(conv, repaired("".join(audit), mine)):
                yield _typed([found], schema)
            for _ in mine:  # rows after the last edit: none
                pass

    return stream.mapInArrow(run, f"conv_id {key}, {ddl}")


def _parsed(rows: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Rows, finished conversations, and pieces of those that span slices."""
    key = rows.schema["conv_id"].dataType.simpleString()
    rows = classify(rows)
    slices = store_stage(
        _sliced(
            rows.repartitionByRange(*ordered_columns()).sortWithinPartitions(*ordered_columns()), key, slice_rows
        ),
        "conversation-slices",
    )
    whole = slices.where("slice IS NULL")
    reports = slices.where("slice IS NOT NULL")
    ways = _folded(reports, key).withColumnRenamed("slice", "at").drop("conv_id")
    audits = reports.select("conv_id", "slice", "audits").join(
        ways.withColumnRenamed("at", "slice"), "slice"
    )
    pieces = store_stage(
        audits.select(
            "conv_id", "slice", "gaps", *COUNTS, "cost", "tail", F.expr("audits[way]").alias("audit")
        ), "conversation-pieces",
    )
    last = F.max("slice").over(Window.partitionBy("conv_id"))
    pieces = pieces.withColumn(
        "audit", F.concat("audit", F.when(F.col("slice") == last, F.col("tail")).otherwise(""))
    )
    return rows, whole, pieces, key


def repair(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) for every conversation of ``rows`` (conv_id, turn, role,
    text, copies; see ``damage`` and ``as_rows``).

    Rows of a conversation stand by turn, null first; rows of one turn by role
    and text, equal ones next to each other. A null conv_id is a conversation of
    its own. A role that does not begin with s, u or a, the empty one included,
    cannot be kept. A conversation without copies has zeros, an empty audit and
    the digest of the empty text. Texts are of any length; other columns are not
    looked at; an empty table gives no rows.
    """
    rows, whole, pieces, key = _parsed(rows, slice_rows)
    columns = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    joined = pieces.groupBy("conv_id").agg(
        *(F.first(n).alias(n) for n in ("gaps", *COUNTS, "cost")),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("slice", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
    )

    def emit(conv, lines):
        yield {"conv_id": conv, "repaired_sha256": digest_of(lines)}

    digests = _streamed(rows, pieces, key, emit, "repaired_sha256 string").select(
        F.struct("conv_id").alias("hashed"), "repaired_sha256"
    )
    spanning = joined.join(digests, F.col("hashed.conv_id").eqNullSafe(joined["conv_id"]))
    return whole.select(columns).unionByName(spanning.select(columns))


def repaired_rows(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, position, role, text): the rows of all repaired conversations,
    numbered from 0. A conversation of which nothing is left has none. Nulls,
    ties and other cases as in ``repair``."""
    rows, whole, pieces, key = _parsed(rows, slice_rows)

    def emit(conv, lines):
        for at, (role, text) in enumerate(lines):
            yield {"conv_id": conv, "position": at, "role": role, "text": text}

    audits = whole.select("conv_id", F.lit(0).cast("bigint").alias("slice"), "audit").unionByName(
        pieces.select("conv_id", "slice", "audit")
    )
    return _streamed(rows, audits, key, emit, "position bigint, role string, text string")
