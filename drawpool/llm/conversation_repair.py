"""Cheapest repair of the turn structure of conversations.

The roles of a repaired conversation read ``(s?(ua)+)?`` by initials.  Rows
are kept (0), given the other role (3), deleted (4; blank and repeated rows
must be) or rows without text are inserted (3); a truncated row that stays
adds 3.  Among the cheapest edits those with the least audit string win.

One whole number decides both: its high digits are the cost, its low ones
``width`` octal digits, a digit for each letter of the audit from the left,
zeros after the last.  A shorter string that begins a longer one is less, as
in ASCII.  Reading rows from the last to the first, the least number of each
state (nothing yet, s, u, a) is found by a plain minimum over the edges of a
graph without cycles; putting a letter in front shifts the low digits by one.

A conversation of up to ``LONG`` rows is solved in one task.  Longer ones are
cut into runs of bounded size in the order of a range partitioning; each run
gives its least number from every state to every state, and these are joined
in order, so no task holds the rows of a long conversation.  Its hash is made
of its rows as they pass.  Equal rows are counted before any shuffle.

Defined cases: a null role or text is one space, a null ``conv_id`` or
``turn`` one space in the checksum that decides the damage; rows without a
``conv_id`` are one conversation; rows of one turn (or without a turn, which
come first) are taken by role, then text; an empty text is blank; a role of
another initial can't be kept; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, written

#: Rows of a conversation that are solved together, and rows of a range partition.
LONG, PART = 2048, 1 << 16
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # digits in the order of their letters
LETTERS = {DELETE: "D", INSERT: "I", KEEP: "K", REROLE: "R"}
NOTHING, S, U, A = range(4)
_NEXT = {"s": {NOTHING: S}, "u": {NOTHING: U, S: U, A: U}, "a": {U: A}}


# ---------------------------------------------------------------- least numbers
def _insert(f: list[int | None], width: int) -> None:
    """Rows without text before what ``f`` stands for: at most two in a row help."""
    for _ in range(2):
        best = list(f)
        for role in "ua":
            for state, to in _NEXT[role].items():
                best[state] = _least(best[state], _put(INSERT, 3, f[to], width))
        f[:] = best


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _put(letter: int, cost: int, rest: int | None, width: int) -> int | None:
    """The number of ``letter`` before ``rest``."""
    if rest is None:
        return None
    low = rest & ((1 << 3 * width) - 1)
    return ((rest >> 3 * width) + cost << 3 * width) + (letter << 3 * (width - 1)) + (low >> 3)


def _row(code: str, f: list[int | None], width: int) -> list[int | None]:
    """``f`` with a row before it.  ``code``: d for a row that must go, else
    its initial, in capitals when it is truncated, or ? for another one."""
    if code == "d":
        return [_put(DELETE, 4, x, width) for x in f]
    more = 3 * (code in "SUA!")
    out = [_put(DELETE, 4, x, width) for x in f]
    for role in "sua":
        for state, to in _NEXT[role].items():
            if code.lower() == role:
                out[state] = _least(out[state], _put(KEEP, more, f[to], width))
            if role != "s":
                out[state] = _least(out[state], _put(REROLE, 3 + more, f[to], width))
    return out


def _reach(codes: str, end: list[int | None], width: int, inserts: bool) -> list[int | None]:
    """Least number of each state before the rows ``codes``, given those after them."""
    f = list(end)
    if inserts:
        _insert(f, width)
    for code in reversed(codes):
        f = _row(code, f, width)
        _insert(f, width)
    return f


def _read(number: int, width: int) -> tuple[int, str]:
    """(cost, audit letters) of a number."""
    digits = oct((number & ((1 << 3 * width) - 1)) | 1 << 3 * width)[3:].rstrip("0")
    return number >> 3 * width, "".join(LETTERS[int(x)] for x in digits)


@lru_cache(1 << 14)
def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    width = 3 * len(codes) + 2  # two inserts before each row and after the last
    return _read(_reach(codes, [0, None, None, 0], width, True)[NOTHING], width)


def run_matrix(codes: str) -> list[tuple[int, str] | None]:
    """(cost, audit) of a run from each state to each state, by 4 * from + to.
    Inserts stand before rows; those after the last row belong to the next run."""
    width = 3 * len(codes) + 2
    cells: list = [None] * 16
    for to in range(4):
        end: list[int | None] = [None] * 4
        end[to] = 0
        for state, number in enumerate(_reach(codes, end, width, False)):
            cells[4 * state + to] = None if number is None else _read(number, width)
    return cells


class Chain:
    """The numbers of a long conversation from its runs, in order: letters go
    on at the end, and the width grows with them."""

    def __init__(self):
        self.best: list[tuple[int, int, int] | None] = [(0, 0, 0), None, None, None]  # cost, digits, letters

    @staticmethod
    def _less(x, y) -> bool:
        """Whether x has the lesser number: costs, then digits of one width."""
        if x[0] != y[0]:
            return x[0] < y[0]
        width = max(x[2], y[2])
        return x[1] << 3 * (width - x[2]) < y[1] << 3 * (width - y[2])

    def add(self, cells: list[tuple[int, str] | None]) -> None:
        out: list = [None] * 4
        digit = {v: str(k) for k, v in LETTERS.items()}
        for i, cell in enumerate(cells):
            before = self.best[i // 4]
            if cell is None or before is None:
                continue
            cost, audit = cell
            value = int("".join(map(digit.get, audit)), 8) if audit else 0
            new = (before[0] + cost, (before[1] << 3 * len(audit)) + value, before[2] + len(audit))
            if out[i % 4] is None or self._less(new, out[i % 4]):
                out[i % 4] = new
        self.best = out

    def end(self) -> tuple[int, str]:
        tail: list = [None] * 16
        for state, cell in enumerate([(0, ""), (6, "II"), (3, "I"), (0, "")]):
            tail[4 * state + A] = cell
        self.add(tail)
        cost, value, n = self.best[A]
        return cost, "".join(LETTERS[int(x)] for x in (oct(value)[2:] if n else ""))


class Writer:
    """Hash of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, NOTHING, hashlib.sha256(), True

    def _emit(self, role: str, initial: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first, self.state = False, _NEXT[initial][self.state]

    def _other(self) -> tuple[str, str]:
        return ("assistant", "a") if self.state == U else ("user", "u")

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(*self._other(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._emit(role, role[0], text)
        elif letter == "R":
            self._emit(*self._other(), text)

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


# ------------------------------------------------------------------- Spark side
_BLANK, _LAST = r"[\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the damaged rows, equal ones
    counted together; a dropped row has no copies and no role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
                       space("role").alias("role"), space("text").alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("kind") == 0
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, None).when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(~gone, text).alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """``damaged`` rows with ``code`` (d: blank or seen earlier; else the
    initial, in capitals when truncated, or ? and !) and ``blank``."""
    rows = rows.withColumn("blank", F.regexp_replace("text", _BLANK, "") == "")
    rows = rows.withColumn("key", F.when(~F.col("blank"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)))
    rows = written(rows, "turns")
    first = rows.where("key IS NOT NULL").groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    new = F.col("first.turn").eqNullSafe(F.col("turn"))
    cut = ~F.col("text").rlike(_LAST)
    initial = F.substring("role", 1, 1)
    whole = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    code = F.when(F.col("role").isNull(), None).when(F.col("blank") | ~new, "d").when(cut, F.translate(F.upper(whole), "?", "!")).otherwise(whole)
    return rows.select("conv_id", "turn", "role", "text", initial.alias("initial"), "copies", code.alias("code"), "blank")


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_SCHEMA = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_LEGAL = {"su", "ua", "au"}


class Tally:
    """Counts over the rows of a conversation as they pass."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.turn = self.last = None

    def row(self, turn, initial: str, copies: int, code: str, blank: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        if blank:
            self.blank += copies
        elif code == "d":
            self.duplicate += copies
        else:
            self.duplicate += copies - 1
            self.truncated += code in "SUA!"
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        self.illegal += copies - 1
        self.last = initial

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def _rows(batches, columns: list[str]):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


_TURN = ["conv_id", "turn", "role", "text", "initial", "copies", "code", "blank"]


def _short(batches):
    """Results of whole conversations, whose rows come in order."""
    out: list = []

    def close(conv, rows):
        tally = Tally()
        for turn, _, _, initial, copies, code, blank in rows:
            tally.row(turn, initial, copies, code, blank)
        cost, audit = solve("".join(r[5] + "d" * (r[4] - 1) for r in rows))
        writer = Writer(audit)
        for _, role, text, _, copies, code, _ in rows:
            writer.row(role, text)
            for _ in range(copies - 1):
                writer.row(role, text)
        out.append((conv, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, writer.end()))

    conv, held, some = None, [], False
    for c, *row in _rows(batches, _TURN):
        if some and c != conv:
            close(conv, held)
            held = []
        conv, some = c, True
        if row[4]:
            held.append(row)
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)
            out.clear()
    if some:
        close(conv, held)
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], _SCHEMA)


_RUN = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("pos", pa.int32()), *((n, pa.string()) for n in ("role", "text", "initial", "code")),
                  ("turn", pa.int64()), ("copies", pa.int64()), ("blank", pa.bool_())])
_RUN_DDL = "conv_id bigint, run bigint, pos int, role string, text string, initial string, code string, turn bigint, copies bigint, blank boolean"


def _cut(size: int):
    """Rows of long conversations with the number of their run and their place
    in it; copies are dealt to runs of their own where they are many."""
    def run(batches):
        from pyspark import TaskContext

        base, conv, n, pos, rows = TaskContext.get().partitionId() << 40, None, 0, size, 0
        for b in batches:
            out = []
            for c, turn, role, text, initial, copies, code, blank in _rows([b], _TURN):
                first = True
                while copies:
                    if pos >= size or rows >= size or c != conv or n == 0:
                        conv, n, pos, rows = c, n + 1, 0, 0
                    part = min(copies, size - rows)
                    out.append((c, base + n, pos, role, text if first else None, initial, code if first else "d", turn, part, blank))
                    copies, first, pos, rows = copies - part, False, pos + 1, rows + part
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_RUN.names, r)) for r in out], _RUN)
    return run


_CELLS = "conv_id bigint, run bigint, cells array<struct<cost: bigint, audit: string>>"


def _matrices(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))])
    for b in batches:
        rows = []
        for conv, run, steps in _rows([b], ["conv_id", "run", "steps"]):
            cells = run_matrix("".join(s["code"] + "d" * (s["copies"] - 1) for s in steps))
            rows.append({"conv_id": conv, "run": run, "cells": [c and {"cost": c[0], "audit": c[1]} for c in cells]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _chained(batches):
    """Of each long conversation: first its runs' cells, then its rows, each in order."""
    conv, some, state = None, False, None

    def close():
        chain, tally, writer = state
        cost, audit = chain
        return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (conv, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, writer.end())))], _SCHEMA)

    for c, cells, role, text, initial, code, turn, copies, blank in _rows(batches, ["conv_id", "cells", "role", "text", "initial", "code", "turn", "copies", "blank"]):
        if some and c != conv:
            yield close()
        if not some or c != conv:
            conv, some, state = c, True, [Chain(), Tally(), None]
        if cells is not None:
            state[0].add([x and (x["cost"], x["audit"]) for x in cells])
            continue
        if state[2] is None:
            state[0] = state[0].end()
            state[2] = Writer(state[0][1])
        state[1].row(turn, initial, copies, code, blank)
        for _ in range(copies):
            state[2].row(role, text)
    if some:
        yield close()


def _of(rows: DataFrame, convs: DataFrame, how: str) -> DataFrame:
    return rows.join(convs, F.col("conv_id").eqNullSafe(F.col("long_id")), how)


def repair(conversations: DataFrame, long: int = LONG, part: int = PART) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every conversation of ``conversations`` (conv_id, turn,
    role, text) after the damage."""
    importable(conversations.sparkSession)
    rows = written(faults(damaged(conversations)), "faults")
    order = ("conv_id", "turn", "role", "text")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > long)
    large = written(sizes.select(F.col("conv_id").alias("long_id"), "n"), "long")
    n = large.agg(F.sum("n")).first()[0]
    short = _of(rows, large, "left_anti") if n else rows
    done = short.repartition("conv_id").sortWithinPartitions(*order).select(*_TURN).mapInArrow(_short, _RESULT)
    if not n:
        return done
    in_order = _of(rows.where("copies > 0"), large, "left_semi").repartitionByRange(-(-n // part), *order).sortWithinPartitions(*order)
    runs = written(in_order.select(*_TURN).mapInArrow(_cut(long), _RUN_DDL), "runs")
    steps = runs.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "copies"))).alias("steps"))  # at most ``long`` of them
    cells = steps.mapInArrow(_matrices, _CELLS).withColumn("pos", F.lit(-1))
    both = cells.withColumn("kind", F.lit(0)).unionByName(runs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "run", "pos")
    return done.unionByName(both.mapInArrow(_chained, _RESULT))

