"""Repair of conversation structure: cheapest edits by a Viterbi pass with survivor coalescence.

A conversation's rows are brought to the role initials ``(s?(ua)+)?`` by edits: Keep (0), Rerole
to user or assistant (2), Delete (3), Insert an empty-text user or assistant turn anywhere (2).
Blank and duplicate rows must be deleted; a truncated row that stays adds 1. Among equally cheap
edit sequences the one whose letters (D, I, K, R) are least as a string is taken.

Method. Four states say what was written last (nothing, system, user, assistant). Each state has
one survivor, a leaf of a tree of edits with pointers back; a node counts its children and the
survivors on it, and goes when none is left. As soon as the oldest node has a single child, all
survivors share that edit: it is emitted and forgotten. A survivor that another one undercuts by
more than any ending could win back is dropped, so the survivors' costs lie close together and
their paths meet. Two equally cheap paths are compared over their whole unresolved letters: after
the same rows, the letters up to the last row's own edit are never one a prefix of the other, so
their order is kept as a rank from row to row, and only the newest letters are looked at.

Layout. Rows are hashed by conversation once. Window functions mark duplicates inside the same
partitioning, rows are sorted by (conversation, turn, role, text) with spilling, and one pass over
the sorted rows holds the unresolved edits of one conversation. A conversation is one chain of
decisions and one task's work by definition; it is never collected.

Defined cases: null role and text are one space; an empty role can't be kept; turns sort nulls first,
equal turns by role, then text. A null conversation id is a conversation of its own. Repeated
rows are duplicates. A conversation whose rows are all absent gives one row without an edit. An
empty table gives none.
Columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]"
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# what a conversation may cost more from the row's state on than from the column's, at most
_REGRET = [[0, 0, 2, 0], [4, 0, 2, 4], [5, 2, 0, 2], [3, 0, 2, 0]]
_FULL = {_USER: "user", _ASSISTANT: "assistant"}


class _Node:
    __slots__ = ("up", "kids", "held", "edit", "role", "text", "row")

    def __init__(self, up, edit, role, text, row):
        self.up, self.kids, self.held = up, [], 0
        self.edit, self.role, self.text, self.row = edit, role, text, row


def _after(state: int, role: int) -> int | None:
    """State after a turn of ``role``, None where it can't follow."""
    if role == _SYSTEM:
        return _SYSTEM if state == _START else None
    if role == _USER:
        return _USER if state != _USER else None
    return _ASSISTANT if state == _USER else None


class Repair:
    """Decodes one conversation, row by row; ``push`` and ``end`` return the edits that all
    survivors share."""

    def __init__(self):
        self.base = _Node(None, "", None, None, None)
        self.base.held = 1
        # survivor: (cost, rank of its letters up to the last row's edit, inserts since, node)
        self.alive = {_START: (0, 0, "", self.base)}
        self._inserts()

    def push(self, role: str, text: str, fault: str | None, row) -> list[_Node]:
        own = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}.get(role[:1])
        gone, left = fault in ("blank", "duplicate"), int(fault == "truncated")
        best: dict[int, tuple] = {}
        for state, (cost, rank, inserts, node) in self.alive.items():
            steps = [("D", state, None, None)]
            if not gone:
                if own is not None:
                    steps.append(("K", _after(state, own), role, text))
                steps += [("R", _after(state, r), _FULL[r], text) for r in _FULL]
            for edit, to, said, kept in steps:
                if to is None:
                    continue
                key = (cost + _COST[edit] + (left if edit != "D" else 0), rank, inserts + edit)
                if to not in best or key < best[to][0]:
                    best[to] = (key, node, edit, said, kept)
        order = {k: i for i, k in enumerate(sorted({b[0][1:] for b in best.values()}))}
        self._replace({to: (key[0], order[key[1:]], "", self._grow(node, edit, said, kept, row))
                       for to, (key, node, edit, said, kept) in best.items()})
        self._inserts()
        for to in [s for s, x in self.alive.items()
                   if any(y[0] + _REGRET[t][s] < x[0] for t, y in self.alive.items())]:
            self._drop(self.alive.pop(to)[3])
        return self._shared()

    def end(self) -> list[_Node]:
        last = min((self.alive[s] for s in (_START, _ASSISTANT) if s in self.alive), key=lambda x: x[:3])
        last[3].held += 1
        for x in self.alive.values():
            self._drop(x[3])
        self.alive = {_START: last}
        return self._shared()

    def cost(self) -> int:
        return self.alive[_START][0]

    def _grow(self, node, edit, role, text, row) -> _Node:
        new = _Node(node, edit, role, text, row)
        node.kids.append(new)
        return new

    def _replace(self, alive) -> None:
        for x in alive.values():
            x[3].held += 1
        for x in self.alive.values():
            self._drop(x[3])
        self.alive = alive

    def _drop(self, node) -> None:
        node.held -= 1
        while node is not self.base and not node.held and not node.kids:
            up = node.up
            up.kids.remove(node)
            node = up

    def _inserts(self) -> None:
        """Paths that insert turns before the next row; two in a row are enough."""
        for _ in range(2):
            for state in sorted(self.alive):
                cost, rank, inserts, node = self.alive[state]
                for role, name in _FULL.items():
                    to = _after(state, role)
                    if to is None:
                        continue
                    key = (cost + _COST["I"], rank, inserts + "I")
                    if to not in self.alive or key < self.alive[to][:3]:
                        new = self._grow(node, "I", name, "", None)
                        new.held += 1
                        if to in self.alive:
                            self._drop(self.alive[to][3])
                        self.alive[to] = (*key, new)

    def _shared(self) -> list[_Node]:
        out = []
        while not self.base.held and len(self.base.kids) == 1:
            self.base = self.base.kids[0]
            self.base.up = None
            out.append(self.base)
        return out


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str, absent: Column) -> DataFrame:
    """Rows in order within their partitions, with their fault; absent rows first."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    slim = rows.select(F.col(conv).alias("conv"), F.coalesce(absent, F.lit(False)).alias("absent"), F.col(turn).cast("long").alias("turn"),
                       r.alias("role"), t.alias("text"))
    slim = slim.withColumns({c: F.when(~F.col("absent"), F.col(c)) for c in ("turn", "role", "text")})
    same = Window.partitionBy("conv", "absent", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    fault = (F.when(F.col("absent"), None).when(last == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    return (slim.repartition("conv").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
            .sortWithinPartitions("conv", F.desc("absent"), F.asc_nulls_first("turn"), "role", "text", "nth").drop("nth"))


def repair_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 absent: Column | None = None) -> DataFrame:
    """One row per edit, a conversation's edits together and in order: conv, edit (K, R, D, I),
    role and text as repaired (null for D), and of the edited row (null for I) its turn, first
    initial ``was`` and fault; cost of the edit. ``absent`` rows only name their conversation; one
    without other rows gives a single row whose edit is null."""
    slim = _marked(rows, conv, turn, role, text, F.lit(False) if absent is None else absent)
    kind = slim.schema["conv"].dataType
    fields = [("conv", kind), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("turn", T.LongType()),
              ("was", T.StringType()), ("fault", T.StringType()), ("cost", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def told(conv, nodes):
        for n in nodes:
            turn, was, fault = n.row or (None, None, None)
            yield conv, n.edit, n.role, n.text, turn, was, fault, _COST[n.edit] + int(fault == "truncated" and n.edit != "D")

    def edits(batches):
        conv = job = seen = None
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "absent", "turn", "role", "text", "fault")]):
                if seen is None or row[0] != conv:
                    if seen is not None:
                        yield from told(conv, job.end()) if job else [(conv, *[None] * 7)]
                    conv, job, seen = row[0], None, True
                if row[1]:
                    continue
                job = job or Repair()
                yield from told(conv, job.push(row[3], row[4], row[5], (row[2], row[3][:1], row[5])))
        if seen is not None:
            yield from told(conv, job.end()) if job else [(conv, *[None] * 7)]

    def task(batches):
        first, batches = _peek(batches)
        kinds = [first.schema.field("conv").type if first else None, *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.int32()]
        held, chars = [], 0
        for e in edits(batches):
            held.append(e)
            chars += len(e[3] or "")
            if len(held) >= 4096 or chars > 1 << 22:
                yield _batch(held, kinds, schema)
                held, chars = [], 0
        if held:
            yield _batch(held, kinds, schema)

    return slim.mapInArrow(task, schema)


def _peek(batches):
    first = next(batches, None)
    return first, itertools.chain([] if first is None else [first], batches)


def _batch(rows, kinds, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)


def conversation_digests(edits: DataFrame) -> DataFrame:
    """Folds the edits of ``repair_turns`` to one row per conversation, in the same tasks: gaps in
    the turns, faults, illegal neighbours, cost, the edits' letters and the hash of the repaired
    ``role:text`` lines, which is fed line by line."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv", edits.schema["conv"].dataType)] + [T.StructField(n, T.LongType()) for n in names]
                          + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    class Fold:
        def __init__(self):
            self.hash, self.audit, self.lines, self.n = hashlib.sha256(), [], 0, dict.fromkeys(names, 0)
            self.was = self.low = self.turn = None
            self.turns = 0

        def add(self, edit, role, text, turn, was, fault, cost):
            self.audit.append(edit)
            self.n["cost"] += cost
            if role is not None:
                self.hash.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
                self.lines += 1
            if edit == "I":
                return
            if fault:
                self.n[fault] += 1
            if self.was is not None:
                self.n["illegal"] += self.was + was not in ("su", "ua", "au")
            self.was = was
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.turn, self.turns = turn, self.turns + 1

        def row(self, conv):
            self.n["gaps"] = self.turn - self.low + 1 - self.turns if self.turns else 0
            return (conv, *self.n.values(), "".join(self.audit), self.hash.hexdigest())

    def task(batches):
        first, batches = _peek(batches)
        kinds = [first.schema.field("conv").type if first else None, *[pa.int64()] * 6, pa.string(), pa.string()]
        conv = fold = None
        out, chars = [], 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
                if fold is None or row[0] != conv:
                    if fold is not None:
                        out.append(fold.row(conv))
                        chars += len(out[-1][7])
                    conv, fold = row[0], Fold()
                if row[1] is not None:
                    fold.add(*row[1:])
            if len(out) >= 4096 or chars > 1 << 22:
                yield _batch(out, kinds, schema)
                out, chars = [], 0
        if fold is not None:
            out.append(fold.row(conv))
            yield _batch(out, kinds, schema)

    return edits.mapInArrow(task, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Stand-in input of op12: rows of (conv_id, turn, role, text) damaged by crc32 of
    ``conv_id:turn`` modulo 20, nulls as one space; dropped rows stay as ``absent``."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    act = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    out = rows.select("conv_id", "turn", (act == 0).alias("absent"), F.when(act == 4, "user").otherwise(text[2]).alias("role"),
                      F.when(act == 1, "").when(act == 2, F.regexp_replace(text[3], "[.!?]", "")).otherwise(text[3]).alias("text"),
                      F.when(act == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")
