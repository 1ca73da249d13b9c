"""Turn repair against all edit sequences of short conversations, and its SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlens.llm.queries import op12_turn_repair
from feedlens.llm.turn_repair import Repair, _Node, conversation_digests, repair_turns
from tests.conftest import SF

GOAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, letters, lines) by a best-first search over (rows done, what was written)."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, wrote, lines = heapq.heappop(todo)
        if i == len(rows) and GOAL.match(wrote):
            return cost, audit, lines
        # what may follow depends on the rows done, the last initial and whether anything stands
        key = (i, wrote[-1:], audit, len(wrote) > 1)
        if key in done or cost > 3 * len(rows) or len(audit) > 2 * len(rows) + 2:
            continue
        done.add(key)

        def go(price, letter, i, role=None, text=""):
            new = wrote if role is None else wrote + role[:1]
            if role is None or re.match(r"s?(ua)*u?\Z", new):
                heapq.heappush(todo, (cost + price, audit + letter, i, new, lines if role is None else (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(2, "I", i, role)
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", i + 1)
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role:
                    go(more, "K", i + 1, role, text)
                for r in ("user", "assistant"):
                    go(2 + more, "R", i + 1, r, text)


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def test_cheapest_edits_of_short_conversations():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "up", ""]), rng.choice(["a.", "b!", "c", " ", "d.", "e?"]))
                for _ in range(rng.randint(1, 6))]
        job, nodes = Repair(), []
        for (role, text), fault in zip(rows, faults(rows)):
            nodes += job.push(role, text, fault, None)
        nodes += job.end()
        cost, audit, lines = cheapest([(*r, f) for r, f in zip(rows, faults(rows))])
        assert (job.cost(), "".join(n.edit for n in nodes)) == (cost, audit), rows
        assert tuple(f"{n.role}:{n.text}" for n in nodes if n.role is not None) == lines


def test_unresolved_edits_stay_few():
    """A conversation of 20,000 rows holds a few nodes at a time."""
    rng, job, most, out = random.Random(3), Repair(), 0, 0
    for i in range(20_000):
        fault = rng.choice([None, None, None, "truncated", "blank", "duplicate"])
        out += len(job.push(rng.choice(["user", "assistant"]) if i % 3 else "user", f"t{i}", fault, None))
        todo, n = [job.base], 0
        while todo:
            todo += todo.pop().kids
            n += 1
        most = max(most, n)
    assert out > 19_000 and most < 200


def test_a_bad_start_goes():
    """Only deletions, then long alternation: the state in which nothing was written dies out."""
    job = Repair()
    for i in range(50):
        job.push(("user", "assistant")[i % 2], f"{i}.", None, None)
    assert 0 not in job.alive and isinstance(job.base, _Node)


ROWS = [(1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (None, 5, "user", "x."), (2, 0, None, None), (3, None, "user", "q?"),
        (3, None, "user", "q?"), (3, 7, "assistant", "done"), (4, 1, "system", "s."), (5, 0, "user", ""), (5, 3, "assistant", "\n")]


def test_defined_cases(spark):
    rows = spark.createDataFrame([(*r, 9) for r in ROWS] + [(6, 0, "user", "away.", 9)], "conv_id long, turn int, role string, text string, fault int")
    edits = repair_turns(rows, absent=F.col("conv_id") == 6)
    got = {r["conv"]: r for r in conversation_digests(edits).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == ("KK", 0, sha("user:hi.\nassistant:yes."))
    assert (got[None]["audit"], got[None]["cost"]) == ("KI", 2) and got[None]["repaired_sha256"] == sha("user:x.\nassistant:")
    assert (got[2]["audit"], got[2]["blank"], got[2]["repaired_sha256"]) == ("D", 1, sha(""))
    assert (got[3]["audit"], got[3]["duplicate"], got[3]["truncated"], got[3]["cost"], got[3]["gaps"]) == ("KDK", 1, 1, 4, 0)
    assert got[3]["illegal"] == 1
    assert (got[4]["audit"], got[4]["cost"]) == ("D", 3)
    assert (got[5]["audit"], got[5]["gaps"], got[5]["blank"]) == ("DD", 2, 2)
    assert (got[6]["audit"], got[6]["cost"], got[6]["repaired_sha256"]) == ("", 0, sha(""))
    assert conversation_digests(repair_turns(rows.filter("false"))).collect() == []
    text = spark.createDataFrame([("x", 1, "user", "a."), ("x", 2, "assistant", "b.")], "conv_id string, turn long, role string, text string")
    assert [r["edit"] for r in repair_turns(text).collect()] == ["K", "K"]


def test_long_texts_and_many_rows(spark):
    rows = spark.range(6000).selectExpr("id % 3 AS conv_id", "id AS turn", "if(id div 3 % 2 = 0, 'user', 'assistant') AS role",
                                        "concat(repeat('word ', 300), id, '.') AS text")
    got = conversation_digests(repair_turns(rows.repartition(7))).collect()
    assert {(r["conv"], r["cost"], r["audit"]) for r in got} == {(c, 0, "K" * 2000) for c in range(3)}
    assert {r["gaps"] for r in got} == {5998 - 2000}


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_query_equals_sql(spark, sf):
    import duckdb

    from feedlens.llm.queries import OP12_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(OP12_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in op12_turn_repair(spark, sf).select(names).collect())
