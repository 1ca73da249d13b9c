"""Whole results from less time, shuffle and disk (findings of round 4)."""

import numpy as np
import pyarrow as pa
import pytest

from feedlens.catalog import QUERIES
from feedlens.functions.pack import pack, unpack
from feedlens.operators import index as ix
from feedlens.operators import similarity as sim
from feedlens.plans import training as tr
from feedlens.session import shared_dir
from feedlens.sources import cache as cc
from feedlens.sources import files
from feedlens.streaming import generation as gen
from tests.conftest import SF


def _met(monkeypatch, v, ids, k, exclude):
    """(what BestOf finds, what all pairs give, entries multiplied) of rows ``v`` against themselves."""
    monkeypatch.setattr(sim, "LIST", 8, raising=False)
    sent, whole = [], sim.BestOf._tile
    monkeypatch.setattr(sim.BestOf, "_tile", lambda self, rows, places, *a: sent.append(len(rows) * len(places)) or whole(self, rows, places, *a))
    t = pa.table({"l": ids, "r": ids, "_v": pa.array(v.tolist())})
    top = sim.BestOf(t, t, "l", "r", k, exclude, False, 6)
    top.meet(np.arange(len(v)), np.arange(len(v)), True)
    row, _, right, sims = top.found()
    unit = sim.unit_rows(pa.array(v.tolist()))
    s = np.round(unit @ unit.T, 6)
    if exclude:
        s[ids[:, None] == ids[None, :]] = -np.inf
    want = [(i, int(ids[j]), float(s[i, j]) + 0.0) for i in range(len(v)) for j in np.lexsort((ids, -s[i]))[:k] if np.isfinite(s[i, j])]
    return list(zip(row.tolist(), right.to_pylist(), sims.tolist(), strict=True)), want, sum(sent)


@pytest.mark.parametrize("exclude,twice", [(False, 1), (True, 1), (True, 2)])
def test_lists_that_hold_none_of_the_best_are_left_out(monkeypatch, exclude, twice):
    """clustered rows, with equal ones, zero ones and (twice = 2) repeated ids; all pairs were multiplied before."""
    rng = np.random.default_rng(7)
    n = 480
    v = rng.normal(size=(24, 12))[rng.integers(0, 24, n)] + rng.normal(0, 0.05, (n, 12))
    v[100:130], v[200:203] = v[99], 0
    got, want, met = _met(monkeypatch, v, np.arange(n) // twice, 3, exclude)
    assert got == want and met < n * n / 3


def test_rows_without_clusters_find_the_same(monkeypatch):
    rng = np.random.default_rng(8)
    for v in (rng.normal(size=(300, 16)), rng.integers(-1, 2, (300, 4)).astype(float)):
        got, want, _ = _met(monkeypatch, v, rng.permutation(300), 5, True)
        assert got == want
    v = rng.normal(size=(300, 4))
    v[5] = np.nan  # finds nothing and is not found
    got, want, _ = _met(monkeypatch, v, np.arange(300), 2, False)
    assert got == [w for w in want if w[0] != 5]


# ---- F3: preference_table ------------------------------------------------------------------------

TEXTS = ["a", "", None, "same text", "same text", "naïve – ünïcode \U0001f600", " padded\n", "long " * 5000, "z", "\x00"]


def test_packed_texts_come_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i INT, t STRING").repartition(3)
    rows = df.select("i", "t", pack("t").alias("p")).select("*", unpack("p").alias("u")).collect()
    assert [(r.i, r.u) for r in sorted(rows)] == list(enumerate(TEXTS)) and all((r.p is None) == (r.t is None) for r in rows)
    assert len(next(r.p for r in rows if r.i == 7)) < 200


def test_preference_table_of_packed_numbered_rows_is_the_same(spark):
    rows = [(i if i != 4 else None, i // 4, f"q{i // 4}", "c", "e", f"d{i % 2}", t, "gold", float(i % 3 == 0), 0.0, float(i % 2), 1.0, 0.0)
            for i, t in enumerate(TEXTS + TEXTS[3:])]
    labels = "incorrect DOUBLE, reveal DOUBLE, suggestions DOUBLE, misconceptions DOUBLE, positive DOUBLE"
    data = spark.createDataFrame(rows, "row_id LONG, qid LONG, question STRING, correct_answer STRING, explanation STRING, distractor STRING, "
                                       f"feedback STRING, method STRING, {labels}")
    src = [*tr.ITEM, "feedback"]
    want = tr.preference_table(data, data.select(*src)).collect()
    packed = ix.key_positions(data.withColumn("feedback", pack("feedback")), "row_id", index_col="at", total_col="of")
    got = tr.preference_table(packed, packed.select(*src, "at", "of"), packed=True, numbers=("at", "of")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len({r.source for r in got}) == 3


@pytest.mark.parametrize("ids", [[5, 3, 3, None, 9, 1, None, 3], [None], [], [2, 1]])
def test_key_positions(spark, ids):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(ids)], "i INT, k LONG").repartition(3)
    rows = ix.key_positions(df, "k").collect()
    assert sorted(r.idx for r in rows) == list(range(len(ids))) and {r.n for r in rows} <= {len(ids)}
    assert sorted(r.i for r in rows) == list(range(len(ids)))
    assert [r.k for r in sorted(rows, key=lambda r: r.idx)] == sorted(ids, key=lambda k: (k is None, k))


def test_preference_table_writes_its_texts_once(spark, monkeypatch):
    """All branches read one table of packed texts; two tables of plain texts were written before."""
    held, whole = [], files.write_table
    monkeypatch.setattr(files, "write_table", lambda df, *a, **b: held.append(dict(df.dtypes)) or whole(df, *a, **b))
    QUERIES["preference_table"](spark, SF)
    assert [t["feedback"] for t in held if "feedback" in t] == ["binary"]


# ---- F2: generate_random -------------------------------------------------------------------------

@pytest.fixture()
def sent(spark):
    return spark.sparkContext.accumulator(0)


@pytest.mark.parametrize("n,again", [(300, 0), (300, 40), (5, 0), (0, 0)])
def test_prompts_are_sent_once_each_and_shuffled_for_repeats_only(spark, monkeypatch, sent, n, again):
    """Whole prompts were shuffled to find repeats, and written with what all of them share, before."""
    looked, held, missing, write = [], [], cc.missing, files.write_table
    monkeypatch.setattr(cc, "missing", lambda *a: looked.append(1) or missing(*a))
    monkeypatch.setattr(files, "write_table", lambda df, *a, **b: held.append(dict(df.dtypes)) or write(df, *a, **b))

    def client(prompts, **_):
        sent.add(len(prompts))
        return [f"re {p}" for p in prompts]

    rows = [(i, f"prompt {i % (n - again)}", "kept") for i in range(n)]
    prompts = spark.createDataFrame(rows, "row_id INT, prompt STRING, more STRING").repartition(16)
    root = shared_dir(spark, "less")
    out = gen.generate(spark, prompts, client, root, model="m", max_tokens=5, batch_size=3)
    want = [(i, p, m, f"re {p}", None) for i, p, m in rows]
    assert sorted(map(tuple, out.collect())) == want and out.columns == ["row_id", "prompt", "more", "response", "error"]
    assert sent.value == n - again and len(looked) == (again > 0)
    assert held == [{"row_id": "int", "prompt": "string", "more": "string", cc.HASH: "binary"}]
    out = gen.generate(spark, prompts, client, root, model="m", max_tokens=5, batch_size=3)  # all cached now
    assert sorted(map(tuple, out.collect())) == want and sent.value == n - again
    out = gen.generate(spark, prompts, client, root, model="other", max_tokens=5)  # another key
    assert sorted(map(tuple, out.collect())) == want and sent.value == 2 * (n - again)


def test_marks_that_agree_lose_no_prompt(spark, monkeypatch, sent):
    """A count of fewer marks than prompts only means that repeats are looked for."""
    whole = getattr(gen, "_fresh")
    monkeypatch.setattr(gen, "_fresh", lambda *a: whole(*a) - 1)
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "row_id INT, prompt STRING")
    out = gen.generate(spark, prompts, gen.stub_writer, shared_dir(spark, "agree"), model="m", max_tokens=50)
    rows = out.collect()
    assert len(rows) == 20 and all(r.response == gen.stub_writer([r.prompt], model="m", max_tokens=50, system_message=None, temperature=0)[0] for r in rows)
