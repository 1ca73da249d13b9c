"""Work that stays bounded when tables grow: blocks, batches, products, shuffles (findings of round 3)."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.functions.bertscore import hashed_words, match_means
from feedlens.functions.plugins import Tokenizer, token_ids
from feedlens.operators import pairs as prs
from feedlens.operators import similarity as sim
from feedlens.operators import vector_index as vi
from feedlens.session import shared_dir
from feedlens.sources import cache as cc
from feedlens.streaming import generation as gen


def test_few_wide_blocks(spark):
    counts = spark.range(1).select(*[sim.block_count(F.lit(n), 4096).alias(f"n{n}") for n in (5000, 100_000, 615_000)]).first()
    assert list(counts) == [2, 8, 10]  # one block per 4,096 rows would be 151


@pytest.mark.parametrize("exclude,zero", [(False, False), (True, False), (False, True)])
def test_tiles_keep_the_best_of_all(monkeypatch, exclude, zero):
    """Products in tiles of 7 give the rows of one product: ties, repeated ids, fewer rows than k."""
    monkeypatch.setattr(sim, "TILE", 7)
    rng = np.random.default_rng(3)
    for n, ids in ((40, np.arange(40)), (40, np.arange(40) // 2), (2, np.arange(2))):
        v = rng.integers(-1, 2, (n, 3)).astype(float)
        t = lambda order: pa.table({"l": ids[order], "r": ids[order], "_v": pa.array(v[order].tolist())})  # noqa: E731, B023
        top = sim.BestOf(t(np.arange(n)), t(rng.permutation(n)), "l", "r", 3, exclude, zero, 6)
        top.meet(np.arange(n), np.arange(n), True)
        row, _, right, sims = top.found()
        unit = sim.unit_rows(pa.array(v.tolist()))
        s = np.round(unit @ unit.T, 6)
        same = ids[:, None] == ids[None, :]
        s[same] = np.where(exclude, -np.inf, 0.0 if zero else s[same])
        want = [(i, int(ids[j]), float(s[i, j]) + 0.0) for i in range(n) for j in np.lexsort((ids, -s[i]))[:3] if np.isfinite(s[i, j])]
        assert list(zip(row.tolist(), right.to_pylist(), sims.tolist(), strict=True)) == want


def test_a_query_is_sent_once_per_band_of_lists(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "id LONG, vec ARRAY<DOUBLE>")
    index = vi.VectorIndex.build(pool, "id", lists=16, files=2)
    sent = []
    whole = vi.score_blocks
    monkeypatch.setattr(vi, "score_blocks", lambda left, *a, **b: sent.append(left.count()) or whole(left, *a, **b))
    found = index.search(pool.withColumnRenamed("id", "q"), "q", k=2, probes=12).count()
    assert sent == [300] and found == 600  # by list it would be 3,600


def test_pruned_search_sends_bands(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vecs = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 16)))]  # nothing can be left out
    t, p = (spark.createDataFrame(vecs, f"{c} LONG, vec ARRAY<DOUBLE>") for c in ("target_id", "pool_id"))
    sent = []
    whole = sim.score_blocks
    monkeypatch.setattr(sim, "score_blocks", lambda left, *a, **b: sent.append(left.count()) or whole(left, *a, **b))
    search = sim.PrunedSearch(t, p, left_id="target_id", right_id="pool_id", k=2, pivots=32, rings=2, block_rows=10)
    got = search.run().select("target_id", "pool_id", "sim", "rank").collect()
    assert sum(sent) < 800 * 20 < 800 * search.scored ** 0.5  # a row went to each ring of the other side
    want = sim.block_topk(t, p, left_id="target_id", right_id="pool_id", k=2).select("target_id", "pool_id", "sim", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_client_batches_are_slices():
    n = 2000
    rows = pa.record_batch({cc.HASH: [str(i) for i in range(n)], "model": ["m"] * n, "max_tokens": pa.array([9] * n, pa.int32()),
                            "system_message": pa.array([None] * n, pa.string()), "prompt": [f"p{i}" for i in range(n)]})
    told = []
    run = gen._call_batches(lambda ps, **kw: told.append(len(ps)) or [p.upper() for p in ps], 10, 0, 0.0, False)
    out = list(run(iter([rows])))
    assert max(b.num_rows for b in out) <= gen.SLICE and set(told) == {10}
    assert pa.Table.from_batches(out).column("response").to_pylist() == [f"P{i}" for i in range(n)]


def test_answers_are_written_once_and_failed_ones_are_no_entries(spark):
    def client(ps, **kw):
        if any(p == "bad" for p in ps):
            raise gen.TransientError("later")
        return [p.upper() for p in ps]

    root = shared_dir(spark, "once")
    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a"), (4, "b")], "row_id INT, prompt STRING")
    k = dict(model="m", max_tokens=5)
    out = gen.generate(spark, prompts, client, root, batch_size=1, max_retries=0, **k)
    assert sorted((r.row_id, r.response, r.error) for r in out.collect()) == [(1, "A", None), (2, None, "later"), (3, "A", None), (4, "B", None)]
    assert spark.read.parquet(f"{root}/{cc.deltas(spark, root)[0]}").count() == 3  # the answers' only table
    assert sorted(r.prompt for r in cc.load_cache(spark, root).collect()) == ["a", "b"]
    slim = cc.load_responses(spark, root)
    assert slim.columns == [cc.HASH, "response"] and "prompt" not in slim._jdf.queryExecution().executedPlan().toString()
    again = gen.generate(spark, prompts, lambda ps, **kw: [p + "!" for p in ps], root, **k)
    assert sorted((r.row_id, r.response) for r in again.collect()) == [(1, "A"), (2, "bad!"), (3, "A"), (4, "B")]


def test_token_ids_hold_one_batch_of_lists(spark):
    def load():
        class Ids(list):
            live = 0

            def __init__(self, *a):
                super().__init__(*a)
                Ids.live += 1
                assert Ids.live <= 100, "ids of a whole Arrow batch are Python lists"

            def __del__(self):
                Ids.live -= 1

        return lambda texts: [Ids(map(len, t.split())) for t in texts]

    texts = spark.range(0, 2000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("ab "), F.col("id").cast("string"))).alias("t"))
    got = {r.id: r.ids for r in texts.select("id", token_ids(Tokenizer("counted-lists", load, batch_size=50), F.col("t")).alias("ids")).collect()}
    assert got == {i: None if i % 7 == 0 else [2, len(str(i))] for i in range(2000)}


def test_bertscore_multiplies_only_words_of_one_text():
    class Counted(np.ndarray):
        made = 0

        def __matmul__(self, other):
            Counted.made += len(self) * other.shape[1]
            return np.asarray(self) @ np.asarray(other)

    both = [f"w{i}" for i in range(300)]
    pred, ref = both + ["left", "left"], ["right", *both]
    got = match_means(pred, ref, lambda words: hashed_words(words).view(Counted))
    assert Counted.made <= 2 * 301  # not 301 x 301

    v = {w: hashed_words([w])[0] for w in {*pred, *ref}}
    best = lambda a, b: [int(np.floor(max(v[x] @ v[y] / (np.sqrt(v[x] @ v[x]) * np.sqrt(v[y] @ v[y])) for y in b) * 1_000_000 + 0.5)) for x in a]
    mean = lambda s: (2 * sum(s) + len(s)) // (2 * len(s))
    assert got == (mean(best(pred, set(ref))), mean(best(ref, set(pred))))


def test_small_and_large_groups_have_the_same_neighbours(spark):
    rows = [(i, g, f"f{i}" if i % 5 else None) for i, g in enumerate([1] * 9 + [2] * 4 + [3] * 2 + [4] + [None] * 3)]
    src = spark.createDataFrame(rows, "row_id LONG, qid LONG, feedback STRING")
    near, joined = (sorted(map(repr, prs.inner_neighbours(src, window_rows=n).collect())) for n in (100, 0))
    mixed = sorted(map(repr, prs.inner_neighbours(src, window_rows=4).collect()))
    assert near == joined == mixed and len(near) == 2 * 13 + 2


def test_small_items_are_shuffled_once(spark):
    rows = [(i, i // 4, "d", float(i % 3), f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id LONG, question LONG, distractor STRING, score DOUBLE, feedback STRING")
    pairs = lambda n: sorted(map(repr, prs.score_pairs(df, block_rows=n).collect()))
    assert pairs(4096) == pairs(2) and len(pairs(4096)) == 50


def test_task_columns_have_one_type(spark):
    """An int and a long are hashed apart: with several partitions their groups would never meet."""
    side = lambda kind: spark.createDataFrame([(1, 1, [1.0])], f"id LONG, t {kind}, _v ARRAY<DOUBLE>")
    with pytest.raises(ValueError):
        sim.score_blocks(side("INT"), side("LONG").withColumnRenamed("id", "r"), ["t"], [], "id", "r", 1, False, False, 6)
