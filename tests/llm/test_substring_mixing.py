import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedlens.llm import mixing, substring_cover
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("period", sorted(substring_cover.DIFFERENCE_SETS))
def test_difference_sets_are_covers(period):
    d = substring_cover.DIFFERENCE_SETS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


@pytest.mark.parametrize("window,period,chunk", [(35, None, 300), (35, 31, 4 << 20), (6, 1, 200), (9, 7, 100)])
def test_repeats_equal_brute_force(spark, window, period, chunk):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (window - 1, window, window + 1, 3 * window)]
    texts = [None, "", " \n\t", "short text", "a " * (2 * window)]
    for _ in range(30):
        parts = [[rng.choice(words) for _ in range(rng.randrange(60))]]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), [rng.choice(words) for _ in range(rng.randrange(20))]]
        texts.append(rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p))
    texts += [texts[-1], texts[-1]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, N_words string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_cover.remove_repeats(
        docs, window=window, period=period, chunk_bytes=chunk, bucket_bytes=500).collect()}
    assert got == dict(enumerate(brute_repeats(texts, window)))


def test_repeats_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, chunk int, bits string")
    out = substring_cover.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "chunk", "bits", "n_words", "n_removed", "kept_text"] and out.collect() == []


def test_repeats_keep_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = substring_cover.remove_repeats(docs)
    assert out.select(docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()


def brute_targets(sizes, weights, share=1.5, most=2.0):
    total = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sizes(docs).collect()
    text = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(r.text or "")) for i, r in text.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken in (0, r["size"], 2 * r["size"])
    names = sorted(by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    expected = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, n, t in zip(names, sizes, expected):
        assert by[s][0].source_size == n and abs(by[s][0].target - t) < 1e-6 * max(t, 1)
        passes, sums = int(round(t) // n) if n else 0, {0}
        for r in by[s]:  # ten documents a source: every subset can be tried
            sums |= {x + r["size"] for x in sums}
        best = min(abs(passes * n + x - round(t)) for x in sums)
        assert abs(sum(r.taken for r in by[s]) - round(t)) == best
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(7)).collect()))


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (5, "f " * 30000, "z"), (6, "", "e")],
                                 "doc_id long, text string, source string").selectExpr("*", "7 as size", "8 as target", "9 as row")
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == 7 and {r.source_size for r in rows if r.source is None} == {2}
    assert all(r.taken <= 2 * r["size"] for r in rows) and {r.target for r in rows if r.source == "e"} == {0.0}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_sizes(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_fit_budget_is_a_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 60, 6))
        free = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, max(1, (lengths * free).sum()) + 1))
        sums = {0}
        for n, f in zip(lengths.tolist(), free.tolist()):
            sums = {s + k * n for s in sums for k in range(f + 1)}
        take = mixing.fit_budget(lengths, free, budget)
        assert (take <= free).all() and abs((take * lengths).sum() - budget) == min(abs(s - budget) for s in sums)


def test_fit_budget_takes_documents_of_any_length():
    one = lambda n, target: int(mixing.plan_source(np.array([n]), np.array([1]), target)[1][0])
    assert [one(n, 0.75 * n) for n in (100_000, 150_000, 300_000, 3_000_000)] == [1, 1, 1, 1]
    assert [one(n, 0.25 * n) for n in (100_000, 150_000, 300_000, 3_000_000)] == [0, 0, 0, 0]
    assert mixing.plan_source(np.array([1_000_000]), np.array([3]), 1_600_000)[1].tolist() == [2]
    rng = np.random.default_rng(2)
    for top in (200_000, 400_000, 2_000_000):  # over 131,072 and over 262,144
        for _ in range(20):
            lengths = np.unique(rng.integers(100_000, top, 6))
            free = rng.integers(0, 3, len(lengths))
            budget = int(rng.integers(0, max(1, (lengths * free).sum()) + 1))
            sums = {0}
            for n, f in zip(lengths.tolist(), free.tolist()):
                sums = {s + k * n for s in sums for k in range(f + 1)}
            take = mixing.fit_budget(lengths, free, budget)
            assert (take <= free).all() and abs((take * lengths).sum() - budget) == min(abs(s - budget) for s in sums)


def test_fit_budget_of_more_sums_than_room():
    lengths = np.unique(np.random.default_rng(3).integers(140_000, 3_000_000, 60))
    free = np.full(len(lengths), 2)
    for budget in (10_000_001, 50_000_001):
        take = mixing.fit_budget(lengths, free, budget)
        assert (take <= free).all() and abs((take * lengths).sum() - budget) <= -(-budget // (1 << 17))


def test_mix_of_a_long_document(spark):
    docs = spark.createDataFrame([(1, "f " * 300_000, "a"), (2, "g " * 300_000, "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix_sizes(docs, weights=(3, 1), share=0.5, max_passes=2).collect()}
    assert (rows[1].target, rows[1].taken, rows[2].taken) == (225_000, 300_000, 0)


def test_mix_hot_length_class_is_exact(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'one two three' as text", "'only' as source")
    rows = mixing.mix_sizes(docs).collect()
    assert sum(r.taken for r in rows) == 13500 and {r.copies for r in rows} == {1, 2}


def test_mix_repeats_take_rows_as_often(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    times = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert set(times.values()) <= {1, 2} and len(times) > 100
    assert hashlib.md5(str(sorted(times.items())).encode()).hexdigest() == hashlib.md5(
        str(sorted(Counter(r.doc_id for r in mixing.mix(docs).collect()).items())).encode()).hexdigest()


def test_plan_takes_every_length_at_the_wanted_share():
    rng = np.random.default_rng(5)
    for n, per, share in ((5200, 3, 0.3), (900, 1, 0.758), (400, 40, 0.635), (60, 900, 0.02)):
        lengths = np.sort(rng.choice(np.arange(1, 20_000), n, replace=False))
        counts = np.full(n, per)
        total = int((lengths * counts).sum())
        for seed in range(4):
            passes, take = mixing.plan_source(lengths, counts, share * total, seed=seed)
            assert passes == 0 and (take >= 0).all() and (take <= counts).all()
            assert (take * lengths).sum() == round(share * total)
            for part in np.array_split(np.arange(n), 5):
                assert abs(take[part].sum() / counts[part].sum() - share) < 0.05 * max(share, 0.2)


def test_mix_takes_every_fifth_of_lengths_alike(spark):
    """Every source of sf0.1, by fifths of document length: the wanted share within 0.05."""
    rows = mixing.mix_sizes(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for docs in by.values():
        passes, rest = divmod(round(docs[0].target), docs[0].source_size)
        assert abs(sum(r.taken for r in docs) - round(docs[0].target)) <= min(r["size"] for r in docs if r["size"])
        docs = sorted((r for r in docs if r["size"]), key=lambda r: r["size"])
        for part in np.array_split(np.arange(len(docs)), 5):
            took = sum(docs[i].copies - passes for i in part) / len(part)
            assert abs(took - rest / docs[0].source_size) < 0.05


def test_mix_of_identical_rows(spark):
    """A third of all rows are one document; no window or join key holds them all."""
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, -1, id) as doc_id", "if(id % 3 = 0, 'one two three', concat('w x y ', id)) as text",
                                        "if(id % 3 < 2, 'a', 'b') as source")
    rows = mixing.mix_sizes(docs, weights=(1, 4), share=0.5).collect()
    for s in "ab":
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 3
    a = [r for r in rows if r.source == "a"]
    same, other = [r.copies for r in a if r.doc_id == -1], [r.copies for r in a if r.doc_id != -1]
    assert len(same) == len(other) == 3000 and 0 < sum(same) < 3000
    again = mixing.mix_sizes(docs.repartition(5), weights=(1, 4), share=0.5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert len(mixing.mix(docs, weights=(1, 4), share=0.5).collect()) == sum(r.copies for r in rows)
