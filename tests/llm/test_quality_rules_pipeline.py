import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from feedlens.llm import outliers, quality_knn
from feedlens.llm.queries import op1_quality_votes, op8_rule_outliers, tokenizer_path
from feedlens.llm.words import text_buffers
from tests.conftest import SF
from tests.llm.test_substring_mixing import brute_repeats
from tests.llm.test_words_simhash import brute_components, brute_fingerprint

LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in op1_quality_votes(spark, LARGER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b c", "z"), (None, "q" * 200_000, "w"), (3, "a b c", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    out = quality_knn.classify(docs, quality_knn.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = quality_knn.classify(docs, quality_knn.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_knn.classify(docs.limit(0), quality_knn.fit(docs, labels)).collect() == []


def test_quality_fits_one_text_of_each_labelled_id(spark):
    texts = [(i, f"text {i} " + "ab " * i) for i in range(10)]
    docs = spark.createDataFrame([*[(0, f"copy {k % 3}") for k in range(60)], *texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    fits = [quality_knn.fit(d, labels, max_rows=10) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("text")))]
    assert all(len(m.labels) == 10 and m.labels.sum() == 5 for m in fits)
    assert all(np.array_equal(fits[0].vectors, m.vectors) for m in fits[1:])


def test_quality_counts_are_not_clipped(spark):
    docs = spark.createDataFrame([(1, "q" * 200_000), (2, "r s")], "doc_id long, text string")
    m = quality_knn.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    long = quality_knn.features(*text_buffers(pa.array(["q" * 200_000], pa.string())), len(m.weights))
    assert np.abs(m.vectors - m.project(long)).sum(1).min() < 1e-5


def test_blocked_votes_are_exact():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.integers(0, 2, 100).astype(float)
    m = quality_knn.LatentVotes(np.zeros(1), np.zeros((1, 8)), x[:100], y, 0.5, 5, 2.0)
    got = m.score(x[100:], block=33)
    for i, v in enumerate(x[100:]):
        c = x[:100] @ v
        near = np.argsort(-c)[:5]
        w = np.maximum(c[near], 0).astype(float) ** 2
        assert abs(got[i] - ((w * y[near]).sum() + 0.025) / (w.sum() + 0.05)) < 1e-6


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    """Texts of one label whose n-gram counts have equal sums, in three orders of arrival."""
    rng = np.random.default_rng(2)
    texts = [(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 5, 4)) for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = []
    for parts in (1, 3, 7):
        model = quality_knn.fit(docs.repartition(parts).orderBy(F.xxhash64(F.lit(parts), "doc_id")), labels.repartition(parts), k=4)
        scores.append([r.score for r in quality_knn.classify(docs, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1] == scores[2]


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_text_statistics(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", "\n\n", "a\na\n a\na", "x y z x y z", "é é é é", "# $ %", "a\n", "\na\r\na\r\n"]
    s = outliers.text_statistics(*text_buffers(pa.array(texts, pa.string())))
    assert [tuple(int(s[c][i]) for c in outliers.BASE) for i in range(len(texts))] == [brute_statistics(t) for t in texts]


def test_rules_keep_clean_and_reject_noise(spark):
    rows = op8_rule_outliers(spark, LARGER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    tried = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, q in tried if q == 1]) > 0.99
    assert np.mean([k for k, q in tried if q == 0]) < 0.25


def test_rules_equal_a_brute_force_estimate(spark):
    """One group of known shape, a seventh of it far off in one statistic (the numpy run of the same
    steps is below)."""
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(5, 1, (400, 1)), rng.normal(1.6, 0.2, (400, 1)), np.zeros((400, 3))]
    x[:60, 1] += 4
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    r = outliers.robust_estimates(rows).first()
    assert r.n_rows == 400 and abs(r["mean"][1] - 1.6) < 0.1 and abs(r["mean"][0] - 5) < 0.4
    cov = outliers._square(np.array(r["cov"]))
    assert 0.3 < cov[0, 0] < 2 and 0.01 < cov[1, 1] < 0.1


def numpy_groups(groups):
    """Start, concentration steps and consistency of all groups (name -> rows) in plain numpy."""
    floor = np.diag(np.square(outliers.FLOORS))
    distance = lambda x, mean, cov: np.maximum(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean), 0)
    bins = lambda d: np.floor(np.log2(d + 1e-6) * outliers.BINS).astype(int)

    def nearer(b):
        """Rows in the bins that begin before half of the rows are counted."""
        return np.array([2 * (b < x).sum() < len(b) for x in b])

    now = {}
    for name, x in groups.items():
        q = [np.sort(x, axis=0)[int(np.ceil(p * len(x))) - 1] for p in (0.25, 0.5, 0.75)]
        now[name] = np.round(q[1], 9), np.diag(np.square((q[2] - q[0]) / 1.349))
    for step in range(10):
        moved = []
        for name, x in groups.items():
            mean, cov = now[name]
            near = x[nearer(bins(distance(x, mean, cov)))]
            new = near.mean(0), np.cov(near.T, bias=True)
            moved.append(abs(np.linalg.slogdet(new[1] + floor)[1] - np.linalg.slogdet(cov + floor)[1]))
            now[name] = np.round(new[0], 9), new[1]
        if step and max(moved) <= 1e-3:
            break
    out = {}
    for name, x in groups.items():
        mean, cov = now[name]
        b = bins(distance(x, mean, cov))
        median = 2.0 ** ((b[nearer(b)].max() + 1) / outliers.BINS)
        varying = max(1.0, np.trace(np.linalg.inv(cov + floor) @ cov))
        out[name] = mean, cov * max(1.0, median / outliers.chi_square_bound(0.5, varying)), len(x)
    return out, floor


def test_rules_equal_a_numpy_run(spark):
    """Every row's distance and verdict against numpy: start, steps, consistency, leaning, bound."""
    got = {r.doc_id: r for r in op8_rule_outliers(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    vectors, fitted = {}, {}
    for d in docs:
        n, chars, symbols, lines, repeats = brute_statistics(d.text)
        vectors[d.doc_id] = np.array([np.log1p(n), np.log(max(chars / max(n, 1), 1.0)), np.log1p(symbols / (n + 50)),
                                      np.sqrt(lines / (n + 50)), np.sqrt(repeats / (n + 50))])
        assert got[d.doc_id].base_failed == (n < 50 or 100 * repeats > 50 * n)
        if not got[d.doc_id].base_failed:
            for name in ((d.lang, d.source), (d.lang,)):
                fitted.setdefault(name, []).append(vectors[d.doc_id])
    found, floor = numpy_groups({k: np.array(v) for k, v in fitted.items()})
    limit, compared, rejected = outliers.chi_square_bound(0.999, 5), 0, 0
    for d in docs:
        r = got[d.doc_id]
        if (d.lang, d.source) not in found:
            assert r.distance is None and r.kept == (not r.base_failed)
            continue
        (mean, cov, n), (wide_mean, wide_cov, _) = found[d.lang, d.source], found[d.lang,]
        part = n / (n + 50)
        x = vectors[d.doc_id] - (part * mean + (1 - part) * wide_mean)
        want = x @ np.linalg.inv(part * cov + (1 - part) * wide_cov + floor) @ x
        assert abs(r.distance - want) <= 1e-6 * max(1.0, want)
        assert r.kept == (not r.base_failed and want <= limit)
        compared += 1
        rejected += not r.base_failed and want > limit
    assert compared > 150 and rejected > 3


def test_rules_reject_planted_outliers_that_pass_the_base_rules(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(3000)]
    words = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    clean = [" ".join(words(int(n))) for n in np.exp(rng.normal(5.6, 0.6, 400)).clip(60, 2000)]
    w, planted = words(200), words(15)
    passage = " ".join([*w[:120], *planted * 6])  # 90 of 210 words repeat
    lines = "\n".join(x for k in range(0, 198, 6) for x in (" ".join(w[k:k + 6]), "more"))  # 32 duplicate lines of one word
    symbols = " ".join(x + " #" * (i % 6 == 0) for i, x in enumerate(w))  # a symbol to six words
    docs = spark.createDataFrame(list(enumerate([*clean, passage, lines, symbols])), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    got = {r.doc_id: r for r in outliers.rule_verdicts(docs).collect()}
    assert [(got[i].base_failed, got[i].kept) for i in (400, 401, 402)] == [(False, False)] * 3
    assert sum(got[i].kept for i in range(400)) >= 396


def test_rules_hold_their_false_rejection_rate(spark):
    """Normal rows that vary in every statistic are beyond the bound about as often as it says."""
    rng = np.random.default_rng(3)
    x = rng.normal([5.6, 1.6, 0.3, 0.3, 0.3], [0.85, 0.05, 0.2, 0.2, 0.2], (20_000, 5))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    r = outliers.robust_estimates(rows).first()
    inverse = np.linalg.inv(outliers._floored(outliers._square(np.array(r["cov"]))))
    d = x - np.array(r["mean"])
    beyond = np.einsum("ij,jk,ik->i", d, inverse, d) > outliers.chi_square_bound(outliers.QUANTILE, outliers.P)
    assert 0.0003 < beyond.mean() < 0.003


def test_rule_edges(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (3, good, None, "s"), (3, good, None, "s"), (None, good + " x", "en", "s"), (5, "a " * 100, "en", "s")],
                                 "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as grp", "3 as n_words")
    got = sorted(((r.doc_id, r.base_failed, r.kept) for r in outliers.rule_verdicts(docs).collect()), key=repr)
    assert got == sorted([(1, True, False), (2, True, False), (3, False, True), (3, False, True), (None, False, True), (5, True, False)], key=repr)
    assert outliers.rule_verdicts(docs.limit(0)).collect() == []


def test_pipeline_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in op1_quality_votes(spark, SF).collect()}
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p == 1}
    once = stage["near_duplicates"](spark, docs, SF)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert sorted(r.doc_id for r in once.collect()) == sorted({c for _, _, c in brute_components(rows)}) and once.columns == docs.columns
    cut = {r.doc_id: r for r in stage["repeated_passages"](spark, docs, SF).collect()}
    all_rows = docs.collect()
    for r, (n, gone, text) in zip(all_rows, brute_repeats([r.text for r in all_rows], 35)):
        # documents that lose every word stay, with an empty text
        assert cut[r.doc_id].text == (text if gone else r.text) and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)
    mixed = stage["weighted_mix"](spark, docs, SF)
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.run(spark, SF)
    t = Tokenizer.from_file(tokenizer_path())
    whole = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        whole = spark.createDataFrame(f(spark, whole, SF).collect(), whole.schema)
    expected = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in whole.collect())
    got = Counter((r.doc_id, r.doc_tokens) for r in pieces.filter("start = 0").collect())
    assert got == expected


def test_pipeline_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (None, "x y", None, None, None), (None, "x y", None, None, None), (2, "x y", "en", "a", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("label", F.lit("q"))
    for frame in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, frame, SF)
            out.collect()
            assert name == "packed" or out.columns == frame.columns
