"""Question expansion (mcq_edge) and head-to-head matchups (h2h_hand)."""

from pyspark.sql import functions as F

from feedlens.operators import compile as cp
from feedlens.operators import mcq

COLS = ("id LONG, question STRING, construct_id LONG, correct_no STRING, answer1 STRING, answer2 STRING, answer3 STRING, "
        "answer4 STRING, explanation1 STRING, explanation2 STRING, explanation3 STRING, explanation4 STRING, "
        "script_clean BOOLEAN, cleaned BOOLEAN, discuss_flag BOOLEAN, image_needed BOOLEAN")


def _q(i, correct, answers, flags=(True, False, False, False)):
    return (i, f"q{i}", 1, correct, *answers, "e1", "e2", "e3", "e4", *flags)


def test_mcq_edge(spark):
    rows = [
        _q(1, "2", ["a", "b", "c", "d"]),
        _q(2, "5", ["a", "b", "c", "d"]),
        _q(3, "abc", ["a", "b", "c", "d"]),
        _q(4, None, ["a", "b", "c", "d"]),
        _q(5, "1", ["", "b", "c", "d"]),
        _q(6, "1", ["0", None, "c", "d"]),
        _q(7, "1", ["a", "b", "c", "d"], (False, True, True, False)),   # cleaned but discussed: not eligible
        _q(8, "1", ["a", "b", "c", "d"], (False, True, False, False)),  # cleaned, not discussed: eligible
        _q(9, "1", ["a", "b", "c", "d"], (True, True, False, True)),    # needs an image: not eligible
    ]
    df = mcq.eligible(spark.createDataFrame(rows, COLS))
    ids = sorted(r.id for r in df.collect())
    assert ids == [1, 2, 3, 4, 5, 6, 8]
    ex = mcq.expand(df).collect()
    by = {}
    for r in ex:
        by.setdefault(r.qid, []).append(r)
    assert sorted(by) == [1, 6, 8]
    assert sorted(r.distractor for r in by[1]) == ["a", "c", "d"] and all(r.correct_answer == "b" for r in by[1])
    assert by[6][0].correct_answer == "0" and None in [r.distractor for r in by[6]]  # '0' kept, NULL distractor kept
    rej = {r.id: r.reason for r in mcq.rejects(df).collect()}
    assert rej == {2: "out_of_range", 3: "unparsable", 4: "unparsable", 5: "missing_answer"}


def test_h2h_hand(spark):
    cols = "src_row_id LONG, qid LONG, question STRING, correct_answer STRING, explanation STRING, distractor STRING, " \
           "feedback STRING, generated_feedback STRING"
    gen = {m: spark.createDataFrame([(1, 1, "q", "c", "e", "d", "orig", f"{m}-text")], cols) for m in ("knn", "random", "zs")}
    single = cp.compile_single(gen)
    assert single.count() == 4
    h = cp.compile_h2h(single).collect()
    assert len(h) == 6
    assert {frozenset((r.method_1, r.method_2)) for r in h} == {frozenset(p) for p in
                                                                [("knn", "random"), ("knn", "zs"), ("knn", "gold"),
                                                                 ("random", "zs"), ("random", "gold"), ("zs", "gold")]}
    assert all(r.feedback_1 == ("orig" if r.method_1 == "gold" else f"{r.method_1}-text") for r in h)
    assert len(cp.compile_h2h(single, last_only=True).collect()) == 1
    lab = spark.createDataFrame([("knn", "zs", 0), ("zs", "gold", 1)], "method_1 STRING, method_2 STRING, label INT")
    w = {r.method: r for r in cp.win_rates(lab).collect()}
    assert w["knn"].win_rate == 1.0 and w["gold"].win_share_all == 0.5 and w["zs"].win_rate == 0.0


def test_h2h_of_incomplete_items_and_repeated_rows(spark):
    cols = "src_row_id LONG, qid LONG, question STRING, correct_answer STRING, explanation STRING, distractor STRING, feedback STRING, method STRING"
    item = lambda i, f, m: (i, 10 + i, f"q{i}", "c", "e", "d", f, m)
    single = spark.createDataFrame([
        item(1, "r", "random"), item(1, "z", "zs"), item(1, "g", "gold"),  # no row of the first method
        item(2, "k", "knn"), item(2, None, "zs"),  # a null feedback is a row
        item(3, "k1", "knn"), item(3, "k2", "knn"), item(3, "z1", "zs"), item(3, "z2", "zs"), item(3, "g", "gold"),
        item(4, "alone", "gold"), item(5, "x", "other"), item(5, "y", "knn")], cols)
    h = cp.compile_h2h(single).collect()
    sides = lambda i: sorted(tuple(sorted([(r.method_1, r.feedback_1), (r.method_2, r.feedback_2)], key=str)) for r in h if r.src_row_id == i)
    assert sides(1) == sorted([(("gold", "g"), ("random", "r")), (("gold", "g"), ("zs", "z")), (("random", "r"), ("zs", "z"))])
    assert all(r.question == "q1" and r.qid == 11 for r in h if r.src_row_id == 1)
    assert [r.method_1 != r.method_2 and {r.feedback_1, r.feedback_2} for r in h if r.src_row_id == 2] == [{"k", None}]
    assert len(sides(3)) == 4 and sides(4) == [] and sides(5) == []
    assert sum(p[0][0] == "gold" or p[1][0] == "gold" for p in sides(3)) == 2  # the one gold row meets one row of each method
    assert len({p for p in sides(3) if "gold" not in (p[0][0], p[1][0])}) == 2
    last = cp.compile_h2h(single, last_only=True).collect()
    assert sorted((r.src_row_id, *sorted([r.method_1, r.method_2])) for r in last) == [
        (1, "gold", "zs"), (2, "knn", "zs"), (3, "gold", "zs"), (3, "knn", "zs")]


def test_stratified_sample(spark):
    import pytest

    from feedlens.operators import index as ix

    df = spark.range(9000).selectExpr("id", "element_at(array('train', 'val', 'test'), cast(id % 3 as int) + 1) as split", "id as _c")
    got = ix.stratified_sample(df, {"train": 500, "val": 20, "test": 3}, "split", ["id"], digits=2)
    rows = got.collect()
    assert got.columns == df.columns
    for s, n in (("train", 500), ("val", 20), ("test", 3)):
        want = ix.sample_exact(df.filter(F.col("split") == s), n, ["id"])
        assert {r.id for r in rows if r.split == s} == {r.id for r in want.collect()}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, ix.stratified_sample(df.repartition(7), {"train": 500, "val": 20, "test": 3}, "split", ["id"]).collect()))
    assert ix.stratified_sample(df, {"train": 5000, "gone": 2}, "split", ["id"]).count() == 3000
    with pytest.raises(Exception, match="fewer than 5000 rows of train"):
        ix.stratified_sample(df, {"train": 5000}, "split", ["id"], strict=True).collect()
    with pytest.raises(Exception, match="fewer than 2 rows of gone"):
        ix.stratified_sample(df, {"train": 50, "gone": 2}, "split", ["id"], strict=True).collect()
    assert ix.stratified_sample(df.filter("false"), {"train": 5}, "split", ["id"]).collect() == []
