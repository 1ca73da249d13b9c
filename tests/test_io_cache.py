"""CSV hand-off (csv_edge), response cache, generation and the incremental stream."""

from pyspark.sql import types as T

from feedlens.session import shared_dir
from feedlens.sources import cache as cc
from feedlens.sources import files as fl
from feedlens.streaming import generation as gen


def test_csv_edge_roundtrip(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("label", T.DoubleType())])
    raw = spark.createDataFrame([(1, 'line one\nline "two", with comma', "1"), (2, "", "NA"), (3, "NA", "0"),
                                 (4, None, None), (5, "  padded  ", "0.5")], "id LONG, text STRING, label STRING")
    path = shared_dir(spark, "csvtest") + "/t"
    fl.write_csv(raw, path)
    back = {r.id: r for r in fl.read_csv(spark, path, schema, na_columns=["label"]).collect()}
    assert back[1].text == 'line one\nline "two", with comma' and back[1].label == 1.0
    assert back[2].label is None           # NA in a label column is missing
    assert back[3].text == "NA"            # ... but stays text elsewhere
    assert back[4].label is None
    assert back[5].text == "  padded  " and back[5].label == 0.5


def test_cache_merge_and_lookup(spark):
    root = shared_dir(spark, "cachetest")
    k = dict(model="m", max_tokens=10, system_message=None)
    stored = cc.with_key(spark.createDataFrame([("p1", "old1"), ("p2", "old2")], "prompt STRING, response STRING"), **k)
    cc.save_cache(spark, stored, root)
    own = cc.with_key(spark.createDataFrame([("p2", "new2"), ("p3", "new3")], "prompt STRING, response STRING"), **k)
    cc.save_cache(spark, own, root)
    assert len(cc.deltas(spark, root)) == 2
    got = {r.prompt: r.response for r in cc.load_cache(spark, root).collect()}
    assert got == {"p1": "old1", "p2": "new2", "p3": "new3"}
    q = cc.with_key(spark.createDataFrame([(1, "p1"), (2, "p4"), (3, "p4")], "row_id INT, prompt STRING"), **k)
    assert cc.missing(q, cc.load_cache(spark, root)).count() == 1  # p4 sent once


def test_generate_and_retry(spark):
    root = shared_dir(spark, "gentest")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row_id INT, prompt STRING")
    out = {r.row_id: r.response for r in gen.generate(spark, prompts, gen.stub_writer, root, model="m",
                                                      max_tokens=50).collect()}
    assert out[1] == out[3] and out[1].startswith("Check the step again")
    calls = {"n": 0}

    def flaky(ps, **kw):
        calls["n"] += 1
        if calls["n"] % 2:
            raise gen.TransientError("busy")
        return [p.upper() for p in ps]

    res = {r.row_id: r.response for r in gen.generate(spark, prompts, flaky, shared_dir(spark, "gentest2"),
                                                      model="m", max_tokens=5).collect()}
    assert res == {1: "A", 2: "B", 3: "A"}
    sampled = gen.generate(spark, prompts, gen.stub_writer, root, model="m", max_tokens=50, temperature=0.7)
    assert sampled.count() == 3 and set(sampled.columns) == {"row_id", "prompt", "response", "error"}


def _rows(spark, root, *pairs):
    rows = cc.with_key(spark.createDataFrame(list(pairs), "prompt STRING, response STRING"), "m", 10, None)
    return cc.save_cache(spark, rows, root)


def test_two_writers_and_an_unfinished_write_lose_nothing(spark):
    import os

    root = shared_dir(spark, "cachewriters")
    _rows(spark, root, ("a", "1"))
    first = cc.load_cache(spark, root)  # both writers read before either saves
    _rows(spark, root, ("b", "2"))
    _rows(spark, root, ("c", "3"))
    assert first.count() == 1 and {r.prompt for r in cc.load_cache(spark, root).collect()} == {"a", "b", "c"}
    os.remove(_rows(spark, root, ("d", "4")).replace("file:", "") + "/_SUCCESS")
    assert {r.prompt for r in cc.load_cache(spark, root).collect()} == {"a", "b", "c"}


def test_exhausted_retries_are_reported_and_not_cached(spark):
    root = shared_dir(spark, "generrors")
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "row_id INT, prompt STRING")

    def broken(ps, **kw):
        if "p1" in ps:
            raise gen.TransientError("busy")
        return [p.upper() for p in ps]

    out = {r.row_id: (r.response, r.error) for r in gen.generate(spark, prompts, broken, root, model="m", max_tokens=5, batch_size=1).collect()}
    assert out[1] == (None, "busy") and out[0] == ("P0", None)
    assert cc.load_cache(spark, root).count() == 3


def test_calls_are_spread_over_tasks(spark):
    prompts = spark.range(200).selectExpr("id as row_id", "concat('p', id) as prompt")

    def where(ps, **kw):
        from pyspark import TaskContext
        return [str(TaskContext.get().partitionId())] * len(ps)

    out = gen.generate(spark, prompts, where, shared_dir(spark, "genspread"), model="m", max_tokens=5, concurrency=4)
    assert out.select("response").distinct().count() == 4


def test_histories_bypass_the_cache(spark):
    root = shared_dir(spark, "genhistory")
    prompts = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", []), (3, "a", None)], "row_id INT, prompt STRING, history ARRAY<STRING>")

    def client(ps, *, histories=None, **kw):
        return [p + "".join(h) for p, h in zip(ps, histories)] if histories else [p.upper() for p in ps]

    out = {r.row_id: r.response for r in gen.generate(spark, prompts, client, root, model="m", max_tokens=5).collect()}
    assert out == {1: "axy", 2: "A", 3: "A"} and cc.load_cache(spark, root).count() == 1


def test_incremental_stream(spark):
    base = shared_dir(spark, "stream")
    src, out, ckpt, root = (f"{base}/{n}" for n in ("src", "out", "ckpt", "cache"))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("prompt", T.StringType())])
    spark.createDataFrame([(1, "x"), (2, "y")], schema).write.mode("append").parquet(src)
    q = gen.start_incremental(spark, src, schema, gen.stub_writer, root, out, ckpt, model="m", max_tokens=20)
    q.awaitTermination()
    spark.createDataFrame([(3, "x"), (4, "z")], schema).write.mode("append").parquet(src)
    q = gen.start_incremental(spark, src, schema, gen.stub_writer, root, out, ckpt, model="m", max_tokens=20)
    q.awaitTermination()
    rows = {r.row_id: r.response for r in spark.read.parquet(out).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[1] == rows[3]
    cached = {r.prompt for r in cc.load_cache(spark, root).collect()}
    assert cached == {"x", "y", "z"}


def test_shared_folder_rules(spark, monkeypatch):
    import os

    import pytest

    from feedlens import session

    path = session.shared_dir(spark, "gone").replace("file:", "")
    assert os.path.isdir(path)
    assert session.release_intermediates(spark) >= 1 and not os.path.exists(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster, "x")
