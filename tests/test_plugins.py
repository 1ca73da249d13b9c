"""Tokenizer and model plug-ins: loads per worker, loss masks, padding, one pass for an ensemble."""

import os
import uuid

from pyspark.sql import functions as F

from feedlens.functions import plugins as pl
from feedlens.operators import batches as bt


def counted(folder, make):
    """A loader that leaves a file per load, named by the worker process."""
    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return make()

    return load


def loads(folder):
    by = {}
    for name in os.listdir(folder):
        by[name.split("-")[0]] = by.get(name.split("-")[0], 0) + 1
    return by


def test_a_worker_loads_once(spark, tmp_path):
    tokenizer = pl.Tokenizer(f"t-{uuid.uuid4().hex}", counted(str(tmp_path), pl.load_word_ids), batch_size=7)
    df = spark.range(400).selectExpr("id", "concat('a b ', id) AS text").repartition(40)
    for _ in range(2):  # 80 tasks
        got = {r.id: list(r.ids) for r in df.select("id", pl.token_ids(tokenizer, F.col("text")).alias("ids")).collect()}
    assert got[5] == pl.load_word_ids()(["a b 5"])[0]
    assert 1 <= len(loads(tmp_path)) <= 16 and set(loads(tmp_path).values()) == {1}


def test_an_ensemble_is_one_pass_with_one_load_each(spark, tmp_path):
    names = [f"m{i}-{uuid.uuid4().hex}" for i in range(3)]
    folders = []
    for n in names:
        os.mkdir(tmp_path / n)
        folders.append(str(tmp_path / n))
    models = [pl.Scorer(n, counted(f, pl.hashed_scorer(n).load), batch_size=9) for n, f in zip(names, folders)]
    df = spark.createDataFrame([(i, None if i == 3 else f"text {i}", "x") for i in range(100)], "row_id INT, text STRING, logits2 STRING")
    out = pl.score_rows(df.repartition(10), models, "text", ["row_id", "logits2"])
    rows = {(r.row_id, r.model): list(r.logits) for r in out.collect()}
    out.groupBy("model").count().collect()  # reads the written scores
    assert len(rows) == 300 and all(set(loads(f).values()) == {1} for f in folders)
    for i, text in ((7, "text 7"), (3, "")):
        assert [rows[i, n] for n in names] == [pl.hashed_scorer(n).load()([text])[0] for n in names]
    assert pl.score_rows(df.filter("false"), models, "text", ["row_id"]).collect() == []


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, ""), (3, None), (4, " \t\n")], "id INT, text STRING")
    got = {r.id: r.ids for r in df.select("id", pl.token_ids(pl.WORD_IDS, F.col("text")).alias("ids")).collect()}
    assert len(got[1]) == 2 and got[2] == [] and got[3] is None and got[4] == []


def test_masks_and_padding(spark):
    df = spark.createDataFrame([(i, " ".join(["p"] * (1 + i % 4)), " ".join(["c"] * (i * 7 % 23))) for i in range(50)], "row_id INT, prompt STRING, done STRING")
    t = bt.token_rows(df, pl.WORD_IDS, F.col("prompt"), F.col("done"))
    waste = {}
    for name, batches in (("rows", bt.row_batches(t, 8)), ("lengths", bt.length_batches(t, 8))):
        rows = bt.padded_rows(t, batches, 0).collect()
        assert len(rows) == 50 and sorted({r.batch_id for r in rows}) == list(range(7))
        waste[name] = 0
        for r in rows:
            n, p = 1 + r.row_id % 4 + r.row_id * 7 % 23 + 1, 1 + r.row_id % 4
            width = len(r.input_ids)
            assert width == max(len(x.input_ids) for x in rows if x.batch_id == r.batch_id) == len(r.labels)
            assert r.attention_mask == [1] * n + [0] * (width - n) and r.input_ids[n:] == [0] * (width - n)
            assert r.labels == [-100] * p + r.input_ids[p:n] + [-100] * (width - n) and r.input_ids[n - 1] == 2
            waste[name] += width - n
    assert waste["lengths"] < waste["rows"] / 3


def test_generation_by_a_model(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "row_id INT, prompt STRING")
    got = {r.row_id: r.prediction for r in pl.write_rows(df, pl.ECHO, "prompt", ["row_id"]).collect()}
    assert got[1] == got[2] != got[3] and got[1].endswith("Question: more")
    short = {r.row_id: r.prediction for r in pl.write_rows(df, pl.ECHO, "prompt", ["row_id"], max_new_tokens=2).collect()}
    assert short[1] == " Look"
