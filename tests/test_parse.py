"""Reply parsers on the hand-made replies of FIXTURES §3 (reply_edge, likert_edge)."""


from feedlens.functions.parse import parse_binary, parse_likert


def _bin(spark, texts, strict=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, r STRING")
    rows = df.select("id", parse_binary("r", strict=strict).alias("p")).orderBy("id").collect()
    return [(list(r.p.labels), r.p.n_missing) for r in rows]


def test_binary_reply_edge(spark):
    got = _bin(spark, [
        "1. Yes\n2. No\n3. Yes\n4. No\n5. Yes",
        "1. Because.\nAnswer: Yes.\n2. x Answer: No\n3. Yes",
        "no numbers here\nat all",
        "Answer: Yes",
        "1. Yes\n2. Yes\n3. Yes\n4. Yes\n5. Yes\n6. No",
    ])
    assert got[0][0] == [1.0, 0.0, 1.0, 0.0, 1.0]
    assert got[1][0] == [1.0, 0.0, 0.0, 0.5, 0.5]  # the third label is reset to 0
    assert got[2][0] == [0.5, 0.5, 0.5, 0.5, 0.0]  # nothing seen: the last label becomes 0
    assert got[3][0] == [0.5, 0.5, 0.5, 0.5, 0.0]  # written to the last label, then reset
    assert got[4][0] == [1.0, 1.0, 1.0, 1.0, 1.0]  # a sixth item is ignored


def test_binary_strict(spark):
    got = _bin(spark, ["1. Yes\n2. No\n3. Yes", "1. Yes\n2. No\n3. Yes\n4. No\n5. Yes"], strict=True)
    assert got[0] == ([1.0, 0.0, 1.0, None, None], 2)
    assert got[1] == ([1.0, 0.0, 1.0, 0.0, 1.0], 0)


def test_likert_edge(spark):
    texts = [
        "Score: 2\nScore: 1\nScore: 3\nScore: 2\nScore: 1",
        "Score: 2 and Score: 1\nScore: 1\nScore: 3\nScore: 3\nScore: 3",
        "Score: 2\nScore: 2\nScore: 3\nnone\nScore: 1",
        "Score: 2\nScore: 2\nScore: 9\nScore: 3\nScore: 3",
        "Score: 2\nScore: 2\nScore: 2\nScore: 2\nScore: 2\nScore: 2",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, r STRING")
    rows = df.select("id", parse_likert("r").alias("p"), parse_likert("r", strict=True).alias("s")).orderBy("id").collect()
    assert list(rows[0].p.labels) == [1.0, 0.0, 1.0, 0.5, 0.0]
    assert list(rows[1].p.labels) == [1.0, 0.0, 1.0, 1.0, 1.0]      # first score of a line
    assert list(rows[2].p.labels) == [1.0, 1.0, 1.0, 0.0, 0.5]      # missing fourth -> later scores shift
    assert rows[2].p.n_missing == 1
    assert list(rows[3].p.labels)[2] == 4.0 and rows[3].s.labels[2] is None  # out of range: literal vs strict
    assert list(rows[4].p.labels) == [1.0, 1.0, 0.5, 0.5, 0.5]      # first five used
