"""Queries: question expansion, splits, positional operators, compile single / head-to-head."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.registry import query, r6, sr6
from feedlens.functions.hashing import seeded_hash
from feedlens.operators import compile as cp
from feedlens.operators import index as ix
from feedlens.operators import mcq
from feedlens.rubric import METHODS, SEED
from feedlens.sources.views import view

MCQ = ("v_mcq",)
GEN = ("v_generated",)

# ---------------------------------------------------------------- SQL pieces

SQL_EL = "el AS (SELECT * FROM v_mcq WHERE (script_clean OR (cleaned AND NOT discuss_flag)) AND NOT image_needed)"


def _case(prefix: str) -> str:
    return "CASE c " + " ".join(f"WHEN {i} THEN {prefix}{i}" for i in mcq.OPTIONS) + " END"


SQL_CA = (f"ca AS (SELECT *, {_case('answer')} AS correct_answer, {_case('explanation')} AS explanation "
          "FROM (SELECT *, TRY_CAST(correct_no AS INTEGER) AS c FROM el))")
SQL_SPLIT = ("sp AS (SELECT id, split_idx, CASE WHEN split_idx < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' "
             "WHEN split_idx < floor(n * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM "
             "(SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', '221', 'shuffle', CAST(id AS VARCHAR))), id) - 1 "
             "AS split_idx, count(*) OVER () AS n FROM el))")


def _sql_expand(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT id * 10 + {i} AS row_id, id AS qid, question, construct_id, correct_answer, explanation, "
        f"answer{i} AS distractor, explanation{i} AS feedback{extra} FROM {src} WHERE c <> {i}" for i in mcq.OPTIONS)


SQL_OK = "ok AS (SELECT * FROM ca WHERE correct_answer IS NOT NULL AND correct_answer <> '')"
SQL_EXPANDED_SPLITS = (f"WITH {SQL_EL}, {SQL_CA}, {SQL_OK}, {SQL_SPLIT},\n"
                       f"oks AS (SELECT ok.*, sp.split FROM ok JOIN sp ON ok.id = sp.id),\n"
                       f"ex AS ({_sql_expand('oks', ', split')})")


# ---------------------------------------------------------------- Spark pieces

def eligible(spark, sf):
    return mcq.eligible(view(spark, sf, "v_mcq"))


def expanded_splits(spark, sf):
    """Questions split 60/20/20 after a seeded shuffle, then expanded (no question crosses splits)."""
    q = ix.split_by_share(eligible(spark, sf), ["id"])
    return mcq.expand(q, extra=("split",))


def expanded_table(spark, sf):
    """Expanded splits written once (partitioned by split) for jobs that read them in several branches."""
    from feedlens.sources.files import materialize
    return materialize(expanded_splits(spark, sf), "expanded", partition_by=["split"])


def generated_tables(spark, sf):
    g = view(spark, sf, "v_generated")
    return {m: g.filter(F.col("method") == m) for m in METHODS if m != "gold"}


def single(spark, sf):
    return cp.compile_single(generated_tables(spark, sf))


def h2h(spark, sf):
    return cp.compile_h2h(single(spark, sf))


# ---------------------------------------------------------------- queries

@query("mcq_eligible", MCQ, f"WITH {SQL_EL} SELECT * FROM el")
def mcq_eligible(spark, sf):
    return eligible(spark, sf)


@query("mcq_expand", MCQ, f"WITH {SQL_EL}, {SQL_CA}, {SQL_OK} {_sql_expand('ok')}")
def mcq_expand(spark, sf):
    return mcq.expand(eligible(spark, sf))


@query("mcq_rejects", MCQ, f"WITH {SQL_EL}, {SQL_CA} SELECT id, correct_no, CASE WHEN c IS NULL THEN 'unparsable' "
       "WHEN c NOT BETWEEN 1 AND 4 THEN 'out_of_range' ELSE 'missing_answer' END AS reason FROM ca "
       "WHERE correct_answer IS NULL OR correct_answer = ''")
def mcq_rejects(spark, sf):
    return mcq.rejects(eligible(spark, sf))


@query("expanded_splits", MCQ, SQL_EXPANDED_SPLITS + " SELECT * FROM ex")
def expanded_splits_q(spark, sf):
    return expanded_splits(spark, sf)


@query("split_exact", MCQ, f"WITH {SQL_EL}, {SQL_SPLIT} SELECT id, split_idx, split FROM sp")
def split_exact(spark, sf):
    return ix.split_by_share(eligible(spark, sf).select("id"), ["id"])


@query("row_index", (), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def row_index(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return ix.ordered_index(o, ["o_orderkey"])


@query("seeded_shuffle", (), "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', '221', 'shuffle', "
       "CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS idx FROM orders")
def seeded_shuffle(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return ix.seeded_order(o, ["o_orderkey"])


SAMPLE_SIZES = {"train": 10_000, "val": 1000, "test": 1000}
_STAND_IN = {m: f"'{m} feedback ' || substr(md5(concat_ws(':', '{m}', CAST(row_id AS STRING))), 1, 8)" for m in METHODS if m != "gold"}
_SQL_COMPILED = (SQL_EXPANDED_SPLITS + ", cs AS (" + " UNION ALL ".join(
    f"SELECT row_id AS src_row_id, qid, question, correct_answer, explanation, distractor, {e} AS feedback, '{m}' AS method, split FROM ex"
    for m, e in {**_STAND_IN, "gold": "feedback"}.items()) + ")")


def compiled_splits(spark, sf):
    """The compiled method table of all three splits over stand-in generated feedback, written once."""
    from feedlens.sources.files import materialize
    ex = expanded_table(spark, sf).withColumn("src_row_id", F.col("row_id"))
    generated = {m: ex.withColumn("generated_feedback", F.expr(e)) for m, e in _STAND_IN.items()}
    return materialize(cp.compile_single(generated, extra=("split",)), "compiled", partition_by=["split"])


@query("sample_exact", MCQ, _SQL_COMPILED + " SELECT src_row_id, qid, question, correct_answer, explanation, distractor, feedback, method, split "
       "FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws(':', '221', 'sample', CAST(src_row_id AS VARCHAR), method)), "
       "src_row_id, method) AS rn FROM cs) WHERE rn <= CASE split WHEN 'train' THEN 10000 ELSE 1000 END")
def sample_exact(spark, sf):
    """The training subsets: rows of the compiled method table, an exact number of every split."""
    return ix.stratified_sample(compiled_splits(spark, sf), SAMPLE_SIZES, "split", ["src_row_id", "method"], strict=True)


@query("prefix_limit", ("v_annotated_a",), "SELECT row_id, method FROM v_annotated_a ORDER BY row_id LIMIT 250")
def prefix_limit(spark, sf):
    return view(spark, sf, "v_annotated_a").select("row_id", "method").orderBy("row_id").limit(250)


@query("batch_ids", ("v_prompt",), "SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 10) AS BIGINT) "
       "AS batch_id FROM v_prompt")
def batch_ids(spark, sf):
    return ix.batch_ids(view(spark, sf, "v_prompt").select("row_id"), 10, ["row_id"])


CORPUS_SIZE = 500
VAL_SIZE = 250


@query("corpus_partition", MCQ, SQL_EXPANDED_SPLITS + f""",
tr AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws(':', '221', 'corpus', CAST(row_id AS VARCHAR))), row_id) - 1
  AS idx, count(*) OVER () AS n FROM ex WHERE split = 'train'),
dv AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM ex WHERE split = 'val')
SELECT 'train' AS mode, row_id, CASE WHEN idx < n - {CORPUS_SIZE} THEN 'data' ELSE 'corpus' END AS role FROM tr
UNION ALL SELECT 'dev', row_id, 'data' FROM dv WHERE idx < {VAL_SIZE}
UNION ALL SELECT 'dev', row_id, 'corpus' FROM ex WHERE split = 'train'""")
def corpus_partition(spark, sf):
    from feedlens.plans.retrieval import corpus_partition as cpart
    ex = expanded_table(spark, sf).select("row_id", "split")
    return cpart(ex, corpus_size=CORPUS_SIZE, val_size=VAL_SIZE)


_SQL_GEN_SINGLE = ("cs AS (" + " UNION ALL ".join(
    f"SELECT src_row_id, qid, question, correct_answer, explanation, distractor, generated_feedback AS feedback, '{m}' AS method "
    f"FROM v_generated WHERE method = '{m}'" for m in METHODS if m != "gold")
    + " UNION ALL SELECT src_row_id, qid, question, correct_answer, explanation, distractor, feedback, 'gold' "
    f"FROM v_generated WHERE method = '{METHODS[0]}')")


@query("compile_single", GEN, f"WITH {_SQL_GEN_SINGLE} SELECT * FROM cs")
def compile_single(spark, sf):
    return single(spark, sf)


_ORD = "CASE method " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METHODS)) + " END"
_SQL_H2H = (_SQL_GEN_SINGLE + f""",
co AS (SELECT *, {_ORD} AS ord, row_number() OVER (PARTITION BY src_row_id, method ORDER BY coalesce(md5(feedback), ''), feedback) AS nth FROM cs),
it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_row_id, nth ORDER BY ord) AS first FROM co) WHERE first = 1),
mu AS (SELECT it.src_row_id, it.qid, it.question, it.correct_answer, it.explanation, it.distractor,
  a.method AS mi, a.feedback AS fi, b.method AS mj, b.feedback AS fj,
  substr(md5(concat_ws(':', '221', 'h2h', CAST(a.src_row_id AS VARCHAR), CAST(a.ord AS VARCHAR), CAST(b.ord AS VARCHAR))), 1, 1) < '8' AS swap
  FROM co a JOIN co b ON a.src_row_id = b.src_row_id AND a.nth = b.nth AND a.ord < b.ord JOIN it ON it.src_row_id = a.src_row_id AND it.nth = a.nth),
h AS (SELECT src_row_id, qid, question, correct_answer, explanation, distractor,
  CASE WHEN swap THEN fj ELSE fi END AS feedback_1, CASE WHEN swap THEN fi ELSE fj END AS feedback_2,
  CASE WHEN swap THEN mj ELSE mi END AS method_1, CASE WHEN swap THEN mi ELSE mj END AS method_2 FROM mu)""")


@query("compile_h2h", GEN, f"WITH {_SQL_H2H} SELECT * FROM h")
def compile_h2h(spark, sf):
    return h2h(spark, sf)


def _h2h_label():
    return F.when(F.substring(seeded_hash(SEED, F.lit("h2hlabel"), "src_row_id", "method_1", "method_2"), 1, 1)
                  < F.lit("8"), F.lit(0)).otherwise(F.lit(1))


_SQL_H2H_LABEL = ("CASE WHEN substr(md5(concat_ws(':', '221', 'h2hlabel', CAST(src_row_id AS VARCHAR), method_1, method_2)), 1, 1) "
                  "< '8' THEN 0 ELSE 1 END")


@query("h2h_win_rate", GEN, f"WITH {_SQL_H2H}, hl AS (SELECT *, {_SQL_H2H_LABEL} AS label FROM h),\n"
       "sides AS (SELECT method_1 AS method, label = 0 AS win FROM hl UNION ALL SELECT method_2, label = 1 FROM hl)\n"
       f"SELECT method, count(*) AS n_matchups, {sr6('count_if(win) / (SELECT count(*) FROM hl)')} AS win_share_all, "
       f"{sr6('count_if(win) / count(*)')} AS win_rate FROM sides GROUP BY method")
def h2h_win_rate(spark, sf):
    w = cp.win_rates(h2h(spark, sf).withColumn("label", _h2h_label()))
    return w.select("method", "n_matchups", r6("win_share_all").alias("win_share_all"), r6("win_rate").alias("win_rate"))
