"""Queries: Likert grading end to end, model-graded means, generation after prompting, short ROUGE-L."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.agreement_q import _AGREE_SQL, SQL_PAIRS
from feedlens.catalog.metrics_q import _sql_example, _FEWSHOT_KNN, _FEWSHOT_RANDOM, LOG, P_NAMES, R_NAMES, SQL_ENS, SQL_PROBS, _ens, fewshot_knn, fewshot_random
from feedlens.catalog.registry import query, r6, sr6
from feedlens.catalog.sources_q import MAX_TOKENS, MODEL
from feedlens.functions import prompts as pr
from feedlens.functions.encode import encoder_udf, hashed_bow
from feedlens.functions.parse import parse_likert, sql_likert_scores, sql_parse_likert
from feedlens.functions.rouge import rouge_l, sql_tokens
from feedlens.operators import agreement as ag
from feedlens.operators import fewshot as fs
from feedlens.operators import index as ix
from feedlens.operators import metrics as mt
from feedlens.operators.similarity import block_topk
from feedlens.plans import generate as pg
from feedlens.rubric import LIKERT, LIKERT_MAX_SCORES, LIKERT_NAMES
from feedlens.session import shared_dir
from feedlens.sources.files import materialize
from feedlens.sources.views import view
from feedlens.streaming import generation as gen

LIK = LIKERT.labels
_, _LIK = sql_parse_likert()


# ---- Likert mode ----------------------------------------------------------------------------

def _sql_stub_likert(prompt: str) -> str:
    lines = [f"'{n}: Score: ' || CAST(('0x' || substr(md5({prompt}), {i + 1}, 1))::INTEGER % {m} + 1 AS VARCHAR)"
             for i, (n, m) in enumerate(zip(LIKERT_NAMES, LIKERT_MAX_SCORES))]
    return " || chr(10) || ".join(lines)


@query("annotate_likert", ("v_annotated_a",), f"SELECT row_id, {', '.join(f'{e} AS {n}' for e, n in zip(_LIK, LIK))} FROM "
       f"(SELECT row_id, {sql_likert_scores()} AS sc FROM (SELECT row_id, {_sql_stub_likert('prompt')} AS response FROM "
       f"(SELECT row_id, {pr.sql_annotation_prompt(True)} AS prompt FROM v_annotated_a)))")
def annotate_likert(spark, sf):
    """Grade every row with the (stub) Likert grader and parse the replies into the five scores."""
    prompts = pg.grading_prompts(view(spark, sf, "v_annotated_a"), prompt_fn=lambda: pr.annotation_prompt(True))
    out = gen.generate(spark, prompts, gen.stub_likert_grader, shared_dir(spark, "cache"), model=MODEL, max_tokens=MAX_TOKENS,
                       system_message=pr.EXPERT_SYSTEM)
    p = out.select("row_id", parse_likert("response").alias("p"))
    return p.select("row_id", *[F.col("p.labels")[i].alias(n) for i, n in enumerate(LIK)])


# the second annotator's binary labels on the Likert scale: accurate and reveal are reversed
_B = ["1 - incorrect", "1 - reveal", "suggestions", "misconceptions", "positive"]
_LIKERT_LONG = (f"WITH sc AS (SELECT row_id, {sql_likert_scores()} AS sc FROM v_reply_likert),\n"
                f"la AS (SELECT row_id, {', '.join(f'{e} AS {n}' for e, n in zip(_LIK, LIK))} FROM sc),\n"
                "long AS (" + " UNION ALL ".join(
                    f"SELECT la.row_id, method, '{n}' AS label, CAST(la.{n} AS DOUBLE) AS a, CAST({b.replace('incorrect', 'b.incorrect').replace('reveal', 'b.reveal') if '-' in b else 'b.' + b} AS DOUBLE) AS b "
                    f"FROM la JOIN v_annotated_b b ON b.row_id = la.row_id WHERE b.reveal IS NOT NULL" for n, b in zip(LIK, _B)) + ")")


@query("agreement_likert", ("v_reply_likert", "v_annotated_b"), _LIKERT_LONG + _AGREE_SQL[len(SQL_PAIRS):] + "\nSELECT method, label, n, "
       + ", ".join(f"{sr6(m)} AS {m}" for m in ag.METRICS) + " FROM mf")
def agreement_likert(spark, sf):
    """Parsed Likert scores (which take values beyond 0, 0.5 and 1) against the second annotator."""
    a = view(spark, sf, "v_reply_likert").select("row_id", parse_likert("response")["labels"].alias("s"))
    b = view(spark, sf, "v_annotated_b").filter("reveal IS NOT NULL").select(F.col("row_id").alias("_b"), "method", *[
        F.expr(e).alias(f"{n}_b") for n, e in zip(LIK, _B)])
    j = a.join(b, F.col("row_id") == F.col("_b")).select("*", *[F.col("s")[i].alias(f"{n}_a") for i, n in enumerate(LIK)])
    m = ag.agreement_metrics(ag.long_labels(j, LIK))
    return m.select("method", "label", "n", *[r6(x).alias(x) for x in ag.METRICS])


@query("eval_means_likert", ("v_reply_likert",), f"WITH p AS (SELECT {', '.join(f'{e} AS {n}' for e, n in zip(_LIK, LIK))} FROM "
       f"(SELECT {sql_likert_scores()} AS sc FROM v_reply_likert)) " + " UNION ALL ".join(
           f"SELECT '{n}' AS metric, {sr6(f'avg({n})')} AS mean FROM p" for n in LIK)
       + f" UNION ALL SELECT 'score', {sr6(f'avg({LIK[0]} * (' + ' + '.join(LIK) + ') / 5.0)')} FROM p")
def eval_means_likert(spark, sf):
    p = view(spark, sf, "v_reply_likert").select(parse_likert("response")["labels"].alias("s"))
    p = p.select(*[F.col("s")[i].alias(n) for i, n in enumerate(LIK)])
    wide = p.agg(*[F.avg(n).alias(n) for n in LIK], F.avg(ag.gated_score(LIK)).alias("score"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), r6(n).alias("mean")) for n in [*LIK, "score"]])))


# ---- model-graded evaluation ------------------------------------------------------------------

@query("eval_means_model", LOG, f"WITH {SQL_ENS}, {SQL_PROBS}, rr AS (SELECT " + ", ".join(
           f"round_even({p}, 0) AS {r}" for p, r in zip(P_NAMES, R_NAMES)) + " FROM pr) " + " UNION ALL ".join(
           f"SELECT '{r}' AS metric, {sr6(f'avg({r})')} AS mean FROM rr" for r in R_NAMES)
       + f" UNION ALL SELECT 'score', {sr6('avg(' + R_NAMES[0] + ' * (' + ' + '.join(R_NAMES) + ') / 5.0)')} FROM rr")
def eval_means_model(spark, sf):
    """Means of the reward models' rounded labels and of the gated score."""
    e = _ens(spark, sf).select(F.transform(mt.probabilities(F.col("logits")), lambda p: F.bround(p, 0)).alias("r"))
    wide = e.agg(*[F.avg(F.col("r")[i]).alias(n) for i, n in enumerate(R_NAMES)], F.avg(mt.gated(F.col("r"))).alias("score"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), r6(n).alias("mean")) for n in [*R_NAMES, "score"]])))


# ---- generation after prompting -----------------------------------------------------------------

_WRITTEN = "'Check the step again (' || substr(md5(prompt), 1, 8) || ').'"


def _written(spark, prompts):
    out = pg.generate_feedback(spark, prompts, gen.stub_writer, shared_dir(spark, "cache"), model=MODEL, max_tokens=MAX_TOKENS)
    return out.select("row_id", "prompt", "generated_feedback")


@query("generate_zero_shot", ("v_expanded",), f"SELECT row_id, prompt, {_WRITTEN} AS generated_feedback FROM "
       f"(SELECT row_id, {pr.sql_zero_shot(pr.sql_prompt_input(False))} AS prompt FROM v_expanded)")
def generate_zero_shot(spark, sf):
    return _written(spark, pg.zero_shot_prompts(view(spark, sf, "v_expanded")))


@query("generate_random", ("v_mcq",), f"SELECT row_id, prompt, {_WRITTEN} AS generated_feedback FROM ({_FEWSHOT_RANDOM})")
def generate_random(spark, sf):
    return _written(spark, fewshot_random(spark, sf))


@query("generate_knn", ("v_expanded",), f"SELECT row_id, prompt, {_WRITTEN} AS generated_feedback FROM ({_FEWSHOT_KNN})")
def generate_knn(spark, sf):
    return _written(spark, fewshot_knn(spark, sf))


# ---- nearest examples by encoded prompt inputs --------------------------------------------------------

_SQL_ENCODED = f"""sp AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '221', 'shuffle', CAST(row_id AS VARCHAR))), row_id) - 1 AS idx,
  count(*) OVER () AS n FROM v_expanded),
x AS (SELECT *, CASE WHEN idx < floor(n * 0.6) THEN 'train' WHEN idx < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split,
  {pr.sql_prompt_input(False)} AS txt FROM sp),
c AS (SELECT row_id, slot, CAST(count(*) AS DOUBLE) AS n FROM (SELECT row_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS slot
  FROM (SELECT row_id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS w FROM x)) GROUP BY row_id, slot),
m AS (SELECT row_id, map(list(slot), list(n)) AS mp, sqrt(sum(n * n)) AS len FROM c GROUP BY row_id),
u AS (SELECT m.row_id, split, list_transform(range(64), lambda i: coalesce(m.mp[i], 0.0) / m.len) AS u FROM m JOIN x ON x.row_id = m.row_id),
sims AS (SELECT t.row_id AS target_id, p.row_id AS pool_id, round(list_dot_product(t.u, p.u), 6) AS sim
  FROM u t JOIN u p ON p.split = 'train' AND t.row_id <> p.row_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, pool_id) AS rank FROM sims) WHERE rank <= 2)"""


@query("fewshot_knn_encoded", ("v_expanded",), f"""WITH {_SQL_ENCODED},
exs AS (SELECT k.target_id AS row_id, k.rank, {_sql_example('p.')} AS text FROM knn k JOIN x p ON p.row_id = k.pool_id),
body AS (SELECT row_id, string_agg(text, '' ORDER BY rank DESC) AS b FROM exs GROUP BY row_id)
SELECT x.row_id, x.split, {pr.sql_lit(pr.instruction(False) + chr(10) + chr(10))} || coalesce(body.b, '') || {pr.sql_prompt_input(False, 'x.')}
  || chr(10) || 'Feedback:' AS prompt FROM x LEFT JOIN body ON body.row_id = x.row_id""")
def fewshot_knn_encoded(spark, sf):
    """Examples of the train split nearest to each row's own encoded prompt input (self excluded);
    targets are the rows of all three splits."""
    x = view(spark, sf, "v_expanded")
    split = ix.split_by_share(x.select("row_id"), ["row_id"]).select(F.col("row_id").alias("_s"), "split")
    # a task per core: adaptive execution would merge rows so slim into few tasks, and the encoding with them
    inputs = x.select("row_id", pr.prompt_input(False).alias("_text")).repartition(spark.sparkContext.defaultParallelism, "row_id")
    vec = encoder_udf(hashed_bow, 64)("_text")
    coded = materialize(inputs.select("row_id", vec.alias("vec")).join(split, F.col("row_id") == F.col("_s")).drop("_s"), "encoded")
    targets = coded.select(F.col("row_id").alias("target_id"), "vec")
    pool = coded.filter("split = 'train'").select(F.col("row_id").alias("pool_id"), "vec")
    knn = block_topk(targets, pool, left_id="target_id", right_id="pool_id", k=2, exclude_self=True)
    texts = x.select(F.col("row_id").alias("pool_id"), fs.example_texts(x).alias("text"))
    examples = knn.join(texts, "pool_id").select(F.col("target_id").alias("row_id"), "rank", "text")
    prompts = fs.assemble(x, examples, descending=True)
    return prompts.join(coded.select(F.col("row_id").alias("_s"), "split"), F.col("row_id") == F.col("_s")).select("row_id", "split", "prompt")


# ---- ROUGE-L on short texts, where an LCS in SQL ends ---------------------------------------------

@query("rouge_l_short", (), f"""WITH RECURSIVE tok AS (SELECT a.p_partkey, {sql_tokens('a.p_name')} AS ta, {sql_tokens("b.p_name || ' ' || a.p_type")} AS tb
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
dp(p_partkey, i, row) AS (
  SELECT p_partkey, 0, list_transform(range(0, len(tb) + 1), lambda x: 0) FROM tok
  UNION ALL
  SELECT d.p_partkey, d.i + 1, list_transform(range(1, len(t.tb) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    greatest(d.row[k], CASE WHEN k > 1 AND t.ta[d.i + 1] = t.tb[k - 1] THEN d.row[k - 1] + 1 ELSE 0 END))))
  FROM dp d JOIN tok t ON t.p_partkey = d.p_partkey WHERE d.i < len(t.ta)),
l AS (SELECT d.p_partkey, len(ta) AS na, len(tb) AS nb, CAST(d.row[len(tb) + 1] AS DOUBLE) AS lcs
      FROM dp d JOIN tok t ON t.p_partkey = d.p_partkey WHERE d.i = len(t.ta)),
pr AS (SELECT p_partkey, CASE WHEN na = 0 THEN 0.0 ELSE lcs / na END AS p, CASE WHEN nb = 0 THEN 0.0 ELSE lcs / nb END AS r FROM l)
SELECT p_partkey, {sr6('p')} AS rouge_p, {sr6('r')} AS rouge_r,
  {sr6('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS rouge_f FROM pr""")
def rouge_l_short(spark, sf):
    """ROUGE-L of each part's name against the next part's name and its own type."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    nxt = part.select((F.col("p_partkey") - 1).alias("_k"), F.col("p_name").alias("_n"))
    j = part.join(nxt, F.col("p_partkey") == F.col("_k"))
    p, r, f = rouge_l(F.col("p_name"), F.concat("_n", F.lit(" "), "p_type"))
    return j.select("p_partkey", r6(p).alias("rouge_p"), r6(r).alias("rouge_r"), r6(f).alias("rouge_f"))
