"""Queries: model-output metrics, evaluation, similarity search, few-shot prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.build_q import SQL_EXPANDED_SPLITS, expanded_table
from feedlens.catalog.registry import query, r6, sr6
from feedlens.functions import prompts as pr
from feedlens.functions.bijection import sql_bijection
from feedlens.functions.parse import parse_binary, sql_parse_binary_ctes
from feedlens.functions.rouge import rouge_l, sql_rouge_ctes
from feedlens.operators import fewshot as fs
from feedlens.operators import metrics as mt
from feedlens.operators.agreement import gated_score, method_rollup
from feedlens.operators.similarity import block_topk, pruned_topk
from feedlens.operators.vector_index import VectorIndex
from feedlens.rubric import BINARY_LABELS as LAB, FLIPPED_LABELS as FL
from feedlens.sources.views import view

LOG = ("v_logits",)
P_NAMES = [f"p_{l}" for l in FL]
R_NAMES = [f"r_{l}" for l in FL]

# ---------------------------------------------------------------- SQL pieces

SQL_ENS = ("ens AS (SELECT row_id, max(method) AS method, max(truth) AS truth, ["
           + ", ".join(f"avg(logits[{i + 1}])" for i in range(5)) + "] AS logits FROM v_logits GROUP BY row_id)")


def _sql_prob(i: int) -> str:
    p = f"(1.0 / (1.0 + exp(-logits[{i + 1}])))"
    return f"(1.0 - {p})" if i in (0, 1) else p


SQL_PROBS = "pr AS (SELECT row_id, method, " + ", ".join(f"{_sql_prob(i)} AS {n}" for i, n in enumerate(P_NAMES)) + " FROM ens)"


def _sql_pearson(x, y):
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL "
            f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


def _ens(spark, sf):
    return mt.ensemble(view(spark, sf, "v_logits"))


# ---------------------------------------------------------------- model outputs

@query("ensemble_scores", LOG, f"WITH {SQL_ENS}, {SQL_PROBS} SELECT row_id, method, "
       + ", ".join(f"{sr6(n)} AS {n}" for n in P_NAMES)
       + f", {sr6(P_NAMES[0] + ' * (' + ' + '.join(P_NAMES) + ') / 5.0')} AS score FROM pr")
def ensemble_scores(spark, sf):
    e = _ens(spark, sf).withColumn("p", mt.probabilities(F.col("logits")))
    return e.select("row_id", "method", *[r6(F.col("p")[i]).alias(n) for i, n in enumerate(P_NAMES)],
                    r6(mt.gated(F.col("p"))).alias("score"))


@query("round_scores", LOG, f"WITH {SQL_ENS}, {SQL_PROBS}, rr AS (SELECT row_id, method, "
       + ", ".join(f"round_even({p}, 0) AS {r}" for p, r in zip(P_NAMES, R_NAMES)) + " FROM pr) SELECT row_id, method, "
       + ", ".join(R_NAMES) + f", {sr6(R_NAMES[0] + ' * (' + ' + '.join(R_NAMES) + ') / 5.0')} AS score FROM rr")
def round_scores(spark, sf):
    e = _ens(spark, sf).withColumn("r", F.transform(mt.probabilities(F.col("logits")), lambda p: F.bround(p, 0)))
    return e.select("row_id", "method", *[F.col("r")[i].alias(n) for i, n in enumerate(R_NAMES)],
                    r6(mt.gated(F.col("r"))).alias("score"))


_BCE = " + ".join(f"(greatest(logits[{i}], 0) - logits[{i}] * truth[{i}] + ln(1 + exp(-abs(logits[{i}]))))"
                  for i in range(1, 6))


@query("bce_loss", LOG, f"WITH {SQL_ENS} SELECT CASE WHEN GROUPING(method) = 1 THEN 'all' ELSE method END AS method, "
       f"{sr6(f'avg(({_BCE}) / 5.0)')} AS loss FROM ens GROUP BY GROUPING SETS ((method), ())")
def bce_loss(spark, sf):
    e = _ens(spark, sf)
    per_row = F.aggregate(F.zip_with("logits", "truth", lambda x, y: mt.bce_terms(x, y)), F.lit(0.0),
                          lambda a, v: a + v) / F.lit(5.0)
    g = e.select("method", per_row.alias("l")).rollup("method").agg(F.avg("l").alias("loss"),
                                                                     F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("method")).alias("method"), r6("loss").alias("loss"))


_FL = ("fl AS (SELECT row_id, method, [-logits[1], logits[2], logits[3], logits[4], logits[5]] AS x, "
       "[1 - truth[1], truth[2], truth[3], truth[4], truth[5]] AS y FROM ens WHERE NOT list_contains(truth, 0.5))")
_LG = "lg AS (" + " UNION ALL ".join(
    f"SELECT row_id, {g} AS grp, {i} AS label, x[{i + 1}] AS x, y[{i + 1}] AS y, "
    f"CASE WHEN x[{i + 1}] >= 0 THEN 1.0 ELSE 0.0 END AS h FROM fl" for g in ("method", "'all'") for i in range(5)) + ")"
_AUC = """hist AS (SELECT grp, label, x, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM lg GROUP BY grp, label, x),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp, label ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
auc AS (SELECT grp, label, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
  FROM cum GROUP BY grp, label)"""
_NAME = "CASE label " + " ".join(f"WHEN {i} THEN '{l}'" for i, l in enumerate(LAB)) + " END"
_HSUM = " + ".join(f"CASE WHEN x[{i}] >= 0 THEN 1.0 ELSE 0.0 END" for i in range(1, 6))
_REPORT = f"""WITH {SQL_ENS}, {_FL}, {_LG}, {_AUC},
pl AS (SELECT grp, label, avg(CAST(h = y AS DOUBLE)) AS accuracy, {_sql_pearson('h', 'y')} AS pearson FROM lg GROUP BY grp, label),
rs AS (SELECT g.grp, (CASE WHEN x[1] >= 0 THEN 1.0 ELSE 0.0 END) * ({_HSUM}) / 5.0 AS sh,
  y[1] * (y[1] + y[2] + y[3] + y[4] + y[5]) / 5.0 AS st
  FROM fl JOIN (SELECT DISTINCT method AS m, method AS grp FROM fl UNION ALL SELECT DISTINCT method, 'all' FROM fl) g ON g.m = fl.method),
rep AS (
  SELECT grp, 'accuracy_' || {_NAME} AS metric, accuracy AS value FROM pl
  UNION ALL SELECT grp, 'pearson_' || {_NAME}, pearson FROM pl
  UNION ALL SELECT grp, 'auc_' || {_NAME}, auc FROM auc
  UNION ALL SELECT grp, 'accuracy_all', avg(CAST(h = y AS DOUBLE)) FROM lg GROUP BY grp
  UNION ALL SELECT grp, 'auc_all', CASE WHEN count(auc) = 5 THEN avg(auc) END FROM auc GROUP BY grp
  UNION ALL SELECT grp, 'pearson_score', {_sql_pearson('sh', 'st')} FROM rs GROUP BY grp)"""


@query("classifier_report", LOG, _REPORT + f" SELECT grp AS method, metric, {sr6('value')} AS value FROM rep")
def classifier_report(spark, sf):
    # the ensemble table feeds five branches of the report: write it once, scan it five times
    from feedlens.sources.files import materialize
    rep = mt.classifier_report(materialize(_ens(spark, sf), "ensemble"), LAB)
    return rep.select("method", "metric", r6("value").alias("value"))


_ROC_SQL = ("lr AS (" + " UNION ALL ".join(
    f"SELECT model AS grp, {i} AS label, logits[{i + 1}] AS x, truth[{i + 1}] AS y FROM v_logits" for i in range(5))
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'ens', {i}, logits[{i + 1}], truth[{i + 1}] FROM ens" for i in range(5)) + ")")


@query("roc_auc", LOG, f"WITH {SQL_ENS}, {_ROC_SQL}, " + _AUC.replace("FROM lg", "FROM lr")
       + f" SELECT grp AS model, {_NAME} AS label, {sr6('auc')} AS auc FROM auc")
def roc_auc_q(spark, sf):
    lg = view(spark, sf, "v_logits").select(F.col("model").alias("grp"), "logits", "truth").unionByName(
        _ens(spark, sf).select(F.lit("ens").alias("grp"), "logits", "truth"))
    long = lg.select("grp", F.inline(F.transform("logits", lambda x, i: F.named_struct(
        F.lit("label"), i, F.lit("x"), x, F.lit("y"), F.col("truth")[i]))))
    a = mt.roc_auc(long)
    name = F.element_at(F.array(*[F.lit(l) for l in LAB]), F.col("label") + 1)
    return a.select(F.col("grp").alias("model"), name.alias("label"), r6("auc").alias("auc"))


@query("best_epoch", ("v_reward",), f"SELECT epoch, {sr6('avg(reward)')} AS mean_reward FROM v_reward GROUP BY epoch "
       "ORDER BY avg(reward) DESC, epoch LIMIT 1")
def best_epoch(spark, sf):
    g = view(spark, sf, "v_reward").groupBy("epoch").agg(F.avg("reward").alias("m"))
    return g.orderBy(F.col("m").desc(), F.col("epoch")).limit(1).select("epoch", r6("m").alias("mean_reward"))


# ---------------------------------------------------------------- evaluation

_EVAL_SQL = ("WITH " + sql_parse_binary_ctes("v_reply").strip() + ",\nfl AS (SELECT 1 - l0 AS correct, 1 - l1 AS reveal, "
             "l2 AS suggestions, l3 AS misconceptions, l4 AS positive FROM parsed)\n" + " UNION ALL ".join(
                 f"SELECT '{f}' AS metric, {sr6(f'avg({f})')} AS mean FROM fl" for f in FL)
             + f" UNION ALL SELECT 'score', {sr6('avg(correct * (' + ' + '.join(FL) + ') / 5.0)')} FROM fl")


@query("eval_means", ("v_reply",), _EVAL_SQL)
def eval_means(spark, sf):
    p = view(spark, sf, "v_reply").select(parse_binary("response").alias("p"))
    lab = p.select(*[F.col("p.labels")[i].alias(l) for i, l in enumerate(LAB)])
    from feedlens.operators.agreement import flip_labels
    fl = flip_labels(lab)
    aggs = [F.avg(f).alias(f) for f in FL] + [F.avg(gated_score(FL)).alias("score")]
    wide = fl.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), r6(n).alias("mean"))
                                         for n in FL + ["score"]])))


@query("eval_reference", ("v_generated",), rouge=True, sql="WITH " + sql_rouge_ctes("v_generated", "row_id", "generated_feedback", "feedback")
       + f"\nSELECT g.method, {sr6('avg(r.rouge_f)')} AS rouge_l FROM v_generated g JOIN rouge_f r ON g.row_id = r.rid "
       "GROUP BY g.method")
def eval_reference(spark, sf):
    g = view(spark, sf, "v_generated")
    _, _, f = rouge_l(F.col("generated_feedback"), F.col("feedback"))
    return g.groupBy("method").agg(r6(F.avg(f)).alias("rouge_l"))


# ---------------------------------------------------------------- similarity

def _sql_unit(src: str, id_expr: str, vec: str, extra: str = "") -> str:
    return (f"SELECT {id_expr} AS id{extra}, CASE WHEN nrm = 0 THEN list_transform(v, lambda x: 0.0) "
            f"ELSE list_transform(v, lambda x: x / nrm) END AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS nrm "
            f"FROM (SELECT *, CAST({vec} AS DOUBLE[]) AS v FROM {src}))")


def _sql_knn(targets: str, pool: str, k: int, exclude_self: bool) -> str:
    cond = "WHERE t.id <> p.id" if exclude_self else ""
    return (f"tu AS ({_sql_unit(targets, 'vec_id', 'embedding')}), pu AS ({_sql_unit(pool, 'vec_id', 'embedding')}),\n"
            f"sims AS (SELECT t.id AS target_id, p.id AS pool_id, round(list_dot_product(t.u, p.u), 6) AS sim "
            f"FROM tu t JOIN pu p ON TRUE {cond}),\n"
            "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY sim DESC, pool_id) AS rank "
            f"FROM sims) WHERE rank <= {k})")


K = 2


def _emb(spark, sf, cond=None):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e if cond is None else e.filter(cond)


@query("knn_topk", (), "WITH " + _sql_knn("(SELECT * FROM embeddings WHERE label >= 8)",
                                         "(SELECT * FROM embeddings WHERE label < 8)", K, False)
       + " SELECT target_id, pool_id, CAST(rank AS INTEGER) AS rank, sim FROM knn")
def knn_topk(spark, sf):
    t = _emb(spark, sf, F.col("label") >= 8).select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec"))
    p = _emb(spark, sf, F.col("label") < 8).select(F.col("vec_id").alias("pool_id"), F.col("embedding").alias("vec"))
    return block_topk(t, p, left_id="target_id", right_id="pool_id", k=K).select("target_id", "pool_id", "rank", "sim")


@query("knn_self", (), "WITH " + _sql_knn("embeddings", "embeddings", K, True)
       + " SELECT target_id, pool_id, CAST(rank AS INTEGER) AS rank, sim FROM knn")
def knn_self(spark, sf):
    e = _emb(spark, sf)
    t = e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec"))
    p = e.select(F.col("vec_id").alias("pool_id"), F.col("embedding").alias("vec"))
    return block_topk(t, p, left_id="target_id", right_id="pool_id", k=K, exclude_self=True).select(
        "target_id", "pool_id", "rank", "sim")


@query("knn_pruned", (), "WITH " + _sql_knn("embeddings", "embeddings", K, True)
       + " SELECT target_id, pool_id, CAST(rank AS INTEGER) AS rank, sim FROM knn")
def knn_pruned(spark, sf):
    """``knn_self`` over blocks cut by pivot and angle, without the pairs of blocks that hold no neighbour."""
    e = _emb(spark, sf)
    t = e.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vec"))
    p = e.select(F.col("vec_id").alias("pool_id"), F.col("embedding").alias("vec"))
    return pruned_topk(t, p, left_id="target_id", right_id="pool_id", k=K, exclude_self=True, block_rows=1024).select(
        "target_id", "pool_id", "rank", "sim")


@query("knn_indexed")
def knn_indexed(spark, sf):
    """The neighbours of ``knn_self`` through an inverted-list index of all vectors, with the fewest
    probes whose recall on a sample of queries is 0.95."""
    e = _emb(spark, sf).select("vec_id", F.col("embedding").alias("vec"))
    index = VectorIndex.build(e, "vec_id")
    targets = e.withColumnRenamed("vec_id", "target_id")
    probes = index.tuned_probes(targets, "target_id", k=K, exclude_self=True)
    return index.search(targets, "target_id", k=K, probes=probes, exclude_self=True).select(
        "target_id", F.col("id").alias("pool_id"), "rank", "sim")


# means of six-digit similarities in whole millionths: no rounding tie can depend on the order of a sum
_SQL_MEAN = "CAST((2 * sum(CAST(round(m * 1000000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000"
_SQL_TOKENS = ("tp AS (" + _sql_unit("v_token_vectors WHERE side = 'pred'", "pos", "vec", ", pair_id") + "),\n"
               "tr AS (" + _sql_unit("v_token_vectors WHERE side = 'ref'", "pos", "vec", ", pair_id") + "),\n"
               "ts AS (SELECT a.pair_id, a.id AS pid, b.id AS rid, round(list_dot_product(a.u, b.u), 6) AS sim "
               "FROM tp a JOIN tr b ON a.pair_id = b.pair_id),\n"
               f"bp AS (SELECT pair_id, {_SQL_MEAN} AS p FROM (SELECT pair_id, pid, max(sim) AS m FROM ts GROUP BY pair_id, pid) "
               "GROUP BY pair_id),\n"
               f"br AS (SELECT pair_id, {_SQL_MEAN} AS r FROM (SELECT pair_id, rid, max(sim) AS m FROM ts GROUP BY pair_id, rid) "
               "GROUP BY pair_id),\n"
               "bs AS (SELECT bp.pair_id, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 "
               "FROM bp JOIN br ON bp.pair_id = br.pair_id)")


def bertscore(spark, sf):
    """Greedy max-cosine matching of token vectors inside each text pair, both directions."""
    tv = view(spark, sf, "v_token_vectors")
    pred = tv.filter(F.col("side") == "pred").select("pair_id", F.col("pos").alias("pid"), "vec")
    ref = tv.filter(F.col("side") == "ref").select("pair_id", F.col("pos").alias("rid"), "vec")
    p = block_topk(pred, ref, left_id="pid", right_id="rid", group_cols=["pair_id"], k=1)
    r = block_topk(ref, pred, left_id="rid", right_id="pid", group_cols=["pair_id"], k=1)
    mean = F.expr("(2 * sum(cast(round(sim * 1000000) as bigint)) + count(*)) div (2 * count(*))").cast("double") / 1000000
    bp = p.groupBy("pair_id").agg(mean.alias("p"))
    br = r.groupBy("pair_id").agg(mean.alias("r"))
    out = bp.join(br, "pair_id")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")),
                                           F.lit(0.0)))


@query("bertscore_from_vectors", ("v_token_vectors",), f"WITH {_SQL_TOKENS} SELECT pair_id, {sr6('p')} AS precision, "
       f"{sr6('r')} AS recall, {sr6('f1')} AS f1 FROM bs")
def bertscore_from_vectors(spark, sf):
    b = bertscore(spark, sf)
    return b.select("pair_id", r6("p").alias("precision"), r6("r").alias("recall"), r6("f1").alias("f1"))


_PAIR_METHOD = "CASE pair_id % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'random' WHEN 2 THEN 'knn' ELSE 'zs' END"


@query("bertscore_means", ("v_token_vectors",), f"WITH {_SQL_TOKENS} SELECT CASE WHEN GROUPING(method) = 1 THEN 'all' "
       f"ELSE method END AS method, {sr6('avg(f1)')} AS bertscore FROM (SELECT {_PAIR_METHOD} AS method, f1 FROM bs) "
       "GROUP BY GROUPING SETS ((method), ())")
def bertscore_means(spark, sf):
    b = bertscore(spark, sf).withColumn("method", F.expr(_PAIR_METHOD))
    g = method_rollup(b.withColumn("_k", F.lit(1)), ["_k"], F.avg("f1").alias("bertscore"))
    return g.select("method", r6("bertscore").alias("bertscore"))


# ---------------------------------------------------------------- few-shot prompts

def _sql_example(prefix: str = "") -> str:
    return f"{pr.sql_prompt_input(False, prefix)} || chr(10) || {pr.sql_prompt_output(prefix)} || chr(10) || chr(10)"


_OWN = "CAST(('0x' || substr(md5(concat_ws(':', '221', 'draw', CAST(row_id AS VARCHAR))), 1, 15)) AS BIGINT)"
_FEWSHOT_RANDOM = SQL_EXPANDED_SPLITS + f""",
pool AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pool_pos FROM ex WHERE split = 'train'),
t AS (SELECT ex.row_id, ex.split, ex.question, ex.correct_answer, ex.distractor, p.pool_pos AS self_pos,
  (SELECT count(*) FROM pool) - CASE WHEN p.pool_pos IS NULL THEN 0 ELSE 1 END AS m, {_OWN.replace('row_id', 'ex.row_id')} AS own
  FROM ex LEFT JOIN pool p ON p.row_id = ex.row_id),
d AS (SELECT *, {sql_bijection('rank', 'm', salt='draw', tweak='own')} AS drawn FROM (SELECT *, unnest(range({K})) AS rank FROM t) WHERE rank < m),
picks AS (SELECT row_id, rank, drawn + CASE WHEN drawn >= self_pos THEN 1 ELSE 0 END AS pp FROM d),
exs AS (SELECT k.row_id, k.rank, {_sql_example('p.')} AS text FROM picks k JOIN pool p ON p.pool_pos = k.pp),
body AS (SELECT row_id, string_agg(text, '' ORDER BY rank) AS b FROM exs GROUP BY row_id)
SELECT t.row_id, {pr.sql_lit(pr.instruction(False) + chr(10) + chr(10))} || coalesce(body.b, '') || {pr.sql_prompt_input(False, 't.')}
  || chr(10) || 'Feedback:' AS prompt FROM t LEFT JOIN body ON body.row_id = t.row_id"""


@query("fewshot_random", ("v_mcq",), _FEWSHOT_RANDOM)
def fewshot_random(spark, sf):
    ex = expanded_table(spark, sf)
    train = F.col("split") == "train"
    pool = fs.numbered_pool(ex.filter(train))
    targets = pool.select("row_id", F.col("pool_pos").alias("_self")).unionByName(
        ex.filter(~train).select("row_id", F.lit(None).cast("long").alias("_self")))
    picks = fs.draw(targets, K, pool.select(F.max("pool_n")).scalar())
    chosen = picks.join(pool.select("pool_pos", F.col("row_id").alias("ex_id")), "pool_pos")  # slim rows
    texts = ex.filter(train).select(F.col("row_id").alias("ex_id"), fs.example_texts(ex).alias("text"))
    return fs.assemble(ex, chosen.join(texts, "ex_id").select("row_id", "rank", "text"))


_KNN_BASE = "(SELECT e.vec_id, e.embedding FROM embeddings e JOIN v_expanded x ON x.row_id = e.vec_id)"
_FEWSHOT_KNN = ("WITH " + _sql_knn(_KNN_BASE, _KNN_BASE, K, True) + f""",
exs AS (SELECT k.target_id AS row_id, k.rank, {_sql_example('p.')} AS text FROM knn k JOIN v_expanded p ON p.row_id = k.pool_id),
body AS (SELECT row_id, string_agg(text, '' ORDER BY rank DESC) AS b FROM exs GROUP BY row_id)
SELECT t.row_id, {pr.sql_lit(pr.instruction(False) + chr(10) + chr(10))} || coalesce(body.b, '') || {pr.sql_prompt_input(False, 't.')}
  || chr(10) || 'Feedback:' AS prompt
FROM v_expanded t LEFT JOIN body ON body.row_id = t.row_id""")


@query("fewshot_knn", ("v_expanded",), _FEWSHOT_KNN)
def fewshot_knn(spark, sf):
    """Nearest-neighbour examples (self excluded), most similar last; a row without a vector has a
    prompt without examples."""
    x = view(spark, sf, "v_expanded")
    e = _emb(spark, sf).select("vec_id", F.col("embedding").alias("vec"))
    rows = x.join(e, x.row_id == e.vec_id).drop("vec_id")
    t = rows.select(F.col("row_id").alias("target_id"), "vec")
    p = rows.select(F.col("row_id").alias("pool_id"), "vec")
    knn = block_topk(t, p, left_id="target_id", right_id="pool_id", k=K, exclude_self=True)
    texts = x.select(F.col("row_id").alias("pool_id"), fs.example_texts(x).alias("text"))
    examples = knn.join(texts, "pool_id").select(F.col("target_id").alias("row_id"), "rank", "text")
    return fs.assemble(x, examples, descending=True)
