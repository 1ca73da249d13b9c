"""Queries: annotator pairing, flips, agreement, means, diff reports, ROUGE-L references."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.registry import query, r6, sr6
from feedlens.functions.rouge import rouge_l, sql_rouge_ctes
from feedlens.operators import agreement as ag
from feedlens.operators.dedup import first_per_key
from feedlens.operators.index import ordered_index
from feedlens.rubric import BINARY_LABELS as LAB, FLIPPED_LABELS as FL
from feedlens.sources.views import view

AB = ("v_annotated_b",)

# ---------------------------------------------------------------- shared SQL pieces

_ITEM = "row_id, qid, question, correct_answer, explanation, distractor, feedback, method"


def _sql_occ(src: str) -> str:
    return (f"SELECT {_ITEM}, {', '.join(LAB)}, row_number() OVER (PARTITION BY qid, distractor, feedback "
            f"ORDER BY md5(concat_ws(':', '221', 'occ', CAST(row_id AS VARCHAR))), row_id) AS occ "
            f"FROM {src} WHERE reveal IS NOT NULL")


def _sql_flip(side: str, alias: str) -> str:
    parts = []
    for l, f in zip(LAB, FL):
        expr = f"1 - {alias}.{l}" if l in ("incorrect", "reveal") else f"{alias}.{l}"
        parts.append(f"{expr} AS {f}_{side}")
    return ", ".join(parts)


SQL_PAIRS = f"""WITH pa AS ({_sql_occ('v_annotated_a')}),
pb AS ({_sql_occ('v_annotated_b')}),
pairs AS (SELECT pa.row_id, pb.row_id AS row_id_b, pa.qid, pa.question, pa.correct_answer, pa.explanation,
  pa.distractor, pa.feedback, pa.method, {_sql_flip('a', 'pa')}, {_sql_flip('b', 'pb')}
  FROM pa JOIN pb ON pa.qid IS NOT DISTINCT FROM pb.qid AND pa.distractor IS NOT DISTINCT FROM pb.distractor
   AND pa.feedback IS NOT DISTINCT FROM pb.feedback AND pa.occ = pb.occ),
long AS ({' UNION ALL '.join(f"SELECT row_id, method, '{f}' AS label, CAST({f}_a AS DOUBLE) AS a, CAST({f}_b AS DOUBLE) AS b FROM pairs" for f in FL)})"""


def _sql_gated(side: str) -> str:
    return f"(correct_{side} * ({' + '.join(f'{f}_{side}' for f in FL)}) / 5.0)"


def _sql_pearson(x: str, y: str) -> str:
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL "
            f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


_METHOD_ALL = "CASE WHEN GROUPING(method) = 1 THEN 'all' ELSE method END"

# reference text: first expanded row (lowest row_id) per (qid, distractor); left join keeps unmatched rows
SQL_REF = """ref AS (SELECT qid, distractor, min(row_id) AS ref_row_id FROM v_expanded GROUP BY qid, distractor),
refj AS (SELECT a.row_id, a.method, a.qid, a.distractor, a.feedback, r.ref_row_id, e.feedback AS ref_feedback
  FROM v_annotated_a a LEFT JOIN ref r ON a.qid IS NOT DISTINCT FROM r.qid AND a.distractor IS NOT DISTINCT FROM r.distractor
  LEFT JOIN v_expanded e ON e.row_id = r.ref_row_id),""" + sql_rouge_ctes("refj WHERE ref_feedback IS NOT NULL", "row_id", "feedback", "ref_feedback")


# ---------------------------------------------------------------- Spark pieces

def pairs(spark, sf):
    a = view(spark, sf, "v_annotated_a")
    b = view(spark, sf, "v_annotated_b")
    return ag.flip_pair(ag.pair_annotations(a, b, LAB))


def long(spark, sf):
    return ag.long_labels(pairs(spark, sf), FL)


def with_reference(rows, spark, sf):
    """``rows`` (qid, distractor, ...) with the reference feedback of their item; NULL if there is none.

    Which row is an item's reference is settled on ids; only that row's text is fetched."""
    x = view(spark, sf, "v_expanded")
    first = x.groupBy(F.col("qid").alias("_q"), F.col("distractor").alias("_d")).agg(F.min("row_id").alias("ref_row_id"))
    refs = first.join(x.select(F.col("row_id").alias("_r"), F.col("feedback").alias("ref_feedback")), F.col("ref_row_id") == F.col("_r"))
    cond = [F.col("qid").eqNullSafe(F.col("_q")), F.col("distractor").eqNullSafe(F.col("_d"))]
    return rows.join(refs, cond, "left").drop("_q", "_d", "_r")


def reference_rows(spark, sf):
    """Each annotated row with the reference feedback of its (qid, distractor); NULL if none."""
    return with_reference(view(spark, sf, "v_annotated_a"), spark, sf)


def _rouge(rows, *keep):
    p, r, f = rouge_l(F.col("feedback"), F.col("ref_feedback"))
    has = F.col("ref_feedback").isNotNull()
    return rows.select(*keep, F.when(has, p).alias("rouge_p"), F.when(has, r).alias("rouge_r"), F.when(has, f).alias("rouge_f"))


def rouge_rows(spark, sf):
    return _rouge(reference_rows(spark, sf), "row_id", "method")


def paired_rouge(spark, sf):
    """The paired annotations with ROUGE-L: the LCS runs on paired rows only."""
    p = pairs(spark, sf)
    return _rouge(with_reference(p, spark, sf), "row_id", "method", *[f"{f}_{s}" for f in FL for s in "ab"])


# ---------------------------------------------------------------- queries

@query("paired_annotations", AB, SQL_PAIRS + """
SELECT row_id, row_id_b, qid, distractor, method, """ + ", ".join(f"{f}_a, {f}_b" for f in FL) + " FROM pairs")
def paired_annotations(spark, sf):
    return pairs(spark, sf).select("row_id", "row_id_b", "qid", "distractor", "method",
                                   *[c for f in FL for c in (f"{f}_a", f"{f}_b")])


@query("flip_labels", ("v_annotated_a",), "SELECT row_id, method, 1 - incorrect AS correct, 1 - reveal AS reveal, "
       "suggestions, misconceptions, positive FROM v_annotated_a")
def flip_labels_q(spark, sf):
    return ag.flip_labels(view(spark, sf, "v_annotated_a")).select("row_id", "method", *FL)


@query("labelled_only", AB, f"SELECT row_id, method, {', '.join(LAB)} FROM v_annotated_b WHERE incorrect IS NOT NULL")
def labelled_only(spark, sf):
    return ag.labelled(view(spark, sf, "v_annotated_b"), "incorrect").select("row_id", "method", *LAB)


@query("external_labels", AB, "SELECT row_id, " + ", ".join(f"TRY_CAST(trunc({l}) AS INTEGER) AS {l}" for l in LAB)
       + " FROM v_annotated_b")
def external_labels(spark, sf):
    return ag.external_labels(view(spark, sf, "v_annotated_b"), LAB).select("row_id", *LAB)


_AGREE_SQL = SQL_PAIRS + f""",
g AS (SELECT {_METHOD_ALL} AS method, label, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po,
  {_sql_pearson('a', 'b')} AS pearson,
  count_if(a = 1 AND b = 1) AS tp, count_if(a = 1 AND b = 0) AS fp, count_if(a = 0 AND b = 1) AS fn
  FROM long GROUP BY GROUPING SETS ((label, method), (label))),
lm AS (SELECT label, method, a, b FROM long UNION ALL SELECT label, 'all', a, b FROM long),
ca AS (SELECT label, method, a AS v, count(*) AS n FROM lm GROUP BY ALL),
cb AS (SELECT label, method, b AS v, count(*) AS n FROM lm GROUP BY ALL),
ch AS (SELECT ca.label, ca.method, CAST(sum(ca.n * cb.n) AS DOUBLE) AS s FROM ca JOIN cb USING (label, method, v) GROUP BY ALL),
gp AS (SELECT g.*, coalesce(s, 0) / (CAST(n AS DOUBLE) * n) AS pe FROM g LEFT JOIN ch USING (label, method)),
m AS (SELECT method, label, n, CASE WHEN 1 - pe = 0 THEN NULL ELSE (po - pe) / (1 - pe) END AS kappa, pearson,
  po AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM gp),
mf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""


def agreement(spark, sf):
    return ag.agreement_metrics(long(spark, sf))


@query("agreement_by_method", AB, _AGREE_SQL + "\nSELECT method, label, n, " +
       ", ".join(f"{sr6(m)} AS {m}" for m in ag.METRICS) + " FROM mf")
def agreement_by_method(spark, sf):
    return agreement(spark, sf).select("method", "label", "n", *[r6(m).alias(m) for m in ag.METRICS])


@query("agreement_macro", AB, _AGREE_SQL + "\nSELECT method, " + ", ".join(f"{sr6(f'avg({m})')} AS {m}" for m in ag.METRICS)
       + ", count(pearson) AS n_labels FROM mf GROUP BY method")
def agreement_macro(spark, sf):
    m = ag.macro_over_labels(agreement(spark, sf))
    return m.select("method", *[r6(x).alias(x) for x in ag.METRICS], "n_labels")


def _both(df):
    """Long table (annotator, label, method, value) of both annotators' flipped labels."""
    entries = [F.struct(F.lit(s).alias("annotator"), F.lit(f).alias("label"), F.col(f"{f}_{s}").alias("value"))
               for s in ("a", "b") for f in FL]
    return df.select("method", F.inline(F.array(*entries)))


@query("label_means", AB, SQL_PAIRS + ",\nbothl AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS annotator, '{f}' AS label, method, {f}_{s} AS value FROM pairs" for s in "ab" for f in FL)
    + f")\nSELECT annotator, label, {_METHOD_ALL} AS method, {sr6('avg(value)')} AS mean "
      "FROM bothl GROUP BY GROUPING SETS ((annotator, label, method), (annotator, label))")
def label_means(spark, sf):
    g = ag.method_rollup(_both(pairs(spark, sf)), ["annotator", "label"], F.avg("value").alias("mean"))
    return g.select("annotator", "label", "method", r6("mean").alias("mean"))


@query("score_means", AB, SQL_PAIRS + ",\nsc AS (SELECT 'a' AS annotator, method, " + _sql_gated("a") +
       " AS score FROM pairs UNION ALL SELECT 'b', method, " + _sql_gated("b") + " FROM pairs)\n"
       f"SELECT annotator, {_METHOD_ALL} AS method, {sr6('avg(score)')} AS mean_score FROM sc "
       "GROUP BY GROUPING SETS ((annotator, method), (annotator))")
def score_means(spark, sf):
    p = pairs(spark, sf)
    sc = p.select("method", F.inline(F.array(*[
        F.struct(F.lit(s).alias("annotator"), ag.gated_score(FL, f"_{s}").alias("score")) for s in "ab"])))
    g = ag.method_rollup(sc, ["annotator"], F.avg("score").alias("mean_score"))
    return g.select("annotator", "method", r6("mean_score").alias("mean_score"))


_ALL_EQ = " AND ".join(f"{f}_a = {f}_b" for f in FL)


@query("perfect_agreement", AB, SQL_PAIRS + f"\nSELECT count_if({_ALL_EQ}) AS n_perfect, count(*) AS n_total FROM pairs")
def perfect_agreement(spark, sf):
    p = pairs(spark, sf)
    cond = None
    for f in FL:
        c = F.col(f"{f}_a") == F.col(f"{f}_b")
        cond = c if cond is None else cond & c
    return p.agg(F.count_if(cond).alias("n_perfect"), F.count(F.lit(1)).alias("n_total"))


@query("diff_counts", AB, SQL_PAIRS + "\nSELECT label, count_if(a <> b) AS n_diff FROM long GROUP BY label")
def diff_counts(spark, sf):
    return long(spark, sf).groupBy("label").agg(F.count_if(F.col("a") != F.col("b")).alias("n_diff"))


_NDIFF = " + ".join(f"CAST({f}_a <> {f}_b AS INTEGER)" for f in FL)


@query("only_diff_counts", AB, SQL_PAIRS + ",\nnd AS (SELECT row_id, " + _NDIFF + " AS n_diff FROM pairs)\n"
       "SELECT l.label, count_if(l.a <> l.b AND nd.n_diff = 1) AS n_only_diff FROM long l JOIN nd ON l.row_id = nd.row_id "
       "GROUP BY l.label")
def only_diff_counts(spark, sf):
    p = pairs(spark, sf)
    n_diff = sum((F.col(f"{f}_a") != F.col(f"{f}_b")).cast("int") for f in FL)
    lg = ag.long_labels(p.withColumn("n_diff", n_diff), FL, keep=("row_id", "method", "n_diff"))
    return lg.groupBy("label").agg(F.count_if((F.col("a") != F.col("b")) & (F.col("n_diff") == 1)).alias("n_only_diff"))


@query("both_true_false", AB, SQL_PAIRS + "\nSELECT label, count_if(a <> 0 AND b <> 0) AS n_both_true, "
       "count_if(a = 0 AND b = 0) AS n_both_false FROM long GROUP BY label")
def both_true_false(spark, sf):
    a, b = F.col("a"), F.col("b")
    return long(spark, sf).groupBy("label").agg(F.count_if((a != 0) & (b != 0)).alias("n_both_true"),
                                                F.count_if((a == 0) & (b == 0)).alias("n_both_false"))


@query("show_diffs", (*AB, "v_reply"), SQL_PAIRS + "\nSELECT l.row_id, l.label, l.a AS value_a, l.b AS value_b, p.question, "
       "p.distractor, p.feedback, p.method, p.correct_answer, r.response FROM long l JOIN pairs p ON l.row_id = p.row_id "
       "LEFT JOIN v_reply r ON r.row_id = l.row_id WHERE l.a <> l.b")
def show_diffs(spark, sf):
    p = pairs(spark, sf)
    lg = ag.long_labels(p, FL, keep=("row_id", "method", "question", "correct_answer", "distractor", "feedback"))
    replies = view(spark, sf, "v_reply").select(F.col("row_id").alias("_r"), "response")
    return lg.filter(F.col("a") != F.col("b")).join(replies, F.col("row_id") == F.col("_r"), "left").select(
        "row_id", "label", F.col("a").alias("value_a"), F.col("b").alias("value_b"),
        "question", "distractor", "feedback", "method", "correct_answer", "response")


@query("sorted_annotations", AB, SQL_PAIRS + "\nSELECT row_id, qid, distractor, row_number() OVER "
       "(ORDER BY qid ASC NULLS LAST, distractor ASC NULLS LAST, row_id) - 1 AS pos FROM pairs")
def sorted_annotations(spark, sf):
    p = pairs(spark, sf).select("row_id", "qid", "distractor")
    # ascending, NULLs last
    return ordered_index(p, ["qid", "distractor", "row_id"], index_col="pos")


@query("annotator_select", AB, "WITH t AS (SELECT 'a' AS annotator, 'bin' AS rubric, row_id, " + ", ".join(LAB)
       + " FROM v_annotated_a UNION ALL SELECT 'b', 'bin', row_id, " + ", ".join(LAB) + " FROM v_annotated_b)\n"
       "SELECT * FROM t WHERE annotator = 'b' AND rubric = 'bin' AND incorrect IS NOT NULL")
def annotator_select(spark, sf):
    a = view(spark, sf, "v_annotated_a").select(F.lit("a").alias("annotator"), F.lit("bin").alias("rubric"), "row_id", *LAB)
    b = view(spark, sf, "v_annotated_b").select(F.lit("b").alias("annotator"), F.lit("bin").alias("rubric"), "row_id", *LAB)
    t = a.unionByName(b)
    return ag.labelled(t.filter((F.col("annotator") == "b") & (F.col("rubric") == "bin")), "incorrect")


@query("gated_score", ("v_annotated_a",), "SELECT row_id, method, " + sr6(
    "(1 - incorrect) * ((1 - incorrect) + (1 - reveal) + suggestions + misconceptions + positive) / 5.0")
    + " AS score FROM v_annotated_a")
def gated_score(spark, sf):
    f = ag.flip_labels(view(spark, sf, "v_annotated_a"))
    return f.select("row_id", "method", r6(ag.gated_score(FL)).alias("score"))


@query("gated_score_raw", ("v_annotated_a",), "SELECT row_id, method, " + sr6(
    "(1 - incorrect) * (incorrect + (1 - reveal) + suggestions + misconceptions + positive)")
    + " AS score_raw FROM v_annotated_a")
def gated_score_raw(spark, sf):
    a = view(spark, sf, "v_annotated_a")
    f = a.withColumn("correct", 1 - F.col("incorrect")).withColumn("reveal", 1 - F.col("reveal"))
    return f.select("row_id", "method", r6(ag.gated_score_raw("correct", LAB)).alias("score_raw"))


@query("dedup_first", ("v_annotated_a",), "SELECT a.* FROM v_annotated_a a JOIN (SELECT qid, distractor, min(row_id) AS m "
       "FROM v_annotated_a GROUP BY qid, distractor) k ON a.row_id = k.m")
def dedup_first(spark, sf):
    return first_per_key(view(spark, sf, "v_annotated_a"), ["qid", "distractor"], "row_id")


@query("reference_join", ("v_annotated_a", "v_expanded"), "WITH " + SQL_REF.split("rg_tok AS")[0].rstrip().rstrip(",")
       + "\nSELECT row_id, method, qid, distractor, feedback, ref_row_id, ref_feedback FROM refj")
def reference_join(spark, sf):
    return reference_rows(spark, sf).select("row_id", "method", "qid", "distractor", "feedback", "ref_row_id",
                                            "ref_feedback")


@query("rouge_l", ("v_annotated_a", "v_expanded"), rouge=True, sql="WITH " + SQL_REF + f"""
SELECT j.row_id, j.method, {sr6('r.rouge_p')} AS rouge_p, {sr6('r.rouge_r')} AS rouge_r, {sr6('r.rouge_f')} AS rouge_f
FROM refj j LEFT JOIN rouge_f r ON j.row_id = r.rid""")
def rouge_l_q(spark, sf):
    r = rouge_rows(spark, sf)
    return r.select("row_id", "method", *[r6(c).alias(c) for c in ("rouge_p", "rouge_r", "rouge_f")])


_PAIRS_ROUGE = SQL_PAIRS + ",\n" + SQL_REF + ",\npr AS (SELECT p.*, r.rouge_f FROM pairs p LEFT JOIN rouge_f r ON p.row_id = r.rid)"


@query("rouge_means", AB + ("v_expanded",), rouge=True, sql=_PAIRS_ROUGE +
       f"\nSELECT {_METHOD_ALL} AS method, {sr6('avg(rouge_f)')} AS rouge_l FROM pr GROUP BY GROUPING SETS ((method), ())")
def rouge_means(spark, sf):
    p = paired_rouge(spark, sf)
    g = p.rollup("method").agg(F.avg("rouge_f").alias("rouge_l"), F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("method")).alias("method"),
                    r6("rouge_l").alias("rouge_l"))


@query("score_correlation", AB + ("v_expanded",), rouge=True, sql=_PAIRS_ROUGE + f""",
s AS (SELECT method, {_sql_gated('a')} AS sa, {_sql_gated('b')} AS sb, rouge_f FROM pr)
SELECT {_METHOD_ALL} AS method, {sr6(_sql_pearson('sa', 'sb'))} AS pearson_scores,
  {sr6(_sql_pearson('sb', 'rouge_f'))} AS pearson_rouge FROM s GROUP BY GROUPING SETS ((method), ())""")
def score_correlation(spark, sf):
    p = paired_rouge(spark, sf)
    s = p.select("method", ag.gated_score(FL, "_a").alias("sa"), ag.gated_score(FL, "_b").alias("sb"), "rouge_f")
    g = s.rollup("method").agg(ag.pearson(F.col("sa"), F.col("sb")).alias("pearson_scores"),
                               ag.pearson(F.col("sb"), F.col("rouge_f")).alias("pearson_rouge"),
                               F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("method")).alias("method"),
                    r6("pearson_scores").alias("pearson_scores"), r6("pearson_rouge").alias("pearson_rouge"))


@query("system_correlation", AB + ("v_expanded",), rouge=True, sql=_PAIRS_ROUGE + ",\nmm AS (SELECT method, " + ", ".join(
    f"avg({f}_a) AS {f}_a, avg({f}_b) AS {f}_b" for f in FL) + f", avg({_sql_gated('a')}) AS score_a, "
    f"avg({_sql_gated('b')}) AS score_b, avg(rouge_f) AS rouge FROM pr GROUP BY method)\n" + " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, {sr6(_sql_pearson(m + '_a', m + '_b'))} AS pearson FROM mm" for m in FL + ['score']]
    + [f"SELECT 'rouge' AS metric, {sr6(_sql_pearson('score_b', 'rouge'))} AS pearson FROM mm"]))
def system_correlation(spark, sf):
    p = paired_rouge(spark, sf)
    mm = p.groupBy("method").agg(*[F.avg(f"{f}_{s}").alias(f"{f}_{s}") for f in FL for s in "ab"],
                                 F.avg(ag.gated_score(FL, "_a")).alias("score_a"),
                                 F.avg(ag.gated_score(FL, "_b")).alias("score_b"),
                                 F.avg("rouge_f").alias("rouge"))
    aggs = [ag.pearson(F.col(f"{m}_a"), F.col(f"{m}_b")).alias(m) for m in FL + ["score"]]
    aggs.append(ag.pearson(F.col("score_b"), F.col("rouge")).alias("rouge"))
    wide = mm.agg(*aggs)
    names = FL + ["score", "rouge"]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), r6(n).alias("pearson")) for n in names])))
