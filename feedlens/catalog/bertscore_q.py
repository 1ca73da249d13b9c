"""Queries: BERTScore beside ROUGE-L on the annotation pairs and the generated feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.agreement_q import _METHOD_ALL, _sql_gated, _sql_pearson, AB, pairs, reference_rows, SQL_PAIRS, SQL_REF, with_reference
from feedlens.catalog.registry import query, r6, sr6
from feedlens.functions.bertscore import bertscore, sql_bertscore_ctes
from feedlens.operators import agreement as ag
from feedlens.rubric import FLIPPED_LABELS as FL
from feedlens.sources.views import view

_SQL_REFJ = SQL_REF.split("rg_tok AS")[0].rstrip().rstrip(",")
_SQL_BERT = _SQL_REFJ + "," + sql_bertscore_ctes("refj WHERE ref_feedback IS NOT NULL", "row_id", "feedback", "ref_feedback")


def _value(c: str) -> str:  # a row with a reference, but without words on one side, scores 0
    return f"CASE WHEN j.ref_feedback IS NOT NULL AND j.feedback IS NOT NULL THEN coalesce(b.{c}, 0.0) END"


_PAIRS_BERT = (SQL_PAIRS + ",\n" + _SQL_BERT + f",\npr AS (SELECT p.*, {_value('bert_f')} AS bert_f FROM pairs p "
               "JOIN refj j ON j.row_id = p.row_id LEFT JOIN bert_f b ON p.row_id = b.rid)")


def paired_bertscore(spark, sf):
    """The paired annotations with the BERTScore of their feedback against their item's reference."""
    p = with_reference(pairs(spark, sf), spark, sf)
    return p.select("row_id", "method", *[f"{f}_b" for f in FL], bertscore(F.col("feedback"), F.col("ref_feedback"))[2].alias("bert_f"))


@query("bertscore_rows", ("v_annotated_a", "v_expanded"), "WITH " + _SQL_BERT + "\nSELECT j.row_id, j.method, "
       + ", ".join(f"{sr6(_value(c))} AS {c}" for c in ("bert_p", "bert_r", "bert_f")) + " FROM refj j LEFT JOIN bert_f b ON j.row_id = b.rid")
def bertscore_rows(spark, sf):
    p, r, f = bertscore(F.col("feedback"), F.col("ref_feedback"))
    return reference_rows(spark, sf).select("row_id", "method", r6(p).alias("bert_p"), r6(r).alias("bert_r"), r6(f).alias("bert_f"))


@query("bertscore_correlation", AB + ("v_expanded",), _PAIRS_BERT + f""",
s AS (SELECT method, {_sql_gated('b')} AS sb, bert_f FROM pr)
SELECT {_METHOD_ALL} AS method, {sr6('avg(bert_f)')} AS bertscore, {sr6(_sql_pearson('sb', 'bert_f'))} AS pearson_bertscore
FROM s GROUP BY GROUPING SETS ((method), ())""")
def bertscore_correlation(spark, sf):
    """Mean BERTScore and its correlation with the second annotator's score, by method and over all."""
    s = paired_bertscore(spark, sf).select("method", ag.gated_score(FL, "_b").alias("sb"), "bert_f")
    g = s.rollup("method").agg(F.avg("bert_f").alias("bertscore"), ag.pearson(F.col("sb"), F.col("bert_f")).alias("pearson"),
                               F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("method")).alias("method"),
                    r6("bertscore").alias("bertscore"), r6("pearson").alias("pearson_bertscore"))


@query("system_bertscore", AB + ("v_expanded",), _PAIRS_BERT + f""",
mm AS (SELECT method, avg({_sql_gated('b')}) AS score_b, avg(bert_f) AS bert FROM pr GROUP BY method)
SELECT 'bertscore' AS metric, {sr6(_sql_pearson('score_b', 'bert'))} AS pearson FROM mm""")
def system_bertscore(spark, sf):
    """System-level correlation: method means of the score against method means of BERTScore."""
    mm = paired_bertscore(spark, sf).groupBy("method").agg(F.avg(ag.gated_score(FL, "_b")).alias("score_b"), F.avg("bert_f").alias("bert"))
    return mm.agg(ag.pearson(F.col("score_b"), F.col("bert")).alias("p")).select(F.lit("bertscore").alias("metric"), r6("p").alias("pearson"))


@query("eval_reference_bertscore", ("v_generated",), "WITH " + sql_bertscore_ctes("v_generated", "row_id", "generated_feedback", "feedback")
       + f"\nSELECT g.method, {sr6('avg(coalesce(b.bert_f, 0.0))')} AS bertscore FROM v_generated g LEFT JOIN bert_f b ON g.row_id = b.rid "
       "WHERE g.generated_feedback IS NOT NULL AND g.feedback IS NOT NULL GROUP BY g.method")
def eval_reference_bertscore(spark, sf):
    g = view(spark, sf, "v_generated").filter("generated_feedback IS NOT NULL AND feedback IS NOT NULL")
    return g.groupBy("method").agg(r6(F.avg(bertscore(F.col("generated_feedback"), F.col("feedback"))[2])).alias("bertscore"))
