"""Queries: prompt texts, reply parsing, text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.build_q import SQL_EXPANDED_SPLITS, expanded_splits
from feedlens.catalog.registry import query
from feedlens.functions import prompts as pr
from feedlens.functions import text as tx
from feedlens.functions.plugins import WORD_IDS, token_ids
from feedlens.functions.parse import (parse_binary, parse_likert, sql_likert_scores, sql_parse_binary_ctes,
                                      sql_parse_likert)
from feedlens.plans.retrieval import retrieval_sample as retrieval_fields
from feedlens.rubric import BINARY_LABELS as LAB, LIKERT_LABELS as LIK
from feedlens.sources.views import view

EXP = ("v_expanded",)
ANN = ("v_annotated_a",)
EXP_COLS = ["row_id", "qid", "question", "correct_answer", "explanation", "distractor", "feedback"]


def _labels(struct_col: str, names):
    return [F.col(f"{struct_col}.labels")[i].alias(n) for i, n in enumerate(names)]


# ---- prompts ---------------------------------------------------------------------------------

@query("prompt_input", EXP, f"SELECT row_id, {pr.sql_prompt_input(False)} AS input, {pr.sql_prompt_input(True)} AS "
       f"input_sol, {pr.sql_prompt_output()} AS output FROM v_expanded")
def prompt_input(spark, sf):
    e = view(spark, sf, "v_expanded")
    return e.select("row_id", pr.prompt_input(False).alias("input"), pr.prompt_input(True).alias("input_sol"),
                    pr.prompt_output().alias("output"))


@query("prompt_zero_shot", EXP, f"SELECT row_id, {pr.sql_zero_shot(pr.sql_prompt_input(False))} AS prompt, "
       f"{pr.sql_zero_shot(pr.sql_prompt_input(True), True)} AS prompt_sol_rubric FROM v_expanded")
def prompt_zero_shot(spark, sf):
    e = view(spark, sf, "v_expanded")
    return e.select("row_id", pr.zero_shot(pr.prompt_input(False)).alias("prompt"),
                    pr.zero_shot(pr.prompt_input(True), True).alias("prompt_sol_rubric"))


@query("annotation_prompt_binary", ANN, f"SELECT row_id, {pr.sql_annotation_prompt(False)} AS prompt FROM v_annotated_a")
def annotation_prompt_binary(spark, sf):
    return view(spark, sf, "v_annotated_a").select("row_id", pr.annotation_prompt(False).alias("prompt"))


@query("annotation_prompt_likert", ANN, f"SELECT row_id, {pr.sql_annotation_prompt(True)} AS prompt FROM v_annotated_a")
def annotation_prompt_likert(spark, sf):
    return view(spark, sf, "v_annotated_a").select("row_id", pr.annotation_prompt(True).alias("prompt"))


@query("rm_input_text", ANN, f"SELECT row_id, {pr.sql_rm_input(False)} AS input, {pr.sql_rm_input(True)} AS input_enc, "
       f"{pr.sql_prompt_output()} AS decoder_input FROM v_annotated_a")
def rm_input_text(spark, sf):
    a = view(spark, sf, "v_annotated_a")
    return a.select("row_id", pr.rm_input().alias("input"), pr.rm_input(encoder_only=True).alias("input_enc"),
                    pr.rm_decoder_input().alias("decoder_input"))


@query("sft_table", EXP, f"SELECT *, {pr.sql_sft_prompt(False)} AS prompt, {tx.sql_strip(tx.sql_py_str('feedback'))} "
       "AS label FROM v_expanded")
def sft_table(spark, sf):
    e = view(spark, sf, "v_expanded")
    return e.select(*EXP_COLS, pr.sft_prompt(False).alias("prompt"), pr.completion().alias("label"))


_TO_JSON = "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in EXP_COLS) + "}) AS VARCHAR)"


@query("ppo_query_table", EXP, f"SELECT row_id, {pr.sql_sft_prompt(True)} AS query, {_TO_JSON} AS meta_data FROM v_expanded")
def ppo_query_table(spark, sf):
    e = view(spark, sf, "v_expanded")
    return e.select("row_id", pr.sft_prompt(True).alias("query"),
                    F.to_json(F.struct(*EXP_COLS)).alias("meta_data"))


@query("records_struct", EXP, f"SELECT row_id, {_TO_JSON} AS meta_data FROM v_expanded")
def records_struct(spark, sf):
    from feedlens.sources.files import records
    e = records(view(spark, sf, "v_expanded"), EXP_COLS)
    return e.select("row_id", F.to_json("meta_data").alias("meta_data"))


def _sql_retrieval():
    body = ["Problem: ", "\x00" + tx.sql_py_str("question"), "\nCorrect Answer: ", "\x00" + tx.sql_py_str("correct_answer"),
            "\nSolution: ", "\x00" + tx.sql_py_str("explanation"), "\nIncorrect Answer: ", "\x00" + tx.sql_py_str("distractor")]
    b = pr._sql_txt(body)
    return (f"SELECT row_id, {b} || 'Feedback:' AS lm_context, ' ' || {tx.sql_py_str('feedback')} AS lm_label, "
            f"{b} AS encoder_context, chr(10) || 'Feedback: ' || {tx.sql_py_str('feedback')} AS encoder_label FROM v_expanded")


@query("retrieval_sample", EXP, _sql_retrieval().replace("|| 'Feedback:' AS lm_context", "|| chr(10) || 'Feedback:' AS lm_context"))
def retrieval_sample(spark, sf):
    return retrieval_fields(view(spark, sf, "v_expanded")).drop("meta_data")


@query("chat_messages", (), """WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
u AS (SELECT conv_id * 100 + turn AS row_id, conv_id, turn, text FROM c WHERE role = 'user'),
h AS (SELECT u.row_id, u.conv_id, p.turn, p.role, p.text FROM u JOIN c p ON p.conv_id = u.conv_id AND p.turn < u.turn)
SELECT row_id, conv_id, 0 AS pos, 'system' AS role, '""" + pr.EXPERT_SYSTEM + """' AS content FROM u
UNION ALL SELECT row_id, conv_id, CAST(row_number() OVER (PARTITION BY conv_id, row_id ORDER BY turn) AS INTEGER), role, text FROM h
UNION ALL SELECT row_id, conv_id, CAST(1 + (SELECT count(*) FROM c p WHERE p.conv_id = u.conv_id AND p.turn < u.turn) AS INTEGER),
  'user', text FROM u""")
def chat_messages(spark, sf):
    """Messages of each user turn: system, all earlier turns of the conversation, the user prompt."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    u = turns.select("conv_id", "turns", F.explode("turns").alias("t")).filter("t.role = 'user'")
    hist = F.transform(F.filter("turns", lambda p: p["turn"] < F.col("t.turn")),
                       lambda p: F.struct(p["role"].alias("role"), p["content"].alias("content")))
    msgs = pr.chat_messages(F.col("t.content"), hist, F.lit(pr.EXPERT_SYSTEM))
    return u.select((F.col("conv_id") * 100 + F.col("t.turn")).alias("row_id"), "conv_id", F.posexplode(msgs)).select(
        "row_id", "conv_id", "pos", F.col("col.role").alias("role"), F.col("col.content").alias("content"))


# ---- reply parsing -----------------------------------------------------------------------------

@query("parse_binary", ("v_reply",), "WITH " + sql_parse_binary_ctes("v_reply").lstrip().rstrip() + "\nSELECT rid AS row_id, "
       + ", ".join(f"l{i} AS {n}" for i, n in enumerate(LAB)) + " FROM parsed")
def parse_binary_q(spark, sf):
    r = view(spark, sf, "v_reply").select("row_id", parse_binary("response").alias("p"))
    return r.select("row_id", *_labels("p", LAB))


_LIK_MISS, _LIK_OUT = sql_parse_likert()


@query("parse_likert", ("v_reply_likert",), f"SELECT row_id, " + ", ".join(f"{e} AS {n}" for e, n in zip(_LIK_OUT, LIK))
       + f" FROM (SELECT row_id, {sql_likert_scores()} AS sc FROM v_reply_likert)")
def parse_likert_q(spark, sf):
    r = view(spark, sf, "v_reply_likert").select("row_id", parse_likert("response").alias("p"))
    return r.select("row_id", *_labels("p", LIK))


_LIK_MISS_S, _ = sql_parse_likert(strict=True)


@query("annotation_missing", ("v_reply", "v_reply_likert"), "WITH " + sql_parse_binary_ctes("v_reply", strict=True).strip()
       + f"\nSELECT 'bin' AS rubric, count_if(n_missing > 0) AS n_missing_rows, count(*) AS n_rows FROM parsed "
       f"UNION ALL SELECT 'lik', count_if({_LIK_MISS_S} > 0), count(*) FROM (SELECT {sql_likert_scores()} AS sc FROM v_reply_likert)")
def annotation_missing(spark, sf):
    b = view(spark, sf, "v_reply").select(parse_binary("response", strict=True)["n_missing"].alias("m"))
    lk = view(spark, sf, "v_reply_likert").select(parse_likert("response", strict=True)["n_missing"].alias("m"))
    agg = [F.count_if(F.col("m") > 0).alias("n_missing_rows"), F.count(F.lit(1)).alias("n_rows")]
    return b.agg(*agg).select(F.lit("bin").alias("rubric"), "*").unionByName(
        lk.agg(*agg).select(F.lit("lik").alias("rubric"), "*"))


@query("drop_unparsed", ("v_reply",), "WITH " + sql_parse_binary_ctes("v_reply").strip() + "\nSELECT rid AS row_id, "
       + ", ".join(f"l{i} AS {n}" for i, n in enumerate(LAB)) + " FROM parsed WHERE "
       + " AND ".join(f"l{i} <> 0.5" for i in range(len(LAB))))
def drop_unparsed(spark, sf):
    r = view(spark, sf, "v_reply").select("row_id", parse_binary("response").alias("p"))
    r = r.filter(~F.exists("p.labels", lambda x: x == 0.5))
    return r.select("row_id", *_labels("p", LAB))


# ---- text helpers -------------------------------------------------------------------------------

@query("clean_whitespace", (), f"SELECT doc_id, regexp_replace({tx.sql_strip('text')}, '{tx.WS_CLASS}+', ' ', 'g') "
       "AS cleaned FROM documents")
def clean_whitespace(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", tx.clean_whitespace("text").alias("cleaned"))


# generation output: the turn's text, and for assistant turns a last line carrying the whole text again
_GEN_OUT = ("concat(text, CASE WHEN role = 'assistant' THEN concat(chr(10), 'Feedback:  ', replace(text, chr(10), ' '), "
            "CASE WHEN turn % 2 = 1 THEN chr(10) ELSE ' ' END) ELSE '' END)")
_FB_RE = "Feedback: ([^\\n]*)\\n?\\z"


@query("extract_feedback", (), f"SELECT conv_id, turn, CASE WHEN regexp_matches(o, '{_FB_RE}') THEN "
       f"{tx.sql_strip(f'regexp_extract(o, {chr(39)}{_FB_RE}{chr(39)}, 1)')} END AS feedback "
       f"FROM (SELECT conv_id, turn, {_GEN_OUT} AS o FROM conversations)")
def extract_feedback(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    o = c.select("conv_id", "turn", F.expr(_GEN_OUT).alias("o"))
    return o.select("conv_id", "turn", tx.extract_feedback("o").alias("feedback"))


@query("first_line", (), f"SELECT conv_id, turn, {tx.sql_strip('split_part(text, chr(10), 1)')} AS first_line, "
       "CASE WHEN strpos(text, chr(10) || chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10) || chr(10)) - 1) "
       "ELSE text END AS until_blank FROM conversations")
def first_line(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", tx.first_line("text").alias("first_line"),
                    tx.until_blank_line("text").alias("until_blank"))


@query("bool_flag", (), "SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) <> '0' AS flag FROM orders")
def bool_flag(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", tx.bool_flag((F.col("o_orderkey") % 3).cast("string")).alias("flag"))


_SQL_WC = (f"CASE WHEN {tx.sql_strip('feedback')} = '' THEN 0 ELSE "
           f"len(regexp_split_to_array({tx.sql_strip('feedback')}, '{tx.WS_CLASS}+')) END")


@query("max_tokens", ("v_mcq",), SQL_EXPANDED_SPLITS + f" SELECT split, max({_SQL_WC}) AS max_tokens FROM ex GROUP BY split")
def max_tokens(spark, sf):
    ex = expanded_splits(spark, sf)
    return ex.groupBy("split").agg(F.max(F.size(token_ids(WORD_IDS, tx.strip("feedback")))).cast("long").alias("max_tokens"))
