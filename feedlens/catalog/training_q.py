"""Queries: reward-model negatives and table, preference pairs and table."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.catalog.registry import query
from feedlens.functions import prompts as pr
from feedlens.functions import text as tx
from feedlens.functions.bijection import sql_bijection
from feedlens.functions.plugins import ECHO, WORD_IDS, hashed_scorer, score_rows, write_rows
from feedlens.operators import batches as bt
from feedlens.operators import index as ix
from feedlens.operators.metrics import ensemble
from feedlens.plans import training as tr
from feedlens.rubric import BINARY_LABELS as LAB
from feedlens.sources.views import packed_annotated, view

SRC = ("v_expanded",)
BOTH = ("v_annotated_a", "v_expanded")
_ITEM = "row_id, qid, question, correct_answer, explanation, distractor"
_NEG = ("CAST(1.0 AS DOUBLE) AS incorrect, CAST(0.0 AS DOUBLE) AS reveal, CAST(0.0 AS DOUBLE) AS suggestions, "
        "CAST(0.0 AS DOUBLE) AS misconceptions, CAST(0.0 AS DOUBLE) AS positive")

SQL_INNER = """h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws(':', '221', 'inner',
  CAST(row_id AS VARCHAR))), row_id) - 1 AS pos, count(*) OVER (PARTITION BY qid) AS n FROM v_expanded),
o AS (SELECT h.*, 1 AS shift FROM h WHERE n > 1 UNION ALL SELECT h.*, 2 AS shift FROM h WHERE n > 2),
inn AS (SELECT o.*, p.feedback AS alt_feedback FROM o JOIN h p ON p.qid = o.qid AND p.pos = (o.pos + o.shift) % o.n)"""

SQL_OUTER = f"""b AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS cnt FROM v_expanded),
outr AS (SELECT b.* EXCLUDE (i, cnt), p.feedback AS alt_feedback, 0 AS round
  FROM (SELECT *, {sql_bijection('i', 'cnt', salt='outer:0')} AS goes FROM b) b JOIN b p ON p.i = b.goes)"""


def _src(spark, sf):
    return view(spark, sf, "v_expanded")


def _data(spark, sf):
    return view(spark, sf, "v_annotated_a")


@query("rm_mismatch_inner", SRC, f"WITH {SQL_INNER} SELECT row_id, shift, alt_feedback AS feedback, "
       f"'mismatch_inner' AS method, {_NEG} FROM inn")
def rm_mismatch_inner(spark, sf):
    return tr.rm_inner(_src(spark, sf)).select("row_id", "shift", "feedback", "method", *LAB)


@query("rm_mismatch_outer", SRC, f"WITH {SQL_OUTER} SELECT row_id, round, alt_feedback AS feedback, "
       f"'mismatch_outer' AS method, {_NEG} FROM outr")
def rm_mismatch_outer(spark, sf):
    return tr.rm_outer(_src(spark, sf)).select("row_id", "round", "feedback", "method", *LAB)


_RM_ROWS = (f"rows AS (SELECT {_ITEM}, feedback, method, {', '.join(LAB)} FROM v_annotated_a WHERE incorrect IS NOT NULL "
            f"UNION ALL SELECT {_ITEM}, alt_feedback, 'mismatch_outer', {_NEG} FROM outr "
            f"UNION ALL SELECT {_ITEM}, alt_feedback, 'mismatch_inner', {_NEG} FROM inn)")


@query("rm_training_table", BOTH, f"WITH {SQL_OUTER}, {SQL_INNER}, {_RM_ROWS} SELECT row_id, method, "
       f"{pr.sql_rm_input()} AS input, [{', '.join(f'CAST({l} AS DOUBLE)' for l in LAB)}] AS label FROM rows")
def rm_training_table(spark, sf):
    t = tr.rm_training_table(_data(spark, sf), _src(spark, sf))
    return t.select("row_id", "method", "input", "label")


def _sql_pref(rej: str) -> str:
    return (f"{pr.sql_sft_prompt(False)} AS prompt, {tx.sql_strip(tx.sql_py_str('feedback'))} AS chosen, "
            f"{tx.sql_strip(tx.sql_py_str(rej))} AS rejected")


@query("pref_mismatch_outer", SRC, f"WITH {SQL_OUTER} SELECT row_id, {_sql_pref('alt_feedback')} FROM outr")
def pref_mismatch_outer(spark, sf):
    return tr.pref_outer(_src(spark, sf)).select("row_id", "prompt", "chosen", "rejected")


@query("pref_mismatch_inner", SRC, f"WITH {SQL_INNER} SELECT row_id, {_sql_pref('alt_feedback')} FROM inn "
       "WHERE coalesce(feedback <> alt_feedback, TRUE)")
def pref_mismatch_inner(spark, sf):
    return tr.pref_inner(_src(spark, sf)).select("row_id", "prompt", "chosen", "rejected")


_SCORE = ("(1 - incorrect) * ((1 - incorrect) + (1 - reveal) + suggestions + misconceptions + positive) / 5.0")
SQL_SCORE_PAIRS = f"""sc AS (SELECT {_ITEM}, feedback, {_SCORE} AS score FROM v_annotated_a),
sp AS (SELECT a.*, b.row_id AS row_id_b, b.feedback AS b_feedback, b.score AS b_score FROM sc a JOIN sc b
  ON a.question = b.question AND a.distractor = b.distractor AND a.row_id < b.row_id AND a.score <> b.score),
spp AS (SELECT row_id, row_id_b, {pr.sql_sft_prompt(False)} AS prompt,
  CASE WHEN score > b_score THEN {tx.sql_strip(tx.sql_py_str('feedback'))} ELSE {tx.sql_strip(tx.sql_py_str('b_feedback'))} END AS chosen,
  CASE WHEN score > b_score THEN {tx.sql_strip(tx.sql_py_str('b_feedback'))} ELSE {tx.sql_strip(tx.sql_py_str('feedback'))} END AS rejected
  FROM sp)"""


@query("pref_score_pairs", ("v_annotated_a",), f"WITH {SQL_SCORE_PAIRS} SELECT * FROM spp")
def pref_score_pairs(spark, sf):
    return tr.pref_scores(_data(spark, sf)).select("row_id", "row_id_b", "prompt", "chosen", "rejected")


@query("preference_table", BOTH, f"WITH {SQL_OUTER}, {SQL_INNER}, {SQL_SCORE_PAIRS}\n"
       f"SELECT 'mismatch_outer' AS source, row_id, {_sql_pref('alt_feedback')} FROM outr UNION ALL "
       f"SELECT 'mismatch_inner', row_id, {_sql_pref('alt_feedback')} FROM inn WHERE coalesce(feedback <> alt_feedback, TRUE) "
       "UNION ALL SELECT 'score', row_id, prompt, chosen, rejected FROM spp")
def preference_table(spark, sf):
    # the view joins labels to whole texts: once, for all branches, which read packed texts with
    # their numbers in key order; v_expanded is its item columns
    numbers = ("row_at", "row_count")
    data = ix.key_positions(packed_annotated(spark, sf), "row_id", index_col=numbers[0], total_col=numbers[1])
    return tr.preference_table(data, data.select(*_src(spark, sf).columns, *numbers), packed=True, numbers=numbers)


# ---- tokenised supervised rows with the loss mask ---------------------------------------------

_PAD, _EOS, _IGNORE, _BATCH = WORD_IDS.pad_id, WORD_IDS.eos_id, bt.IGNORE, 8


def _sql_word_ids(e: str) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array({tx.sql_strip(e)}, '{tx.WS_CLASS}+'), lambda w: w <> ''), "
            "lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) + 3)")


def _sql_padded(order: str) -> str:
    return f"""WITH t AS (SELECT row_id, {_sql_word_ids(pr.sql_sft_prompt(False))} AS p,
  list_concat({_sql_word_ids(pr.sql_sft_prompt(False))}, {_sql_word_ids('feedback')}, [{_EOS}]) AS f FROM v_expanded),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {order}) - 1) / {_BATCH}) AS BIGINT) AS batch_id FROM t),
m AS (SELECT *, max(len(f)) OVER (PARTITION BY batch_id) AS width FROM b)
SELECT row_id, batch_id,
  list_concat(f, list_transform(range(width - len(f)), lambda i: {_PAD})) AS input_ids,
  list_concat(list_transform(range(len(f)), lambda i: 1), list_transform(range(width - len(f)), lambda i: 0)) AS attention_mask,
  list_concat(list_transform(range(len(p)), lambda i: {_IGNORE}), f[len(p) + 1:],
              list_transform(range(width - len(f)), lambda i: {_IGNORE})) AS labels
FROM m"""


def _token_rows(spark, sf):
    return bt.token_rows(_src(spark, sf), WORD_IDS, pr.sft_prompt(False), F.col("feedback"))


@query("sft_loss_mask", SRC, _sql_padded("row_id"))
def sft_loss_mask(spark, sf):
    """Prompt+completion token ids padded to the batch width; prompt and padding are ignored (-100)."""
    t = _token_rows(spark, sf)
    return bt.padded_rows(t, bt.row_batches(t, _BATCH), _PAD)


@query("sft_length_batches", SRC, _sql_padded("len(f), row_id"))
def sft_length_batches(spark, sf):
    """The rows of ``sft_loss_mask`` in batches of nearly one length."""
    t = _token_rows(spark, sf)
    return bt.padded_rows(t, bt.length_batches(t, _BATCH), _PAD)


# ---- model plug-ins -----------------------------------------------------------------------------

MODELS = ("rm-a", "rm-b", "rm-c")


def _sql_logit(i: int) -> str:
    one = [f"(CAST(('0x' || substr(md5('{m}:' || input), {2 * i + 1}, 2)) AS INTEGER) - 128) / 16.0" for m in MODELS]
    return f"round(CAST(({' + '.join(one)}) / {len(MODELS)}.0 AS DOUBLE), 6)"


@query("score_stub", BOTH, f"SELECT row_id, {', '.join(f'{_sql_logit(i)} AS logit_{n}' for i, n in enumerate(LAB))} FROM "
       f"(SELECT row_id, {pr.sql_rm_input(False)} AS input FROM v_annotated_a)")
def score_stub(spark, sf):
    """Every row's reward-model input scored by three (stand-in) models in one pass, mean logits."""
    rows = _data(spark, sf).select("row_id", pr.rm_input().alias("input"))
    scored = score_rows(rows, [hashed_scorer(m) for m in MODELS], "input", ["row_id"])
    e = ensemble(scored, keep=())
    return e.select("row_id", *[F.round(F.col("logits")[i], 6).alias(f"logit_{n}") for i, n in enumerate(LAB)])


@query("generate_model", SRC, f"SELECT row_id, prompt, 'Look at step ' || CAST(('0x' || substr(md5(prompt), 1, 1)) AS INTEGER) || ' again, ' || "
       f"substr(md5(prompt), 1, 6) || '.' AS prediction FROM (SELECT row_id, {pr.sql_sft_prompt(False)} AS prompt FROM v_expanded)")
def generate_model(spark, sf):
    """A (stand-in) model's text after every supervised prompt, cut after its first line."""
    rows = _src(spark, sf).select("row_id", pr.sft_prompt(False).alias("prompt"))
    out = write_rows(rows, ECHO, "prompt", ["row_id"])
    return out.select("row_id", "prompt", tx.first_line("prediction").alias("prediction"))
