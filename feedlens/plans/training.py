"""Training tables: supervised prompts, reward-model rows with negatives, preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import prompts as pr
from feedlens.functions.pack import unpack
from feedlens.operators import agreement as ag
from feedlens.operators import pairs as pa
from feedlens.rubric import BINARY, BINARY_LABELS, FLIPPED_LABELS, Rubric

ITEM = ["row_id", "qid", "question", "correct_answer", "explanation", "distractor"]


def negative_labels(df: DataFrame, labels=BINARY_LABELS) -> DataFrame:
    """Mismatched feedback is wrong: first label 1, the others 0."""
    df = df.withColumn(labels[0], F.lit(1.0))
    for l in labels[1:]:
        df = df.withColumn(l, F.lit(0.0))
    return df


def rm_inner(src: DataFrame, labels=BINARY_LABELS) -> DataFrame:
    n = pa.inner_neighbours(src)
    out = n.select(*ITEM, "shift", F.col("alt_feedback").alias("feedback"), F.lit("mismatch_inner").alias("method"))
    return negative_labels(out, labels)


def rm_outer(src: DataFrame, rate: int = 1, labels=BINARY_LABELS) -> DataFrame:
    n = pa.outer_permutation(src, rounds=rate)
    out = n.select(*ITEM, "round", F.col("alt_feedback").alias("feedback"), F.lit("mismatch_outer").alias("method"))
    return negative_labels(out, labels)


def rm_training_table(data: DataFrame, src: DataFrame, *, rate: int = 1, intra: bool = True, enc_dec: bool = False,
                      labels=BINARY_LABELS) -> DataFrame:
    """Annotated rows plus mismatched negatives -> (input, decoder_input, label vector, method)."""
    cols = ITEM + ["feedback", "method", *labels]
    rows = data.filter(F.col(labels[0]).isNotNull()).select(*cols)
    rows = rows.unionByName(rm_outer(src, rate, labels).select(*cols))
    if intra:
        rows = rows.unionByName(rm_inner(src, labels).select(*cols))
    inp = pr.rm_input(encoder_only=enc_dec)
    dec = pr.rm_decoder_input() if enc_dec else F.lit(None).cast("string")
    return rows.select("row_id", "method", inp.alias("input"), dec.alias("decoder_input"),
                       F.array(*[F.col(l).cast("double") for l in labels]).alias("label"))


def _pref(df: DataFrame, rejected_col: str, include_rubric: bool) -> DataFrame:
    return df.select("row_id", pr.sft_prompt(include_rubric).alias("prompt"), pr.completion("feedback").alias("chosen"),
                     pr.completion(rejected_col).alias("rejected"))


def _unpacked(df: DataFrame, cols, packed: bool) -> DataFrame:
    return df.withColumns({c: unpack(c) for c in cols}) if packed else df


def pref_outer(src: DataFrame, rounds: int = 1, include_rubric: bool = False, *, packed: bool = False, numbers=None) -> DataFrame:
    """``packed``: feedback comes as bytes of ``functions.pack``, here and below; ``numbers``: see
    ``outer_permutation``."""
    n = _unpacked(pa.outer_permutation(src, rounds=rounds, numbers=numbers), ["feedback", "alt_feedback"], packed)
    return _pref(n, "alt_feedback", include_rubric).withColumn("source", F.lit("mismatch_outer"))


def pref_inner(src: DataFrame, include_rubric: bool = False, *, packed: bool = False) -> DataFrame:
    n = _unpacked(pa.inner_neighbours(src), ["feedback", "alt_feedback"], packed)
    n = n.filter(F.coalesce(F.col("feedback") != F.col("alt_feedback"), F.lit(True)))  # equal texts give no preference
    return _pref(n, "alt_feedback", include_rubric).withColumn("source", F.lit("mismatch_inner"))


def pref_scores(data: DataFrame, include_rubric: bool = False, rubric: Rubric = BINARY, *, packed: bool = False) -> DataFrame:
    """Pairs of annotated feedback on one item; the higher gated score is chosen."""
    scored = ag.flip_labels(data, rubric).withColumn("score", ag.gated_score(FLIPPED_LABELS))
    p = _unpacked(pa.score_pairs(scored.select(*ITEM, "feedback", "score")), ["feedback", "b_feedback"], packed)
    first_wins = F.col("score") > F.col("b_score")
    return p.select(F.col("row_id"), F.col("b_row_id").alias("row_id_b"), pr.sft_prompt(include_rubric).alias("prompt"),
                    F.when(first_wins, pr.completion("feedback")).otherwise(pr.completion("b_feedback")).alias("chosen"),
                    F.when(first_wins, pr.completion("b_feedback")).otherwise(pr.completion("feedback")).alias("rejected"),
                    F.lit("score").alias("source"))


def preference_table(data: DataFrame, src: DataFrame, *, mmo: int = 1, mmi: bool = True, score: bool = True,
                     include_rubric: bool = False, packed: bool = False, numbers=None) -> DataFrame:
    """Bag union of the three preference sources. ``packed`` and ``numbers`` (of ``src``): see ``pref_outer``."""
    cols = ["source", "row_id", "prompt", "chosen", "rejected"]
    parts = []
    if mmo:
        parts.append(pref_outer(src, mmo, include_rubric, packed=packed, numbers=numbers).select(*cols))
    if mmi:
        parts.append(pref_inner(src.drop(*(numbers or ())), include_rubric, packed=packed).select(*cols))
    if score:
        parts.append(pref_scores(data, include_rubric, packed=packed).select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
