"""Supervised rows as token ids: loss masks and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.plugins import Tokenizer, token_ids
from feedlens.operators.index import batch_ids, ordered_index
from feedlens.sources.files import materialize

IGNORE = -100  # fixed value: the label that a loss leaves out


def token_rows(rows: DataFrame, tokenizer: Tokenizer, prompt: Column, completion: Column, key: str = "row_id") -> DataFrame:
    """(key, prompt_ids, ids): the ids of the prompt, and of prompt, completion and the end id.
    Tokenized once and written: widths, batches and masks read the arrays."""
    t = rows.select(key, token_ids(tokenizer, prompt).alias("prompt_ids"), token_ids(tokenizer, completion).alias("_c"))
    ids = F.concat("prompt_ids", "_c", F.array(F.lit(tokenizer.eos_id)))
    return materialize(t.select(key, "prompt_ids", ids.alias("ids")), "token-rows")


def row_batches(tokens: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """(key, batch_id): batches in the order of the key; numbered on slim keys."""
    return batch_ids(tokens.select(key), size, [key])


def length_batches(tokens: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """(key, batch_id): batches of rows of nearly one length, so that little is padded."""
    slim = tokens.select(key, F.size("ids").alias("_len"))
    out = ordered_index(slim, ["_len", key], index_col="_idx")
    return out.select(key, F.floor(F.col("_idx") / size).cast("bigint").alias("batch_id"))


def padded_rows(tokens: DataFrame, batches: DataFrame, pad_id: int, key: str = "row_id") -> DataFrame:
    """(key, batch_id, input_ids, attention_mask, labels), padded to the batch's longest row. Labels
    of the prompt and of the padding are ``IGNORE``."""
    t = tokens.join(batches, key)
    widths = t.groupBy("batch_id").agg(F.max(F.size("ids")).alias("_width"))  # one row per batch
    m = t.join(widths, "batch_id")
    pad, n, p = F.col("_width") - F.size("ids"), F.size("ids"), F.size("prompt_ids")
    return m.select(
        key, "batch_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE), p), F.slice("ids", p + 1, F.greatest(n - p, F.lit(0))),
                 F.array_repeat(F.lit(IGNORE), pad)).alias("labels"))
