"""Plug-ins that run inside tasks: tokenizers and models, loaded once per Python worker.

A plug-in is a name and a ``load`` function without arguments; what ``load`` returns is called
with whole batches. The loaded object outlives a task: it is kept in the worker process under the
plug-in's name, so a worker loads it once for all tasks it runs. ``load`` and what it needs must
be importable, or picklable by value, on the workers; file paths it opens must exist there.

* ``Tokenizer``: ``load()`` gives ``fn(texts) -> list of id lists``.
* ``Scorer``: ``load()`` gives ``fn(texts) -> (len(texts), n) numbers``.
* ``Writer``: ``load()`` gives ``fn(prompts, max_new_tokens) -> list of texts`` that follow them.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.sources.files import materialize


@dataclass(frozen=True)
class Plugin:
    name: str
    load: Callable[[], Callable]
    batch_size: int = 256


@dataclass(frozen=True)
class Tokenizer(Plugin):
    eos_id: int = 2
    pad_id: int = 0


class Scorer(Plugin):
    pass


class Writer(Plugin):
    pass


def held(plugin: Plugin) -> Callable:
    """The loaded plug-in of this worker. The registry is a module of the process, as functions sent
    by value have their own globals in each task."""
    kept = sys.modules.setdefault("feedlens_worker_plugins", types.ModuleType("feedlens_worker_plugins")).__dict__
    key = f"{type(plugin).__name__}:{plugin.name}"
    if key not in kept:
        kept[key] = plugin.load()
    return kept[key]


def _batches(items: list, size: int) -> Iterator[list]:
    return (items[at:at + size] for at in range(0, len(items), size))


def token_ids(plugin: Tokenizer, text: Column) -> Column:
    """``ARRAY<INT>`` of a text's ids, without an end id; a null text has null."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        # a batch of texts at a time is Python objects; ids are kept as numbers
        some = texts.drop_null()
        made = [np.asarray(x, np.int32) for at in range(0, len(some), plugin.batch_size)
                for x in held(plugin)(some.slice(at, plugin.batch_size).to_pylist())]
        counts = np.zeros(len(texts), np.int64)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        counts[~null] = [len(x) for x in made]
        ids = pa.array(np.concatenate(made) if made else np.zeros(0, np.int32), pa.int32())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), ids, mask=pa.array(null))

    return encode(text)


def score_rows(rows: DataFrame, scorers: Sequence[Scorer], text_col: str, keys: Sequence[str], n: int = 5) -> DataFrame:
    """(*keys, model, logits): every row scored by every model in one pass over the texts, written
    before it is used, so that no later branch runs the models again. Keys may be any columns but
    ``model`` and ``logits``."""
    keys = list(keys)
    slim = rows.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("model", T.StringType()), T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in scorers:
                made = [np.asarray(held(s)(part), np.float64).reshape(len(part), n) for part in _batches(pdf["_text"].tolist(), s.batch_size)]
                out = pdf[keys].copy()
                out["model"], out["logits"] = s.name, list(np.concatenate(made)) if made else []
                yield out

    return materialize(slim.mapInPandas(run, schema), "scores")


def write_rows(rows: DataFrame, writer: Writer, prompt_col: str, keys: Sequence[str], max_new_tokens: int = 200) -> DataFrame:
    """(*keys, prompt_col, prediction): what the model writes after each prompt, written before use."""
    keys = [*keys, prompt_col]
    slim = rows.select(*keys)
    schema = T.StructType([*slim.schema.fields, T.StructField("prediction", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            out["prediction"] = [t for part in _batches(pdf[prompt_col].fillna("").tolist(), writer.batch_size)
                                 for t in held(writer)(part, max_new_tokens)]
            yield out

    return materialize(slim.mapInPandas(run, schema), "predictions")


# ---- deterministic stand-ins (tests and registered queries); SQL can repeat them ----------------------

def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def load_word_ids():
    """One id per whitespace-separated word: 3 + the first four hex digits of its md5."""
    return lambda texts: [[int(_md5(w)[:4], 16) + 3 for w in t.split()] for t in texts]


def hashed_scorer(name: str) -> Scorer:
    """Five logits from -8 to 7.9375 out of the md5 of ``name:text``."""
    def load():
        def score(texts):
            digests = [_md5(f"{name}:{t}") for t in texts]
            return [[(int(d[2 * i:2 * i + 2], 16) - 128) / 16 for i in range(5)] for d in digests]

        return score

    return Scorer(name, load)


def load_echo_writer():
    """A first line out of the prompt's md5, then a line that generation would leave behind."""
    return lambda prompts, n: [" ".join(f" Look at step {int(_md5(p)[0], 16)} again, {_md5(p)[:6]}.\nQuestion: more".split(" ")[:n]) for p in prompts]


WORD_IDS = Tokenizer("word-ids", load_word_ids)
ECHO = Writer("echo", load_echo_writer)
