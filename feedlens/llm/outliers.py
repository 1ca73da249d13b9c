"""Quality rules by robust multivariate outliers.

Method: every text becomes a vector of transformed statistics (log length, log mean word length,
symbol share, duplicate-line share, repeated-word share). Per (language, source) a minimum
covariance determinant estimate is grown by concentration steps from a deterministic start
(medians and quartile ranges): the half of the rows with the smallest Mahalanobis distance gives
the next mean and covariance, until the determinant no longer falls. Rows beyond a chi-square
bound of the final distance are rejected.

* Bound: ``QUANTILE`` of a chi-square with as many degrees as there are statistics, a stated
  false-rejection rate of one normal row in a thousand. No label sets it.
* Floors: most texts have no symbol and no repeated line at all, so the nearer half does not vary
  in these shares. ``FLOORS`` squared is added to the variances; for the three shares it is set so
  that a share of ``REACH`` reaches the bound by itself in a text that is otherwise at the mean.
* Short texts: shares are over as many more words as the least text that passes the base rules has
  (``least_words``): a share counts with the text's words against one such text without finds, so
  the least text's own shares count half. The number is the base rule's, and moves with it.
* Consistency: the covariance of the nearer half is scaled so that the median distance is that of a
  chi-square with the degrees in which the rows vary above the floors (a sum of fractions, at
  least one). The half varies less than the whole, so the factor is never below one.
* Small groups lean on their language: an estimate counts with its number of rows against
  ``lean`` rows of the language's own estimate, a smooth weight at every size.

Scale. One pass over the texts gives slim rows. Each step is one grouped sum over them, by bins of
distance, which is combined per map task, so a hot source is no larger than any other for the
reducer. The cut of a step is one of these bins, not the result of a sort. Parameters (a row
per group) stay a table and are joined back.

Defined cases: null and empty texts have no word and fail the base rules; null language or
source is a group of its own; equal rows get equal verdicts; a group of one row rejects nothing
by itself; a group without a row that passes the base rules has no distance (null). An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from math import log1p, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.llm.words import _SEP, mix, sliced, text_buffers, window_hashes, word_hashes, word_spans
from feedlens.sources.files import materialize

STATS = ("log_words", "log_word_chars", "log_symbols", "dup_lines", "repeats")
SYMBOLS = b"#*$%&|<>"
P = len(STATS)
_UPPER = [(i, j) for i in range(P) for j in range(i, P)]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def chi_square_bound(p: float, degrees: float) -> float:
    """Chi-square quantile (Wilson-Hilferty)."""
    c = 2 / (9 * degrees)
    return degrees * (1 - c + NormalDist().inv_cdf(p) * sqrt(c)) ** 3


QUANTILE = 0.999
# Shares that reach the bound by themselves: symbols a word, duplicate lines a word (30 % of lines of ten words), repeated words.
REACH = (0.1, 0.03, 0.25)
# Standard deviation added to each statistic's own, in its transformed unit.
FLOORS = (0.1, 0.01, *[x / sqrt(chi_square_bound(QUANTILE, P)) for x in (log1p(REACH[0]), sqrt(REACH[1]), sqrt(REACH[2]))])


def _again(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier entry of the same text, equal to any other entry of it)."""
    key = mix(h, owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def text_statistics(data: np.ndarray, offsets: np.ndarray, window: int = 3) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    total = lambda flags: np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])
    chars = total(~_SEP[data] & ((data & 0xC0) != 0x80))  # whatever separates no words lies in one
    # lines: cut at \n and at the borders of texts
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.r_[offsets[:-1], breaks + 1])
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.r_[line_start[1:], len(data)], offsets[line_owner + 1]) if len(line_start) else line_start
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 0x0A)) if len(line_start) else line_end
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_owner = line_start[worded], line_end[worded], line_owner[worded]
    later, _ = _again(line_owner, word_hashes(data, line_start, line_end))
    dup = np.bincount(line_owner[later], minlength=n)
    words = word_hashes(data, starts, ends)
    runs = window_hashes(words, window)
    whole = np.flatnonzero(owner[:len(runs)] == owner[window - 1:]) if len(runs) else np.zeros(0, np.int64)
    _, found = _again(owner[whole], runs[whole])
    at = whole[found]
    cover = np.cumsum(np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1))[:-1] > 0
    return {"n_words": counts, "word_chars": chars, "n_symbols": total(_IS_SYMBOL[data]), "n_dup_lines": dup,
            "n_repeat_words": np.bincount(owner[cover], minlength=n)}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(text_col: str, slice_bytes: int):
    def run(batches):
        for b in sliced(batches, text_col, slice_bytes):
            at = b.schema.get_field_index(text_col)
            s = text_statistics(*text_buffers(b.column(at)))
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *[pa.array(s[c].astype(np.int64)) for c in BASE]],
                                             [*[b.schema.names[i] for i in keep], *BASE])

    return run


def _vector(least_words: int) -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / (F.col("n_words") + least_words)
    return [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), F.log1p(share("n_symbols")),
            F.sqrt(share("n_dup_lines")), F.sqrt(share("n_repeat_words"))]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from ``mean`` under ``inverse`` (upper triangle)."""
    terms = [f"(x{i} - mean[{i}]) * (x{j} - mean[{j}]) * inverse[{k}] * {1 if i == j else 2}" for k, (i, j) in enumerate(_UPPER)]
    return F.expr(f"greatest({' + '.join(terms)}, 0D)")


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for k, (i, j) in enumerate(_UPPER):
        out[i, j] = out[j, i] = upper[k]
    return out


def _floored(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(FLOORS))


def _row(group, mean, cov, before: float | None = None) -> dict:
    inverse = np.linalg.inv(_floored(cov))
    logdet = float(np.linalg.slogdet(_floored(cov))[1])
    return {"grp": group, "mean": np.round(mean, 9).tolist(), "cov": [float(cov[i, j]) for i, j in _UPPER],
            "inverse": [float(inverse[i, j]) for i, j in _UPPER], "logdet": logdet, "moved": None if before is None else abs(logdet - before)}


_PARAMS = "grp string, mean array<double>, cov array<double>, inverse array<double>, logdet double, moved double"


def _rows_to_params(make):
    """A table of groups -> parameter rows, batch by batch."""

    def run(batches):
        schema = pa.schema([("grp", pa.string()), *[(c, pa.list_(pa.float64())) for c in ("mean", "cov", "inverse")],
                            ("logdet", pa.float64()), ("moved", pa.float64())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([make(r) for r in b.to_pylist()], schema=schema)

    return run


def _start(r: dict) -> dict:
    q = np.array([r[f"q{i}"] for i in range(P)])  # quartiles of each statistic
    spread = (q[:, 2] - q[:, 0]) / 1.349
    return _row(r["grp"], q[:, 1], np.diag(np.square(spread)))


def _moments(r: dict) -> dict:
    n = r["n"]
    mean = np.array(r["s"]) / n
    cov = _square(np.array(r["ss"]) / n) - np.outer(mean, mean)
    return _row(r["grp"], mean, (cov + cov.T) / 2, r["before"])


BINS = 32  # histogram bins per doubling of a distance


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS).cast("int")


def _halves(bins: DataFrame) -> DataFrame:
    """The rows of ``bins`` (grp, bin, n, ...) that make up the half of each group with the smallest
    distances, in whole bins, with the group's number of rows. A group has a bounded number of bins."""
    w = W.partitionBy("grp")
    earlier = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return bins.select("*", earlier.alias("earlier"), F.sum("n").over(w).alias("rows")).filter(F.col("earlier") * 2 < F.col("rows"))


def robust_estimates(rows: DataFrame, steps: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """(grp, mean, cov, n_rows) for ``rows`` (grp, x0..): concentration steps to convergence.

    A step is one aggregate over the rows: sums by bin of distance, of which the bins of the nearer
    half are then added up."""
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    params = materialize(quartiles.mapInArrow(_rows_to_params(_start), _PARAMS), "mcd-start")
    sums = [f"sum(x{i}) AS s{i}" for i in range(P)] + [f"sum(x{i} * x{j}) AS s{i}_{j}" for i, j in _UPPER]
    for step in range(steps):
        d = rows.join(params.select("grp", "mean", "inverse", "logdet"), "grp").withColumn("bin", _bin(_distance()))
        bins = d.groupBy("grp", "bin").agg(F.count("*").alias("n"), F.max("logdet").alias("before"), *map(F.expr, sums))
        near = _halves(bins).groupBy("grp").agg(
            F.sum("n").alias("n"), F.max("before").alias("before"), F.expr(f"array({', '.join(f'sum(s{i})' for i in range(P))}) AS s"),
            F.expr(f"array({', '.join(f'sum(s{i}_{j})' for i, j in _UPPER)}) AS ss"))
        params = materialize(near.mapInArrow(_rows_to_params(_moments), _PARAMS), "mcd-step")
        if step and params.filter(F.col("moved") > tolerance).isEmpty():
            break
    bins = (rows.join(params.select("grp", "mean", "inverse"), "grp").groupBy("grp", _bin(_distance()).alias("bin"))
            .agg(F.count("*").alias("n")))
    halves = _halves(bins).groupBy("grp").agg(F.max("bin").alias("cut"), F.max("rows").alias("rows")).select(
        "grp", "rows", F.pow(F.lit(2.0), (F.col("cut") + 1) / F.lit(float(BINS))).alias("median"))

    def consistent(r: dict) -> dict:
        cov = _square(np.array(r["cov"]))
        varying = max(1.0, float(np.trace(np.linalg.inv(_floored(cov)) @ cov)))
        factor = max(1.0, r["median"] / chi_square_bound(0.5, varying))
        return {"grp": r["grp"], "mean": r["mean"], "cov": [x * factor for x in r["cov"]], "n_rows": r["rows"]}

    def scale(batches):
        schema = pa.schema([("grp", pa.string()), ("mean", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), ("n_rows", pa.int64())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([consistent(r) for r in b.to_pylist()], schema=schema)

    return params.join(halves, "grp").select("grp", "mean", "cov", "median", "rows").mapInArrow(
        scale, "grp string, mean array<double>, cov array<double>, n_rows long")


def _group_name(*cols: str) -> Column:
    return F.to_json(F.array(*[F.col(c) for c in cols]))


def rule_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  least_words: int = 50, repeat_percent: int = 50, quantile: float = QUANTILE, lean: float = 50.0,
                  slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, distance, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"))
    stats = slim.mapInArrow(_statistics("_text", slice_bytes), f"doc_id {kind}, lang string, source string, "
                            + ", ".join(f"{c} long" for c in BASE))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = materialize(stats.select("*", failed.alias("base_failed"), _group_name("lang", "source").alias("own"),
                                     _group_name("lang").alias("wide"), *[x.alias(f"x{i}") for i, x in enumerate(_vector(least_words))]), "rule-stats")
    fitted = stats.filter(~F.col("base_failed"))
    xs = [f"x{i}" for i in range(P)]
    rows = fitted.select(F.explode(F.array("own", "wide")).alias("grp"), *xs)
    found = materialize(robust_estimates(rows), "rule-estimates")
    pairs = stats.select("own", "wide").distinct()
    wide = found.select(F.col("grp").alias("wide"), F.col("mean").alias("wide_mean"), F.col("cov").alias("wide_cov"))
    leaned = pairs.join(found.withColumnRenamed("grp", "own"), "own").join(wide, "wide")

    def blend(batches):
        schema = pa.schema([("own", pa.string()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])
        for b in batches:
            out = []
            for r in b.to_pylist():
                part = r["n_rows"] / (r["n_rows"] + lean)
                mean = part * np.array(r["mean"]) + (1 - part) * np.array(r["wide_mean"])
                cov = _floored(_square(part * np.array(r["cov"]) + (1 - part) * np.array(r["wide_cov"])))
                inverse = np.linalg.inv(cov)
                out.append({"own": r["own"], "mean": mean.tolist(), "inverse": [float(inverse[i, j]) for i, j in _UPPER]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    bounds = materialize(leaned.select("own", "mean", "cov", "n_rows", "wide_mean", "wide_cov").mapInArrow(
        blend, "own string, mean array<double>, inverse array<double>"), "rule-bounds")
    limit = chi_square_bound(quantile, P)
    return (stats.join(bounds, "own", "left").withColumn("distance", F.when(F.col("inverse").isNotNull(), _distance()))
            .select("doc_id", *BASE, "base_failed", "distance",
                    F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept")))
