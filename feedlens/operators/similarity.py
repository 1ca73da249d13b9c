"""Exact cosine top-k between two vector tables, blocked.

The source multiplies the full target x pool matrix in memory. Here each side is cut into
blocks of bounded rows per group; a left block meets every right block of the same group in one
``cogroup`` task that multiplies them with numpy, tile by tile, and keeps the top-k per left row.
No pair row is ever materialised: the shuffle carries each vector once per block of the other
side (few, wide blocks, see ``block_count``) and at most ``k`` candidates per (left row, right
block); the final top-k is a window with ``WindowGroupLimit``. A task holds two blocks and one
tile, whatever the data. All pairs are scored, so the time grows with the product of the sides.

``PrunedSearch`` cuts the blocks by nearest pivot and by distance from it instead. Angles obey the
triangle inequality, so two blocks' pivots and distances bound every similarity between them.
Each left block first meets the blocks that promise its rows k neighbours; the k-th best found
there is the mark that any other right block must be able to reach, or the pair is dropped before
its vectors are shuffled.

Similarities are rounded to ``digits`` before ranking and ties go to the smaller right id, so
the ranking is reproducible and equal to a SQL engine computing the same formula. A zero vector
has similarity 0 to all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.operators import index as ix
from feedlens.rubric import SEED


def unit(vec) -> Column:
    """L2-normalised ``ARRAY<DOUBLE>``; the zero vector stays zero."""
    v = F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def unit_rows(column) -> np.ndarray:
    """A list column of doubles as a matrix of unit rows; zero rows stay zero."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None] if len(rows) else np.ones((0, 1))
    return np.divide(rows, norm, out=rows, where=norm != 0)


def top_of_rows(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest finite entries, the leftmost of equal ones."""
    k = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


TILE = 1024
# Right rows a list, the least number of lists that is worth the cutting, and left rows that meet the lists at a time
LIST, LEAST_LISTS, STRIP = 128, 16, 8 * TILE


class BestOf:
    """The k best right rows of each left row, out of products of at most ``TILE`` x ``TILE`` entries.

    Right rows are named by their place in the order of their ids, so the smaller place wins a tie.
    Similarities are kept in whole units of the last of ``digits`` places.
    """

    def __init__(self, left: pa.Table, right: pa.Table, left_id: str, right_id: str, k: int, exclude_self: bool, self_sim_zero: bool, digits: int):
        self.ids = [t.column(c).combine_chunks() for t, c in ((left, left_id), (right, right_id))]
        lid, rid = (i.to_numpy(zero_copy_only=False) for i in self.ids)
        self.order = np.argsort(rid, kind="stable")
        self.left, self.right = unit_rows(left.column("_v")), unit_rows(right.column("_v"))[self.order]
        self.k, self.unit, self.self_value = k, 10.0 ** digits, 0.0 if self_sim_zero else -np.inf
        self.own = self.codes = None
        if (exclude_self or self_sim_zero) and len(lid) and len(rid):
            place = {x: j for j, x in enumerate(rid[self.order].tolist())}
            if len(place) == len(rid):
                self.own = np.array([place.get(x, -1) for x in lid.tolist()], np.int64)
            else:  # an id may have several rows
                codes = np.unique(np.concatenate([lid, rid[self.order]]), return_inverse=True, equal_nan=False)[1]
                self.codes = codes[:len(lid)], codes[len(lid):]
        self.sims = np.full((len(lid), k), -np.inf)
        self.places = np.full((len(lid), k), -1, np.int64)
        # single precision tells which pairs may be better; those are scored again in double precision
        self.singles = None if self_sim_zero else [v.astype(np.float32) for v in (self.left, self.right)]
        self.slack = (self.left.shape[1] + 8) * 2.0 ** -23  # more than the error of a product of unit rows

    def meet(self, rows: np.ndarray, places: np.ndarray, ascending: bool) -> None:
        """Scores left ``rows`` against right ``places`` (both ascending). ``ascending``: these
        rows met only smaller places before, so that an equal one no longer counts."""
        lists = min(len(rows), len(places)) // LIST >= LEAST_LISTS and self._lists(places)
        if lists and np.isfinite(self.left[rows]).all():
            for i in range(0, len(rows), STRIP):
                self._meet_lists(rows[i:i + STRIP], *lists)
        else:
            self._meet_tiles(rows, places, ascending)

    def _meet_tiles(self, rows, places, ascending) -> None:
        for i in range(0, len(rows), TILE):
            for j in range(0, len(places), TILE):
                self._tile(rows[i:i + TILE], places[j:j + TILE], ascending)

    def _lists(self, places):
        """(centres, members of each one's list, the largest angle in it), or None: a row that counts
        as its own candidate with similarity 0 and vectors that are not finite have no angle bound."""
        v = self.right[places]
        if self.self_value == 0 or not np.isfinite(v).all():
            return None
        some = np.linspace(0, len(v) - 1, min(len(v), 16 * (len(v) // LIST))).astype(np.int64)
        centres = spherical_means(v[some], len(v) // LIST, 3)
        if not len(centres):
            return None
        near, sim = np.empty(len(v), np.int64), np.empty(len(v))
        for i in range(0, len(v), TILE):
            s = v[i:i + TILE] @ centres.T
            near[i:i + TILE] = at = s.argmax(1)
            sim[i:i + TILE] = s[np.arange(len(s)), at]
        by_list = np.argsort(near, kind="stable")  # places stay ascending
        ends = np.searchsorted(near[by_list], np.arange(len(centres) + 1))
        wide = np.zeros(len(centres))
        np.maximum.at(wide, near, np.arccos(np.clip(sim, -1, 1)))
        return centres, [places[by_list[a:b]] for a, b in zip(ends[:-1], ends[1:])], wide

    def _meet_lists(self, rows, centres, members, wide) -> None:
        """Scores ``rows`` against all lists that can hold one of their k best: no similarity exceeds
        the cosine of the angle to the list's centre less the list's largest angle."""
        most = self.left[rows] @ centres.T
        first = most.argmax(1)
        np.clip(most, -1, 1, out=most)
        wide = np.minimum(wide + 1e-6, np.pi)  # more than an angle's error
        inside = most >= np.cos(wide)
        off = np.sqrt(1 - most * most)
        off *= np.sin(wide)
        most *= np.cos(wide)
        most += off  # cos(a - b)
        most[inside] = 1
        most *= self.unit
        most += 0.5 + self.unit * 1e-9  # rounding
        order = np.argsort(first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(len(centres) + 1))
        for c in np.unique(first):
            self._meet_tiles(rows[order[ends[c]:ends[c + 1]]], members[c], False)
        most[np.arange(len(rows)), first] = -np.inf
        can = np.flatnonzero((most >= self.sims[rows, -1][:, None]).any(axis=0))
        for c in can:
            self._meet_tiles(rows[(most[:, c] >= self.sims[rows, -1]) & (most[:, c] > -np.inf)], members[c], False)

    def _tile(self, rows, places, ascending) -> None:
        if self.singles is not None:
            least = ((self.sims[rows, -1] - 0.5) / self.unit - self.slack).astype(np.float32)
            may = self.singles[0][rows] @ self.singles[1][places].T >= least[:, None]
            some = np.flatnonzero(may.any(axis=1))
            if not len(some):
                return
            rows, may = rows[some], may[some]
            if np.count_nonzero(may) < 16 * len(rows):
                r, c = np.nonzero(may)
                s = np.rint(np.einsum("ij,ij->i", self.left[rows[r]], self.right[places[c]]) * self.unit)
                if self.own is not None:
                    s[self.own[rows[r]] == places[c]] = self.self_value
                elif self.codes is not None:
                    s[self.codes[0][rows[r]] == self.codes[1][places[c]]] = self.self_value
                mark = self.sims[rows[r], -1]
                better = (s > mark) if ascending else (s >= mark) & (s > -np.inf)
                self._keep(rows, r[better], places[c[better]], s[better])
                return
        s = self.left[rows] @ self.right[places].T
        s *= self.unit
        np.rint(s, out=s)
        if self.own is not None:
            own = self.own[rows]
            at = np.minimum(np.searchsorted(places, own), len(places) - 1)
            hit = np.flatnonzero(places[at] == own)
            s[hit, at[hit]] = self.self_value
        elif self.codes is not None:
            s[self.codes[0][rows][:, None] == self.codes[1][places][None, :]] = self.self_value
        mark = self.sims[rows, -1][:, None]
        better = (s > mark) if ascending else (s >= mark) & (s > -np.inf)
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        many = np.count_nonzero(better[some], axis=1) > self.k
        few, lots = some[~many], some[many]
        r, c = np.nonzero(better[few])
        r = few[r]
        if len(lots):
            r2, c2 = top_of_rows(np.where(better[lots], s[lots], -np.inf), self.k)
            r, c = np.concatenate([r, lots[r2]]), np.concatenate([c, c2])
        self._keep(rows, r, places[c], s[r, c])

    def _keep(self, rows, r, place, sim) -> None:
        """Ranks what ``rows`` hold together with new ``place``s of ``rows[r]``."""
        some = np.unique(r)
        held = np.repeat(some, self.k)
        row = np.concatenate([held, r])
        sim = np.concatenate([self.sims[rows[some]].ravel(), sim])
        place = np.concatenate([self.places[rows[some]].ravel(), place])
        rank = np.lexsort((place, -sim, row))
        row, sim, place = row[rank], sim[rank], place[rank]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.sims[rows[row[keep]], nth[keep]], self.places[rows[row[keep]], nth[keep]] = sim[keep], place[keep]

    def found(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """(left row, left id, right id, similarity) of all that was found."""
        row, nth = np.nonzero(self.sims > -np.inf)
        right = self.ids[1].take(pa.array(self.order[self.places[row, nth]], pa.int64()))
        return row, self.ids[0].take(pa.array(row, pa.int64())), right, self.sims[row, nth] / self.unit + 0.0


def _score(left_id, right_id, keys, k, exclude_self, self_sim_zero, digits, meet):
    def fn(lt: pa.Table, rt: pa.Table) -> pa.Table:
        top = BestOf(lt, rt, left_id, right_id, k, exclude_self, self_sim_zero, digits)
        if lt.num_rows and rt.num_rows:
            meet(top, lt, rt)
        row, lid, rid, sim = top.found()
        out = {c: lt.column(c).combine_chunks().take(pa.array(row, pa.int64())) for c in keys}
        return pa.table({**out, left_id: lid, right_id: rid, "sim": sim})

    return fn


def _meet_all(top: BestOf, lt: pa.Table, rt: pa.Table) -> None:
    top.meet(np.arange(lt.num_rows), np.arange(rt.num_rows), True)


def score_blocks(left: DataFrame, right: DataFrame, tasks: list[str], keys: list[str], left_id: str, right_id: str, k: int,
                 exclude_self: bool, self_sim_zero: bool, digits: int, meet=_meet_all) -> DataFrame:
    """(*keys, left_id, right_id, sim): the top-k right rows of each left row in one block, for
    every combination of the ``tasks`` columns that both sides hold. Vectors are in ``_v``.
    ``meet(best, left, right)`` may leave out pairs; ``keys`` are columns of the left rows."""
    if any(left.schema[c].dataType != right.schema[c].dataType for c in tasks):
        raise ValueError("task columns of two types are hashed apart")
    fields = [left.schema[c] for c in [*keys, left_id]] + [right.schema[right_id], T.StructField("sim", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    fn = _score(left_id, right_id, keys, k, exclude_self, self_sim_zero, digits, meet)
    return left.groupBy(*tasks).cogroup(right.groupBy(*tasks)).applyInArrow(fn, schema)


def best(part: DataFrame, keys, left_id: str, right_id: str, k: int) -> DataFrame:
    """The k best of all blocks' candidates, with their rank."""
    w = Window.partitionBy(*keys, left_id).orderBy(F.col("sim").desc(), F.col(right_id).asc())
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Blocks a side: one per ``block_rows`` up to ``SPREAD`` of them, which keeps tasks busy, then as few
# as leave ``WIDE * block_rows`` rows in a block, as every block sends its rows to all of the other side.
SPREAD, WIDE = 8, 16


def block_count(n: Column, block_rows: int) -> Column:
    return F.greatest(F.least(F.ceil(n / F.lit(block_rows)), F.lit(SPREAD)), F.ceil(n / F.lit(WIDE * block_rows)))


def as_vectors(vec: str) -> Column:
    return F.col(vec).cast("array<double>")


def sent_vectors(df: DataFrame, vec: str) -> Column:
    """Vectors as they are shuffled: single precision stays so, tasks make doubles of it."""
    return F.col(vec) if df.schema[vec].dataType == T.ArrayType(T.FloatType(), df.schema[vec].dataType.containsNull) else as_vectors(vec)


def block_topk(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, vec: str = "vec", k: int = 2,
               group_cols=(), exclude_self: bool = False, self_sim_zero: bool = False, block_rows: int = 4096, digits: int = 6) -> DataFrame:
    """Top-``k`` right rows per left row by cosine similarity (within ``group_cols``).

    Returns ``(*group_cols, left_id, right_id, sim, rank)`` with rank 1 = most similar.
    ``self_sim_zero`` keeps a row as its own candidate with similarity 0, as the reference does.
    """
    if exclude_self and self_sim_zero:
        raise ValueError("exclude_self and self_sim_zero exclude each other")
    g = list(group_cols)
    # fresh aliases: both sides may come from one table (self-similarity)
    lv = left.select(*[F.col(c).alias(c) for c in g], F.col(left_id).alias(left_id), sent_vectors(left, vec).alias("_v"))
    rv = right.select(*[F.col(c).alias(c) for c in g], F.col(right_id).alias(right_id), sent_vectors(right, vec).alias("_v"))
    nlb = block_count(F.count(F.lit(1)), block_rows)
    if g:
        # number of blocks per group and side: a table with one row per group, joined on the group key
        blocks = lv.groupBy(*g).agg(nlb.alias("_nlb")).join(rv.groupBy(*g).agg(nlb.alias("_nrb")), g)
        lv, rv = lv.join(blocks, g), rv.join(blocks, g)
    else:
        # one group: the block counts are scalar subqueries
        n_l, n_r = lv.select(nlb).scalar(), rv.select(nlb).scalar()
        lv = lv.withColumn("_nlb", n_l).withColumn("_nrb", n_r)
        rv = rv.withColumn("_nlb", n_l).withColumn("_nrb", n_r)
    lrep = (lv.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.col("_nlb")))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nrb") - 1))).drop("_nlb", "_nrb"))
    rrep = (rv.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.col("_nrb")))
            .withColumn("_lb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nlb") - 1))).drop("_nlb", "_nrb"))
    part = score_blocks(lrep, rrep, [*g, "_lb", "_rb"], g, left_id, right_id, k, exclude_self, self_sim_zero, digits)
    return best(part, g, left_id, right_id, k)


# ---- pivots -------------------------------------------------------------------------------------

def fit_pivots(vectors: DataFrame, id_col: str, vec: str, count: int, *, sample_rows: int = 16_384, rounds: int = 10,
               seed: int = SEED) -> np.ndarray:
    """At most ``count`` unit vectors that lie among the table's: spherical k-means over the
    ``sample_rows`` rows of the smallest seeded hashes, the only rows that reach the driver."""
    sound = vectors.select(id_col, as_vectors(vec).alias("_v")).filter(F.col("_v").isNotNull() & F.col(id_col).isNotNull())
    rows = ix.sample_exact(sound, sample_rows, [id_col], seed=seed)
    return spherical_means(unit_rows(rows.select("_v").toArrow().column("_v")), count, rounds, seed)


def spherical_means(x: np.ndarray, count: int, rounds: int, seed: int = SEED) -> np.ndarray:
    """At most ``count`` unit vectors that lie among the unit rows ``x``; zero rows take no part."""
    x = x[np.abs(x).sum(1) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres = np.unique(x, axis=0)
    centres = centres[np.sort(np.random.default_rng(seed).permutation(len(centres))[:count])]
    for _ in range(rounds if len(centres) < len(x) else 0):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def nearest_lists(vectors: DataFrame, id_col: str, vec: str, pivots: np.ndarray, probes: int) -> DataFrame:
    """(id, _v, pivots, angles): a row per vector with its ``probes`` nearest pivots, the nearest
    first; a zero vector has pivot -1 and angle 0. Null vectors and ids take no part. The pivots go
    to the tasks with the function: as many as ``fit_pivots`` was asked for."""
    slim = vectors.select(id_col, sent_vectors(vectors, vec).alias("_v")).filter(F.col("_v").isNotNull() & F.col(id_col).isNotNull())
    schema = T.StructType([*slim.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType())), T.StructField("angles", T.ArrayType(T.DoubleType()))])

    def task(batches):
        # a slice's similarities to all pivots are bounded, however many pivots there are
        size = max(16, TILE * TILE // max(len(pivots), 1))
        for batch in (whole.slice(at, size) for whole in batches for at in range(0, whole.num_rows, size)):
            v = unit_rows(batch.column(1))
            zero = np.abs(v).sum(1) == 0
            sims = v @ pivots.T if len(pivots) else np.zeros((len(v), 1))
            n = min(probes, sims.shape[1])
            near = np.argsort(-sims, axis=1, kind="stable")[:, :n] if n < sims.shape[1] else np.tile(np.arange(n), (len(v), 1))
            many = np.where(zero, min(n, 1), n)
            row, place = np.repeat(np.arange(len(v)), n), near.ravel()
            once = ~zero[row] | (np.arange(len(row)) % max(n, 1) == 0)
            row, place = row[once], place[once]
            angle = np.arccos(np.clip(sims[row, place], -1, 1))
            angle[zero[row]], place = 0.0, np.where(zero[row], -1, place)
            ends = pa.array(np.r_[0, np.cumsum(many)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(angle))], names=schema.names)

    return slim.mapInArrow(task, schema)


def nearest_pivots(vectors: DataFrame, id_col: str, vec: str, pivots: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, _v, pivot, angle): ``nearest_lists`` with a row per vector and pivot."""
    near = nearest_lists(vectors, id_col, vec, pivots, probes)
    return near.select(id_col, "_v", F.inline(F.arrays_zip(F.col("pivots").alias("pivot"), F.col("angles").alias("angle"))))


# ---- exact search without the pairs of blocks that hold nothing -----------------------------------

class PrunedSearch:
    """``block_topk`` of two tables (without groups) over blocks cut by pivot and angle.

    At most ``pivots`` pivots of ``rings`` rings each. So the driver sees (pivots * rings)^2 pairs of
    rings at most, whatever the data. Rings travel in wide bands, so a vector is shuffled once per
    band of the other side, not once per ring; a ring larger than a band is cut on by hash. After
    ``run``, ``pairs`` is the number of pairs of rings and ``scored`` how many were scored.
    """

    def __init__(self, left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, vec: str = "vec", k: int = 2, exclude_self: bool = False,
                 pivots: int = 64, rings: int = 8, block_rows: int = 4096, digits: int = 6, sample_rows: int = 16_384):
        self.left, self.right, self.left_id, self.right_id, self.vec, self.k = left, right, left_id, right_id, vec, k
        self.exclude_self, self.rings, self.block_rows, self.digits = exclude_self, rings, block_rows, digits
        self.most, self.sample_rows = pivots, sample_rows
        self.pairs = self.scored = 0

    def _cells(self, df: DataFrame, id_col: str, centres: np.ndarray, name: str):
        """(rows with their cell and block, written; per cell its pivot, least and largest angle, rows, blocks)."""
        from feedlens.sources.files import materialize

        near = materialize(nearest_pivots(df, id_col, self.vec, centres), name)
        cuts = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
            "angle", [i / self.rings for i in range(1, self.rings)] or [0.5], 1000).alias("cut")).collect()  # a row per pivot
        told = []  # rings only where a pivot holds more than a block
        for r in cuts:
            parts = min(self.rings, -(-r.n // self.block_rows))
            told.append((r.pivot, sorted({float(r.cut[-(-i * self.rings // parts) - 1]) for i in range(1, parts)})))
        table = near.sparkSession.createDataFrame(told, "pivot int, _cut array<double>")
        near = near.join(F.broadcast(table), "pivot")
        ring = F.size(F.filter("_cut", lambda c: F.col("angle") > c))
        near = near.withColumn("cell", (F.col("pivot") + 1) * self.rings + ring).drop("_cut")
        stats = near.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("angle").alias("low"), F.max("angle").alias("high"),
                                         F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a row per ring
        return near, stats

    def _bounds(self, ls, rs, centres):
        """Least and largest angle between rows of each pair of cells."""
        col = lambda rows, name: np.array([r[name] for r in rows])
        if not ls or not rs:
            return (np.zeros((len(ls), len(rs))),) * 2
        p, q = col(ls, "pivot"), col(rs, "pivot")
        zero = (p < 0)[:, None] | (q < 0)[None, :]
        apart = np.arccos(np.clip(centres[p] @ centres[q].T, -1, 1)) if len(centres) else np.zeros(zero.shape)
        alow, ahigh, blow, bhigh = col(ls, "low")[:, None], col(ls, "high")[:, None], col(rs, "low")[None], col(rs, "high")[None]
        low = np.maximum.reduce([np.zeros(zero.shape), apart - ahigh - bhigh, alow - apart - bhigh, blow - apart - ahigh])
        high = np.minimum(np.pi, apart + ahigh + bhigh)
        return np.where(zero, np.pi / 2, low), np.where(zero, np.pi / 2, high)  # a zero vector has similarity 0

    def _bands(self, stats) -> dict[int, tuple[int, int]]:
        """Per cell its band and the number of parts of it. Neighbouring cells share a band of at most
        ``WIDE * block_rows`` rows (fewer, while that makes less than ``SPREAD`` bands); a larger cell
        is a band of its own, cut by hash."""
        most = min(WIDE * self.block_rows, max(self.block_rows, -(-sum(s.n for s in stats) // SPREAD)))
        out, band, held = {}, -1, most + 1
        for s in stats:
            if held + s.n > most:
                band, held = band + 1, 0
            held += s.n
            out[s.cell] = (band, -(-s.n // most))
        return out

    def _meet(self, lc, rc, ls, rs, todo):
        """Scores the pairs of cells in ``todo``. A row goes once to each band of the other side that
        holds a cell its own band meets; in the task its cell meets only the cells of ``todo``."""
        spark = lc.sparkSession
        lbands, rbands = self._bands(ls), self._bands(rs)
        parts = lambda bands: {b: n for b, n in bands.values()}
        lparts, rparts = parts(lbands), parts(rbands)
        pairs = sorted({(lbands[ls[i].cell][0], rbands[rs[j].cell][0]) for i, j in todo})
        meets: dict[int, list[int]] = {}
        for i, j in todo:
            meets.setdefault(ls[i].cell, []).append(rs[j].cell)

        def sent(rows, bands, mine, theirs, met, id_col, own, their):
            told = [(cell, band, n) for cell, (band, n) in bands.items()]
            rows = rows.join(F.broadcast(spark.createDataFrame(told, f"cell int, {own}c int, _n int")), "cell")
            to = [(i, j, theirs[j]) for i, j in met]
            rows = rows.join(F.broadcast(spark.createDataFrame(to, f"{own}c int, {their}c int, _m int")), f"{own}c")
            return (rows.withColumn(f"{own}b", F.pmod(F.xxhash64(id_col), F.col("_n"))).withColumn(f"{their}b", F.explode(F.sequence(
                F.lit(0).cast("long"), F.col("_m").cast("long") - 1))).drop("_n", "_m", "pivot", "angle"))

        def meet(top: BestOf, lt: pa.Table, rt: pa.Table) -> None:
            mine, other = (t.column("cell").to_numpy() for t in (lt, rt))
            other = other[top.order]
            for cell in np.unique(mine):
                top.meet(np.flatnonzero(mine == cell), np.flatnonzero(np.isin(other, meets.get(int(cell), []))), True)

        lrep = sent(lc, lbands, lparts, rparts, pairs, self.left_id, "_l", "_r")
        rrep = sent(rc, rbands, rparts, lparts, [(j, i) for i, j in pairs], self.right_id, "_r", "_l")
        part = score_blocks(lrep, rrep, ["_lc", "_lb", "_rc", "_rb"], ["cell"], self.left_id, self.right_id, self.k, self.exclude_self, False, self.digits, meet)
        return part.withColumnRenamed("cell", "_lc")

    def run(self) -> DataFrame:
        from feedlens.sources.files import materialize

        n = self.right.count()
        centres = fit_pivots(self.right, self.right_id, self.vec, max(1, min(self.most, -(-n // self.block_rows))), sample_rows=self.sample_rows)
        lc, ls = self._cells(self.left, self.left_id, centres, "cells-left")
        rc, rs = self._cells(self.right, self.right_id, centres, "cells-right")
        low, high = self._bounds(ls, rs, centres)
        first, need = [], self.k + int(self.exclude_self)
        for i in range(len(ls)):  # the cells that hold enough rows, those that promise most first
            held = 0
            for j in np.argsort(high[i], kind="stable"):
                first.append((i, int(j)))
                held += rs[j].n
                if held >= need:
                    break
        part = materialize(self._meet(lc, rc, ls, rs, first), "pairs-first")
        kth = part.groupBy("_lc", self.left_id).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("sim"))[F.greatest(
            F.lit(0), F.count(F.lit(1)) - self.k).cast("int")].alias("s"))  # at most k rows a block that was met
        mark = {r["_lc"]: r.s for r in kth.groupBy("_lc").agg(F.min(F.when(F.col("n") >= self.k, F.col("s")).otherwise(-2.0)).alias("s")).collect()}
        slack = 10.0 ** -self.digits  # rounding, and a tie may win by its id
        done = set(first)
        rest = [(i, j) for i in range(len(ls)) for j in range(len(rs))
                if (i, j) not in done and np.cos(low[i, j]) + slack >= mark.get(ls[i].cell, -2.0)]
        self.pairs, self.scored = len(ls) * len(rs), len(first) + len(rest)
        if rest:
            part = part.unionByName(self._meet(lc, rc, ls, rs, rest))
        return best(part.drop("_lc"), [], self.left_id, self.right_id, self.k)


def pruned_topk(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """``block_topk`` without groups, by ``PrunedSearch``."""
    return PrunedSearch(left, right, **options).run()
