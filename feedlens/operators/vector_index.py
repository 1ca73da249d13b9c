"""Approximate cosine top-k: an inverted-list index kept as a table.

``VectorIndex.build`` fits pivots on a bounded seeded sample, deals **every** vector to the list of
its nearest pivot and writes the lists, sorted by list, beside a table of pivots and list sizes. A
search sends each query to its ``probes`` nearest lists and scores it there against all their
vectors, exactly, in blocks of bounded rows; a list that holds a third of all vectors is many
blocks. The k best of all probed lists are the answer. More probes give more recall and cost;
``tuned_probes`` takes the fewest, of the powers of two, whose recall on a seeded sample of
queries, against the exact search over all vectors, reaches the wanted one. All lists probed is
the exact search.

Defined cases: null vectors and null ids are not indexed and have no neighbours; a zero vector lies
in a list of its own (-1) and is probed by zero queries only. Rows that repeat an id are rows of
their own. An empty index finds nothing. Vectors have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.operators import index as ix
from feedlens.operators.similarity import SPREAD, TILE, WIDE, BestOf, as_vectors, best, block_topk, fit_pivots, nearest_lists, nearest_pivots, score_blocks
from feedlens.rubric import SEED
from feedlens.session import shared_dir
from feedlens.sources.files import materialize, read_table, write_table


def probed_bands(queries: DataFrame, id_col: str, vec: str, pivots: np.ndarray, probes: int, band_of: dict[int, int]) -> DataFrame:
    """(id, _v, _band, _lists): a row per query and band, with the lists of the band among the query's
    ``probes`` nearest (list -1 for a zero vector)."""
    near = nearest_lists(queries, id_col, vec, pivots, probes)
    schema = T.StructType([*near.schema.fields[:2], T.StructField("_band", T.IntegerType()), T.StructField("_lists", T.ArrayType(T.IntegerType()))])
    most = max(band_of.values(), default=0) + 1

    def task(batches):
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten().to_numpy()
            band = np.array([band_of.get(x, -1) for x in flat.tolist()], np.int64)
            key = row * most + band
            order = np.argsort(key[band >= 0], kind="stable")
            key, flat = key[band >= 0][order], flat[band >= 0][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            told = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), pa.array(flat, pa.int32()))
            size = 16 * TILE  # rows: a query's vector is repeated per band
            for at in range(0, len(first), size):
                part = first[at:at + size]
                where = pa.array(key[part] // most)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(key[part] % most, pa.int32()),
                                                  told.slice(at, len(part))], names=schema.names)

    return near.mapInArrow(task, schema)


def _meet_probed(top: BestOf, lt: pa.Table, rt: pa.Table) -> None:
    asked = lt.column("_lists").combine_chunks()
    row = np.repeat(np.arange(lt.num_rows), asked.value_lengths().to_numpy())
    flat = asked.flatten().to_numpy()
    lists = rt.column("list").to_numpy()[top.order]
    by_query, by_place = np.argsort(flat, kind="stable"), np.argsort(lists, kind="stable")  # both ascending inside a list
    flat, row, lists = flat[by_query], row[by_query], lists[by_place]
    for x in np.unique(flat):
        mine, theirs = (slice(*np.searchsorted(a, [x, x + 1])) for a in (flat, lists))
        top.meet(row[mine], by_place[theirs], False)


class VectorIndex:
    """An index under ``path``: ``vectors`` (id, _v, list), ``lists`` (list, n) and ``pivots``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.vectors = read_table(spark, f"{self.path}/vectors")
        self.lists = read_table(spark, f"{self.path}/lists")
        rows = read_table(spark, f"{self.path}/pivots").orderBy("list").collect()  # one per list: a parameter of the build
        self.pivots = np.array([r.pivot for r in rows]) if rows else np.zeros((0, 0))

    @classmethod
    def build(cls, pool: DataFrame, id_col: str, vec: str = "vec", *, path: str | None = None, lists: int | None = None,
              sample_rows: int = 16_384, files: int | None = None, seed: int = SEED) -> VectorIndex:
        """Writes the index of ``pool``. ``lists``: the square root of the number of rows, and
        4,096 at most, if not given; the pivots are fitted on at most ``sample_rows`` rows."""
        spark = pool.sparkSession
        path = path or shared_dir(spark, "vector-index")
        if lists is None:
            lists = int(min(4096, max(1, round(pool.count() ** 0.5))))
        pivots = fit_pivots(pool, id_col, vec, lists, sample_rows=sample_rows, seed=seed)
        told = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "list int, pivot array<double>")
        write_table(told.coalesce(1), f"{path}/pivots")
        near = nearest_pivots(pool, id_col, vec, pivots).select(F.col(id_col).alias("id"), "_v", F.col("pivot").alias("list"))
        # by (list, id hash): a range of lists per file, a hot list is cut on by the hash
        keys = ["list", F.xxhash64("id")]
        near = near.repartitionByRange(files, *keys) if files else near.repartitionByRange(*keys)
        write_table(near.sortWithinPartitions("list"), f"{path}/vectors")
        out = read_table(spark, f"{path}/vectors")
        write_table(out.groupBy("list").agg(F.count(F.lit(1)).alias("n")).coalesce(1), f"{path}/lists")
        return cls(spark, path)

    def search(self, queries: DataFrame, query_id: str, vec: str = "vec", *, k: int = 2, probes: int = 8, exclude_self: bool = False,
               block_rows: int = 4096, digits: int = 6) -> DataFrame:
        """(query_id, id, sim, rank): the ``k`` best of the ``probes`` nearest lists of each query."""
        # lists travel in bands of at most WIDE * block_rows vectors, a larger list in parts: a query goes
        # once to each band that holds a list it probes, and meets there the lists it probes only
        lists = self.lists.orderBy("list").collect()  # a row per list: bounded by the build
        wide = min(WIDE * block_rows, max(block_rows, -(-sum(r.n for r in lists) // SPREAD)))
        bands, held = [], wide + 1
        for r in lists:
            if held + r.n > wide:
                bands, held = [*bands, []], 0
            held += r.n
            bands[-1].append(r)
        told = [(r.list, band, max(1, -(-sum(x.n for x in rows) // wide))) for band, rows in enumerate(bands) for r in rows]
        table = F.broadcast(self.spark.createDataFrame(told, "list int, _band int, _ni int"))
        asked = probed_bands(queries.withColumnRenamed(query_id, "_q"), "_q", vec, self.pivots, probes, {r[0]: r[1] for r in told})
        size = F.broadcast(self.spark.createDataFrame(sorted({(band, n) for _, band, n in told}), "_band int, _ni int"))
        # a band with many queries takes them in parts as well
        many = asked.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("_nq"))  # a row per band
        q = (asked.join(size, "_band").join(F.broadcast(many), "_band").withColumn("_bq", F.pmod(F.xxhash64("_q"), F.col("_nq")))
             .withColumn("_bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ni").cast("long") - 1))).drop("_nq", "_ni"))
        v = (self.vectors.join(table, "list").join(F.broadcast(many), "_band").withColumn("_bi", F.pmod(F.xxhash64("id"), F.col("_ni")))
             .withColumn("_bq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq").cast("long") - 1))).drop("_nq", "_ni"))
        part = score_blocks(q, v, ["_band", "_bq", "_bi"], [], "_q", "id", k, exclude_self, False, digits, _meet_probed)
        return best(part, [], "_q", "id", k).withColumnRenamed("_q", query_id)

    def _exact(self, queries: DataFrame, query_id: str, vec: str, k: int, exclude_self: bool, sample: int, seed: int):
        """A seeded sample of the queries and its exact neighbours, written."""
        some = materialize(ix.sample_exact(queries.select(query_id, as_vectors(vec).alias(vec)), sample, [query_id], seed=seed), "recall-sample")
        pool = self.vectors.select("id", F.col("_v").alias(vec))
        exact = block_topk(some, pool, left_id=query_id, right_id="id", vec=vec, k=k, exclude_self=exclude_self)
        return some, materialize(exact.select(query_id, "rank", F.col("sim").alias("exact")), "recall-exact")

    def _found(self, some: DataFrame, exact: DataFrame, query_id: str, vec: str, **search) -> float:
        got = self.search(some, query_id, vec, **search).select(query_id, "rank", F.col("sim").alias("found"))
        hit = F.when(F.col("found") >= F.col("exact"), 1.0).otherwise(0.0)
        return float(exact.join(got, [query_id, "rank"], "left").agg(F.coalesce(F.avg(hit), F.lit(1.0))).first()[0])

    def recall(self, queries: DataFrame, query_id: str, vec: str = "vec", *, k: int = 2, probes: int = 8, exclude_self: bool = False,
               sample: int = 256, seed: int = SEED) -> float:
        """Part of the exact neighbours of ``sample`` seeded queries that the search finds; an
        exact neighbour counts as found by any row as similar."""
        some, exact = self._exact(queries, query_id, vec, k, exclude_self, sample, seed)
        return self._found(some, exact, query_id, vec, k=k, probes=probes, exclude_self=exclude_self)

    def tuned_probes(self, queries: DataFrame, query_id: str, vec: str = "vec", *, least: float = 0.95, k: int = 2,
                     exclude_self: bool = False, sample: int = 256, seed: int = SEED) -> int:
        """The fewest probes, of the powers of two, whose ``recall`` is at least ``least``."""
        some, exact = self._exact(queries, query_id, vec, k, exclude_self, sample, seed)
        probes, most = 1, max(1, len(self.pivots))
        while probes < most and self._found(some, exact, query_id, vec, k=k, probes=probes, exclude_self=exclude_self) < least:
            probes *= 2
        return min(probes, most)
