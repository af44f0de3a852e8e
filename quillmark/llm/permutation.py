"""Nearest neighbours through a permutation index: vectors as ordered nearest pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import stage_table
from quillmark.llm.vectors import component_type, cosines, matrix, plain, units, usable

#: The share of the pivots that a permutation keeps, nearest first.
PREFIX = 0.5
#: The share of a shard's vectors that are ranked again by their cosine, and the least number.
RERANKED, LEAST_RERANKED = 0.2, 256
#: Vectors in a shard of the index, and queries in a block, at most about. A shard's inverted files
#: are made once for each block, so a block is as large as a task can hold.
SHARD_ROWS, BLOCK_QUERIES = 8192, 8192
#: How far a cosine in single precision may be off, and more.
ROUGH = 1e-4
SEED = 11


def pivots(dimensions: int, seed: int = SEED) -> np.ndarray:
    """As many pivots as dimensions, at right angles to each other: no two say the same."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q.T * np.sign(np.diag(r))[:, None]


def permutations(x: np.ndarray, pivot: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` nearest pivots of each row of unit vectors, nearest first."""
    return np.argsort(-(x @ pivot.T), axis=1, kind="stable")[:, :keep]


class InvertedFiles:
    """For each pivot its file: the place that it has with every vector, behind the last place for those
    that do not have it among their nearest. Half of all vectors have a pivot, so a full row of
    small numbers is no larger than a list of those that do, and is read without jumps."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.keep = orders.shape
        self.files = np.full((n_pivots, self.n), self.keep, np.int16)
        self.files[orders, np.arange(self.n)[:, None]] = np.arange(self.keep, dtype=np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Spearman's footrule distance of every vector's permutation to ``order``, a pivot that is
        missing from a permutation standing behind its last place. Only the files of the query's
        own pivots are read: a pivot in the places i and j brings the distance down from that of
        two permutations without a pivot in common by twice what max(i, j) is short of the last."""
        found = np.full(self.n, self.keep * (self.keep + 1) - 2 * self.keep * len(order), np.int32)
        later = np.zeros(self.n, np.int32)
        for i, pivot in enumerate(order.tolist()):
            later += np.maximum(self.files[pivot], i)
        return found + 2 * later


def search(
    index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
    reranked: float = RERANKED, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest rows of ``index`` found for each row of ``queries``, by cosine.

    Returns query_id, rank (from 1), vec_id, score. Both frames have an id and a vector, and other
    columns are ignored. Rows without an id or usable vector take no part; rows that agree in both
    count once. A row is no candidate for a query of the same id, nor one of another length, which
    has no cosine with it. Rows of one id with different vectors are queries, or candidates, each
    for itself. Equal vectors are indexed once, with the k + 1 smallest of their ids, which is all that a result of k
    can show of them. Empty frames give no rows.

    The index is dealt in shards and every block of queries visits every shard. There a query's
    permutation is held against the inverted files of its own pivots, the ``reranked`` share of the
    shard with the least footrule distance is ranked by exact cosine, and the k best go on; the
    best of all shards are the result. Ties go to the smaller id throughout.
    """
    kind = component_type((queries, vector), (index, vector))
    own = Window.partitionBy("v").orderBy("id")
    asked = _tidy(queries, id_col, vector, kind)
    rows = _tidy(index, id_col, vector, kind).withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1).drop("n")
    asked, kept = stage_table(asked, "queries"), stage_table(rows, "indexed")
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    by_length = asked.groupBy(F.size("v").alias("d")).agg(parts(F.count("*"), block_queries).alias("blocks"))
    lengths = kept.groupBy(F.size("v").alias("d")).agg(parts(F.count("*"), shard_rows).alias("shards")).join(by_length, "d")
    lengths = stage_table(lengths, "lengths")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = kept.withColumn("d", F.size("v")).join(lengths, "d").withColumn("shard", dealt("v", "shards")).withColumn("block", every("blocks"))
    visits = asked.withColumn("d", F.size("v")).join(lengths, "d").withColumn("block", dealt("id", "blocks")).withColumn("shard", every("shards"))

    def visit(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = _search_shard(rows, asked, key[0].as_py(), k, reranked)
        return pa.table(dict(zip(("query_id", "query", "vec_id", "score"), map(pa.array, out))))

    near = (
        spread.select("d", "shard", "block", "id", "v").groupBy("d", "shard", "block")
        .cogroup(visits.select("d", "shard", "block", "id", "v", F.xxhash64("v").alias("query")).groupBy("d", "shard", "block"))
        .applyInArrow(visit, "query_id long, query long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _tidy(df: DataFrame, id_col: str, vector: str, kind: str) -> DataFrame:
    """(id, v): the different vectors of each id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), plain(vector, kind).alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()


def _search_shard(rows: pa.Table, asked: pa.Table, dimensions: int, k: int, reranked: float) -> tuple[np.ndarray, ...]:
    """(query, its vector's hash, candidate, cosine) of the k best candidates of each query in one shard."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(rows) or not len(asked):
        return none
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    x = matrix(rows.column("v"), dimensions)[order]
    q = matrix(asked.column("v"), dimensions)
    pivot = pivots(dimensions)
    keep = max(1, round(dimensions * PREFIX))
    unit = units(x)
    files = InvertedFiles(permutations(unit, pivot, keep), dimensions)
    rough = unit.astype(np.float32)
    asked_orders = permutations(units(q), pivot, keep)
    depth = min(len(ids), max(LEAST_RERANKED, k + 1, int(np.ceil(len(ids) * reranked))))
    out: list[tuple] = []
    for query, mark, vector, permutation in zip(asked.column("id").to_pylist(), asked.column("query").to_pylist(), q, asked_orders):
        distance = files.footrule(permutation)
        if depth < len(ids):
            # all rows nearer than the depth-th, and of those as near the smallest ids
            edge = np.partition(distance, depth - 1)[depth - 1]
            inside = np.flatnonzero(distance < edge)
            at = np.concatenate([inside, np.flatnonzero(distance == edge)[: depth - len(inside)]])
        else:
            at = np.arange(len(ids))
        at = at[ids[at] != query]
        if len(at) > k:
            # single precision is off by far less than ROUGH: the exact cosine decides among what it leaves
            near = rough[at] @ units(vector[None, :])[0].astype(np.float32)
            at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - ROUGH]
        score = cosines(x[at], vector[None, :])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), query), np.full(len(best), mark), ids[at][best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def divisible(id_col: str, by: int) -> Column:
    return F.col(id_col) % by == 0
