"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

A block of candidates is centred and turned onto its principal axes, which leaves inner products
as they are and gives lists that differ in range; each axis then has its candidates in order. A
search reads steps of the lists, those with the greatest fall of the bound first, so lists are
read the deeper the more they weigh for the query. It ends when the bound on everything unread
cannot beat the k-th score. Scores themselves are computed on the whole numbers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, docs_of, materialise, pick

SCALE = 64
#: Rows of candidates and of queries that meet in one group.
CANDIDATES, QUERIES = 8192, 2048
#: Steps that a list is read in.
STEPS = 64


class Search(NamedTuple):
    """Rows of the block and their scores, best first; how the search went."""

    rows: np.ndarray
    scores: np.ndarray
    met: int  # candidates that sorted access met, all of them scored
    stopped: bool  # ended by the bound, before the lists did


class Lists:
    """A block of candidates with their order along each axis."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, names: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        #: Tells rows with equal ids apart.
        self.names = self.ids if names is None else names[by_id]
        n, dims = self.vectors.shape
        largest = int(np.abs(self.vectors).max(initial=0))
        # Whole numbers below 2^53 (2^24) are exact in double (single) precision, and faster.
        reach = largest * largest * max(1, dims)
        self.scored = self.vectors.astype(np.float32) if reach < 1 << 22 else self.vectors.astype(np.float64) if reach < 1 << 50 else self.vectors
        self.step = max(1, -(-n // STEPS))
        self.places = np.minimum(np.arange(0, n + self.step, self.step), n)
        real = self.vectors.astype(np.float64)
        self.centre = real.mean(axis=0)
        self.axes = np.linalg.eigh(np.atleast_2d(np.cov(real, rowvar=False, bias=True)))[1]
        turned = (real - self.centre) @ self.axes
        self.order = np.ascontiguousarray(np.argsort(turned, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(turned.T, self.order, axis=1)
        self.extent = float(np.abs(turned).max(initial=0)) + float(np.abs(real).max(initial=0))
        # The best value left in a list after each step, from its upper and its lower end.
        last = np.minimum(self.places, n - 1)
        self.upper, self.lower = self.values[:, n - 1 - last], self.values[:, last]

    def best(self, query: np.ndarray, name: int | None, k: int, floor: float = -np.inf) -> Search:
        """The k best for ``query``, highest first, ties to the smaller id; row ``name`` is left out.

        Only scores of ``floor`` or more are wanted: the k-th score of another block, say. The
        search ends when the bound is below the k-th score or the floor (at a tie an unread
        candidate could still have a smaller id), or with the lists.
        """
        n = len(self.ids)
        q = query.astype(self.scored.dtype)
        turned = query.astype(np.float64) @ self.axes
        base = float(query.astype(np.float64) @ self.centre)
        # More than the rounding of any bound here.
        slack = 1e-9 * (1 + self.extent * float(np.abs(query).sum() + np.abs(turned).sum()) * len(query))
        rest = np.where(turned[:, None] >= 0, self.upper, self.lower) * turned[:, None]
        falls = rest[:, :-1] - rest[:, 1:]
        # A list is read from its end on: no step counts for more than one before it.
        rank = np.minimum.accumulate(falls, axis=1)
        sequence = np.argsort(-rank.ravel(), kind="stable")
        bounds = base + rest[:, 0].sum() - np.concatenate(([0.0], np.cumsum(falls.ravel()[sequence]))) + slack
        owner = sequence // falls.shape[1]
        whole = falls.shape[1]
        fresh = np.ones(n, dtype=bool)  # not met yet
        if name is not None:
            fresh[self.names == name] = False
        left = int(fresh.sum())
        read = np.zeros(len(turned), dtype=np.int64)
        rows, scores = np.empty(0, np.int64), np.empty(0, self.scored.dtype)
        at, kth, goal = 0, -np.inf, max(1, -(-2 * k // self.step))
        while True:
            # The first place at which the present k-th score would do.
            enough = int(np.searchsorted(-bounds, -max(kth, floor), side="right"))
            if at >= enough or len(rows) == left:
                break
            now = min(goal, enough, len(sequence))
            new = np.zeros(n, dtype=bool)
            steps = np.bincount(owner[at:now], minlength=len(turned))
            for d in np.flatnonzero(steps).tolist():
                a, b = self.places[read[d]], self.places[read[d] + steps[d]]
                new[self.order[d, n - b : n - a] if turned[d] >= 0 else self.order[d, a:b]] = True
            read += steps
            at, goal = now, 4 * now
            some = np.flatnonzero(new & fresh)
            fresh[some] = False
            rows, scores = np.concatenate([rows, some]), np.concatenate([scores, self.scored[some] @ q])
            if len(rows) >= k:
                kth = float(np.partition(scores, len(rows) - k)[len(rows) - k])
        met, stopped = len(rows), at >= enough
        good = scores >= max(kth, floor)
        rows, scores = rows[good], scores[good]
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return Search(rows[first], scores[first].astype(np.int64), met, stopped)


def quantised(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): floor(scale * component) of each vector, a row per row.

    Vectors that are null, empty or hold a null or non-finite component, and rows without
    vec_id, are left out. Other columns are ignored; an empty table gives no rows.
    """
    rows = pick(table, vec_id="long", embedding="array<double>").where("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False))))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vec"))


def _searched(c: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score): in every group, the k best for each query.

    ``c`` and ``q`` have (qb, cb, row, vec_id, vec), and ``q`` a floor.
    """

    def kernel(table):
        is_q = table.column("q").to_numpy(zero_copy_only=False).astype(bool)
        ids, names = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        values = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        floors = np.array([-np.inf if x is None else x for x in table.column("floor").to_pylist()], dtype=float)
        found: list[tuple] = []
        if is_q.any() and not is_q.all():
            lists = Lists(values[~is_q], ids[~is_q], names[~is_q])
            for name, own, vec, floor in zip(names[is_q].tolist(), ids[is_q].tolist(), values[is_q], floors[is_q].tolist()):
                got = lists.best(vec, name, k, floor)
                found.append((np.full(len(got.rows), name, np.int64), np.full(len(got.rows), own, np.int64), lists.ids[got.rows], got.scores))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), cols)))

    names = ["qb", "cb", "row", "vec_id", "vec"]
    both = c.select(*names, F.lit(False).alias("q"), F.lit(None).cast("double").alias("floor")).union(q.select(*names, F.lit(True).alias("q"), "floor"))
    return both.withColumn("dim", F.size("vec")).groupBy("dim", "qb", "cb").applyInArrow(kernel, "query_row long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, chosen: str, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, its k best of ``vectors`` but itself.

    ``vectors(vec_id, vec)`` holds whole numbers; the queries are its rows for which ``chosen``
    (SQL) holds, and only vectors of the query's length count. A row is left out of its own
    query's candidates alone: other rows with its vec_id take part, and rank among equals by
    vec_id. Candidates and queries are cut into blocks by a hash. All queries first search one
    block; the k-th scores found there are floors for the search of the others. A group sends
    on at most k rows a query, which are ranked once more. All of them if there are fewer than
    k; an empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(chosen)
    n_c, n_q = -(-max(1, rows.count()) // CANDIDATES), -(-max(1, queries.count()) // QUERIES)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    number = lambda a, n: F.explode(F.sequence(F.lit(a), F.lit(n - 1)))
    c = rows.select("row", "vec_id", "vec", number(0, n_q).alias("qb"), block(n_c).alias("cb"))
    q = queries.select("row", "vec_id", "vec", block(n_q).alias("qb"))
    first = materialise(_searched(c.where("cb = 0"), q.withColumns({"cb": F.lit(0), "floor": F.lit(None).cast("double")}), k), "top-first")
    every = first
    if n_c > 1:
        floors = first.groupBy("query_row").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("low").cast("double")).alias("floor"))
        # A row a query: the floors are as few as the queries, and travel with them.
        q = q.join(floors, "row", "left").select("*", number(1, n_c).alias("cb"))
        every = materialise(first.union(_searched(c.where("cb > 0"), q, k)), "top-every")
        discard(spark, first)
    discard(spark, rows)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(quantised(docs_of(spark, sf_dir, "embeddings")), "vec_id % 20 = 0", 20)


OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.vec) = len(c.vec) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
