"""Nearest neighbours by inner product: collision counting over sorted projections.

Every vector is lengthened by one coordinate to the largest norm, so that large inner products become small distances,
and projected on ``PROJECTIONS`` random lines; each line is one sorted array. A query is placed on every line, and a window
around it is opened and widened step by step (virtual rehashing: nothing is hashed again, the arrays are walked outwards
from the query). Only what a step newly covers is touched: it counts one collision more. Vectors that have collided on
``THRESHOLD`` lines are verified on the original vectors in double precision. A query ends when its windows reach ``REACH``
times as far as the k-th nearest found: a vector as near as that has then collided often enough with a probability of
0.93, nearer ones with a larger one, whatever the data. On clustered data that is soon; where all vectors are about as
far away, the windows become wide and many are verified.

The vectors are dealt to blocks, the stated queries too, and every pair of blocks is searched in one task: all rows are
indexed, none is left out, and a task holds two blocks. Of equal vectors the k + 1 smallest ids are kept: others can't
be among the nearest k.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component takes no part, nor does a row
without an id; vectors are compared with those of equal length only; rows that share the query's id are its own and no
candidates; a query id with several vectors searches with the smallest of them (by components), a candidate id with several
counts once, with the best of its scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, EVERY = 20, 20
#: Lines, collisions asked for, and how far windows reach in distances of the k-th nearest found.
PROJECTIONS, THRESHOLD, REACH = 48, 32, 1.15
#: Vectors in a block, queries in a block.
BLOCK, QUERIES = 65536, 2048
SEED = 11
#: Half-widths of the windows, each 1.2 times the one before, as shares of the largest norm; the next one is the whole line.
RADII = tuple(0.02 * 1.2**k for k in range(28))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim: the rows that take part; of equal vectors the k + 1 smallest ids."""
    own = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return own.where("vec_id is not null and vector is not null").where(finite).where(some).withColumn("dim", F.size("vector"))


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -score))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, touched: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest k found among the rows of x for each query: query, id, inner product. `touched` gets the number of
    places looked at and of vectors verified for each query."""
    n, dim = x.shape
    rng = np.random.default_rng(SEED)
    lines = rng.standard_normal((dim + 1, PROJECTIONS))
    norms = np.sqrt((x * x).sum(1))
    top = norms.max()
    flat = x @ lines[:dim] + np.sqrt(np.maximum(top * top - norms * norms, 0))[:, None] * lines[dim]
    ranks = [np.argsort(flat[:, j], kind="stable") for j in range(PROJECTIONS)]
    lengths = np.sqrt((queries * queries).sum(1))
    placed = (queries / lengths[:, None] * top) @ lines[:dim]
    # window edges for every radius, query and line, as places in the sorted arrays; the last window is the whole array
    reach = np.array([*RADII, np.inf]) * top
    edges = np.empty((len(queries), 2, len(reach), PROJECTIONS), np.int64)
    for j in range(PROJECTIONS):
        array = flat[ranks[j], j]
        edges[:, 0, :, j] = np.searchsorted(array, placed[:, j, None] - reach)
        edges[:, 1, :, j] = np.searchsorted(array, placed[:, j, None] + reach, side="right")
    begin = ((edges[:, 1] - edges[:, 0]).sum(-1) >= THRESHOLD * min(k, n)).argmax(1)  # narrower windows can't have k vectors collide so often
    several = len(np.unique(ids)) < n
    want = min(k, len(np.unique(ids)))
    out: list[tuple] = []
    for q in range(len(queries)):
        counts, hits, near = np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0)
        seen = ids == query_ids[q]
        wanted = min(want, len(np.unique(ids[~seen]))) if several else min(k, n - int(seen.sum()))
        steps, step, walked = edges[q].tolist(), int(begin[q]), 0
        low = high = steps[0][step]
        low, high = list(low), list(low)
        while True:
            new_low, new_high = steps[0][step], steps[1][step]
            fresh = [ranks[j][a:b] for j in range(PROJECTIONS) for a, b in ((new_low[j], low[j]), (high[j], new_high[j])) if a < b]
            low, high = new_low, new_high
            if fresh:
                fresh = np.concatenate(fresh)
                walked += len(fresh)
                counts += np.bincount(fresh, minlength=n)
                more = np.flatnonzero((counts >= THRESHOLD) & ~seen)
                seen[more] = True
                hits, near = np.concatenate([hits, more]), np.concatenate([near, x[more] @ queries[q]])
            if step == len(reach) - 1:
                break
            if len(hits) >= wanted:
                if not wanted:
                    break
                last = near[best_of(ids[hits], near, wanted)] if several else np.partition(near, -wanted)[-wanted:]
                if len(last) == wanted and REACH * np.sqrt(max(0.0, 2 * top * (top - last.min() / lengths[q]))) <= reach[step]:
                    break
            step += 1
        if touched is not None:
            touched += [walked, len(hits)]
        if len(hits) > wanted and not several:  # sums in one fixed order decide among those that the fast product puts in reach
            kept = near >= np.partition(near, -wanted)[-wanted] - 1e-9 * top * np.abs(queries[q]).sum() if wanted else near < -np.inf
            hits = hits[kept]
        score = (x[hits] * queries[q]).sum(1)
        best = best_of(ids[hits], score, wanted)
        out.append((np.full(len(best), query_ids[q]), ids[hits][best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: rows whose vec_id is divisible by `every`."""
    own = written(usable(vectors), "vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    data = own.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    queries = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    # smaller query blocks where there would be fewer tasks than cores; how queries are dealt changes no result
    n_queries, data_blocks = queries.count(), max(1, -(-own.count() // BLOCK))
    query_blocks = max(1, -(-n_queries // QUERIES), min(-(-n_queries // 64), -(-2 * own.sparkSession.sparkContext.defaultParallelism // data_blocks)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("d", dealt(data_blocks)).withColumn("q", to_all(query_blocks))
    queries = queries.withColumn("q", dealt(query_blocks)).withColumn("d", to_all(data_blocks))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("vector").combine_chunks()
        return flat.flatten().to_numpy().reshape(table.num_rows, -1), table.column("vec_id").to_numpy()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            (x, ids), (q, query_ids) = matrix(left), matrix(right)
            found = search(x, ids, q, query_ids, k)
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found = data.groupBy("dim", "d", "q").cogroup(queries.groupBy("dim", "d", "q")).applyInArrow(pair, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
