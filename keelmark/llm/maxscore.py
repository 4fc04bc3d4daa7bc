"""Exact top-k search by MaxScore over sharded postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelmark.llm.runtime import prepare

TOP, SCALE = 10, 1024.0
#: Vectors of a shard, queries of a block, queries that traverse postings together, and vectors between two updates of the bounds, at first and at most.
SHARD, QUERIES, TOGETHER, STEP, LONGEST_STEP = 4096, 4096, 256, 256, 2048
#: A list that holds this share of the vectors is kept as a row.
FULL = 1 / 8


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component; null for vectors that are null, or hold null or non-finite components.

    What lies beyond 64 bits becomes the largest or smallest long, which ``search_top`` refuses.
    """
    numbers = F.transform(vector, lambda x: x.cast("double"))
    scaled = F.transform(numbers, lambda x: x * SCALE)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("long")))


class Postings:
    """A shard's vectors, by increasing id, as postings of non-negative weights.

    A dimension makes two terms: one for queries with a positive weight there, with each component less the smallest, and
    one for negative query weights, with the largest less each component. So a query's score is a constant plus a sum of
    non-negative parts, which bounds can cut off. Zero parts are left out of the postings; a list with few zero parts, as dense
    vectors have, is its row of weights, and the rows of many queries are traversed by one matrix product.
    """

    def __init__(self, vectors: np.ndarray):
        self.size, self.dims = vectors.shape
        self.low = vectors.min(axis=0) if self.size else np.zeros(self.dims, np.int64)
        self.high = vectors.max(axis=0) if self.size else np.zeros(self.dims, np.int64)
        #: terms times vectors: first those for positive query weights, then those for negative ones
        self.weights = np.concatenate([(vectors - self.low).T, (self.high - vectors).T])
        full = np.count_nonzero(self.weights, axis=1) >= FULL * self.size
        self.full, self.posts = np.flatnonzero(full), {int(t): np.flatnonzero(self.weights[t]) for t in np.flatnonzero(~full)}

    def search(self, query: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the ``top`` highest scores, ties to smaller places; ``own`` places are left out."""
        return self.search_all(query[None], [own], top)[0]

    def search_all(self, queries: np.ndarray, own: list[np.ndarray], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``search`` for every row of ``queries``, with its own places."""
        constant = np.where(queries > 0, queries * self.low, queries * self.high).sum(axis=1)
        weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        bound = weight * np.tile(self.high - self.low, 2)
        order = np.argsort(bound, axis=1, kind="stable")  # from the weakest term
        nth = np.argsort(order, axis=1)
        below = np.zeros((len(queries), 2 * self.dims + 1), dtype=np.int64)  # of the n weakest terms together
        np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1, out=below[:, 1:])
        # Doubles hold every sum exactly up to 2**53; beyond, whole numbers are used, which are slower.
        kind = np.float64 if below[:, -1].max(initial=0) < 1 << 53 else np.int64
        rows, vectors = self.weights[self.full].astype(kind), np.ascontiguousarray(self.weights.T)
        all_terms = np.full(len(queries), 2 * self.dims)
        weakest = np.count_nonzero(below <= below[:, -1:] // 64, axis=1) - 1  # terms that add a sixty-fourth at most
        own_query, own_place = np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate([*own, np.empty(0, np.int64)])

        def traverse(part: np.ndarray, start: int, first: np.ndarray, last: np.ndarray) -> None:
            """Add the lists of each query's terms from its ``first`` weakest on up to its ``last``."""
            wanted = np.where((nth >= first[:, None]) & (nth < last[:, None]), weight, 0)
            part += wanted[:, self.full].astype(kind) @ rows[:, start:start + part.shape[1]]
            for t, posts in self.posts.items():
                held = posts[slice(*np.searchsorted(posts, (start, start + part.shape[1])))]
                asked = np.flatnonzero(wanted[:, t])
                if len(held) and len(asked):
                    part[np.ix_(asked, held - start)] += np.outer(wanted[asked, t], self.weights[t, held])

        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        theta, essential, stop, step = np.full(len(queries), -1), np.zeros(len(queries), np.int64), 0, STEP
        while stop < self.size:
            start, stop, step = stop, min(stop + step, self.size), min(2 * step, LONGEST_STEP)
            part = np.zeros((len(queries), stop - start), dtype=kind)

            def can_win(n: np.ndarray) -> np.ndarray:
                return part > (theta - np.take_along_axis(below, n[:, None], axis=1)[:, 0])[:, None]

            # Essential postings: what is in none of them stays at or under the threshold.
            traverse(part, start, essential, all_terms)
            alive, probed = can_win(essential), essential
            # The others are probed, strongest first, while a vector can still win: in lists while many can, then vector by vector.
            if np.count_nonzero(alive) >= FULL * alive.size and (weakest < essential).any():
                probed = np.minimum(essential, weakest)
                traverse(part, start, probed, essential)
                alive = can_win(probed)
            here = (own_place >= start) & (own_place < stop)
            alive[own_query[here], own_place[here] - start] = False
            query, place = np.nonzero(alive)
            score = part[query, place].astype(np.int64)
            for a in range(0, len(query), lot := max(1, (1 << 21) // max(1, 2 * self.dims))):
                q, x = query[a:a + lot], place[a:a + lot] + start
                if probed[q].any():
                    score[a:a + lot] += np.einsum("ij,ij->i", np.where(nth[q] < probed[q, None], weight[q], 0), vectors[x])
            wins = score > theta[query]
            query, place, score = query[wins], place[wins] + start, score[wins]
            edges = np.searchsorted(query, np.arange(len(queries) + 1))
            for q in np.unique(query).tolist():
                found = slice(edges[q], edges[q + 1])
                places, scores = np.concatenate([best[q][0], place[found]]), np.concatenate([best[q][1], score[found]])
                first = np.lexsort((places, -scores))[:top]
                best[q] = places[first], scores[first]
                if len(first) == top:
                    theta[q] = scores[first[-1]]  # a later vector of this score comes after it
                    essential[q] = np.searchsorted(below[q], theta[q], side="right") - 1
        return [(places, scores + c) for (places, scores), c in zip(best, constant)]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    sizes = pa.compute.list_value_length(column).to_numpy()
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = pa.compute.list_flatten(column).to_numpy()
    return out


def _searching(top: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not shard.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        shard = shard.sort_by("vec_id")
        ids = shard.column("vec_id").to_numpy()
        dims = max(pa.compute.max(pa.compute.list_value_length(t.column("vector"))).as_py() for t in (queries, shard))
        postings = Postings(_matrix(shard.column("vector"), dims))
        found: tuple[list, list, list] = ([], [], [])
        asked, wanted = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), dims)
        for a in range(0, len(asked), TOGETHER):
            some = asked[a:a + TOGETHER]
            own = [np.arange(*x) for x in zip(np.searchsorted(ids, some), np.searchsorted(ids, some, side="right"))]
            for q, (places, scores) in zip(some, postings.search_all(wanted[a:a + TOGETHER], own, top)):
                for out, values in zip(found, (np.full(len(places), q), ids[places], scores)):
                    out.append(values)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in found], names=names)

    return run


def search_top(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the ``top`` highest inner products, ties to the smaller vec_id.

    Both tables have vec_id and vector (array of long, as ``quantised`` makes it; null vectors and null ids take no part). A query's own
    id is no candidate for it. Vectors of different lengths count as padded with zeros. If a query id comes
    repeatedly, its smallest vector is asked; repeated candidate rows all count. Empty tables give an empty one, other columns are ignored. Components so large that
    a score could leave 64 bits are refused with a ValueError: no vector is left out.

    Vectors are dealt into shards of about ``SHARD`` rows and queries into blocks of about ``QUERIES``; each shard meets each block in
    a task of its own, where MaxScore finds the shard's best. Shards' winners, ``top`` a query at most, are merged by a
    window that Spark limits before it shuffles.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long"), "vector")
    queries = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min("vector").alias("vector")
    )
    # Sums over all dimensions of a product of two components, or of one and a spread of twice the largest, must fit into 64 bits.
    sizes = vectors.union(queries).agg(F.max(F.size("vector")), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    dims, largest = sizes[0] or 0, max(abs(sizes[1] or 0), abs(sizes[2] or 0))
    if 2 * dims * largest ** 2 >= 1 << 62:
        raise ValueError(f"scores of {dims} components up to {largest} do not fit into 64 bits")
    shards, blocks = -(-vectors.count() // SHARD) or 1, -(-queries.count() // QUERIES) or 1

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")

    asked = queries.withColumn("block", dealt(blocks)).withColumn("shard", every(shards))
    held = vectors.withColumn("shard", dealt(shards)).withColumn("block", every(blocks))
    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(
        _searching(top), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
