"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 7).

A term is a dimension of the vectors. A block of candidate rows is held as postings: for each term, the rows that have it
and their weights. The sparse queries of a block are taken term by term: each query's weight, times the postings,
is scattered into that query's dense array of scores. Partition selection keeps each block's k best; blocks then merge.

Defined results: a row whose vector or id is null, or whose vector has null or non-finite components, takes no part; an empty vector
scores 0 with every row; vectors of other lengths are compared on the terms that they share; rows with the query's own id
are no candidates; further rows with one id are further candidates, and queries of one id are one query, its best rows
being taken over all its vectors; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import ship
from tallyloom.storage import Workspace

#: Weights of queries that are broadcast at once (each block of queries is a scan of the candidates), candidates and queries to a dense array.
QUERY_WEIGHTS, ROW_BLOCK, TILE = 1 << 20, 1024, 128


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, terms): each component x as floor(scale * x), x as double; rows that take no part are left out."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(False))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("terms"))


class Postings:
    """A block of rows, by term."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(ids)), size)
        term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)
        held = values != 0
        row, term, values = row[held], term[held], values[held]
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order], values[order]
        self.edge = np.searchsorted(term[order], np.arange((term.max() if len(term) else -1) + 2))

    def scores(self, query_terms: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Dense scores of n queries; query_terms has, for each term, the queries that hold it and their weights."""
        terms = min(len(query_terms), len(self.edge) - 1)
        most = max((int(np.abs(w).max()) for _, w in query_terms[:terms] if len(w)), default=0) * int(np.abs(self.weight).max() if len(self.weight) else 0) * max(terms, 1)
        kind = np.int32 if most < 1 << 31 else np.int64  # no sum can be larger
        out, room = np.zeros((n, len(self.ids)), kind), np.empty((n, len(self.ids)), kind)
        held = self.weight.astype(kind)
        for t, (queries, weights) in enumerate(query_terms[:terms]):
            a, b = self.edge[t], self.edge[t + 1]
            if a == b or not len(queries):
                continue
            if 4 * len(queries) * (b - a) > n * len(self.ids):  # most are held: the others count as weights of zero
                own, posted = np.zeros(n, kind), np.zeros(len(self.ids), kind)
                own[queries], posted[self.row[a:b]] = weights, held[a:b]
                np.multiply(own[:, None], posted, out=room)
                out += room
            else:
                out[queries[:, None], self.row[a:b]] += weights.astype(kind)[:, None] * held[a:b]
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _by_term(queries: list[tuple[int, list[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in range(max((len(v) for _, v in queries), default=0)):
        held = [(i, v[t]) for i, (_, v) in enumerate(queries) if t < len(v) and v[t]]
        out.append((np.array([i for i, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
    return out


class Best:
    """The k best candidates that a task has seen, for each query of a tile; what is worse than a query's k-th isn't looked at."""

    def __init__(self, queries: list[tuple[int, list[int]]], k: int):
        self.ids, self.k, self.by_term = np.array([q for q, _ in queries], np.int64), k, _by_term(queries)
        self.least = np.full(len(queries), np.iinfo(np.int64).min)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)

    def see(self, postings: Postings) -> None:
        scores = postings.scores(self.by_term, len(self.ids))
        good = scores >= self.least[:, None]
        for i in np.flatnonzero(np.isin(self.ids, postings.ids)).tolist():
            good[i] &= postings.ids != self.ids[i]
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            at = np.flatnonzero(good[i])
            ids, found = np.r_[self.held[i][0], postings.ids[at]], np.r_[self.held[i][1], scores[i, at].astype(np.int64)]
            keep = best(found, ids, self.k)
            self.held[i] = (ids[keep], found[keep])
            if len(keep) == self.k:
                self.least[i] = found[keep[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(ids) for ids, _ in self.held]
        return np.repeat(self.ids, n), np.concatenate([x for x, _ in self.held]), np.concatenate([x for _, x in self.held])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query. vectors: (vec_id, terms array<long>).

    Queries are taken as many at a time as have QUERY_WEIGHTS weights, and broadcast; candidates stay where they are scanned, and each
    task sends k rows a query to the merge.
    """
    spark = vectors.sparkSession
    ship(spark)
    ws = Workspace(spark, "topk")
    vectors = ws.cut(vectors)
    queries = vectors.where(is_query)
    weights = queries.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    blocks = -(-weights // QUERY_WEIGHTS)
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(blocks):
        part = [(r.vec_id, r.terms) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            own = shared.value
            tiles = [Best(own[i : i + TILE], k) for i in range(0, len(own), TILE)]
            for batch in batches:
                for start in range(0, batch.num_rows, ROW_BLOCK):
                    rows = batch.slice(start, ROW_BLOCK)
                    terms = rows.column(1)
                    postings = Postings(rows.column(0).to_numpy(), terms.flatten().to_numpy(), terms.offsets.to_numpy().astype(np.int64))
                    for tile in tiles:
                        tile.see(postings)
            for tile in tiles:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in tile.rows()], names=["query_id", "vec_id", "score"])

        found = found.unionByName(ws.cut(vectors.mapInArrow(scan, "query_id long, vec_id long, score long")))
        shared.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
