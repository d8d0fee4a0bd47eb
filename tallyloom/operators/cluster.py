"""Clustering of vectors: choice of k by silhouette, fit, exemplars, summary."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import dot, l2_normalise
from tallyloom.session import ship
from tallyloom.storage import Workspace

log = logging.getLogger(__name__)


#: Vectors that are compared with all centres at once.
BLOCK_ROWS = 512


@dataclass(frozen=True)
class ClusterChoice:
    k: int
    silhouette: float
    scores: dict[int, float]
    centres: np.ndarray


class Centres:
    """The centres of many k-means models: model m has starts[m] as its first row, starts[m + 1] as the one behind its last."""

    def __init__(self, models: list[np.ndarray]):
        self.all = np.concatenate(models)
        self.starts = np.cumsum([0, *(len(m) for m in models)])

    def nearest(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(model, each row's cluster, its squared distance) for every model."""
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.all.T) + (self.all * self.all).sum(axis=1)
        for m, (a, z) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            own = far[:, a:z].argmin(axis=1)
            yield m, own, np.maximum(far[np.arange(len(x)), a + own], 0)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that have an id and a vector, unit length."""
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return Workspace(vectors.sparkSession, "vectors").cut(usable.select(F.col(id_col).alias("id"), l2_normalise(F.col(vector_col)).alias("v")))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def _blocks(batches, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their vectors), BLOCK_ROWS at most: what is made of a block has a number for each row and centre, however large Spark's batches are."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(start, BLOCK_ROWS)
            yield rows, _matrix(rows.column(column), rows.num_rows)


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each chosen with a probability that grows with the squared distance to those before (k-means++)."""
    at = [int(rng.integers(len(x)))]
    far = ((x - x[at[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = far.sum()
        at.append(int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _sums(d: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows of each cluster, sum of each cluster's vectors, cost) of every model, from one scan: a row a model from each task, then one in all."""
    spark = d.sparkSession
    shared = spark.sparkContext.broadcast(Centres(models))

    def scan(batches):
        centres, out = shared.value, {}
        for _, x in _blocks(batches):
            for m, own, far in centres.nearest(x):
                k = centres.starts[m + 1] - centres.starts[m]
                n, total, cost = out.setdefault(m, [np.zeros(k), np.zeros((k, x.shape[1])), 0.0])
                n += np.bincount(own, minlength=k)
                total += (np.arange(k)[:, None] == own).astype(float) @ x
                out[m][2] = cost + float(far.sum())
        if out:
            packed = [(m, n.tobytes(), total.tobytes(), cost) for m, (n, total, cost) in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["model", "n", "total", "cost"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes()
        return pd.DataFrame([(pdf["model"].iloc[0], add("n"), add("total"), pdf["cost"].sum())], columns=["model", "n", "total", "cost"])

    schema = "model int, n binary, total binary, cost double"
    found = {r.model: r for r in d.select("v").mapInArrow(scan, schema).groupBy("model").applyInPandas(merge, schema).collect()}  # a row for each model
    shared.unpersist()
    return [(np.frombuffer(found[m].n), np.frombuffer(found[m].total).reshape(len(c), -1), found[m].cost) for m, c in enumerate(models)]


def fit_all(d: DataFrame, ks: list[int], seed: int = 42, inits: int = 10, iterations: int = 20, sample: int = 10_000) -> dict[int, np.ndarray]:
    """The centres of the best by cost of `inits` k-means models for each k, all fitted to all of d (id, v) at once.

    Every iteration is one scan, whatever the number of models: what is broadcast, and comes back, is a row for each of their clusters. Starts
    are chosen (k-means++) from the first `sample` vectors by a hash of the id. A cluster that loses all its vectors keeps its centre.
    """
    ship(d.sparkSession)
    some = np.array([r.v for r in d.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").collect()], np.float64)
    kinds = len(np.unique(some, axis=0))
    models, of = [], []
    for k in ks:
        for i in range(inits):
            models.append(_start(some, min(k, kinds), np.random.default_rng([seed, k, i])))
            of.append(k)
    cost = None
    for _ in range(iterations):
        made = _sums(d, models)
        models = [np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old) for (n, total, _), old in zip(made, models, strict=True)]
        before, cost = cost, np.array([c for _, _, c in made])
        if before is not None and np.all(before - cost <= 1e-9 * np.maximum(1, cost)):
            break
    cost = [c for _, _, c in _sums(d, models)]
    return {k: models[min((m for m in range(len(models)) if of[m] == k), key=lambda m: (cost[m], m))] for k in ks}


def assign(d: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster) of all of d (id, v), the first of equally near centres."""
    ship(d.sparkSession)
    held = Centres([centres])

    def scan(batches):
        for rows, x in _blocks(batches, 1):
            _, own, _ = next(held.nearest(x))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own.astype(np.int32))], names=["id", "cluster"])

    return d.select("id", "v").mapInArrow(scan, f"id {d.schema['id'].dataType.simpleString()}, cluster int")


def _silhouettes(d: DataFrame, models: list[np.ndarray]) -> list[float]:
    """The mean cosine silhouette over all vectors for every model, from two scans: by what the sum of a cluster's unit vectors says of all distances to it."""
    sums = _sums(d, models)
    shared = d.sparkSession.sparkContext.broadcast((Centres(models), [(n, total) for n, total, _ in sums]))

    def scan(batches):
        centres, clusters = shared.value
        got, rows_seen = np.zeros(len(clusters)), 0
        for _, x in _blocks(batches):
            for m, own, _ in centres.nearest(x):
                got[m] += silhouette_of(x, own, *clusters[m]).sum()
            rows_seen += len(x)
        if rows_seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), pa.array(got), pa.array([rows_seen] * len(got), pa.int64())], names=["model", "s", "n"])

    made = d.select("v").mapInArrow(scan, "model int, s double, n long").groupBy("model").agg((F.sum("s") / F.sum("n")).alias("s"))
    found = {r.model: r.s for r in made.collect()}
    return [found[m] if (sums[m][0] > 0).sum() > 1 else -1.0 for m in range(len(models))]


def silhouette_of(x: np.ndarray, own: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Cosine silhouettes of unit vectors x in clusters own, given the rows and the sum of the vectors of each cluster; 0 in a cluster of one."""
    far = n - x @ total.T  # the sum of the cosine distances to each cluster's vectors, itself at 0 included
    at = np.arange(len(x))
    a = (far[at, own] - (1 - (x * x).sum(axis=1))) / np.maximum(n[own] - 1, 1)
    mean = np.where(n > 0, far / np.maximum(n, 1), np.inf)
    mean[at, own] = np.inf
    b = mean.min(axis=1)
    return np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def silhouette(vectors: DataFrame, assigned: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """(cluster, size, silhouette): the mean cosine silhouette of each cluster's vectors, over all of them.

    Two passes: the sums of the clusters' unit vectors, a row for each cluster and dimension; then each vector against them.
    """
    d = vectors.select(id_col, l2_normalise(F.col(vector_col)).alias("v")).join(assigned.select(id_col, cluster_col), id_col)
    dims = d.select(cluster_col, F.posexplode("v").alias("i", "x")).groupBy(cluster_col, "i").agg(F.sum("x").alias("x"))
    centre = dims.groupBy(cluster_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("total"))
    centre = centre.join(d.groupBy(cluster_col).agg(F.count("*").alias("n")), cluster_col)
    every = centre.agg(F.collect_list(F.struct(F.col(cluster_col).alias("c"), "n", "total")).alias("every"))  # a row for each cluster, as one
    seen = d.crossJoin(F.broadcast(every))
    own = F.filter("every", lambda e: e.c == F.col(cluster_col))[0]
    a = (own.n - dot(F.col("v"), own.total) - (1 - dot(F.col("v"), F.col("v")))) / (own.n - 1)
    b = F.array_min(F.transform(F.filter("every", lambda e: e.c != F.col(cluster_col)), lambda e: 1 - dot(F.col("v"), e.total) / e.n))
    s = seen.select(cluster_col, F.when(own.n > 1, a).alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.groupBy(cluster_col).agg(F.count("*").alias("size"), F.avg(value).alias("silhouette"))


def choose_k(vectors: DataFrame, low: int = 3, high: int = 24, seed: int = 42, inits: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> ClusterChoice:
    """The k of the best cosine silhouette over all vectors; -1 where k is degenerate; first of equals. Every k from `inits` starts."""
    d = unit_vectors(vectors, id_col, vector_col)
    ks = list(range(low, min(high, d.count() - 1) + 1))
    if not ks:
        raise ValueError("too few vectors to cluster")
    centres = fit_all(d, ks, seed, inits)
    scores = dict(zip(ks, _silhouettes(d, [centres[k] for k in ks]), strict=True))
    best = max(scores, key=lambda k: (scores[k], -k))
    return ClusterChoice(best, scores[best], scores, centres[best])


def fit_clusters(vectors: DataFrame, low: int = 3, high: int = 24, seed: int = 42, inits: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[ClusterChoice, DataFrame]:
    """(choice, (id, cluster) of all vectors); warns if the best k is at an end of the range."""
    choice = choose_k(vectors, low, high, seed, inits, id_col, vector_col)
    if choice.k in (low, high):
        log.warning("best k %d is at an end of %d..%d", choice.k, low, high)
    return choice, assign(unit_vectors(vectors, id_col, vector_col), choice.centres).withColumnRenamed("id", id_col)


def exemplars(vectors: DataFrame, assigned: DataFrame, n: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", cluster_col: str = "cluster") -> DataFrame:
    """The n vectors of each cluster nearest to its centroid by cosine: (cluster, exemplar_rank, id, similarity)."""
    d = vectors.select(id_col, l2_normalise(F.col(vector_col)).alias("v")).join(assigned.select(id_col, cluster_col), id_col)
    dims = d.select(cluster_col, F.posexplode("v").alias("i", "x")).groupBy(cluster_col, "i").agg(F.avg("x").alias("x"))
    centre = dims.groupBy(cluster_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))  # a row for each cluster
    scored = d.join(F.broadcast(centre), cluster_col).select(cluster_col, id_col, dot(F.col("v"), l2_normalise(F.col("c"))).alias("similarity"))
    order = Window.partitionBy(cluster_col).orderBy(F.desc(F.round("similarity", 12)), id_col)
    return scored.withColumn("exemplar_rank", F.row_number().over(order)).where(F.col("exemplar_rank") <= n)


def most_common(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    n = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_n"))
    return n.groupBy(by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(out))


def cluster_summary(assigned: DataFrame, facts: DataFrame, id_col: str, cluster_col: str = "cluster", labels: DataFrame | None = None, vectors: DataFrame | None = None, n_exemplars: int = 3) -> DataFrame:
    """Size, share, mean severity, escalation, negativity, rating, top platform; with labels the dominant area and issue, with vectors (id, embedding) the
    ids of the exemplars, nearest first."""
    from tallyloom.functions.score import severity_rank

    d = assigned.join(facts, id_col)
    total = d.agg(F.count("*").alias("_t"))
    g = d.groupBy(cluster_col).agg(
        F.count("*").alias("size"), F.avg(severity_rank(F.col("severity"))).alias("mean_severity"), F.avg(F.col("support_escalation").cast("double")).alias("escalation_rate"),
        F.avg((F.col("sentiment") == "negative").cast("double")).alias("negative_share"), F.avg("rating").alias("mean_rating"),
    )
    g = g.crossJoin(F.broadcast(total)).withColumn("share", F.col("size") / F.col("_t")).drop("_t").join(most_common(d, cluster_col, "platform", "top_platform"), cluster_col, "left")
    if labels is not None:
        lab = assigned.join(labels, id_col)
        for column, out in (("product_area", "dominant_area"), ("issue_type", "dominant_issue")):
            g = g.join(most_common(lab, cluster_col, column, out), cluster_col, "left")
    if vectors is not None:
        near = exemplars(vectors, assigned, n_exemplars, id_col, cluster_col=cluster_col).groupBy(cluster_col).agg(F.array_sort(F.collect_list(F.struct("exemplar_rank", id_col))).alias("_e"))
        g = g.join(near.select(cluster_col, F.transform("_e", lambda x: x[id_col]).alias("exemplars")), cluster_col, "left")
    return g
