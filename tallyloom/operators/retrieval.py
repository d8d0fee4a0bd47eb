"""Exact vector search and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.stats import dot, l2_normalise, ratio
from tallyloom.functions.text import cut
from tallyloom.operators.evaluation import rate
from tallyloom.session import ship
from tallyloom.sources.stores import KeyedStore

OVERFETCH, CEILING = 12, 2000


def hashing_vector(text: Column, dims: int = 64) -> Column:
    """V01's default encoder: words hashed into signed dimensions, unit length. Deterministic; real encoders come as pandas UDFs."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    h = F.transform(words, lambda w: F.xxhash64(w))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(F.pmod(x, F.lit(dims)) == d, F.when(x > 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return l2_normalise(v)


class Encoder(Protocol):
    """What encodes texts in a worker: anything that makes an array of one vector for each text."""

    def encode(self, texts: list[str], batch_size: int): ...


def encode_texts(texts: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = 64, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """(id, embedding array<float>) of every row, unit length (a zero vector stays one); null texts are encoded as empty ones.

    make_encoder is called once for each worker's stream of batches, not for each batch. Raises if an encoder gives another number of vectors than it got texts:
    a text is never paired with a neighbour's vector.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for rows in batches:
            encoder = encoder or make_encoder()
            for start in range(0, len(rows), batch_size):
                part = rows.iloc[start : start + batch_size]
                made = np.asarray(encoder.encode(part["text"].fillna("").tolist(), batch_size), np.float64)
                if made.ndim != 2 or len(made) != len(part):
                    raise ValueError(f"{len(part)} texts, but the encoder's answer has the shape {made.shape}")
                unit = (made / np.maximum(np.linalg.norm(made, axis=1), 1e-12)[:, None]).astype(np.float32)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(unit)})

    ship(texts.sparkSession)
    plain = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = plain.mapInPandas(scan, T.StructType([T.StructField("id", texts.schema[id_col].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    return made.withColumnRenamed("id", id_col)


def embed_reviews(reviews: DataFrame, make_encoder: Callable[[], Encoder], order: str, store: KeyedStore | None = None, batch_size: int = 64, version: int = 1) -> DataFrame:
    """Reviews (review_id, review_text and more) with `embedding`, in the caller's order; what the store has isn't encoded again.

    store: a KeyedStore with the key review_id and the value embedding. Rows of one id get one vector, that of its first text in the order.
    """
    texts = reviews.groupBy("review_id").agg(F.min_by("review_text", order).alias("review_text"))
    if store is None:
        return reviews.join(encode_texts(texts, make_encoder, batch_size), "review_id").orderBy(order)
    store.add(encode_texts(store.missing(texts), make_encoder, batch_size), version)
    return store.lookup(reviews, order)


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product with one query; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", dot(F.col(vector_col), q)).orderBy(F.desc("score"), id_col).limit(k)


def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A flat index: every vector as it is, with its norm, sorted by id in each file; returns it as loaded.

    Raises ValueError if a vector is null, holds null or NaN, or differs in length from the others.
    """
    v = F.col(vector_col)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    seen = vectors.agg(F.count_if(bad).alias("bad"), F.min(F.size(v)).alias("short"), F.max(F.size(v)).alias("long")).first()
    if seen.bad or seen.short != seen.long:
        raise ValueError(f"{seen.bad} vectors without a value, lengths {seen.short} to {seen.long}")
    vectors.withColumn("norm", F.sqrt(dot(v, v))).sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)
    return load_index(vectors.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """An index for top_k, search and search_many."""
    return spark.read.parquet(path)


def candidates(k: int) -> int:
    return min(CEILING, max(OVERFETCH * k, k))


def search(vectors: DataFrame, query: list[float], k: int = 8, where: Column | None = None, prefilter: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rank, cut to the candidates, filter, keep the first k. `truncated` says that filters left fewer than k. prefilter filters first (a different operator)."""
    if not query:
        raise ValueError("empty query")
    if prefilter and where is not None:
        vectors = vectors.where(where)
    got = top_k(vectors, query, candidates(k), id_col, vector_col)
    if where is not None and not prefilter:
        got = got.where(where)
    hits = got.orderBy(F.desc("score"), id_col).limit(k)
    return hits.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) < k)  # over k rows


def post_filter(exclude: list | None = None, areas: list[str] | None = None, severities: list[str] | None = None, window: bool | None = None, id_col: str = "review_id") -> Column:
    """The filters of a search as one predicate: ids to leave out, areas (any of `product_areas`), severities, the comparable window."""
    keep = F.lit(True)
    if exclude:
        keep = keep & ~F.col(id_col).isin(exclude)
    if areas:
        keep = keep & F.coalesce(F.arrays_overlap("product_areas", F.array(*map(F.lit, areas))), F.lit(False))
    if severities:
        keep = keep & F.coalesce(F.col("severity").isin(severities), F.lit(False))
    return keep if window is None else keep & F.col("in_comparable_window").eqNullSafe(window)


def pain_point_query(area: str, issue: str) -> str:
    """The query text of a pain point."""
    return f"{area} {issue}".replace("_", " ").strip()


def evidence_block(hits: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """one text of citations, best first."""
    line = F.concat(F.lit("["), F.col(id_col).cast("string"), F.lit("] "), cut(F.col(text_col)))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"), line.alias("l")))), lambda x: x.l), "\n").alias("block"))


def search_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, score, rank): for a bounded set of queries (query, qv; a row for each area), broadcast; one scan of the vectors.

    Every partition keeps its k best rows of each query before they meet (the window's group limit).
    """
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).crossJoin(F.broadcast(queries))
    d = d.select("query", "id", dot(F.col("v"), F.col("qv")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k)


def evaluate_retrieval(vectors: DataFrame, queries: DataFrame, members: DataFrame, k: int = 8, min_support: int = 50, **cols) -> DataFrame:
    """Unfiltered precision at k for each query area with enough members. members: (area, id); queries: (query = area, qv)."""
    m = members.distinct()
    corpus = m.agg(F.count_distinct("id").alias("_c"))
    support = m.groupBy("area").agg(F.count_distinct("id").alias("support")).where(F.col("support") >= min_support)
    asked = queries.join(F.broadcast(support.select(F.col("area").alias("query"))), "query", "left_semi")
    hits = search_many(vectors, asked, k, **cols).join(m.select(F.col("area").alias("query"), "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    g = hits.groupBy(F.col("query").alias("area")).agg(F.count("*").alias("retrieved"), F.count("hit").alias("relevant"))
    d = g.join(support, "area").crossJoin(F.broadcast(corpus))
    p, low, high = rate(F.col("relevant"), F.col("retrieved"))
    d = d.withColumns({"precision_at_k": p, "ci_low": low, "ci_high": high, "base_rate": ratio(F.col("support"), F.col("_c"))}).drop("_c")
    return d.withColumns({"lift": F.try_divide("precision_at_k", F.nullif("base_rate", F.lit(0.0))), "beats_base_rate": F.coalesce(F.col("ci_low") > F.col("base_rate"), F.lit(False))})


def retrieval_summary(e: DataFrame) -> DataFrame:
    """Pooled over hits."""
    p, low, high = rate(F.sum("relevant"), F.sum("retrieved"))
    return e.agg(F.count("*").alias("areas_evaluated"), p.alias("pooled_precision"), low.alias("ci_low"), high.alias("ci_high"), F.avg("base_rate").alias("mean_base_rate"), F.avg("lift").alias("mean_lift"), F.count_if("beats_base_rate").alias("areas_beating_base_rate"), F.min_by("area", F.struct("precision_at_k", "area")).alias("weakest_area"))
