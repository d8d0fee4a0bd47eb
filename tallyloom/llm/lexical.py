"""Ranked lexical search by sort-based accumulation (operator 13).

A query item is matched with whole documents, term by term. One scan counts each document's terms and keeps, of those that some item has,
how often it has them; document frequencies and lengths are sums over that table, which a second scan then ranks. There
every match of an item's term in a document is an impact under the packed key (item, document). Documents are dealt out by their
place in the scan, so a key is met in one block only: its impacts are concatenated, radix-sorted by key and summed with reduceat. Each task
keeps the k best documents of every item on a heap, and the tasks' heaps are merged.

Scores are 64-bit integers, so that they don't depend on the order of summation: a term of a frequency df among N documents weighs
floor(1000 ln((2N + 2) / (2 df + 1))), and a document of n terms, of L in all, gets from a term that it has tf times the weight
times (10^9 tf) div (1000 tf + 12 m), m being 100 - 25 + (25 n N) div L.

Items are taken as passes of at most PASS_BYTES of text, the terms and items of a pass being what is broadcast. Each pass scans the documents.

Defined results: a null text has no terms, nor has one of separators alone; such a document counts neither in N nor in L and is
ranked nowhere; an item without terms, or whose terms are in no document, gets no row; rows with one item id are one item, with the terms of them
all; further rows with one document id are further documents; equal scores go by ascending id, a null id (of an item or a
document) being an id that stands last; an empty table gives an empty table; input columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.blocks import pieces
from tallyloom.session import ship
from tallyloom.storage import Workspace

#: Text of the items that are broadcast at once, and impacts that are sorted at once (one document may have more).
PASS_BYTES, BLOCK = 8 << 20, 2 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable ascending order of unsigned keys, by digits of 16 bits from the least to the greatest."""
    order = None
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():  # else this digit has its order already
            step = np.argsort(digit, kind="stable")  # numpy sorts 16 bits by radix
            order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def accumulate(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's impacts."""
    if not len(keys):
        return keys, impacts
    order = radix_order(keys)
    keys, impacts = keys[order], impacts[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edge], np.add.reduceat(impacts, edge)


class Items:
    """The items of a pass by term: item numbers and how often each has the term, in one array with an edge for each term."""

    def __init__(self, items: list[tuple[object, str | None]]):
        own: dict[object, Counter] = {}
        for item, text in items:
            own.setdefault(item, Counter()).update(terms_of((text or "").encode()))
        self.ids = list(own)
        self.number = {t: i for i, t in enumerate(sorted({t for c in own.values() for t in c}))}
        held = sorted((self.number[t], i, n) for i, c in enumerate(own.values()) for t, n in c.items())
        term, self.item, self.times = (np.array([h[k] for h in held], np.int64) for k in range(3))
        self.edge = np.searchsorted(term, np.arange(len(self.number) + 1))


def _pack(rows: list[tuple[object, int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    edge = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), *lists], names=["id", "n", "terms", "tf"])


def _matches(docs: DataFrame, shared, kind: str) -> DataFrame:
    """(id, n, terms, tf): of each document with terms its number of terms, and which of the items' it has, how often."""

    def scan(batches):
        number = shared.value.number
        for rows, texts in pieces(batches, "text"):
            ids, out = rows.column(0).to_pylist(), []
            for doc, text in zip(ids, texts, strict=True):
                words = terms_of(text)
                if words:
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    out.append((doc, len(words), np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
            if out:
                yield _pack(out, rows.schema.field(0).type)

    return docs.mapInArrow(scan, f"id {kind}, n long, terms array<int>, tf array<int>")


def _document_frequencies(matches: DataFrame, size: int) -> np.ndarray:
    """How many documents have each of the pass's `size` terms: a row a term from each task, summed."""

    def count(batches):
        held = np.zeros(size, np.int64)
        for rows in batches:
            held += np.bincount(rows.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in matches.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def _blocks(n_impacts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of documents with about BLOCK impacts, at least one document each."""
    start, held = 0, 0
    for i, n in enumerate(n_impacts.tolist()):
        if held and held + n > BLOCK:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(n_impacts):
        yield start, len(n_impacts)


def _rank(batches, shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item number, score, id) of the k best documents that this task sees, for each item."""
    items = shared.value
    heaps: list[list] = [[] for _ in items.ids]
    floor = np.zeros(len(items.ids), np.int64)  # what a document needs to come onto an item's heap
    impact_of = weights * items.times
    kind = None
    for rows in batches:
        kind = rows.schema.field(0).type
        lengths, terms, tf = rows.column(1).to_numpy(), rows.column(2), rows.column(3)
        own = np.diff(terms.offsets.to_numpy())
        term, times = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows), own)
        m = 75 + (25 * lengths * n_docs) // n_terms
        part = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
        fan = items.edge[term + 1] - items.edge[term]
        n_impacts = np.bincount(doc, fan, rows.num_rows).astype(np.int64)
        first = np.r_[0, np.cumsum(own)]
        for a, z in _blocks(n_impacts):
            at = slice(first[a], first[z])
            n = fan[at]
            if not n.sum():
                continue
            entry = np.arange(n.sum()) + np.repeat(items.edge[term[at]] - (np.cumsum(n) - n), n)
            keys = items.item[entry].astype(np.uint64) << np.uint64(32) | np.repeat(doc[at], n).astype(np.uint64)
            keys, sums = accumulate(keys, impact_of[entry] * np.repeat(part[at], n))
            item = (keys >> np.uint64(32)).astype(np.int64)
            good = np.flatnonzero((sums > 0) & (sums >= floor[item]))
            if not len(good):
                continue
            item, sums, row = item[good], sums[good], (keys[good] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ids = rows.column(0).take(pa.array(row)).to_pylist()
            edge = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(item)], strict=True):
                x = int(item[i])
                heaps[x] = heapq.nsmallest(k, [*heaps[x], *((-s, d is None, d) for s, d in zip(sums[i:j].tolist(), ids[i:j], strict=True))], key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
                if len(heaps[x]) == k:
                    floor[x] = -heaps[x][-1][0]
    if kind is not None:
        out = [(x, -s, d) for x, heap in enumerate(heaps) for s, _, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind)], names=["item", "score", "id"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of every item, the highest score first."""
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "lexical")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    passes = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    found = None
    for p in range(passes):
        mine = Items([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()])
        shared = spark.sparkContext.broadcast(mine)
        matches = ws.cut(_matches(plain, shared, kind))
        n_docs, n_terms = matches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not mine.number:
            ws.drop(matches)
            continue
        df = _document_frequencies(matches, len(mine.number))
        weights = np.repeat(np.array([weight(n_docs, int(x)) for x in df], np.int64), np.diff(mine.edge))

        def rank(batches, shared=shared, weights=weights, n_docs=n_docs, n_terms=n_terms):
            return _rank(batches, shared, weights, n_docs, n_terms, k)

        best = matches.mapInArrow(rank, f"item int, score long, id {kind}")
        names = spark.createDataFrame(list(enumerate(mine.ids)), f"item int, item_id {item_kind}")
        best = ws.cut(best.join(F.broadcast(names), "item").select("item_id", "score", "id"))  # names are the pass's items
        ws.drop(matches)
        shared.unpersist()
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
