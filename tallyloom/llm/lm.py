"""Language-model scoring with stupid backoff, as joins between n-grams and their counts (operator 9).

Every chunk of documents explodes into its distinct n-grams with their counts there; the count tables, partitioned by hash,
sum them over all chunks; joined back to the n-grams of each chunk, they give each token its score, and tokens are summed per
document. From order 3 on, only n-grams whose two parts are frequent enough are counted: the others can't be. S(w | context) = count(context w) / count(context) if the n-gram was seen at least
`least` times, else BACKOFF * S(w | shorter context); for a single word count(w) / all tokens. Counts include the document's own.

Words are runs of other than white space, lower-cased. n-grams meet by hashes of 64 bits, whatever the size of the corpus.

Defined results: null, empty or blank text has no tokens, score 0 and a null mean; repeated rows count as often as they are there; an
empty table gives an empty table; input columns other than id and text are dropped.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.llm.exchange import Chunks, unpack_batch

BACKOFF = 0.4
#: Text to a chunk, at least: a larger chunk asks about an n-gram less often, and takes more memory.
CHUNK_BYTES = 14 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[bytes], order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n = 1..order (n-gram i of the n-th list ends at word i+n-1)."""
    h = np.fromiter(map(xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
    out, last = [h], h
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            last = (last[:-1] * _MIX + np.uint64(n)) ^ h[n - 1 :] if len(last) else last
            last = last ^ (last >> np.uint64(31))
            last = last * np.uint64(0xBF58476D1CE4E5B9)
            out.append(last)
        return [x ^ (x >> np.uint64(29)) for x in out]


def joined_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours of h, in order."""
    last = h
    for k in range(2, n + 1):
        last = (last[:-1] * _MIX + np.uint64(k)) ^ h[k - 1 :] if len(last) else last
        last = last ^ (last >> np.uint64(31))
        last = last * np.uint64(0xBF58476D1CE4E5B9)
    return last ^ (last >> np.uint64(29))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Grams:
    """The n-grams of a chunk, none across rows: for each order the distinct hashes, each occurrence's number among them, and counts."""

    def __init__(self, table: pa.Table, order: int):
        self.words = [tokens(t) for t in table.column("text").to_pylist()]
        self.size = np.array([len(w) for w in self.words])
        self.begin = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(self.words)), self.size)
        flat = [w for ws in self.words for w in ws]
        self.hashes = gram_hashes(flat, order)
        self.words = None

    def inside(self, n: int) -> np.ndarray:
        """Where an n-gram that begins there lies in one row."""
        m = max(0, len(self.row) - n + 1)
        return self.row[:m] == self.row[n - 1 :] if m else np.empty(0, bool)

    def kinds(self, n: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the n-grams, ascending distinct hashes, number of each place's hash)."""
        at = np.flatnonzero(self.inside(n) if where is None else where)
        return at, *np.unique(self.hashes[n - 1][at], return_inverse=True)

    def frequent(self, n: int, got: dict, buckets: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the n-grams at each place, 0 if rare; where an (n+1)-gram may be frequent), from the answers."""
        counts = np.zeros(len(self.row), np.int64)
        where = None if n <= 2 else self._maybe
        at, keys, number = self.kinds(n, where)
        if n in got and len(at):
            counts[at] = got[n].on(keys, buckets)[number]
        m = max(0, len(self.row) - n)
        often = counts >= least
        self._maybe = self.inside(n + 1) & often[:m] & often[1 : m + 1]
        return counts, self._maybe


def score_documents(docs: DataFrame, order: int = 3, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_score, mean_log_score, n_backoffs) for each row of docs."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = Chunks(kept, "lm", least_bytes=CHUNK_BYTES)
    kind = kept.schema["id"].dataType.simpleString()
    buckets = chunks.buckets

    def asked(g: Grams, n: int, where=None):
        _, keys, number = g.kinds(n, where)
        return n, keys, np.bincount(number, minlength=len(keys))

    def short(table, got):
        g = Grams(table, min(order, 2))
        for n in range(1, min(order, 2) + 1):
            yield asked(g, n)

    def longer(n):
        def explode(table, got):
            # an n-gram can't be there oftener than what it begins and ends with
            g = Grams(table, n)
            for k in range(2, n):
                _, maybe = g.frequent(k, got, buckets, least)
            yield asked(g, n, maybe)

        return explode

    def count(n, keys, values):
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(values), len(every)).astype(np.int64)
        enough = total >= (least if n > 1 else 1)
        for part in np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]):
            at = np.flatnonzero(enough[part])
            yield at, total[part][at]

    answers = chunks.ws.cut(chunks.ask(short, count, by_place=True))
    chunks.ws.release()
    for n in range(3, order + 1):
        answers = answers.unionByName(chunks.ws.cut(chunks.ask(longer(n), count, answers, by_place=True)))
        chunks.ws.release()
    n_all = chunks.ws.cut(chunks.frame.mapInArrow(_count_tokens, "n long")).agg(F.sum("n")).first()[0] or 1

    def read(table, got):
        g = Grams(table, order)
        ids, m = table.column("id").to_pylist(), len(g.row)
        counts, _ = g.frequent(1, got, buckets, least)
        logp, used = np.log(np.maximum(counts, 1) / n_all), np.zeros(m, np.int64)
        for n in range(2, order + 1):
            context = counts
            counts, _ = g.frequent(n, got, buckets, least)
            begin = np.flatnonzero(g.inside(n))
            seen, end = counts[begin] >= least, begin + n - 1
            logp[end] = np.where(seen, np.log(np.maximum(counts[begin], 1) / np.maximum(context[begin], 1)), logp[end] + np.log(BACKOFF))
            used[end] = np.where(seen, 0, used[end] + 1)
        total, backoffs = (np.bincount(g.row, x, len(ids)) if m else np.zeros(len(ids)) for x in (logp, used))
        mean = [t / n if n else None for t, n in zip(total.tolist(), g.size.tolist(), strict=True)]
        return pd.DataFrame({"id": ids, "n_tokens": g.size, "log_score": total, "mean_log_score": mean, "n_backoffs": backoffs.astype(np.int64)})

    out = chunks.hear(answers, read, f"id {kind}, n_tokens long, log_score double, mean_log_score double, n_backoffs long")
    return out.withColumnRenamed("id", id_col)


def _count_tokens(batches):
    for batch in batches:
        for row in batch.to_pylist():
            n = sum(len(tokens(t)) for t in unpack_batch(row["blob"]).column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def brute_force(texts: list[str | None], order: int = 3, least: int = 2) -> list[tuple[int, float, int]]:
    """(n_tokens, log_score, n_backoffs) of each text, by counting n-grams as tuples."""
    from collections import Counter
    from math import log

    split = [tokens(t) for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, split))
    out = []
    for w in split:
        s, backoffs = 0.0, 0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n > 1 and counts[n - 1][tuple(w[i - n + 1 : i + 1])] < least:
                n, s, backoffs = n - 1, s + log(BACKOFF), backoffs + 1
            c = counts[n - 1][tuple(w[i - n + 1 : i + 1])]
            s += log(c / (counts[n - 2][tuple(w[i - n + 1 : i])] if n > 1 else total))
        out.append((len(w), s, backoffs))
    return out
