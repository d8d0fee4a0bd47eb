"""Benchmark decontamination by Wu-Manber search (operator 10).

Benchmark items become windows of words; the windows, as byte strings with one space around every word, are the patterns. A
class of patterns has a block length B and a window length m (its shortest pattern). The block shift table says how far
the search may move at a block of B bytes without missing a pattern; a shift of zero leads to the suffix-hash bucket of
that block, whose strings are compared directly. The cursors of many stretches of text move at once, as one array.

Defined results: null or wordless text has no words and no hits; an item without words has no window; an item shorter than a
window is one window; a document row is judged by itself, so repeated rows give repeated results; an empty table
gives an empty table; a column of the input that has a result's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.blocks import pieces, with_columns
from tallyloom.session import ship
from tallyloom.storage import Workspace

#: A-Z to lower case; every other ASCII byte that isn't a letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of benchmark text (bytes of UTF-8) whose patterns are broadcast at once; more items are searched in further passes.
PASS_BYTES = 8 << 20
_LANES = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int) -> set[bytes]:
    w = words_of(text)
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else set()


def _blocks_at(data: np.ndarray, ends: np.ndarray, b: int) -> np.ndarray:
    """A 64-bit hash of the b bytes that end before each of `ends`; distinct blocks of up to 8 bytes never share it."""
    n = len(data) - 7
    view = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    if b <= 8:
        return (view[ends - b] << np.uint64(64 - 8 * b)) if b < 8 else view[ends - 8]
    first, last = view[ends - b], view[ends - 8]
    with np.errstate(over="ignore"):
        return (first ^ (first >> np.uint64(29))) * _MIX ^ last


class PatternClass:
    """Wu-Manber tables for patterns of at least m bytes."""

    def __init__(self, patterns: list[tuple[bytes, list[int]]], b: int):
        self.b, self.m = b, min(len(p) for p, _ in patterns)
        self.bits = min(24, max(12, (len(patterns) * self.m).bit_length() + 3))
        self.shift = np.full(1 << self.bits, min(255, self.m - b + 1), np.uint8)
        heads = np.frombuffer(b"".join(p[: self.m] for p, _ in patterns) + bytes(8), np.uint8)
        starts = np.arange(len(patterns), dtype=np.int64) * self.m
        for end in range(b, self.m + 1):
            slot = self.slot(_blocks_at(heads, starts + end, b))
            np.minimum.at(self.shift, slot, np.uint8(min(255, self.m - end)))
        suffix = _blocks_at(heads, starts + self.m, b)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.patterns = suffix[order], [patterns[i] for i in order]

    def slot(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((block ^ (block >> np.uint64(32))) * _MIX) >> np.uint64(64 - self.bits)

    def find(self, text: bytes, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of every occurrence."""
        n = len(text)
        if n < self.m:
            return
        edges = np.linspace(self.m, n + 1, min(_LANES, n - self.m + 1) + 1).astype(np.int64)
        at, stop = edges[:-1].copy(), edges[1:]
        found = []
        while at.size:
            step = self.shift[self.slot(_blocks_at(data, at, self.b))].astype(np.int64)
            if not step.all():
                found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return
        ends = np.sort(np.concatenate(found))
        block = _blocks_at(data, ends, self.b)
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        for end, i, j in zip(ends[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            start = end - self.m
            for k in range(i, j):
                if text.startswith(self.patterns[k][0], start):
                    yield start, k


class Searcher:
    """All pattern classes of a set of items: long patterns aren't held back by short ones."""

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        owners: dict[bytes, set[int]] = defaultdict(set)
        for item, text in items:
            for p in windows(text, size):
                owners[p].add(item)
        kinds: dict[int, list] = defaultdict(list)
        for p in sorted(owners):
            kinds[16 if len(p) >= 32 else 8 if len(p) >= 16 else 3].append((p, sorted(owners[p])))
        self.classes = [PatternClass(ps, b) for b, ps in sorted(kinds.items())]

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[list[int]], set[int]]]:
        """For each text: its number of words, the word spans [first, behind last] of windows, and the items found."""
        split = [words_of(t) for t in texts]
        joined = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
        out = [(len(w), [], set()) for w in split]
        text = b"".join(joined)
        data = np.frombuffer(text + bytes(8), np.uint8)
        ends = np.cumsum([len(j) for j in joined])
        for c in self.classes:
            for start, k in c.find(text, data):
                pattern, owners = c.patterns[k]
                i = int(np.searchsorted(ends, start, "right"))
                first = text.count(b" ", int(ends[i]) - len(joined[i]), start)
                out[i][1].append([first, first + pattern.count(b" ") - 1])
                out[i][2].update(owners)
        return out


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_NEW = [("n_words", T.LongType()), ("hit_spans", _SPANS), ("hit_items", T.ArrayType(T.LongType()))]


def _schema(df: DataFrame, new: list[tuple[str, T.DataType]], drop: tuple[str, ...] = ()) -> T.StructType:
    names = {n for n, _ in new} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in new])


def _item_passes(spark: SparkSession, items: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, bytes]]]:
    """The items in passes of at most PASS_BYTES (one item at least); each pass is fetched by itself."""
    ranked = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = ranked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // PASS_BYTES) + 1
    for k in range(n):
        part = ranked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else ranked
        yield [(r.item, r.text.encode()) for r in part.collect()]


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """docs with n_words, hit_spans (maximal runs of hit words, [first, behind last]) and hit_items (sorted ids).

    The benchmark is broadcast PASS_BYTES at a time; each further pass adds to the columns of the one before, which is
    written to shared storage. Documents are never shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    ws, out, first = Workspace(spark, "decontaminate"), docs.drop("n_words", "hit_spans", "hit_items"), True
    for part in _item_passes(spark, items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(part)
        out = ws.cut(out) if not first else out
        schema = _schema(out, _NEW)

        def scan(batches, shared=shared, more=not first):
            searcher = Searcher(shared.value, size)
            for rows, texts in pieces(batches, text_col):
                found = searcher.hits(texts)
                old = rows.select(["hit_spans", "hit_items"]).to_pylist() if more else [{"hit_spans": [], "hit_items": []}] * len(texts)
                spans = [_union(s + o["hit_spans"]) for (_, s, _), o in zip(found, old, strict=True)]
                owners = [sorted(i | set(o["hit_items"])) for (_, _, i), o in zip(found, old, strict=True)]
                yield with_columns(rows, [], n_words=pa.array([n for n, _, _ in found], pa.int64()), hit_spans=pa.array(spans, pa.list_(pa.list_(pa.int32()))), hit_items=pa.array(owners, pa.list_(pa.int64())))

        out, first = out.mapInArrow(scan, schema), False
    return out


def contamination_digest(found: DataFrame) -> DataFrame:
    """hit_spans and hit_items as n_hit, n_items, items_sha256 and contaminated."""
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.withColumns({"n_hit": hit, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(ids.cast("binary"), 256), "contaminated": hit > 0})


def brute_force(text: str | None, items: list[tuple[int, str | None]], size: int = 10) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) of one text, by comparing every window with every position."""
    w = words_of((text or "").encode())
    hit, owners = set(), set()
    for item, t in items:
        iw = words_of((t or "").encode())
        for k in range(max(1, len(iw) - size + 1)) if iw else ():
            p = iw[k : k + size]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    owners.add(item)
    return len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
