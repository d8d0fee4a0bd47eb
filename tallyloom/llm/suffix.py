"""Exact substring dedup over a sparse suffix array (operator 6).

A byte goes if a string of LENGTH bytes (a window) that covers it also starts in a document with a smaller id. Of all suffixes of
the text, those at anchors are sorted: a window's anchor is where the least hash of a string of HEAD bytes within it stands
(the first of equal ones), so that equal windows have equal anchors at equal distances. A run is the windows that
have one anchor; its bytes, some 65, hold all of them, and its suffix begins with the HEAD bytes at the anchor.

1. Chunks of documents are packed with the places of their runs, hashed once.
2. Every chunk asks for the distinct heads of its runs, by hash: heads that one document has rule out their windows. A chance
   meeting of hashes only lets a run through that isn't needed.
3. The runs that are left are sent as their bytes, each distinct one once a chunk, range-partitioned by the leading bytes of their suffixes
   between splitters that are drawn from a sample of these suffixes. In a bucket, equal runs are found as whole byte strings;
   the suffixes of those that differ are sorted by multikey quicksort, a machine word at a time, and neighbours are compared: how far a
   suffix agrees with its neighbours, forwards and (in the order of what precedes the anchors) backwards, bounds the windows that can
   be shared. Those are compared byte by byte. Nothing is decided by a hash.
4. Splitters compare whole heads, so the runs of one window lie on one side of every boundary. A head with over HOT runs would make its bucket as
   large as it is frequent: its windows are sent one by one instead, dealt by all their bytes, and only whole strings are compared.

The driver holds at most SPLITTERS * SAMPLE heads; ranges beyond SPLITTERS are divided by the hash of the head.

Defined results: null text is empty; documents shorter than a window keep all; a null id counts as larger than
any other and equal to other nulls; rows with one id don't remove each other's text; ids may be of any type that sorts; an empty table gives
an empty table; input columns other than id and text are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.blocks import trim
from tallyloom.llm.exchange import Chunks, get_numbers, get_sorted, heard_of, press, put_numbers, put_sorted, unpack_batch, unpress
from tallyloom.operators.neardup import dense_numbers
from tallyloom.session import ship

#: Bytes at an anchor by which suffixes are dealt; a window of LENGTH has LENGTH - HEAD + 1 places for its anchor.
HEAD = 20
#: The most ranges of suffixes, and sampled heads for each.
SPLITTERS, SAMPLE = 4096, 40
#: Chunks that the sample is drawn from.
SAMPLED_CHUNKS = 32
#: The most runs of one head (distinct ones of each chunk, together) that are compared in one place.
HOT = 4096
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 19) - 1)
_ALL = (1 << 32) - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LUT = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def hashes_of(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes that start at each byte, made from hashes of powers of two."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, at, power, size = None, 0, _LUT[data], 1
    while True:
        if n & size:
            out = power[at : at + m].copy() if out is None else out * _M[0] + power[at : at + m]
            at += size
        if size * 2 > n:
            return _mix(out)
        power = power[:-size] * _M[size.bit_length() % 6] + power[size:]
        size *= 2


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def find_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in the joined texts, distance of the anchor, number of windows) of every run; windows don't cross texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts, offsets, counts = [], [], []
    for a in range(0, len(data) - length + 1, _BLOCK):
        piece = data[a : a + _BLOCK + length - 1]
        n = len(piece) - length + 1
        key = hashes_of(piece, HEAD)
        key = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint64)
        anchor = (least_of(key, length - HEAD + 1) & _PLACE).astype(np.int64)
        # the end of the text in which each window starts
        first, last = np.searchsorted(ends, [a, a + n - 1], "right")
        size = np.diff(np.r_[a, np.minimum(ends[first : last + 1], a + n)])
        whole = np.arange(a + length, a + n + length) <= np.repeat(ends[first : last + 1], size)
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        anchor = anchor[at]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        starts.append(a + at[new])
        offsets.append(anchor[new] - at[new])
        counts.append(np.diff(np.r_[new, len(at)]))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, offsets, counts))


def _texts(table) -> list[bytes]:
    return [(t or "").encode() for t in table.column("text").to_pylist()]


class Runs:
    """The runs of a chunk."""

    def __init__(self, table: pa.Table, length: int, drop: int):
        self.texts, self.length = _texts(table), length
        self.raw = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        held = table.schema.metadata or {}
        self.start = get_sorted(held.get(b"start", b"")).astype(np.int64)
        if not len(self.start):
            self.offset = self.count = self.doc = self.rank = np.empty(0, np.int64)
            self.heads, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        self.offset, self.count = get_numbers(held[b"offset"]), get_numbers(held[b"count"])
        self.stop = self.start + self.count + length - 1
        self.doc = np.searchsorted(self.ends, self.start, "right")
        self.rank = table.column("rank").to_numpy()[self.doc]
        data = np.frombuffer(self.raw + bytes(8), np.uint8)
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        at = self.start + self.offset
        head = _mix(words[at] * _M[3] + words[at + HEAD - 8])
        head = _mix(head * _M[4] + words[at + 8])
        self.hash = head
        name = _mix(words[self.start] * _M[5] + words[self.stop - 8] + self.count.astype(np.uint64))
        # the upper bits name a head; below them, what tells the runs of one head apart
        self.both = (head >> np.uint64(drop) << np.uint64(drop)) | (name >> np.uint64(64 - drop)) if drop else head
        self.heads, self.number = np.unique(head >> np.uint64(drop) << np.uint64(drop), return_inverse=True)

    def asked(self) -> np.ndarray:
        """For each head: twice its number of different runs, and one more if two documents have it."""
        if not len(self.heads):
            return np.empty(0, np.int64)
        low, high = np.full(len(self.heads), 1 << 62), np.full(len(self.heads), -1)
        np.minimum.at(low, self.number, self.rank)
        np.maximum.at(high, self.number, self.rank)
        order = np.argsort(self.both)
        v, head = self.both[order], self.number[order]
        runs = np.bincount(head[np.r_[True, v[1:] != v[:-1]]], minlength=len(self.heads))
        return np.minimum(runs, HOT + 1) * 2 + (low != high)

    def left(self, answer: np.ndarray) -> "Left":
        """The runs that several documents may have. answer: for each head 0, 1 (shared) or 2 (its windows go one by one)."""
        reply = answer[self.number] if len(self.heads) else self.number
        run, one = np.flatnonzero(reply == 1), np.flatnonzero(reply == 2)
        count = self.count[one]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        of = np.r_[run, np.repeat(one, count)]
        start = np.r_[self.start[run], np.repeat(self.start[one], count) + step]
        n = np.r_[self.count[run], np.ones(len(step), np.int64)]
        return Left(self, of, start, n, np.arange(len(of)) >= len(run))


class Left:
    """Runs (and single windows) of a chunk that are to be compared: each distinct byte string has a number, in order of its first place."""

    def __init__(self, runs: Runs, of: np.ndarray, start: np.ndarray, count: np.ndarray, single: np.ndarray):
        self.start, self.count, self.rank, self.doc = start, count, runs.rank[of], runs.doc[of]
        self.stop = start + count + runs.length - 1
        seen: dict[bytes, int] = {}
        raw = runs.raw
        self.number = np.fromiter((seen.setdefault(raw[a:z] + b"\1" if s else raw[a:z], len(seen)) for a, z, s in zip(start.tolist(), self.stop.tolist(), single.tolist(), strict=True)), np.int64, len(of))
        self.least = np.full(len(seen), 1 << 62)
        np.minimum.at(self.least, self.number, self.rank)
        first = np.full(len(seen), len(of))
        np.minimum.at(first, self.number, np.arange(len(of)))
        self.first, self.strings = first, list(seen)
        self.single = single[first]
        self.offset = np.where(self.single, 255, runs.offset[of][first])
        self.hash = runs.hash[of][first] if len(of) else np.empty(0, np.uint64)
        at = (runs.start + runs.offset)[of][first]
        self.head = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), HEAD)[at] if len(of) else np.empty((0, HEAD), np.uint8)

    def buckets(self, splitters: np.ndarray, divide: int) -> np.ndarray:
        """The bucket of each distinct string: a range of heads, divided by hash; single windows by all their bytes."""
        head = np.ascontiguousarray(self.head).view(f"S{HEAD}").ravel()
        out = np.searchsorted(splitters, head, "right") * divide + (self.hash % np.uint64(divide)).astype(np.int64)
        if self.single.any():
            one = np.frombuffer(b"".join(s for s, x in zip(self.strings, self.single.tolist(), strict=True) if x), np.uint8).reshape(int(self.single.sum()), -1)[:, :-1]
            h = np.zeros(len(one), np.uint64)
            for k in range(one.shape[1]):
                h = (h ^ one[:, k]) * _M[0]
            out[self.single] = (_mix(h) % np.uint64((len(splitters) + 1) * divide)).astype(np.int64)
        return out


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Positions in the order of words[0], then words[1], ...: each word sorts only what all before it left equal."""
    order = np.argsort(words[0], kind="stable")
    if not len(order):
        return order
    v = words[0][order]
    same = v[1:] == v[:-1]
    for w in words[1:]:
        if not same.any():
            break
        run = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
        at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        sub = order[at]
        order[at] = sub[np.lexsort((w[sub], run[at]))]
        v = w[order]
        same = same & (v[1:] == v[:-1])
    return order


def _as_words(strings: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian machine words, padded with zeros."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return list(np.ascontiguousarray(padded.view(">u8").T.astype(np.uint64)))


def _agree(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes of each row agree with a neighbour's, at most, where rows stand in `order`."""
    s = strings[order]
    differ = s[1:] != s[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), s.shape[1])
    out = np.zeros(len(s), np.int64)
    out[order] = np.maximum(np.r_[n, 0], np.r_[0, n])
    return out


def judge_runs(strings: list[bytes], offset: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For distinct runs of one bucket, with their smallest document: a bit for each window that starts in a smaller one too."""
    mask = np.zeros(len(strings), np.int64)
    many = np.flatnonzero(offset != 255)
    if len(many) < 2:
        return mask
    size = np.array([len(strings[i]) for i in many.tolist()])
    data = np.frombuffer(b"".join(strings[i] for i in many.tolist()) + bytes(length + HEAD), np.uint8)
    begin = np.cumsum(size) - size
    off = offset[many]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    back = length - HEAD
    suffix = view[begin + off].copy()
    suffix[np.arange(length) >= (size - off)[:, None]] = 0  # behind the run
    order = multikey_order(_as_words(suffix))
    # suffixes that share a head are neighbours
    head = suffix[order, :HEAD]
    new = np.r_[True, (head[1:] != head[:-1]).any(axis=1)]
    group = np.empty(len(many), np.int64)
    group[order] = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    many, size, begin, off, group, suffix = many[several], size[several], begin[several], off[several], group[several], suffix[several]
    if not len(many):
        return mask
    forward = np.minimum(_agree(suffix, multikey_order(_as_words(suffix))), size - off)
    at = begin + off
    before = np.where(np.arange(back) < off[:, None], data[np.maximum(at[:, None] - 1 - np.arange(back), 0)], 0)
    keyed = np.hstack([group.astype(">u4").view(np.uint8).reshape(-1, 4), before])
    backward = np.minimum(_agree(keyed, multikey_order(_as_words(keyed))) - 4, off)
    # a window that takes o bytes before its anchor takes length - o from it on
    count = size - length + 1
    low, high = np.maximum(length - forward, off - count + 1), np.minimum(backward, off)
    n = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(many)), n)
    if not len(of):
        return mask
    o = np.repeat(low, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    step = off[of] - o
    windows = view[begin[of] + step]
    words = [group[of].astype(np.uint64) << np.uint64(8) | o.astype(np.uint64), *_as_words(windows)]
    order = multikey_order(words)
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in words:
        v = w[order]
        new[1:] |= v[1:] != v[:-1]
    edge = np.flatnonzero(new)
    own = least[many][of][order]
    first = np.repeat(np.minimum.reduceat(own, edge), np.diff(np.r_[edge, len(order)]))
    gone = order[first < own]
    np.bitwise_or.at(mask, many[of[gone]], np.int64(1) << step[gone])
    return mask


def _ranked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rank, text): ranks are in the order of the ids, null behind all."""
    last = F.lit(1 << 61)
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        low = docs.agg(F.min(id_col)).first()[0] or 0
        rank = F.coalesce(F.col(id_col).cast("long") - F.lit(low), last)
        return docs.select(F.col(id_col).alias("id"), rank.alias("rank"), F.col(text_col).alias("text"))
    ids = dense_numbers(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "id", "rank")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left")
    return named.select("id", F.coalesce("rank", last).alias("rank"), "text")


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): the maximal runs of bytes to remove, [start, behind end), and the bytes that stay."""
    if not HEAD + 8 <= length < HEAD + 32:
        raise ValueError(f"length must be {HEAD + 8} to {HEAD + 31} bytes")
    spark = docs.sparkSession
    ship(spark)

    def marks(rows: pa.RecordBatch) -> dict[bytes, bytes]:
        start, offset, count = find_runs(_texts(rows), length)
        return {b"start": put_sorted(start), b"offset": put_numbers(offset), b"count": put_numbers(count)}

    chunks = Chunks(_ranked(docs, id_col, text_col), "suffix", marks=marks)
    ws, kind, buckets = chunks.ws, docs.schema[id_col].dataType.simpleString(), chunks.buckets
    drop = max(0, 64 - 12 - max(20, (chunks.bytes // 12).bit_length()))

    def asked(table, _):
        runs = Runs(table, length, drop)
        yield 0, runs.heads, runs.asked()

    def several(_, keys, values):
        every, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        value = np.concatenate(values)
        shared = (n > 1) | (np.bincount(inverse, value & 1, len(every)) > 0)
        hot = np.bincount(inverse, value >> 1, len(every)) > HOT
        for part in np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]):
            at = np.flatnonzero(shared[part])
            yield at, 1 + hot[part[at]]

    shared = ws.cut(chunks.ask(asked, several, by_place=True))
    ws.release()

    def left_of(blob: bytes, got: pd.DataFrame) -> tuple[Runs, Left]:
        runs = Runs(unpack_batch(blob), length, drop)
        known = heard_of(got[got["kind"] == 0])
        return runs, runs.left(known[0].on(runs.heads, buckets) if 0 in known else np.zeros(len(runs.heads), np.int64))

    # splitters: from the suffixes that are left in some chunks, chosen by hash
    ranges = min(SPLITTERS, buckets)
    divide = -(-buckets // ranges)
    some = [r.chunk for r in chunks.frame.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLED_CHUNKS).collect()]

    def sample(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in own["blob"]:
            head = left_of(blob, got)[1].head
            pick = np.random.Generator(np.random.PCG64(5)).integers(0, max(1, len(head)), min(len(head), -(-ranges * SAMPLE // SAMPLED_CHUNKS)))
            out += [bytes(head[i]) for i in pick.tolist()]
        trim()
        return pd.DataFrame({"head": out})

    in_sample = F.col("chunk").isin(some)
    drawn = chunks.frame.where(in_sample).groupBy("chunk").cogroup(shared.where(in_sample).groupBy("chunk")).applyInPandas(sample, "head binary") if some else None
    heads = sorted(bytes(r.head) for r in drawn.collect()) if drawn is not None else []
    splitters = np.array(sorted({heads[i * len(heads) // ranges] for i in range(1, ranges)}) if heads else [], f"S{HEAD}")

    def send(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, blob in zip(own["chunk"], own["blob"], strict=True):
            left = left_of(blob, got)[1]
            bucket = left.buckets(splitters, divide)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else order
            for at in np.split(order, edge[1:]) if len(order) else ():
                strings = [left.strings[i] for i in at.tolist()]
                sizes = np.array([len(s) for s in strings])
                out.append((int(bucket[at[0]]), chunk, put_sorted(at), put_numbers(left.least[at]), put_numbers(left.offset[at]), put_numbers(sizes), press(b"".join(strings))))
        trim()
        return pd.DataFrame(out, columns=["bucket", "chunk", "at", "least", "offset", "size", "bytes"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        numbers, ranks, offsets = [], [], []
        for rank, off, size, data in zip(pdf["least"], pdf["offset"], pdf["size"], pdf["bytes"], strict=True):
            raw = unpress(data)
            stop = np.cumsum(get_numbers(size))
            strings = [raw[a:z] for a, z in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
            numbers.append(np.array([seen.setdefault(s, len(seen)) for s in strings], np.int64))
            ranks.append(get_numbers(rank))
            offsets.append(get_numbers(off))
        number, rank = np.concatenate(numbers), np.concatenate(ranks)
        least, offset = np.full(len(seen), 1 << 62), np.zeros(len(seen), np.int64)
        np.minimum.at(least, number, rank)
        offset[number] = np.concatenate(offsets)
        mask = judge_runs(list(seen), offset, least, length)
        out = []
        for chunk, bucket, at, n, r in zip(pdf["chunk"], pdf["bucket"], pdf["at"], numbers, ranks, strict=True):
            told = np.where(r > least[n], _ALL, mask[n])
            yes = np.flatnonzero(told)
            if len(yes):
                out.append((chunk, 2, bucket, put_sorted(get_sorted(at)[yes]), put_numbers(told[yes])))
        trim()
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "keys", "values"])

    rows = chunks.frame.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(send, "bucket int, chunk string, at binary, least binary, offset binary, size binary, bytes binary")
    verdicts = ws.cut(rows.groupBy("bucket").applyInPandas(judge, "chunk string, kind int, bucket int, keys binary, values binary"))
    ws.release()

    def spans_of(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out, told = [], heard_of(got[got["kind"] == 2])
        for blob in own["blob"]:
            table = unpack_batch(blob)
            runs, left = left_of(blob, got)
            mask = np.zeros(len(left.strings), np.int64)
            if 2 in told:
                mask[told[2][0].astype(np.int64)] = told[2][1]
            mask = np.where(left.rank > left.least[left.number], _ALL, mask[left.number])
            whole, part = np.flatnonzero(mask == _ALL), np.flatnonzero((mask > 0) & (mask != _ALL))
            run, bit = np.nonzero((mask[part][:, None] >> np.arange(32)) & 1)
            begin = np.r_[left.start[whole], left.start[part][run] + bit]
            end = np.r_[left.stop[whole], left.start[part][run] + bit + length]
            doc = np.r_[left.doc[whole], left.doc[part][run]]
            order = np.argsort(begin, kind="stable")
            begin, end, doc = begin[order], np.maximum.accumulate(end[order]), doc[order]
            new = np.flatnonzero(np.r_[True, (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])]) if len(begin) else order
            begin, end, doc = begin[new], end[np.r_[new[1:] - 1, len(end) - 1]] if len(new) else end, doc[new]
            base = runs.ends[doc] - np.array([len(t) for t in runs.texts], np.int64)[doc]
            begin, end = (begin - base).tolist(), (end - base).tolist()
            cut = np.searchsorted(doc, np.arange(len(runs.texts) + 1)).tolist()
            for i, (id_, text) in enumerate(zip(table.column("id").to_pylist(), runs.texts, strict=True)):
                a, z = begin[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]]
                kept = b"".join(text[x:y] for x, y in zip([0, *z], [*a, len(text)], strict=True)) if a else text
                out.append((id_, len(text), [[x, y] for x, y in zip(a, z, strict=True)], kept))
        trim()
        return pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    both = shared.unionByName(verdicts)
    out = chunks.frame.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(spans_of, f"id {kind}, n_bytes long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def span_digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.withColumns({"n_removed": removed, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}).drop("spans", "kept")


def brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    """id -> (n_bytes, n_removed, n_spans, kept), by a table of all windows."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = (len(b), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + bytes(gone), strict=False)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out
