"""Paragraph dedup by MinHash banding (operator 3).

A paragraph is a line, or, of a line of over LONG words, a stretch between two cuts. It is cut behind a word whose rank, a hash of it and
the word before, is the least of WORDS - 1 words on either side; ends of sentences rank before all others. So a cut depends on the words
around it alone, a stretch has WORDS words at least (10 on average), and a passage of 50 words that stands in the midst of different lines is cut
alike there, but for its edges. Where no word ranks least for over STRETCH + WORDS - 1 words, as in a word that is repeated, every STRETCH words are
a stretch: those of a short period have the same shingles, wherever they begin. Paragraphs become sets of shingles of WORDS words; equal sets are one
set. Every band of a set's MinHash signature is asked for corpus-wide; sets that share a band are fetched with all their
shingles, and joined where the exact Jaccard similarity is at least the threshold; components of these links are the
classes, and of each class all paragraphs but the first (least document id, then place) are to be removed.

A band is asked for by 48 bits of its signature (what meets by chance is compared in vain) with 24 bits of the set's name: where exactly two
sets share a band, in two chunks, one band in 16 million takes them for one set and isn't fetched.

Bands are tuned: the fewest hash functions whose bands find a pair at the threshold with at least the wanted probability.
A bucket of over BUCKET sets is split by hash; two of its sets, the hubs, are in every part, so that a family of variants mostly
comes together through them. What of such a bucket is still outside its largest component is then compared with all sets of the bucket that are near it in
size, in blocks of about BUCKET by BUCKET sets, so that all pairs that share a band are compared, or already joined, or can't be similar.

Defined results: null, empty and short paragraphs (fewer than WORDS words) are in no class; a null id sorts behind all others; repeated rows are
repeated paragraphs; an empty table gives an empty table; input columns other than id and text are dropped.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyloom.graph import connected_components
from tallyloom.llm.exchange import Chunks, look_up
from tallyloom.llm.lm import joined_hashes
from tallyloom.storage import Workspace

WORDS, LONG, BUCKET, STRETCH, SALTS = 5, 48, 1024, 20, 8
#: Shingles that are compared as a group, about.
BLOCK_BYTES = 16 << 20
_KEY_KIND = 1000


def tune_bands(threshold: float, recall: float = 0.995, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at the threshold with probability `recall`."""
    fit = [(b, r) for r in range(1, most + 1) for b in range(1, most // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
    return min(fit, key=lambda x: (-x[1], x[0]))


class Stretches:
    """The paragraphs of some texts: for each its text, its first word and the one behind its last, and its span in code points.

    Words are numbered through all texts; word_hash has a hash of each.
    """

    def __init__(self, texts: list[str]):
        words, starts, stops, lines, texts_of, ends = [], [], [], [], [], []
        n_lines = 0
        for d, text in enumerate(texts):
            low = text.lower().encode().split()
            if not low:
                continue
            code = np.frombuffer(text.encode() if text.isascii() else text.encode("utf-32-le"), np.uint8 if text.isascii() else np.uint32)
            space = (code == 32) | ((code >= 9) & (code <= 13))
            edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
            begin, stop = edge[::2], edge[1::2]
            words += low
            starts.append(begin)
            stops.append(stop)
            line = np.cumsum(code == 10)
            lines.append(line[begin] + n_lines)
            n_lines += int(line[-1]) + 1
            texts_of.append(np.full(len(low), d))
            last = code[stop - 1]
            ends.append((last == 46) | (last == 33) | (last == 63))
        self.word_hash = np.fromiter(map(xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
        if not words:
            self.text = self.first = self.stop = self.start_at = self.stop_at = np.empty(0, np.int64)
            return
        starts, stops, lines, texts_of, ends = (np.concatenate(x) for x in (starts, stops, lines, texts_of, ends))
        cut = self._cuts(lines, ends)
        self.stop = cut + 1
        self.first = np.r_[0, self.stop[:-1]]
        self.text, self.start_at, self.stop_at = texts_of[cut], starts[self.first], stops[cut]

    def _cuts(self, line: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last word of each paragraph."""
        n = len(line)
        new = np.r_[True, line[1:] != line[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        size = np.diff(np.r_[np.flatnonzero(new), n])
        size = np.repeat(size, size)
        place = np.arange(n) - first
        before = np.where(new, np.uint64(0), np.r_[np.uint64(0), self.word_hash[:-1]])
        rank = (_mix(before * np.uint64(0x9E3779B97F4A7C15) + self.word_hash, 77) >> np.uint64(1)) | (~ends).astype(np.uint64) << np.uint64(63)
        least = (size > LONG) & (place >= WORDS - 1) & (place < size - WORDS)
        for step in range(1, WORDS):
            least[:-step] &= (rank[:-step] < rank[step:]) | (line[:-step] != line[step:])
            least[step:] &= (rank[step:] <= rank[:-step]) | (line[:-step] != line[step:])
        cut = np.flatnonzero(least | (place == size - 1))
        # where a long line has no cut for long, every STRETCH words are a paragraph
        last = np.r_[-1, cut[:-1]]
        wide = np.flatnonzero((cut - last > STRETCH + WORDS - 1) & (size[cut] > LONG))
        more = [np.arange(last[i] + STRETCH, cut[i] - WORDS + 1, STRETCH) for i in wide.tolist()]
        return np.sort(np.concatenate([cut, *more])) if more else cut


def split_paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph, in code points; white space at the edges isn't part of it."""
    s = Stretches([text])
    return list(zip(s.start_at.tolist(), s.stop_at.tolist(), strict=True))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Sets:
    """The shingle sets of a chunk's paragraphs."""

    def __init__(self, table, words: int = WORDS):
        self.ids = table.column("id").to_pylist()
        parts = Stretches([t or "" for t in table.column("text").to_pylist()])
        size = parts.stop - parts.first
        keep = size >= words
        self.doc, self.n_words, size = parts.text[keep], size[keep], size[keep]
        self.span = list(zip(parts.start_at[keep].tolist(), parts.stop_at[keep].tolist(), strict=True))
        self.n = len(size)
        h = joined_hashes(parts.word_hash, words)
        n = size - words + 1
        owner = np.repeat(np.arange(self.n), n)
        h = h[np.repeat(parts.first[keep], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] if self.n else np.empty(0, np.uint64)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
        self.shingle, owner = h[new], owner[new]
        self.edge = np.searchsorted(owner, np.arange(self.n + 1))
        self.key = np.add.reduceat(_mix(self.shingle, 999), self.edge[:-1]) if self.n else np.empty(0, np.uint64)

    def bands(self, bands: int, rows: int) -> list[np.ndarray]:
        out = []
        for b in range(bands):
            sig = np.zeros(self.n, np.uint64)
            for r in range(rows):
                # shingles are hashes already: one multiplication orders them anew
                seed = _mix(np.array([b * rows + r + 1], np.uint64), 4242)[0] | np.uint64(1)
                sig = _mix(sig ^ np.minimum.reduceat((self.shingle ^ (self.shingle >> np.uint64(31)) ^ seed) * seed, self.edge[:-1]), b + 500) if self.n else sig
            # 48 bits: what meets by chance is only compared in vain
            out.append(sig >> np.uint64(16) << np.uint64(16))
        return out


def similar_roots(sets: list[np.ndarray], threshold: float) -> list[int]:
    """For each set the first of its component, where sets with a Jaccard similarity of at least threshold are linked."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    number, edge, asked = number.astype(np.int32), np.cumsum(size) - size, np.zeros(len(every), bool)
    root, left = [-1] * n, np.ones(n, bool)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], left[i], queue = i, False, [i]
        while queue and left.any():
            q = queue.pop()
            own = number[edge[q] : edge[q] + size[q]]
            asked[own] = True
            common = np.add.reduceat(asked[number], edge, dtype=np.int64)
            asked[own] = False
            near = np.flatnonzero(left & (common >= threshold * (size + size[q] - common) - 1e-12))
            for j in near.tolist():
                root[j] = i
            left[near] = False
            queue += near.tolist()
    return root


def cross_links(strays: list[int], comp: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (stray, other) that join the components of similar sets, for pairs of a stray and any other set."""
    size = np.array([len(s) for s in sets])
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    edge, asked, comp, out = np.cumsum(size) - size, np.zeros(len(every), bool), comp.copy(), []
    for q in strays:
        if (comp == comp[q]).all():
            continue
        own = number[edge[q] : edge[q] + size[q]]
        asked[own] = True
        common = np.add.reduceat(asked[number], edge, dtype=np.int64)
        asked[own] = False
        near = (comp != comp[q]) & (common >= threshold * (size + size[q] - common) - 1e-12)
        for j in np.flatnonzero(near).tolist():
            if comp[j] != comp[q]:
                out.append((q, j))
                comp[comp == comp[j]] = comp[q]
    return out


def _left_links(buckets: DataFrame, bands: DataFrame, comp: DataFrame, threshold: float) -> DataFrame | None:
    """(u, v): the links that are still missing in buckets of over BUCKET sets; None if each is in one component."""
    ws = Workspace(buckets.sparkSession, "paragraph-blocks")
    sets = buckets.join(bands, "band", "left_semi").groupBy("band", "key").agg(F.first("shingles").alias("shingles"))
    sets = sets.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sets = ws.cut(sets)
    # similar sets are similar in size: those of a class of sizes are compared with each other and with the next class
    sized = sets.withColumn("class", F.floor(F.log(F.octet_length("shingles") / 8) / F.lit(-math.log(threshold))).cast("int"))
    sized = sized.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("band", F.xxhash64("band", "class"))
    n = sized.groupBy("band", "component").agg(F.count("*").alias("m"), F.sum(F.octet_length("shingles")).alias("b"))
    n = n.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("n"), F.sum("b").alias("b"))
    parts, chunks = (F.ceil(F.greatest(x / BUCKET, F.col("b") * x / F.col("n") / BLOCK_BYTES)).cast("int") for x in (F.col("n"), F.col("n") - F.col("most")))
    n = ws.cut(n.where("most < n").select("band", "main", parts.alias("parts"), chunks.alias("chunks")))
    if n.isEmpty():
        return None
    open_ = sized.join(n, "band").withColumns({"part": F.pmod(F.xxhash64("key", "band"), "parts").cast("int"), "chunk": F.pmod(F.xxhash64("band", "key"), "chunks").cast("int")})
    every = open_.withColumns({"stray": F.lit(False), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    strays = open_.where("component <> main").withColumns({"stray": F.lit(True), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    columns = ["band", "part", "chunk", "stray", "key", "component", "shingles"]

    def compare(batches):
        group, rows = None, []

        def settle():
            if not rows:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["u", "v"])
            keys, sets = [r[1] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows]
            linked = cross_links([i for i, r in enumerate(rows) if r[0]], np.array([r[2] for r in rows]), sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array([keys[x[k]] for x in linked], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for *now, stray, key, component, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != group:
                    yield settle()
                    group, rows = now, []
                rows.append((stray, key, component, shingles))
        yield settle()

    blocks = every.select(columns).unionByName(strays.select(columns)).repartition("band", "part", "chunk").sortWithinPartitions("band", "part", "chunk", "key", "stray")
    return ws.cut(blocks.mapInArrow(compare, "u long, v long"))


def joined_sets(buckets: DataFrame, threshold: float) -> DataFrame:
    """(node, component): the components of sets that meet in a bucket and have a Jaccard similarity of at least threshold.

    buckets: (band, key, shingles), the sets that are in each bucket; key names a set, shingles are its 64-bit numbers, ascending.
    """
    ws = Workspace(buckets.sparkSession, "joined-sets")
    given = buckets
    buckets = given.groupBy("band", "key").agg(F.first("shingles").alias("shingles"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"), F.min("key").alias("hub0"), F.max("key").alias("hub1")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / BUCKET, F.when(F.col("n") > 2, F.col("bytes") / BLOCK_BYTES).otherwise(F.lit(0.0)))).cast("int")
    part = F.when(F.col("key").isin(F.col("hub0"), F.col("hub1")), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("key", "band"), parts).cast("int")))
    split = buckets.join(sizes, "band").select("band", "key", "shingles", F.explode(part).alias("part"), (parts > 1).alias("large"))

    def verify(batches):
        # links, and (band, null) for each part of a bucket that is split;
        # groups come one after the other; most are pairs, so that a call for each of them would cost more than the work
        group, large, keys, sets = None, False, [], []
        out_u, out_v = [], []

        def settle():
            if len(sets) == 2:
                common = len(np.intersect1d(*sets, assume_unique=True))
                linked = [(1, 0)] if common >= threshold * (len(sets[0]) + len(sets[1]) - common) - 1e-12 else []
            elif len(sets) > 2:
                linked = [(i, r) for i, r in enumerate(similar_roots(sets, threshold)) if i != r]
            else:
                linked = []
            out_u.extend(keys[i] for i, _ in linked)
            out_v.extend(keys[r] for _, r in linked)
            if large:
                out_u.append(group[0])
                out_v.append(None)

        for batch in batches:
            for band, part, key, shingles, split_up in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, part) != group:
                    settle()
                    group, large, keys, sets = (band, part), split_up, [], []
                keys.append(key)
                sets.append(np.frombuffer(shingles, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])
            out_u, out_v = [], []
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    ordered = split.select("band", "part", "key", "shingles", "large").repartition("band", "part").sortWithinPartitions("band", "part", "key")
    links = ws.cut(ordered.mapInArrow(verify, "u long, v long"))
    ws.release()
    comp = connected_components(links)
    bands = links.where("v is null").select(F.col("u").alias("band")).distinct()
    if not bands.isEmpty():
        more = _left_links(given, bands, comp, threshold)
        comp = comp if more is None else connected_components(links.unionByName(more))
    return comp


def duplicate_paragraphs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, component_id, kept_doc_id, removed): every paragraph that is in a class of two or more.

    start and end are code points of the document's text; kept_doc_id is the document whose paragraph stays.
    """
    chunks = Chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "paragraphs")
    ws, kind = chunks.ws, docs.schema[id_col].dataType.simpleString()
    n_bands, n_rows = tune_bands(threshold)

    def asked(table, _):
        s = Sets(table)
        for b, sig in enumerate(s.bands(n_bands, n_rows)):
            order = np.lexsort((s.key, sig))
            sig, key = sig[order], s.key[order]
            edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if s.n else np.empty(0, np.int64)
            last = np.r_[edge[1:], s.n] - 1 if s.n else edge
            yield b, sig[edge], np.where(key[edge] == key[last], (key[edge] >> np.uint64(40)) + np.uint64(1), np.uint64(0)).astype(np.int64)
        keys, n = np.unique(s.key, return_counts=True)
        yield _KEY_KIND, keys, (n > 1).astype(np.int64)

    def shared(what, keys, values):
        every, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        value = np.concatenate(values)
        if what == _KEY_KIND:
            yes = (n > 1) | (np.bincount(inverse, value, len(every)) > 0)
        else:  # several sets have this band: in one chunk (0), or in two that name different sets
            low, high = np.full(len(every), 1 << 40), np.full(len(every), -1)
            np.minimum.at(low, inverse, value)
            np.maximum.at(high, inverse, value)
            yes = (low == 0) | (low != high)
        for part in np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]):
            at = np.flatnonzero(yes[part])
            yield at, np.ones(len(at), np.int64)

    answers = ws.cut(chunks.ask(asked, shared))
    ws.release()

    def candidates(table, got):
        s = Sets(table)
        bands = s.bands(n_bands, n_rows)
        hit = [look_up(sig, got.get(b)) > 0 for b, sig in enumerate(bands)]
        member = (look_up(s.key, got.get(_KEY_KIND)) > 0) | np.any(hit, axis=0) if s.n else np.empty(0, bool)
        rows, seen = [], set()
        for p in np.flatnonzero(member).tolist():
            key = int(s.key[p].view(np.int64))
            a, b = s.span[p]
            rows.append((s.ids[s.doc[p]], a, b, s.n_words[p], key, None, None))
            if key not in seen:
                seen.add(key)
                shingles = s.shingle[s.edge[p] : s.edge[p + 1]].tobytes()
                rows += [(None, None, None, None, key, int(bands[k][p].view(np.int64)), shingles) for k in range(n_bands) if hit[k][p]]
        return pd.DataFrame(rows, columns=["id", "start", "end", "n_words", "key", "band", "shingles"]).astype({c: "Int64" for c in ("start", "end", "n_words", "key", "band")})

    found = ws.cut(chunks.hear(answers, candidates, f"id {kind}, start long, end long, n_words long, key long, band long, shingles binary"))
    ws.release()
    comp = joined_sets(found.where("band is not null").select("band", "key", "shingles"), threshold)
    ws.release()
    members = found.where("band is null").select("id", "start", "end", "n_words", "key").join(comp.withColumnRenamed("node", "key"), "key", "left")
    members = members.withColumn("component_id", F.coalesce("component", "key"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "start", "end")
    classes = members.groupBy("component_id").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # a class may hold a large part of all rows: its line is given to SALTS tasks
    salt = F.pmod(F.xxhash64("id", "start", "end"), F.lit(SALTS)).cast("int")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = members.withColumn("salt", salt).join(classes, ["component_id", "salt"])
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("start") == F.col("first.start"))
    return out.select(F.col("id").alias(id_col), "start", "end", "n_words", "component_id", F.col("first.id").alias("kept_doc_id"), (~same).alias("removed"))
