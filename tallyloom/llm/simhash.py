"""SimHash near-duplicate detection over a Gray-order hierarchical index (operator 1).

Fingerprints are made document by document. Distinct fingerprints are then put under upper nodes: a node is a mask of bit
positions and the pattern that its fingerprints share there. The masks of a level are chosen by pigeonhole, so that any two
fingerprints that differ in at most `most` bits meet under one node at least. A node with more than GROUP fingerprints gets a
further level of masks, inside the bits that are still free, so that no task ever holds a big group. Inside a node
the fingerprints stand in order of Gray rank; runs of them are factored into inner nodes (shared bits, and a mask of where
they are shared), and pairs of inner nodes whose accumulated differences exceed `most` are pruned with all that is below them.

near_copies() is for corpora that are to be thinned out: fingerprints of five-word shingles, linked as above, and MinHash bands beside them, for pairs whose
fingerprints differ in more bits than an index can bridge; whatever meets is then compared by its shingles, exactly.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; equal fingerprints link; repeated ids are one node; a row whose id is null has a null component; an empty
table gives an empty table; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tallyloom.graph import connected_components
from tallyloom.llm.blocks import pieces, with_columns
from tallyloom.session import ship
from tallyloom.storage import Workspace

SEED = 42
#: The most fingerprints that are compared as one group; larger nodes are split by further masks.
GROUP = 256
#: Fingerprints of an inner node.
RUN = 8


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash: bit set if it is set in over half of the shingles' XXH64."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """docs without the text, with its fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (text_col, name)]

    def scan(batches):
        for rows, texts in pieces(batches, text_col):
            fp = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield with_columns(rows, [text_col], **{name: pa.array(fp)})

    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField(name, T.LongType())]))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    rank = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(s))
    return rank


def level_masks(free: int, parts: int, keep: int) -> list[int]:
    """Masks of `keep` of the `parts` stretches into which the bit positions of `free` are cut."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [sum(1 << b for b in bits[len(bits) * p // parts : len(bits) * (p + 1) // parts]) for p in range(parts)]
    return [sum(c) for c in combinations(cut, keep)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fp: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within `most` bits in the same group; rows are ordered by group and Gray rank."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(fp) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, group[1:] != group[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
    # inner nodes: RUN rows of a group in Gray order
    edge = np.flatnonzero(new | ((np.arange(len(fp)) - first) % RUN == 0))
    node_end = np.r_[edge[1:], len(fp)]
    node_and, node_or = np.bitwise_and.reduceat(fp, edge), np.bitwise_or.reduceat(fp, edge)
    mask, bits, node_group = ~(node_and ^ node_or), node_and, group[edge]
    # pairs of inner nodes of a group, pruned by the differences where both are factored
    last = np.searchsorted(node_group, node_group, "right")
    count = last - np.arange(len(edge))
    a = np.repeat(np.arange(len(edge)), count)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    joint = mask[a] & mask[b]
    held = np.bitwise_count((bits[a] ^ bits[b]) & joint)
    ok = held <= most
    a, b, joint, held = a[ok], b[ok], joint[ok], held[ok]
    # leaves: only the bits that the nodes haven't counted
    na, nb = (node_end - edge)[a], (node_end - edge)[b]
    size = na * nb
    pair = np.repeat(np.arange(len(a)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = edge[a][pair] + k // nb[pair], edge[b][pair] + k % nb[pair]
    ok = i < j
    pair, i, j = pair[ok], i[ok], j[ok]
    ok = held[pair] + np.bitwise_count((fp[i] ^ fp[j]) & (ones ^ joint[pair])) <= most
    return i[ok], j[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 with links i-j: the smallest row of each one's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def _links_of(fp: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller row's fingerprint) that join the components of these groups."""
    order = np.lexsort((gray_rank(fp), group))
    fp, group = fp[order], group[order]
    kinds, number = np.unique(fp, return_inverse=True)
    i, j = _near(fp, group, most)
    root = _roots(len(kinds), number[i], number[j])
    own = np.flatnonzero(root != np.arange(len(kinds)))
    return kinds[own], kinds[root[own]]


def _search(most: int):
    def scan(batches):
        held_fp, held_key = np.empty(0, np.uint64), np.empty(0, np.int64)
        for rows in batches:
            fp = np.r_[held_fp, rows.column(0).to_numpy().view(np.uint64)]
            key = np.r_[held_key, rows.column(1).to_numpy()]
            if not len(fp):
                continue
            cut = int(np.searchsorted(np.cumsum(key != key[-1]), np.sum(key != key[-1]))) + 1 if key[0] != key[-1] else 0
            done_fp, done_key, held_fp, held_key = fp[:cut], key[:cut], fp[cut:], key[cut:]
            u, v = _links_of(done_fp, done_key, most)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        u, v = _links_of(held_fp, held_key, most)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return scan


def links(fps: DataFrame, most: int = 2, group: int = GROUP) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that join all that differ in at most `most` bits.

    Not every near pair is a row, but every near pair is joined by rows. Levels: with `most`+2 stretches and 2 of them
    kept, some choice of two has no difference. Each level leaves fewer free bits; the last leaves 8 or fewer, so at
    most 256 distinct fingerprints under a node, whatever the data.
    """
    spark = fps.sparkSession
    ship(spark)
    ws = Workspace(spark, "simhash")
    level = fps.select("fp", F.lit(0).cast("long").alias("mask")).distinct()
    free_of = {0: (1 << 64) - 1}
    out = None
    while True:
        masks = {m: level_masks(f, most + 2, 2) for m, f in free_of.items()}
        grown = {m | k for m, ks in masks.items() for k in ks}
        last = all(((1 << 64) - 1 & ~g).bit_count() <= 8 for g in grown)
        below = F.create_map(*[x for m, ks in masks.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(m | k)) for k in ks]))])
        nodes = level.select("fp", F.explode(below[F.col("mask")]).alias("mask")).distinct()
        nodes = nodes.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        nodes = ws.cut(nodes.join(sizes, "key"))
        small = nodes if last else nodes.where(F.col("n") <= group)
        found = small.select("fp", "key").repartition("key").sortWithinPartitions("key").mapInArrow(_search(most), "u long, v long")
        found = ws.cut(found)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        level = nodes.where(F.col("n") > group).select("fp", "mask")
        if level.isEmpty():
            return out
        present = [r.mask for r in level.select("mask").distinct().collect()]  # at most 6 masks, then 36
        free_of = {m % (1 << 64): (1 << 64) - 1 & ~(m % (1 << 64)) for m in present}


def _shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; those of an empty text are none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(w) - words + 1))


_LOW = np.uint64(0x0101010101010101)


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For texts of `sizes` hashes each (at least one), one after the other in h: the bits that over half of a text's hashes have."""
    # a bit of each byte is counted in that byte's lane, for 255 hashes at a time
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    step = np.arange(parts.sum()) - np.repeat(first, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * step
    ones = np.empty((len(sizes), 8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LOW, begin)
        ones[:, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return np.packbits(ones.reshape(-1, 64) * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _stir(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def bands_of(h: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): MinHash bands of sets of `sizes` hashes each (at least one), one after the other in h; bands of different places differ."""
    out, edge = np.zeros((len(sizes), bands), np.uint64), np.cumsum(sizes) - sizes
    low = h ^ (h >> np.uint64(31))
    for b in range(bands):
        for r in range(rows):
            # shingles are hashes already: one multiplication orders them anew
            seed = _stir(np.array([b * rows + r + 1], np.uint64), 4242)[0] | np.uint64(1)
            out[:, b] = _stir(out[:, b] ^ np.minimum.reduceat((low ^ seed) * seed, edge), b + 500)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.995, most: int = 2) -> DataFrame:
    """(id, mark, component_id) per row of docs: texts whose sets of shingles have a Jaccard similarity of at least threshold are linked.

    Texts meet if their fingerprints differ in at most `most` bits (see links), or in a MinHash band: 64 bits of SimHash alone can't tell a pair at 0.8,
    which differs in some 10 bits, from others, unless by masks whose number grows steeply with the corpus. Bands are tuned to meet a pair at the threshold with a
    probability of `recall` at least, alone (0.995; at 0.85 0.9998, at 0.9 0.999999); families of copies have more ways to come together. What meets at all is compared by its
    shingles, exactly, so that only texts that are similar are ever joined; texts with equal sets always are.

    A component is named by its smallest id. mark is a hash of the text, by which rows with one id and different texts are told apart. A row without an
    id has no component; null and blank texts are one set.
    """
    from tallyloom.llm.paragraphs import joined_sets, tune_bands

    ship(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "near-copies")
    kind = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    n_bands, n_rows = tune_bands(threshold, recall, 128)

    def scan(batches):
        for rows, texts in pieces(batches, "text", 1 << 20):
            sets = [np.unique(_shingles(t, words)) for t in texts]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            key, fp, bands = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), n_bands), np.uint64)  # zeros: an empty text
            if len(full):
                h, sizes = np.concatenate([sets[i] for i in full.tolist()]), np.array([len(sets[i]) for i in full.tolist()])
                key[full] = np.add.reduceat(_stir(h, 999), np.cumsum(sizes) - sizes)
                fp[full] = majorities(_stir(h, 1), sizes)
                bands[full] = bands_of(h, sizes, n_bands, n_rows)
            edge = pa.array((np.arange(len(sets) + 1) * n_bands).astype(np.int32))
            yield with_columns(rows, ["text"], key=pa.array(key.view(np.int64)), fp=pa.array(fp.view(np.int64)), bands=pa.ListArray.from_arrays(edge, pa.array(bands.ravel().view(np.int64))))

    fields = [T.StructField("id", kind), T.StructField("mark", T.LongType()), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    made = ws.cut(plain.mapInArrow(scan, T.StructType(fields)))
    row = F.when(F.col("id").isNotNull(), F.struct("id", "mark"))
    sets = ws.cut(made.groupBy("key").agg(F.min(row).alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    # everything that meets in a band, or by its fingerprint, is linked to the least set there
    each = sets.select("key", F.explode("bands").alias("band"))
    hubs = each.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub <> top")
    banded = each.join(hubs, "band").where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    first = ws.cut(sets.where("key <> 0").groupBy("fp").agg(F.min("key").alias("first")))
    equal = sets.join(first, "fp").where("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    found = links(first.select("fp"), most)
    meet = found.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    edges = ws.cut(banded.unionByName(equal).unionByName(meet.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct())
    ws.release()
    # the text of one row of each set that met another is fetched again, and compared by its shingles
    clusters = connected_components(edges).withColumnRenamed("node", "key").join(sets.select("key", "rep"), "key").where("rep is not null")
    fetched = plain.join(clusters.select("rep.id", "rep.mark", "key", F.col("component").alias("band")), ["id", "mark"])

    def shingles(batches):
        for rows, texts in pieces(batches, "text", 1 << 20):
            sets = [np.unique(_shingles(t, words)) for t in texts]
            keys = np.array([_stir(x, 999).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
            own = pa.array(keys == rows.column(0).to_numpy())  # texts of one id whose marks are equal by chance
            yield with_columns(rows, ["text"], shingles=pa.array([x.tobytes() for x in sets], pa.binary())).filter(own)

    buckets = ws.cut(fetched.select("key", "band", "text").mapInArrow(shingles, "key long, band long, shingles binary"))
    ws.drop(first, edges)
    ws.release()
    same = joined_sets(buckets, threshold).withColumnRenamed("node", "key")
    named = sets.select("key", "rep.id").join(same, "key", "left").select("key", "id", F.coalesce("component", "key").alias("c"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    by_key = named.join(least, "c").select("key", "component_id")
    return made.select("id", "mark", "key").join(by_key, "key").select(F.col("id").alias(id_col), "mark", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """(id, fp, fingerprint, component_id) per row of docs: the smallest id reachable over links, itself included."""
    ws = Workspace(docs.sparkSession, "simhash-docs")
    made = ws.cut(fingerprints(docs.select(id_col, text_col), text_col, words).select(F.col(id_col).alias("doc_id"), "fp"))
    reps = made.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = connected_components(links(reps, most))
    # the smallest id of a component of fingerprints, then of every fingerprint
    named = reps.join(comp, reps.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(least, "c").select("fp", "component_id")
    return (
        made.join(by_fp, "fp")
        .select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
        .withColumnRenamed("doc_id", id_col)
    )
