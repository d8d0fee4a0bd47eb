"""Exact near-duplicate groups by TF-IDF cosine, with prefix filtering instead of all pairs.

Equal token sequences (by SHA-256) are one vector, named by its smallest id, so copies never multiply pairs. Terms are ordered by
document frequency, rare first. Let t be the first term that two unit vectors share: their cosine is at most |x from t on| * |y from t on|.
So a pair that reaches the threshold shares a term at which the product of what remains of both does, and candidates are just such pairs.
A term that many vectors have in their prefixes is dealt out by salt. Vectors lie packed in chunks, and those that are in a pair are taken out, so that
it is compared in one place; groups need links that join what is similar, not all pairs, so families are compared with leaders first.

Terms are told apart by hashes of 64 bits. A null text has no tokens; texts without tokens are in no group; an empty table gives an empty table.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.graph import connected_components
from tallyloom.ordered import dense_numbers
from tallyloom.session import ship
from tallyloom.storage import Workspace

#: 1-grams and 2-grams to a chunk, about; text to a bucket of hashes, about.
CHUNK_GRAMS, BUCKET_BYTES = 2_000_000, 6 << 20
#: What rounding may take from a cosine.
EPS = 1e-9
#: Accent stripping as far as it is a character map: lower-case Latin letters and what remains of them.
_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(c):
    """Lower-cased tokens of two or more word characters, accents stripped."""
    plain = F.translate(F.lower(c), _ACCENTS, _PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def gram_hashes(t):
    """Hashes of the 1-grams and 2-grams of an array of tokens."""
    two = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.concat(F.transform(t, lambda a: F.xxhash64(a)), two)


@dataclass(frozen=True)
class Vectors:
    """The distinct vectors of a corpus, packed: chunks have them with the document frequencies and names of their terms."""

    #: (vec, term, rest): the terms that other vectors have too, from which on a vector can still reach the threshold; rest is the squared length of what
    #: remains from that term on, rare terms first.
    prefix: DataFrame
    #: (chunk, bucket, data, more): of each chunk what its texts hold (a negative bucket), and what each bucket says of its terms.
    chunks: DataFrame
    #: (vec, copies, chunk, row): where a vector is.
    places: DataFrame
    #: The number of texts.
    n: int

    def of(self, wanted: DataFrame) -> DataFrame:
        """(vec, terms, weights) of the wanted vectors (vec), packed; terms that no other vector has are left out."""
        places = self.places.join(wanted, "vec", "left_semi")
        chunks, n = self.chunks.join(places.select("chunk").distinct(), "chunk", "left_semi"), self.n

        def read(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            if not len(got):
                return pd.DataFrame(columns=["vec", "terms", "weights"])
            row, term, df, w = _entries(own, got, n)
            shared = df > got["copies"].to_numpy()[row]
            row, term, w = row[shared], term[shared], w[shared]
            order = np.lexsort((term, row))
            edge = np.searchsorted(row[order], np.arange(len(got) + 1))
            cut = [order[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)]
            return pd.DataFrame({"vec": got["vec"].to_numpy(), "terms": [put_sorted(term[c]) for c in cut], "weights": [w[c].tobytes() for c in cut]})

        vec = next(f for f in self.places.schema.fields if f.name == "vec")
        schema = T.StructType([vec, T.StructField("terms", T.BinaryType()), T.StructField("weights", T.BinaryType())])
        return chunks.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInPandas(read, schema)


def tfidf(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> tuple[DataFrame, Vectors]:
    """((id, vec) of every text with tokens, the distinct vectors).

    Sublinear tf, smooth idf, unit length. Texts are packed into chunks, which hold their terms as places in the chunk's list of distinct terms. Each bucket owns
    a range of hashes: chunks send it that part of their lists, packed, and it answers with the document frequency of each term and a name for those that
    several texts have. So a term of a text moves as a byte or two, and its hash once for each chunk.
    """
    spark = texts.sparkSession
    ship(spark)
    ws = Workspace(spark, "tfidf")
    found = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    n, buckets = found.n, max(64, (found.bytes or 0) // BUCKET_BYTES)
    seq = texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    rows = seq.select("id", F.sha2(F.array_join("t", " "), 256).alias("kind"), gram_hashes(F.col("t")).alias("g"))  # no filter here: it would find the tokens once more
    asked = rows.mapInArrow(lambda batches: _asked(batches, buckets), "chunk string, bucket long, data binary, more binary, names binary")
    chunks = ws.cut(asked.groupBy("bucket").applyInPandas(_answered, "chunk string, bucket long, data binary, more binary, names binary"))
    ws.release()
    id_ = next(f for f in rows.schema.fields if f.name == "id")
    docs = ws.cut(chunks.where("bucket < 0").select("chunk", "names").mapInArrow(_docs, T.StructType([id_, *(T.StructField(c, t) for c, t in (("kind", T.BinaryType()), ("chunk", T.StringType()), ("row", T.LongType())))])))
    kinds = ws.cut(docs.groupBy("kind").agg(F.count("*").alias("copies"), F.min("id").alias("vec"), F.min_by(F.struct("chunk", "row"), "id").alias("at")))
    places = kinds.select("vec", "copies", "at.chunk", "at.row")
    chunks = chunks.drop("names")

    def prefix_of(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(got):
            return pd.DataFrame(columns=["vec", "term", "rest"])
        row, term, df, w = _entries(own, got, n)
        order = np.lexsort((term, df, row))
        upto = np.r_[0.0, np.cumsum((w * w)[order])]
        ends = np.searchsorted(row, np.arange(len(got)), "right")  # row is the same in either order
        rest = upto[ends][row] - upto[:-1]
        held = (rest >= threshold * threshold - EPS) & (df[order] > got["copies"].to_numpy()[row])
        return pd.DataFrame({"vec": got["vec"].to_numpy()[row[held]], "term": term[order][held], "rest": rest[held]})

    schema = T.StructType([T.StructField("vec", id_.dataType), T.StructField("term", T.LongType()), T.StructField("rest", T.DoubleType())])
    prefix = ws.cut(chunks.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInPandas(prefix_of, schema))
    ws.release()
    return docs.join(kinds.select("kind", "vec"), "kind").select("id", "vec"), Vectors(prefix, chunks, places, n)


def _asked(batches, buckets: int):
    """Chunks of the rows (id, kind, hashes) that have hashes: the part of the distinct hashes that each bucket owns with the number of texts that have them, and
    a row of what the texts hold."""
    held, size, number = [], 0, 0

    def rows() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lists = whole.column(2)
        edge = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        keys, at = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        at = at + len(keys) * np.repeat(np.arange(whole.num_rows), np.diff(edge))
        at, times = np.unique(at, return_counts=True)  # (text, place of the term) as one number
        row, place = np.divmod(at, len(keys))
        texts = np.bincount(place, minlength=len(keys))
        part, chunk = TaskContext.get().partitionId(), number
        out = [(f"{part}-{chunk}", -1 - (part << 32 | chunk), b"".join(_framed([put_numbers(np.bincount(row, minlength=whole.num_rows)), put_numbers(np.diff(at, prepend=0)), put_numbers(times)])), None, _names(whole))]
        own = keys // np.uint64(-(-(1 << 64) // buckets))
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist()
        out += [(f"{part}-{chunk}", int(own[a]), put_sorted(keys[a:z]), put_numbers(texts[a:z]), None) for a, z in zip(first, [*first[1:], len(keys)], strict=True)]
        types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "bucket", "data", "more", "names"])

    for batch in batches:
        batch, start = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(2)), 0), 0)), 0
        for i, k in enumerate(pc.list_value_length(batch.column(2)).to_numpy().tolist()):
            size += k
            if size >= CHUNK_GRAMS:
                held.append(batch.slice(start, i + 1 - start))
                yield rows()
                held, size, number, start = [], 0, number + 1, i + 1
                pa.default_memory_pool().release_unused()
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield rows()


def _names(whole: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    kinds = pa.array([bytes.fromhex(k) for k in whole.column(1).to_pylist()], pa.binary())
    made = pa.RecordBatch.from_arrays([whole.column(0), kinds], names=["id", "kind"])
    with pa.ipc.new_stream(out, made.schema) as w:
        w.write_batch(made)
    return out.getvalue()


def _docs(batches):
    """(id, kind, chunk, row) of every text of the chunks."""
    for batch in batches:
        for chunk, names in zip(batch.column(0), batch.column(1), strict=True):
            got = pa.ipc.open_stream(names.as_buffer()).read_all().combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([chunk.as_py()] * got.num_rows), pa.array(np.arange(got.num_rows))], names=["id", "kind", "chunk", "row"])


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the document frequencies of the terms it asked a bucket about, and the names of those that several texts have."""
    bucket = int(pdf["bucket"].iloc[0])
    if bucket < 0:
        return pdf
    keys = [get_sorted(k) for k in pdf["data"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(at, np.concatenate([get_numbers(x) for x in pdf["more"]])).astype(np.int64)
    name = (bucket << 32) + np.cumsum(df > 1)
    edge = np.cumsum([0, *map(len, keys)])
    asked = [at[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)]
    return pdf.assign(data=[put_numbers(df[x]) for x in asked], more=[put_sorted(name[x][df[x] > 1]) for x in asked])


def _entries(own: pd.DataFrame, got: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in got, term, document frequency, weight) of the terms of a chunk's wanted rows, in the order of got; a term of one text is named -1."""
    held = own["bucket"].to_numpy() < 0
    sizes, step, times = map(get_numbers, _unframed(own["data"][held].iloc[0]))
    told = own[~held].sort_values("bucket")
    df = np.concatenate([get_numbers(x) for x in told["data"]])
    name = np.full(len(df), -1)
    name[df > 1] = np.concatenate([get_sorted(x) for x in told["more"]]).view(np.int64)
    place = np.cumsum(step) % len(df)
    edge = np.r_[0, np.cumsum(sizes)]
    rows = got["row"].to_numpy()
    at = np.concatenate([np.arange(edge[r], edge[r + 1]) for r in rows])
    row, place, times = np.repeat(np.arange(len(rows)), sizes[rows]), place[at], times[at]
    w = (1 + np.log(times)) * (np.log((n + 1) / (df[place] + 1)) + 1)
    return row, name[place], df[place], w / np.sqrt(np.bincount(row, w * w))[row]


def put_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0, as many bytes each as the largest needs, byte plane by byte plane, compressed."""
    v = np.asarray(values).astype("<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + len(v).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True)


def get_numbers(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(data[5:], width * n, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def put_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers, as their differences."""
    return put_numbers(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(get_numbers(data).view(np.uint64), dtype=np.uint64)


def _framed(parts: list[bytes]) -> list[bytes]:
    return [x for p in parts for x in (len(p).to_bytes(8, "little"), p)]


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def verified(pairs: DataFrame, vectors: Vectors, threshold: float) -> DataFrame:
    """(u, v, cosine) of the pairs (u, v) whose vectors have a cosine of at least threshold: a pair meets both vectors in one row."""

    def compare(batches):
        for batch in batches:
            u, v, *packed = batch.columns
            cosine = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = (get_sorted(c[i].as_buffer().to_pybytes()) for c in packed[::2])
                a, b = (np.frombuffer(c[i].as_buffer()) for c in packed[1::2])
                if len(x) and len(y):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    same = x[at] == y
                    cosine[i] = a[at[same]] @ b[same]
            out = pa.RecordBatch.from_arrays([u, v, pa.array(cosine)], names=["u", "v", "cosine"])
            yield out.filter(pa.array(cosine >= threshold - EPS))

    ws = Workspace(pairs.sparkSession, "pairs")
    pairs = ws.cut(pairs)
    packed = ws.cut(vectors.of(pairs.select(F.col("u").alias("vec")).unionByName(pairs.select(F.col("v").alias("vec"))).distinct()))
    side = lambda c: packed.select(F.col("vec").alias(c), F.col("terms").alias(f"terms_{c}"), F.col("weights").alias(f"weights_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "terms_u", "weights_u", "terms_v", "weights_v")
    return both.mapInArrow(compare, T.StructType([*pairs.select("u", "v").schema.fields, T.StructField("cosine", T.DoubleType())]))


def _met(vectors: Vectors, part: int) -> DataFrame:
    """(term, vec, rest, parts): the prefix terms that several vectors have; a term in n prefixes is dealt out to n / part tasks."""
    prefix = vectors.prefix
    common = prefix.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    return prefix.join(common, "term")


def _pairs(some: DataFrame, every: DataFrame, threshold: float, differ=None) -> DataFrame:
    """(u, v), u < v: of two tables of prefix terms the vectors that share a term from which on both can reach the threshold."""
    left = every.withColumn("salt", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).drop("parts")
    right = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left, right = left.alias("a"), right.alias("b")
    on = (F.col("a.term") == F.col("b.term")) & (F.col("a.salt") == F.col("b.salt"))
    near = (F.col("a.vec") != F.col("b.vec")) & (F.col("a.rest") * F.col("b.rest") >= threshold * threshold - EPS)
    met = left.join(right, on).where(near if differ is None else near & differ)
    return met.select(F.least("a.vec", "b.vec").alias("u"), F.greatest("a.vec", "b.vec").alias("v")).distinct()


def similar_vectors(vectors: Vectors, threshold: float = 0.8, part: int = 512) -> DataFrame:
    """(u, v, cosine) of all distinct vectors with a cosine of at least threshold, u < v; vectors: as tfidf gives them.

    A family of n variants has up to n^2 / 2 pairs, which this lists; components need fewer, see vector_components.
    """
    _check(threshold)
    met = Workspace(vectors.prefix.sparkSession, "similar").cut(_met(vectors, part))
    return verified(_pairs(met, met, threshold), vectors, threshold)


def vector_components(vectors: Vectors, threshold: float = 0.8, part: int = 512) -> DataFrame:
    """(node, component): the components of vectors with a cosine of at least threshold, for vectors that have company.

    Where vectors share a prefix term, all are first compared with two leaders. What is then outside a term's largest component is
    compared with all of the term's vectors in other components. So a family of n variants takes some n comparisons, and pairs that
    what is known doesn't join are all compared.
    """
    _check(threshold)
    ws = Workspace(vectors.prefix.sparkSession, "linked")
    met = ws.cut(_met(vectors, part))
    row, by = F.struct("vec", "rest"), F.xxhash64("vec")
    lead = met.groupBy("term").agg(F.array(F.min_by(row, by), F.max_by(row, by)).alias("lead"))
    led = met.join(lead, "term").select("vec", "rest", F.explode("lead").alias("l")).where((F.col("vec") != F.col("l.vec")) & (F.col("rest") * F.col("l.rest") >= threshold * threshold - EPS))
    pairs = led.select(F.least("vec", "l.vec").alias("u"), F.greatest("vec", "l.vec").alias("v")).distinct()
    comp = ws.cut(connected_components(verified(pairs, vectors, threshold).select("u", "v")))
    open_ = ws.cut(_open(met, comp))
    main = open_.groupBy("term", "component").agg(F.count("*").alias("m")).groupBy("term").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    strays = open_.join(main, "term").where("component <> main").drop("main")
    rest = ws.cut(verified(_pairs(strays, open_, threshold, F.col("a.component") != F.col("b.component")), vectors, threshold))
    if rest.isEmpty():
        return comp
    return connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest.select("u", "v")))


def _open(met: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of prefix terms whose vectors are of several components, with their component."""
    known = met.join(comp.select(F.col("node").alias("vec"), "component"), "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    several = known.groupBy("term").agg(F.min("component").alias("_a"), F.max("component").alias("_z")).where("_a <> _z").select("term")
    return known.join(several, "term").select("term", "vec", "rest", "parts", "component")


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8, id_col: str = "review_id", order_col: str = "source_row_index", text_col: str = "review_text") -> DataFrame:
    """(id, near_dup_group_id, near_dup_group_size, is_near_dup_representative) of every text in a group of two or more.

    Groups are numbered from 0 in the order of their first member; the representative is the longest text, the first of
    those. Texts without tokens are in no group.
    """
    ids, vectors = tfidf(texts, id_col, text_col, threshold)
    comp = vector_components(vectors, threshold)
    member = ids.join(comp.withColumnRenamed("node", "vec"), "vec", "left").select(F.col("id").alias(id_col), F.coalesce("component", "vec").alias("c"))
    facts = member.join(texts.select(id_col, order_col, F.char_length(text_col).alias("_len")), id_col)
    groups = facts.groupBy("c").agg(F.count("*").alias("near_dup_group_size"), F.min(order_col).alias("_first"), F.max_by(id_col, F.struct("_len", -F.col(order_col))).alias("_rep")).where("near_dup_group_size > 1")
    numbered = dense_numbers(groups, "_first", "near_dup_group_id")
    return facts.join(numbered, "c").select(id_col, "near_dup_group_id", "near_dup_group_size", (F.col(id_col) == F.col("_rep")).alias("is_near_dup_representative"))
