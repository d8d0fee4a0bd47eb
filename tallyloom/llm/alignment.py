"""Token alignment across two tokenizers (operator 12).

A text is encoded by a byte-level BPE (A) and by a piece BPE (B). Both cut the same bytes, so byte offsets at which tokens of both end cut it into
groups: the least stretches that both cover with whole tokens. All documents of a batch are laid end to end, the ends of A's and B's tokens
are counted once over all their bytes (bincount), and cuts are where both counts stand; prefix sums over the cuts,
taken at the documents' own ends, give each document's tokens, groups and links.

A link is an A token and a B token that share a group. How many documents of the corpus hold an id pair linked is counted relationally: a chunk says
each of its distinct pairs once, with its documents; sums by pair, the highest of each A id, and back to the chunks that asked. Vocabularies
bound the pairs, and no pair has more rows than there are chunks.

A's merges run in tiktoken, on ranks read from the tokenizer's own file, if that file is a byte-level BPE with GPT-2's pattern whose merges stand in
the order of their ids and which gives each of its tokens back as itself (then both engines merge alike); otherwise in the library. Long texts are
encoded in stretches that begin at a single space between two other characters, which no token of either crosses.

Defined results: a null or empty text, and one whose tokens don't spell a space and the text (the piece model rewrites U+2581), has no tokens:
zeros, and an empty string instead of a digest; strings of special tokens are plain text; repeated rows are documents of their own, each counted; a
null id is kept; an empty table gives an empty table; input columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import pieces, trim
from tallyloom.llm.exchange import get_numbers, get_sorted, put_numbers, put_sorted
from tallyloom.session import ship
from tallyloom.storage import Workspace

#: Text of a chunk; texts that are encoded at once; longer ones are encoded in stretches; pairs that are made at once.
CHUNK_BYTES, BATCH_BYTES, STRETCH, PAIRS = 8 << 20, 1 << 20, 1 << 18, 1 << 19
_SEAM = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def _byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """A vocabulary's tokens as bytes, with their lengths."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)

    def spells(self, ids, data: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == data


class ByteBpe:
    """Tokenizer A, from a `tokenizers` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, chars = file["model"], _byte_chars()
        vocab = {**model["vocab"], **{t["content"]: t["id"] for t in file.get("added_tokens", ())}}
        special = {t["content"] for t in file.get("added_tokens", ())}
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = t.encode() if t in special else bytes(chars[c] for c in t)
        self.table = Table(tokens)
        self.ranks = {tokens[i]: i for t, i in vocab.items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        before = file.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        ordered = len(self.ranks) == 256 + len(pairs) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        self.engine = None
        if plain and ordered:
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.engine = tiktoken.Encoding(hashlib.sha256(path.encode()).hexdigest(), pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True
            self.library.no_truncation()
            self.library.no_padding()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.engine is not None:
            return [self.engine.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]


class PieceBpe:
    """Tokenizer B, from a `sentencepiece` model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = Table([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteBpe, PieceBpe]:
    """Both, once a worker."""
    return ByteBpe(a_path), PieceBpe(b_path)


def stretches(text: str) -> list[str]:
    """The text without the spaces at which it is cut: joined by single spaces they are the text again."""
    out, start = [], 0
    while len(text) - start > STRETCH:
        seam = _SEAM.search(text, start + STRETCH)
        if not seam:
            break
        out.append(text[start : seam.start()])
        start = seam.end()
    return [*out, text[start:]]


def encode_both(texts: list[str], a: ByteBpe, b: PieceBpe) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of space+text by A and by B; two empty arrays where they don't spell it."""
    split = [stretches(t) if t else [] for t in texts]
    flat = [s for ss in split for s in ss]
    ids_a, ids_b = a.encode([" " + s for s in flat]), b.encode(flat)
    out, at = [], 0
    none = np.empty(0, np.int64)
    for ss in split:
        got = []
        for s, x, y in zip(ss, ids_a[at : at + len(ss)], ids_b[at : at + len(ss)], strict=True):
            data = (" " + s).encode()
            if not a.table.spells(x, data) or not b.table.spells(y, data):
                got = []
                break
            got.append((np.array(x, np.int64), np.array(y, np.int64)))
        at += len(ss)
        out.append((np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (none, none))
    return out


class Aligned:
    """Documents laid end to end: tokens of both sides with their document and group (numbered through all documents)."""

    def __init__(self, ids: list[tuple[np.ndarray, np.ndarray]], size_a: np.ndarray, size_b: np.ndarray):
        self.n = len(ids)
        self.a, self.b = (np.concatenate([x[k] for x in ids]) if ids else np.empty(0, np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        total = int(end_a[-1]) if len(end_a) else 0
        ends = [np.bincount(e, minlength=total + 1) for e in (end_a, end_b)]
        cut = (ends[0] > 0) & (ends[1] > 0)
        before = np.cumsum(cut)  # groups that end at this byte or before
        self.group_a, self.group_b = before[end_a - 1], before[end_b - 1]
        self.groups = int(before[-1]) if total else 0
        self.doc_a, self.doc_b = (np.repeat(np.arange(self.n), x) for x in (self.n_a, self.n_b))
        # segmented prefix sums: what all documents have up to a document's end, less what they have up to its beginning
        self.in_a, self.in_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        last = np.r_[0, np.cumsum(self.n_a)]
        upto = np.r_[0, self.group_a + 1][last]  # groups up to each document's end
        self.n_groups = np.diff(upto)
        links = np.r_[0, np.cumsum(self.in_a * self.in_b)]
        self.n_links = np.diff(links[upto])

    def digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` for each document with tokens, else an empty string."""
        n = len(self.a) + len(self.b)
        if not n:
            return [""] * self.n
        start_a, start_b = (np.cumsum(x) - x for x in (self.in_a, self.in_b))
        place_a = np.arange(len(self.a)) + start_b[self.group_a]  # behind B's tokens of earlier groups
        place_b = np.arange(len(self.b)) + (start_a + self.in_a)[self.group_b]
        mark_a = np.where(np.r_[self.group_a[1:] != self.group_a[:-1], True], ord("|"), ord(","))
        mark_b = np.where(np.r_[self.group_b[1:] != self.group_b[:-1], True], ord(";"), ord(","))
        mark_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 0
        cells = np.zeros((n, 11), np.uint8)
        for place, ids, mark in ((place_a, self.a, mark_a), (place_b, self.b, mark_b)):
            cells[place, :10] = _digits(int(ids.max()) + 1)[ids]
            cells[place, 10] = mark
        shown = cells != 0
        data = cells[shown].tobytes()
        end = np.r_[0, np.cumsum(shown.sum(axis=1))][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [hashlib.sha256(data[i:j]).hexdigest() if j > i else "" for i, j in zip(end[:-1], end[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links), each pair of a document once, ascending; a pair is A's id times 2^32 and B's id."""
        made = [_merged(*x) for x in self._links()]
        while len(made) > 1:  # halves at a time, so that no more than twice the distinct pairs are held
            made = [_merged(*(np.concatenate(c) for c in zip(*made[i : i + 2], strict=True))) for i in range(0, len(made), 2)]
        return made[0] if made else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))

    def _links(self):
        """Links in blocks of about PAIRS; in a group, equal ids are taken together first."""
        sides = []
        for ids, group in ((self.a, self.group_a), (self.b, self.group_b)):
            key, times = np.unique(group << 32 | ids, return_counts=True)
            g = key >> 32
            sides.append((key & 0xFFFFFFFF, times, np.searchsorted(g, np.arange(self.groups + 1)), g))
        (id_a, times_a, _, group), (id_b, times_b, edge_b, _) = sides
        doc = self.doc_a[np.searchsorted(self.group_a, group)]
        fan = np.diff(edge_b)[group]
        upto = np.cumsum(fan)
        start = 0
        while start < len(id_a):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            n = fan[start:stop]
            b = np.arange(n.sum()) + np.repeat(edge_b[group[start:stop]] - (np.cumsum(n) - n), n)
            pair = np.repeat(id_a[start:stop], n).astype(np.uint64) << np.uint64(32) | id_b[b].astype(np.uint64)
            yield np.repeat(doc[start:stop], n), pair, np.repeat(times_a[start:stop], n) * times_b[b]
            start = stop


def _merged(doc: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.empty(0, np.int64)
    return doc[edge], pair[edge], np.add.reduceat(n, edge) if len(edge) else n


@functools.lru_cache(maxsize=4)
def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0..n-1 as characters, zeros (not '0') in front."""
    power = 10 ** np.arange(9, -1, -1)
    number = np.arange(n)[:, None]
    return np.where((number >= power) | (power == 1), number // power % 10 + 48, 0).astype(np.uint8)


class Chunk:
    """Batches of documents, each aligned as a whole, until they are packed as one row."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.sides, self.parts, self.bytes = (a, b), [], 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        a, b = self.sides
        x = Aligned(encode_both([t.decode() for t in texts], a, b), a.table.size, b.table.size)
        doc, pair, links = x.pairs()
        columns = [ids, *(pa.array(v) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.digests(), pa.string()), pa.array(np.bincount(doc, minlength=x.n))]
        self.parts.append((pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own"]), pair, links.astype(np.int32)))
        self.bytes += sum(map(len, texts))

    def packed(self, name: str) -> pa.RecordBatch:
        """The chunk as a row: its documents' digests, its distinct pairs with their documents, and each document's share in them."""
        kinds, number, held = np.unique(np.concatenate([p for _, p, _ in self.parts]), return_inverse=True, return_counts=True)
        out = io.BytesIO()
        with pa.ipc.new_stream(out, self.parts[0][0].schema) as w:
            for rows, _, _ in self.parts:
                w.write_batch(rows)
        packed = [out.getvalue(), put_sorted(kinds), put_numbers(held), put_numbers(number), put_numbers(np.concatenate([n for _, _, n in self.parts]))]
        self.parts, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([p], pa.binary()) for p in packed)], names=["chunk", "docs", "pairs", "held", "number", "links"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    ship(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "alignment")
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        chunk, n = Chunk(*tokenizers(a_path, b_path)), 0
        for rows, texts in pieces(batches, "text", BATCH_BYTES):
            chunk.add(rows.column(0), texts)
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk.packed(f"{TaskContext.get().partitionId()}-{n}")
                n += 1
                trim()
        if chunk.parts:
            yield chunk.packed(f"{TaskContext.get().partitionId()}-{n}")
            trim()

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = ws.cut(plain.mapInArrow(scan, "chunk string, docs binary, pairs binary, held binary, number binary, links binary"))

    def say(batches):
        for rows in batches:
            for chunk, pairs, held in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                keys = get_sorted(pairs)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(keys)), pa.array(keys.view(np.int64)), pa.array(get_numbers(held))], names=["chunk", "pair", "n"])

    said = chunks.select("chunk", "pairs", "held").mapInArrow(say, "chunk string, pair long, n long")
    counts = ws.cut(said.groupBy("pair").agg(F.sum("n").alias("n")))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    known = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", F.col("n").alias("count"), (F.col("n") == F.col("highest")).alias("best"))
    heard = said.select("chunk", "pair").join(known, "pair").select("chunk", "pair", "count", "best")

    def finish(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(got["pair"].to_numpy().view(np.uint64))
        count, best = got["count"].to_numpy()[order], got["best"].to_numpy()[order].astype(np.int64)
        out = []
        for blob, number, links in zip(own["docs"], own["number"], own["links"], strict=True):
            rows = pa.ipc.open_stream(blob).read_all()
            at, n = (get_numbers(x) if x else np.empty(0, np.int64) for x in (number, links))
            end = np.cumsum(np.r_[0, rows.column("own").to_numpy()])
            sums = [np.diff(np.r_[0, np.cumsum(n * v[at])][end]) for v in (best, count)]
            pdf = rows.drop_columns(["own"]).to_pandas(types_mapper=lambda t: pd.Int64Dtype() if t == pa.int64() else None)
            out.append(pdf.assign(n_best=sums[0], count_sum=sums[1]))
        trim()
        return pd.concat(out)[["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]] if out else empty

    columns = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    empty = pd.DataFrame(columns=[c.split()[0] for c in columns.split(", ")])
    found = chunks.select("chunk", "docs", "number", "links").groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInPandas(finish, columns)
    return found.withColumnRenamed("id", id_col)
