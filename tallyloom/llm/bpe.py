"""BPE encoding and decoding over a minimal acyclic transducer lexicon (operator 8).

The corpus's most frequent pieces are compiled into a minimal acyclic automaton: equal suffixes share their states, and the
outputs summed along a path number the word, whose token ids stand in a table under that number. The arrays
are one file in the shared folder, fetched by Spark's file cache and memory-mapped by every worker. Pieces that the lexicon
doesn't have are merged exactly, pair by pair in order of rank, many words at a time. The lexicon changes the speed, not the
result.

Case, composition and classes of characters are Python's here; they are the library's for every character that Unicode 3.2 has, and for
the blocks of PICTURES. A text with any other character (unassigned ones, letters and marks of later versions, on which libraries differ by
their age) is encoded by the library itself.

Defined results: null text is encoded as empty text, to no ids; rows are encoded one by one, so repeated rows give repeated
results; an empty table gives an empty table; a column of the input that has a result's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.blocks import pieces, with_columns
from tallyloom.session import ship
from tallyloom.storage import Workspace, share_bytes

#: Pieces of the lexicon: a table of fixed size that any worker can hold.
LEXICON_WORDS = 32768
#: Chunks that a worker remembers between documents, and distinct chunks that it counts before passing them on.
REMEMBERED, COUNTED = 300_000, 200_000
_NONE = np.int64(1) << 40


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the kind byte-level BPE with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = token
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        order = np.argsort(key)
        self.key, self.rank, self.new = np.r_[key[order], _NONE], np.r_[rank[order], len(pairs)], np.r_[new[order], 0]
        made = dict(zip(new.tolist(), rank.tolist(), strict=True))
        #: True if a pair always ranks behind the merges that make its parts, so that all places of a pair merge at once.
        self.ordered = all(made.get(k >> 20, -1) < r and made.get(k & 0xFFFFF, -1) < r for k, r in zip(key.tolist(), rank.tolist(), strict=True))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty), by merging its lowest-ranked pair, leftmost first, until none is left."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        sym = self.inner[data]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list = [None] * len(words)
        none = len(self.key) - 1
        while len(sym):
            pair = np.where(np.r_[word[:-1] == word[1:], False], sym << 20 | np.r_[sym[1:], 0], _NONE)
            at = np.searchsorted(self.key, pair)
            at = np.where(self.key[at] == pair, at, none)
            rank = self.rank[at]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            done = least == none
            if done.any():
                for s, n in zip(starts[done].tolist(), size[done].tolist(), strict=True):
                    out[word[s]] = sym[s : s + n].astype(np.uint32)
            each = np.repeat(least, size)
            hit = (rank == each) & (each != none)
            where = np.flatnonzero(hit)
            if len(where):
                if self.ordered:  # of a run of overlapping places, every second one
                    run = np.r_[True, np.diff(where) > 1]
                    first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                    where = where[(np.arange(len(where)) - first) % 2 == 0]
                else:
                    where = where[np.r_[True, word[where][1:] != word[where][:-1]]]
                sym[where] = self.new[at[where]]
            keep = ~np.repeat(done, size)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# Blocks of symbols later than Unicode 3.2, which have neither case nor composition.
PICTURES = [(0x1F300, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F910, 0x1F93A), (0x1F947, 0x1F9AA)]


def _rare() -> re.Pattern:
    """Finds a character on which versions of Unicode may differ."""
    known = [c for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    edge = [0, *(i for i in range(1, len(known)) if known[i] != known[i - 1] + 1), len(known)]
    spans = [(known[a], known[b - 1]) for a, b in zip(edge, edge[1:])] + PICTURES
    return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]")


_RARE = _rare()
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def chunks(text: str) -> list[str]:
    """Text in NFC and lower case, cut at white space (which never joins, composes or merges with what is beside it)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()  # character by character: no final sigma
    return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()


# --- the lexicon ---------------------------------------------------------------------------------------------------


def build_lexicon(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """The file of a minimal acyclic transducer from words (distinct) to their ids."""
    order = sorted(range(len(words)), key=words.__getitem__)
    # states are (final, ((label, state), ...)); equal ones are one state
    register: dict[tuple, int] = {}
    made: list[tuple] = []

    def settle(node: list) -> int:
        state = (node[0], tuple(node[1]))
        if state not in register:
            register[state] = len(made)
            made.append(state)
        return register[state]

    path: list[list] = [[False, []]]
    before = b""
    for w in (words[i] for i in order):
        same = next((k for k in range(min(len(w), len(before))) if w[k] != before[k]), min(len(w), len(before)))
        while len(path) > same + 1:
            child = settle(path.pop())
            path[-1][1].append((before[len(path) - 1], child))
        for _ in w[same:]:
            path.append([False, []])
        path[-1][0] = True
        before = w
    while len(path) > 1:
        child = settle(path.pop())
        path[-1][1].append((before[len(path) - 1], child))
    root = settle(path[0])
    count = [0] * len(made)
    key, to, skip = [], [], []
    for s, (final, arcs) in enumerate(made):  # children are settled before their parents
        n = int(final)
        for label, child in arcs:
            key.append(s << 8 | label)
            to.append(child)
            skip.append(n)
            n += count[child]
        count[s] = n
    parts = {
        "key": np.array([*key, _NONE], np.int64),
        "to": np.array([*to, 0], np.int32),
        "skip": np.array([*skip, 0], np.int32),
        "final": np.array([f for f, _ in made], np.uint8),
        "start": np.cumsum([0, *(len(ids[i]) for i in order)]).astype(np.int64),
        "ids": np.concatenate([np.empty(0, np.uint32), *(ids[i] for i in order)]).astype(np.uint32),
    }
    head = json.dumps({"root": root, "arrays": [[k, str(a.dtype), len(a)] for k, a in parts.items()]}).encode()
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in parts.values())
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + body


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(bytes(self.raw[:8]), "little")
        head = json.loads(bytes(self.raw[8 : 8 + n]))
        self.root, at, self.part = head["root"], 8 + n, {}
        for name, kind, size in head["arrays"]:
            nbytes = np.dtype(kind).itemsize * size
            self.part[name] = self.raw[at : at + nbytes].view(kind)
            at += nbytes + -nbytes % 8

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word; None for those that aren't in the lexicon."""
        if not words or len(self.part["final"]) == 0:
            return [None] * len(words)
        key, to, skip = self.part["key"], self.part["to"], self.part["skip"]
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, k = np.flatnonzero(size > 0), 0
        while len(live):
            want = state[live] << 8 | data[begin[live] + k]
            at = np.searchsorted(key, want)
            ok = key[at] == want
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            number[live] += skip[at]
            state[live] = to[at]
            k += 1
            live = live[size[live] > k]
        found = (state >= 0) & (self.part["final"][np.maximum(state, 0)] > 0)
        start, ids = self.part["start"], self.part["ids"]
        return [ids[start[n] : start[n + 1]] if f else None for n, f in zip(number.tolist(), found.tolist(), strict=True)]


def frequent_pieces(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pieces of all texts, counted over every document: those of a count that at most `most` pieces reach.

    That count is read off a histogram of counts, so the driver never holds more than `most` pieces.
    """
    ship(docs.sparkSession)

    def flush(seen: Counter):
        out: Counter = Counter()
        for chunk, n in seen.items():
            for p in _PIECE.findall(chunk):
                out[p] += n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["piece", "n"])

    def count(batches):
        seen: Counter = Counter()
        for _, texts in pieces(batches, text_col):
            for t in texts:
                seen.update(chunks(t.decode()))
            if len(seen) > COUNTED:
                yield flush(seen)
                seen.clear()
        yield flush(seen)

    ws = Workspace(docs.sparkSession, "pieces")
    counted = docs.select(text_col).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 8).cast("int")  # eight levels for each power of two: some hundred in all
    counted = ws.cut(counted.withColumn("level", level))
    levels = sorted((tuple(r) for r in counted.groupBy("level").count().collect()), reverse=True)
    least, total = None, 0
    for k, n in levels:
        total += n
        if total > most:
            break
        least = k
    found = [r.piece.encode() for r in counted.where(F.col("level") >= least).select("piece").collect()] if least is not None else []
    ws.drop(counted)
    return found


# --- encoding and decoding -----------------------------------------------------------------------------------------


class Encoder:
    """Encodes texts in one worker."""

    def __init__(self, vocabulary_path: str, lexicon_path: str | None = None):
        self.vocab = vocabulary(vocabulary_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.known: dict[str, bytes] = {}
        self.path, self.library = vocabulary_path, None

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        parts = [_PIECE.findall(c) for c in new]
        kinds = list(dict.fromkeys(p for ps in parts for p in ps))
        raw = [k.encode() for k in kinds]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        unseen = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(unseen, self.vocab.merge([raw[i] for i in unseen]), strict=True):
            ids[i] = x
        of = dict(zip(kinds, (x.tobytes() for x in ids), strict=True))
        for c, ps in zip(new, parts, strict=True):
            self.known[c] = b"".join([of[p] for p in ps])

    def _segments(self, text: str) -> list:
        """Special tokens as bytes of their id, the text between as chunks."""
        out: list = []
        for part in self.vocab.split_special.split(text):
            if part in self.vocab.special:
                out.append(np.uint32(self.vocab.special[part]).tobytes())
            else:
                out.extend(chunks(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        rare = {i: self._by_library(t) for i, t in enumerate(texts) if not t.isascii() and _RARE.search(t)}
        if rare:
            texts = ["" if i in rare else t for i, t in enumerate(texts)]
        special = self.vocab.split_special
        split = [self._segments(t) if special and special.search(t) else chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(dict.fromkeys(c for s in split for c in s if c not in known and isinstance(c, str)))
        if new:
            self._learn(new)
        out = [b"".join([known[c] if isinstance(c, str) else c for c in s]) if special and any(isinstance(c, bytes) for c in s) else b"".join(map(known.__getitem__, s)) for s in split]
        for i, ids in rare.items():
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' texts with a space between (the file has no decoder of its own); special tokens are kept."""
        return " ".join(map(self.vocab.text.__getitem__, ids.tolist()))


def encode_rows(batches, vocabulary_path: str, lexicon: str | None, text_col: str = "text", name: str = "token_ids", drop: tuple[str, ...] = ()):
    """Record batches with the ids of each text in column `name`."""
    encoder = Encoder(vocabulary_path, SparkFiles.get(lexicon) if lexicon else None)
    for rows, texts in pieces(batches, text_col):
        ids = encoder.encode([t.decode() for t in texts])
        offsets = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
        values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        yield with_columns(rows, list(drop), **{name: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


def decode_rows(batches, vocabulary_path: str, ids_col: str = "token_ids", name: str = "decoded"):
    """Record batches with the text that each row's ids stand for in column `name` (null ids: empty)."""
    decoder = Encoder(vocabulary_path)
    for rows in batches:
        col = rows.column(rows.schema.get_field_index(ids_col))
        values, offsets = col.values.to_numpy(), col.offsets.to_numpy()
        yield with_columns(rows, [], **{name: pa.array([decoder.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())})


def digest_rows(batches, ids_col: str = "token_ids", text_col: str = "decoded"):
    """doc_id with the number and digests of a row's ids and decoded text."""
    for rows in batches:
        col = rows.column(rows.schema.get_field_index(ids_col))
        values, offsets = col.values.to_numpy().astype("<u4"), col.offsets.to_numpy()
        sums = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()]
        yield with_columns(rows, [ids_col, text_col], n_tokens=pa.array(np.diff(offsets).astype(np.int64)), ids_sha256=pa.array(sums), decoded_sha256=pa.array(texts))


def corpus_lexicon(docs: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the corpus's frequent pieces into a lexicon file in the shared folder; returns its name."""
    words = frequent_pieces(docs, text_col, most)
    data = build_lexicon(words, vocabulary(vocabulary_path).merge(words))
    return share_bytes(docs.sparkSession, f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}", data)


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", name: str = "token_ids", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """docs with the ids of each whole text in array column `name`."""
    ship(docs.sparkSession)
    lexicon = corpus_lexicon(docs, vocabulary_path, text_col, lexicon_words)
    fields = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda b: encode_rows(b, vocabulary_path, lexicon, text_col, name), schema)


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """df with the text of each row's ids in column `name`."""
    ship(df.sparkSession)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.StringType())])
    return df.mapInArrow(lambda b: decode_rows(b, vocabulary_path, ids_col, name), schema)


def round_trip_digest(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every row in one pass of the workers, without the ids going through the JVM."""
    ship(docs.sparkSession)
    lexicon = corpus_lexicon(docs, vocabulary_path, text_col)

    def run(batches):
        coded = encode_rows(batches, vocabulary_path, lexicon, text_col, drop=(text_col,))
        return digest_rows(decode_rows(coded, vocabulary_path))

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
