"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator (operator 4).

Trusted positives are rows labelled 1; unlabelled text is that of all documents, whatever their label, which isn't read. With the
class prior p, a scorer g and the logistic loss, the risk is p*E_pos[l(g)] + max(0, E_unl[l(-g)] - p*E_pos[l(-g)]): the second part, an
unbiased estimate of the negatives' risk, is kept from going below zero, where a flexible model would fit noise.

The fit starts on bounded samples (of positives, and of documents by a hash). Then the unlabelled part of the risk and of its gradient is summed
over all documents by Spark, once for each of a few Newton steps, whose curvature is that of the sample; a step that makes the risk larger, or
the negatives' risk less than zero, is tried again at a quarter of its length. Features are written once for this, in 16 bits.

The prior is estimated from the two samples: of scores on rows that a first scorer hasn't seen, the least ratio of the unlabelled
share above a threshold to the positives' share above it, with a margin for the size of the samples. (Where only positives score high, that
ratio is the share of positives.) The share of 1 among labelled rows is kept beside it, for comparison.

The scorer is logistic in features of the text alone: words, pairs of words and strings of four bytes, hashed, and the text's shape
(shares of byte classes, repetition, word and line lengths) with squares.

Defined results: null text is scored as empty text; every row gets a score, repeated rows the same; labels that are null count as
no labels; documents without an id are unlabelled text like any other; of repeated ids of labels one counts; without any positive label every score is the prior (1 if there are no labels at all); an empty table
gives an empty table; input columns named like a result are replaced.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.blocks import pieces, trim, with_columns
from tallyloom.session import ship
from tallyloom.storage import Workspace

THRESHOLD = 0.3
#: Places of the hashed features, by kind.
WORDS, PAIRS, GRAMS = 512, 256, 256
SUMMERS = 16
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_SHAPE = len(_PUNCT) + 18


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Numbers that describe a text's shape, not its subject or language."""
    n = len(text)
    if not n:
        return [0.0] * _SHAPE
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    lines = text.split(b"\n")
    m = max(1, len(words))
    kinds = len(set(words))
    sizes = [len(w) for w in words] or [0]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(w.isalpha() for w in words)
    return [
        float(hist[65:91].sum()),
        float(hist[97:123].sum()),
        float(hist[48:58].sum()),
        float(hist[128:].sum()),
        float(hist[32]),
        float(hist[9:14].sum()),
        float(hist[:32].sum()),
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        kinds / m,
        same / m,
        np.log1p(m / max(1, kinds)),
        sum(sizes) / m / 10,
        max(sizes) / 50 if max(sizes) < 50 else 1.0,
        letters / m,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        sum(w[:1].isupper() for w in words) / m,
        *(float(hist[c]) for c in _PUNCT),
    ]


def _root(hashes: np.ndarray, places: int) -> np.ndarray:
    """Square roots of the shares of hashed features."""
    n = np.bincount(hashes, minlength=places)
    return np.sqrt(n / max(1, len(hashes)))


def features(text: bytes) -> np.ndarray:
    words = text.split()
    low = np.fromiter(map(crc32, text.lower().split(), repeat(0)), np.uint64, -1)
    pair = (low[:-1] * np.uint64(0x9E3779B97F4A7C15) + low[1:] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    gram = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(20) if len(raw) > 3 else np.empty(0, np.uint32)
    hashed = [_root((low % np.uint64(WORDS)).astype(np.int64), WORDS), _root((pair % np.uint64(PAIRS)).astype(np.int64), PAIRS), _root((gram % GRAMS).astype(np.int64), GRAMS)]
    return np.concatenate([shape(text, words), *hashed]).astype(np.float32)


def feature_rows(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """docs without the text, with its features in 16 bits each."""
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (text_col, name)]

    def scan(batches):
        for rows, texts in pieces(batches, text_col):
            yield with_columns(rows, [text_col], **{name: pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())})

    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField(name, T.BinaryType())]))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Features as feature_rows packs them, a row for each text."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(len(col), -1 if len(col) else 0).astype(np.float32)


class Model:
    """A logistic scorer over standardised shapes, their squares, and hashed features."""

    def __init__(self, prior: float, mean=None, scale=None, weights=None, labelled_share: float | None = None):
        self.prior, self.mean, self.scale, self.weights, self.labelled_share, self.risk = prior, mean, scale, weights, labelled_share, None

    def design(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        out = np.ones((len(x), 1 + n + _SHAPE), np.float32)
        z = np.subtract(x, self.mean, out=out[:, 1 : n + 1])
        z /= self.scale
        np.clip(z, -8, 8, out=z)
        out[:, n + 1 :] = z[:, :_SHAPE] ** 2 / 8
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), float(self.prior))
        return _sigmoid((self.design(x) @ self.weights).astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, decay: float | None = None) -> Model:
    """Minimise the non-negative unbiased risk by full-batch Adam steps; the same data gives the same model.

    decay holds the weights back the more, the fewer the positives are (12 over their number, unless it is given).
    """
    if not len(positive) or not len(unlabelled):
        return Model(prior)
    share = len(positive) / (len(positive) + len(unlabelled))
    mean = share * positive.mean(axis=0) + (1 - share) * unlabelled.mean(axis=0)
    square = share * ((positive - mean) ** 2).mean(axis=0) + (1 - share) * ((unlabelled - mean) ** 2).mean(axis=0)
    model = Model(prior, mean.astype(np.float32), (np.sqrt(square) + 0.01).astype(np.float32))
    p, u = model.design(positive), model.design(unlabelled)
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    prior, decay = min(prior, 0.995), max(1e-3, 12 / len(p)) if decay is None else decay
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        rest = np.mean(-np.log(1 - su + 1e-7)) - prior * np.mean(-np.log(1 - sp + 1e-7))
        rest_grad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        # below zero the estimate is noise: step back up
        grad = prior * (p.T @ (sp - 1)) / len(p) + rest_grad if rest >= 0 else -rest_grad
        grad = grad + decay * np.r_[np.float32(0), w[1:]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - np.float32(rate * 0.1 ** (t / rounds)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = w.astype(np.float32)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows."""
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    half = lambda x, k: x[k::2]
    shares = []
    for k in (0, 1):
        # any prior in the middle ranks rows alike
        model = fit(half(positive, k), half(unlabelled, k), 0.5, rounds=120)
        p, u = np.sort(model.score(half(positive, 1 - k))), np.sort(model.score(half(unlabelled, 1 - k)))
        at = np.quantile(p, np.linspace(0.02, 0.9, 89))
        above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        margin = np.sqrt(above_u * (1 - above_u) / len(u)) + np.sqrt(above_p * (1 - above_p) / len(p))
        shares.append(float(np.min((above_u + margin) / above_p)))
    return float(np.clip(np.mean(shares), 0.01, 0.99))


def _place(*cols: str) -> Column:
    """A place from 0 to 1, by a hash."""
    return F.xxhash64(F.lit("sample"), *cols) / F.lit(float(1 << 64)) + 0.5


def unlabelled_sums(rows: DataFrame, model: Model) -> tuple[int, float, np.ndarray]:
    """(number of rows, their loss as negatives, its gradient by the weights), summed over all rows of feature_rows.

    A task sends one row; these are added up by SUMMERS tasks, so that the driver reads at most as many rows however large the table is.
    """

    def row(n: int, loss: float, grad: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], names=["n", "loss", "grad"])

    def part(batches):
        n, loss, grad = 0, 0.0, np.zeros(len(model.weights))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = model.design(matrix(batch.column(0).slice(at, 1024)))
                g = (x @ model.weights).astype(np.float64)
                n, loss, grad = n + len(x), loss + float(np.logaddexp(0, g).sum()), grad + _sigmoid(g).astype(np.float32) @ x
        if n:
            yield row(n, loss, grad)

    def add(batches):
        n, loss, grad = 0, 0.0, np.zeros(len(model.weights))
        for batch in batches:
            for m, more, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, loss, grad = n + m, loss + more, grad + np.frombuffer(g)
        if n:
            yield row(n, loss, grad)

    schema = "n long, loss double, grad binary"
    got = rows.select("features").mapInArrow(part, schema).repartition(SUMMERS).mapInArrow(add, schema).collect()
    return sum(r.n for r in got), sum(r.loss for r in got), sum((np.frombuffer(r.grad) for r in got), np.zeros(len(model.weights)))


def refine(model: Model, positive: np.ndarray, sample: np.ndarray, prior: float, sums, passes: int = 10) -> Model:
    """Newton steps from the model's weights on the risk whose unlabelled part is sums(model), as unlabelled_sums gives it, in at most `passes` calls.

    The curvature is the sample's, taken once. The model has the risk of its weights afterwards (None where every call found the negatives' risk below zero).
    """
    if model.weights is None:
        return model
    prior, decay = min(prior, 0.995), max(1e-3, 12 / len(positive))
    p, u = model.design(positive), model.design(sample)
    held = np.r_[0.0, np.full(p.shape[1] - 1, decay)]
    s = _sigmoid((u @ model.weights).astype(np.float64))
    curve = (u * (s * (1 - s)).astype(np.float32)[:, None]).T @ u / np.float32(len(u)) + np.diag(held + 1e-6)
    centre = p.mean(axis=0, dtype=np.float64)

    def risk(w: np.ndarray) -> tuple[float, float, np.ndarray]:
        at = Model(prior, model.mean, model.scale, w.astype(np.float32))
        n, loss, grad = sums(at)
        g = (p @ at.weights).astype(np.float64)
        negatives = loss / n - prior * np.logaddexp(0, g).mean()
        return prior * np.logaddexp(0, -g).mean() + max(0.0, negatives) + held @ (w * w) / 2, negatives, grad / n - prior * centre + held * w

    w, step, left = model.weights.astype(np.float64), 1.0, passes - 1
    value, negatives, grad = risk(w)
    while negatives < 0 and left:  # at zero weights it is (1 - prior) * log 2
        w, left = w * 0.7, left - 1
        value, negatives, grad = risk(w)
    while negatives >= 0 and left and step > 1 / 100:
        move = np.linalg.solve(curve, grad)
        if grad @ move < 1e-6:
            break
        new, left = w - step * move, left - 1
        found = risk(new)
        if found[1] >= 0 and found[0] < value:
            w, step = new, min(1.0, 2 * step)
            value, negatives, grad = found
        else:
            step /= 4
    model.weights, model.risk = w.astype(np.float32), float(value) if negatives >= 0 else None
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_positive: int = 4000, most_start: int = 4000, passes: int = 10) -> Model:
    """Fit on at most most_positive rows labelled 1 and on all of docs, unlabelled, which are read at most `passes` times as features.

    The positives are the first by a hash of the id; may_learn says which labels may be used at all. The first most_start documents by a hash give the
    scale of the features, the prior, the start of the fit and its curvature. Both bounds keep the fit on the driver small (some 100 MB).
    """
    known = labels.where(may_learn & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.withColumn("rank", _place("id"))
    labelled, ones = known.agg(F.count("y"), F.count_if(F.col("y") == 1)).first()
    share = ones / labelled if labelled else 1.0
    if not ones:
        return Model(share, labelled_share=share)
    ws = Workspace(docs.sparkSession, "quality")
    texts = docs.select(F.col(id_col).alias("id"), _place(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    rows = ws.cut(feature_rows(texts))

    def first(of: DataFrame, order: str, most: int, n: int) -> np.ndarray:
        """By a threshold on the hash, a little more than `most` rows; what is over is cut off behind."""
        few = of.where(F.col(order) < (most + 5 * most**0.5) / max(n, 1))
        return matrix(few.select(order, "features").distinct().orderBy(order, "features").limit(most).select("features").toArrow().column(0))

    chosen = known.where("y = 1").where(F.col("rank") < (most_positive + 5 * most_positive**0.5) / ones)  # bounded by the parameter
    pos = first(rows.join(F.broadcast(chosen.select("id", "rank")), "id"), "rank", most_positive, ones)
    if not len(pos):
        ws.drop(rows)
        return Model(share, labelled_share=share)
    start = first(rows, "place", most_start, rows.count())
    prior = estimate_prior(pos, start)
    model = refine(fit(pos, start, prior), pos, start, prior, lambda at: unlabelled_sums(rows, at), passes)
    model.labelled_share = share
    ws.drop(rows)
    del pos, start
    trim()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]

    def scan(batches):
        for rows, texts in pieces(batches, text_col):
            s = model.score(np.array([features(t) for t in texts]))
            yield with_columns(rows, [], score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels may not be learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
