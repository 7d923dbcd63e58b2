"""Quality scores: random-indexing word vectors, pooled, into a two-layer network.

Every token has a fixed sparse index vector drawn from its hash.  A frequent
token's word vector is the sum of the index vectors of its neighbours over the
whole corpus; a rare token keeps its index vector.  A text is the mean of its
word vectors with the spread around it and a few shape measures.  The network
is trained in numpy and its logits are divided by a temperature fitted on
labelled rows that training did not see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialise, sliced
from .lm_scoring import held_out

#: Runs of letters, of digits, and of other characters that are no space.
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\sa-z0-9\x80-\xff]+")
#: A-Z first, then the other bytes of letters.
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
FLUSH = 200_000
#: Entries of an index vector that are not zero; distinct tokens of a text whose vectors are held at once.
ONES, POOLED = 4, 50_000


def tokens_of(text: str | None) -> list[bytes]:
    return TOKEN.findall(text.encode().lower()) if text else []


def index_entries(token: bytes, dims: int) -> tuple[list[int], list[int]]:
    """Places and signs of a token's index vector, from its hash."""
    from xxhash import xxh3_128_intdigest

    h, places, signs = xxh3_128_intdigest(token), [], []
    for _ in range(ONES):
        h, at = divmod(h, dims)
        h, sign = divmod(h, 2)
        places.append(at)
        signs.append(1 - 2 * sign)
    return places, signs


def index_vector(token: bytes, dims: int) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    np.add.at(v, *index_entries(token, dims))
    return v


def entries_of(tokens: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """index_entries of each token, as rows of places and of signs."""
    from xxhash import xxh3_128_digest

    words = np.frombuffer(b"".join(map(xxh3_128_digest, tokens)), ">u4").reshape(-1, 4).astype(np.int64)
    places, signs = np.empty((len(tokens), ONES), np.int64), np.empty((len(tokens), ONES))
    for k in range(ONES):
        for by, out in ((dims, places), (2, signs)):
            rest = np.zeros(len(tokens), np.int64)
            for j in range(4):  # long division, the highest word first
                words[:, j], rest = np.divmod((rest << 32) | words[:, j], by)
            out[:, k] = rest
    return places, 1 - 2 * signs


def index_vectors(tokens: list[bytes], dims: int) -> np.ndarray:
    """index_vector of each token, at unit length."""
    places, signs = entries_of(tokens, dims)
    at = np.arange(len(tokens))[:, None] * dims + places
    out = np.bincount(at.ravel(), signs.ravel(), len(tokens) * dims).reshape(-1, dims)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "n"])
        seen.clear()
        return batch

    seen: Counter[bytes] = Counter()
    for batch in sliced(batches):
        for text in batch.column(0):
            seen.update(tokens_of(text.as_py()))
            if len(seen) > FLUSH:
                yield out()
    if seen:
        yield out()


def _context_sums(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        size = len(index) + 1
        sums = np.zeros(size * dims)
        known = entries_of([*index], dims)
        for batch in sliced(batches):
            # numbers beyond the vocabulary are the batch's other tokens, which are neighbours only
            local: dict[bytes, int] = {}
            ids = []
            for text in batch.column(0):
                found = tokens_of(text.as_py())
                row = np.fromiter(map(index.get, found, repeat(0)), np.int64, len(found))
                for at in np.flatnonzero(row == 0):
                    row[at] = size + local.setdefault(found[at], len(local))
                ids += [row, np.zeros(1, np.int64)]  # 0 between texts, without entries
            ids = np.concatenate(ids or [np.zeros(0, np.int64)])
            own = entries_of([*local], dims)
            places, signs = (np.concatenate([np.zeros((1, ONES), k.dtype), k, o]) for k, o in zip(known, own))
            for a in range(0, len(ids), 500_000):
                part = ids[a : a + 500_001]
                for of, by in ((part[:-1], part[1:]), (part[1:], part[:-1])):
                    kept = (of > 0) & (of < size)
                    of, by = of[kept], by[kept]
                    sums += np.bincount((of[:, None] * dims + places[by]).ravel(), signs[by].ravel(), size * dims)
        sums = sums.reshape(size, dims)
        rows = [k for k in range(1, size) if sums[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([sums[k].tolist() for k in rows], pa.list_(pa.float64()))], names=["token", "sums"])

    return run


def _added(size: int, dims: int):
    """One row for each token of a partition: the sum of its vectors, which are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((size, dims)), np.zeros(size, bool)
        for batch in sliced(batches, 4096):
            tokens = batch.column(0).to_numpy()
            np.add.at(sums, tokens, batch.column(1).flatten().to_numpy().reshape(len(tokens), dims))
            seen[tokens] = True
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(sums[rows].tolist(), pa.list_(pa.float64()))], names=["token", "sums"])

    return run


class WordVectors:
    """Unit vectors by token: context sums for the known ones, index vectors for others."""

    def __init__(self, index: dict[bytes, int], sums: np.ndarray):
        self.index, self.dims = index, sums.shape[1]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        self.vectors = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)

    def features(self, text: str | None) -> np.ndarray:
        """Pooled vector, its distances to the rest, and measures of shape, all in a small range."""
        tokens = tokens_of(text)
        n = len(tokens)
        out = np.zeros(2 * self.dims + N_SHAPES, np.float32)
        if not n:
            return out
        counts = Counter(tokens)
        times = np.fromiter(counts.values(), np.float32, len(counts))
        ids = np.fromiter(map(self.index.get, counts, repeat(0)), np.int64, len(counts))
        head = np.fromiter(map(itemgetter(0), counts), np.uint8, len(counts))
        letter, digit = (head >= 128) | (head >= 97) & (head <= 122), (head >= 48) & (head <= 57)
        weights = times / n
        names, pooled, squares = [*counts], 0, 0
        for at in range(0, len(ids), POOLED):
            s = slice(at, at + POOLED)
            own = self.vectors[ids[s]]
            new = np.flatnonzero(ids[s] == 0)
            if len(new):
                own[new] = index_vectors([names[at + k] for k in new], self.dims)
            pooled, squares = pooled + weights[s] @ own, squares + weights[s] @ own**2
        out[: self.dims] = pooled
        out[self.dims : 2 * self.dims] = np.sqrt(squares)
        raw = text.encode()
        letters = len(raw) - len(raw.translate(None, LETTERS))
        upper = len(raw) - len(raw.translate(None, LETTERS[:26]))
        words = len(raw.split())
        out[2 * self.dims :] = [
            np.log1p(n) / 10,
            len(counts) / n,
            weights.max(),
            times[times > 1].sum() / n,
            letters / max(1, len(raw)),
            upper / max(1, letters),
            weights[~letter & ~digit].sum(),
            min(1.0, len(raw) / max(1, words) / 20),
            weights[ids == 0].sum(),
            np.count_nonzero((ids == 0) & (times > 2)) / len(counts),
        ]
        return out


N_SHAPES = 10


class Network:
    """tanh layer, then a logit; Adam on the log loss; a temperature at the end."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 9, decay: float = 1e-3):
        rng = np.random.default_rng(seed)
        last = rng.random(len(x)) < 0.2
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        fit = np.flatnonzero(~last)
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 128):
                k = fit[at : at + 128]
                h = np.tanh(z[k] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[k]) / len(k)
                dh = d[:, None] * w[2] * (1 - h**2)
                g = [z[k].T @ dh + decay * w[0], dh.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True)]
                step += 1
                for i in range(4):
                    m[i] = 0.9 * m[i] + 0.1 * g[i]
                    v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                    w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if last.any():
            logits = self.logits(x[last])
            losses = {t: np.mean(np.logaddexp(0, np.where(y[last] > 0, -logits, logits) / t)) for t in np.geomspace(0.25, 8, 61)}
            self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-40, 40)))


def _features_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [shared.value.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    return run


def _score(vectors, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                x = np.array([vectors.value.features(t.as_py()) for t in batch.column(1)], np.float32).reshape(batch.num_rows, -1)
                scores = model.scores(x) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def word_vectors(texts: DataFrame, vocabulary: int = 4096, dims: int = 64) -> WordVectors:
    """Word vectors of the ``vocabulary`` most frequent tokens of ``texts`` (one column), from all of its neighbours.

    Each task keeps one vector of sums by token and hands it over once.
    """
    counts = texts.mapInArrow(_count_tokens, T.StructType([field("token", T.BinaryType()), field("n", T.LongType())])).groupBy("token").agg(F.sum("n").alias("n"))
    top = [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "token").limit(vocabulary).collect()]
    index = {t: k + 1 for k, t in enumerate(top)}
    shared = texts.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([field("token", T.IntegerType()), field("sums", T.ArrayType(T.DoubleType()))])
    partial = texts.mapInArrow(_context_sums(shared, dims), schema)
    got = partial.repartition("token").mapInArrow(_added(len(index) + 1, dims), schema).collect()  # a row for each word of the vocabulary
    sums = np.zeros((len(index) + 1, dims))
    for token, values in got:
        sums[token] += values
    return WordVectors(index, sums)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 8000, vocabulary: int = 4096, dims: int = 64):
    """(broadcast word vectors, network or None) from all texts and at most ``max_labelled`` labelled rows.

    The labelled rows taken are those with the smallest hash of the id, so that
    the sample is the same at each run.  An id with labels of both kinds is left
    out; labels that repeat count once, other values of ``label_col`` and null
    ids not at all.  Without labels of both kinds there is no network.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(texts, vocabulary, dims))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    clear = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    chosen = materialise(clear.orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")  # at most max_labelled rows
    table = rows.mapInArrow(_features_of(vectors), T.StructType([field("x", T.ArrayType(T.FloatType())), field("y", T.IntegerType())])).toPandas()
    if table["y"].nunique() < 2:
        return vectors, None
    x = np.array(table["x"].tolist(), np.float64)
    order = np.lexsort((*x.T[:8], table["y"].to_numpy()))
    return vectors, Network(x[order], table["y"].to_numpy(float)[order])


def classify(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row of ``docs``; score is the calibrated probability of label 1.

    Null and empty texts are scored as a text without tokens; without a network
    every score is 0.5.  Null and repeated ids come out as they went in, an empty
    table gives no row, and no other column is read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(*fitted), T.StructType([rows.schema[0], field("score", T.DoubleType())]))


__all__ = ["classify", "fit_classifier", "held_out", "word_vectors"]
