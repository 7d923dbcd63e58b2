"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The corpus is counted by executors.  A symbol is one of the most frequent words,
the end of a text, or one of the classes that all other words are hashed into.
A log-bilinear model of two context symbols is trained in numpy: the vector of
each context symbol times the matrix of its position, summed, predicts the next
symbol's vector, and the score is their product plus a bias.  Two symbols back
only the most frequent ones are told apart, so that all contexts are few enough
to be normalised once, by batched matrix products.  A word outside the
vocabulary has the probability of its class times its smoothed share of it.

One task trains first, on a bounded share of the texts; then every task trains
on its own texts as they come by, each text in one of several rounds, and models
are averaged by the events that they saw, level by level.  So the events grow
with the corpus, and a task's work does not.

Frequent words are looked up in a broadcast table of bounded length; rare words
meet their counts in a join, so that no table of all words is ever gathered.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialise, sliced, words_of

#: No word holds a space, so this token is the end of a text and nothing else.
END = b" "
FLUSH = 300_000
#: Rounds that the texts are dealt to; models that are averaged at once, and that the driver takes.
ROUNDS, FAN_IN, GATHERED = 3, 16, 8
#: Events that a task holds at once, and bytes of a word that may stand in the lookup.
HELD_EVENTS, LOOKED_UP_BYTES = 65_536, 200


def held_out(id_col: str, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder`` by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == remainder, F.lit(False))


# counting -------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    seen: Counter[bytes] = Counter()
    for batch in sliced(batches):
        for text in batch.column(0):
            seen.update(words_of(text.as_py()))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield out()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of ``texts`` (one column) and the ends."""
    schema = T.StructType([field("word", T.BinaryType()), field("n", T.LongType())])
    return texts.mapInArrow(_count_words, schema).groupBy("word").agg(F.sum("n").alias("n"))


def symbol_table(words: list[bytes], vocabulary: int, classes: int) -> np.ndarray:
    """Symbols of the numbers of looked-up words: 1 to ``vocabulary`` are themselves, class 0 is 0, class c is vocabulary + c."""
    of = np.arange(len(words) + 1)
    of[vocabulary + 1 :] = class_symbols(words[vocabulary:], vocabulary, classes)
    return of


def class_symbols(words: list[bytes], vocabulary: int, classes: int) -> list[int]:
    return [vocabulary + c if (c := zlib.crc32(w) % classes) else 0 for w in words]


def symbols_of(words: list[bytes], ids: np.ndarray, table: np.ndarray, vocabulary: int, classes: int) -> np.ndarray:
    out = table[ids]
    rare = np.flatnonzero(ids == 0)
    out[rare] = class_symbols([words[i] for i in rare], vocabulary, classes)
    return out


def contexts(symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two back, one back, next) of each symbol of a text and its end; a text begins after ends."""
    one = np.r_[end, symbols]
    return np.r_[end, one[:-1]], one, np.r_[symbols, end]


# the model ------------------------------------------------------------------


class LogBilinear:
    """score(next | one, two back) = (context[one] @ mix[0] + context[far(two)] @ mix[1]) . target[next] + bias[next].

    far(symbol) is the symbol itself below ``far``, else 0.
    """

    def __init__(self, size: int, dims: int, unigram: np.ndarray, far: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.far = min(far, size)
        self.noise = unigram / unigram.sum()
        self.context = rng.normal(0, 0.1, (size, dims)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (size, dims)).astype(np.float32)
        self.mix = np.concatenate([np.eye(dims), np.eye(dims)]).astype(np.float32)  # a matrix for each position
        self.bias = np.log(self.noise).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-2, np.float32) for x in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.mix, self.bias]

    def state(self) -> np.ndarray:
        """All parameters and Adagrad sums as one row."""
        return np.concatenate([x.ravel() for x in [*self.parts(), *self.sums]])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for x in [*self.parts(), *self.sums]:
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size

    def train(self, two: np.ndarray, one: np.ndarray, true: np.ndarray, rng: np.random.Generator, batch: int = 1024, noise: int = 32, rate: float = 0.1) -> None:
        """Noise-contrastive estimation by Adagrad over the events in order: tell observed next symbols from ``noise`` ones drawn for each batch."""
        dims = self.context.shape[1]
        noise_ends = np.cumsum(self.noise)
        log_noise = np.log(noise * self.noise).astype(np.float32)
        two = np.where(two < self.far, two, 0)
        parts, sums, all_mix = self.parts(), self.sums, np.arange(2 * dims)
        small = np.int16 if len(self.noise) < 1 << 15 else np.int64  # sorts by counting

        def gathered(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each row that is named, once, with the sum of its gradients."""
            order = np.argsort(rows.astype(small), kind="stable")
            rows = rows[order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            return rows[starts], np.add.reduceat(grad[order], starts, axis=0)

        def step(k: int, rows: np.ndarray, total: np.ndarray) -> None:
            sums[k][rows] += total**2
            parts[k][rows] -= rate * total / np.sqrt(sums[k][rows])

        for at in range(0, len(true), batch):
            prev, before, wanted_at = one[at : at + batch], two[at : at + batch], true[at : at + batch]
            drawn = np.searchsorted(noise_ends, rng.random(noise) * noise_ends[-1], side="right").clip(max=len(self.noise) - 1)
            first, second = self.positions()
            guess = first[prev] + second[before]
            wanted, other = self.target[wanted_at], self.target[drawn]
            good = 1 / (1 + np.exp((guess * wanted).sum(1) + self.bias[wanted_at] - log_noise[wanted_at])) * -1  # slope at the observed symbol
            bad = 1 / (1 + np.exp(-(guess @ other.T + self.bias[drawn] - log_noise[drawn])))
            d_guess = good[:, None] * wanted + bad @ other
            # a context's gradients are summed by symbol before they meet the matrices
            (u, of_u), (v, of_v) = gathered(prev, d_guess), gathered(before, d_guess)
            d_mix = np.concatenate([self.context[u].T @ of_u, self.context[v].T @ of_v])
            to_u, to_v = of_u @ self.mix[:dims].T, of_v @ self.mix[dims:].T
            rows = np.r_[wanted_at, drawn]
            t, of_t = gathered(rows, np.concatenate([good[:, None] * guess, bad.T @ guess]))
            of_bias = np.bincount(rows, np.r_[good, bad.sum(0)], len(self.bias)).astype(np.float32)[t]
            step(0, u, to_u)
            step(0, v, to_v)
            step(1, t, of_t)
            step(3, t, of_bias)
            step(2, all_mix, d_mix)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol adds to the prediction, one back and two back."""
        dims = self.context.shape[1]
        return self.context @ self.mix[:dims], self.context[: self.far] @ self.mix[dims:]

    def normalisers(self, two: int, rows: int = 512) -> np.ndarray:
        """ln of the sum over all next symbols of exp(score), for each symbol one back and the given one two back."""
        first, second = self.positions()
        out = np.empty(len(first), np.float32)
        for at in range(0, len(out), rows):
            scores = (first[at : at + rows] + second[two]) @ self.target.T + self.bias
            top = scores.max(1)
            scores -= top[:, None]
            out[at : at + rows] = np.log(np.exp(scores, out=scores).sum(1)) + top
        return out

    def log_probabilities(self, two: int) -> np.ndarray:
        """log10 P(next | one back, ``two``) for all of both; each row sums to one."""
        first, second = self.positions()
        scores = (first + second[two if two < self.far else 0]) @ self.target.T + self.bias
        return (scores - self.normalisers(two if two < self.far else 0)[:, None]) / np.log(10)


_STATES = T.StructType([field("n", T.LongType()), field("state", T.BinaryType())])


def _state_batch(n: int, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([state.tobytes()], pa.binary())], names=["n", "state"])


def _train_texts(shared, turn: int, batch: int, least: int = 0):
    """The state of the model after the texts of a partition, and their events; they are gone over again until ``least`` events were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table, vocabulary, classes, model = shared.value
        end, rng = index.get(END, 0), np.random.default_rng([turn, TaskContext.get().partitionId()])
        state, seen = model.state(), 0  # the broadcast value stays as it is
        held: list[tuple] = []
        kept: list[tuple] = []
        waiting = 0

        def train(events: tuple) -> None:
            nonlocal seen
            model.train(*events, rng, batch)
            seen += len(events[0])

        for part in sliced(batches):
            for text in part.column(0):
                words = words_of(text.as_py())
                ids = np.fromiter((index.get(w, 0) for w in words), np.int64, len(words))
                held.append(contexts(symbols_of(words, ids, table, vocabulary, classes), end))
                waiting += len(words) + 1
                if waiting >= HELD_EVENTS:
                    events = tuple(map(np.concatenate, zip(*held)))
                    train(events)
                    kept += [tuple(x.astype(np.int32) for x in events)] if least else []
                    held, waiting = [], 0
        if held:
            events = tuple(map(np.concatenate, zip(*held)))
            train(events)
            kept += [events] if least else []
        while least and kept and seen < least:
            for k in rng.permutation(len(kept)):
                by = rng.permutation(len(kept[k][0]))
                train(tuple(x[by] for x in kept[k]))
        out = model.state()
        model.load(state)
        if seen:
            yield _state_batch(seen, out)

    return run


def _mean(table: pa.Table) -> pa.Table:
    weights = np.array(table.column("n").to_pylist(), np.float64)
    total = 0.0
    for w, state in zip(weights / weights.sum(), table.column("state")):
        total = total + w * np.frombuffer(state.as_py(), np.float32)
    return pa.table([pa.array([int(weights.sum())]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["n", "state"])


def averaged(states: DataFrame) -> pa.Table | None:
    """One row (n, state): the mean by events of all models; groups of them are averaged by executors until the driver takes few."""
    states = materialise(states, "none")
    count = states.count()
    while count > GATHERED:
        groups = -(-count // FAN_IN)
        dealt = states.withColumn("group", F.pmod(F.xxhash64("state"), F.lit(groups)))
        states = materialise(dealt.groupBy("group").applyInArrow(lambda t: _mean(t.select(["n", "state"])), _STATES), "none")
        count = states.count()
    return _mean(states.toArrow()) if count else None


def train_on_texts(model: LogBilinear, texts: DataFrame, lookup: tuple, total: int, steps: int, batch: int = 4096) -> int:
    """Train ``model`` on ``texts`` (one column); the events seen, at least as many as the texts have.

    One task sees about ``steps`` * 1024 events first.  Where the texts have more,
    each of them is seen once after that, in one of ROUNDS rounds.
    """
    spark, first = texts.sparkSession, steps * 1024
    seen = 0
    share = min(1.0, first / max(1, total))
    rounds = [(texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).repartition(1), 1024, first)]
    if total > first:
        rounds += [(texts.where(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(ROUNDS)) == k), batch, 0) for k in range(ROUNDS)]
    for turn, (part, size, least) in enumerate(rounds):
        shared = spark.sparkContext.broadcast((*lookup, model))
        found = averaged(part.mapInArrow(_train_texts(shared, turn, size, least), _STATES))
        if found is not None:
            model.load(np.frombuffer(found.column("state")[0].as_py(), np.float32))
            seen += found.column("n")[0].as_py()
        shared.unpersist()
    return seen


def normaliser_table(spark, model: LogBilinear) -> np.ndarray:
    """normalisers() of all contexts, (two back, one back): a row for each symbol that is told apart two back, made by executors."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for two in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([two]), pa.array([shared.value.normalisers(two)], pa.list_(pa.float32()))], names=["two", "z"])

    rows = spark.range(0, model.far, 1, min(model.far, 32)).mapInArrow(run, T.StructType([field("two", T.LongType()), field("z", T.ArrayType(T.FloatType()))])).toArrow()
    out = np.empty((model.far, len(model.bias)), np.float32)
    for two, z in zip(rows.column("two").to_pylist(), rows.column("z")):
        out[two] = z.values.to_numpy()
    shared.unpersist()
    return out


# scoring --------------------------------------------------------------------


def text_score(model: LogBilinear, positions: tuple, normalisers: np.ndarray, symbols: np.ndarray, end: int) -> float:
    """ln P of a text's symbols and its end."""
    (first, second), total = positions, 0.0
    whole = contexts(symbols, end)
    for at in range(0, len(symbols) + 1, HELD_EVENTS):
        two, one, after = (x[at : at + HELD_EVENTS] for x in whole)
        two = np.where(two < model.far, two, 0)
        fit = np.einsum("ij,ij->i", first[one] + second[two], model.target[after]) + model.bias[after] - normalisers[two, one]
        total += float(fit.sum(dtype=np.float64))
    return total


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vocab, base, rare, model, normalisers, symbols, classes = shared.value
        positions, end = model.positions(), index.get(END, 0)
        base, rare = np.r_[0.0, base], np.r_[0.0, rare]
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                ids = np.fromiter((index.get(w, 0) for w in words), np.int64, len(words))
                tail = Counter(words[i] for i in np.flatnonzero(ids == 0))
                short = symbols_of(words, ids, symbols, len(vocab), classes)
                score = text_score(model, positions, normalisers, short, end) / math.log(10) + rare[ids].sum()
                known = np.count_nonzero(ids) + (end > 0)
                rows.append((row, len(words) + 1, known, base[ids].sum() + base[end], score, [*tail.keys()], [*tail.values()]))
                row += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "row", "n_tokens", "n_known", "base", "score", "tail", "times"])

    return run


def fit(texts: DataFrame, vocabulary: int = 2048, looked_up: int = 100_000, dims: int = 48, steps: int = 1500, classes: int = 512, far: int = 128):
    """(counts, statistics, shared) from the training texts, one column.

    counts is the table of all words; shared is the broadcast of the first
    ``looked_up`` words and the model over the first ``vocabulary`` of them and
    ``classes`` of all other words; ``far`` symbols are told apart two back.  The
    bounds are independent of the input; words of more than LOOKED_UP_BYTES are
    joined like rare ones.  All texts are counted, and training sees each of them.
    """
    spark = texts.sparkSession
    texts = texts.toDF("text")
    counts = materialise(word_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    first = counts.where(F.length("word") <= LOOKED_UP_BYTES).orderBy(F.desc("n"), "word").limit(looked_up).toArrow()
    top = [*zip(first.column("word").to_pylist(), first.column("n").to_pylist())]
    if top and END not in [w for w, _ in top[:vocabulary]]:  # the model holds the end whatever its rank
        ends = counts.where(F.col("word") == F.lit(bytearray(END))).first()["n"]
        top = [x for x in top if x[0] != END]
        top = [*top[: vocabulary - 1], (END, ends), *top[vocabulary - 1 : looked_up - 1]]
    index = {w: k + 1 for k, (w, _) in enumerate(top)}
    vocab = [w for w, _ in top[:vocabulary]]
    common = sum(n for _, n in top[: len(vocab)])
    other, kinds = total - common, distinct - len(vocab)
    mass, members = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for c, n, k in counts.groupBy(_class_of("word", classes)).agg(F.sum("n"), F.count("*")).collect():
        mass[c], members[c] = n, k
    for w, n in top[: len(vocab)]:
        mass[zlib.crc32(w) % classes] -= n
        members[zlib.crc32(w) % classes] -= 1
    below = mass + 0.5 * (members + 1)
    base = np.array([np.log10((n + 0.5) / (total + 0.5 * (distinct + 1))) for _, n in top])
    rare = np.array([0.0 if k < len(vocab) else np.log10((n + 0.5) / below[zlib.crc32(w) % classes]) for k, (w, n) in enumerate(top)])
    symbols = symbol_table([w for w, _ in top], len(vocab), classes)
    unigram = np.array([max(1, mass[0]), *(n for _, n in top[: len(vocab)]), *np.maximum(1, mass[1:])], np.float64)
    model, draws = LogBilinear(len(vocab) + classes, dims, unigram, far), 0
    if vocab:
        draws = train_on_texts(model, texts, (index, symbols, len(vocab), classes), total, steps)
    shared = spark.sparkContext.broadcast((index, vocab, base, rare, model, normaliser_table(spark, model), symbols, classes))
    return counts, {"total": total, "distinct": distinct, "other": other, "kinds": kinds, "top": len(top), "below": below.tolist(), "draws": draws}, shared


def _class_of(word: str, classes: int):
    return F.pmod(F.crc32(word), F.lit(classes)).cast("int")


def score(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each row of ``docs``.

    Null and empty texts are the end alone.  One row comes out for each row that
    goes in, null and repeated ids included; other columns are not read.  A word
    that training never held counts 0 in both scores; without training texts all
    words do, and the model is uniform over the classes.
    """
    counts, stats, shared = fitted
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbers = [field("row", T.LongType()), field("n_tokens", T.LongType()), field("n_known", T.LongType()), field("base", T.DoubleType()), field("score", T.DoubleType())]
    schema = T.StructType([rows.schema[0], *numbers, field("tail", T.ArrayType(T.BinaryType())), field("times", T.ArrayType(T.LongType()))])
    scored = materialise(rows.mapInArrow(_score(shared), schema))
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    total, distinct = (float(stats[k]) for k in ("total", "distinct"))
    base = F.col("times") * F.log10((n + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    rare = F.col("times") * F.log10((n + 0.5) / F.col("below"))
    found = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    below = docs.sparkSession.createDataFrame([*enumerate(stats["below"])], "class int, below double")  # a row for each class
    of_class = tail.join(counts, "word", "left").withColumn("class", _class_of("word", len(stats["below"]))).join(F.broadcast(below), "class")
    sums = of_class.groupBy("row").agg(F.sum(base).alias("tail_base"), F.sum(rare).alias("tail_rare"), F.sum(found).alias("tail_known"))
    zero = F.lit(0.0)
    return scored.drop("tail", "times").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("tail_rare", zero)).alias("score"),
    )
