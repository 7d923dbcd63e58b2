"""SimHash near-duplicates by pigeonhole blocks.

Close fingerprints share a block; fingerprints meet in a join on the block and
their Hamming distance is verified.  Equal fingerprints are one node throughout,
so that copies cost nothing.  A block that many different fingerprints share is
split by further bits, and what is then still large is dealt out in pairs of
parts; in a task it is searched breadth first: a node that was reached is not
compared again.

Where a few bits may differ, a fingerprint's bits are cut into pieces, and a
block is a choice of pieces.  Where sets of shingles of a given similarity are
asked for, the shingles are dealt to classes by hash and a block is the SimHash
of one class: texts that differ in few shingles agree in the classes that hold
none of these.  Distances then only name candidates: texts that chains of
candidates join are compared by their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt_parts, field, hot_keys, hot_of, materialise, sliced, spread_join, words_of, wrapped
from .components import connected_components

#: Runs of a block up to this length are compared pair by pair.
SHORT_RUN = 24
#: A text's shingles are dealt to a power of two of classes, LEAST_CLASSES at
#: least, so that a class holds two to four; of more classes than the least,
#: CLASSES make blocks.  Two texts at a similarity of 0.8 agree in a class of
#: about four shingles with probability 0.4 (Poisson), which misses 0.6 ** 24 =
#: 0.0005 % of such pairs, whatever the number of texts.
LEAST_CLASSES, CLASSES = 32, 24
#: Distance of 128 bits up to which texts that share a class are candidates.  At
#: a similarity of 0.8 the distance is 19 on average with a spread of 4.
CANDIDATE_BITS, CANDIDATE_DISTANCE = 128, 48
#: Sets of one group of candidates meet in a task up to this number and this
#: number of shingles, others in pairs of such parts.
SET_BLOCK, SET_SHINGLES = 4096, 4_000_000
#: Values of a group of sets that are compared as bits.
FREQUENT = 1024
#: Rows of blocks in a task, about 10 MB.
BLOCK_ROWS = 250_000
#: Bytes of texts that are hashed at once where sets are asked for.
TEXT_BYTES = 1 << 20
_EDGES = T.StructType([field("a", T.BinaryType()), field("b", T.BinaryType())])
_KEYED = T.StructType([field("key", T.LongType()), field("fp", T.BinaryType())])


# fingerprints ---------------------------------------------------------------


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words (of all words, where there are fewer), repeats included."""
    from xxhash import xxh64_digest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[size - 1 :]) if len(words) > size else [(0, len(joined) + 1)]
    return np.frombuffer(b"".join([xxh64_digest(joined[a : b - 1], seed) for a, b in spans]), ">u8").astype(np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 further bits of each hash; the hash itself for k = 0."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def factors_of(n: int) -> np.ndarray:
    """An odd factor for each of the first ``n`` places."""
    return mixed(np.arange(n, dtype=np.uint64), 3) | np.uint64(1)


#: Numbers of the 256 bytes, and the factors of the first places of a word.
BYTES, FACTORS = mixed(np.arange(256, dtype=np.uint64), 4), factors_of(256)


def fingerprint(words: list[bytes], shingle: int, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half the hashes; big-endian.  No words: zero."""
    return fingerprint_of(shingle_hashes(words, shingle), bits)


def fingerprint_of(h: np.ndarray, bits: int) -> bytes:
    out = np.empty((bits // 64, 8), np.uint8)
    values = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    places = np.arange(8, dtype=np.int64) * 256
    for k in range(bits // 64):
        octets = mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(octets) < 200:
            ones = np.unpackbits(octets, axis=1).sum(0).reshape(8, 8)
        else:
            ones = np.bincount((octets + places).ravel(), minlength=2048).reshape(8, 256) @ values
        out[k] = np.packbits(2 * ones > len(h), axis=1)[:, 0]
    return out.tobytes()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``data`` (A-Z in lower case, with white space at the end), and where it starts.

    A hash is the mixed sum of its bytes' numbers, each times a factor of the byte's place.
    """
    at = np.frombuffer(data, np.uint8)
    inside = (at != 32) & (at - np.uint8(9) > 4)
    edges = np.flatnonzero(np.r_[inside[:1], inside[1:] != inside[:-1]])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 100_000):  # the arrays of a long text stay small
        own = slice(k, k + 100_000)
        piece = slice(starts[own][0], ends[own][-1])
        sizes = ends[own] - starts[own]
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        longest = int(sizes.max())
        factors = FACTORS if longest <= len(FACTORS) else factors_of(longest)
        out[own] = np.add.reduceat(BYTES[at[piece][inside[piece]]] * factors[place], first)
    return mixed(out, 5), starts


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of ``size`` words (of all words, where there are fewer), ascending in each text, and how many it has.

    All texts are hashed at once.  The hashes are not those of ``shingle_hashes``.
    """
    data = b"".join([(t or b"") + b" " for t in texts]).lower()
    words, starts = word_hashes(data)
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)])
    n, first = np.diff(bounds), bounds[:-1]
    weighted = np.concatenate([words, np.zeros(size, np.uint64)])
    runs = np.zeros(len(words), np.uint64)
    for j in range(size):
        runs += weighted[j : j + len(words)] * factors_of(size)[j]
    for t in np.flatnonzero((n > 0) & (n < size)):
        runs[first[t]] = (words[first[t] : first[t] + n[t]] * factors_of(size)[: n[t]]).sum()
    runs = mixed(runs, 6)[np.arange(len(words)) - np.repeat(first, n) < np.repeat(np.maximum(n - size + 1, 1), n)]
    ends = np.cumsum(np.where(n > 0, np.maximum(n - size + 1, 1), 0))
    bounds = np.r_[0, ends]
    for a, b in zip(bounds[:-1].tolist(), ends.tolist()):
        runs[a:b].sort()
    new = np.r_[np.ones(min(1, len(runs)), bool), runs[1:] != runs[:-1]]
    new[bounds[:-1][n > 0]] = True
    return runs[new], np.diff(np.r_[0, np.cumsum(new)][bounds])


def set_fingerprints(h: np.ndarray, sizes: np.ndarray, bits: int) -> list[bytes]:
    """``fingerprint_of`` each set; the sets lie in ``h`` one after the other.

    The ones of every eighth bit are summed at once, as bytes of a word, over 255 hashes at most.
    """
    out = np.zeros((len(sizes), bits // 64, 8), np.uint8)
    some = np.flatnonzero(sizes)
    runs = -(-sizes[some] // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat((np.cumsum(sizes) - sizes)[some], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    ones = np.empty((len(some), 8, 8), np.int64)  # by set, octet from the lowest, bit from the lowest
    for k in range(bits // 64 if len(some) else 0):
        x = mixed(h, k)
        for bit in range(8):
            sums = np.add.reduceat((x >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
            ones[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        out[some, k] = np.packbits(2 * ones[:, ::-1, ::-1] > sizes[some, None, None], axis=2)[:, :, 0]
    return [x.tobytes() for x in out]


def classes_for(n: float) -> int:
    return max(LEAST_CLASSES, 1 << max(0, int(n / 4 - 1e-9).bit_length()))


def set_blocks(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks of each set, and how many it has: the SimHash of the shingles (distinct hashes) in each class that has any.

    The sets lie in ``h`` one after the other.  Texts of a similarity of 0.8
    differ in size by a quarter at most, so that they share a number of classes:
    each takes its own and that of the larger.
    """
    own = np.array([(classes_for(n), classes_for(n * 1.25)) for n in sizes.tolist()], np.int64).reshape(-1, 2)
    owner, spread = np.repeat(np.arange(len(sizes)), sizes), mixed(h, 101)
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for classes in np.unique(own).tolist():
        used = np.flatnonzero((own == classes).any(1)[owner])
        used = used[spread[used] & np.uint64(classes - 1) < (classes if classes == LEAST_CLASSES else CLASSES)]
        if not len(used):
            continue
        name = (spread[used] & np.uint64(classes - 1)).astype(np.int64)
        place = owner[used] * LEAST_CLASSES + name
        order = np.argsort(place, kind="stable")
        used, name, place = used[order], name[order], place[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ones = np.add.reduceat(np.unpackbits(h[used].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int64)
        held = np.diff(np.r_[starts, len(used)])
        value = np.packbits(2 * ones > held[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)
        keys.append(mixed(value, 1 + 2 * classes) ^ mixed(name[starts].astype(np.uint64), 2 + 2 * classes))
        owners.append(owner[used[starts]])
    at = np.concatenate(owners)
    return np.concatenate(keys)[np.argsort(at, kind="stable")].view(np.int64), np.bincount(at, minlength=len(sizes))


def split(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The sets that lie in ``h`` one after the other, as bytes."""
    ends = np.cumsum(sizes)
    return [h[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def class_blocks(h: np.ndarray) -> np.ndarray:
    """``set_blocks`` of one set."""
    return set_blocks(h, np.array([len(h)]))[0]


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, row_key long, fp binary) of every row; row_key tells rows of one id apart by their text.

    With ``sets``, each shingle counts once, and the hash of the set, its size
    and the keys of its blocks are further columns set, n and keys.
    """
    from xxhash import xxh3_128_digest

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=TEXT_BYTES) if sets else sliced(batches):
            if sets:
                h, sizes = shingle_sets(batch.column(2).cast(pa.large_binary()).to_pylist(), shingle)
                keys, held = set_blocks(h, sizes)
                columns = [
                    pa.array(set_fingerprints(h, sizes, bits), pa.binary()),
                    pa.array([xxh3_128_digest(x) for x in split(h, sizes)], pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(keys)),
                ]
            else:
                columns = [pa.array([fingerprint(words_of(t.as_py()), shingle, bits) for t in batch.column(2)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row_key", *kinds])

    kinds = {"fp": T.BinaryType()} | ({"set": T.BinaryType(), "n": T.LongType(), "keys": T.ArrayType(T.LongType())} if sets else {})
    return rows.mapInArrow(run, T.StructType([rows.schema[0], field("row_key", T.LongType()), *(field(n, k) for n, k in kinds.items())]))


# blocks ---------------------------------------------------------------------


def pigeonhole_blocks(bits: int, max_distance: int, pieces: int) -> list[list[int]]:
    """Bit positions of every choice of ``pieces - max_distance`` of the pieces.

    Fingerprints that differ in at most ``max_distance`` bits differ in at most
    as many pieces, so that they agree in all the others: no close pair is lost.
    """
    if pieces <= max_distance:
        raise ValueError("more pieces than max_distance are needed")
    cut = [bits * k // pieces for k in range(pieces + 1)]
    return [[b for p in chosen for b in range(cut[p], cut[p + 1])] for chosen in combinations(range(pieces), pieces - max_distance)]


def _bits(column, bits: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), bits // 8), axis=1)


def words_from(column: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    fixed = column.cast(pa.binary(bits // 8))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[fixed.offset * bits // 64 :][: len(fixed) * bits // 64].reshape(-1, bits // 64)


def _number(ones: np.ndarray) -> np.ndarray:
    """Columns of bits (63 at most) as a number."""
    return ones.astype(np.int64) @ (np.int64(1) << np.arange(ones.shape[1], dtype=np.int64))


def _keyed(blocks: list[list[int]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ones = _bits(batch.column(0), bits)
            for k, block in enumerate(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(_number(ones[:, block]) | np.int64(k << 48)), batch.column(0)], names=["key", "fp"])

    return run


def _keyed_within(blocks: list[list[int]], bits: int, max_distance: int, pieces: int):
    """Keys inside a block: the pigeonhole blocks of the bits that it leaves, each under a hash of both keys.

    A collision of hashes adds candidates, whose distance is verified like any.
    """
    inner = [[sorted(set(range(bits)) - set(block))[b] for b in part] for block in blocks for part in pigeonhole_blocks(bits - len(block), max_distance, pieces)]
    each = len(inner) // len(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column(0).to_numpy()
            for k in np.unique(outer >> 48):
                rows = np.flatnonzero(outer >> 48 == k)
                fps = batch.column(1).take(pa.array(rows))
                ones, key = _bits(fps, bits), outer[rows].astype(np.uint64)
                for j in range(each):
                    own = _number(ones[:, inner[int(k) * each + j]]).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array((mixed(key, 2 * j + 1) ^ mixed(own, 2 * j + 2)).view(np.int64)), fps], names=["key", "fp"])

    return run


def close_pairs(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= most


def spanning_links(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links that join all fingerprints (rows of 64-bit words) which chains of close pairs join."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, 2_000_000 // (len(left) * fps.shape[1]))
            now, front = front[:step], front[step:]
            near = close_pairs(fps[now][:, None, :], fps[left][None, :, :], most)
            hit = near.any(0)
            a += now[near[:, hit].argmax(0)].tolist()
            b += left[hit].tolist()
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return a, b


def run_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that share a key; rows come sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes))
    k, f = keys[short], fps[short]
    for lag in range(1, SHORT_RUN):
        at = np.flatnonzero(k[:-lag] == k[lag:]) if lag < len(k) else np.empty(0, np.int64)
        if not len(at):
            break
        at = at[close_pairs(f[at], f[at + lag], most)]
        a.append(short[at])
        b.append(short[at + lag])
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        x, y = spanning_links(fps[s : s + n], most)
        a.append(s + np.array(x, np.int64))
        b.append(s + np.array(y, np.int64))
    none = [np.empty(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _linked(most: int, bits: int):
    names = ["a", "b"]

    def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        a, b = run_links(keys, fps, most)
        for at in range(0, len(a), 50_000):
            cols = [pa.array([fps[i].tobytes() for i in x[at : at + 50_000]], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            fps = words_from(batch.column(1), bits)
            held.append((keys, fps))
            if keys[-1] != held[0][0][0]:
                keys, fps = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from out(keys[:cut], fps[:cut])
                held = [(keys[cut:], fps[cut:])]
        if held:
            yield from out(*(np.concatenate(c) for c in zip(*held)))

    return run


def dealt(keyed: DataFrame, most: int) -> DataFrame:
    """``keyed`` (key, fp) by key, with keys of more than ``most`` rows split into pairs of parts, each pair under a key of its own.

    Every two fingerprints of a key meet in the pair of their parts.
    """
    total = keyed.count()
    hot = materialise(hot_of(keyed.groupBy("key").agg(F.count("*").alias("rows")), total, most))
    if hot.isEmpty():
        return keyed.select("key", "fp").repartition(dealt_parts(total, BLOCK_ROWS), "key")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = keyed.join(F.broadcast(hot), "key", "left")  # bounded by hot_of
    others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != part))
    paired = placed.withColumn("part", part).withColumn("other", F.explode(others))
    key = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return paired.select(key.alias("key"), "fp").repartition(dealt_parts(total, BLOCK_ROWS), "key")


def block_links(keyed: DataFrame, max_distance: int, bits: int, most: int = 4096) -> DataFrame:
    """Links (a, b) of the fingerprints that chains of close pairs join inside the blocks of ``keyed`` (key, fp)."""
    return dealt(keyed, most).sortWithinPartitions("key").mapInArrow(_linked(max_distance, bits), _EDGES)


def fingerprint_links(distinct: DataFrame, max_distance: int, pieces: int, bits: int = 64, most: int = 4096) -> DataFrame:
    """Links (a, b) of the fingerprints ``fp`` that chains of close pairs join: none is missed.

    Blocks of more than ``most`` fingerprints are split by pigeonhole blocks of their other bits.
    """
    blocks = pigeonhole_blocks(bits, max_distance, pieces)
    keyed = distinct.select("fp").mapInArrow(_keyed(blocks, bits), _KEYED)
    hot = materialise(hot_keys(keyed.groupBy("key").agg(F.count("*").alias("rows")), most).select("key"))
    if hot.isEmpty():
        return block_links(keyed, max_distance, bits, most)
    flat = keyed.join(F.broadcast(hot), "key", "left_anti")  # bounded by hot_keys
    deep = keyed.join(F.broadcast(hot), "key", "left_semi").select("key", "fp").mapInArrow(_keyed_within(blocks, bits, max_distance, pieces), _KEYED)
    return block_links(flat.select("key", "fp").unionByName(deep), max_distance, bits, most)


# sets -----------------------------------------------------------------------


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join all sets (distinct values) which chains of pairs at a Jaccard similarity of at least ``similarity`` join.

    With its values in one order, the rarest first, a set of n values shares one
    of its first n - ceil(similarity * n) + 1 with any set that is so similar, and
    it is one of the other's first as well (prefix filter).  Only sets that meet
    in such a value are compared, so that the work does not grow with the square
    of the group where texts share a passage only.  Where many meet, their
    FREQUENT most frequent values are compared as bits: these and all others that
    are shared are the most that two sets can have in common.
    """
    a, b = [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    if (sizes > 0).sum() < 2:
        return a, b
    values, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    single = int((counts == 1).sum())  # ranks below are in one set only
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = rank[values]
    ends = np.cumsum(sizes)
    for s, e in zip((ends - sizes).tolist(), ends.tolist()):
        flat[s:e].sort()
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    most = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    shared = flat >= single
    named = np.flatnonzero(shared & (place < most[owner]))
    flat, held = flat[shared] - single, np.bincount(owner[shared], minlength=len(sets))
    ends = np.cumsum(held)
    starts = ends - held
    first_values = flat[np.cumsum(shared)[named] - 1]
    first_ends = np.cumsum(np.bincount(owner[named], minlength=len(sets)))
    by_value = np.argsort(first_values, kind="stable")
    holders = owner[named][by_value]
    value_ends = np.cumsum(np.bincount(first_values, minlength=len(counts) - single))
    top = max(0, len(counts) - single - FREQUENT)
    bits = np.zeros((len(sets), FREQUENT), bool)
    frequent = np.flatnonzero(flat >= top)
    among = np.repeat(np.arange(len(sets)), held)[frequent]
    bits[among, flat[frequent] - top] = True
    rest = held - np.bincount(among, minlength=len(sets))
    bits = np.packbits(bits, axis=1).view(np.uint64)
    mark, open_ = np.zeros(len(counts) - single, bool), np.ones(len(sets), bool)
    for seed in np.unique(holders).tolist():
        front = [seed] if open_[seed] else []
        open_[seed] = False
        while front:
            x = front.pop()
            own = first_values[first_ends[x - 1] if x else 0 : first_ends[x]]
            lists = [holders[value_ends[v - 1] if v else 0 : value_ends[v]] for v in own.tolist()]
            if sum(map(len, lists)) < len(sets):
                met = np.concatenate([holders[:0], *lists])
                met = np.unique(met[open_[met]])
            else:
                met = np.flatnonzero(open_ & (held > 0))
            bound = np.bitwise_count(bits[met] & bits[x]).sum(1, dtype=np.int64) + np.minimum(rest[met], rest[x])
            met = met[bound >= similarity * (sizes[x] + sizes[met] - bound) - 1e-9]
            if not len(met):
                continue
            mark[flat[starts[x] : ends[x]]] = True
            runs = held[met]  # none is empty
            begin = np.cumsum(runs) - runs
            at = np.arange(runs.sum()) + np.repeat(starts[met] - begin, runs)
            common = np.add.reduceat(mark[flat[at]], begin, dtype=np.int64)
            mark[flat[starts[x] : ends[x]]] = False
            reached = met[common >= similarity * (sizes[x] + sizes[met] - common) - 1e-9].tolist()
            a += [x] * len(reached)
            b += reached
            front += reached
            open_[reached] = False
    return a, b


def _set_rows(shingle: int):
    names = ["component", "set", "block", "blocks", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, size=TEXT_BYTES):
            hashes = split(*shingle_sets(batch.column(4).cast(pa.large_binary()).to_pylist(), shingle))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(hashes, pa.binary())], names=names)

    return run


def _similar(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("set").to_pylist(), table.column("hashes").to_pylist()))  # a set once
        names = [*held]
        links = similar_links([np.frombuffer(h, np.uint64) for h in held.values()], similarity)
        return pa.table([pa.array([names[k] for k in x], pa.binary()) for x in links], names=["a", "b"])

    return run


def set_links(docs: DataFrame, nodes: DataFrame, parts: DataFrame, shingle: int, similarity: float, block: int = SET_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) of the sets of ``nodes`` (set, n, fp, rep) that exact similarity joins, inside the ``parts`` of their fingerprints.

    Only texts of parts with more than one set are shingled again, one for each set.
    """
    placed = nodes.select("set", "n", "fp", "rep").join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("shingles") / SET_SHINGLES)).cast("int")
    members = spread_join(placed, sizes.select("component", "sets", blocks.alias("blocks")), ["component"], "sets")
    members = materialise(members.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    same = F.col("id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.row_key"))
    chosen = texts.join(members.hint("shuffle_hash"), same).select("component", "set", "block", "blocks", "text")
    whole = [field("component", T.BinaryType()), field("set", T.BinaryType()), field("block", T.IntegerType()), field("blocks", T.IntegerType()), field("hashes", T.BinaryType())]
    sets = chosen.mapInArrow(_set_rows(shingle), T.StructType(whole))
    # a part of a group meets each other part once; inside, its own sets meet as well
    other = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or other <> block")
    dealt = other.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "hashes")
    return dealt.groupBy("component", "low", "high").applyInArrow(_similar(similarity), _EDGES)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    bits: int = CANDIDATE_BITS,
    max_distance: int = CANDIDATE_DISTANCE,
    pieces: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    most: int = 4096,
) -> DataFrame:
    """(doc_id, row_key, fp, component_id) of each row of ``docs``.

    component_id is the smallest doc_id among the rows that links reach.  With
    ``pieces``, fingerprints of at most ``max_distance`` differing bits are
    linked; whole pigeonhole pieces are used and no link is missed.  Without,
    texts are linked whose sets of shingles have a Jaccard similarity of at
    least ``similarity`` (0.8 or more): blocks by classes of shingles and
    ``max_distance`` name candidates (see CLASSES for what they miss), and the
    sets decide.  Each shingle then counts once in a fingerprint.  Blocks of more
    than ``most`` fingerprints are split.

    Null and empty texts have the fingerprint zero and are linked like others.
    A null doc_id never names a component (null where no other id is there).
    Repeated rows come out as often as they went in; an empty table gives none.
    Other columns are not read.
    """
    if not pieces and similarity < 0.8:
        raise ValueError("classes of shingles find similarities of 0.8 or more")
    rows = materialise(fingerprints(docs, shingle, bits, id_col, text_col, sets=not pieces))
    node = "fp" if pieces else "set"
    if pieces:
        nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        parts = connected_components(materialise(fingerprint_links(nodes, max_distance, pieces, bits, most)))
    else:
        firsts = [F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_key")).alias("rep")]
        nodes = materialise(rows.groupBy("set").agg(*firsts, *(F.first(c).alias(c) for c in ("fp", "n", "keys"))))  # one value for each set
        keyed = nodes.select(F.explode("keys").alias("key"), "fp")
        parts = connected_components(materialise(block_links(keyed, max_distance, bits, most)))
        parts = connected_components(materialise(set_links(docs, nodes, parts, shingle, similarity, id_col=id_col, text_col=text_col)))
    labelled = nodes.join(parts.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    labelled = materialise(labelled.select(node, "least", "component"))
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    of_node = materialise(spread_join(labelled.select(node, "component"), named, ["component"], "nodes").select(node, "component_id"))
    return rows.select("doc_id", "row_key", *dict.fromkeys(["fp", node])).join(of_node, node).select("doc_id", "row_key", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component of ``found``.

    The row with the smallest (doc_id, row_key) stays, a null doc_id last.  Rows
    that agree in both are alike to the operator: one of them stays.  Only the
    list of dropped rows meets the texts, in a hash join at every size.
    """
    rows = found.groupBy("component_id", "fp", "doc_id", "row_key").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    # components without any doc_id are told apart by their fingerprint
    part = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("own_fp")]
    best = rows.groupBy(*part).agg(F.min(rank).alias("best"))
    marked = rows.select("*", part[1]).join(
        best.withColumnsRenamed({"component_id": "best_id", "own_fp": "best_fp"}), F.col("component_id").eqNullSafe(F.col("best_id")) & F.col("own_fp").eqNullSafe(F.col("best_fp"))
    )
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    dropped = marked.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("drop_id"), F.col("row_key").alias("drop_key"), stays.alias("stays")).distinct()
    dropped = materialise(dropped)
    texts = wrapped(docs, id=id_col, text=text_col).select("row", "id", F.xxhash64("text").alias("row_key"))
    same = F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key"))
    kept = texts.join(dropped.hint("shuffle_hash"), same, "left_anti")
    out = [kept.select("row")]
    repeated = dropped.where("stays")
    if not repeated.isEmpty():  # one of the rows that agree in id and text
        out.append(texts.join(repeated.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["id", "row_key"]).select("row"))
    return reduce(DataFrame.unionByName, out).select(*(F.col("row")[c].alias(c) for c in docs.columns))
