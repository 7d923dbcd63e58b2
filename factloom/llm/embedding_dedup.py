"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order.  Each
pivot has an inverted list of the vectors that name it.  Vectors that meet in a
list and share enough pivots are candidates, and the cosine of each candidate
pair is verified in double precision.

Equal vectors are one node of the index with a multiplicity, so that copies
cost nothing.  Pivots that are near to each other form a group, and a vector is
sent once to each group that it names a pivot of, with the numbers of all its
pivots; the lists are made where the group is.  A group with many vectors is
dealt out in pairs of blocks of bounded size; its size is estimated from the
pivots, which are a sample of the vectors.  A pair is verified in one place
only, so that a task hands over a count for each of its vectors and the links of
a spanning forest, and never the pairs themselves.

In a list, a product of matrices in single precision goes before the count of
shared pivots, because it costs less a pair; both must hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialise, sliced
from .components import connected_components

#: Bytes of the pivots, which the driver gathers and broadcasts, as unit rows in double precision.
PIVOT_BYTES = 64 << 20
#: Bytes of a block of vectors in double precision; a task holds two blocks and as much again.
BLOCK_BYTES = 64 << 20
#: What single precision may be off by, generously.
SLACK = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(kind: str):
    """Rows whose vector is whole, finite and not zero, as little-endian floats or doubles (``kind``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4000):
            ids, vectors = batch.column(0), batch.column(1).to_pylist()
            keep, raw = [], []
            for k, v in enumerate(vectors):
                if v and ids[k].is_valid and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        keep.append(k)
                        raw.append((x + x.dtype.type(0)).tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Free of overflow in norms, whatever the magnitudes."""
    return x / np.abs(x).max(1, keepdims=True)


def _matrix(column, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """The numbers of the ``named`` pivots nearest to each row, the nearest first; ties by number."""
    out = np.empty((len(x), named), np.int32)
    for at in range(0, len(x), step := max(1, 4_000_000 // len(pivots))):
        near = x[at : at + step] @ pivots.T
        few = np.sort(np.argpartition(-near, named - 1, axis=1)[:, :named], axis=1) if named < len(pivots) else np.arange(len(pivots))[None].repeat(len(near), 0)
        values = np.take_along_axis(near, few, 1)
        last = values.min(1, keepdims=True)
        tied = np.flatnonzero((near >= last).sum(1) > named)  # a tie at the edge goes to the smaller number
        out[at : at + step] = np.take_along_axis(few, np.argsort(-values, axis=1, kind="stable"), 1)
        for k in tied:
            out[at + k] = np.argsort(-near[k], kind="stable")[:named]
    return out


_CELL = T.StructType([field("cell", T.LongType()), field("side", T.IntegerType()), field("vec_id", T.LongType()), field("copies", T.LongType()), field("v", T.BinaryType()), field("named", T.BinaryType())])
_FOUND = T.StructType([field("a", T.LongType()), field("b", T.LongType()), field("n", T.LongType())])


def _dealt(shared, named: int, kind: str):
    """A row for each cell that a vector belongs to: a pair of blocks of a group that it names a pivot of.

    A cell's number is the group, the lower and the higher block; the side tells which of both is the vector's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, group_of, blocks = shared.value
        for batch in sliced(batches, 4000):
            ids = batch.column(0).to_numpy()
            names = nearest_pivots(_unit(_scaled(_matrix(batch.column(1), kind))), pivots, named)
            groups = np.sort(group_of[names], axis=1)
            first = np.c_[np.ones(len(ids), bool), groups[:, 1:] != groups[:, :-1]]
            row, col = np.nonzero(first)
            group = groups[row, col].astype(np.int64)
            own = ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks[group]
            at = np.repeat(np.arange(len(row)), blocks[group])
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks[group]) - blocks[group], blocks[group])
            row, group, own = row[at], group[at], own[at]
            low, high = np.minimum(own, other), np.maximum(own, other)
            held = pa.array([x.tobytes() for x in np.sort(names, axis=1)], pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group << 42 | low << 21 | high), pa.array((own != low).astype(np.int32)), batch.column(0).take(take), batch.column(2).take(take), batch.column(1).take(take), held.take(take)], names=_CELL.names
            )

    return run


class Forest:
    """Which of n nodes are joined, for links that come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The places of links that join what was apart: a spanning forest of what is new."""
        x, y = self.label[a], self.label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return []
        codes = np.minimum(x[apart], y[apart]) * len(self.label) + np.maximum(x[apart], y[apart])
        places = apart[np.unique(codes, return_index=True)[1]]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = v = root.get(up, up)
            return v

        used = []
        for k, u, v in zip(places.tolist(), x[places].tolist(), y[places].tolist()):
            if (ru := find(u)) != (rv := find(v)):
                root[max(ru, rv)] = min(ru, rv)
                used.append(k)
        new = np.arange(len(self.label))
        for v in root:
            new[v] = find(v)
        self.label = new[self.label]
        return used


def _verified(shared, threshold: float, least: int, kind: str):
    """Counts (a, null, n) and spanning links (a, b, null) of one cell."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, group_of, _ = shared.value
        cell = key[0].as_py()
        group, same = cell >> 42, cell >> 21 & 0x1FFFFF == cell & 0x1FFFFF
        ids, side, copies = (table.column(c).to_numpy() for c in ("vec_id", "side", "copies"))
        whole = _unit(_scaled(_matrix(table.column("v"), kind)))
        brief = whole.astype(np.float32)
        raw = table.column("named").to_pylist()
        names = np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), -1)
        row, col = np.nonzero(group_of[names] == group)
        pivot = names[row, col]
        by = np.lexsort((row, side[row], pivot))
        row, pivot = row[by], pivot[by]
        counts, forest, joined = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else []
        for a, z in zip(starts, [*starts[1:], len(row)]):
            members = row[a:z]
            cut = int(np.searchsorted(side[members], 1))
            left, right = (members, members) if same else (members[:cut], members[cut:])
            if not len(left) or not len(right):
                continue
            step = max(1, 4_000_000 // len(right))
            for at in range(0, len(left), step):
                near = brief[left[at : at + step]] @ brief[right].T >= threshold - SLACK
                i, j = np.nonzero(np.triu(near, at + 1) if same else near)
                for c in range(0, len(i), 100_000):
                    x, y = left[at + i[c : c + 100_000]], right[j[c : c + 100_000]]
                    both = (names[x][:, :, None] == names[y][:, None, :]).any(2)
                    # a pair is verified in the list of the first pivot that it shares
                    ok = (both.sum(1) >= least) & (names[x, both.argmax(1)] == pivot[a])
                    x, y = x[ok], y[ok]
                    ok = np.einsum("ij,ij->i", whole[x], whole[y]) >= threshold
                    x, y = x[ok], y[ok]
                    counts += np.bincount(x, copies[y], len(ids)).astype(np.int64) + np.bincount(y, copies[x], len(ids)).astype(np.int64)
                    joined += [(int(ids[x[k]]), int(ids[y[k]])) for k in forest.join(x, y)]
        hit = np.flatnonzero(counts)
        one, two = [*ids[hit].tolist(), *(p for p, _ in joined)], [None] * len(hit) + [q for _, q in joined]
        return pa.table([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([*counts[hit].tolist(), *[None] * len(joined)], pa.int64())], names=["a", "b", "n"])

    return run


def choose_pivots(distinct: DataFrame, n: int, kind: str) -> np.ndarray:
    """``n`` vectors with the smallest hash as unit rows: the bounded sample that the index is fitted on, before ``spread``."""
    rows = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(n).collect()
    return _unit(_scaled(np.array([np.frombuffer(r[0], kind) for r in rows], np.float64)))


def spread(sample: np.ndarray, least: float, step: int = 1024) -> np.ndarray:
    """The unit rows of ``sample`` whose cosine with every earlier one that is kept is below ``least``.

    A dense region would else have many pivots, of which near vectors name different ones.
    """
    kept = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), step):
        part = sample[at : at + step]
        for k in range(0, len(kept), step):
            part = part[(part @ kept[k : k + step].T).max(1) < least] if len(part) else part
        near, chosen = part @ part.T >= least, []
        for k in range(len(part)):
            if not near[k, chosen].any():
                chosen.append(k)
        kept = np.concatenate([kept, part[chosen]])
    return kept


def index_size(n: int, dims: int) -> tuple[int, int]:
    """(pivots, names) for ``n`` vectors.

    Work for a vector is the pivots that it is compared with and the lists that
    it stands in, names ** 2 * n / pivots; both grow with the root of n.  The more
    pivots, the more of them a vector names, so that of pairs at a cosine of 0.9
    in 64 dimensions, in random directions, 98 % or more share two.
    """
    names = 8 if n <= 1 << 18 else 12 if n <= 1 << 24 else 16
    return max(1, min(n, max(64, math.ceil(names / 2 * math.sqrt(n))), max(64, PIVOT_BYTES // (8 * dims)))), names


def links(distinct: DataFrame, threshold: float = 0.9, kind: str = "<f8", named: int | None = None, shared: int = 2, pivots: int | None = None, block: int | None = None) -> DataFrame:
    """What tasks found among ``distinct`` (vec_id, v, copies): rows (a, null, n) with parts of the number of
    vectors, copies included, that a is linked to, and rows (a, b, null) with links that span what is linked."""
    spark = distinct.sparkSession
    n, width = distinct.agg(F.count("*"), F.max(F.length("v"))).first()
    if n < 2:
        return spark.createDataFrame([], _FOUND)
    dims = width // np.dtype(kind).itemsize
    n_pivots, names = index_size(n, dims)
    block = block or max(1024, BLOCK_BYTES // (8 * dims))
    n_pivots, names = min(n, pivots or n_pivots), named or names
    sample = choose_pivots(distinct, n_pivots, kind)
    points = spread(sample, 0.8)
    n_pivots = len(points)
    names, shared = min(names, n_pivots), min(shared, n_pivots)
    # a group is what is nearest to one of the first pivots; the fewer there are, the fewer copies of a vector
    heads = max(1, min(n_pivots // 8, -(-2 * n // block) if n > block else 1))
    group_of = nearest_pivots(points, points[:heads], 1)[:, 0]
    own = group_of[nearest_pivots(sample, points, names)]
    share = np.array([(own == g).any(1).mean() for g in range(heads)])
    blocks = np.maximum(1, np.ceil(share * n / block)).astype(np.int64)
    held = spark.sparkContext.broadcast((points, group_of, blocks))  # PIVOT_BYTES at most, and 16 bytes a pivot
    cells = distinct.select("vec_id", "v", "copies").mapInArrow(_dealt(held, names, kind), _CELL)
    return cells.groupBy("cell").applyInArrow(_verified(held, threshold, shared, kind), _FOUND)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``.

    n_links counts the other vectors at a cosine of at least ``threshold`` that
    the index found; component_id is the smallest vec_id that links reach; kept
    tells whether that is the vector itself.  Vectors that are null, empty or
    zero or hold null or non-finite components link with nothing, and so do
    rows without a vec_id (component null, not kept).  Vectors of different
    lengths link only with their like.  Rows that repeat a vec_id are one vector
    each, but never links of themselves; an empty table gives no row.  Ids are
    whole numbers (cast to long).
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), True) or vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), False)
    kind = "<f4" if single else "<f8"  # as the vectors are, so that nothing is lost
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    schema = T.StructType([field("vec_id", T.LongType()), field("v", T.BinaryType())])
    valid = materialise(rows.mapInArrow(_valid(kind), schema))
    same = materialise(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")))
    of_rep = same.select(F.col("rep").alias("vec_id"), "v", "copies")
    found = spark.createDataFrame([], _FOUND)
    for size in sorted(r[0] for r in same.select(F.length("v")).distinct().collect()):  # lengths of vectors, one as a rule
        found = found.unionByName(links(of_rep.where(F.length("v") == size), threshold, kind, **how))
    found = materialise(found)
    parts = connected_components(found.where("b is not null")).withColumnRenamed("node", "rep")
    beyond = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("beyond"))
    by_rep = same.join(beyond, "rep", "left").join(parts, "rep", "left")
    by_rep = materialise(by_rep.select("v", (F.coalesce("beyond", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    named = valid.join(by_rep, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(named, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
