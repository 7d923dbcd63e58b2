"""Repeated substrings by merging shard Burrows-Wheeler transforms.

A window is a string of ``length`` bytes; it is repeated if it starts at two
places of the corpus.  Every window belongs to the bucket of its minimizer, the
least hash among the grams that lie in it, so that equal windows meet.  The
windows of a document that follow each other in one bucket make a fragment.

1. Fragments are counted by bucket; a bucket with one fragment has no repeat.
2. Equal fragments are one, with a multiplicity: their windows are repeated.
3. The distinct fragments of the other buckets are dealt to groups of bounded
   size.  In a group, shards of fragments are suffix-sorted into transforms, and
   the transforms are merged by refining their interleave: rows that agree in d
   symbols are told apart by the order of the rows d symbols on, for d = 1, 2, 4
   and so on.  The successor of a row comes from the transform alone.  Each
   shard's rows are in order already, so a refinement merges sorted runs and no
   suffix is sorted again.  Where neighbours part gives their common prefix, and
   runs of rows with a common prefix of ``length`` that hold two starts are the
   repeated intervals.
4. A bucket with more distinct fragments than a group can hold (a passage in
   very many contexts) is split by a longer context.  All its windows hold the
   minimizer's gram, and equal windows hold it at the same place.  Windows with
   the gram in their right half share more text before it, others more after it:
   each half is a bucket by the text that its windows share, and is split again
   while it is too large.  Fragments that become equal are one.

"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialise, sliced, spread_join, worker_cache

GRAM = 32
#: Windows of a fragment, and bytes of text that are hashed at once.
MOST_WINDOWS = 1024
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15


# hashes and minimizers ------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    cache = worker_cache()
    held = cache.get("powers")
    if held is None or len(held[0]) < n:
        with np.errstate(over="ignore"):
            held = tuple(np.cumprod(np.r_[np.uint64(1), np.full(max(n, CHUNK + 1) - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
        cache["powers"] = held
    return held[0][:n], held[1][:n]


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place (where there are so many)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
        h = sums[size - 1 :].copy()
        h[1:] -= sums[: n - 1]
        h *= inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done, least = 1, h
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def fragments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, keys, own) of the fragments of texts that end at ``ends`` of ``data``.

    own: whether the minimizer stands at two places of the fragment, so that it
    may repeat itself.
    """
    width = length - GRAM + 1
    n = len(data) - length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(bool)
    h = rolling_hashes(data, GRAM)
    least = sliding_least(h, width)[:n]
    lengths = np.diff(np.r_[0, ends])
    valid = np.repeat(ends, lengths)[:n] - np.arange(n) >= length
    new = np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, n])
    keep = valid[starts]
    starts, sizes = starts[keep], sizes[keep]
    if (sizes > MOST_WINDOWS).any():
        pieces = -(-sizes // MOST_WINDOWS)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        long = np.repeat(sizes, pieces)
        starts = np.repeat(starts, pieces) + at * MOST_WINDOWS
        sizes = np.minimum(MOST_WINDOWS, long - at * MOST_WINDOWS)
        # a run of one minimizer that goes on in the next piece repeats its key there
    keys = least[starts]
    own = np.zeros(len(starts), bool)
    steps = np.arange(width)
    for k in range(0, len(starts), 4096):
        s = slice(k, k + 4096)
        a, b = starts[s], starts[s] + sizes[s] - 1
        first = a + (h[a[:, None] + steps] == keys[s, None]).argmax(1)
        last = b + width - 1 - (h[b[:, None] + width - 1 - steps] == keys[s, None]).argmax(1)
        own[s] = last > first
    return starts, sizes, keys, own


_FRAGMENTS = T.StructType([field("key", T.LongType()), field("f", T.LongType()), field("start", T.IntegerType()), field("windows", T.IntegerType()), field("own", T.BooleanType())])


def _find_fragments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in sliced(batches):
            raw = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(raw):
                to, total = at, 0
                while to < len(raw) and (to == at or total + len(raw[to]) <= CHUNK):
                    total += len(raw[to])
                    to += 1
                joined = b"".join(raw[at:to])
                ends = np.cumsum([len(r) for r in raw[at:to]])
                starts, sizes, keys, own = fragments(np.frombuffer(joined, np.uint8), ends, length)
                doc = np.searchsorted(ends, starts, side="right")
                begin = np.r_[0, ends][doc]
                f = np.array([xxh3_64_intdigest(joined[a : a + n + length - 1]) for a, n in zip(starts.tolist(), sizes.tolist())], np.uint64)
                rows = pa.array(doc + at)
                cols = [keys.view(np.int64), f.view(np.int64), (starts - begin).astype(np.int32), sizes.astype(np.int32), own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, cols)], names=["id", "row_key", *_FRAGMENTS.names])
                at = to

    return run


# transforms -----------------------------------------------------------------


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform) of texts that each end in a 0; the zeros are distinct, in order."""
    n = len(symbols)
    ends = symbols == 0
    m = int(ends.sum())
    rank = symbols.astype(np.int64) + m
    rank[ends] = np.arange(m)
    order, d = None, 1
    todo = np.arange(n)  # suffixes that are not yet alone in their rank
    _, rank = np.unique(rank, return_inverse=True)
    # ranks are places in the order: those of a class are the place of its first
    first = np.cumsum(np.bincount(rank)) - np.bincount(rank)
    rank = first[rank]
    while len(todo):
        key = rank[todo] * n + rank[np.minimum(todo + d, n - 1)]
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        head = np.r_[True, key[1:] // n != key[:-1] // n]  # where a class begins
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(todo))
        base = rank[todo] - np.maximum.accumulate(np.where(head, place, 0))
        rank[todo] = base + np.maximum.accumulate(np.where(new, place, 0))
        alone = new & np.r_[new[1:], True]
        todo = todo[~alone]
        d *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, symbols[order - 1]


def successors(bwt: np.ndarray) -> np.ndarray:
    """The row of the suffix one symbol shorter, from the transform alone; a row of a text's end is its own."""
    by = np.argsort(bwt, kind="stable")
    m = int(np.count_nonzero(bwt == 0))
    by[:m] = np.arange(m)
    return by


def merged(bwts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the merged rows of transforms: the rows in the order of their first ``length`` symbols, and
    the common prefix of each row with the one before, as the last depth at which both were still alike (``length`` at most)."""
    offsets = np.cumsum([0, *(len(b) for b in bwts)])
    n = int(offsets[-1])
    kind = np.int32 if n < 1 << 31 else np.int64
    step = np.concatenate([successors(b) + o for b, o in zip(bwts, offsets)]).astype(kind)
    top = 1 << (length.bit_length() - 1)
    common, hop, rest, depth = np.full(n, length, np.int32), None, length - top, 0
    common[:1] = 0

    def interleave(key: np.ndarray, deeper: int) -> np.ndarray:
        """The number of each row's run of equal keys; runs that part here were alike to ``depth``."""
        nonlocal order, depth
        order = np.argsort(key, kind="stable")  # sorted runs, one for each transform: a merge
        parted = np.r_[False, key[order][1:] != key[order][:-1]]
        common[parted & (common == length)] = depth
        block = np.empty(n, kind)
        block[order] = np.cumsum(parted)
        depth = deeper
        return block

    order = np.arange(n)
    head = np.concatenate([np.sort(b).astype(np.int64) for b in bwts]) + n
    ends = np.flatnonzero(head == n)
    head[ends] = ends
    block, d = interleave(head, 1), 1
    while d < top:
        if rest & d:
            hop = step if hop is None else step[hop]
        block = interleave(block * np.int64(n) + block[step], 2 * d)
        step = step[step]
        d *= 2
    if rest:
        interleave(block * np.int64(n) + block[hop], length)
    return order, common


def repeated_starts(texts: list[bytes], times: np.ndarray, length: int, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each text, the places where a window starts that starts anywhere else; a text stands for ``times`` of it."""
    shards: list[list[int]] = [[]]
    size = 0
    for k, t in enumerate(texts):
        if size + len(t) > shard_bytes and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(t) + 1
    bwts, of_text, of_place = [], [], []
    for shard in shards:
        lengths = np.array([len(texts[k]) for k in shard])
        symbols = np.zeros(lengths.sum() + len(shard), np.uint16)
        owner = np.repeat(shard, lengths + 1)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
        symbols[place < lengths.repeat(lengths + 1)] = np.frombuffer(b"".join(texts[k] for k in shard), np.uint8).astype(np.uint16) + 1
        order, bwt = transform(symbols)
        bwts.append(bwt)
        of_text.append(owner[order])
        of_place.append(place[order])
    owner, place = np.concatenate(of_text), np.concatenate(of_place)
    order, common = merged(bwts, length)
    owner, place = owner[order], place[order]
    run = np.cumsum(common < length) - 1  # of rows with a common prefix of length symbols
    whole = place + length <= np.array([len(t) for t in texts])[owner]
    count = np.bincount(run[whole], times[owner[whole]], len(run))
    hit = whole & (count[run] >= 2)
    owner, place = owner[hit], place[hit]
    by = np.lexsort((place, owner))
    return np.split(place[by], np.searchsorted(owner[by], np.arange(1, len(texts))))


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of the windows that start at ``starts`` (ascending), as maximal runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(a), int(b) + length) for a, b in zip(starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]])]


_SPAN = T.ArrayType(T.StructType([field("a", T.IntegerType()), field("b", T.IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _merge_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        texts, times = table.column("text").to_pylist(), table.column("times").to_numpy()
        found = repeated_starts(texts, times, length)
        spans = [[{"a": a, "b": b} for a, b in spans_of(s, length)] for s in found]
        return pa.table([table.column("key"), table.column("f"), pa.array(spans, _SPAN_ARROW)], names=["key", "f", "spans"])

    return run


def _cut_texts():
    """The fragments of a document that are wanted, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                out += [(w["key"], w["f"], w["times"], raw[w["start"] : w["start"] + w["size"]], None, None, None) for w in wanted]
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _PIECE_ARROW)], names=_PIECES.names)

    return run


#: A fragment's text; of a split one, the gram's place and the least and most bytes of a window before it.
_PIECES = T.StructType([field("key", T.LongType()), field("f", T.LongType()), field("times", T.LongType()), field("text", T.BinaryType()), field("at", T.IntegerType()), field("low", T.IntegerType()), field("high", T.IntegerType())])
_PIECE_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
_HALVES = T.StructType([field("of_key", T.LongType()), field("of_f", T.LongType()), field("place", T.IntegerType()), *_PIECES.fields])


def halves(key: int, text: bytes, at: int | None, low: int | None, high: int | None, length: int) -> list[tuple]:
    """(place, key, f, text, at, low, high) of the parts that a fragment is split into; together they have its windows.

    A part's windows begin ``low`` to ``high`` bytes before the gram at ``at``, so
    that all hold the text that the new key stands for.  A fragment that was not
    split yet is first taken apart by the gram that is the first in a window.
    """
    from xxhash import xxh3_64_intdigest

    windows, out = len(text) - length + 1, []
    if at is None:
        grams = np.flatnonzero(rolling_hashes(np.frombuffer(text, np.uint8), GRAM).view(np.int64) == key).tolist()
        low, high = 0, length - GRAM
    else:
        grams = [at]
    middle, begin = (low + high) // 2, 0
    for gram in grams:
        end = min(gram, windows - 1)  # the last window whose first gram this is
        for a, b in ((middle + 1, high), (low, middle)):
            first, last = max(begin, gram - b), min(end, gram - a)
            if first <= last:
                part = text[first : last + length]
                name = xxh3_64_intdigest(text[gram - a : gram - b + length], a << 16 | b)
                out.append((first, name, xxh3_64_intdigest(part, gram - first), part, gram - first, a, b))
        begin = gram + 1
    return out


def _split(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for key, f, times, text, at, low, high in zip(*(batch.column(c).to_pylist() for c in _PIECES.names)):
                out += [(key, f, place, _signed(k), _signed(g), times, part, *rest) for place, k, g, part, *rest in halves(key, text, at, low, high, length)]
            cols = list(zip(*out)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), *_PIECE_ARROW])], names=_HALVES.names)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_MARKS = T.StructType([field("key", T.LongType()), field("f", T.LongType()), field("spans", _SPAN)])


def bucket_marks(pieces: DataFrame, length: int, group_bytes: int, most_in_bucket: int) -> DataFrame:
    """(key, f, spans): where windows of each of ``pieces`` (distinct fragments of buckets) stand that are repeated in their bucket.

    Buckets of more than ``most_in_bucket`` fragments are split until none is as large.
    """
    sizes = pieces.groupBy("key").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > most_in_bucket).select("key"))
    some_large = not large.isEmpty()
    fit = pieces.join(large.hint("merge"), "key", "left_anti") if some_large else pieces
    total = fit.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    out = fit.select("key", "f", "times", "text").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInArrow(_merge_group(length), _MARKS)
    if not some_large:
        return out
    parts = materialise(pieces.join(large.hint("merge"), "key", "left_semi").select(*_PIECES.names).mapInArrow(_split(length), _HALVES))
    same = [F.first(c).alias(c) for c in ("text", "at", "low", "high")]  # one value for each key and f
    distinct = materialise(parts.groupBy("key", "f").agg(F.sum("times").alias("times"), *same))
    wanted = distinct.groupBy("key").agg(F.count("*").alias("texts"), F.min("times").alias("least")).where("texts > 1 and least = 1").select("key")
    open_ = materialise(distinct.join(wanted.hint("merge"), "key", "left_semi").select(*_PIECES.names))
    found = bucket_marks(open_, length, group_bytes, most_in_bucket).join(distinct.where("times = 1").select("key", "f").hint("merge"), ["key", "f"])
    whole = distinct.where("times > 1").select("key", "f", F.array(F.struct(F.lit(0).alias("a"), F.length("text").alias("b"))).cast(_SPAN).alias("spans"))
    marks = materialise(whole.unionByName(found.select(*_MARKS.names)).where(F.size("spans") > 0))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("place")).alias("a"), (s["b"] + F.col("place")).alias("b")))
    placed = parts.select("key", "f", "of_key", "of_f", "place").join(marks.hint("merge"), ["key", "f"])
    back = placed.groupBy(F.col("of_key").alias("key"), F.col("of_f").alias("f")).agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return out.unionByName(back.select("key", "f", F.col("spans").cast(_SPAN).alias("spans")))


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, kept, sizes = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode() if text else b""
                own: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(b, own[-1][1])
                    else:
                        own.append([a, b])
                cuts = [0, *(x for s in own for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                spans.append([{"a": a, "b": b} for a, b in own])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPAN_ARROW), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_bytes: int = 2 << 20, most_in_bucket: int = 8000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``docs``.

    spans are the maximal runs of bytes that windows of ``length`` bytes cover
    which start anywhere else in the table, the same text included; kept are the
    other bytes, in order.  Texts are compared as UTF-8; null and empty texts
    have no bytes.  Rows that repeat (in id and text) are copies of each other
    like any, and come out once each; null ids are ids of their own.  An empty
    table gives no row.  Other columns are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    id_field = rows.schema[0]
    schema = T.StructType([id_field, field("row_key", T.LongType()), *_FRAGMENTS.fields])
    found = materialise(rows.mapInArrow(_find_fragments(length), schema))
    shared = materialise(found.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 or own").select("key"))
    some = materialise(found.join(shared.hint("merge"), "key"))
    rep = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row_key", "start", "windows"))
    distinct = materialise(some.groupBy("key", "f").agg(F.count("*").alias("times"), F.max("own").alias("own"), rep.alias("rep")))
    keys = distinct.groupBy("key").agg(F.count("*").alias("texts"), F.max("own").alias("any_own"), F.min("times").alias("least")).where("least = 1 and (texts > 1 or any_own)")
    open_ = spread_join(distinct, keys.select("key", "texts"), ["key"], "texts")
    wanted = F.struct("key", "f", "times", F.col("rep.start").alias("start"), (F.col("rep.windows") + (length - 1)).alias("size"))
    by_doc = open_.groupBy(F.col("rep.id").alias("_id"), F.col("rep.row_key").alias("_key")).agg(F.collect_list(wanted).alias("wanted"))
    same = rows.id.eqNullSafe(F.col("_id")) & (rows.row_key == F.col("_key"))
    # rows that repeat would cut their fragments again
    texts = rows.join(by_doc.hint("shuffle_hash"), same).select("text", "wanted")
    pieces = materialise(texts.mapInArrow(_cut_texts(), _PIECES).dropDuplicates(["key", "f"]))
    merged_marks = bucket_marks(pieces, length, group_bytes, most_in_bucket)
    whole = distinct.where("times > 1").select("key", "f", F.array(F.struct(F.lit(0).alias("a"), (F.col("rep.windows") + (length - 1)).alias("b"))).cast(_SPAN).alias("spans"))
    partly = merged_marks.join(distinct.where("times = 1").select("key", "f").hint("merge"), ["key", "f"])
    marks = materialise(whole.unionByName(partly).where(F.size("spans") > 0))
    placed = some.select("key", "f", "id", "row_key", "start").join(marks.hint("merge"), ["key", "f"])
    ranges = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    per_doc = placed.select("id", "row_key", ranges.alias("r")).groupBy(F.col("id").alias("_id"), F.col("row_key").alias("_key")).agg(F.flatten(F.collect_set("r")).alias("ranges"))
    out = rows.join(materialise(per_doc).hint("shuffle_hash"), same, "left").select(F.col("id"), "text", "ranges")
    return out.mapInArrow(_remove(length), T.StructType([field("doc_id", id_field.dataType), field("n_bytes", T.LongType()), field("spans", _SPAN), field("kept", T.BinaryType())]))
