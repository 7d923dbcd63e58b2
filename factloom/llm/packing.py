"""Packing token sequences into windows: bounded-space online best fit.

Each task keeps at most ``open_windows`` windows open.  A document's full
windows leave at once; its remainder goes to the open window that it fills
best.  When none fits, the fullest window is emitted: as it is when its gap is
at most ``slack``, else after a head cut from the piece has filled the gap.
What is still open at the end of a task is merged with the leftovers of other
tasks, ``fan_in`` tasks at a time, level by level, until one group is left.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, materialise, sliced, worker_cache

NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _schema(id_type: T.DataType) -> T.StructType:
    """Pieces as tasks hand them over: NAMES, then the task (or group) and whether the window is still open."""
    kinds = [id_type, T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    return T.StructType([field(n, k) for n, k in zip([*NAMES, "task", "open"], kinds)])


#: Words in a generation of a worker's cache, and bytes of the longest that is kept.
CACHED_WORDS, CACHED_BYTES = 500_000, 100


class Packer:
    """The windows of one task.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, slack: int, first_id: int):
        self.size, self.most, self.slack, self.next_id = size, open_windows, slack, first_id
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        self.windows: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.made = 0

    def close(self, pieces: list[tuple], open_: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next_id, at, open_))
            at += n
        self.next_id += 1

    def put(self, doc, start: int, ids: bytes, total: int) -> None:
        full = len(ids) - len(ids) % (4 * self.size)
        for at in range(0, full, 4 * self.size):
            self.close([(doc, start + at // 4, ids[at : at + 4 * self.size], total)])
        piece, start = ids[full:], start + full // 4
        while piece:
            n = len(piece) // 4
            k = bisect_left(self.gaps, (n, -1))
            if k < len(self.gaps):
                self.add(k, (doc, start, piece, total), n)
                return
            if len(self.gaps) < self.most:
                self.made += 1
                self.windows[self.made] = []
                insort(self.gaps, (self.size, self.made))
                continue
            gap = self.gaps[0][0]
            if gap <= self.slack:
                self.close(self.windows.pop(self.gaps.pop(0)[1]))
                continue
            self.add(0, (doc, start, piece[: 4 * gap], total), gap)
            piece, start = piece[4 * gap :], start + gap

    def add(self, k: int, piece: tuple, n: int) -> None:
        gap, window = self.gaps.pop(k)
        self.windows[window].append(piece)
        if gap == n:
            self.close(self.windows.pop(window))
        else:
            insort(self.gaps, (gap - n, window))

    def leave_open(self) -> None:
        for _, window in self.gaps:
            self.close(self.windows[window], True)
        self.gaps, self.windows = [], {}

    def flush(self) -> None:
        """Close everything: nearly full windows as they are, the others laid end to end."""
        rest: list[tuple] = []
        for gap, window in self.gaps:
            if gap <= self.slack:
                self.close(self.windows[window])
            else:
                rest += self.windows[window]
        self.gaps, self.windows = [], {}
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            take = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= take
            window = []
            while take:
                doc, start, ids, total = rest.pop(0)
                n = min(take, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total))
                take -= n
            self.close(window)

    def take(self, task: int, id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*self.done)) or [()] * 8
        self.done = []
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols[:7], kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(cols[0]), pa.int64()), pa.array(cols[7], pa.bool_())], names=[*NAMES, "task", "open"])


class _Words(dict):
    """Ids of words, filled by ``encode`` when a word is missing."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids


class WordEncoder:
    """Token ids of texts as little-endian 32-bit words.

    The vocabulary's pieces never cross ASCII white space and know no capitals,
    so that ids are kept by word, in two generations of bounded size: a word that
    was used since the last change is in the young one.  A word of printable
    ASCII and small Latin-1 letters is cut into pieces here and merged by the
    model; any other word, and one that may hold a special token, goes through
    the whole tokenizer.  A-Z become small before the lookup only where that
    cannot change what the tokenizer sees: its special tokens are told by case,
    and it composes a letter with a mark that follows before it makes it small.
    """

    #: The vocabulary's own pre-token pattern, for the characters of SIMPLE. Fixed value.
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    SIMPLE = re.compile("[!-~\u00df-\u00f6\u00f8-\u00ff]+")
    #: The byte-level alphabet's names of the bytes of those letters that do not stand for themselves. Fixed value.
    BYTES = {0x9F: 321, 0xA0: 322, 0xAD: 323}
    SPECIAL = b"<|"
    #: What makes the case of A-Z matter: a special token, or the first byte of a combining mark (U+0300 to U+036F).
    CASED = re.compile(b"<\\||[\xcc\xcd]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young, self.old = _Words(self.word), {}

    def word(self, word: bytes) -> bytes:
        if held := self.old.get(word):
            return held
        text = word.decode()
        if self.SIMPLE.fullmatch(text) and self.SPECIAL not in word:
            pieces = self.PIECE.findall(text.lower())
            if not text.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.BYTES) for p in pieces]
            ids = [t.id for piece in pieces for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        raw = text.encode() if text else b""
        out = b"".join(map(self.young.__getitem__, (raw if self.CASED.search(raw) else raw.lower()).split()))
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = _Words(self.word), dict(self.young)
        return out


def encoder(path: str) -> WordEncoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = WordEncoder(path)
    return cache["encoder", path]


def _pack_task(path: str, size: int, open_windows: int, slack: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, codes, end = Packer(size, open_windows, slack, task << 30), encoder(path), end_id.to_bytes(4, "little")
        id_type = pa.null()
        for batch in sliced(batches, 100):
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = codes.encode(text.as_py()) + end
                packer.put(doc, 0, code, len(code) // 4)
            if packer.done:
                yield packer.take(task, id_type)
        packer.leave_open()
        if packer.done:
            yield packer.take(task, id_type)

    return run


def _merge_group(size: int, open_windows: int, slack: int, level: int, last: bool):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = key[0].as_py(), [*batches]
        rows = [r for b in held for r in zip(*(b.column(c).to_pylist() for c in ("length", "doc_id", "start", "ids", "doc_tokens")))]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1], r[2]))
        packer = Packer(size, open_windows, slack, (level << 58) + (group << 30))
        for n, doc, start, ids, total in rows:
            packer.put(doc, start, ids, total)
        packer.flush() if last else packer.leave_open()
        yield packer.take(group, held[0].column("doc_id").type)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    open_windows: int = 128,
    slack: int = 16,
    fan_in: int = 16,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document's ids are its text's tokens, then ``end_id``.  Returns doc_id (as
    it is in ``docs``, of any type that sorts), start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  Only the last leftovers make sequences shorter than
    ``size - slack``; those have a power of two of tokens and need no padding.

    Null and empty texts give the one token ``end_id``.  Rows are packed one by
    one, so repeated rows and ids give repeated pieces and null ids stay null.
    An empty table gives no piece.  Other columns are not read.  The task's
    memory is bounded by its open windows and one batch, whatever the input.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _schema(rows.schema[0].dataType)
    made = materialise(rows.mapInArrow(_pack_task(tokenizer_path, size, open_windows, slack, end_id), schema))
    out, level = [made.where("not open")], 1
    tasks = (made.where("open").agg(F.max("task")).first()[0] or 0) + 1
    while True:
        groups = -(-tasks // fan_in)
        left = made.where("open").withColumn("group", F.expr(f"task div {fan_in}"))
        merged = left.groupBy("group").applyInArrow(_merge_group(size, open_windows, slack, level, groups == 1), schema)
        if groups == 1:
            out.append(merged)
            break
        made = materialise(merged)
        out.append(made.where("not open"))
        tasks, level = groups, level + 1
    all_pieces = out[0]
    for more in out[1:]:
        all_pieces = all_pieces.unionByName(more)
    return all_pieces.select(*NAMES)
