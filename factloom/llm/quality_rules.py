"""Quality rules as a short-circuit cascade.

Each rule is a measure of a text and a limit.  On a bounded sample the cascade
estimates every rule's cost and the share of texts that it rejects, and orders
the rules by rejections per second.  A text leaves the cascade at the first rule
that rejects it; the order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, sliced

SYMBOLS = b"#*$%&|<>"
#: Measures that can be reported for each text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_NOT_SPACE = bytes(c for c in range(256) if not (c == 32 or 9 <= c <= 13))


class Text:
    """A text and the measures taken from it so far."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw.translate(None, _NOT_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if len(number) == n:
            return 0
        if len(number) < 2_000_000:
            codes = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            codes = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(codes, kind="stable")
        same = codes[order][1:] == codes[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice[2:] |= twice[1:-1] | twice[:-2]
        twice[1] |= twice[0]
        # a window that starts at i covers i, i + 1 and i + 2
        return int(twice.sum())

    @cached_property
    def upper_share(self) -> float:
        letters = len(self.raw.translate(None, _NOT_LETTER))
        return len(self.raw.translate(None, _NOT_UPPER)) / letters if letters else 0.0

    @cached_property
    def cry_share(self) -> float:
        return self.raw.count(b"!!") / max(1, self.n_words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells whether a text fails; it reads only what it needs."""

    name: str
    rejects: Callable[[Text], bool]


def base_rules(min_words: int = 50, repeat_percent: int = 50) -> list[Rule]:
    return [
        Rule("few_words", lambda t: t.n_words < min_words),
        Rule("repeated_words", lambda t: 100 * t.n_repeat_words > repeat_percent * t.n_words),
    ]


def default_rules() -> list[Rule]:
    """The base rules, and limits on symbols, repeated lines, capitals, cries and word length."""
    return [
        *base_rules(),
        Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
        Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > max(1, len(t.lines))),
        Rule("capitals", lambda t: t.upper_share > 0.6),
        Rule("cries", lambda t: t.cry_share > 0.3),
        Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    ]


def plan_cascade(texts: list[str | None], rules: list[Rule], clock: Callable[[], float] = time.perf_counter) -> list[dict]:
    """For each rule its cost (seconds a text) and rejected share, in the order to run.

    Costs are taken on a fresh text, so that a measure which rules share counts
    for each.  Ties keep the given order; without texts so does the whole list.
    """
    found = []
    for k, rule in enumerate(rules):
        began, rejected = clock(), 0
        for t in texts:
            rejected += rule.rejects(Text(t))
        cost = (clock() - began) / max(1, len(texts))
        found.append({"rule": rule, "cost": cost, "rejected": rejected / max(1, len(texts)), "given": k})
    return sorted(found, key=lambda x: (-x["rejected"] / max(x["cost"], 1e-9), x["given"]))


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 200, max_chars: int = 100_000) -> list[str | None]:
    """About ``rows`` texts of at most ``max_chars``, for the estimates; verdicts never depend on them.

    A hash of the id deals the sample over all files: about twice as many rows
    as are wanted lie below its limit, and those with the smallest are taken.  At
    most four times as many reach the driver, whatever ids repeat.
    """
    n = docs.count()
    limit = (1 << 30) if n <= 2 * rows else -(-2 * rows * (1 << 30) // n)
    dealt = docs.select(F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h")).where(F.col("h") < limit)
    some = dealt.where(f"coalesce(char_length(text), 0) <= {max_chars}").limit(4 * rows).collect()
    return [r.text for r in sorted(some, key=lambda r: (r.h, r.text or ""))[:rows]]


def _schema(id_type: T.DataType, report: tuple[str, ...]) -> T.StructType:
    return T.StructType([field("doc_id", id_type), *(field(m, T.LongType()) for m in report), field("base_failed", T.BooleanType()), field("kept", T.BooleanType()), field("rejected_by", T.StringType())])


def _cascade(rules: list[Rule], base: tuple[str, ...], report: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column(1):
                t = Text(text.as_py())
                hit = next((r.name for r in rules if r.rejects(t)), None)
                failed = hit in base or hit is not None and any(r.rejects(t) for r in rules if r.name in base)
                out.append((*(getattr(t, m) for m in report), failed, hit is None, hit))
            cols = list(zip(*out)) or [()] * (len(report) + 3)
            kinds = [pa.int64()] * len(report) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *report, "base_failed", "kept", "rejected_by"])

    return run


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", report: tuple[str, ...] = BASE, sample_rows: int = 200) -> DataFrame:
    """doc_id, the measures of ``report``, base_failed, kept, rejected_by of each text.

    ``report`` measures are taken of every text, rejected or not; with an empty
    ``report`` a text is measured only as far as the cascade goes, and by the
    base rules if another one rejected it.  rejected_by names the rule at which
    the text left the cascade: where several reject it, that depends on the
    measured costs; nothing else does.  One row comes out for each row that goes in, in no shuffle; null texts count as
    empty (no words: rejected as few_words), null ids stay null, repeated rows
    give repeated rows, an empty table none.  Other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    order = [x["rule"] for x in plan_cascade(sample_texts(docs, id_col, text_col, sample_rows), rules)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cascade(order, tuple(r.name for r in base_rules()), report), _schema(rows.schema[0].dataType, report))


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 200) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, all columns as they were.

    The verdict is made row by row where the row is: ids only deal out the sample,
    so that null and repeated ones and columns of any name pass through.
    """
    rules = default_rules() if rules is None else rules
    order = [x["rule"] for x in plan_cascade(sample_texts(docs, id_col, text_col, sample_rows), rules)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept = [not any(r.rejects(t) for r in order) for t in (Text(x.as_py()) for x in batch.column(at))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
