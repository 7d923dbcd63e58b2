"""Line deduplication in DataFrame functions alone.

Lines are exploded, normalised and hashed to 128 bits; documents are counted by
hash; the positions that go are gathered by document and taken out of its lines.
Only hashes and positions are shuffled by line.  A line that very many rows hold
is dealt to several tasks: its rows are counted before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, materialise, spread_join, wrapped


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(SPACE)))


def _judged(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, part_rows: int) -> DataFrame:
    """(row, total, dropped, kept) of each row; a text is shuffled once, in its row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = wrapped(docs, id=id_col, text=text_col).withColumn("text", text).withColumn("row_key", F.xxhash64("text"))
    lines = rows.where("id is not null").select("id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = materialise(keys.select("id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")))
    counted = hashed.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"), F.count("*").alias("rows"))
    common = materialise(counted.where(F.col("n") >= min_docs).select("h1", "h2", "last", "rows"))
    # the joins are of one kind at every size: sorted by line, and hashed by
    # document, where the small side is the positions
    gone = spread_join(hashed, common, ["h1", "h2"], "rows", part_rows).where("id <> last")
    drops = materialise(gone.groupBy("id", "row_key").agg(F.collect_set("pos").alias("drops")))
    out = rows.drop("text").join(drops.hint("shuffle_hash"), ["id", "row_key"], "left")
    out = out.withColumn("text", F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).withColumn("parts", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(F.col("parts"), i + 1)), "\n")
    dropped = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops"))
    return out.select("row", F.size("parts").cast("long").alias("total"), dropped.cast("long").alias("dropped"), F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, part_rows: int = 4096) -> DataFrame:
    """``docs`` with _lines_total, _lines_dropped and _lines_kept; columns of those names are replaced.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines, except in the largest doc_id with it.
    Null and empty texts are one empty line.  Documents are told apart by
    doc_id: rows that repeat one count once, and rows without one are not counted
    and lose nothing.  Rows of one doc_id with different texts are each judged by
    their own lines.  An empty table gives no row; all columns pass through.
    """
    out = _judged(docs, id_col, text_col, min_chars, min_docs, part_rows)
    own = {"_lines_total": "total", "_lines_dropped": "dropped", "_lines_kept": "kept"}
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *(F.col(v).alias(k) for k, v in own.items()))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, part_rows: int = 4096) -> DataFrame:
    """``docs`` with the kept lines as the text; a null text becomes empty."""
    out = _judged(docs, id_col, text_col, min_chars, min_docs, part_rows)
    return out.select(*((F.col("kept") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
