"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words; ``bytes.split()`` splits at exactly these.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where that is unset a temporary folder is set, on a local master only: on a
    cluster the executors could not read it.  A scratch table lives until
    ``release`` or the end of the application, since plans that read it are lazy.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="factloom-")
        if not held.isDefined():
            sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(release, spark)
    _SCRATCH.append(path)
    return path


#: Scratch tables that were not deleted yet, in the order in which they were written.
_SCRATCH: list[str] = []


def mark() -> int:
    """A place in the list of scratch tables, for ``release``."""
    return len(_SCRATCH)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables written since ``mark``; plans that read them no longer run."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    while len(_SCRATCH) > since:
        target = sc._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at files that outlive any executor.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and about ``size`` bytes, one row at least.

    Spark bounds its batches by bytes; what Python makes of one is bounded here,
    so that no setting of the session need change.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if part.nbytes > 2 * size:  # a few long texts among short ones
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part


def hot_keys(counts: DataFrame, most: int = 4096, keys: int = 100_000) -> DataFrame:
    """``counts`` (…, rows) of the keys with more rows than a part may hold, as (…, parts); at most ``keys`` of them.

    A part holds ``most`` rows, or one in ``keys`` of all rows if that is more, so
    that hot keys can never be more than ``keys``: they may be broadcast.
    """
    return hot_of(counts, counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], most, keys)


def hot_of(counts: DataFrame, total: int, most: int = 4096, keys: int = 100_000) -> DataFrame:
    """hot_keys of counts whose sum is known."""
    bound = max(most, -(-total // keys))
    return counts.where(F.col("rows") > bound).withColumn("parts", F.ceil(F.col("rows") / bound).cast("int")).drop("rows")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, most: int = 1024) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``rows`` the number of rows of ``left``.

    The rows of a hot key are dealt to parts, of which each has a copy of the key.
    """
    hot = F.broadcast(hot_keys(right.select(*keys, F.col(rows).alias("rows")), most))  # bounded by hot_keys
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("parts"))).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("part", part).drop("parts")
    copies = right.drop(rows).join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies.hint("merge"), [*keys, "part"]).drop("part")


def dealt_parts(rows: int, each: int) -> int:
    """How many partitions of ``each`` rows (or bytes, or tokens) there should be; 100,000 at most."""
    return max(1, min(100_000, -(-rows // each)))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("factloom_worker_cache", types.ModuleType("factloom_worker_cache"))
    return holder.__dict__.setdefault("cache", {})


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def lower_ascii(col):
    """A-Z to a-z, and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def wrapped(df: DataFrame, **named: str):
    """``df`` as a struct ``row`` beside the named columns, so that no other column's name can clash."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *(df[c].alias(k) for k, c in named.items()))


def field(name: str, kind) -> T.StructField:
    return T.StructField(name, kind, True)
