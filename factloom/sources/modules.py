"""Facts that need a fixpoint or a chain: re-exports by glob, configuration chains, workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.graph import closure
from ..operators.owners import longest_prefix
from ..operators.state import settle


def glob_exports(direct: DataFrame, globs: DataFrame, modules: DataFrame) -> DataFrame:
    """S3: (owner, symbol, status): what modules expose, their own and what globs re-export, transitively.

    ``direct`` has owner and symbol, ``globs`` owner and target, ``modules`` path.
    A glob of an unknown module is unverifiable, one of a module without any
    public item is empty; both are named ``target::*``.
    """
    own = direct.select("owner", "symbol").distinct()
    reach = closure(globs.select(F.col("owner").alias("src"), F.col("target").alias("dst")))
    through = reach.join(own.withColumnRenamed("owner", "dst"), "dst").select(F.col("src").alias("owner"), "symbol")
    shown = settle(own.unionByName(through).distinct())
    known = modules.select(F.col("path").alias("target")).distinct()
    star = F.concat("target", F.lit("::*"))
    pairs = globs.select("owner", "target").distinct()
    unknown = pairs.join(known, "target", "left_anti").select("owner", star.alias("symbol"), F.lit("unverifiable").alias("status"))
    bare = pairs.join(known, "target", "left_semi").join(shown.select(F.col("owner").alias("target")).distinct(), "target", "left_anti")
    return shown.withColumn("status", F.lit("resolved")).unionByName(unknown).unionByName(bare.select("owner", star.alias("symbol"), F.lit("empty").alias("status")))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the configuration in the nearest directory above each file.

    ``configs`` has config and dir (``.`` at the top).
    """
    roots = configs.select(F.col("config").alias("name"), F.col("dir").alias("root"))
    return longest_prefix(files.select("path"), roots).select("path", F.col("name").alias("config"))


def config_chain(configs: DataFrame, max_depth: int = 64) -> DataFrame:
    """(config, base, depth): each configuration and those that it extends, in order; a loop is an error.

    ``configs`` has config and extends (null at the end).
    """
    step = settle(configs.select("config", "extends"))
    front = settle(step.select("config", F.col("config").alias("base"), F.lit(0).alias("depth")))
    done = front
    for depth in range(1, max_depth + 1):
        front = settle(front.join(step.select(F.col("config").alias("base"), "extends"), "base").where("extends is not null").select("config", F.col("extends").alias("base"), F.lit(depth).alias("depth")))
        if front.isEmpty():
            return done
        done = settle(done.unionByName(front))
    raise ValueError(f"a configuration extends itself, or more than {max_depth} others")


def effective(chain: DataFrame, settings: DataFrame) -> DataFrame:
    """(config, key, value): each setting from the nearest link of the chain that has it."""
    found = chain.join(settings.withColumnRenamed("config", "base"), "base")
    return found.groupBy("config", "key").agg(F.min_by("value", "depth").alias("value"))


def workspace_members(packages: DataFrame, patterns: list[str]) -> DataFrame:
    """(path): package directories that a workspace's globs take in; a pattern with ``!`` takes out."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit & ~P.glob_match("path", F.lit(p[1:])) if p.startswith("!") else hit | P.glob_match("path", F.lit(p))
    return packages.where(hit).select("path").distinct()
