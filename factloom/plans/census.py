"""Counts over facts and findings.  All are exact and pre-aggregated by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: The bucket of a category; every other category is a contract's. Fixed values.
BUCKETS = {
    "missing component": "components",
    "unexpected component": "components",
    "unassigned unit": "components",
    "ambiguous module match": "components",
    "forbidden edge present": "boundary",
    "facade dependency": "boundary",
    "missing edge": "undeclared",
    "disallowed cross-component dependency": "undeclared",
    "used but undeclared": "undeclared",
    "cycle detected in": "cycles",
}


def bucket(category: Column, message: Column) -> Column:
    known = reduce(lambda out, kv: out.when(category == kv[0], kv[1]), BUCKETS.items(), F.when((category == "warning") & F.startswith(message, F.lit("cycle: ")), "cycles"))
    return known.when(category == "warning", None).otherwise("contracts")


def violation_counts(found: DataFrame) -> DataFrame:
    """A1: (bucket, n)."""
    return found.select(bucket(F.col("category"), F.col("message")).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def metrics(claims: DataFrame, units: DataFrame, unit_edges: DataFrame, externals: DataFrame, found: DataFrame) -> DataFrame:
    """A1: (metric, n)."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")

    parts = [one("components", claims), one("units", units), one("edges_internal", unit_edges.select("src", "dst").distinct()), one("edges_external", externals.select("package").distinct())]
    counts = violation_counts(found)
    return reduce(DataFrame.unionByName, parts).unionByName(counts.select(F.concat(F.lit("violations_"), "bucket").alias("metric"), "n"))


def async_census(rows: DataFrame) -> DataFrame:
    """A3: (face, name, fan_out, fan_in): distinct partners of each service, and publishers and subscribers of each event."""
    pairs = rows.select("src", "dst", "event").distinct()
    sides = pairs.select(F.col("src").alias("name"), F.col("dst").alias("out"), F.lit(None).cast("string").alias("into"))
    sides = sides.unionByName(pairs.select(F.col("dst").alias("name"), F.lit(None).cast("string").alias("out"), F.col("src").alias("into")))
    service = sides.groupBy("name").agg(F.count_distinct("out").alias("fan_out"), F.count_distinct("into").alias("fan_in")).select(F.lit("service").alias("face"), "name", "fan_out", "fan_in")
    event = pairs.groupBy(F.col("event").alias("name")).agg(F.count_distinct("src").alias("fan_out"), F.count_distinct("dst").alias("fan_in")).select(F.lit("event").alias("face"), "name", "fan_out", "fan_in")
    return service.unionByName(event)


def declaration_census(producers: DataFrame) -> DataFrame:
    """A4: (class, producer, constant)."""
    return producers.select("class", "producer", (F.col("kind") == "shared_constant").alias("constant")).distinct()


def environment(notices: DataFrame) -> DataFrame:
    """A5: (class, n) of the notices' lines."""
    return notices.groupBy(P.diagnostic_class("line").alias("class")).agg(F.count("*").alias("n"))


def build_state(notices: DataFrame, unbuilt: list[str]) -> DataFrame:
    """A5: one row: UNBUILT if a notice of such a class is there, else BUILT."""
    bad = F.count_if(P.diagnostic_class("line").isin(unbuilt))
    return notices.agg(F.when(bad > 0, "UNBUILT").otherwise("BUILT").alias("state"))


def site_census(sites: DataFrame, sides: DataFrame) -> DataFrame:
    """(pattern, language, noun, n); declared sides without a site count 0."""
    counted = sites.groupBy("pattern", "language", "noun").agg(F.count("*").alias("n"))
    declared = sides.select("pattern", "language", "noun").distinct().withColumn("z", F.lit(0).cast("long"))
    return counted.join(declared, ["pattern", "language", "noun"], "full").select("pattern", "language", "noun", F.coalesce("n", "z").alias("n"))


def coverage(owned: DataFrame, paths: DataFrame, members: DataFrame) -> DataFrame:
    """One row (inside, total): paths in the territory of the claims ``members`` (name)."""
    hit = paths.select("path").distinct().join(owned.select("path", "name"), "path", "left").join(F.broadcast(members.select("name").distinct().withColumn("_m", F.lit(True))), "name", "left")
    return hit.agg(F.count_if(F.col("_m")).alias("inside"), F.count("*").alias("total"))


def cycle_census(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """One row (nodes, rows, cycles)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count("*").alias("nodes"))
    return nodes.join(edges.agg(F.count("*").alias("rows"))).join(rings.agg(F.count("*").alias("cycles")))  # three rows of one


def evidence(file_pairs: DataFrame) -> DataFrame:
    """A10: (src, dst, files): the importing files of each pair of claims, each once."""
    return file_pairs.groupBy("src", "dst").agg(F.array_sort(F.collect_set("file")).alias("files"))


def declarers(exports: DataFrame) -> DataFrame:
    """(event, units)."""
    return exports.groupBy("event").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def orphans(files: DataFrame, edges: DataFrame, externals: DataFrame) -> DataFrame:
    """(path): files that no fact names."""
    seen = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).unionByName(externals.select("path"))
    return files.select("path").distinct().join(seen.distinct(), "path", "left_anti")


def dropped_policies(loaded: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(fingerprint, n): rows that a reseed lost, as a difference of multisets."""
    return loaded.select("fingerprint").exceptAll(regenerated.select("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))
