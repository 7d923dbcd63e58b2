"""What the readers here state of each language, and which rules that leaves without effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources import manifests, python_source, text_sources, trees

#: The facts that a rule may need. A reader names those that it states in its FACTS.
FACTS = ["file edges", "module edges", "type-only marks", "externals", "exports", "manifests", "module gates", "roles", "literal sites", "event records", "test gates"]
#: The facts without which a constraint checks nothing.
NEEDS = {
    "public_api_allowlist": ["exports"],
    "feature_boundary": ["module gates"],
    "no_cycles": ["file edges"],
    "forbid_external_crates": ["externals"],
    "external_free": ["externals"],
    "manifest_integrity": ["manifests"],
    "forbid_submodule_dependency": ["module edges"],
}


def stated(language: str) -> set[str]:
    """The facts that the readers of a language state together."""
    readers = [text_sources.FACTS.get(language, set()), manifests.FACTS.get(language, set()), python_source.FACTS if language == "python" else set()]
    return set().union(*readers)


def capability(spark: SparkSession) -> DataFrame:
    """(language, fact, status)."""
    rows = [(lang, fact, "yes" if fact in stated(lang) else "no") for lang in trees.PRIORITY for fact in FACTS]
    return spark.createDataFrame(rows, "language string, fact string, status string")


def inert_rules(spark: SparkSession, language: str, constraints: list[dict]) -> DataFrame:
    """(entry, kind, fact, status) of constraints whose facts no reader of the language states."""
    rows = [(k, c["type"], fact) for k, c in enumerate(constraints, 1) for fact in NEEDS.get(c["type"], [])]
    asked = spark.createDataFrame(rows, "entry long, kind string, fact string")
    return asked.join(F.broadcast(capability(spark).where(F.col("language") == language)), "fact").where("status <> 'yes'").select("entry", "kind", "fact", "status")


def present_elements(*sources: DataFrame) -> DataFrame:
    """U4: (path): everything that any fact names."""
    return reduce(DataFrame.unionByName, (s.select("path") for s in sources)).distinct()


def augmented(mapping: DataFrame, scores: DataFrame, language: str = "") -> DataFrame:
    """(unit, name, reclaimed): units that no claim matched, mapped by the first claim in order that addresses a module of theirs.

    ``mapping`` has unit and name (null where none); ``scores`` is claim_scores of
    the modules' paths.  A reclaimed unit keeps its finding beside the claim: its
    edges resolve, and the report still says that no claim names it.  In Go a
    unit is a path of its own, so that a claim which addresses it is no reclaim.
    """
    unit = F.element_at(P.segments("path"), 1) if language != "go" else F.col("path")
    first = scores.groupBy(unit.alias("unit")).agg(F.min_by("name", "idx").alias("soft"))
    out = mapping.join(first, "unit", "left")
    reclaimed = F.col("name").isNull() & F.col("soft").isNotNull() & F.lit(language != "go")
    return out.select("unit", F.coalesce("name", "soft").alias("name"), reclaimed.alias("reclaimed"))


def grouped_tier(edges: DataFrame, mapping: DataFrame, language: str) -> DataFrame:
    """(src, dst): for Go the edges between the declared groups of units; for others the edges as they are."""
    if language != "go":
        return edges.select("src", "dst").distinct()
    m = mapping.select("unit", "name")
    out = edges.join(m.toDF("src", "a"), "src", "left").join(m.toDF("dst", "b"), "dst", "left")
    return out.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()


def suggestions(dead: DataFrame, paths: DataFrame, scores: DataFrame, most: int = 3) -> DataFrame:
    """(target, named, more): the first paths that an entry without separator could mean, and how many others there are.

    A path is meant if its last segment is the entry, or if a claim of that very
    name addresses it (``scores`` is claim_scores).  Nothing is guessed by likeness.
    """
    asked = dead.select("target").where(~F.contains("target", F.lit(P.SEP))).distinct()
    by_tail = paths.select(F.col("name").alias("path"), P.bare("name").alias("target")).join(asked, "target")
    by_claim = scores.select("path", F.col("name").alias("target")).join(asked, "target").join(paths.select(F.col("name").alias("path")), "path", "left_semi")
    both = by_tail.select("target", "path").unionByName(by_claim.select("target", "path"))
    listed = both.groupBy("target").agg(F.array_sort(F.collect_set("path")).alias("all"))
    return listed.select("target", F.slice("all", 1, most).alias("named"), F.greatest(F.size("all") - most, F.lit(0)).cast("long").alias("more"))


def did_you_mean(named: list[str], more: int) -> str:
    """W10 as a sentence: fixed format of the finding."""
    quoted = [f'"{n}"' for n in named]
    if not quoted:
        return ""
    if more:
        text = f"{', '.join(quoted)}...and {more} more module path{'s' if more > 1 else ''}"
    else:
        text = quoted[0] if len(quoted) == 1 else f"{', '.join(quoted[:-1])} or {quoted[-1]}"
    return f"; allowed entries are module paths — did you mean {text}?"


def explain(placed: DataFrame, verdicts: DataFrame, findings: DataFrame, a: str, b: str) -> DataFrame:
    """(part, text): the edges, verdict and findings of one pair of claims, in that order."""
    rows = placed.where((F.col("src_claim") == a) & (F.col("dst_claim") == b))
    edges = rows.select(F.lit("edge").alias("part"), F.concat("src", F.lit(" -> "), "dst", F.lit(" ("), "placed", F.when(F.col("type_only"), ", type-only").otherwise(""), F.lit(")")).alias("text"))
    verdict = verdicts.where((F.col("src") == a) & (F.col("dst") == b)).select(F.lit("verdict").alias("part"), F.coalesce("verdict", F.lit("allowed")).alias("text"))
    told = findings.where(F.startswith("message", F.lit(f"{a} -> {b}"))).select(F.lit("finding").alias("part"), F.concat("category", F.lit(": "), "message").alias("text"))
    return edges.unionByName(verdict).unionByName(told)
