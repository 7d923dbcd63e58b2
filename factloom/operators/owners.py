"""Ownership joins: which claim, unit or directory holds a path.

Paths are made distinct before a join, literal patterns meet spellings in a hash
join, and only patterns with stars are compared one by one, against a broadcast
table as small as the rule document.  Every tie has an order of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def claim_scores(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, idx, name, depth, pos, score): each claim's best pattern on each path.

    ``paths`` has a column path; patterns are those of the kind modules.
    """
    forms = paths.select("path").distinct().select("path", F.explode(P.address_forms("path")).alias("f")).select("path", "f.form", "f.off")
    literal = F.broadcast(patterns.where(~F.contains("pattern", F.lit("*"))))
    starred = F.broadcast(patterns.where(F.contains("pattern", F.lit("*"))))
    whole = (F.char_length("form") + F.col("off")).alias("whole")
    keys = forms.select("path", F.explode(F.array_distinct(F.array("form", P.bare("form")))).alias("key"), whole)
    by_key = keys.join(literal, F.col("key") == F.col("pattern")).select("path", "idx", "name", "depth", "pos", F.when(F.col("path") == F.col("pattern"), F.lit(P.EXACT)).otherwise(F.col("whole")).alias("score"))
    stars = F.regexp_replace("pattern", r"\*+$", "")
    trailing = ~F.contains(stars, F.lit("*"))
    rx = P.glob_regex("pattern")
    starts, bare_starts = F.startswith("form", stars), F.startswith(P.bare("form"), stars)
    hit = F.when(trailing, F.when(starts, F.char_length(stars) + F.col("off")).when(bare_starts, F.col("whole")))
    hit = hit.otherwise(F.col("whole"))  # the join has matched it
    by_glob = forms.select("path", "form", "off", whole).join(starred, F.rlike(F.col("form"), rx) | F.rlike(P.bare("form"), rx)).select("path", "idx", "name", "depth", "pos", hit.alias("score"))
    scored = by_key.unionByName(by_glob).where("score is not null")
    # the best score of a claim, then its earliest pattern
    best = F.max_by(F.struct("score", "pos"), F.struct("score", (-F.col("pos")).alias("early")))
    return scored.groupBy("path", "idx", "name", "depth").agg(best.alias("b")).select("path", "idx", "name", "depth", F.col("b.pos").alias("pos"), F.col("b.score").alias("score"))


def owners(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, idx, name, depth, score): the most specific claim; then the deeper one, then the smaller name."""
    return best_owners(claim_scores(paths, patterns))


def best_owners(scored: DataFrame) -> DataFrame:
    """owners() of claim_scores."""
    rank = F.struct("score", "depth")
    top = scored.groupBy("path").agg(F.max(rank).alias("top"))
    tied = scored.join(top, "path").where(rank == F.col("top"))
    least = F.min_by(F.struct("idx", "name", "depth", "score"), "name")
    return tied.groupBy("path").agg(least.alias("o")).select("path", "o.*")


def ambiguous_owners(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, name_a, name_b): claims that share the top score."""
    w = Window.partitionBy("path")
    tied = claim_scores(paths, patterns).withColumn("top", F.max("score").over(w)).where("score = top").select("path", "name")
    a, b = tied.withColumnRenamed("name", "name_a"), tied.withColumnRenamed("name", "name_b")
    return a.join(b, "path").where("name_a < name_b")


def first_match(values: DataFrame, patterns: DataFrame, value: str = "value") -> DataFrame:
    """(value, idx, name): the first declared claim with a glob that matches, null where none does."""
    distinct = values.select(value).distinct()
    matched = distinct.join(F.broadcast(patterns), P.glob_match(F.col(value), F.col("pattern")))
    first = matched.groupBy(value).agg(F.min_by(F.struct("idx", "name"), F.col("idx")).alias("o")).select(value, "o.*")
    return distinct.join(first, value, "left")


def split_unmatched(mapped: DataFrame, value: str = "value") -> DataFrame:
    """Unmatched values are unassigned below a matched namespace, else unexpected."""
    parts = F.split(value, r"[./]")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    lost = mapped.where("idx is null and name is null")
    known = mapped.where("idx is not null").select(F.regexp_replace(value, r"\.", "/").alias("_up")).distinct()
    named = lost.select(value, F.explode(F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))).alias("_up")).join(known, "_up", "left_semi").select(value).distinct()
    return lost.join(named.withColumn("_below", F.lit(True)), value, "left").select(value, F.when(F.col("_below"), "unassigned unit").otherwise("unexpected component").alias("category"))


def place_edges(edges: DataFrame, owned: DataFrame, unit_owner: DataFrame, lineage: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Each edge with its claims, or why it has none.

    ``edges`` has unit, src, dst and type_only; ``owned`` is (path, name) of the
    most specific claims, ``unit_owner`` (unit, name) the fallback by unit;
    ``lineage`` relates claims to their ancestors.  placed is one of pair, gated,
    unowned and inside; fallback tells whether a side was placed by its unit.
    """
    # all that is known of an endpoint is put together once for each path, so that
    # the edges are shuffled for their two ends and no more
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    known = ends.withColumn("unit", F.element_at(P.segments("path"), 1)).join(owned.select("path", F.col("name").alias("own")), "path", "left")
    known = known.join(unit_owner.select("unit", F.col("name").alias("by_unit")), "unit", "left")
    if gated is None:
        known = known.withColumn("gate", F.lit(False))
    else:
        known = known.join(gated_paths(edges, gated).withColumn("gate", F.lit(True)), "path", "left")
    known = known.select("path", F.coalesce("own", "by_unit").alias("claim"), F.col("own").isNull().alias("loose"), F.coalesce("gate", F.lit(False)).alias("gate"))
    out = edges
    for side in ("src", "dst"):
        out = out.join(known.withColumnsRenamed({"path": side, "claim": f"{side}_claim", "loose": f"{side}_loose", "gate": f"{side}_gate"}), side)
    kin = F.broadcast(related(lineage).withColumn("_kin", F.lit(True)))
    out = out.join(kin, (F.col("src_claim") == F.col("a")) & (F.col("dst_claim") == F.col("b")), "left")
    placed = F.when(F.col("src_gate") | F.col("dst_gate"), "gated").when(F.col("src_claim").isNull() | F.col("dst_claim").isNull(), "unowned").when(F.col("_kin"), "inside").otherwise("pair")
    return out.select("unit", "src", "dst", "type_only", "src_claim", "dst_claim", placed.alias("placed"), (F.col("src_loose") | F.col("dst_loose")).alias("fallback"))


def gated_paths(edges: DataFrame, gated: DataFrame) -> DataFrame:
    """(path): endpoints that are gated, or lie under a gated path (P10)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return ends.select("path", F.explode(P.lineage("path")).alias("_q")).join(gated.select(F.col("path").alias("_q")).distinct(), "_q", "left_semi").select("path").distinct()


def boundary_pairs(placed: DataFrame) -> DataFrame:
    """(src, dst, value, fallback): claims that edges join; value if some edge is no type-only one."""
    pairs = placed.where("placed = 'pair'").groupBy(F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst"))
    return pairs.agg(F.bool_or(~F.col("type_only")).alias("value"), F.bool_and("fallback").alias("fallback"))


def unowned_endpoints(placed: DataFrame) -> DataFrame:
    """(path): endpoints without a claim, for a warning each."""
    lost = placed.where("placed = 'unowned'")
    sides = [lost.where(f"{s}_claim is null").select(F.col(s).alias("path")) for s in ("src", "dst")]
    return sides[0].unionByName(sides[1]).distinct()


def longest_prefix(paths: DataFrame, roots: DataFrame, sep: str = "/", root_owns: bool = True, last_wins: bool = False, tie: str = "name") -> DataFrame:
    """(path, name, root): the owner with the longest root that holds the path.

    ``roots`` has name and root; ``.`` is the tree's root, which owns the rest or
    nothing.  Among equal roots the first name wins, or the last one.  Ancestors
    are exploded, so that the join is an equi-join.
    """
    parts = F.split("path", sep if sep != "." else r"\.", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    spelled = F.concat(up, F.array(F.lit("."))) if root_owns else up
    exploded = paths.select("path").distinct().select("path", F.posexplode(spelled).alias("n", "root")).withColumn("n", F.when(F.col("root") == ".", F.lit(-1)).otherwise(F.col("n")))
    if not root_owns:
        roots = roots.where("root <> '.'")
    found = exploded.join(roots, "root")
    order = F.max if last_wins else F.min
    named = found.groupBy("path", "n", "root").agg(order(tie).alias("name"))
    return named.groupBy("path").agg(F.max_by(F.struct("name", "root"), "n").alias("o")).select("path", "o.*")


def related(lineage: DataFrame) -> DataFrame:
    """(a, b): claims of which one is the other or its ancestor."""
    up = lineage.select(F.col("name").alias("a"), F.col("anc_name").alias("b"))
    return up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

