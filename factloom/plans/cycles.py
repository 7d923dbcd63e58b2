"""Cycle checks on claims, files and events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.state import settle
from . import checks


def rotated(ring: Column | str) -> Column:
    """A closed ring turned so that it begins at its smallest node."""
    r = F.col(ring) if isinstance(ring, str) else ring
    open_ = F.slice(r, 1, F.size(r) - 1)
    at = F.array_position(open_, F.array_min(open_)).cast("int")
    turned = F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, 1, at - 1))
    return F.concat(turned, F.slice(turned, 1, 1))


def claim_cycles(pairs: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """(component, ring, kind) of the claims' pairs, or of those among ``group`` (node)."""
    edges = pairs.select("src", "dst", "value")
    if group is not None:
        edges = graph.induced(edges, group)
    edges = settle(edges)
    rings = graph.rings(edges, graph.strong_components(edges))
    return checks.ring_kinds(rings, edges.where("value"))


def common_claims(members: DataFrame, lineage: DataFrame) -> DataFrame:
    """(component, claim): the deepest claim that holds all members' claims; no row where none does.

    ``members`` has component and claim.
    """
    up = members.join(F.broadcast(lineage.select(F.col("name").alias("claim"), "anc_name")), "claim")
    deep = lineage.groupBy(F.col("name").alias("anc_name")).agg(F.max("distance").alias("depth"))
    size = members.groupBy("component").agg(F.count_distinct("claim").alias("n"))
    shared = up.groupBy("component", "anc_name").agg(F.count_distinct("claim").alias("k")).join(size, "component").where("k = n").join(F.broadcast(deep), "anc_name")
    return shared.groupBy("component").agg(F.max_by("anc_name", "depth").alias("claim"))


def file_cycles(file_edges: DataFrame, owned: DataFrame, lineage: DataFrame, claim_rings: DataFrame, gated: DataFrame) -> DataFrame:
    """(component, ring, kind, claim) of files, less what a reported claim cycle already says.

    ``mod`` rows and gated files make no cycle.  A component is left out if every
    step of it from one claim to another is a step of a reported claim cycle and
    there is such a step.  ``owned`` has path (of a file) and name.  A leg is a
    value edge if some row of it is not type-only (``type_only``, where
    ``file_edges`` has it: languages without that mark have value edges alone).
    """
    if "type_only" not in file_edges.columns:
        file_edges = file_edges.withColumn("type_only", F.lit(False))
    live = file_edges.where("kind <> 'mod'").join(gated.select(F.col("path").alias("src")), "src", "left_anti").join(gated.select(F.col("path").alias("dst")), "dst", "left_anti")
    edges = settle(live.where("src <> dst").groupBy("src", "dst").agg(F.bool_and("type_only").alias("type_only")))
    parts = settle(graph.strong_components(edges))
    inside = edges.join(parts.toDF("src", "c"), "src").join(parts.toDF("dst", "d"), "dst").where("c = d")
    own = owned.select("path", "name")
    steps = inside.join(own.toDF("src", "a"), "src", "left").join(own.toDF("dst", "b"), "dst", "left").where("a <> b").select("c", "a", "b").distinct()
    legs = claim_rings.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))).alias("l")).select("l.a", "l.b").distinct()
    told = steps.join(legs.withColumn("_t", F.lit(True)), ["a", "b"], "left").groupBy(F.col("c").alias("component")).agg(F.bool_and(F.coalesce("_t", F.lit(False))).alias("told")).where("told")
    rings = graph.rings(edges, parts).join(told, "component", "left_anti")
    members = parts.join(own.toDF("node", "claim"), "node").select("component", "claim")
    return checks.ring_kinds(rings, edges.where("not type_only")).join(common_claims(members, lineage), "component", "left")


def async_rings(direct: DataFrame, declared: DataFrame, local_edges: int = graph.LOCAL_EDGES) -> DataFrame:
    """(ring, kind) of direct edges and declared publish legs (src, dst, publisher_only).

    A direct edge is carved out if every declared leg the other way only
    publishes and there is one.  Of each component the first simple ring through
    its smallest node counts if a leg of it is declared; each declared leg whose
    opposite direct edge stays is a mixed ring of two.  The depth-first law is
    sequential, so that each component is walked in a task of its own.
    """
    back = declared.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.bool_and("publisher_only").alias("_carve"))
    kept = direct.select("src", "dst").distinct().join(back, ["src", "dst"], "left").where("_carve is null or not _carve").select("src", "dst", F.lit(False).alias("soft"))
    both = settle(kept.unionByName(declared.select("src", "dst", F.lit(True).alias("soft")).distinct()))
    parts = graph.strong_components(both, local_edges)
    inside = both.join(parts.toDF("src", "c"), "src").join(parts.toDF("dst", "d"), "dst").where("c = d").select("c", "src", "dst", "soft")

    def run(table: pa.Table) -> pa.Table:
        rows = [*zip(*(table.column(c).to_pylist() for c in ("src", "dst", "soft")))]
        soft, out = {r[:2] for r in rows if r[2]}, {}
        for a, b in sorted({r[:2] for r in rows}):
            out.setdefault(a, []).append(b)
        ring = graph.simple_ring([*out], out) or []
        legs = set(zip(ring, ring[1:]))
        told = bool(legs & soft)
        return pa.table([pa.array([ring] * told, pa.list_(pa.string())), pa.array(["mixed" if legs - soft else "async"] * told, pa.string())], names=["ring", "kind"])

    whole = inside.groupBy("c").applyInArrow(run, "ring array<string>, kind string")
    two = both.where("soft and src <> dst").join(both.where("not soft").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return whole.unionByName(two.select(F.array(low, high, low).alias("ring"), F.lit("mixed").alias("kind"))).distinct()
