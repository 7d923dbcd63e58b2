"""Views of the dependency graph: folds of paths to coarser nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.owners import longest_prefix

#: Nodes from which a view says that it was collapsed. Fixed value.
CROWDED = 200


@dataclass
class View:
    """nodes (node) and edges (src, dst), both distinct and without loops."""

    nodes: DataFrame
    edges: DataFrame
    grain: str = "modules"
    of: DataFrame | None = None  # (path, node), where paths were folded


def fold(modules: DataFrame, edges: DataFrame, node: Column, src: Column, dst: Column, grain: str) -> View:
    """Each path becomes its node; edges inside a node vanish, its node stays."""
    kept = edges.select(src.alias("src"), dst.alias("dst")).where("src is not null and dst is not null")
    nodes = modules.select(node.alias("node")).where("node is not null")
    ends = kept.select(F.col("src").alias("node")).unionByName(kept.select(F.col("dst").alias("node")))
    of = modules.select("path", node.alias("node")).where("node is not null").distinct()
    return View(nodes.unionByName(ends).distinct(), kept.where("src <> dst").distinct(), grain, of)


def top_modules(modules: DataFrame, edges: DataFrame) -> View:
    return fold(modules, edges, P.top_node("path"), P.top_node("src"), P.top_node("dst"), "top")


def deep_modules(modules: DataFrame, edges: DataFrame) -> View:
    return fold(modules, edges, P.deep_node("path"), P.deep_node("src"), P.deep_node("dst"), "deep")


def identity(modules: DataFrame, edges: DataFrame) -> View:
    return fold(modules, edges, F.col("path"), F.col("src"), F.col("dst"), "paths")


def units_view(units: DataFrame, unit_edges: DataFrame, module_edges: DataFrame) -> View:
    """V3, A2: unit edges and those that module edges show, each pair once."""
    roots = units.select("name", F.col("name").alias("root"))
    ends = module_edges.select(F.col("src").alias("path")).unionByName(module_edges.select(F.col("dst").alias("path"))).distinct()
    own = longest_prefix(ends, roots, P.SEP, root_owns=False, last_wins=True).select("path", "name")
    seen = module_edges.join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = unit_edges.select("src", "dst").unionByName(seen).where("src <> dst").distinct()
    return View(units.select(F.col("name").alias("node")).distinct(), edges, "units")


def modules_view(units: DataFrame, unit_edges: DataFrame, modules: DataFrame, module_edges: DataFrame) -> View:
    """V1: the coarsest fold with more than one node: top segments, last segments, paths where nothing contains them, units."""
    best = top_modules(modules, module_edges)
    if best.nodes.limit(2).count() > 1:
        return best
    deep = deep_modules(modules, module_edges)
    if deep.nodes.limit(2).count() > best.nodes.limit(2).count():
        return deep
    if modules.isEmpty():
        whole = identity(modules, module_edges)
        if whole.nodes.limit(2).count() > 1:
            return whole
    by_unit = units_view(units, unit_edges, module_edges)
    return by_unit if by_unit.nodes.limit(2).count() > 1 else best


def submodules(modules: DataFrame, edges: DataFrame, parent: str) -> View:
    """V4: the children of a parent; an unknown parent is an error."""
    p = F.lit(parent)
    view = fold(modules, edges, P.child_node(p, "path"), P.child_node(p, "src"), P.child_node(p, "dst"), parent)
    if view.nodes.isEmpty():
        raise ValueError(f"no submodules under {parent}")
    return view


def api_usage(edges: DataFrame) -> DataFrame:
    """(dst, src, symbols): what is used of each module, by whom."""
    used = edges.select("dst", "src", F.explode("symbols").alias("symbol"))
    return used.groupBy("dst", "src").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def ledger(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(src, dst, debt): edges that are used but not declared, and declared but not used."""
    a, b = used.select("src", "dst").distinct(), declared.select("src", "dst").distinct()
    missing = a.join(b, ["src", "dst"], "left_anti").withColumn("debt", F.lit("undeclared"))
    return missing.unionByName(b.join(a, ["src", "dst"], "left_anti").withColumn("debt", F.lit("unused")))


def manifest_edges(manifests: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst): manifest dependencies that name a unit, exactly or after normalisation."""
    deps = manifests.select("unit", F.explode("deps").alias("dep"))
    exact = units.select(F.col("name").alias("dep"), F.col("name").alias("_exact")).distinct()
    loose = units.groupBy(P.crate_name("name").alias("_key")).agg(F.min("name").alias("_loose"))
    out = deps.join(exact, "dep", "left").withColumn("_key", P.crate_name("dep")).join(loose, "_key", "left")
    return out.select(F.col("unit").alias("src"), F.coalesce("_exact", "_loose").alias("dst")).where("dst is not null and src <> dst").distinct()


def unit_product(unit_edges: DataFrame, unit_nodes: DataFrame) -> DataFrame:
    """(src, dst): unit edges spread over the nodes of both units (unit, node)."""
    a, b = unit_nodes.toDF("src", "a").distinct(), unit_nodes.toDF("dst", "b").distinct()
    return unit_edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct()


def markers(roles: DataFrame, node: Column) -> tuple[DataFrame, DataFrame]:
    """(node, role) where all roles of a node agree, and (unplaced): roles of nodes that disagree."""
    folded = roles.select(node.alias("node"), "role").groupBy("node").agg(F.min("role").alias("lo"), F.max("role").alias("hi"), F.count("*").alias("n"))
    agree = folded.where("lo = hi").select("node", F.col("lo").alias("role"))
    return agree, folded.where("lo <> hi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unplaced"))


def territory(owned: DataFrame, lineage: DataFrame, claim: str) -> DataFrame:
    """(path): what a claim and the claims below it own."""
    below = lineage.where(F.col("anc_name") == claim).select("name").distinct()
    return owned.join(F.broadcast(below), "name", "left_semi").select("path").distinct()


def neighbourhood(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """K7: edges with an end in a territory, and on which side it lies."""
    p = inside.select("path").distinct().withColumn("_in", F.lit(True))
    out = edges.select("src", "dst").distinct().join(p.toDF("src", "a"), "src", "left").join(p.toDF("dst", "b"), "dst", "left").where("a or b")
    return out.select("src", "dst", F.when(F.col("a") & F.col("b"), "inside").when(F.col("a"), "out").otherwise("in").alias("side"))


def attach_async(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """V8: (src, dst, kind): hard edges and async ones, without loops."""
    soft = rows.select("src", "dst").where("src <> dst").distinct().withColumn("kind", F.lit("async"))
    return edges.select("src", "dst").withColumn("kind", F.lit("direct")).unionByName(soft)


def crowded_note(view: View) -> str | None:
    """V7."""
    n = view.nodes.count()
    return f"{n} nodes: the view is too crowded to read, choose a coarser one" if n > CROWDED else None


def collision_note(view: View) -> str | None:
    """How many nodes stand for paths of more than one unit."""
    if view.of is None:
        return None
    units = view.of.groupBy("node").agg(F.count_distinct(F.element_at(P.segments("path"), 1)).alias("n"))
    n = units.where("n > 1").count()
    return f"{n} nodes stand for modules of more than one unit" if n else None


def soft_nodes(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """V9: nodes of the clusters overlay: modules and endpoints; the edges keep their multiplicity."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return modules.select(F.col("path").alias("node")).unionByName(ends).distinct()
