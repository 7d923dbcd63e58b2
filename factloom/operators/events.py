"""The value join of publishers and subscribers, with a census of every site.

Each site lands in an edge or in a named row; nothing is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .owners import longest_prefix

UNFUNDED = ("unfunded",)


def oriented(sites: DataFrame, sides: DataFrame) -> DataFrame:
    """Sites with the one distinct role that the sides declare for (pattern, noun), else null."""
    roles = sides.groupBy("pattern", "noun").agg(F.collect_set("role").alias("r"))
    role = F.when(F.size("r") == 1, F.element_at("r", 1))
    return sites.join(F.broadcast(roles.select("pattern", "noun", role.alias("role"))), ["pattern", "noun"], "left")  # as small as the rules


def constants_apart(sites: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites of a shared constant's class, and the others."""
    named = F.broadcast(constants.select(F.col("class").alias("pattern")).distinct())
    return sites.join(named, "pattern", "left_semi"), sites.join(named, "pattern", "left_anti")


def value_join(sites: DataFrame, sides: DataFrame, constants: DataFrame) -> DataFrame:
    """(src, dst, event, pattern): publishers and subscribers of one value within a pattern, self pairs included.

    Sites are made distinct by unit before the join, so that a value which many
    sites name fans out by units and not by sites.
    """
    _, rest = constants_apart(sites, constants)
    legs = oriented(rest, sides).select("unit", "value", "pattern", "role").distinct()
    pub = legs.where("role = 'publish'").select(F.col("unit").alias("src"), "value", "pattern")
    sub = legs.where("role = 'subscribe'").select(F.col("unit").alias("dst"), "value", "pattern")
    return pub.join(sub, ["value", "pattern"]).select("src", "dst", F.col("value").alias("event"), "pattern")


def value_census(sites: DataFrame, sides: DataFrame, constants: DataFrame, unfunded: list[str] = []) -> DataFrame:
    """(kind, pattern, value, n): what becomes of the sites.

    joined, shared-constant, ambiguous-leg, one-sided-leg and unfunded-shape
    count each site once; value-namespace names values with more than one
    pattern and unoriented names patterns without any role (n is null).
    """
    fixed, rest = constants_apart(sites, constants)
    legs = oriented(rest, sides)
    by_value = legs.groupBy("value", "pattern").agg(F.bool_or(F.col("role") == "publish").alias("pub"), F.bool_or(F.col("role") == "subscribe").alias("sub"))
    declared = sides.where("role is not null").groupBy("pattern", "role").agg(F.bool_or(F.col("language").isin(unfunded) if unfunded else F.lit(False)).alias("poor"))
    other = F.when(F.col("role") == "publish", "subscribe").otherwise("publish")
    judged = legs.join(by_value, ["value", "pattern"]).withColumn("_other", other)
    judged = judged.join(F.broadcast(declared.withColumnsRenamed({"role": "_other"})), ["pattern", "_other"], "left")
    kind = F.when(F.col("role").isNull(), "ambiguous-leg").when(F.col("pub") & F.col("sub"), "joined").when(F.col("poor"), "unfunded-shape").otherwise("one-sided-leg")
    counted = judged.withColumn("kind", kind).groupBy("kind", "pattern", "value").agg(F.count("*").alias("n"))
    held = fixed.groupBy("pattern", "value").agg(F.count("*").alias("n")).select(F.lit("shared-constant").alias("kind"), "pattern", "value", "n")
    none = F.lit(None).cast("long").alias("n")
    spaces = rest.groupBy("value").agg(F.count_distinct("pattern").alias("k")).where("k > 1").select(F.lit("value-namespace").alias("kind"), F.lit(None).cast("string").alias("pattern"), "value", none)
    roleless = sides.groupBy("pattern").agg(F.count("role").alias("k")).where("k = 0").join(rest.select("pattern").distinct(), "pattern", "left_semi")
    unoriented = roleless.select(F.lit("unoriented").alias("kind"), "pattern", F.lit(None).cast("string").alias("value"), none)
    return counted.unionByName(held).unionByName(spaces).unionByName(unoriented)


def literal_sites(candidates: DataFrame, sides: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites (with their owner unit) of the candidates that a side names, and refused ones without an owner."""
    matched = matched_sides(candidates, sides).select("path", "language", "tag", "noun", "position", "value", "pattern").distinct()
    found = matched.join(longest_prefix(matched, roots).select("path", F.col("name").alias("unit")), "path", "left")
    return found.where("unit is not null"), found.where("unit is null").drop("unit")


def matched_sides(candidates: DataFrame, sides: DataFrame) -> DataFrame:
    """``candidates`` with pattern and side (its number), a row for each side that names one.

    A call matches by name and argument position, an exported property by name.
    """
    s = F.broadcast(sides.select("pattern", "side", F.col("noun").alias("_noun"), F.col("language").alias("_lang"), F.col("tag").alias("_tag"), F.col("position").alias("_pos")))  # as small as the rules
    same = (F.col("language") == F.col("_lang")) & (F.col("tag") == F.col("_tag")) & (F.col("noun") == F.col("_noun")) & ((F.col("tag") == "property") | F.col("position").eqNullSafe(F.col("_pos")))
    return candidates.join(s, same).drop("_noun", "_lang", "_tag", "_pos")


def paired_sites(sites: DataFrame, candidates: DataFrame, sides: DataFrame) -> DataFrame:
    """``sites`` with the noun of the pair of candidate and side that each takes, null where none is left.

    Pairs are those that match; each goes to one site of its own pattern, path,
    language, value and tag (call or property).  Sites take them in order (ord),
    pairs are taken by their candidate's order (ord), then their side's.
    """
    key = ["pattern", "path", "language", "value", "tag"]
    turn = "row_number() over (partition by pattern, path, language, value, tag order by {}) as _turn"
    pairs = matched_sides(candidates, sides).selectExpr(*key, "noun", turn.format("ord, side"))
    return sites.selectExpr("*", turn.format("ord")).join(pairs, [*key, "_turn"], "left").drop("_turn")


def resolve_units(spelled: DataFrame, units: DataFrame, spellings: DataFrame) -> DataFrame:
    """(spelling, producer_dir, unit): the unit that a spelling names, null where it names none.

    In order: ``.`` is the owner of the directory where it stands; an exact
    spelling; a canonical one; the deepest unit directory that holds it.
    ``units`` has name and root; ``spellings`` has spelling, unit and ord (the
    first registration wins, ``.`` is never registered).
    """
    table = spellings.where("spelling <> '.'").groupBy("spelling").agg(F.min_by("unit", "ord").alias("unit"))
    canon = P.canonical_dir("spelling")
    base = spelled.select("spelling", "producer_dir").distinct().withColumn("canon", canon)
    own = longest_prefix(base.select(P.canonical_dir("producer_dir").alias("path")), units).toDF("_dir", "_dir_unit", "_r1")
    held = longest_prefix(base.where(F.contains("canon", F.lit("/"))).select(F.col("canon").alias("path")), units, root_owns=False).toDF("_canon", "_held", "_r2")
    dirs = units.groupBy("root").agg(F.min("name").alias("_at")).withColumnRenamed("root", "_root")
    out = base.join(own.drop("_r1"), P.canonical_dir("producer_dir") == F.col("_dir"), "left")
    out = out.join(table.toDF("_s1", "_exact"), F.col("spelling") == F.col("_s1"), "left").join(table.toDF("_s2", "_canonical"), F.col("canon") == F.col("_s2"), "left")
    out = out.join(held.drop("_r2"), F.col("canon") == F.col("_canon"), "left").join(dirs, F.col("canon") == F.col("_root"), "left")
    return out.select("spelling", "producer_dir", F.when(F.col("canon") == ".", F.col("_dir_unit")).otherwise(F.coalesce("_exact", "_canonical", "_held", "_at")).alias("unit"))


def attribution(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(src, dst, event, derived_from): declared rows whose event reaches dst, but from other units only."""
    near = derived.groupBy("dst", "event").agg(F.array_sort(F.collect_set("src")).alias("derived_from"))
    return declared.select("src", "dst", "event").distinct().join(derived.select("src", "dst", "event"), ["src", "dst", "event"], "left_anti").join(near, ["dst", "event"]).select("src", "dst", "event", "derived_from")


def blind_zones(zones: DataFrame, sites: DataFrame) -> DataFrame:
    """(zone, n): distinct files with sites in each zone (by whole path components), 0 included.

    Files are exploded to their ancestors, so that the join is an equi-join.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = sites.select("path").distinct().select("path", F.explode(F.concat(up, F.array(F.lit(".")))).alias("zone"))
    return zones.select("zone").distinct().join(near, "zone", "left").groupBy("zone").agg(F.count_distinct("path").alias("n"))


def one_node_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between endpoints that fold to exactly one node, and the count of the others.

    ``nodes`` has endpoint and node.
    """
    single = nodes.groupBy("endpoint").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo = hi").select("endpoint", F.col("lo").alias("node"))
    out = edges.join(single.toDF("src", "a"), "src", "left").join(single.toDF("dst", "b"), "dst", "left")
    seen = out.where("a is not null and b is not null and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "event").distinct()
    return seen, out.where("a is null or b is null").groupBy("event").agg(F.count("*").alias("out_of_view"))


def edge_labels(rows: DataFrame) -> DataFrame:
    """(src, dst, event, label): the shortest tail that tells the events of one pair apart."""
    a, b = rows.select("src", "dst", "event").distinct(), rows.select("src", "dst", F.col("event").alias("other")).distinct()
    near = a.join(b, ["src", "dst"]).where("event <> other").groupBy("src", "dst", "event").agg(F.max(P.shared_tail("event", "other")).alias("k"))
    out = a.join(near, ["src", "dst", "event"], "left")
    return out.select("src", "dst", "event", P.event_suffix("event", F.coalesce("k", F.lit(0)) + 1).alias("label"))


def collisions(entries: DataFrame) -> DataFrame:
    """(src, dst, name, events): simple names that stand for more than one event between two units."""
    named = entries.withColumn("name", P.simple_event("event")).groupBy("src", "dst", "name").agg(F.array_sort(F.collect_set("event")).alias("events"))
    return named.where(F.size("events") > 1)
