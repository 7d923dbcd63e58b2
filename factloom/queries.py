"""One query for each operator, over the projected driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import events, graph, owners
from .operators.state import settle
from .plans import capability, census, checks, cycles, sample_rules, views
from .plans.projection import Facts
from .plans.verify import FactSet, Verdict
from .sources import modules, trees
from .sources.rules import Rules, load_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SPEC = load_spec(sample_rules.TEXT)


def query(f):
    QUERIES[f.__name__] = f
    return f


class Run:
    """Facts and rules of one query, with what several queries build on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.facts, self.rules = spark, Facts(spark, sf_dir), Rules(spark, SPEC)
        self.held: dict[str, DataFrame] = {}

    def hold(self) -> Run:
        """Write what many checks share, so that it is made once: imports, async edges, scores, owners and placement."""
        for name in ("imports", "async_edges"):
            self.facts.held[name] = settle(getattr(self.facts, name)())
        for name in ("scores", "owned", "placed"):
            self.held[name] = settle(getattr(self, name)())
        return self

    def edges(self) -> DataFrame:
        """Module edges, written once: they are joined for both ends and for their endpoints."""
        if "edges" not in self.held:
            self.held["edges"] = settle(self.facts.module_edges())
        return self.held["edges"]

    def paths(self) -> DataFrame:
        return self.facts.modules().select("path").distinct()

    def patterns(self) -> DataFrame:
        return self.rules.patterns("modules")

    def owned(self) -> DataFrame:
        return self.held.get("owned") or owners.best_owners(self.scores())

    def unit_owner(self) -> DataFrame:
        units = self.facts.table("part").select(F.col("p_brand").alias("value")).distinct()
        found = owners.first_match(units, self.rules.patterns("units"))
        return found.where("idx is not null").select(F.col("value").alias("unit"), "name")

    def placed(self) -> DataFrame:
        return self.held.get("placed") or owners.place_edges(self.edges(), self.owned(), self.unit_owner(), self.rules.lineage(), self.facts.test_gated())

    def pairs(self) -> DataFrame:
        return owners.boundary_pairs(self.placed())

    def verdicts(self) -> DataFrame:
        return checks.pair_verdicts(self.pairs(), self.rules.policies(), self.rules.claims())

    def constraint(self, kind: str) -> dict:
        return next(c for c in SPEC.constraints if c["type"] == kind)

    def rings(self) -> DataFrame:
        edges = self.facts.cycle_graph()
        rings = graph.rings(edges, graph.strong_components(edges))
        return checks.ring_kinds(rings, self.facts.module_edges().where("not type_only"))

    def patterns_of(self, *kinds: str) -> DataFrame:
        return self.rules.patterns(*kinds)

    def owned_any(self) -> DataFrame:
        """(name): claims that some module matches, whoever owns it."""
        return self.scores().select("name").distinct()

    def scores(self) -> DataFrame:
        return self.held.get("scores") or owners.claim_scores(self.paths(), self.patterns())

    def file_owners(self) -> DataFrame:
        """(path, name): files by the claim of their module."""
        files = _files(self.spark, self.facts.dir)
        module = F.regexp_replace("path", r"^(.*)/src/(.*)/m[0-9]+\.ts$", "$1::$2")
        return files.select("path", module.alias("m")).join(self.owned().select(F.col("path").alias("m"), "name"), "m").select("path", "name")

    def evidence(self) -> DataFrame:
        """(src, dst, files): pairs of claims that file imports join."""
        own = self.owned().select("path", "name")
        e = self.facts.imports().where("src <> dst").select("src", "dst", F.col("src_file").alias("file")).distinct()
        pairs = e.join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "file")
        return census.evidence(pairs)

    def resolved_producers(self) -> DataFrame:
        units = self.facts.units().select("name", F.col("path").alias("root"))
        spellings = self.facts.units().select(F.col("name").alias("spelling"), F.col("name").alias("unit"), F.lit(0).alias("ord"))
        spelled = self.rules.producers().select(F.col("producer").alias("spelling"), F.lit(".").alias("producer_dir"))
        found = events.resolve_units(spelled, units, spellings)
        return found.join(units.select(F.col("name").alias("unit"), F.col("root").alias("canon")), "unit", "left").select("spelling", "unit", "canon")


def big(df: DataFrame, *names: str) -> DataFrame:
    """Counts as BIGINT, so that they compare with SQL's."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


# predicates and path algebra --------------------------------------------------


def _each_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    return r.paths().join(F.broadcast(r.patterns().select("pattern").distinct()))  # a rule document's patterns


@query
def p1_glob_match(spark, sf_dir):
    return _each_pattern(spark, sf_dir).where(P.glob_match("path", "pattern")).select("path", "pattern")


@query
def p2_module_matches(spark, sf_dir):
    return _each_pattern(spark, sf_dir).where(P.module_matches("pattern", "path")).select("path", "pattern")


@query
def p3_module_path_matches(spark, sf_dir):
    return _each_pattern(spark, sf_dir).where(P.module_path_matches("pattern", "path")).select("path", "pattern")


@query
def p4_module_listed(spark, sf_dir):
    return _each_pattern(spark, sf_dir).where(P.module_listed("pattern", "path")).select("path", "pattern")


@query
def p5_specificity(spark, sf_dir):
    return big(_each_pattern(spark, sf_dir).select("path", "pattern", P.specificity("pattern", "path").alias("score")).where("score is not null"), "score")


@query
def p6_path_algebra(spark, sf_dir):
    e = Facts(spark, sf_dir).module_edges()
    return e.select("src", "dst", P.strip_unit("src").alias("local"), P.common_ancestor("src", "dst").alias("up"), P.rel_after("unit", "dst").alias("rel"))


@query
def p7_folds(spark, sf_dir):
    p = Run(spark, sf_dir).paths().unionByName(Facts(spark, sf_dir).modules().select(F.col("unit").alias("path")).distinct())
    return p.select("path", P.top_node("path").alias("top"), P.deep_node("path").alias("deep"), P.child_node(F.lit("Brand#1"), "path").alias("child"))


@query
def p9_file_modules(spark, sf_dir):
    f = Facts(spark, sf_dir).file_edges().select("unit", "src").distinct()
    return f.select("src", P.file_module("src", "unit", "unit").alias("module"))


@query
def p10_test_gated(spark, sf_dir):
    r = Run(spark, sf_dir)
    return owners.gated_paths(r.facts.module_edges(), r.facts.test_gated())


@query
def p12_canonical_dir(spark, sf_dir):
    u = Facts(spark, sf_dir).units()
    odd = F.concat(F.lit("./"), "root", F.lit("//x/../"), "name", F.lit("/."))
    return u.select("name", P.canonical_dir(odd).alias("dir"), P.canonical_dir(F.concat(F.lit("../"), "root", F.lit("/../.."))).alias("up"))


@query
def p13_event_names(spark, sf_dir):
    e = Facts(spark, sf_dir).async_edges().select("event").distinct()
    return big(e.select("event", P.simple_event("event").alias("name"), P.event_suffix("event", F.lit(2)).alias("tail"), P.shared_tail("event", F.lit("mall.order.7")).alias("shared")), "shared")


@query
def p15_crate_names(spark, sf_dir):
    u = Facts(spark, sf_dir).units().select(F.replace("name", F.lit("_"), F.lit("-")).alias("name"))
    return u.select("name", P.crate_name("name").alias("crate"))


@query
def p17_within_zone(spark, sf_dir):
    u = Facts(spark, sf_dir).units()
    return u.select("path", P.within(F.lit("ASIA"), "path").alias("asia"), P.within(F.lit("AS"), "path").alias("part"), P.within(F.lit("."), "path").alias("all"))


@query
def p18_dispatch_rows(spark, sf_dir):
    n = Facts(spark, sf_dir).notices().distinct().select(F.concat(F.col("line"), F.lit(", xx -> "), P.diagnostic_class("line")).alias("line"))
    row = P.dispatch_row("line")
    return n.select("line", row["zone"].alias("zone"), F.array_join(row["languages"], ",").alias("languages"), row["winner"].alias("winner"))


@query
def p19_civil_date(spark, sf_dir):
    n = Facts(spark, sf_dir).table("orders").select((F.col("o_orderkey") * 7).alias("days"))
    return n.select("days", P.civil_date(F.col("days")).alias("date"))


# ownership -------------------------------------------------------------------


@query
def j1_owners(spark, sf_dir):
    return big(Run(spark, sf_dir).owned().select("path", "name", "score"), "score")


@query
def j3_unit_fallback(spark, sf_dir):
    return Run(spark, sf_dir).unit_owner()


@query
def j5_unit_mapping(spark, sf_dir):
    r = Run(spark, sf_dir)
    units = r.facts.units().select(F.col("path").alias("value")).unionByName(r.facts.units().select(F.concat("path", F.lit("/x")).alias("value")))
    rules = spark.createDataFrame([(0, "east", "A*/NATION_1*"), (1, "all_asia", "ASIA/*"), (2, "one", "EUROPE/NATION_3")], "idx int, name string, pattern string")
    found = owners.first_match(units, rules)
    lost = owners.split_unmatched(found)
    return found.join(lost, "value", "left").select("value", "name", "category")


@query
def j8_longest_prefix(spark, sf_dir):
    f = Facts(spark, sf_dir)
    roots = f.modules().select(F.col("unit").alias("name"), F.col("unit").alias("root")).unionByName(f.modules().select(F.concat("path", F.lit("!")).alias("name"), F.replace("path", F.lit("::"), F.lit("/src/")).alias("root"))).distinct()
    paths = f.file_edges().select(F.col("src").alias("path"))
    return owners.longest_prefix(paths, roots)


@query
def j9_boundary_pairs(spark, sf_dir):
    return Run(spark, sf_dir).pairs()


@query
def j9_placement(spark, sf_dir):
    return Run(spark, sf_dir).placed().groupBy("placed", "fallback").agg(F.count("*").alias("n"))


@query
def j9_unowned(spark, sf_dir):
    return owners.unowned_endpoints(Run(spark, sf_dir).placed())


@query
def j10_related_claims(spark, sf_dir):
    return owners.related(Run(spark, sf_dir).rules.lineage())


@query
def w8_policies(spark, sf_dir):
    return Run(spark, sf_dir).rules.policies().withColumnsRenamed({"list": "kind"})


# events ------------------------------------------------------------------------


def _events(spark, sf_dir):
    r = Run(spark, sf_dir)
    return r.facts.literal_sites(), r.rules.sides(), r.rules.constants()


@query
def j11_value_join(spark, sf_dir):
    return events.value_join(*_events(spark, sf_dir))


@query
def j12_value_census(spark, sf_dir):
    return events.value_census(*_events(spark, sf_dir), unfunded=["ts"])


@query
def j13_orientation(spark, sf_dir):
    sites, sides, _ = _events(spark, sf_dir)
    return events.oriented(sites, sides).groupBy("pattern", "noun", "role").agg(F.count("*").alias("n"))


@query
def j14_literal_sites(spark, sf_dir):
    r = Run(spark, sf_dir)
    position = F.when(F.col("noun") == "purchase", 1).otherwise(0)
    sites = r.facts.literal_sites()
    unit_path = r.facts.units().select("name", "path")
    tag = F.when(F.col("noun") == "click", "property").otherwise("call")
    c = sites.join(unit_path, sites.unit == unit_path.name).select(F.concat(unit_path.path, F.lit("/f.ts")).alias("path"), "language", tag.alias("tag"), "noun", position.alias("position"), "value")
    roots = r.facts.units().where("root <> 'ASIA'").select("name", F.col("path").alias("root"))
    found, refused = events.literal_sites(c, r.rules.sides(), roots)
    both = found.select("pattern", "unit").unionByName(refused.select("pattern", F.lit("(none)").alias("unit")))
    return both.groupBy("pattern", "unit").agg(F.count("*").alias("n"))


@query
def j16_resolved_units(spark, sf_dir):
    return Run(spark, sf_dir).resolved_producers()


@query
def j15_paired_sites(spark, sf_dir):
    f = Facts(spark, sf_dir)
    sides = Rules(spark, SPEC).sides()
    spoken = f.literal_sites().select("path", "language", "noun", "value").distinct()
    more = F.explode(F.sequence(F.lit(1), F.when(F.col("value").cast("int") % 3 == 0, 2).otherwise(1)))
    tag, position = F.when(F.col("noun") == "click", "property").otherwise("call"), F.when(F.col("noun") == "purchase", 1).otherwise(0)
    # one file, so that two nouns of a pattern share a key; its candidates come in the order of their nouns
    candidates = spoken.select(F.lit("f.ts").alias("path"), "language", tag.alias("tag"), "noun", position.alias("position"), F.concat(F.element_at(F.split("path", "/"), 1), F.lit(":"), "value").alias("value"), more.alias("again"))
    candidates = candidates.withColumn("ord", F.struct("noun", "again"))
    sites = events.matched_sides(candidates, sides).select("pattern", "path", "language", "value", "tag", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).distinct()
    return big(events.paired_sites(sites, candidates, sides), "ord").select("pattern", "language", "value", "tag", "ord", "noun")


@query
def j17_attribution(spark, sf_dir):
    f = Facts(spark, sf_dir)
    edges = f.async_edges()
    declared = edges.join(f.units().select(F.col("name").alias("src"), "root"), "src").select(F.col("root").alias("src"), "dst", "event")
    return joined(events.attribution(declared.unionByName(edges), edges), "derived_from")


@query
def j18_blind_zones(spark, sf_dir):
    f = Facts(spark, sf_dir)
    zones = f.units().select(F.col("root").alias("zone")).unionByName(f.units().select(F.col("path").alias("zone"))).unionByName(spark.createDataFrame([(".",), ("NOWHERE",)], "zone string"))
    u = f.units().select(F.col("name").alias("unit"), F.col("path").alias("at"))
    sites = f.literal_sites().join(u, "unit").select(F.concat("at", F.lit("/"), "noun").alias("path"))
    return events.blind_zones(zones, sites)


@query
def j20_async_placement(spark, sf_dir):
    f = Facts(spark, sf_dir)
    nodes = f.units().select(F.col("name").alias("endpoint"), F.col("root").alias("node"))
    nodes = nodes.unionByName(nodes.where("endpoint = 'NATION_7'").select("endpoint", F.lit("SECOND").alias("node")))
    return events.one_node_endpoints(f.async_edges(), nodes)[0]


@query
def j20_out_of_view(spark, sf_dir):
    f = Facts(spark, sf_dir)
    nodes = f.units().where("root <> 'ASIA'").select(F.col("name").alias("endpoint"), F.col("root").alias("node"))
    return events.one_node_endpoints(f.async_edges(), nodes)[1]


@query
def j21_edge_labels(spark, sf_dir):
    rows = Facts(spark, sf_dir).async_edges()
    return events.edge_labels(rows.unionByName(rows.withColumn("event", F.replace("event", F.lit("shop"), F.lit("mall")))))


@query
def a14_event_collisions(spark, sf_dir):
    r = Run(spark, sf_dir)
    return joined(events.collisions(r.rules.async_depends()), "events")


# graph -------------------------------------------------------------------------


@query
def g1_components(spark, sf_dir):
    return graph.strong_components(Facts(spark, sf_dir).cycle_graph())


@query
def g1_components_by_colour(spark, sf_dir):
    return graph.strong_components(Facts(spark, sf_dir).unit_edges(), local_edges=0)


@query
def g3_rings(spark, sf_dir):
    edges = Facts(spark, sf_dir).cycle_graph()
    return joined(graph.rings(edges, graph.strong_components(edges)), "ring")


@query
def g4_reach(spark, sf_dir):
    found = graph.reach_levels(Facts(spark, sf_dir).unit_edges(), "NATION_3")
    return big(found.select("node", "level"), "level")


@query
def g5_closure(spark, sf_dir):
    return graph.closure(Facts(spark, sf_dir).cycle_graph())


@query
def g6_induced(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return graph.induced(f.module_edges().select("src", "dst"), f.modules().where("unit like 'Brand#1%'").select(F.col("path").alias("node")))


@query
def g9_ring_kinds(spark, sf_dir):
    return joined(Run(spark, sf_dir).rings(), "ring")


@query
def g10_exempt_cycles(spark, sf_dir):
    rings = Run(spark, sf_dir).rings()
    found = checks.tier_rings(rings, "module", "warning")
    every = rings.select(F.array_join("ring", " -> ").alias("cycle"), F.element_at(F.split(F.element_at("ring", 1), "#|::"), 2).cast("int").alias("entry"))
    tier = F.when(F.col("entry") % 4 == 0, "file").when(F.col("entry") % 4 == 1, "both").otherwise("module")
    until = F.when(F.col("entry") % 3 == 0, "2020-01-01")
    rows = every.where("entry % 5 <> 0").select("entry", "cycle", tier.alias("tier"), F.lit(1).cast("long").alias("cap"), until.alias("until"), F.lit("debt").alias("reason"))
    old = spark.createDataFrame([(102, "a -> b -> a", "module", None, "2020-01-01", "old"), (103, "c -> d -> c", "both", None, None, "gone")], "entry int, cycle string, tier string, cap long, until string, reason string")
    return checks.cycle_findings(found, rows.unionByName(old), "2024-06-01").drop("entry")


@query
def u2_warnings_less_errors(spark, sf_dir):
    rings = Run(spark, sf_dir).rings()
    found = checks.tier_rings(rings, "module", "error", ["runtime"]).unionByName(checks.tier_rings(rings, "module", "warning"))
    none = spark.createDataFrame([], "entry int, cycle string, tier string, cap long, until string, reason string")
    return checks.cycle_findings(found, none, "2024-06-01").drop("entry")


@query
def g12_clusters(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return graph.clusters(views.soft_nodes(f.modules(), f.module_edges()), f.module_edges())


@query
def g12_cluster_outcome(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return graph.cluster_outcome(views.soft_nodes(f.modules(), f.module_edges()), f.module_edges())


@query
def g13_laundered(spark, sf_dir):
    f = Facts(spark, sf_dir)
    e = settle(f.unit_edges())
    units = f.table("nation").select("n_name", "n_regionkey")
    after = units.select(F.col("n_name").alias("dst"), F.pmod(F.col("n_regionkey") - 1, F.lit(5)).alias("n_regionkey"))
    bans = units.join(after, "n_regionkey").select(F.col("n_name").alias("src"), "dst")  # each unit of the next region
    return graph.laundered(e, e.where("src like 'NATION_1%' or src > dst"), bans)


@query
def a11_weights(spark, sf_dir):
    return graph.undirected_weights(Facts(spark, sf_dir).imports().where("src <> dst"))


# views ---------------------------------------------------------------------------


@query
def v1_modules_view(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.modules_view(f.units(), f.unit_edges(), f.modules(), f.module_edges()).edges


@query
def v2_deep_modules(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.deep_modules(f.modules(), f.module_edges()).edges


@query
def v3_units_view(spark, sf_dir):
    f = Facts(spark, sf_dir)
    brands = f.modules().select(F.col("unit").alias("name")).distinct()
    return views.units_view(brands, f.unit_edges(), f.module_edges()).edges


@query
def v4_submodules(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.submodules(f.modules(), f.module_edges(), "Brand#1").nodes


@query
def v5_api_usage(spark, sf_dir):
    return joined(views.api_usage(Facts(spark, sf_dir).module_edges()), "symbols")


@query
def v6_ledger(spark, sf_dir):
    f = Facts(spark, sf_dir)
    declared = f.unit_edges().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return views.ledger(f.unit_edges(), declared)


@query
def v8_async_arrows(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.attach_async(f.unit_edges(), f.async_edges())


@query
def v9_soft_nodes(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.soft_nodes(f.modules(), f.module_edges())


@query
def v10_territory(spark, sf_dir):
    r = Run(spark, sf_dir)
    return views.territory(r.owned(), r.rules.lineage(), "core")


@query
def k7_neighbourhood(spark, sf_dir):
    r = Run(spark, sf_dir)
    return views.neighbourhood(r.facts.module_edges(), views.territory(r.owned(), r.rules.lineage(), "edge"))


@query
def j19_unit_product(spark, sf_dir):
    f = Facts(spark, sf_dir)
    nodes = f.units().select(F.col("name").alias("unit"), F.concat("root", F.lit("!")).alias("node")).unionByName(f.units().select(F.col("name").alias("unit"), F.col("path").alias("node")))
    return views.unit_product(f.unit_edges(), nodes)


@query
def j22_manifest_edges(spark, sf_dir):
    f = Facts(spark, sf_dir)
    units = spark.createDataFrame([("LARGE",), ("PRO-MO",), ("SMALL",), ("small",)], "name string")
    deps = f.manifests().withColumn("deps", F.transform("deps", lambda d: F.when(d == "PROMO", "PRO_MO").otherwise(d)))
    return views.manifest_edges(deps, units)


@query
def a12_markers(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return views.markers(f.roles(), P.deep_node("path"))[0]


# censuses --------------------------------------------------------------------------


@query
def a1_violations(spark, sf_dir):
    return census.violation_counts(all_findings(spark, sf_dir))


@query
def a1_metrics(spark, sf_dir):
    r = Run(spark, sf_dir)
    return census.metrics(r.rules.claims(), r.facts.units(), r.facts.unit_edges(), r.facts.page_links(), checks.findings([checks.edge_findings(r.verdicts())]))


@query
def a2_unit_pairs(spark, sf_dir):
    return v3_units_view(spark, sf_dir).agg(F.count("*").alias("pairs"))


@query
def a3_async_census(spark, sf_dir):
    return census.async_census(Facts(spark, sf_dir).async_edges())


@query
def a4_declarations(spark, sf_dir):
    return census.declaration_census(Run(spark, sf_dir).rules.producers())


@query
def a5_environment(spark, sf_dir):
    return census.environment(Facts(spark, sf_dir).notices())


@query
def a6_site_census(spark, sf_dir):
    sites, sides, _ = _events(spark, sf_dir)
    return census.site_census(sites, sides)


@query
def a8_coverage(spark, sf_dir):
    r = Run(spark, sf_dir)
    return census.coverage(r.owned(), r.paths(), r.rules.lineage().where("anc_name = 'core'").select("name"))


@query
def a9_cycle_census(spark, sf_dir):
    r = Run(spark, sf_dir)
    return census.cycle_census(r.facts.cycle_graph(), r.rings())


@query
def a10_evidence(spark, sf_dir):
    return joined(Run(spark, sf_dir).evidence(), "files")


@query
def a13_declarers(spark, sf_dir):
    e = Facts(spark, sf_dir).async_edges().select("event", F.col("src").alias("unit"))
    return joined(census.declarers(e), "units")


@query
def a16_dropped_policies(spark, sf_dir):
    p = Run(spark, sf_dir).rules.allowed().select(F.concat_ws("|", "list", "target").alias("fingerprint"))
    return census.dropped_policies(p, p.distinct().where("fingerprint not like '%ghost'"))


# checks ------------------------------------------------------------------------------


@query
def r1_verdicts(spark, sf_dir):
    return Run(spark, sf_dir).verdicts()


@query
def r2_edge_findings(spark, sf_dir):
    return checks.edge_findings(Run(spark, sf_dir).verdicts()).drop("entry")


def _missing(r: Run) -> DataFrame:
    placed = r.placed()
    pairs = owners.boundary_pairs(placed)
    gated = placed.where("placed = 'gated' and src_claim is not null and dst_claim is not null").select(F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst")).distinct()
    unowned = placed.where("placed = 'unowned'").select(F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst"))
    return checks.missing_edges(pairs, r.rules.claims(), r.rules.allowed(), r.rules.lineage(), gated, unowned.where("src is not null"), r.evidence().select("src", "dst"))


@query
def r3_missing_edges(spark, sf_dir):
    return _missing(Run(spark, sf_dir))


@query
def r4_used_undeclared(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.used_undeclared(r.evidence(), r.pairs().where("dst <> 'promo'")).select("category", "message")


@query
def r5_facades(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return checks.facade_dependencies(f.module_edges(), f.roles(), f.test_gated()).select("category", "message")


def _contracts(r: Run) -> tuple[DataFrame, DataFrame]:
    owned = r.owned().select("path", F.col("name").alias("claim"))
    shown = r.facts.table("part").select(F.concat_ws("::", "p_brand", "p_type").alias("path"), F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("symbol")).distinct()
    return shown.join(owned, "path").select("claim", "symbol").distinct(), owned


def _forbidden(r: Run) -> tuple[DataFrame, DataFrame]:
    """(claim, stereotype) with what ancestors forbid, and (stereotype, pattern)."""
    own = r.spark.createDataFrame([(c.name, s) for c in SPEC.claims for s in c.forbid], "anc_name string, stereotype string")
    forbids = r.rules.lineage().select(F.col("name").alias("claim"), "anc_name").join(own, "anc_name").select("claim", "stereotype").distinct()
    return forbids, r.spark.createDataFrame([(x["name"], p) for x in SPEC.stereotypes for p in x["names"]], "stereotype string, pattern string")


def _exposing(r: Run) -> DataFrame:
    declaring = r.spark.createDataFrame([(c.name, c.expose) for c in SPEC.claims if c.expose is not None] + [("core_large", ["LARGE_1*"])], "chain string, patterns array<string>")
    return r.rules.lineage().select(F.col("name").alias("claim"), F.col("anc_name").alias("chain")).join(declaring, "chain")


@query
def r6_contract_leaks(spark, sf_dir):
    r = Run(spark, sf_dir)
    shown, _ = _contracts(r)
    forbids, kinds = _forbidden(r)
    return checks.contract_leaks(shown.withColumnRenamed("symbol", "name"), forbids, kinds).select("category", "message")


@query
def r7_unexposed(spark, sf_dir):
    r = Run(spark, sf_dir)
    shown, _ = _contracts(r)
    return checks.unexposed(shown, _exposing(r))


@query
def r9_public_api(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.public_api(r.facts.exports(), r.constraint("public_api_allowlist")["allowed"]).select("category", "message")


@query
def r10_forbidden_externals(spark, sf_dir):
    r = Run(spark, sf_dir)
    c = r.constraint("forbid_external_crates")
    return checks.forbidden_externals(r.facts.page_links(), c["from"], c["forbid"]).select("category", "message")


@query
def r11_external_free(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.external_free(r.facts.page_links(), r.constraint("external_free")["from"]).select("category", "message")


@query
def r12_manifests(spark, sf_dir):
    r = Run(spark, sf_dir)
    c = r.constraint("manifest_integrity")
    return checks.manifest_integrity(r.facts.manifests(), c["require_publish"], c["forbidden_dependencies"], c["required_features"]).select("category", "message")


@query
def r13_feature_boundary(spark, sf_dir):
    r = Run(spark, sf_dir)
    c = r.constraint("feature_boundary")
    return checks.feature_boundary(r.facts.module_decls(), r.facts.module_edges(), c["feature"], c["gated_modules"], c["allowed_from"]).select("category", "message")


@query
def r14_submodules(spark, sf_dir):
    r = Run(spark, sf_dir)
    c = r.constraint("forbid_submodule_dependency")
    return checks.submodule_dependencies(r.facts.module_edges(), c["parent"], c["from"], c["forbid"]).select("category", "message")


@query
def r15_engagement(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.engagement(owners.claim_scores(r.paths(), r.patterns()), r.rules.claims(), r.patterns())


@query
def r16_dead_references(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.dead_references(r.rules.allowed(), r.rules.claims()).select("category", "message")


@query
def r17_vacuous(spark, sf_dir):
    r = Run(spark, sf_dir)
    domains = {k: (c["type"], r.facts.page_links() if c["type"] in ("forbid_external_crates", "external_free") else r.facts.module_edges()) for k, c in enumerate(SPEC.constraints, 1)}
    domains[99] = ("no_cycles", r.facts.module_edges().where("unit = 'none'"))
    return spark.createDataFrame(checks.vacuous(domains), "entry long, kind string")


@query
def r18_async(spark, sf_dir):
    r = Run(spark, sf_dir)
    a = r.facts.async_edges()
    return checks.async_findings(r.rules.async_depends(), a, a, a, r.facts.units().select(F.col("name").alias("unit"))).select("category", "message", F.col("entry").cast("long"))


def _declared_events(f: Facts) -> DataFrame:
    """(entry, src, dst, event): every derived edge as a declared one, numbered by its event."""
    return f.async_edges().select((F.element_at(F.split("event", "[.]"), -1).cast("int") + 1).alias("entry"), "src", "dst", "event")


@query
def r19_schema_drift(spark, sf_dir):
    f = Facts(spark, sf_dir)
    entries = _declared_events(f).select("entry", "dst", "event").distinct()
    return checks.schema_drift(entries, *f.event_records()).select("message", F.col("entry").cast("long"))


@query
def r20_producers(spark, sf_dir):
    r = Run(spark, sf_dir)
    return checks.producer_findings(r.rules.producers(), r.resolved_producers()).select("category", "message")


@query
def r21_ambiguous(spark, sf_dir):
    r = Run(spark, sf_dir)
    return owners.ambiguous_owners(r.paths(), r.patterns())


def _components(r: Run) -> DataFrame:
    """(category, message): claims that hold nothing, and units that no claim names."""
    named = r.patterns_of("modules", "units").select("name").distinct()
    hit = r.owned_any().unionByName(r.unit_owner().select("name")).distinct()
    lost = named.join(hit, "name", "left_anti").select(F.lit("missing component").alias("category"), F.col("name").alias("message"))
    units = r.facts.modules().select(F.col("unit").alias("value")).distinct()
    mapped = owners.first_match(units, r.rules.patterns("units"))
    return lost.unionByName(owners.split_unmatched(mapped).select("category", F.col("value").alias("message")))


@query
def r22_components(spark, sf_dir):
    return _components(Run(spark, sf_dir))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the checks over the driver tables, in canonical order."""
    r = Run(spark, sf_dir).hold()
    c = {x["type"]: x for x in SPEC.constraints}
    miss = _missing(r)
    suffix = F.when(F.col("reason") == "", "").otherwise(F.concat(F.lit(" ("), "reason", F.lit(")")))
    edges, f = r.edges(), r.facts
    shown, _ = _contracts(r)
    hidden = checks.unexposed(shown, _exposing(r))
    twice = owners.ambiguous_owners(r.paths(), r.patterns())
    told = checks.engagement(r.scores(), r.rules.claims(), r.patterns())
    text = F.when(F.col("by").isNull(), F.concat("kind", F.lit(": "), "claim")).otherwise(F.concat("kind", F.lit(": "), "claim", F.lit(" is fully claimed by "), "by"))
    a = f.async_edges()
    rings = checks.tier_rings(cycles.claim_cycles(r.pairs()), "module", "error")
    parts = [
        _components(r).select("category", F.lit("error").alias("severity"), "message", F.lit(0).alias("entry")),
        checks.finding(twice, "ambiguous module match", F.concat("path", F.lit(" matches "), "name_a", F.lit(", "), "name_b")),
        checks.edge_findings(r.verdicts()),
        checks.finding(miss, "missing edge", F.concat(checks.arrow(), suffix)),
        checks.used_undeclared(r.evidence(), r.pairs()),
        checks.facade_dependencies(edges, f.roles(), f.test_gated()),
        checks.contract_leaks(shown.withColumnRenamed("symbol", "name"), *_forbidden(r)),
        checks.finding(hidden, "contract leak", F.concat("claim", F.lit(" exposes "), "symbol", F.lit(" (not exposed)"))),
        checks.cycle_findings(rings, r.rules.exempt(), "2024-06-01"),
        checks.public_api(f.exports(), c["public_api_allowlist"]["allowed"]),
        checks.forbidden_externals(f.page_links(), c["forbid_external_crates"]["from"], c["forbid_external_crates"]["forbid"]),
        checks.external_free(f.page_links(), c["external_free"]["from"]),
        checks.manifest_integrity(f.manifests(), True, c["manifest_integrity"]["forbidden_dependencies"], c["manifest_integrity"]["required_features"]),
        checks.feature_boundary(f.module_decls(), edges, c["feature_boundary"]["feature"], c["feature_boundary"]["gated_modules"], c["feature_boundary"]["allowed_from"]),
        checks.submodule_dependencies(edges, c["forbid_submodule_dependency"]["parent"], c["forbid_submodule_dependency"]["from"], c["forbid_submodule_dependency"]["forbid"]),
        checks.dead_references(r.rules.allowed(), r.rules.claims()),
        checks.finding(told, "warning", text, "warning"),
        checks.async_findings(r.rules.async_depends(), a, a, a, f.units().select(F.col("name").alias("unit"))),
        checks.schema_drift(_declared_events(f).select("entry", "dst", "event").distinct(), *f.event_records()),
        checks.producer_findings(r.rules.producers(), r.resolved_producers()),
    ]
    return checks.findings(parts).drop("entry").distinct()


def fact_set(spark: SparkSession, sf_dir: str) -> FactSet:
    """The driver tables as the facts of a scan, for a verdict over all of them."""
    f = Facts(spark, sf_dir)
    for name in ("imports", "async_edges"):
        f.held[name] = settle(getattr(f, name)())
    records, bases, enums, bound, own = f.event_records()
    graph_of_files = f.imports().where("src_file <> dst_file").groupBy("unit", F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.bool_and("type_only").alias("type_only"))
    brands = f.modules().select(F.col("unit").alias("name"), F.lit("brand").alias("kind"), F.col("unit").alias("path")).distinct()
    module = F.regexp_replace("path", r"^(.*)/src/(.*)/m[0-9]+\.ts$", "$1::$2")
    tables = {
        "units": brands.unionByName(f.units().select("name", "kind", "path")), "unit_edges": f.unit_edges(), "modules": f.modules(), "module_edges": f.module_edges().drop("weight"),
        "file_edges": graph_of_files.select("unit", "src", "dst", F.lit("use").alias("kind"), "type_only"), "file_modules": _files(spark, sf_dir).select("path", module.alias("module")),
        "externals": f.page_links(), "roles": f.roles(), "exports": f.exports(), "test_gated": f.test_gated(), "manifests": f.manifests(), "module_decls": f.module_decls(), "async_edges": f.async_edges().withColumn("kind", F.lit("publish")),
        "shown": f.table("part").select(F.concat_ws("::", "p_brand", "p_type").alias("path"), F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("symbol")).distinct(),
        "records": records, "bases": bases, "enums": enums, "bound": bound, "own_records": own, "declarers": f.async_edges().select("event", F.col("src").alias("unit")).distinct(),
    }
    return FactSet(spark, SPEC.language, tables)


@query
def r24_verdict(spark, sf_dir):
    """Everything that verify checks, over the driver tables at once."""
    return big(Verdict(fact_set(spark, sf_dir), SPEC, "2024-06-01").findings.drop("entry"), "category_ord")


@query
def r24_findings(spark, sf_dir):
    return big(all_findings(spark, sf_dir), "category_ord")


# trees ---------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    f = Facts(spark, sf_dir).imports()
    return f.select(F.col("src_file").alias("path")).unionByName(f.select(F.col("dst_file").alias("path"))).distinct()


@query
def s3_glob_exports(spark, sf_dir):
    f = Facts(spark, sf_dir)
    direct = f.table("part").where("p_size % 10 = 3 and p_type <> 'PROMO'").select(F.concat_ws("::", "p_brand", "p_type").alias("owner"), F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("symbol"))
    globs = f.cycle_graph().select(F.col("src").alias("owner"), F.col("dst").alias("target"))
    return modules.glob_exports(direct, globs, f.modules().where("unit <> 'Brand#14'"))


def _configs(spark, sf_dir) -> DataFrame:
    f = Facts(spark, sf_dir).modules()
    deep = f.select(F.concat("path", F.lit(".json")).alias("config"), F.replace("path", F.lit("::"), F.lit("/src/")).alias("dir"), F.concat("unit", F.lit(".json")).alias("extends")).where("dir like '%LARGE'")
    unit = f.select(F.concat("unit", F.lit(".json")).alias("config"), F.col("unit").alias("dir"), F.lit("base.json").alias("extends")).distinct()
    top = spark.createDataFrame([("base.json", ".", None)], "config string, dir string, extends string")
    return deep.unionByName(unit).unionByName(top)


@query
def s9_nearest_configs(spark, sf_dir):
    return modules.nearest_config(_files(spark, sf_dir), _configs(spark, sf_dir))


@query
def s9_config_chains(spark, sf_dir):
    return big(modules.config_chain(_configs(spark, sf_dir)), "depth")


@query
def s8_candidates(spark, sf_dir):
    e = Facts(spark, sf_dir).file_edges()
    name = F.regexp_extract("dst", r"src/([A-Z]+/m[0-9]+)\.ts$", 1)
    ending = F.when(F.rlike("dst", F.lit(r"[02468]\.ts$")), ".js").otherwise("")  # NodeNext spelling of a .ts file
    return trees.candidates(e.select("src", F.concat(F.lit("../"), name, ending).alias("specifier")), _files(spark, sf_dir))


@query
def s10_gitignore(spark, sf_dir):
    rules = spark.createDataFrame(
        [("", 1, "m1*.ts", False), ("", 2, "!m11.ts", True), ("", 3, "Brand#9/", False), ("Brand#1", 1, "src/LARGE", False), ("Brand#2", 1, "m1*.ts", True), ("Brand#3", 1, "/src/**/m4?.ts", False)],
        "base string, line int, pattern string, negated boolean",
    ).withColumn("pattern", F.ltrim("pattern", F.lit("!")))
    return trees.ignored(_files(spark, sf_dir), rules)


@query
def s14_languages(spark, sf_dir):
    mixed = _files(spark, sf_dir).select(F.when(F.col("path").like("%LARGE%"), F.replace("path", F.lit(".ts"), F.lit(".py"))).when(F.col("path").like("%PROMO%"), F.replace("path", F.lit(".ts"), F.lit(".go"))).otherwise(F.col("path")).alias("path"))
    return trees.language_counts(mixed)


@query
def s15_mixed_directories(spark, sf_dir):
    mixed = _files(spark, sf_dir).select(F.when(F.col("path").like("%m7.ts"), F.replace("path", F.lit(".ts"), F.lit(".py"))).otherwise(F.col("path")).alias("path"))
    return joined(trees.mixed_directories(mixed), "languages")


@query
def s16_exclusions(spark, sf_dir):
    return trees.exclusions(_files(spark, sf_dir), Run(spark, sf_dir).rules.excluded())


@query
def s17_dead_exclusions(spark, sf_dir):
    return trees.dead_exclusions(_files(spark, sf_dir), Run(spark, sf_dir).rules.excluded())


@query
def s21_file_map(spark, sf_dir):
    return trees.file_map(Facts(spark, sf_dir).file_edges())


@query
def s25_orphans(spark, sf_dir):
    f = Facts(spark, sf_dir)
    part = f.table("part").select(F.concat("p_brand", F.lit("/src/"), "p_type", F.lit("/m"), F.col("p_size").cast("string"), F.lit(".ts")).alias("path"))
    edges = f.file_edges().where("src not like '%/PROMO/%' and dst not like '%/PROMO/%'")
    outside = f.file_edges().where("src like '%/PROMO/m1%'").select(F.col("src").alias("path"))
    return census.orphans(part, edges, outside)


# cycles, capability and explanation ----------------------------------------------------


@query
def g7_claim_cycles(spark, sf_dir):
    return joined(cycles.claim_cycles(Run(spark, sf_dir).pairs()), "ring")


@query
def g8_file_cycles(spark, sf_dir):
    r = Run(spark, sf_dir)
    gated = _files(spark, sf_dir).where("path like '%/m7.ts'")
    told = cycles.claim_cycles(r.pairs())
    return joined(cycles.file_cycles(r.facts.file_graph(), r.file_owners(), r.rules.lineage(), told, gated), "ring")


@query
def g11_async_rings(spark, sf_dir):
    f = Facts(spark, sf_dir)
    legs = f.async_edges().select("src", "dst", (F.pmod(F.crc32(F.concat("src", "dst")), F.lit(2)) == 0).alias("publisher_only")).distinct()
    return joined(cycles.async_rings(f.unit_edges(), legs), "ring")


@query
def w12_rotated_rings(spark, sf_dir):
    e = Facts(spark, sf_dir).unit_edges()
    two = e.join(e.toDF("dst", "third"), "dst").where("third <> src")
    return two.select("src", "dst", "third", F.array_join(cycles.rotated(F.array("src", "dst", "third", "src")), ",").alias("ring"))


@query
def w10_suggestions(spark, sf_dir):
    r = Run(spark, sf_dir)
    names = r.facts.modules().select(F.col("path").alias("name")).distinct()
    asked = r.facts.table("part").select(F.col("p_type").alias("target")).unionByName(r.rules.claims().select(F.col("name").alias("target"))).unionByName(names.select(F.col("name").alias("target")))
    return joined(capability.suggestions(asked, names, r.scores()), "named")


@query
def u4_present_elements(spark, sf_dir):
    f = Facts(spark, sf_dir)
    e = f.module_edges()
    return capability.present_elements(f.modules(), e.select(F.col("src").alias("path")), e.select(F.col("dst").alias("path")), f.page_links().select(F.col("module").alias("path")), f.units())


@query
def j6_augmented_mapping(spark, sf_dir):
    r = Run(spark, sf_dir)
    units = r.facts.modules().select("unit").distinct().join(r.unit_owner(), "unit", "left")
    return capability.augmented(units, r.scores())


@query
def j7_grouped_tier(spark, sf_dir):
    r = Run(spark, sf_dir)
    e = r.facts.module_edges().select(F.element_at(P.segments("src"), 1).alias("src"), F.element_at(P.segments("dst"), 1).alias("dst"))
    return capability.grouped_tier(e, r.unit_owner(), "go")


@query
def r23_inert_rules(spark, sf_dir):
    return capability.inert_rules(spark, "python", SPEC.constraints)


@query
def j23_explain(spark, sf_dir):
    r = Run(spark, sf_dir)
    verdicts = r.verdicts()
    return capability.explain(r.placed(), verdicts, checks.edge_findings(verdicts), "core", "rest")


@query
def flagship_forbidden_edges(spark, sf_dir):
    """Slice 0: findings of the boundary pairs, from tables to messages."""
    return checks.findings([checks.edge_findings(Run(spark, sf_dir).verdicts())]).drop("entry")
