"""All checks of a rule document over one set of facts, and what a scan of a tree puts together for them.

Every check is a lazy table of findings.  A constraint whose facts are not there
is told of as vacuous: nothing passes in silence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import events, graph, owners
from ..operators.state import settle
from ..sources.rules import Rules, Spec
from . import capability, census, checks, cycles

#: The fact tables and their columns.
TABLES = {
    "units": "name string, kind string, path string",
    "unit_edges": "src string, dst string",
    "modules": "unit string, path string",
    "module_edges": "unit string, src string, dst string, symbols array<string>, type_only boolean",
    "file_edges": "unit string, src string, dst string, kind string, type_only boolean",
    "file_modules": "path string, module string",
    "externals": "module string, package string",
    "roles": "path string, role string",
    "exports": "owner string, symbol string, status string",
    "shown": "path string, symbol string",
    "manifests": "unit string, publish boolean, deps array<string>, features array<string>",
    "module_decls": "unit string, name string, feature string, file string",
    "test_gated": "path string",
    "async_edges": "src string, dst string, event string, kind string",
    "records": "record string, field string, type string",
    "bases": "record string, base string",
    "enums": "name string",
    "bound": "dst string, record string, field string, bound boolean, projected boolean",
    "own_records": "dst string, record string, field string, type string",
    "declarers": "event string, unit string",
}
#: Whether files make cycles where a rule says nothing of the scope. Fixed values.
BOTH_TIERS = {"rust", "ts", "python", "kotlin"}


@dataclass
class FactSet:
    """Fact tables by name; a table that is not given is empty."""

    spark: SparkSession
    language: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], TABLES[name])
        return self.tables[name]

    def has(self, name: str) -> bool:
        return name in self.tables


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Verdict:
    """One set of facts against one rule document."""

    def __init__(self, facts: FactSet, spec: Spec, today: str):
        self.facts, self.spec, self.today = facts, spec, today
        self.spark, self.rules = facts.spark, Rules(facts.spark, spec)

    # what several checks build on, written once ------------------------------

    @cached_property
    def edges(self) -> DataFrame:
        return settle(self.facts.module_edges.select("unit", "src", "dst", "symbols", "type_only"))

    @cached_property
    def paths(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("path"))
        return settle(ends.unionByName(self.facts.modules.select("path")).distinct())

    @cached_property
    def scores(self) -> DataFrame:
        return settle(owners.claim_scores(self.paths, self.rules.patterns("modules")))

    @cached_property
    def owned(self) -> DataFrame:
        return settle(owners.best_owners(self.scores))

    @cached_property
    def mapped(self) -> DataFrame:
        """(value, idx, name): units by the claim that names them, null where none does."""
        return settle(owners.first_match(self.facts.units.select(F.col("name").alias("value")), self.rules.patterns("units")))

    @cached_property
    def mapping(self) -> DataFrame:
        """(unit, name, reclaimed): with units that only a claim's modules place."""
        return settle(capability.augmented(self.mapped.select(F.col("value").alias("unit"), "name"), self.scores, self.facts.language))

    @cached_property
    def unit_owner(self) -> DataFrame:
        return self.mapping.where("name is not null").select("unit", "name")

    @cached_property
    def placed(self) -> DataFrame:
        gated = self.facts.test_gated if self.facts.has("test_gated") else None
        return settle(owners.place_edges(self.edges, self.owned, self.unit_owner, self.rules.lineage(), gated))

    @cached_property
    def pairs(self) -> DataFrame:
        """(src, dst, value, fallback): claims that module edges or unit edges join."""
        own = self.unit_owner
        hard = self.facts.unit_edges.join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a <> b")
        kin = owners.related(self.rules.lineage()).toDF("a", "b")
        hard = hard.join(F.broadcast(kin), ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("value"), F.lit(True).alias("fallback"))
        both = owners.boundary_pairs(self.placed).unionByName(hard)
        return settle(both.groupBy("src", "dst").agg(F.bool_or("value").alias("value"), F.bool_and("fallback").alias("fallback")))

    @cached_property
    def verdicts(self) -> DataFrame:
        return settle(checks.pair_verdicts(self.pairs, self.rules.policies(), self.rules.claims(), self.granted_by_unit))

    @cached_property
    def granted_by_unit(self) -> DataFrame:
        """(src, dst, via): pairs whose edges come from a unit with a claim of its own, and that claim."""
        own = self.unit_owner.select("unit", F.col("name").alias("via"))
        rows = self.placed.where("placed = 'pair'").join(own, "unit").where("via <> src_claim")
        return rows.select(F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst"), "via").distinct()

    @cached_property
    def file_owners(self) -> DataFrame:
        return settle(self.facts.file_modules.join(self.owned.select(F.col("path").alias("module"), "name"), "module").select("path", "name"))

    @cached_property
    def evidence(self) -> DataFrame:
        """(src, dst, files): pairs of claims that file edges join."""
        own = self.file_owners
        pairs = self.facts.file_edges.select("src", "dst", F.col("src").alias("file")).join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst").where("a <> b")
        kin = owners.related(self.rules.lineage()).toDF("a", "b")
        pairs = pairs.join(F.broadcast(kin), ["a", "b"], "left_anti")
        return settle(census.evidence(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "file")))

    @cached_property
    def rings(self) -> DataFrame:
        return settle(cycles.claim_cycles(self.pairs))

    # checks --------------------------------------------------------------------

    def components(self) -> list[DataFrame]:
        named = self.rules.patterns("modules", "units").select("name").distinct()
        hit = self.scores.select("name").unionByName(self.unit_owner.select("name")).distinct()
        lost = owners.split_unmatched(self.mapped).join(self.mapping.where("name is null or reclaimed").select(F.col("unit").alias("value")), "value", "left_semi")
        # a pattern that addresses the unit itself is a claim on it
        direct = self.scores.select(F.col("path").alias("value")).distinct().withColumn("direct", F.lit(True))
        told = lost.join(direct, "value", "left").where("category <> 'unexpected component' or direct is null")
        twice = owners.ambiguous_owners(self.paths, self.rules.patterns("modules"))
        return [
            checks.finding(named.join(hit, "name", "left_anti"), "missing component", F.col("name")),
            told.select("category", F.lit("error").alias("severity"), F.col("value").alias("message"), F.lit(0).alias("entry")),
            checks.finding(twice, "ambiguous module match", F.concat("path", F.lit(" matches "), "name_a", F.lit(", "), "name_b")),
        ]

    def boundaries(self) -> list[DataFrame]:
        r, placed = self.rules, self.placed
        ends = placed.select(F.col("src_claim").alias("src"), F.col("dst_claim").alias("dst"), "placed")
        gated = ends.where("placed = 'gated' and src is not null and dst is not null").select("src", "dst").distinct()
        unowned = ends.where("placed = 'unowned' and src is not null").select("src", "dst")
        miss = checks.missing_edges(self.pairs, r.claims(), r.allowed(), r.lineage(), gated, unowned, self.evidence.select("src", "dst"))
        why = F.when(F.col("reason") == "", "").otherwise(F.concat(F.lit(" ("), "reason", F.lit(")")))
        bans = r.policies().where("list = 'forbidden'").select(F.col("name").alias("src"), F.col("target").alias("dst"))
        bans = bans.join(r.claims().select(F.col("name").alias("dst")), "dst", "left_semi")
        routed = graph.laundered(self.pairs, self.pairs.where("fallback"), bans)
        return [
            checks.edge_findings(self.verdicts),
            checks.finding(miss, "missing edge", F.concat(checks.arrow(), why)),
            checks.used_undeclared(self.evidence, self.pairs),
            checks.facade_dependencies(self.edges, self.facts.roles, self.facts.test_gated),
            checks.dead_references(r.allowed(), r.claims()),
            checks.finding(routed, "warning", F.concat(F.lit("laundered forbidden edge: "), checks.arrow(), F.lit(" via "), "via"), "warning"),
            checks.finding(owners.unowned_endpoints(placed), "warning", F.concat(F.lit("unowned: "), "path"), "warning"),
        ]

    def contracts(self) -> list[DataFrame]:
        shown = self.facts.shown.join(self.owned.select("path", F.col("name").alias("claim")), "path").select("claim", "symbol").distinct()
        up = self.rules.lineage().select(F.col("name").alias("claim"), "anc_name")
        forbid = self.spark.createDataFrame([(c.name, s) for c in self.spec.claims for s in c.forbid], "anc_name string, stereotype string")
        kinds = self.spark.createDataFrame([(s["name"], p) for s in self.spec.stereotypes for p in s["names"]], "stereotype string, pattern string")
        expose = self.spark.createDataFrame([(c.name, c.expose) for c in self.spec.claims if c.expose is not None], "anc_name string, patterns array<string>")
        hidden = checks.unexposed(shown, up.join(expose, "anc_name").select("claim", F.col("anc_name").alias("chain"), "patterns"))
        return [
            checks.contract_leaks(shown.withColumnRenamed("symbol", "name"), up.join(forbid, "anc_name").select("claim", "stereotype").distinct(), kinds),
            checks.finding(hidden, "contract leak", F.concat("claim", F.lit(" exposes "), "symbol", F.lit(" (not exposed)"))),
        ]

    @cached_property
    def found_rings(self) -> DataFrame:
        """Each no_cycles rule over its claims, scope and kinds; one advisory pass where there is none."""
        rows = [c for c in self.spec.constraints if c["type"] == "no_cycles"] or [{"severity": "warning"}]
        none = self.spark.createDataFrame([], "identity string, text string, tier string, severity string")
        found = [none]
        for row in rows:
            severity, kinds, listed = row.get("severity", "error"), row.get("kinds"), row.get("modules", [])
            group = self.spark.createDataFrame([(m,) for m in listed], "node string") if listed else None
            rings = settle(cycles.claim_cycles(self.pairs, group)) if listed else self.rings
            told = rings.where(F.col("kind").isin(*kinds)) if kinds else rings
            found.append(checks.tier_rings(rings, "module", severity, kinds))
            if row.get("scope", "both" if self.facts.language in BOTH_TIERS else "claims") != "both" or not self.facts.has("file_edges"):
                continue
            live = self.facts.file_edges
            if listed:
                inside = self.file_owners.join(self.rules.lineage().select("name", F.col("anc_name").alias("node")).join(group, "node"), "name").select("path").distinct()
                live = live.join(inside.toDF("src"), "src", "left_semi").join(inside.toDF("dst"), "dst", "left_semi")
            gated = self.facts.file_modules.join(owners.gated_paths(self.edges, self.facts.test_gated).withColumnRenamed("path", "module"), "module", "left_semi").select("path")
            of_files = settle(cycles.file_cycles(live, self.file_owners, self.rules.lineage(), told, gated))
            found.append(checks.tier_rings(of_files, "file", severity, kinds))
        return settle(_union(found))

    def ring_findings(self) -> list[DataFrame]:
        return [checks.cycle_findings(self.found_rings, self.rules.exempt(), self.today)]

    def debts(self) -> DataFrame:
        """(ring, tier) of the rings that no exemption covers."""
        return checks.debts(self.found_rings, self.rules.exempt(), self.today)

    def constraints(self) -> list[DataFrame]:
        out, f = [], self.facts
        for c in self.spec.constraints:
            kind, named = c["type"], c.get("from", [])
            if kind == "forbid_external_crates":
                rows = checks.forbidden_externals(f.externals, named, c.get("forbid", []))
            elif kind == "external_free":
                rows = checks.external_free(f.externals, named)
            elif kind == "public_api_allowlist":
                rows = checks.public_api(f.exports, c.get("allowed", []))
            elif kind == "forbid_submodule_dependency":
                rows = checks.submodule_dependencies(self.edges, c.get("parent", ""), named, c.get("forbid", []))
            elif kind == "manifest_integrity":
                rows = checks.manifest_integrity(f.manifests, c.get("require_publish"), c.get("forbidden_dependencies", []), c.get("required_features", []))
            elif kind == "feature_boundary":
                rows = checks.feature_boundary(f.module_decls, self.edges, c.get("feature", ""), c.get("gated_modules", []), c.get("allowed_from", []))
            else:
                continue
            if c.get("severity") == "warning":
                rows = rows.select(F.lit("warning").alias("category"), F.lit("warning").alias("severity"), F.concat("category", F.lit(": "), "message").alias("message"), "entry")
            out.append(rows)
        return out

    def domains(self) -> dict[int, tuple[str, DataFrame]]:
        """What each constraint looks at."""
        f, out = self.facts, {}
        for k, c in enumerate(self.spec.constraints, 1):
            kind, named = c["type"], c.get("from", [])
            if kind == "no_cycles":
                listed = c.get("modules", [])
                domain = self.pairs.where(F.col("src").isin(*listed) & F.col("dst").isin(*listed)) if listed else self.pairs
            elif kind in ("forbid_external_crates", "external_free"):
                modules = f.externals.select("module") if kind == "forbid_external_crates" else f.externals.select("module").unionByName(self.paths.select(F.col("path").alias("module")))
                domain = modules.where(checks._from(named))
            elif kind == "public_api_allowlist":
                domain = f.exports
            elif kind == "manifest_integrity":
                domain = f.manifests
            elif kind == "feature_boundary":
                domain = f.module_decls
            else:
                domain = self.edges.where(P.module_matches(F.lit(c.get("parent", "")), P.common_ancestor("src", "dst")))
            out[k] = (kind, domain)
        return out

    def engagement(self) -> list[DataFrame]:
        told = checks.engagement(self.scores, self.rules.claims(), self.rules.patterns("modules"))
        hit = self.unit_owner.select(F.col("name").alias("claim")).distinct()
        told = told.join(hit, "claim", "left_anti")  # a claim that names a unit is engaged
        text = F.when(F.col("by").isNull(), F.concat("kind", F.lit(": "), "claim")).otherwise(F.concat("kind", F.lit(": "), "claim", F.lit(" is fully claimed by "), "by"))
        empty = self.spark.createDataFrame(checks.vacuous(self.domains()), "n long, kind string")
        vacuous = F.concat(F.lit("vacuous constraint: [constraint #"), F.col("n").cast("string"), F.lit("] "), "kind", F.lit(": no fact to check"))
        return [checks.finding(told, "warning", text, "warning"), checks.finding(empty, "warning", vacuous, "warning", F.col("n"))]

    def asynchronous(self) -> list[DataFrame]:
        if not self.spec.async_depends:
            return []
        f, entries = self.facts, self.rules.async_depends()
        named = events.collisions(entries)
        numbers = entries.withColumn("name", P.simple_event("event")).groupBy("src", "dst", "name").agg(F.array_sort(F.collect_set("entry")).alias("n"))
        clash = named.join(numbers, ["src", "dst", "name"]).where("src <> dst")
        text = F.concat(F.lit("async event collision: "), checks.arrow(), F.lit(" declares "), F.size("events").cast("string"), F.lit(" events named "), "name", F.lit(" — "), F.array_join("events", ", "), F.lit(" (entries "), F.array_join(F.transform("n", lambda x: F.concat(F.lit("#"), x.cast("string"))), ", "), F.lit(")"))
        heard = f.declarers.groupBy("event").agg(F.collect_set("unit").alias("by"))
        legs = entries.join(heard, "event", "left").select("src", "dst", (F.col("by").isNull() | ((F.size("by") == 1) & F.array_contains("by", F.col("src")))).alias("publisher_only"))
        rings = cycles.async_rings(f.unit_edges, legs)
        parts = [
            checks.schema_drift(entries, f.records, f.bases, f.enums, f.bound, f.own_records),
            checks.finding(clash, "warning", text, "warning"),
            checks.finding(rings, "warning", F.concat(F.lit("async cycle: "), F.array_join("ring", " -> "), F.lit(" ("), "kind", F.lit(")")), "warning"),
        ]
        if f.has("async_edges"):
            claimed = self.facts.units.select(F.col("name").alias("unit"))
            parts.append(checks.async_findings(entries, f.async_edges, f.async_edges, f.async_edges, claimed))
        return parts

    def producers(self) -> list[DataFrame]:
        if not self.spec.canonical_producer and not self.spec.shared_constant:
            return []
        units = self.facts.units.select("name", F.col("path").alias("root"))
        spellings = units.select(F.col("name").alias("spelling"), F.col("name").alias("unit"), F.lit(0).alias("ord"))
        spelled = self.rules.producers().select(F.col("producer").alias("spelling"), F.lit(".").alias("producer_dir"))
        found = events.resolve_units(spelled, units, spellings)
        canon = found.join(units.select(F.col("name").alias("unit"), F.col("root").alias("canon")), "unit", "left").select("spelling", "unit", "canon")
        return [checks.producer_findings(self.rules.producers(), canon)]

    def notes(self) -> list[str]:
        """Rules that no fact of this language can engage; notes are no findings."""
        rows = capability.inert_rules(self.spark, self.facts.language, self.spec.constraints).orderBy("entry", "fact").collect()  # a row for each rule
        return [f"note: {r.kind} rule #{r.entry} inert for {self.facts.language}: no reader states {r.fact}" for r in rows]

    @cached_property
    def findings(self) -> DataFrame:
        """The findings of all checks, in canonical order, written once."""
        parts = [*self.components(), *self.boundaries(), *self.contracts(), *self.ring_findings(), *self.constraints(), *self.engagement(), *self.asynchronous(), *self.producers()]
        return settle(checks.findings(parts))

    def rows(self) -> list[tuple[str, str, str]]:
        return [(r.category, r.severity, r.message) for r in self.findings.orderBy("category_ord", "entry", "message").collect()]
