"""Models as JSON: what a scan of any language wrote comes in as fact tables, and goes out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """schema_version int, language string,
units array<struct<name: string, kind: string, path: string>>,
edges array<struct<from: string, to: string>>,
soft_structure map<string, array<string>>,
external array<string>,
module_edges array<struct<unit: string, from: string, to: string, symbols: array<string>, type_only: boolean>>,
file_edges array<struct<unit: string, from: string, to: string, kind: string, type_only: boolean>>,
file_modules map<string, string>,
async_edges array<struct<from: string, to: string, event: string, kind: string>>,
module_external map<string, array<string>>,
root_public_exports map<string, array<string>>,
module_public_types map<string, array<string>>,
manifests map<string, struct<publish: boolean, dependencies: array<string>, features: array<string>>>,
module_declarations map<string, array<struct<name: string, gated: boolean, feature: string, file: string>>>,
test_gated array<string>,
literal_sites array<struct<unit: string, path: string, language: string, value: string, anchor: string, pattern: string>>,
roles map<string, string>"""


class ModelFacts:
    """The fact tables of models that lie as JSON files under a path; missing keys are empty tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.model = spark.read.schema(SCHEMA).json(path, multiLine=True)

    def _rows(self, column: str, *fields: str) -> DataFrame:
        return self.model.select(F.explode(column).alias("r")).select(*(F.col(f"r.{f}") for f in fields))

    def units(self) -> DataFrame:
        return self._rows("units", "name", "kind", "path")

    def unit_edges(self) -> DataFrame:
        return self._rows("edges", "from", "to").toDF("src", "dst")

    def module_edges(self) -> DataFrame:
        rows = self._rows("module_edges", "unit", "from", "to", "symbols", "type_only").toDF("unit", "src", "dst", "symbols", "type_only")
        return rows.withColumn("type_only", F.coalesce("type_only", F.lit(False)))

    def file_edges(self) -> DataFrame:
        rows = self._rows("file_edges", "unit", "from", "to", "kind", "type_only").toDF("unit", "src", "dst", "kind", "type_only")
        return rows.withColumn("type_only", F.coalesce("type_only", F.lit(False)))

    def file_modules(self) -> DataFrame:
        return self.model.select(F.explode("file_modules").alias("path", "module"))

    def shown(self) -> DataFrame:
        return self.model.select(F.explode("module_public_types").alias("path", "symbols")).select("path", F.explode("symbols").alias("symbol"))

    def manifests(self) -> DataFrame:
        rows = self.model.select(F.explode("manifests").alias("unit", "m"))
        none = F.array().cast("array<string>")
        return rows.select("unit", F.col("m.publish").alias("publish"), F.coalesce("m.dependencies", none).alias("deps"), F.coalesce("m.features", none).alias("features"))

    def module_decls(self) -> DataFrame:
        return self.model.select(F.explode("module_declarations").alias("unit", "rows")).select("unit", F.explode("rows").alias("r")).select("unit", "r.name", "r.feature", "r.file")

    def test_gated(self) -> DataFrame:
        return self.model.select(F.explode("test_gated").alias("path"))

    def literal_sites(self) -> DataFrame:
        return self._rows("literal_sites", "unit", "path", "language", "value", "anchor", "pattern")

    def fact_set(self):
        """All tables as one set; what the model does not state is not there, so that rules on it are told of as vacuous."""
        from ..plans.verify import FactSet

        keys = {
            "units": "units", "unit_edges": "edges", "modules": "soft_structure", "module_edges": "module_edges", "file_edges": "file_edges", "file_modules": "file_modules", "externals": "module_external",
            "roles": "roles", "exports": "root_public_exports", "shown": "module_public_types", "manifests": "manifests", "module_decls": "module_declarations", "test_gated": "test_gated", "async_edges": "async_edges",
        }
        first = self.model.select("language", *(F.col(c).isNotNull().alias(c) for c in set(keys.values()))).first()
        made = {"externals": self.module_external}
        return FactSet(self.model.sparkSession, first["language"] or "rust", {t: made.get(t, getattr(self, t, None))() for t, c in keys.items() if first[c]})

    def async_edges(self) -> DataFrame:
        return self._rows("async_edges", "from", "to", "event", "kind").toDF("src", "dst", "event", "kind")

    def modules(self) -> DataFrame:
        return self.model.select(F.explode("soft_structure").alias("unit", "paths")).select("unit", F.explode("paths").alias("path"))

    def module_external(self) -> DataFrame:
        return self.model.select(F.explode("module_external").alias("module", "packages")).select("module", F.explode("packages").alias("package"))

    def exports(self) -> DataFrame:
        return self.model.select(F.explode("root_public_exports").alias("owner", "symbols")).select("owner", F.explode("symbols").alias("symbol"), F.lit("resolved").alias("status"))

    def roles(self) -> DataFrame:
        return self.model.select(F.explode("roles").alias("path", "role"))


def model_of(facts) -> dict:
    """K1: the canonical model of a FactSet: its keys in order, its rows and lists sorted, tables that are not there left out.

    The whole model is one document, which the driver holds.
    """

    def rows(name: str, columns: list[str], names: list[str]) -> list[dict]:
        return [dict(zip(names, r)) for r in sorted((tuple(x) for x in getattr(facts, name).select(*columns).collect()), key=repr)]

    def lists(name: str, key: str, value: str) -> dict[str, list[str]]:
        out: dict[str, set] = {}
        for r in getattr(facts, name).select(key, value).collect():
            out.setdefault(r[0], set()).add(r[1])
        return {k: sorted(v) for k, v in sorted(out.items())}

    model: dict = {"schema_version": 1, "language": facts.language}
    made = {
        "units": ("units", lambda: rows("units", ["name", "kind", "path"], ["name", "kind", "path"])),
        "edges": ("unit_edges", lambda: rows("unit_edges", ["src", "dst"], ["from", "to"])),
        "soft_structure": ("modules", lambda: lists("modules", "unit", "path")),
        "module_edges": ("module_edges", lambda: rows("module_edges", ["unit", "src", "dst", "symbols", "type_only"], ["unit", "from", "to", "symbols", "type_only"])),
        "file_edges": ("file_edges", lambda: rows("file_edges", ["unit", "src", "dst", "kind", "type_only"], ["unit", "from", "to", "kind", "type_only"])),
        "file_modules": ("file_modules", lambda: dict(sorted((r.path, r.module) for r in facts.file_modules.collect()))),
        "async_edges": ("async_edges", lambda: rows("async_edges", ["src", "dst", "event", "kind"], ["from", "to", "event", "kind"])),
        "module_external": ("externals", lambda: lists("externals", "module", "package")),
        "root_public_exports": ("exports", lambda: lists("exports", "owner", "symbol")),
        "module_public_types": ("shown", lambda: lists("shown", "path", "symbol")),
        "manifests": ("manifests", lambda: {r.unit: {"publish": r.publish, "dependencies": sorted(r.deps), "features": sorted(r.features)} for r in sorted(facts.manifests.collect(), key=lambda r: r.unit)}),
        "module_declarations": ("module_decls", lambda: _declarations(facts.module_decls.collect())),
        "test_gated": ("test_gated", lambda: sorted(r.path for r in facts.test_gated.select("path").distinct().collect())),
        "roles": ("roles", lambda: dict(sorted((r.path, r.role) for r in facts.roles.collect()))),
    }
    for key, (name, build) in made.items():
        if facts.has(name):
            model[key] = build()
    if facts.has("externals"):
        model["external"] = sorted({p for ps in model["module_external"].values() for p in ps})
    return model


def _declarations(rows) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r.unit, r.name, r.file)):
        out.setdefault(r.unit, []).append({"name": r.name, "gated": r.feature is not None, "feature": r.feature, "file": r.file})
    return out
