"""A source tree as one set of facts: files, language, units, and the language's reader.

Reading is by Spark; a file is parsed where it is read, and everything else is
joins on paths and names.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.owners import longest_prefix
from ..operators.state import settle
from ..plans.verify import FactSet
from . import manifests, python_source, text_sources, trees

#: Files that a scan reads.
PATTERN = "{" + ",".join([*(f"*.{x}" for x in trees.EXTENSIONS), "*.csproj", *(m for m in manifests.READERS if not m.startswith("."))]) + "}"
_NONE = "cast(array() as array<string>)"


class ScanFailed(RuntimeError):
    """A tree that cannot be read as it stands."""


def ignore_rules(root: str) -> list[tuple[str, int, str, bool]]:
    """(base, line, pattern, negated) of the tree's ignore files, which Spark's readers leave out as hidden."""
    out = []
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if d not in trees.SKIPPED]
        if ".gitignore" in names:
            base = os.path.relpath(folder, root).replace(os.sep, "/")
            for n, line in enumerate(Path(folder, ".gitignore").read_text(encoding="utf-8").splitlines()):
                text = line.rstrip()
                if text.strip() and not text.lstrip().startswith("#"):
                    out.append(("" if base == "." else base, n, text.removeprefix("!"), text.startswith("!")))
    return out


def kept_files(spark: SparkSession, root: str, excluded: DataFrame | None = None) -> DataFrame:
    """(path, text) of the tree's files, without mechanical, ignored and declared exclusions."""
    top = os.path.abspath(root)
    files = trees.skip_mechanical(settle(python_source.read_tree(spark, top, PATTERN)))
    rules = spark.createDataFrame(ignore_rules(top), "base string, line int, pattern string, negated boolean")
    gone = trees.ignored(files, rules)
    if excluded is not None:
        gone = gone.unionByName(trees.exclusions(files, excluded).select("path"))
    return settle(files.join(gone.distinct(), "path", "left_anti"))


def language_of_tree(files: DataFrame, asked: str | None) -> tuple[str, list[str]]:
    """(language, notices): the asked one, else the one of a marker at the top, else that of most files; what disagrees is told."""
    counts = {r.language: r.files for r in trees.language_counts(files).orderBy("rank").collect()}  # six rows at most
    top = files.where(~F.contains("path", F.lit("/"))).where(F.col("path").isin(*trees.MARKERS)).select("path").distinct().collect()
    marked = sorted({trees.MARKERS[r.path] for r in top}, key=trees.PRIORITY.index)
    language = asked or (marked[0] if marked else next(iter(counts), None))
    if language is None:
        raise ScanFailed("no source file of a known language")
    told = [f"language mismatch: {language} is asked for, the tree is marked as {', '.join(marked)}"] if asked and marked and asked not in marked else []
    told += [f"ambiguous markers: {', '.join(marked)}"] if len(marked) > 1 else []
    nested = files.where(F.contains("path", F.lit("/"))).select("path", F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").isin(*trees.MARKERS))
    told += [f"nested foreign marker: {r.path}" for r in nested.orderBy("path").collect() if trees.MARKERS[r.name] != language]  # a row for each manifest
    return language, told


def scan(spark: SparkSession, root: str, language: str | None = None, excluded: DataFrame | None = None) -> tuple[FactSet, list[str]]:
    """(facts, notices) of the tree under ``root``."""
    files = kept_files(spark, root, excluded)
    language, notices = language_of_tree(files, language)
    own = settle(files.where(trees.language_of("path") == language))
    found = settle(manifests.parse(files).where(F.col("language") == language))
    bad = found.where("error is not null").agg(F.min_by(F.concat("path", F.lit(": "), "error"), "path")).first()[0]
    if bad:
        raise ScanFailed(bad)
    units = manifests.units(found).drop("language")
    if language == "kotlin":  # a unit for each included project
        units = found.select(F.explode("members").alias("path")).select(F.replace("path", F.lit("/"), F.lit(":")).alias("name"), F.lit("gradle").alias("kind"), "path", F.lit(None).cast("boolean").alias("publish"), *(F.expr(_NONE).alias(c) for c in ("deps", "features", "members")))
    units = settle(units)
    if units.isEmpty():  # a tree without manifests: its top directories
        top = own.select(F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".").alias("path")).distinct()
        name = F.when(F.col("path") == ".", F.lit(os.path.basename(os.path.abspath(root)))).otherwise(F.col("path"))
        units = settle(top.select(name.alias("name"), F.lit("directory").alias("kind"), "path", F.lit(None).cast("boolean").alias("publish"), *(F.expr(_NONE).alias(c) for c in ("deps", "features", "members"))))
    placed = longest_prefix(own.select("path"), units.select("name", F.col("path").alias("root")))
    named = settle(own.select("path").join(placed, "path", "left").select("path", F.coalesce("name", F.lit("")).alias("unit"), F.coalesce("root", F.lit(".")).alias("root")))
    file_modules = settle(named.select("path", "unit", _module(language).alias("module")))
    edges, externals, seen = _edges(language, own, named, file_modules, units)
    edges, externals = settle(edges), settle(externals)
    told = trees.silent_scan(seen, edges.count() + externals.count())
    if told:
        raise ScanFailed(told)
    tables = {
        "units": units.select("name", "kind", "path"),
        "modules": file_modules.where("module <> ''").select("unit", F.col("module").alias("path")).distinct(),
        "externals": externals.join(file_modules, "path").select("module", "package").distinct(),
        "manifests": units.where("kind not in ('directory', 'gradle')").select("name", "publish", "deps", "features").toDF("unit", "publish", "deps", "features"),
        "file_modules": file_modules.select("path", "module"),
    }
    of = file_modules.select("path", "unit", "module")
    both = edges.join(of.toDF("src", "unit", "a"), "src").join(of.select(F.col("path").alias("dst"), F.col("module").alias("b"), F.col("unit").alias("unit_b")), "dst")
    tables["module_edges"] = both.where("a <> b").groupBy("unit", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"), F.bool_and("type_only").alias("type_only"))
    by_code = both.where("unit <> unit_b").select(F.col("unit").alias("src"), F.col("unit_b").alias("dst"))
    tables["unit_edges"] = by_code.unionByName(manifests.unit_edges(units.withColumn("language", F.lit(language)))).distinct()
    if language != "go":  # a Go package is no file
        tables["file_edges"] = both.where("src <> dst").select("unit", "src", "dst", F.lit("use").alias("kind"), "type_only").distinct()
    shown = _shown(language, own, file_modules)
    if shown is not None:
        tables["shown"] = shown
        tables["exports"] = shown.select(F.col("path").alias("owner"), "symbol", F.lit("resolved").alias("status")).distinct()
    if language == "rust":
        gates = settle(text_sources.rust_modules(own).join(file_modules, "path"))
        tables["module_decls"] = gates.where(F.rlike("path", F.lit("(^|/)src/(lib|main)[.]rs$"))).select("unit", "name", "feature", F.concat("name", F.lit(".rs")).alias("file"))
        tables["test_gated"] = gates.where("test").select(F.concat_ws("::", "module", "name").alias("path")).distinct()
    return FactSet(spark, language, {k: settle(v) for k, v in tables.items()}), notices


def _module(language: str) -> Column:
    """The module path of a file (path, unit, root)."""
    if language == "rust":
        return P.file_module("path", "unit", "root")
    inner = F.when(F.col("root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    if language == "go":
        folder = F.regexp_extract(inner, "^(.*)/[^/]*$", 1)
        return F.concat_ws("/", F.col("unit"), F.when(folder != "", folder))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/(__init__|index)$", ""), "^src/", "")
    return F.replace(stem, F.lit("/"), F.lit("::"))


def _edges(language: str, own: DataFrame, named: DataFrame, file_modules: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(src, dst, symbols, type_only) of files, (path, package) outside, and how many imports were seen."""
    plain = lambda df: df.withColumn("symbols", F.expr(_NONE)).select("src", "dst", "symbols", "type_only")
    if language == "python":
        facts = settle(python_source.parse(own))
        bad = facts.where("kind = 'error'").agg(F.min_by(F.concat("path", F.lit(": "), "target"), "path")).first()[0]
        if bad:
            raise ScanFailed(bad)
        edges, external = python_source.resolve(facts, own)
        return edges.select("src", "dst", "symbols", "type_only"), external, 0
    found = settle(text_sources.imports(own))
    value = F.lit(False).alias("type_only")
    if language == "ts":
        edges, external = text_sources.resolve_ts(found, own)
        members = units.select(F.col("name").alias("package"), F.col("path").alias("root"))
        entry = own.select("path").join(members, F.startswith("path", F.concat("root", F.lit("/")))) if not members.isEmpty() else None
        if entry is not None:  # a package of the tree is the first index of its directory
            index = entry.where(F.rlike("path", F.lit(r"/(src/)?index\.(ts|tsx|js)$"))).groupBy("package").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("dst"))
            inside = external.join(index, "package").select(F.col("path").alias("src"), "dst", value)
            edges, external = edges.unionByName(inside), external.join(units.select(F.col("name").alias("package")), "package", "left_anti")
        return plain(edges), external, found.count()
    if language in ("csharp", "kotlin"):
        edges, external = text_sources.resolve_names(found, text_sources.declared(own), language)
        return plain(edges.withColumn("type_only", value)), external, found.count()
    if language == "go":
        return *_go_edges(found, named, units), found.count()
    return *_rust_edges(found, named, file_modules, units), found.count()


def _go_edges(found: DataFrame, named: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports of packages of any module of the tree, by the first file of each package; others with a dot in front are outside."""
    packages = named.select("path", _module("go").alias("package")).groupBy("package").agg(F.min("path").alias("dst"))
    rows = found.select("path", "target").distinct()
    inside = rows.join(packages, F.col("target") == F.col("package"))
    edges = inside.select(F.col("path").alias("src"), "dst", F.expr(_NONE).alias("symbols"), F.lit(False).alias("type_only"))
    outside = rows.join(packages, F.col("target") == F.col("package"), "left_anti").where(F.contains(F.substring_index("target", "/", 1), F.lit(".")))
    return edges, outside.select("path", F.col("target").alias("package")).distinct()


def _rust_edges(found: DataFrame, named: DataFrame, file_modules: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths by ``crate``, ``self``, ``super`` or a crate of the tree to the longest prefix that is a module file; other roots are outside."""
    crates = units.select(P.crate_name("name").alias("root"), F.col("name").alias("of"))
    rows = found.select("path", "target").distinct().join(file_modules, "path")
    root, rest = F.substring_index("target", "::", 1), F.regexp_extract("target", "^[^:]*::(.*)$", 1)
    rows = rows.withColumn("root", root).withColumn("rest", rest).join(F.broadcast(crates), "root", "left")
    up = F.regexp_replace("module", "::[^:]*$", "")
    begin = F.when(F.col("root") == "crate", F.col("unit")).when(F.col("root") == "self", F.col("module")).when(F.col("root") == "super", up).otherwise(F.col("of"))
    rows = settle(rows.withColumn("begin", begin))
    spelled = rows.where("begin is not null").withColumn("full", F.concat_ws("::", "begin", F.when(F.col("rest") != "", F.col("rest"))))
    parts = F.split("full", "::")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))
    hit = spelled.select("path", "target", "full", F.posexplode(prefixes).alias("n", "module")).join(file_modules.select("module", F.col("path").alias("dst")), "module")
    best = hit.groupBy("path", "target", "full").agg(F.max_by(F.struct("dst", "module"), F.struct("n", "dst")).alias("b"))
    symbol = F.expr("substring(full, length(b.module) + 3)")
    edges = best.where("path <> b.dst").select(F.col("path").alias("src"), F.col("b.dst").alias("dst"), symbol.alias("s")).groupBy("src", "dst").agg(F.array_sort(F.filter(F.collect_set("s"), lambda x: x != "")).alias("symbols"))
    outside = rows.where("begin is null").where(~F.col("root").isin("std", "core", "alloc")).select("path", F.col("root").alias("package")).distinct()
    return edges.withColumn("type_only", F.lit(False)), outside


def _shown(language: str, own: DataFrame, file_modules: DataFrame) -> DataFrame | None:
    """(path, symbol): what modules declare for others, where the reader tells that from private names."""
    if language == "python":
        rows = python_source.parse(own).where("kind = 'export'").select("path", F.col("name").alias("symbol")).where(~F.startswith("symbol", F.lit("_")))
    elif language == "go":
        return None
    else:
        public = {"rust": r"(?m)^\s*pub\s+(?:async\s+|unsafe\s+|const\s+)*(?:struct|enum|fn|trait|type|union)\s+(\w+)", "csharp": r"(?m)\bpublic\s+(?:[a-z]+\s+)*(?:class|interface|struct|enum|record)\s+(\w+)", "ts": r"(?m)^\s*export\s+(?:default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?:class|interface|function|const|let|enum|type)\s+(\w+)", "kotlin": r"(?m)^(?!\s*(?:private|internal)\b)\s*(?:[a-z]+\s+)*(?:class|interface|object|fun)\s+(\w+)"}[language]
        rows = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(public), 1)).alias("symbol"))
    return rows.join(file_modules.select("path", "module"), "path").select(F.col("module").alias("path"), "symbol").distinct()
