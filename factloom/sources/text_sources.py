"""Readers of Rust, C#, Go, TypeScript and Kotlin trees by their import lines.

No grammar of these languages is at hand, so that these readers see what import,
package and declaration lines say and nothing else; S20 takes in the facts of a
full scan.  Lines are found by built-in regular expressions, the nested lists of
Rust are spelled out by executors file by file, and resolution is by joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees

#: What these readers state of each language; see plans.capability.
FACTS = {
    "rust": {"file edges", "module edges", "externals", "exports", "module gates", "test gates"},
    "csharp": {"file edges", "module edges", "externals", "exports"},
    "go": {"module edges", "externals"},
    "ts": {"file edges", "module edges", "type-only marks", "externals", "exports"},
    "kotlin": {"file edges", "module edges", "externals", "exports"},
}
#: An import line and its target, by language; Rust's are read by rust_uses. Fixed values.
IMPORTS = {
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;",
    "go": r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\s]+)\"\s*$",
    "ts": r"(?m)(?:^|[;\s])(?:import|export)\b[^'\"\n;]*?['\"]([^'\"\n]+)['\"]|\b(?:import|require)\(\s*['\"]([^'\"\n]+)['\"]",
    "kotlin": r"(?m)^\s*import\s+([A-Za-z_][\w.]*)",
}
#: What a file says that it is.
PACKAGE = {"csharp": r"(?m)^\s*namespace\s+([\w.]+)", "kotlin": r"(?m)^\s*package\s+([\w.]+)", "go": r"(?m)^package\s+(\w+)"}
DECLARED = r"(?m)^\s*(?:public\s+|internal\s+|export\s+|pub\s+|data\s+|sealed\s+|abstract\s+)*(?:class|interface|struct|enum|object|record|fn|func|fun|function|trait)\s+([A-Za-z_]\w*)"


def imports(files: DataFrame) -> DataFrame:
    """(path, language, target, type_only) of the import lines of (path, text)."""
    every = files.withColumn("language", trees.language_of("path"))
    known = every.where(F.col("language").isin(*IMPORTS))

    def of(language: str) -> Column:
        both = [F.regexp_extract_all("text", F.lit(IMPORTS[language]), g) for g in ((1, 2) if language == "ts" else (1,))]
        return F.array_distinct(F.filter(F.concat(*both), lambda x: x != ""))

    targets = F.when(F.lit(False), F.array().cast("array<string>"))
    for language in IMPORTS:
        targets = targets.when(F.col("language") == language, of(language))
    rows = known.select("path", "language", "text", F.explode(targets).alias("target"))
    marked = (F.col("language") == "ts") & F.rlike("text", F.concat(F.lit(r"(?m)import\s+type\b[^'\"\n;]*['\"]\Q"), "target", F.lit("\\E['\"]")))
    rust = every.where("language = 'rust'").select("path", "text").mapInArrow(_rust_targets, "path string, language string, target string, type_only boolean")
    return rows.select("path", "language", "target", marked.alias("type_only")).unionByName(rust)


def rust_uses(text: str) -> list[str]:
    """The paths that use declarations name, lists and renames spelled out: ``a::{b, c::{self, d as e}}`` is a::b, a::c, a::c::d."""
    out: dict[str, None] = {}

    def spell(prefix: str, body: str) -> None:
        depth, start, parts = 0, 0, []
        for k, ch in enumerate(body):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and not depth:
                parts.append(body[start:k])
                start = k + 1
        for part in [*parts, body[start:]]:
            part = part.strip()
            head, brace, rest = part.partition("{")
            if brace:
                spell(prefix + head.strip(), rest.rstrip()[:-1])
            elif part:
                name = re.sub(r"\s+as\s+\w+$", "", part).strip()
                path = prefix.removesuffix("::") if name in ("self", "*") and prefix else prefix + name.removesuffix("::*")
                out[path.removeprefix("::").replace("r#", "")] = None

    plain = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    for body in re.findall(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain):
        spell("", " ".join(body.split()))
    return [p for p in out if re.fullmatch(r"[A-Za-z_]\w*(::[A-Za-z_]\w*)*", p)]


def _rust_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, "rust", t, False) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in rust_uses(text or "")]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), pa.string(), pa.bool_()])], names=["path", "language", "target", "type_only"])


def rust_modules(files: DataFrame) -> DataFrame:
    """(path, name, feature, test): mod declarations of Rust files with the gate in front of them, if any."""
    rx = r"(?m)^[ \t]*((?:#\[[^\n]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*[;{]"
    rust = files.where(trees.language_of("path") == "rust")
    pairs = rust.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), 1).alias("g"), F.regexp_extract_all("text", F.lit(rx), 2).alias("n"))).alias("x"))
    feature = F.regexp_extract("x.g", r"cfg\(\s*feature\s*=\s*\"([^\"]+)\"", 1)
    return pairs.select("path", F.col("x.n").alias("name"), F.when(feature != "", feature).alias("feature"), F.rlike("x.g", F.lit(r"cfg\(\s*test\s*\)")).alias("test"))


def declared(files: DataFrame) -> DataFrame:
    """(path, language, package, name): what files declare."""
    language = trees.language_of("path")
    package = F.when(F.lit(False), "")
    for lang, rx in PACKAGE.items():
        package = package.when(F.col("language") == lang, F.regexp_extract("text", rx, 1))
    known = files.withColumn("language", language).where("language is not null")
    return known.select("path", "language", package.alias("package"), F.explode_outer(F.regexp_extract_all("text", F.lit(DECLARED), 1)).alias("name"))


def resolve_ts(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, externals): relative specifiers to the first candidate file, bare ones to their package."""
    ts = found.where("language = 'ts'")
    relative = ts.where(F.startswith("target", F.lit("."))).select(F.col("path").alias("src"), F.col("target").alias("specifier"), "type_only")
    edges = trees.candidates(relative, files).where("resolved is not null").join(relative, ["src", "specifier"]).groupBy("src", F.col("resolved").alias("dst")).agg(F.bool_and("type_only").alias("type_only"))
    scoped = F.when(F.startswith("target", F.lit("@")), F.substring_index("target", "/", 2)).otherwise(F.substring_index("target", "/", 1))
    return edges, ts.where(~F.startswith("target", F.lit("."))).select("path", scoped.alias("package")).distinct()


def resolve_names(found: DataFrame, names: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(edges, externals): dotted imports to the files of ``package.name``, or of the longest package that holds them."""
    own = names.where(F.col("language") == language).select(F.col("path").alias("dst"), "package", F.concat_ws(".", "package", "name").alias("full"))
    rows = found.where(F.col("language") == language).select("path", "target").distinct()
    parts = F.split("target", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    exact = rows.join(own.select("dst", F.col("full").alias("target")), "target").select("path", "target", "dst")
    rest = rows.join(exact.select("path", "target").distinct(), ["path", "target"], "left_anti")
    spelled = rest.select("path", "target", F.posexplode(up).alias("n", "package")).join(own.select("dst", "package").distinct(), "package")
    deepest = spelled.groupBy("path", "target").agg(F.max("n").alias("n"))
    loose = spelled.join(deepest, ["path", "target", "n"]).select("path", "target", "dst")
    hit = exact.unionByName(loose)
    outside = rows.join(hit.select("path", "target").distinct(), ["path", "target"], "left_anti")
    edges = hit.where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()
    return edges, outside.select("path", F.substring_index("target", ".", 1).alias("package")).distinct()


def resolve_go(found: DataFrame, files: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """(package edges, externals): imports below the module's path, and third-party ones; the standard library has no dot in front."""
    here = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = found.where("language = 'go'").select(here.alias("src"), "path", "target").distinct()
    inside = F.startswith("target", F.lit(module + "/"))
    dirs = files.select(here.alias("dst")).distinct()
    edges = rows.where(inside).withColumn("dst", F.expr(f"substring(target, {len(module) + 2})")).join(dirs, "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
    third = rows.where(~inside & F.contains(F.substring_index("target", "/", 1), F.lit("."))).select("path", F.col("target").alias("package")).distinct()
    return edges, third


def resolve_rust(found: DataFrame, files: DataFrame, crate: str) -> tuple[DataFrame, DataFrame]:
    """(file edges, externals): ``crate::`` paths to the longest prefix that is a module file, other roots to crates."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^(.*/)?src/", ""), r"\.rs$", ""), r"/mod$", "")
    own = files.select(F.col("path").alias("dst"), stem.alias("stem")).where("dst like '%.rs'")
    rows = found.where("language = 'rust'").select("path", "target").distinct()
    local = F.regexp_extract("target", rf"^(?:crate|{crate})::(.*)$", 1)
    inside = rows.withColumn("local", local).where("local <> ''")
    parts = F.split("local", "::")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spelled = inside.select("path", "target", F.posexplode(up).alias("n", "stem")).join(own, "stem")
    edges = spelled.groupBy("path", "target").agg(F.max_by("dst", "n").alias("dst")).where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()
    root = F.substring_index("target", "::", 1)
    return edges, rows.where(~root.isin("crate", crate, "self", "super", "std", "core", "alloc")).select("path", root.alias("package")).distinct()
