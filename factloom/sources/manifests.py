"""Manifests of the build tools as facts: units, publishing, dependencies, features, workspaces."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the manifests of each language state; see plans.capability.
FACTS = {lang: {"manifests"} for lang in ("rust", "csharp", "go", "ts", "python")}
_NAMES = ["path", "language", "unit", "publish", "deps", "features", "members", "error"]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
SCHEMA = "path string, language string, unit string, publish boolean, deps array<string>, features array<string>, members array<string>, error string"


def cargo(text: str) -> tuple:
    """(unit, publish, deps, features, members): run-time dependencies by their real names; a list of registries publishes."""
    doc = tomllib.loads(text)
    package, shared = doc.get("package", {}), doc.get("workspace", {}).get("dependencies", {})

    def real(name: str, value) -> str:
        if isinstance(value, dict) and value.get("workspace"):
            value = shared.get(name, {})
        return value.get("package", name) if isinstance(value, dict) else name

    publish = None if "publish" not in package else package["publish"] is not False
    return package.get("name"), publish, sorted({real(k, v) for k, v in doc.get("dependencies", {}).items()}), sorted(doc.get("features", {})), doc.get("workspace", {}).get("members", [])


def npm(text: str) -> tuple:
    doc = json.loads(text)
    spaces = doc.get("workspaces", [])
    members = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    return doc.get("name"), None, sorted(doc.get("dependencies", {})), [], list(members)


def pyproject(text: str) -> tuple:
    doc = tomllib.loads(text)
    project = doc.get("project", {})
    names = [re.match(r"\s*([A-Za-z0-9][\w.-]*)", d) for d in project.get("dependencies", [])]
    return project.get("name"), None, sorted({m.group(1) for m in names if m}), sorted(project.get("optional-dependencies", {})), []


def csproj(text: str, path: str) -> tuple:
    """Package references are dependencies, project references members; IsPackable says whether it is published."""
    root = ElementTree.fromstring(text)
    found: dict[str, list[str]] = {"PackageReference": [], "ProjectReference": []}
    publish = None
    for e in root.iter():
        tag = e.tag.rsplit("}", 1)[-1]
        if tag in found and e.get("Include"):
            found[tag].append(e.get("Include"))
        elif tag == "IsPackable" and (e.text or "").strip().lower() in ("true", "false"):
            publish = e.text.strip().lower() == "true"
    members = sorted({re.split(r"[\\/]", m)[-1].removesuffix(".csproj") for m in found["ProjectReference"]})
    return path.rsplit("/", 1)[-1].removesuffix(".csproj"), publish, sorted(set(found["PackageReference"])), [], members


def go_mod(text: str) -> tuple:
    module = re.search(r"(?m)^module\s+(\S+)", text)
    block = " ".join(re.findall(r"(?ms)^require\s*\((.*?)^\)", text)) + "\n" + "\n".join(re.findall(r"(?m)^require\s+(\S+\s+\S+)", text))
    return module and module.group(1), None, sorted(set(re.findall(r"([\w./-]+)\s+v\d", block))), [], []


def go_work(text: str) -> tuple:
    block = " ".join(re.findall(r"(?ms)^use\s*\((.*?)^\)", text)) + " " + " ".join(re.findall(r"(?m)^use\s+([^(\s]\S*)", text))
    return None, None, [], [], sorted({m.removeprefix("./") or "." for m in block.split()})


def gradle_settings(text: str) -> tuple:
    """Included projects as paths: ``include(":a:b")`` is a/b."""
    calls = re.findall(r"(?m)^\s*include\s*\(?([^)\n]*(?:\n[^)\n]*)*?)\)?\s*$", text)
    names = [n.strip(":").replace(":", "/") for call in calls for n in re.findall(r"[\"']([^\"']+)[\"']", call)]
    root = re.search(r"rootProject\.name\s*=\s*[\"']([^\"']+)", text)
    return root and root.group(1), None, [], [], sorted(set(names))


#: The reader of each manifest, by file name or ending, and its language.
READERS = {"Cargo.toml": ("rust", cargo), "package.json": ("ts", npm), "pyproject.toml": ("python", pyproject), ".csproj": ("csharp", csproj), "go.mod": ("go", go_mod), "go.work": ("go", go_work), "settings.gradle": ("kotlin", gradle_settings), "settings.gradle.kts": ("kotlin", gradle_settings)}


def facts_of(path: str, text: str) -> tuple | None:
    """One row for a manifest (with an error if it cannot be read), none for other files."""
    name = path.rsplit("/", 1)[-1]
    language, read = READERS.get(name) or READERS.get("." + name.rsplit(".", 1)[-1] if name.endswith(".csproj") else "", (None, None))
    if read is None:
        return None
    try:
        return (path, language, *(read(text, path) if read is csproj else read(text)), None)
    except (ValueError, ElementTree.ParseError, AttributeError, TypeError) as e:
        return (path, language, None, None, [], [], [], f"{type(e).__name__}: {e}")


def parse(files: DataFrame) -> DataFrame:
    """Manifest rows of (path, text), parsed by executors file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (r := facts_of(p, t or ""))]
            cols = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def units(found: DataFrame) -> DataFrame:
    """(name, kind, path, publish, deps, features, members): units of manifests that name one, path their directory (``.`` at the top)."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return found.where("unit is not null and error is null").select(F.col("unit").alias("name"), "language", F.element_at(F.split("path", "/"), -1).alias("kind"), F.when(folder == "", ".").otherwise(folder).alias("path"), "publish", "deps", "features", "members")


def unit_edges(units: DataFrame) -> DataFrame:
    """(src, dst): dependencies and project references that are units of the tree."""
    asked = units.select(F.col("name").alias("src"), F.explode(F.concat("deps", F.when(F.col("language") == "csharp", F.col("members")).otherwise(F.array().cast("array<string>")))).alias("dst"))
    return asked.join(units.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
