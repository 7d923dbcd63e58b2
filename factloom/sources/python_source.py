"""Python trees as facts, read by Spark and parsed with ``ast``.

Files are read as a table of (path, text), parsed by executors file by file, and
resolved by joins: own module, standard library, else external.  A file that
cannot be parsed is an error row; the first by path is the one that counts.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What this reader states; see plans.capability.
FACTS = {"file edges", "module edges", "type-only marks", "externals", "exports", "literal sites"}
_SCHEMA = "path string, kind string, target string, name string, position int, value string, type_only boolean"
_NAMES = ["path", "kind", "target", "name", "position", "value", "type_only"]


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, text) of the files under ``root``, path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    return files.select(F.expr("substring(path, instr(path, '%s') + %d)" % (base.replace("'", "\\'"), len(base))).alias("path"), F.decode("content", "UTF-8").alias("text"))


def package_of(path: str) -> str:
    stem = path[:-3] if path.endswith(".py") else path
    return (stem[:-9] if stem.endswith("/__init__") else stem).replace("/", ".")


def facts_of(path: str, text: str) -> list[tuple]:
    """Imports, exports and literal candidates of one file; one error row if it does not parse."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [(path, "error", str(e), None, None, None, False)]
    out = []
    guarded = {id(n) for i in ast.walk(module) if isinstance(i, ast.If) and ast.unparse(i.test).endswith("TYPE_CHECKING") for s in i.body for n in ast.walk(s)}
    parts = package_of(path).split(".")
    here = parts if path.endswith("__init__.py") else parts[:-1]
    for node in ast.walk(module):
        lazy = id(node) in guarded
        if isinstance(node, ast.Import):
            out += [(path, "import", a.name, None, None, None, lazy) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = here[: len(here) - node.level + 1] if node.level else []
            target = ".".join([*base, *([node.module] if node.module else [])])
            out += [(path, "import", target, a.name, None, None, lazy) for a in node.names]
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
            if name in ("import_module", "__import__") and not (node.args and isinstance(node.args[0], ast.Constant)):
                out.append((path, "dynamic", None, name, None, None, False))
            out += [(path, "call", None, name, k, a.value, False) for k, a in enumerate(node.args) if name and isinstance(a, ast.Constant) and isinstance(a.value, str)]
    for node in module.body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((path, "export", None, node.name, None, None, False))
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            out += [(path, "property", None, t.id, None, node.value.value, False) for t in node.targets if isinstance(t, ast.Name)]
    return out


def parse(files: DataFrame) -> DataFrame:
    """Facts of each file of (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = [f for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in facts_of(p, t or "")]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)

    return files.select("path", "text").mapInArrow(run, _SCHEMA)


def resolve(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file edges, externals): imports resolved to own files, else by package outside the standard library.

    ``from a import b`` is the module a.b where that is a file, else a.
    """
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    own = files.select(F.col("path").alias("file"), module.alias("module")).distinct()
    imports = facts.where("kind = 'import'").select("path", "target", "name", "type_only").distinct()
    deep = F.when(F.col("name").isNotNull(), F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "name"))
    out = imports.withColumn("deep", deep).join(own.toDF("_f1", "_m1"), F.col("deep") == F.col("_m1"), "left").join(own.toDF("_f2", "_m2"), F.col("target") == F.col("_m2"), "left")
    out = out.withColumn("dst", F.coalesce("_f1", "_f2"))
    edges = out.where("dst is not null and dst <> path").groupBy(F.col("path").alias("src"), "dst").agg(F.bool_and("type_only").alias("type_only"), F.array_sort(F.collect_set("name")).alias("symbols"))
    package = F.substring_index("target", ".", 1)
    external = out.where("dst is null").select("path", package.alias("package")).where(F.col("package") != "").where(~F.col("package").isin(*sorted(sys.stdlib_module_names))).distinct()
    return edges, external
