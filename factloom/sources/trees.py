"""Facts of source trees: exclusions, ignore files, languages, candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

#: Language by file extension, marker files, and the priority of a tie. Fixed values.
EXTENSIONS = {"rs": "rust", "cs": "csharp", "go": "go", "ts": "ts", "tsx": "ts", "js": "ts", "svelte": "ts", "py": "python", "kt": "kotlin"}
MARKERS = {"Cargo.toml": "rust", "go.mod": "go", "package.json": "ts", "pyproject.toml": "python", "settings.gradle.kts": "kotlin"}
PRIORITY = ["rust", "csharp", "go", "ts", "python", "kotlin"]
#: Directories that no tree counts. Fixed values.
SKIPPED = ["node_modules", "target", "bin", "obj", ".git", "dist", "build", "__pycache__", ".venv", "vendor"]
#: Extensions of source files in the order of probing, and of assets that are named whole. Fixed values.
TS_SOURCES = ["ts", "tsx", "js", "jsx", "svelte", "mjs", "cjs", "mts", "cts"]
TS_ASSETS = "css scss sass less styl svg png jpg jpeg gif webp avif woff woff2 ttf eot mp3 mp4 webm wav ogg json txt wasm".split()
#: What else an import of a JavaScript name may mean, after the name itself. Fixed values.
TS_INSTEAD = {"js": ["ts", "tsx", "d.ts"], "mjs": ["mts"], "cjs": ["cts"]}


def parents(path: Column | str) -> Column:
    """All directories above a path, and the path itself, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def exclusions(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, entry, mode): the most specific declared entry that holds each file.

    Exploded parents make the prefix join an equi-join; the deepest entry wins.
    """
    up = files.select("path").distinct().select("path", F.posexplode(parents("path")).alias("depth", "entry"))
    hit = up.join(F.broadcast(entries.select("entry", "mode").distinct()), "entry")
    return hit.groupBy("path").agg(F.max_by(F.struct("entry", "mode"), "depth").alias("e")).select("path", "e.entry", "e.mode")


def dead_exclusions(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry): declared entries that hold no file."""
    up = files.select(F.explode(parents("path")).alias("entry")).distinct()
    return entries.select("entry").distinct().join(up, "entry", "left_anti")


def skip_mechanical(files: DataFrame) -> DataFrame:
    """Files outside the directories that no tree counts."""
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def language_of(path: Column | str) -> Column:
    extension = F.substring_index(path, ".", -1)
    return F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))))[extension]


def language_counts(files: DataFrame) -> DataFrame:
    """(language, files, rank): the languages of a tree, the most frequent first, ties by priority."""
    counted = files.select(language_of("path").alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("language"))
    return counted.select("language", "files", F.row_number().over(Window.orderBy(F.desc("files"), place)).cast("long").alias("rank"))  # six rows at most


def mixed_directories(files: DataFrame) -> DataFrame:
    """(dir, languages): directories with files of more than one language."""
    of = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), language_of("path").alias("language")).where("language is not null")
    return of.groupBy("dir").agg(F.array_sort(F.collect_set("language")).alias("languages")).where(F.size("languages") > 1)


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path): files that ignore rules exclude.

    ``rules`` has base (the directory of the ignore file, '' at the top), line,
    pattern and negated.  On each directory above a file and on the file, the
    rule of the deepest ignore file decides, then the later line; an excluded
    directory excludes all below, whatever comes later.
    """
    up = files.select("path").distinct().select("path", F.posexplode(parents("path")).alias("n", "at"))
    above = F.concat(F.array(F.lit("")), F.slice(parents("at"), 1, F.size(parents("at")) - 1))
    local = F.when(F.col("base") == "", F.col("at")).otherwise(F.expr("substring(at, length(base) + 2)"))
    anchored = F.contains(F.rtrim("pattern", F.lit("/")), F.lit("/"))
    body = F.trim("pattern", F.lit("/"))
    # a star stays within a segment, two stars do not
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"([.+(){}\[\]^$|])", r"\\$1"), r"\*\*/?", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    rx = F.concat(F.lit("^"), F.regexp_replace(rx, r"\?", "[^/]"), F.lit("$"))
    subject = F.when(anchored, local).otherwise(F.substring_index("at", "/", -1))
    is_dir = F.col("at") != F.col("path")
    only_dir = F.endswith("pattern", F.lit("/"))
    # rules meet the places below them by directory; there are as many as the tree has ignore files
    hit = up.select("path", "n", "at", F.explode(above).alias("base")).join(rules, "base").where(F.rlike(subject, rx) & (~only_dir | is_dir))
    depth = F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/")))
    verdict = hit.groupBy("path", "n").agg(F.max_by("negated", F.struct(depth.alias("d"), "line")).alias("negated"))
    return verdict.where("not negated").select("path").distinct()


def probes(base: Column) -> Column:
    """The paths that an import of ``base`` may mean, in order: itself where its extension is known, what a JavaScript name stands for, with each source extension, as a directory's index."""
    ending = F.lower(F.regexp_extract(base, r"[^/]\.([^./]+)$", 1))
    stem = F.regexp_replace(base, r"\.[^./]+$", "")
    none = F.array().cast("array<string>")
    whole = F.when(ending.isin(*TS_SOURCES, *TS_ASSETS), F.array(base)).otherwise(none)
    instead = none
    for js, others in TS_INSTEAD.items():
        instead = F.when(ending == js, F.array(*(F.concat(stem, F.lit("." + o)) for o in others))).otherwise(instead)
    inferred = [F.concat(base, F.lit("." + x)) for x in TS_SOURCES] + [F.concat(base, F.lit("/index." + x)) for x in TS_SOURCES]
    return F.concat(whole, instead, F.array(*inferred))


def candidates(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """(src, specifier, resolved): relative imports and the first candidate that exists, null where none does."""
    joined = P.canonical_dir(F.concat(F.regexp_extract("src", "^(.*)/", 1), F.lit("/"), F.col("specifier")))
    base = specifiers.select("src", "specifier").distinct().withColumn("base", joined)
    ranked = base.select("src", "specifier", F.posexplode(probes(F.col("base"))).alias("rank", "path")).join(files.select("path").distinct(), "path", "left_semi")
    first = ranked.groupBy("src", "specifier").agg(F.min_by("path", "rank").alias("resolved"))
    return base.select("src", "specifier").join(first, ["src", "specifier"], "left")


def file_map(edges: DataFrame) -> DataFrame:
    """(src, dst) of a file-level import map."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def silent_scan(n_imports: int, n_facts: int) -> str | None:
    """What a scan says that saw imports and made no fact of them."""
    return f"{n_imports} imports were seen and no fact was made of them" if n_imports and not n_facts else None
