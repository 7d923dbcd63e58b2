"""Column functions on paths.

Module paths are ``unit::a::b``; file paths use ``/``.  All functions stay in
the JVM and return null for null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "::"
#: Score of a pattern that equals the whole path.
EXACT = 2_147_483_647


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def glob_regex(pattern: Column | str) -> Column:
    """The regular expression of a glob: ``*`` and ``**`` are any run, all else is literal."""
    quoted = F.regexp_replace(_col(pattern), r"\\E", r"\\\\E\\\\\\\\E\\\\Q")
    return F.concat(F.lit("(?s)\\A\\Q"), F.regexp_replace(quoted, r"\*+", r"\\E.*\\Q"), F.lit("\\E\\z"))


def glob_match(value: Column | str, pattern: Column | str) -> Column:
    """Whether the whole value matches the glob."""
    return F.rlike(_col(value), glob_regex(pattern))


def segments(path: Column | str) -> Column:
    return F.split(_col(path), SEP, -1)


def bare(path: Column | str) -> Column:
    """The last segment."""
    return F.element_at(segments(path), -1)


def strip_unit(path: Column | str) -> Column:
    """The path without its first segment; a path of one segment as it is."""
    p = _col(path)
    at = F.instr(p, SEP)
    return F.when(at > 0, F.substring(p, at + 2, F.length(p))).otherwise(p)


def lineage(path: Column | str) -> Column:
    """The path and all its ancestors, the longest last."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), SEP))


def ancestors(path: Column | str) -> Column:
    """The proper ancestors."""
    line = lineage(path)
    return F.slice(line, 1, F.size(line) - 1)


def address_forms(path: Column | str) -> Column:
    """Array of (form, off): the spellings under which patterns may address a path.

    off is what a spelling lost in front, so that char_length(form) + off is the
    length of the ancestor that it spells.
    """

    def both(q: Column) -> Column:
        short = strip_unit(q)
        whole = F.struct(q.alias("form"), F.lit(0).alias("off"))
        cut = F.struct(short.alias("form"), (F.char_length(q) - F.char_length(short)).alias("off"))
        return F.when(short == q, F.array(whole)).otherwise(F.array(whole, cut))

    return F.flatten(F.transform(lineage(path), both))


def module_matches(pattern: Column | str, path: Column | str) -> Column:
    """The glob matches the full path or its last segment."""
    return glob_match(path, pattern) | glob_match(bare(path), pattern)


def module_path_matches(pattern: Column | str, path: Column | str) -> Column:
    """The glob matches an address form of the path, or a form's last segment."""
    rx = glob_regex(pattern)
    return F.exists(address_forms(path), lambda f: F.rlike(f["form"], rx) | F.rlike(bare(f["form"]), rx))


def module_listed(pattern: Column | str, path: Column | str) -> Column:
    """The glob matches the path or an ancestor, or its last segment; units stay on."""
    rx = glob_regex(pattern)
    return F.exists(lineage(path), lambda q: F.rlike(q, rx) | F.rlike(bare(q), rx))


def specificity(pattern: Column | str, path: Column | str) -> Column:
    """P5: characters that the pattern pins in the path; EXACT if it equals it; null if it does not match."""
    pat, p = _col(pattern), _col(path)
    stars = F.char_length(pat) - F.char_length(F.replace(pat, F.lit("*"), F.lit("")))
    literal = F.regexp_replace(pat, r"\*+$", "")
    trailing = (stars > 0) & ~F.contains(literal, F.lit("*"))
    rx = glob_regex(pat)

    def score(f: Column) -> Column:
        whole = F.char_length(f["form"]) + f["off"]
        by_prefix = F.when(F.startswith(f["form"], literal), F.char_length(literal) + f["off"]).when(F.startswith(bare(f["form"]), literal), whole)
        by_glob = F.when(F.rlike(f["form"], rx) | F.rlike(bare(f["form"]), rx), whole)
        return F.when(trailing, by_prefix).otherwise(by_glob)

    return F.when(pat == p, F.lit(EXACT)).otherwise(F.array_max(F.transform(address_forms(p), score)))


def common_ancestor(a: Column | str, b: Column | str) -> Column:
    """The longest path that is the same as, or an ancestor of, both; '' if there is none."""
    shared = F.array_intersect(lineage(a), lineage(b))
    return F.when(F.size(shared) > 0, F.element_at(shared, -1)).otherwise("")


def rel_after(base: Column | str, path: Column | str) -> Column:
    """What follows ``base`` in ``path``; null where base is no ancestor of it."""
    p, b = _col(path), F.concat(_col(base), F.lit(SEP))
    return F.when(F.startswith(p, b), F.substring(p, F.length(b) + 1, F.length(p)))


def top_node(path: Column | str) -> Column:
    """The second segment, ``root`` for the unit itself."""
    parts = segments(path)
    return F.when(F.size(parts) <= 1, F.lit("root")).otherwise(F.element_at(parts, 2))


def deep_node(path: Column | str) -> Column:
    """The last segment, ``root`` for the unit itself."""
    parts = segments(path)
    return F.when(F.size(parts) <= 1, F.lit("root")).otherwise(F.element_at(parts, -1))


def child_node(parent: Column | str, path: Column | str) -> Column:
    """The segment right under ``parent``; null outside it."""
    return F.element_at(F.split(rel_after(parent, path), SEP, -1), 1)


def canonical_dir(path: Column | str) -> Column:
    """A directory without empty and ``.`` segments; ``..`` removes the segment before it unless that is ``..``; '' is ``.``."""
    parts = F.filter(F.split(_col(path), "/", -1), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def simple_event(event: Column | str) -> Column:
    """What follows the last ``.`` or ``:``."""
    return F.regexp_extract(_col(event), r"([^.:]*)$", 1)


def event_parts(event: Column | str) -> Column:
    return F.split(_col(event), r"[.:]+", -1)


def event_suffix(event: Column | str, depth: Column) -> Column:
    """The last ``depth`` parts, joined by dots."""
    parts = event_parts(event)
    n = F.least(depth, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def shared_tail(a: Column | str, b: Column | str) -> Column:
    """How many last parts two events share."""
    x, y = F.reverse(event_parts(a)), F.reverse(event_parts(b))
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct((s["n"] + F.when(s["on"] & (F.element_at(x, i) == F.element_at(y, i)), 1).otherwise(0)).alias("n"), (s["on"] & (F.element_at(x, i) == F.element_at(y, i))).alias("on")),
    )["n"]


def diagnostic_class(line: Column | str) -> Column:
    """What stands before the first ``: ``."""
    return F.substring_index(_col(line), ": ", 1)


def crate_name(name: Column | str) -> Column:
    """P15."""
    return F.translate(_col(name), "-", "_")


def within(zone: Column | str, path: Column | str) -> Column:
    """The path is the zone or lies in it, by whole components; ``.`` holds everything."""
    z, p = _col(zone), _col(path)
    return (z == ".") | (p == z) | F.startswith(p, F.concat(z, F.lit("/")))


def dispatch_row(line: Column | str) -> Column:
    """(zone, languages, winner) of a report line ``zone: lang, lang -> winner``; null where it is none."""
    text = _col(line)
    shape = r"^([^:]+): ([^>]+) -> (\S+)$"
    parsed = F.struct(F.regexp_extract(text, shape, 1).alias("zone"), F.split(F.regexp_extract(text, shape, 2), ", ").alias("languages"), F.regexp_extract(text, shape, 3).alias("winner"))
    return F.when(F.rlike(text, F.lit(shape)), parsed)


def civil_date(days: Column | str) -> Column:
    """The ISO date of a number of days since 1970-01-01."""
    return F.date_format(F.date_from_unix_date(_col(days).cast("int")), "yyyy-MM-dd")


def file_module(path: Column | str, unit: Column | str, root: Column | str) -> Column:
    """The module of a Rust, TypeScript, Python or Kotlin file of a unit rooted at ``root``."""
    p = _col(path)
    local = F.when(F.startswith(p, F.concat(_col(root), F.lit("/src/"))), F.substring(p, F.length(_col(root)) + 6, F.length(p))).otherwise(p)
    stem = F.regexp_replace(F.regexp_replace(local, r"\.(rs|tsx?|jsx?|mjs|svelte|py|kt)$", ""), r"(^|/)(mod|lib|main|index|__init__)$", "")
    return F.when(stem == "", _col(unit)).otherwise(F.concat(_col(unit), F.lit(SEP), F.replace(stem, F.lit("/"), F.lit(SEP))))
