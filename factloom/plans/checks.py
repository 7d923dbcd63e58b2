"""Rule checks: facts and rules to findings.

Each check returns (category, severity, message); ``findings`` puts them in the
canonical order.  Messages are fixed formats of the findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Categories in the order of a report. Fixed values.
CATEGORIES = [
    "missing component",
    "unexpected component",
    "unassigned unit",
    "ambiguous module match",
    "forbidden edge present",
    "missing edge",
    "used but undeclared",
    "disallowed cross-component dependency",
    "facade dependency",
    "contract leak",
    "cycle detected in",
    "public api leak",
    "unverifiable glob export",
    "empty glob export",
    "forbidden external crate",
    "not external free",
    "manifest integrity",
    "feature boundary",
    "forbidden submodule dependency",
    "dead reference",
    "async event unresolved",
    "async publish not derived",
    "async subscribe not derived",
    "async endpoint unclaimed",
    "declaration producer unresolved",
    "declaration producer not canonical",
    "declaration producer conflict",
]
#: Warnings that even a strict run does not promote. Fixed values.
CENSUS_ROWS = ("async cycle: ", "async drift field absent: ", "async drift enum projection: ", "async event collision: ")


def finding(df: DataFrame, category: str, message: Column, severity: str = "error", entry: Column | None = None) -> DataFrame:
    return df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"), (F.lit(0) if entry is None else entry).cast("int").alias("entry"))


def findings(parts: list[DataFrame]) -> DataFrame:
    """(category_ord, category, severity, message, entry), distinct, in canonical order: by category, entry and message."""
    both = reduce(DataFrame.unionByName, parts).distinct()
    names = F.array(*map(F.lit, CATEGORIES))
    place = F.array_position(names, F.col("category"))
    ordered = both.withColumn("category_ord", F.when(place > 0, place).otherwise(len(CATEGORIES) + 1).cast("int"))
    return ordered.orderBy("category_ord", "entry", "message").select("category_ord", "category", "severity", "message", "entry")


def gate(found: DataFrame, strict: bool = False) -> bool:
    """Whether the run passes: no error, and with ``strict`` no warning but census rows."""
    bad = F.col("severity") == "error"
    if strict:
        bad = bad | ~reduce(lambda a, b: a | b, (F.startswith("message", F.lit(p)) for p in CENSUS_ROWS))
    return found.where(bad).isEmpty()


# edges ----------------------------------------------------------------------


def pair_verdicts(pairs: DataFrame, policies: DataFrame, claims: DataFrame, via: DataFrame | None = None) -> DataFrame:
    """(src, dst, value, verdict): forbidden, disallowed or null.

    A forbidden entry wins over an allowed one; an entry that exempts type-only
    imports lets those pass.  A claim without any declared ceiling allows nothing.
    ``via`` (src, dst, via) names the claims of the units that a pair's edges come
    from: what such a claim is granted, and not forbidden, passes for the pair.
    """
    banned = policies.where("list = 'forbidden'").select(F.col("name").alias("src"), F.col("target").alias("dst"), F.col("type_only").alias("_ban"))
    granted = policies.where("list = 'depend_on'").groupBy(F.col("name").alias("src"), F.col("target").alias("dst")).agg(F.min("type_only").alias("_grant"))
    known = claims.select(F.col("name").alias("src"), F.lit(True).alias("_known"))
    out = pairs.join(F.broadcast(banned), ["src", "dst"], "left").join(F.broadcast(granted), ["src", "dst"], "left").join(F.broadcast(known), "src", "left")  # as small as the rules
    if via is not None:
        rows = via.join(F.broadcast(granted.toDF("via", "dst", "_mode")), ["via", "dst"]).join(F.broadcast(banned.select(F.col("src").alias("via"), "dst")), ["via", "dst"], "left_anti")
        lent = rows.groupBy("src", "dst").agg(F.min(F.when(F.col("_mode") == "exempt", 1).otherwise(0)).alias("_lent"))
        out = out.join(lent, ["src", "dst"], "left").withColumn("_grant", F.when((F.col("_lent") == 0) | (F.col("_lent") == 1) & ~F.col("value"), "count").otherwise(F.col("_grant")))
    passes = (F.col("_ban") == "exempt") & ~F.col("value")
    verdict = (
        F.when(F.col("_known").isNull(), None)
        .when(F.col("_ban").isNotNull() & ~passes, "forbidden")
        .when(F.col("_grant").isNull(), "disallowed")
        .when((F.col("_grant") == "exempt") & F.col("value"), "disallowed")
    )
    return out.select("src", "dst", "value", verdict.alias("verdict"))


def arrow(a: str = "src", b: str = "dst") -> Column:
    return F.concat(F.col(a), F.lit(" -> "), F.col(b))


def edge_findings(verdicts: DataFrame) -> DataFrame:
    """R2."""
    bad = verdicts.where("verdict is not null")
    category = F.when(F.col("verdict") == "forbidden", "forbidden edge present").otherwise("disallowed cross-component dependency")
    return bad.select(category.alias("category"), F.lit("error").alias("severity"), arrow().alias("message"), F.lit(0).alias("entry"))


def missing_edges(pairs: DataFrame, claims: DataFrame, allowed: DataFrame, lineage: DataFrame, gated: DataFrame, unowned: DataFrame, file_pairs: DataFrame) -> DataFrame:
    """(src, dst, reason): dependencies that a claim declares and no claim of its subtree has.

    Ancestors are folded into the pairs once, on both sides.  A pair that only
    files show is left to used_undeclared.  reason is unowned, test-gated or ''.
    ``gated`` and ``unowned`` are pairs (src, dst) of edges that were not placed.
    """
    names = claims.select("name")
    declared = allowed.where("list = 'depend_on'").join(claims.where("declared").select("idx", F.col("name").alias("src")), "idx").select("src", F.col("target").alias("dst")).distinct()
    declared = declared.join(names.select(F.col("name").alias("dst")), "dst", "left_semi")

    def folded(edges: DataFrame) -> DataFrame:
        up = lineage.select("name", "anc_name")
        return edges.select("src", "dst").join(F.broadcast(up.toDF("src", "s")), "src").join(F.broadcast(up.toDF("dst", "d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()

    left = declared.join(folded(pairs), ["src", "dst"], "left_anti").join(folded(file_pairs), ["src", "dst"], "left_anti")
    out = left.join(unowned.select("src").distinct().withColumn("_u", F.lit(True)), "src", "left").join(folded(gated).withColumn("_g", F.lit(True)), ["src", "dst"], "left")
    return out.select("src", "dst", F.when(F.col("_u"), "unowned").when(F.col("_g"), "test-gated").otherwise("").alias("reason"))


def used_undeclared(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of claims that only files show, with the files."""
    only = evidence.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return finding(only, "used but undeclared", F.concat(arrow(), F.lit(" ("), F.array_join("files", ", "), F.lit(")")))


def facade_dependencies(edges: DataFrame, roles: DataFrame, gated: DataFrame) -> DataFrame:
    """Imports of a facade, from places that are no composition and not only tests."""
    facade = roles.where("role = 'facade'").select(F.col("path").alias("dst")).distinct()
    wiring = roles.where("role = 'composition'").select(F.col("path").alias("src")).distinct()
    hit = edges.select("src", "dst").distinct().join(facade, "dst", "left_semi").join(wiring, "src", "left_anti")
    for side in ("src", "dst"):
        lines = hit.select(side).distinct().select(side, F.explode(P.lineage(side)).alias("_q")).join(gated.select(F.col("path").alias("_q")).distinct(), "_q", "left_semi").select(side).distinct()
        hit = hit.join(lines, side, "left_anti")
    return finding(hit, "facade dependency", arrow())


# contracts ------------------------------------------------------------------


def contract_leaks(owned: DataFrame, forbids: DataFrame, stereotypes: DataFrame) -> DataFrame:
    """Claims that hold a name which a stereotype forbids them, their own or an ancestor's.

    ``owned`` has claim and name; ``forbids`` has claim and stereotype (inherited
    ones included); ``stereotypes`` has stereotype and pattern.
    """
    rules = forbids.join(stereotypes, "stereotype")
    hit = owned.join(F.broadcast(rules), "claim").where(P.glob_match("name", "pattern"))
    return finding(hit.select("claim", "stereotype").distinct(), "contract leak", F.concat("claim", F.lit(" exposes "), "stereotype", F.lit(" (forbidden)")))


def unexposed(exports: DataFrame, exposing: DataFrame) -> DataFrame:
    """(claim, symbol): exported symbols that some declaring claim of the chain does not expose.

    ``exports`` has claim (the owner) and symbol; ``exposing`` has claim, chain
    (a declaring claim of its lineage) and patterns.
    """
    each = exports.join(F.broadcast(exposing), "claim")
    covered = F.exists("patterns", lambda p: P.glob_match(F.col("symbol"), p))
    return each.groupBy("claim", "symbol").agg(F.bool_and(covered).alias("ok")).where("not ok").select("claim", "symbol")


def public_api(exports: DataFrame, allowed: list[str]) -> DataFrame:
    """Exports that no pattern allows, and globs that cannot be resolved or resolve to nothing."""
    ok = reduce(lambda a, b: a | b, (P.glob_match("symbol", F.lit(p)) for p in allowed), F.lit(False))
    name = F.concat("owner", F.lit(" exposes "), "symbol")
    leaks = finding(exports.where("status = 'resolved'").where(~ok), "public api leak", F.concat(name, F.lit(" (not allowlisted)")))
    unknown = finding(exports.where("status = 'unverifiable'"), "unverifiable glob export", name)
    empty = finding(exports.where("status = 'empty'"), "empty glob export", F.concat(name, F.lit(" (resolves to no public items)")))
    return leaks.unionByName(unknown).unionByName(empty)


# externals and manifests ----------------------------------------------------


def _from(patterns: list[str], column: str = "module") -> Column:
    return reduce(lambda a, b: a | b, (P.module_path_matches(F.lit(p), column) for p in patterns), F.lit(False))


def forbidden_externals(module_external: DataFrame, sources: list[str], forbid: list[str]) -> DataFrame:
    """R10."""
    banned = reduce(lambda a, b: a | b, (P.glob_match("package", F.lit(p)) for p in forbid), F.lit(False))
    hit = module_external.where(_from(sources) & banned)
    return finding(hit, "forbidden external crate", F.concat(P.strip_unit("module"), F.lit(" -> "), "package"))


def external_free(module_external: DataFrame, sources: list[str]) -> DataFrame:
    """R11."""
    hit = module_external.where(_from(sources)).groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("package")), ", ").alias("names"))
    return finding(hit, "not external free", F.concat(P.strip_unit("module"), F.lit(" imports "), "names"))


def manifest_integrity(manifests: DataFrame, publish: bool | None, forbidden: list[str], features: list[str]) -> DataFrame:
    """R12; a manifest that says nothing about publishing does not publish."""
    parts = []
    if publish is not None:
        wrong = manifests.where(F.coalesce("publish", F.lit(False)) != publish)
        parts.append(finding(wrong, "manifest integrity", F.concat("unit", F.lit(f" publish={str(not publish).lower()} (required {str(publish).lower()})"))))
    for f in forbidden:
        rx = P.glob_regex(F.lit(f))
        parts.append(finding(manifests.where(F.exists("deps", lambda d: F.rlike(d, rx))), "manifest integrity", F.concat("unit", F.lit(f" has forbidden dependency {f}"))))
    for f in features:
        parts.append(finding(manifests.where(~F.array_contains("features", f)), "manifest integrity", F.concat("unit", F.lit(f" missing required feature {f}"))))
    return reduce(DataFrame.unionByName, parts)


def feature_boundary(decls: DataFrame, edges: DataFrame, feature: str, gated: list[str], allowed_from: list[str]) -> DataFrame:
    """Modules that should be gated under a feature and are not, and who uses those that are."""
    full = F.concat_ws(P.SEP, "unit", "name")
    matched = decls.withColumn("module", full).where(reduce(lambda a, b: a | b, (P.module_matches(F.lit(p), "module") for p in gated), F.lit(False)))
    bare = finding(matched.where("feature is null"), "feature boundary", F.concat("file", F.lit(" module '"), "name", F.lit(f"' not gated under cfg(feature = \"{feature}\")")))
    other = finding(matched.where(F.col("feature") != feature), "feature boundary", F.concat("file", F.lit(" module '"), "name", F.lit("' gated under feature \""), "feature", F.lit(f"\", not \"{feature}\"")))
    right = matched.where(F.col("feature") == feature).select(F.col("module").alias("_m")).distinct()
    used = edges.select("src", "dst").distinct().withColumn("_m", F.explode(P.lineage("dst"))).join(right, "_m")
    outside = used.where(~(_from(allowed_from, "src") | (F.col("src") == F.col("_m")) | F.startswith("src", F.concat("_m", F.lit(P.SEP)))))
    uses = finding(outside, "feature boundary", F.concat(F.col("src"), F.lit(" depends on gated module "), F.col("_m"), F.lit(f" (feature: {feature})")))
    return bare.unionByName(other).unionByName(uses)


def submodule_dependencies(edges: DataFrame, parent: str, sources: list[str], forbid: list[str]) -> DataFrame:
    """Edges between children of a parent that may not know each other."""
    up = edges.select("src", "dst").distinct().withColumn("_up", P.common_ancestor("src", "dst"))
    hit = up.where(P.module_matches(F.lit(parent), "_up")).withColumn("_a", P.child_node("_up", "src")).withColumn("_b", P.child_node("_up", "dst"))
    hit = hit.where(F.col("_a").isin(sources) & F.col("_b").isin(forbid)).select("_up", "_a", "_b").distinct()
    return finding(hit, "forbidden submodule dependency", F.concat("_up", F.lit("::"), "_a", F.lit(" -> "), "_up", F.lit("::"), "_b"))


# engagement -----------------------------------------------------------------


def engagement(scores: DataFrame, claims: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, claim, by): claims that match nothing, and claims whose every path another one owns better.

    ``scores`` is claim_scores; the division is a count: b beats a on as many
    paths as a has.
    """
    with_pattern = patterns.select("name").distinct()
    lost = with_pattern.join(scores.select("name").distinct(), "name", "left_anti").select(F.lit("unmatched claim").alias("kind"), F.col("name").alias("claim"), F.lit(None).cast("string").alias("by"))
    rank = F.struct(F.col("score"), F.col("depth"))
    a = scores.select("path", F.col("name").alias("claim"), rank.alias("ra"))
    b = scores.select("path", F.col("name").alias("by"), rank.alias("rb"))
    beats = (F.col("rb") > F.col("ra")) | ((F.col("rb") == F.col("ra")) & (F.col("by") < F.col("claim")))
    won = a.join(b, "path").where((F.col("claim") != F.col("by")) & beats).groupBy("claim", "by").agg(F.count("*").alias("n"))
    size = scores.groupBy(F.col("name").alias("claim")).agg(F.count("*").alias("paths"))
    shadow = won.join(size, "claim").where("n = paths").select(F.lit("shadowed claim").alias("kind"), "claim", "by")
    return lost.unionByName(shadow)


def dead_references(allowed: DataFrame, claims: DataFrame) -> DataFrame:
    """Declared targets that name no claim, with the nearest name within a third of its length."""
    names = claims.select(F.col("name").alias("candidate"))
    dead = allowed.join(claims.select("idx", F.col("name").alias("claim")), "idx").join(claims.select(F.col("name").alias("target")), "target", "left_anti").select("claim", "list", "target").distinct()
    near = dead.select("target").distinct().join(F.broadcast(names)).withColumn("d", F.levenshtein("target", "candidate"))
    near = near.where(F.col("d") <= F.greatest(F.lit(1), F.floor(F.char_length("target") / 3))).groupBy("target").agg(F.min_by("candidate", F.struct("d", "candidate")).alias("near"))
    hint = F.when(F.col("near").isNotNull(), F.concat(F.lit(' (did you mean "'), "near", F.lit('"?)'))).otherwise("")
    text = F.concat(F.lit("module '"), "claim", F.lit("' allowed."), "list", F.lit(' target "'), "target", F.lit('" does not exist — create it or fix the reference'), hint)
    return finding(dead.join(near, "target", "left"), "dead reference", text)


def vacuous(domains: dict[int, tuple[str, DataFrame]]) -> list[tuple[int, str]]:
    """(entry, kind) of constraints whose domain is empty: nothing was checked."""
    return [(k, kind) for k, (kind, domain) in sorted(domains.items()) if domain.isEmpty()]


# async ----------------------------------------------------------------------


def async_findings(entries: DataFrame, events: DataFrame, publishers: DataFrame, subscribers: DataFrame, claimed: DataFrame) -> DataFrame:
    """Declared events, publishers, subscribers and endpoints that the facts do not show, in entry order."""
    tail = F.concat(F.lit(" — "), "src", F.lit(" -> "), "dst", F.lit(" (entry #"), F.col("entry").cast("string"), F.lit(")"))
    e = F.col("entry")
    lost = finding(entries.join(events.select("event").distinct(), "event", "left_anti"), "async event unresolved", F.concat("event", tail), entry=e)
    pub = finding(entries.join(publishers.select("src", "event").distinct(), ["src", "event"], "left_anti"), "async publish not derived", F.concat("src", tail), entry=e)
    sub = finding(entries.join(subscribers.select("dst", "event").distinct(), ["dst", "event"], "left_anti"), "async subscribe not derived", F.concat("dst", tail), entry=e)
    ends = [finding(entries.join(claimed.select(F.col("unit").alias(s)).distinct(), s, "left_anti"), "async endpoint unclaimed", F.concat(s, tail), entry=e) for s in ("src", "dst")]
    return lost.unionByName(pub).unionByName(sub).unionByName(ends[0]).unionByName(ends[1])


def schema_drift(entries: DataFrame, records: DataFrame, bases: DataFrame, enums: DataFrame, bound: DataFrame, own: DataFrame) -> DataFrame:
    """Fields that a subscriber binds and no record of the event declares, and enum fields that it binds as text.

    Records go by the event's simple name, wherever they are declared, with all
    that their bases declare.  An entry whose event has no such record, or whose
    subscriber binds no field of it, is silent.  Of the enum fields an entry
    names one: bound as text, else seen as text further on, else of a record of
    the subscriber's own that has the field as a string; the smallest of its sort.

    ``records`` has record, field (null of a record without any) and type,
    ``bases`` record and base, ``enums`` name, ``bound`` dst, record, field,
    bound and projected (as text), ``own`` dst, record, field and type.
    """
    from ..operators.graph import closure

    named = entries.withColumn("record", P.simple_event("event"))
    chain = closure(bases.select(F.col("record").alias("src"), F.col("base").alias("dst"))).select(F.col("src").alias("record"), F.col("dst").alias("of"))
    same = records.select("record").unionByName(bases.select("record")).distinct().withColumn("of", F.col("record"))
    whole = chain.unionByName(same).distinct().join(records.withColumnRenamed("record", "of"), "of").select("record", "field", "type").distinct()
    binds = bound.where("bound").select("dst", "record").distinct()
    speaks = named.join(whole.select("record").distinct(), "record").join(binds, ["dst", "record"])
    asked = speaks.join(bound, ["dst", "record"])
    mark = F.concat(F.lit(" (entry #"), F.col("entry").cast("string"), F.lit(")"))
    where = F.concat("dst", F.lit(" binds "), "event", F.lit("."), "field")
    lost = asked.where("bound").join(whole.select("record", "field").distinct(), ["record", "field"], "left_anti")
    absent = finding(lost, "warning", F.concat(F.lit("async drift field absent: "), where, F.lit(" — the publisher record declares no such field"), mark), "warning", F.col("entry"))
    plain = F.element_at(F.split(F.regexp_extract("type", "^([^<]*)", 1), "[.:]"), -1)
    of_enum = whole.withColumn("name", F.trim(plain)).join(enums.select("name").distinct(), "name", "left_semi").select("record", "field").distinct()
    text = own.where(F.lower(F.trim(F.element_at(F.split(F.rtrim(F.regexp_extract("type", "^([^<]*)", 1), F.lit("? ")), "[.:]"), -1))) == "string")
    text = text.select("dst", "record", "field").distinct().withColumn("_own", F.lit(True))
    rank = F.when(F.col("bound") & F.col("projected"), 1).when(F.col("projected"), 2).when(F.col("bound") & F.col("_own"), 3)
    shown = asked.join(of_enum, ["record", "field"], "left_semi").join(text, ["dst", "record", "field"], "left").withColumn("_rank", rank).where("_rank is not null")
    first = shown.groupBy("entry", "dst", "event").agg(F.min_by("field", F.struct("_rank", "field")).alias("field"))
    enum = finding(first, "warning", F.concat(F.lit("async drift enum projection: "), where, F.lit(" as a string projection of the publisher's enum field"), mark), "warning", F.col("entry"))
    return absent.unionByName(enum)


def producer_findings(producers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Declared producers that name no unit, are not spelled canonically, or contradict each other.

    ``resolved`` has spelling, unit and canon (the unit's own spelling).
    """
    r = producers.join(resolved.withColumnRenamed("spelling", "producer"), "producer", "left")
    e = F.col("entry")
    mark = F.concat(F.lit(" ("), "kind", F.lit(" #"), F.col("entry").cast("string"), F.lit(")"))
    lost = finding(r.where("unit is null"), "declaration producer unresolved", F.concat("class", F.lit(": "), "producer", mark), entry=e)
    odd = finding(r.where("unit is not null and producer <> canon"), "declaration producer not canonical", F.concat("class", F.lit(": "), "producer", F.lit(" is "), "canon", mark), entry=e)
    more = r.where("unit is not null").groupBy("kind", "class").agg(F.array_sort(F.collect_set("unit")).alias("units"), F.min("entry").alias("entry")).where(F.size("units") > 1)
    clash = finding(more, "declaration producer conflict", F.concat("class", F.lit(": "), F.array_join("units", ", ")), entry=e)
    return lost.unionByName(odd).unionByName(clash)


# cycles ---------------------------------------------------------------------


def ring_kinds(rings: DataFrame, value_edges: DataFrame) -> DataFrame:
    """(component, ring, kind): runtime if every leg has a value edge, else type-assisted."""
    legs = rings.select("component", "ring", F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("src"), F.element_at("ring", i + 1).alias("dst")))).alias("leg"))
    real = value_edges.select("src", "dst").distinct().withColumn("_v", F.lit(True))
    kinds = legs.select("component", "ring", "leg.src", "leg.dst").join(real, ["src", "dst"], "left").groupBy("component", "ring").agg(F.bool_and(F.coalesce("_v", F.lit(False))).alias("real"))
    return kinds.select("component", "ring", F.when(F.col("real"), "runtime").otherwise("type-assisted").alias("kind"))


def tier_rings(rings: DataFrame, tier: str, severity: str, kinds: list[str] | None = None) -> DataFrame:
    """(identity, text, tier, severity) of ``rings`` (ring, kind, and claim where files have a common one), for cycle_findings.

    ``kinds`` names the kinds of ring that are told, all where it is empty.
    """
    identity = F.array_join("ring", " -> ")
    told = rings.where(F.col("kind").isin(*kinds)) if kinds else rings
    text = F.concat(identity, F.lit(" ("), "kind", F.lit(")"))
    if "claim" in rings.columns:
        text = F.when(F.col("claim").isNotNull(), F.concat("claim", F.lit(": "), text)).otherwise(text)
    return told.select(identity.alias("identity"), text.alias("text"), F.lit(tier).alias("tier"), F.lit(severity).alias("severity"))


def _exempted(found: DataFrame, exempt: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rings that no exemption covers, exemptions, the (entry, …) that met a ring)."""
    each = found.groupBy("identity", "text", "tier").agg(F.min("severity").alias("severity"))  # error comes before warning
    of = (F.col("identity") == F.col("cycle")) & ((F.col("of_tier") == "both") | (F.col("of_tier") == F.col("tier")))
    entries = exempt.select("entry", F.trim("cycle").alias("cycle"), F.col("tier").alias("of_tier"), "cap", (F.col("until").isNotNull() & (F.col("until") < today)).alias("expired"))
    met = each.join(F.broadcast(entries.where("not expired")), of)  # as small as the rules
    turn = "row_number() over (partition by entry order by severity, text) as n"
    covered = met.selectExpr("text", "cap", turn).where("cap is null or n <= greatest(cap, 1)").select("text").distinct()
    return each.join(covered, "text", "left_anti"), entries, met


def debts(found: DataFrame, exempt: DataFrame, today: str) -> DataFrame:
    """(ring, tier) of the rings of tier_rings that no exemption covers."""
    return _exempted(found, exempt, today)[0].select(F.col("identity").alias("ring"), "tier").distinct().orderBy("tier", "ring")


def cycle_findings(found: DataFrame, exempt: DataFrame, today: str) -> DataFrame:
    """One finding for each ring of tier_rings, less what exemptions cover; expired and stale ones are warned of.

    A ring that is an error is no warning as well.  An entry covers the first
    ``cap`` findings of its identity and tier (or of both tiers), errors before
    warnings and then by text; past its date it covers nothing.
    """
    left, entries, met = _exempted(found, exempt, today)
    error = F.col("severity") == "error"
    told = left.select(F.when(error, "cycle detected in").otherwise("warning").alias("category"), "severity", F.when(error, F.col("text")).otherwise(F.concat(F.lit("cycle: "), "text")).alias("message"), F.lit(0).alias("entry"))
    expired = finding(entries.where("expired"), "warning", F.concat(F.lit("exempt expired: "), "of_tier", F.lit(" "), "cycle"), "warning")
    stale = finding(entries.where("not expired").join(met.select("entry").distinct(), "entry", "left_anti"), "warning", F.concat(F.lit("exempt stale: "), "of_tier", F.lit(" "), "cycle"), "warning")
    return told.unionByName(expired).unionByName(stale)
