"""The rule document: TOML with a closed set of keys, as dataclasses and small tables."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The keys that each kind of table may hold. Fixed values of the document format.
KEYS = {
    "top": {"async_depends", "canonical_producer", "constraint", "exempt", "module", "pattern_pair", "project", "shared_constant", "stereotype"},
    "project": {"excluded_sources", "framework", "language"},
    "excluded_sources": {"mode", "path", "reason"},
    "module": {"allowed", "contract", "matches", "name", "submodules"},
    "match": {"modules", "names", "paths", "units"},
    "allowed": {"depend_on", "forbidden"},
    "contract": {"expose", "forbid"},
    "stereotype": {"match", "name"},
    "constraint": {"allowed", "allowed_from", "feature", "forbid", "forbidden_dependencies", "from", "gated_modules", "kinds", "modules", "parent", "require_publish", "required_features", "scope", "severity", "type"},
    "exempt": {"count", "cycle", "reason", "tier", "until"},
    "async_depends": {"event", "from", "to"},
    "canonical_producer": {"class", "producer"},
    "shared_constant": {"class", "producer"},
    "pattern_pair": {"emit", "id", "subscribe"},
    "pattern_side": {"arg", "call", "language", "property", "role"},
}
CONSTRAINTS = {"no_cycles", "public_api_allowlist", "forbid_external_crates", "external_free", "manifest_integrity", "feature_boundary", "forbid_submodule_dependency"}
LANGUAGES = {"rust", "csharp", "go", "ts", "python", "kotlin"}
DOMAINS = {"mode": {"abort", "warn"}, "role": {"publish", "subscribe"}, "tier": {"module", "file", "both"}, "severity": {"error", "warning"}, "scope": {"claims", "both"}}


class InvalidSpec(ValueError):
    """The document is refused; nothing is run."""


@dataclass
class Claim:
    idx: int
    parent: int | None
    depth: int
    name: str
    patterns: list[tuple[str, str, int]]
    declared: bool
    allowed: list[tuple[str, str, str]]
    expose: list[str] | None
    forbid: list[str]


@dataclass
class Spec:
    language: str
    claims: list[Claim] = field(default_factory=list)
    excluded: list[dict] = field(default_factory=list)
    stereotypes: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    exempt: list[dict] = field(default_factory=list)
    async_depends: list[dict] = field(default_factory=list)
    canonical_producer: list[dict] = field(default_factory=list)
    shared_constant: list[dict] = field(default_factory=list)
    pattern_pairs: list[dict] = field(default_factory=list)
    pinned: bool = False  # whether the document names the language


def _closed(shape: str, table: dict, where: str) -> None:
    if not isinstance(table, dict):
        raise InvalidSpec(f"invalid spec: {where} is no table")
    if unknown := sorted(set(table) - KEYS[shape]):
        raise InvalidSpec(f"invalid spec: unknown key {', '.join(unknown)} in {where}")


def _domain(key: str, value, where: str) -> None:
    if value is not None and value not in DOMAINS[key]:
        raise InvalidSpec(f"invalid spec: {key} {value!r} in {where} is not one of {', '.join(sorted(DOMAINS[key]))}")


def _need(table: dict, keys: tuple[str, ...], where: str) -> None:
    for k in keys:
        if not table.get(k):
            raise InvalidSpec(f"invalid spec: {where} needs {k}")


def _entries(kind: str, listed: list, where: str) -> list[tuple[str, str, str]]:
    out = []
    for e in listed:
        if isinstance(e, str):
            out.append((kind, e, "count"))
            continue
        if set(e) - {"target", "type_only"} or "target" not in e or e.get("type_only", "count") not in ("count", "exempt"):
            raise InvalidSpec(f"invalid spec: {kind} entry {e} in {where}")
        out.append((kind, e["target"], e.get("type_only", "count")))
    return out


def _claims(modules: list[dict], parent: int | None, depth: int, out: list[Claim]) -> None:
    for m in modules:
        where = f"module {m.get('name', '?')!r}"
        _closed("module", m, where)
        _need(m, ("name",), where)
        matches, allowed, contract = m.get("matches", {}), m.get("allowed"), m.get("contract", {})
        _closed("match", matches, where)
        _closed("contract", contract, where)
        patterns = [(kind, p, k) for kind in ("names", "paths", "units", "modules") for k, p in enumerate(matches.get(kind, []))]
        entries = []
        if allowed is not None:
            _closed("allowed", allowed, where)
            entries = _entries("depend_on", allowed.get("depend_on", []), where) + _entries("forbidden", allowed.get("forbidden", []), where)
        if any(c.name == m["name"] for c in out):
            raise InvalidSpec(f"invalid spec: module {m['name']!r} is declared twice")
        claim = Claim(len(out), parent, depth, m["name"], patterns, allowed is not None and "depend_on" in allowed, entries, contract.get("expose"), contract.get("forbid", []))
        out.append(claim)
        _claims(m.get("submodules", []), claim.idx, depth + 1, out)


def load_spec(text: str) -> Spec:
    """The document, checked before any job: unknown keys, duplicates and values out of their domain are refused."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise InvalidSpec(f"invalid spec: {e}") from None
    _closed("top", doc, "the document")
    project = doc.get("project", {})
    _closed("project", project, "[project]")
    if project.get("language", "rust") not in LANGUAGES:
        raise InvalidSpec(f"invalid spec: language {project['language']!r}")
    spec = Spec(project.get("language", "rust"), pinned="language" in project)
    for e in project.get("excluded_sources", []):
        _closed("excluded_sources", e, "excluded_sources")
        _need(e, ("path", "reason"), "excluded_sources")
        _domain("mode", e.get("mode"), "excluded_sources")
        spec.excluded.append({"path": e["path"].strip("/"), "mode": e.get("mode", "abort"), "reason": e["reason"]})
    for s in doc.get("stereotype", []):
        _closed("stereotype", s, "stereotype")
        _need(s, ("name",), "stereotype")
        _closed("match", s.get("match", {}), f"stereotype {s['name']!r}")
        spec.stereotypes.append({"name": s["name"], **{k: s.get("match", {}).get(k, []) for k in KEYS["match"]}})
    _claims(doc.get("module", []), None, 0, spec.claims)
    for c in doc.get("constraint", []):
        _closed("constraint", c, "constraint")
        if c.get("type") not in CONSTRAINTS:
            raise InvalidSpec(f"invalid spec: constraint type {c.get('type')!r}")
        _domain("severity", c.get("severity"), c["type"])
        _domain("scope", c.get("scope"), c["type"])
        spec.constraints.append(c)
    for e in doc.get("exempt", []):
        _closed("exempt", e, "exempt")
        _need(e, ("cycle", "tier", "reason"), "exempt")
        _domain("tier", e["tier"], "exempt")
        if (e["cycle"], e["tier"]) in {(x["cycle"], x["tier"]) for x in spec.exempt}:
            raise InvalidSpec(f"invalid spec: exempt {e['cycle']!r} is declared twice")
        spec.exempt.append(e)
    for kind in ("async_depends", "canonical_producer", "shared_constant"):
        for e in doc.get(kind, []):
            _closed(kind, e, kind)
            _need(e, tuple(sorted(KEYS[kind])), kind)
            getattr(spec, kind).append(e)
    for p in doc.get("pattern_pair", []):
        _closed("pattern_pair", p, "pattern_pair")
        _need(p, ("id", "emit", "subscribe"), "pattern_pair")
        for side in ("emit", "subscribe"):
            _closed("pattern_side", p[side], f"pattern_pair {p['id']!r}")
            _need(p[side], ("language",), f"pattern_pair {p['id']!r}")
            _domain("role", p[side].get("role"), f"pattern_pair {p['id']!r}")
            if ("call" in p[side]) == ("property" in p[side]):
                raise InvalidSpec(f"invalid spec: pattern_pair {p['id']!r} needs one of call and property")
        spec.pattern_pairs.append(p)
    return spec


#: Keys of the tool's own configuration. Fixed values.
CONFIG = {"output": {"dir", "format", "check"}, "report": {"format", "strict"}}


def load_config(text: str) -> tuple[dict, list[str]]:
    """(settings, warnings) of a tool configuration; unknown keys are warned of, never refused."""
    doc = tomllib.loads(text)
    warnings = [f"unknown section [{k}]" for k in sorted(set(doc) - set(CONFIG))]
    kept: dict = {}
    for section, keys in CONFIG.items():
        given = doc.get(section, {})
        warnings += [f"unknown key {section}.{k}" for k in sorted(set(given) - keys)]
        kept[section] = {k: v for k, v in given.items() if k in keys}
    return kept, warnings


class Rules:
    """The tables of a rule document: as small as the document, so that they are broadcast."""

    def __init__(self, spark: SparkSession, spec: Spec):
        self.spark, self.spec = spark, spec

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def claims(self) -> DataFrame:
        return self._table([(c.idx, c.parent, c.depth, c.name, c.declared) for c in self.spec.claims], "idx int, parent int, depth int, name string, declared boolean")

    def patterns(self, *kinds: str) -> DataFrame:
        rows = [(c.idx, c.name, c.depth, k, p, n) for c in self.spec.claims for k, p, n in c.patterns if not kinds or k in kinds]
        return self._table(rows, "idx int, name string, depth int, kind string, pattern string, pos int")

    def allowed(self) -> DataFrame:
        rows = [(c.idx, kind, target, mode) for c in self.spec.claims for kind, target, mode in c.allowed]
        return self._table(rows, "idx int, list string, target string, type_only string")

    def lineage(self) -> DataFrame:
        """(idx, anc, distance) of each claim to itself and its ancestors, by name."""
        rows = []
        for c in self.spec.claims:
            at, d = c.idx, 0
            while at is not None:
                rows.append((c.idx, c.name, at, self.spec.claims[at].name, d))
                at, d = self.spec.claims[at].parent, d + 1
        return self._table(rows, "idx int, name string, anc int, anc_name string, distance int")

    def policies(self) -> DataFrame:
        """For each claim its ceiling (the nearest declared one) and all prohibitions above it."""
        claims, rows = self.spec.claims, []
        for c in claims:
            at, declared, banned = c.idx, None, []
            while at is not None:
                if declared is None and claims[at].declared:
                    declared = claims[at]
                banned += [(t, m) for kind, t, m in claims[at].allowed if kind == "forbidden"]
                at = claims[at].parent
            rows += [(c.name, "depend_on", t, m) for kind, t, m in (declared.allowed if declared else []) if kind == "depend_on"]
            # an entry that counts binds, whatever else is exempt
            rows += [(c.name, "forbidden", t, "count" if (t, "count") in banned else "exempt") for t in sorted({t for t, _ in banned})]
        return self._table(rows, "name string, list string, target string, type_only string").distinct()

    def exempt(self) -> DataFrame:
        rows = [(k + 1, e["cycle"], e["tier"], e.get("count"), e.get("until"), e["reason"]) for k, e in enumerate(self.spec.exempt)]
        return self._table(rows, "entry int, cycle string, tier string, cap long, until string, reason string")

    def async_depends(self) -> DataFrame:
        rows = [(k + 1, e["from"], e["to"], e["event"]) for k, e in enumerate(self.spec.async_depends)]
        return self._table(rows, "entry int, src string, dst string, event string")

    def sides(self) -> DataFrame:
        """A row for each side of a pattern pair, numbered: (pattern, noun, role, language, tag, position, side)."""
        rows = []
        for p in self.spec.pattern_pairs:
            for side in (p["emit"], p["subscribe"]):
                tag = "call" if "call" in side else "property"
                rows.append((p["id"], side[tag], side.get("role"), side["language"], tag, side.get("arg"), len(rows)))
        return self._table(rows, "pattern string, noun string, role string, language string, tag string, position int, side int")

    def constants(self) -> DataFrame:
        return self._table([(e["class"], e["producer"]) for e in self.spec.shared_constant], "class string, producer string")

    def producers(self) -> DataFrame:
        rows = [(t, k + 1, e["class"], e["producer"]) for t in ("canonical_producer", "shared_constant") for k, e in enumerate(getattr(self.spec, t))]
        return self._table(rows, "kind string, entry int, class string, producer string")

    def excluded(self) -> DataFrame:
        return self._table([(e["path"], e["mode"], e["reason"]) for e in self.spec.excluded], "entry string, mode string, reason string")
