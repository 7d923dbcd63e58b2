"""Renderers: small, sorted results as text.  What they collect is a view for people, which the callers keep small."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from .checks import CENSUS_ROWS

#: FNV-1a, 64 bits. Fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> int:
    """K9."""
    h = FNV_OFFSET
    for byte in text.encode():
        h = (h ^ byte) * FNV_PRIME % 2**64
    return h


def identifier(name: str) -> str:
    """K9: a diagram identifier; names that need escaping get eight digits of their hash, so that none collide."""
    plain = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return plain if plain == name and not name[:1].isdigit() else f"{plain}_{fnv1a(name) & 0xFFFFFFFF:08x}"


def label(name: str) -> str:
    return name.replace('"', "#quot;")


def pairs(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).distinct().collect())


def mermaid(nodes: list[str], edges: list[tuple[str, str, str]]) -> str:
    """K4, K6: edges are (src, dst, kind): direct, async or violation."""
    arrows = {"direct": "-->", "async": "-.->", "violation": "-->|violates|"}
    lines = ["graph TD"]
    for n in sorted(nodes):
        lines.append(f"  {n}" if identifier(n) == n else f'  {identifier(n)}["{label(n)}"]')
    lines += [f"  {identifier(a)} {arrows[k]} {identifier(b)}" for a, b, k in sorted(edges)]
    return "\n".join(lines) + "\n"


def plantuml(nodes: list[str], edges: list[tuple[str, str, str]]) -> str:
    """K4, K5."""
    arrows = {"direct": "-->", "async": "..>", "violation": "-[#red]->"}
    body = [f'component "{label(n)}" as {identifier(n)}' for n in sorted(nodes)]
    body += [f"{identifier(a)} {arrows[k]} {identifier(b)}" for a, b, k in sorted(edges)]
    return "\n".join(["@startuml", *body, "@enduml"]) + "\n"


def spec_graph(spec) -> tuple[list[str], list[tuple[str, str, str]]]:
    """K5: the declared graph: claims and the dependencies that they allow."""
    names = [c.name for c in spec.claims]
    return names, [(c.name, t, "direct") for c in spec.claims for kind, t, _ in c.allowed if kind == "depend_on" and t in names]


def tree(paths: list[str], sep: str = "::") -> str:
    """K8: nested subgraphs by path segments."""
    root: dict = {}
    for p in paths:
        at = root
        for s in p.split(sep):
            at = at.setdefault(s, {})

    def walk(at: dict, prefix: str, depth: int) -> list[str]:
        out = []
        for name, below in sorted(at.items()):
            full = f"{prefix}{sep}{name}" if prefix else name
            pad = "  " * depth
            if below:
                out += [f'{pad}subgraph {identifier(full)}["{label(full)}"]', *walk(below, full, depth + 1), f"{pad}end"]
            else:
                out.append(f'{pad}{identifier(full)}["{label(full)}"]')
        return out

    return "\n".join(["graph TD", *walk(root, "", 1)]) + "\n"


def findings_text(rows: list[tuple[str, str, str]], strict: bool = False) -> str:
    """K2: a line for each (category, severity, message); what a pass looks like if there is none."""
    marks = {"error": "error", "warning": "error" if strict else "warning"}
    told = lambda s, m: "warning" if s == "warning" and m.startswith(CENSUS_ROWS) else marks[s]
    lines = [f"[{told(s, m)}] {c}: {m}" if c != "warning" else f"[{told(s, m)}] {m}" for c, s, m in rows]
    vacuous = [m.removeprefix("vacuous constraint: ").split(":")[0] for c, s, m in rows if m.startswith("vacuous constraint: ")]
    if rows and len(vacuous) == len(rows):  # nothing was found, but not all was checked either
        lines.insert(0, f"verify: vacuous constraints: {', '.join(sorted(set(vacuous)))}")
    return "\n".join(lines or ["verify: PASS"]) + "\n"


def report_json(language: str, metrics: dict[str, int], rows: list[tuple[str, str, str]], roles: dict[str, str]) -> str:
    """K3."""
    body = {"language": language, "metrics": metrics, "roles": dict(sorted(roles.items())), "findings": [{"category": c, "severity": s, "message": m} for c, s, m in rows]}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def report_markdown(language: str, metrics: dict[str, int], rows: list[tuple[str, str, str]]) -> str:
    """K3."""
    lines = [f"# Report ({language})", "", "| metric | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in metrics.items()), "", "## Findings", ""]
    return "\n".join([*lines, *(f"- {c}: {m}" for c, _, m in rows)] if rows else [*lines, "none"]) + "\n"


def usage_markdown(rows: list[tuple[str, str, list[str]]]) -> str:
    """K10."""
    lines = ["| target | source | symbols |", "|---|---|---|"]
    return "\n".join([*lines, *(f"| {d} | {s} | {', '.join(x)} |" for d, s, x in sorted(rows))]) + "\n"


def seed_spec(language: str, unit_targets: dict[str, list[str]], module_targets: dict[str, list[str]], gates: dict[str, list[str]]) -> str:
    """Facts to rules: a claim for each unit and top module with what it uses, a boundary for each gate, and no_cycles."""

    def quoted(xs) -> str:
        return "[" + ", ".join(json.dumps(x) for x in sorted(xs)) + "]"

    out = ["[project]", f'language = "{language}"', ""]
    for kind, table in (("units", unit_targets), ("modules", module_targets)):
        for name, targets in sorted(table.items()):
            out += ["[[module]]", f"name = {json.dumps(name)}", f"matches = {{ {kind} = [{json.dumps(name)}] }}"]
            out += [f"allowed = {{ depend_on = {quoted(targets)} }}"] if targets else []
            out.append("")
    for feature, modules in sorted(gates.items()):
        out += ["[[constraint]]", 'type = "feature_boundary"', f"feature = {json.dumps(feature)}", f"gated_modules = {quoted(modules)}", ""]
    return "\n".join([*out, "[[constraint]]", 'type = "no_cycles"']) + "\n"


def is_fresh(content: str, path: str) -> bool:
    """Whether a rendered file is what it would be now."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read() == content
    except FileNotFoundError:
        return False


def exempt_entries(debts: list[tuple[str, str]], ledger: list[tuple[str, str]], reason: str) -> str:
    """TOML for rings (cycle, tier) that the ledger does not hold yet."""
    new = sorted(set(debts) - set(ledger))
    return "".join(f"\n[[exempt]]\ncycle = {json.dumps(c)}\ntier = {json.dumps(t)}\nreason = {json.dumps(reason)}\n" for c, t in new)


def ring_reproduction(rings: list[list[str]]) -> str:
    """A line for each runtime ring, with the imports that walk it."""
    out = []
    for r in sorted(rings):
        imports = "; ".join(f"import './{f}'" for f in r[:-1])
        out += [f"repro: {' -> '.join(r)} (runtime)", f'  node --input-type=module -e "{imports}"']
    return "\n".join(out) + "\n" if out else ""


def canonical_json(facts: dict, pretty: bool = False) -> str:
    """K1: a model as JSON, its keys and rows as they come."""
    return json.dumps(facts, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
