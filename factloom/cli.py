"""Commands over a tree's model or a source tree: ``python -m factloom.cli COMMAND [options]``.

Exit codes: 0 passed, 1 findings, 64 usage, 70 could not run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans import capability, census, checks, render, views
from .plans.verify import FactSet, Verdict
from .sources import model_json, rules, tree_facts

OK, FOUND, USAGE, FAILED = 0, 1, 64, 70
COMMANDS = ["scan", "verify", "report", "depgraph", "diagram", "inspect", "explain", "update", "spec", "capability", "doctor"]


def facts_of(spark: SparkSession, path: str, language: str | None = None, spec: rules.Spec | None = None) -> tuple[FactSet, list[str]]:
    """(facts, notices) of a model file (.json), or of the source tree under a directory."""
    if path.endswith(".json"):
        return model_json.ModelFacts(spark, path).fact_set(), []
    excluded = rules.Rules(spark, spec).excluded() if spec and spec.excluded else None
    facts, notices = tree_facts.scan(spark, path, language, excluded)
    if excluded is not None:
        from .sources import python_source, trees

        dead = trees.dead_exclusions(python_source.read_tree(spark, os.path.abspath(path), tree_facts.PATTERN), excluded)
        notices += [f"excluded source matches no file: {r.entry}" for r in dead.orderBy("entry").collect()]  # a row for each rule
    return facts, notices


def seeded(facts: FactSet) -> str:
    """K11 from facts: claims for units and top modules with what they use."""
    units = {r.name: [] for r in facts.units.collect()}
    for a, b in render.pairs(facts.unit_edges, "src", "dst"):
        units.setdefault(a, []).append(b)
    modules: dict[str, list[str]] = {}
    for a, b in render.pairs(facts.module_edges, "src", "dst"):
        top = ["::".join(x.split("::")[:2]) for x in (a, b)]
        for x in top:
            modules.setdefault(x, [])
        if top[0] != top[1] and top[1] not in modules[top[0]]:
            modules[top[0]].append(top[1])
    gates: dict[str, list[str]] = {}
    for unit, name, feature in render.pairs(facts.module_decls.where("feature is not null"), "unit", "name", "feature"):
        gates.setdefault(feature, []).append(f"{unit}::{name}")
    return render.seed_spec(facts.language, units, {k: v for k, v in modules.items() if k not in units}, gates)


def violations(spark: SparkSession, facts: FactSet, args: argparse.Namespace) -> set[tuple[str, str]]:
    """K6: claims' pairs that a rule document, if there is one, calls forbidden or disallowed."""
    if not args.spec or not os.path.exists(args.spec):
        return set()
    verdict = Verdict(facts, rules.load_spec(Path(args.spec).read_text(encoding="utf-8")), args.today)
    return {tuple(r) for r in verdict.verdicts.where("verdict is not null").select("src", "dst").collect()}


def drawn(spark: SparkSession, facts: FactSet, args: argparse.Namespace) -> str:
    """K4, K6, V1 to V7: the asked view as a graph; arrows that break a rule are marked."""
    kind = args.view
    if kind == "units":
        view = views.units_view(facts.units, facts.unit_edges, facts.module_edges)
    elif kind == "submodules":
        view = views.submodules(facts.modules, facts.module_edges, args.parent)
    elif kind == "deep":
        view = views.deep_modules(facts.modules, facts.module_edges)
    elif kind == "api":
        return render.usage_markdown([(r.dst, r.src, list(r.symbols)) for r in views.api_usage(facts.module_edges).collect()])
    else:
        view = views.modules_view(facts.units, facts.unit_edges, facts.modules, facts.module_edges)
    nodes, edges = [n for (n,) in render.pairs(view.nodes, "node")], render.pairs(view.edges, "src", "dst")
    bad = violations(spark, facts, args)
    draw = render.plantuml if args.format == "plantuml" else render.mermaid
    notes = [n for n in (views.crowded_note(view), views.collision_note(view)) if n]
    return "".join(f"%% {n}\n" if draw is render.mermaid else f"' {n}\n" for n in notes) + draw(nodes, [(a, b, "violation" if (a, b) in bad else "direct") for a, b in edges])


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    """(exit code, output) of a command."""
    if args.command == "capability":
        rows = capability.capability(spark).collect()
        return OK, "".join(f"{r.language}\t{r.fact}\t{r.status}\n" for r in rows)
    if args.command == "doctor":
        return OK, f"spark {spark.version}\npython {sys.version.split()[0]}\n"
    if args.command == "spec":
        return OK, json.dumps({k: sorted(v) for k, v in rules.KEYS.items()}, indent=2) + "\n"
    if args.command == "diagram":
        draw = render.plantuml if args.format == "plantuml" else render.mermaid
        return OK, draw(*render.spec_graph(rules.load_spec(Path(args.spec).read_text(encoding="utf-8"))))
    judged = args.command in ("verify", "report", "explain")
    spec = rules.load_spec(Path(args.spec).read_text(encoding="utf-8")) if judged else None
    facts, notices = facts_of(spark, args.path, args.language or (spec.language if spec and spec.pinned else None), spec)
    for n in notices:
        print(f"note: {n}", file=sys.stderr)
    if args.command == "scan":
        return OK, render.canonical_json(model_json.model_of(facts), not args.compact) + "\n"
    if args.command == "update":
        return OK, seeded(facts)
    if args.command == "depgraph":
        return OK, drawn(spark, facts, args)
    if args.command == "inspect":
        if args.clusters:
            nodes = views.soft_nodes(facts.modules, facts.module_edges)
            found = graph.clusters(nodes, facts.module_edges)
            outcome = graph.cluster_outcome(nodes, facts.module_edges, found).first().label
            if outcome.startswith("skipped"):
                return OK, f"clusters: {outcome}\n"
            return OK, f"structure: {outcome}\n" + "".join(f"{r.node} -> {r.cluster}\n" for r in found.orderBy("node").collect())
        paths = facts.modules.select("path").unionByName(facts.module_edges.select(F.explode(F.array("src", "dst")).alias("path"))).distinct()
        return OK, render.tree([p for (p,) in render.pairs(paths, "path")])
    verdict = Verdict(facts, spec, args.today)
    if args.command == "explain":
        told = capability.explain(verdict.placed, verdict.verdicts, verdict.findings, args.source, args.target)
        return OK, "".join(f"{r.part}: {r.text}\n" for r in told.collect())
    rows = verdict.rows()
    if args.command == "report":
        metrics = {r.metric: r.n for r in census.metrics(verdict.rules.claims(), facts.units, facts.unit_edges, facts.externals, verdict.findings).collect()}
        roles = dict(render.pairs(facts.roles, "path", "role"))
        return OK, render.report_json(facts.language, metrics, rows, roles) if args.format == "json" else render.report_markdown(facts.language, metrics, rows)
    debts = [(r.ring, r.tier) for r in verdict.debts().collect()] if args.write_exemptions or args.emit_repro else []
    if args.write_exemptions:
        text = render.exempt_entries(debts, [(e["cycle"], e["tier"]) for e in spec.exempt], "seeded")
        with open(args.spec, "a", encoding="utf-8") as f:
            f.write(text)
        return OK, text or "no cycle to exempt\n"
    out = render.findings_text(rows, args.strict) + "".join(f"{n}\n" for n in verdict.notes())
    if args.emit_repro:
        out += render.ring_reproduction([c.split(" -> ") for c, tier in debts if tier == "file"])
    return (OK if checks.gate(verdict.findings, args.strict) else FOUND), out


def main(argv: list[str] | None = None) -> int:
    from datetime import UTC, datetime

    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path", nargs="?", default=".", help="a model .json or a source tree")
    p.add_argument("source", nargs="?")
    p.add_argument("target", nargs="?")
    p.add_argument("--spec", default="rules.toml")
    p.add_argument("--config", help="the tool's own settings (TOML)")
    p.add_argument("--language", choices=sorted(rules.LANGUAGES))
    p.add_argument("--format", choices=["mermaid", "plantuml", "json", "markdown"])
    p.add_argument("--view", choices=["modules", "units", "deep", "submodules", "api"], default="modules")
    p.add_argument("--parent", default="", help="whose submodules are drawn")
    p.add_argument("--strict", action="store_true", default=None)
    p.add_argument("--compact", action="store_true")
    p.add_argument("--clusters", action="store_true")
    p.add_argument("--write-exemptions", action="store_true", help="add every ring that breaks a rule to the document's exemptions")
    p.add_argument("--emit-repro", action="store_true", help="print how to run each ring of files")
    p.add_argument("--today", default=datetime.now(UTC).date().isoformat())
    p.add_argument("--check", metavar="FILE", help="compare with a file instead of printing")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else USAGE
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        settings, warnings = rules.load_config(Path(args.config).read_text(encoding="utf-8")) if args.config else ({"output": {}, "report": {}}, [])
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        part = settings["report" if args.command in ("report", "verify") else "output"]
        args.format = args.format or part.get("format") or "mermaid"
        args.strict = bool(part.get("strict")) if args.strict is None else args.strict
        args.check = args.check or settings["output"].get("check")
        code, text = run(spark, args)
    except (rules.InvalidSpec, OSError, RuntimeError, ValueError) as e:
        print(e, file=sys.stderr)
        return FAILED
    if args.check:
        return OK if render.is_fresh(text, args.check) else FOUND
    print(text, end="")
    return code


if __name__ == "__main__":
    sys.exit(main())
