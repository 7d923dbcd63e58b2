"""Commands over a small tree, readers by import lines, and cycle laws."""

import json

import pytest

from factloom import cli
from factloom.plans import cycles
from factloom.sources import modules, rules, text_sources, tree_facts

SPEC = """
[project]
language = "python"
[[module]]
name = "core"
matches = { modules = ["app::core*"] }
allowed = { depend_on = ["util"] }
[[module]]
name = "util"
matches = { modules = ["app::util*"] }
allowed = { depend_on = [] }
[[constraint]]
type = "no_cycles"
[[constraint]]
type = "forbid_external_crates"
from = ["*core*"]
forbid = ["requests"]
"""


def tree(tmp_path):
    for name, text in {"app/core.py": "import requests\nfrom app.util import f\n", "app/util.py": "from app import core\ndef f(): pass\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "spec.toml").write_text(SPEC)
    return str(tmp_path), str(tmp_path / "spec.toml")


def test_commands(spark, tmp_path, capsys):
    root, spec = tree(tmp_path)
    assert cli.main(["verify", root, "--spec", spec]) == cli.FOUND
    told = capsys.readouterr().out
    assert "disallowed cross-component dependency: util -> core" in told
    assert "cycle detected in: core -> util -> core (runtime)" in told
    assert "forbidden external crate: core -> requests" in told
    assert cli.main(["scan", root]) == cli.OK
    model = capsys.readouterr().out
    assert {e["from"] for e in json.loads(model)["module_edges"]} == {"app::core", "app::util"}
    (tmp_path / "model.json").write_text(model)
    assert cli.main(["verify", str(tmp_path / "model.json"), "--spec", spec]) == cli.FOUND
    capsys.readouterr()
    assert cli.main(["depgraph", root]) == cli.OK and "core --> util" in capsys.readouterr().out
    assert cli.main(["update", root]) == cli.OK
    seeded = capsys.readouterr().out
    (tmp_path / "seed.toml").write_text(seeded)
    assert cli.main(["update", root, "--check", str(tmp_path / "seed.toml")]) == cli.OK
    assert cli.main(["explain", root, "util", "core", "--spec", spec]) == cli.OK and "verdict: disallowed" in capsys.readouterr().out
    assert cli.main(["report", root, "--spec", spec, "--format", "json"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["metrics"]["violations_cycles"] == 1
    assert cli.main(["inspect", root]) == cli.OK and cli.main(["inspect", root, "--clusters"]) == cli.OK
    assert cli.main(["capability"]) == cli.OK and cli.main(["spec"]) == cli.OK and cli.main(["diagram", root, "--spec", spec]) == cli.OK


def test_exit_codes(spark, tmp_path):
    root, spec = tree(tmp_path)
    assert cli.main(["nonsense"]) == cli.USAGE
    (tmp_path / "bad.toml").write_text("nope = 1")
    assert cli.main(["verify", root, "--spec", str(tmp_path / "bad.toml")]) == cli.FAILED


def test_import_lines(spark):
    files = {
        "w/a.ts": "import type { X } from './b'\nimport fs from 'fs'\nexport * from './lib'\nconst y = require('@s/p/q')\n",
        "w/b.ts": "export class X {}\n",
        "w/lib/index.ts": "",
        "m/x/x.go": "package x\nimport (\n\t\"fmt\"\n\ty \"example.com/m/y\"\n\t\"github.com/a/b\"\n)\n",
        "y/y.go": "package y\n",
        "c/src/lib.rs": "use crate::net::Client;\nuse serde::Serialize;\n",
        "c/src/net/mod.rs": "use std::io;\n",
        "k/A.kt": "package p.a\nimport p.b.B\nimport q.C\nclass A\n",
        "k/B.kt": "package p.b\nclass B\n",
        "s/A.cs": "using P.B;\nusing System;\nnamespace P.A { public class Q {} }\n",
        "s/B.cs": "namespace P.B { public class R {} }\n",
    }
    df = spark.createDataFrame([*files.items()], "path string, text string")
    found = text_sources.imports(df)
    edges, external = text_sources.resolve_ts(found, df)
    assert {tuple(r) for r in edges.collect()} == {("w/a.ts", "w/b.ts", True), ("w/a.ts", "w/lib/index.ts", False)}
    assert {r.package for r in external.collect()} == {"fs", "@s/p"}
    edges, external = text_sources.resolve_go(found, df, "example.com/m")
    assert {tuple(r) for r in edges.collect()} == {("m/x", "y")} and {r.package for r in external.collect()} == {"github.com/a/b"}
    edges, external = text_sources.resolve_rust(found, df, "c")
    assert {tuple(r) for r in edges.collect()} == {("c/src/lib.rs", "c/src/net/mod.rs")} and {r.package for r in external.collect()} == {"serde"}
    names = text_sources.declared(df)
    edges, external = text_sources.resolve_names(found, names, "kotlin")
    assert {tuple(r) for r in edges.collect()} == {("k/A.kt", "k/B.kt")} and {r.package for r in external.collect()} == {"q"}
    edges, external = text_sources.resolve_names(found, names, "csharp")
    assert {tuple(r) for r in edges.collect()} == {("s/A.cs", "s/B.cs")} and {r.package for r in external.collect()} == {"System"}


def test_async_rings(spark):
    direct = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    legs = spark.createDataFrame([("c", "a", False), ("y", "x", True), ("p", "q", False), ("q", "p", False)], "src string, dst string, publisher_only boolean")
    got = {(tuple(r.ring), r.kind) for r in cycles.async_rings(direct, legs).collect()}
    # x -> y is carved out: the leg back only publishes
    assert got == {(("a", "b", "c", "a"), "mixed"), (("p", "q", "p"), "async")}


def test_file_cycles_told_by_claims(spark):
    edges = spark.createDataFrame([("u", "a1", "b1", "use"), ("u", "b1", "a1", "use"), ("u", "a2", "a3", "use"), ("u", "a3", "a2", "use"), ("u", "g", "a1", "use"), ("u", "m", "m2", "mod"), ("u", "m2", "m", "use")], "unit string, src string, dst string, kind string")
    owned = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("a3", "A2"), ("b1", "B")], "path string, name string")
    lineage = spark.createDataFrame([("A", "A", 0), ("B", "B", 0), ("A2", "A2", 0), ("A2", "A", 1)], "name string, anc_name string, distance int")
    rings = spark.createDataFrame([("A", ["A", "B", "A"], "runtime")], "component string, ring array<string>, kind string")
    gated = spark.createDataFrame([("g",)], "path string")
    got = [(list(r.ring), r.claim) for r in cycles.file_cycles(edges, owned, lineage, rings, gated).collect()]
    assert got == [(["a2", "a3", "a2"], "A")]


def test_configuration(spark):
    settings, warnings = rules.load_config("[output]\ndir = 'x'\nodd = 1\n[else]\n")
    assert settings["output"] == {"dir": "x"} and warnings == ["unknown section [else]", "unknown key output.odd"]
    configs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "config string, extends string")
    chain = modules.config_chain(configs)
    values = spark.createDataFrame([("c", "strict", "no"), ("b", "strict", "yes"), ("c", "target", "es5")], "config string, key string, value string")
    assert {tuple(r) for r in modules.effective(chain, values).where("config = 'a'").collect()} == {("a", "strict", "yes"), ("a", "target", "es5")}
    packages = spark.createDataFrame([("packages/a",), ("packages/old/b",), ("tools/c",)], "path string")
    assert [r.path for r in modules.workspace_members(packages, ["packages/*", "!packages/old/*"]).collect()] == ["packages/a"]


RUST = {
    "Cargo.toml": "[workspace]\nmembers = ['app', 'lib']\n",
    "app/Cargo.toml": "[package]\nname = 'app'\npublish = false\n[dependencies]\nlib = { path = '../lib' }\nserde = '1'\njson = { package = 'serde_json', version = '1' }\n[features]\nslim = []\n",
    "app/src/main.rs": "mod net;\n#[cfg(feature = \"slim\")]\npub mod slim;\n#[cfg(test)]\nmod tests;\nuse crate::net::{client::{Client, self}, Server as S};\nuse lib::Shared;\nuse std::{io, fmt::{self, Debug}};\n",
    "app/src/net/mod.rs": "pub mod client;\npub struct Server;\nuse super::slim::Thin;\n",
    "app/src/net/client.rs": "use crate::net::Server;\nuse serde::{Serialize, de::DeserializeOwned};\npub struct Client;\n",
    "app/src/slim.rs": "pub struct Thin;\n",
    "lib/Cargo.toml": "[package]\nname = 'lib'\n",
    "lib/src/lib.rs": "pub struct Shared;\n",
    ".gitignore": "# made\ngenerated/\n",
    "app/src/generated/x.rs": "use nowhere::Else;\n",
    "target/y.rs": "use nowhere::Else;\n",
}


def write(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_rust_tree(spark, tmp_path):
    facts, notices = tree_facts.scan(spark, write(tmp_path, RUST))
    assert facts.language == "rust" and notices == []
    edges = {(r.src, r.dst, tuple(r.symbols)) for r in facts.module_edges.collect()}
    assert ("app", "app::net", ("Server",)) in edges and ("app", "app::net::client", ("Client",)) in edges and ("app::net::client", "app::net", ("Server",)) in edges
    assert ("app::net", "app::slim", ("Thin",)) in edges and ("app", "lib", ("Shared",)) in edges
    assert {tuple(r) for r in facts.unit_edges.collect()} == {("app", "lib")}
    assert {tuple(r) for r in facts.externals.collect()} == {("app::net::client", "serde")}
    assert {(r.unit, r.publish, tuple(r.deps), tuple(r.features)) for r in facts.manifests.collect()} == {("app", False, ("lib", "serde", "serde_json"), ("slim",)), ("lib", None, (), ())}
    assert {(r.name, r.feature) for r in facts.module_decls.collect()} == {("net", None), ("slim", "slim"), ("tests", None)}
    assert [r.path for r in facts.test_gated.collect()] == ["app::tests"]
    assert {tuple(r) for r in facts.shown.collect()} >= {("app::net", "Server"), ("lib", "Shared")}


def test_trees_of_other_languages(spark, tmp_path):
    trees = {
        "go": {"go.work": "use (\n\t./a\n\t./b\n)\n", "a/go.mod": "module ex.com/a\nrequire ex.com/b v1.0.0\n", "b/go.mod": "module ex.com/b\n", "a/x/x.go": "package x\nimport (\n\t\"fmt\"\n\t\"ex.com/b/y\"\n\t\"github.com/q/r\"\n)\n", "b/y/y.go": "package y\n"},
        "kotlin": {"settings.gradle.kts": "rootProject.name = \"r\"\ninclude(\":core\", \":ui:web\")\n", "core/src/A.kt": "package p.core\nclass A\n", "ui/web/src/B.kt": "package p.ui\nimport p.core.A\nimport q.Z\nclass B\n"},
        "csharp": {"App/App.csproj": "<Project><PropertyGroup><IsPackable>false</IsPackable></PropertyGroup><ItemGroup><PackageReference Include='Json' /><ProjectReference Include='..\\Lib\\Lib.csproj' /></ItemGroup></Project>", "Lib/Lib.csproj": "<Project/>", "App/A.cs": "using P.Lib;\nusing System;\nnamespace P.App { public class A {} }\n", "Lib/B.cs": "namespace P.Lib { public class B {} }\n"},
        "ts": {"package.json": "{\"name\": \"root\", \"workspaces\": [\"packages/*\"]}", "packages/a/package.json": "{\"name\": \"@s/a\", \"dependencies\": {\"@s/b\": \"*\", \"left\": \"1\"}}", "packages/b/package.json": "{\"name\": \"@s/b\"}", "packages/a/src/x.ts": "import { y } from './y.js'\nimport type { Z } from '@s/b'\nimport left from 'left'\n", "packages/a/src/y.ts": "export const y = 1\n", "packages/b/src/index.ts": "export interface Z {}\n"},
    }
    got = {}
    for language, files in trees.items():
        facts, _ = tree_facts.scan(spark, write(tmp_path / language, files), language)
        got[language] = ({tuple(r) for r in facts.unit_edges.collect()}, {(r.src, r.dst) for r in facts.module_edges.collect()}, {r.package for r in facts.externals.collect()})
    assert got["go"] == ({("ex.com/a", "ex.com/b")}, {("ex.com/a/x", "ex.com/b/y")}, {"github.com/q/r"})
    assert got["kotlin"] == ({("ui:web", "core")}, {("ui::web::src::B", "core::src::A")}, {"q"})
    assert got["csharp"] == ({("App", "Lib")}, {("App::A", "Lib::B")}, {"System"})
    assert got["ts"] == ({("@s/a", "@s/b")}, {("packages::a::src::x", "packages::a::src::y"), ("packages::a::src::x", "packages::b::src")}, {"left"})


def test_broken_trees_are_refused(spark, tmp_path):
    for name, files in {"none": {"x.md": "hi"}, "manifest": {"Cargo.toml": "= broken", "src/lib.rs": "use a::b;"}, "syntax": {"a/x.py": "def ("}}.items():
        (tmp_path / name).mkdir()
        with pytest.raises(tree_facts.ScanFailed):
            tree_facts.scan(spark, write(tmp_path / name, files))


CONSTRAINTS = {
    "no_cycles": ("", "cycle detected in: a -> b -> a (runtime)"),
    "public_api_allowlist": ("allowed = ['Fine']", "public api leak: app::a exposes Bad (not allowlisted)"),
    "forbid_external_crates": ("from = ['*a*']\nforbid = ['requests']", "forbidden external crate: a -> requests"),
    "external_free": ("from = ['*a*']", "not external free: a imports requests"),
    "manifest_integrity": ("forbidden_dependencies = ['requests']", "manifest integrity: proj has forbidden dependency requests"),
    "feature_boundary": ("feature = 'x'\ngated_modules = ['a']\nallowed_from = []", "vacuous constraint: [constraint #1] feature_boundary: no fact to check"),
    "forbid_submodule_dependency": ("parent = 'app'\nfrom = ['a']\nforbid = ['b']", "forbidden submodule dependency: app::a -> app::b"),
}


@pytest.mark.parametrize("kind", sorted(CONSTRAINTS))
def test_no_constraint_passes_in_silence(spark, tmp_path, capsys, kind):
    files = {"pyproject.toml": "[project]\nname = 'proj'\ndependencies = ['requests>=2']\n", "app/a.py": "import requests\nfrom app.b import f\nclass Bad: pass\nclass Fine: pass\n", "app/b.py": "from app.a import Bad\ndef f(): pass\n"}
    body, told = CONSTRAINTS[kind]
    claims = "[[module]]\nname = 'a'\nmatches = { modules = ['app::a'] }\nallowed = { depend_on = ['b'] }\n[[module]]\nname = 'b'\nmatches = { modules = ['app::b'] }\nallowed = { depend_on = ['a'] }\n[[module]]\nname = 'all'\nmatches = { units = ['proj'] }\n"
    (tmp_path / "spec.toml").write_text(f"[project]\nlanguage = 'python'\n{claims}[[constraint]]\ntype = '{kind}'\n{body}\n")
    root, spec = write(tmp_path / "t", files), str(tmp_path / "spec.toml")
    code = cli.main(["verify", root, "--spec", spec, "--strict"])
    out = capsys.readouterr().out
    assert code == cli.FOUND and told in out, out
    # and the same from the written model
    assert cli.main(["scan", root]) == cli.OK
    (tmp_path / "m.json").write_text(capsys.readouterr().out)
    assert cli.main(["verify", str(tmp_path / "m.json"), "--spec", spec, "--strict"]) == cli.FOUND
    assert capsys.readouterr().out == out


def test_exemptions_are_written_and_rings_reproduced(spark, tmp_path, capsys):
    root, spec = tree(tmp_path)  # one claim holds both files, so that only the files tell of the ring
    (tmp_path / "spec.toml").write_text("[project]\nlanguage = 'python'\n[[module]]\nname = 'whole'\nmatches = { units = ['app'], modules = ['app*'] }\n[[constraint]]\ntype = 'no_cycles'\n")
    assert cli.main(["verify", root, "--spec", spec, "--emit-repro"]) == cli.FOUND
    out = capsys.readouterr().out
    assert "cycle detected in: whole: app/core.py -> app/util.py -> app/core.py (runtime)" in out
    assert "repro: app/core.py -> app/util.py -> app/core.py" in out
    assert cli.main(["verify", root, "--spec", spec, "--write-exemptions"]) == cli.OK
    assert 'cycle = "app/core.py -> app/util.py -> app/core.py"' in capsys.readouterr().out
    assert cli.main(["verify", root, "--spec", spec]) == cli.OK
    assert "cycle detected" not in capsys.readouterr().out
    assert cli.main(["depgraph", root, "--spec", spec, "--view", "api"]) == cli.OK and "| app::core | app::util |" in capsys.readouterr().out
