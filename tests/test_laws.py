"""Exact laws on small rows, against brute force and under permutation."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions import paths as P
from factloom.operators import events, graph, owners
from factloom.plans import capability, checks, render, views
from factloom.plans.verify import TABLES, FactSet
from factloom.sources import model_json, python_source, rules, trees


def score(pattern: str, path: str):
    """The specificity law, written over strings."""
    if pattern == path:
        return P.EXACT
    parts, best = path.split("::"), None
    for n in range(1, len(parts) + 1):
        whole = "::".join(parts[:n])
        for text, off in {(whole, 0), ("::".join(parts[1:n]), len(parts[0]) + 2)} if n > 1 else {(whole, 0)}:
            last = text.split("::")[-1]
            literal = pattern.rstrip("*")
            if pattern.endswith("*") and "*" not in literal:
                got = len(literal) + off if text.startswith(literal) else len(text) + off if last.startswith(literal) else None
            else:
                got = len(text) + off if glob(pattern, text) or glob(pattern, last) else None
            best = got if best is None else best if got is None else max(best, got)
    return best


def glob(pattern: str, value: str) -> bool:
    parts = pattern.split("*")
    if len(parts) == 1:
        return pattern == value
    if not value.startswith(parts[0]):
        return False
    at = len(parts[0])
    for p in parts[1:-1]:
        k = value.find(p, at)
        if k < 0:
            return False
        at = k + len(p)
    return len(value) - at >= len(parts[-1]) and value.endswith(parts[-1])


def test_specificity_matches_the_law(spark):
    rng = random.Random(4)
    seg = ["a", "b", "ab", "a.b", "c_d"]
    paths = ["::".join(rng.choices(seg, k=rng.randint(1, 4))) for _ in range(60)]
    patterns = [rng.choice(["", "*"]) + "::".join(rng.choices(seg, k=rng.randint(1, 3))) + rng.choice(["", "*", "**", "::*"]) for _ in range(60)] + ["*", "a*b", "\\E*", "a::*::b"]
    pairs = [(a, b) for a in paths for b in patterns]
    got = spark.createDataFrame(pairs, "path string, pattern string").select("path", "pattern", P.specificity("pattern", "path").alias("s")).collect()
    bad = [(r.path, r.pattern, r.s, score(r.pattern, r.path)) for r in got if r.s != score(r.pattern, r.path)]
    assert not bad, bad[:5]
    pats = spark.createDataFrame([(k, f"c{k}", 0, p, 0) for k, p in enumerate(patterns)], "idx int, name string, depth int, pattern string, pos int")
    joined = {(r.path, r.name): r.score for r in owners.claim_scores(spark.createDataFrame([(p,) for p in paths], "path string"), pats).collect()}
    assert joined == {(a, f"c{k}"): score(p, a) for a in set(paths) for k, p in enumerate(patterns) if score(p, a) is not None}


def test_owner_ties(spark):
    pats = spark.createDataFrame([(0, "z", 0, "a::b*", 0), (1, "y", 1, "a::b*", 0), (2, "x", 1, "a::b*", 0), (3, "w", 0, "b", 0)], "idx int, name string, depth int, pattern string, pos int")
    got = {r.path: r.name for r in owners.owners(spark.createDataFrame([("a::b",), ("a::bc",), ("q::b",)], "path string"), pats).collect()}
    # the bare hit scores the whole path, as the prefix does: the deeper claim, then the smaller name wins
    assert got == {"a::b": "x", "a::bc": "x", "q::b": "w"}


def test_longest_prefix_ties(spark):
    paths = spark.createDataFrame([("a/b/c",), ("z",)], "path string")
    roots = spark.createDataFrame([("one", "a/b"), ("two", "a/b"), ("top", "."), ("up", "a")], "name string, root string")
    first = {r.path: r.name for r in owners.longest_prefix(paths, roots).collect()}
    last = {r.path: r.name for r in owners.longest_prefix(paths, roots, root_owns=False, last_wins=True).collect()}
    assert first == {"a/b/c": "one", "z": "top"} and last == {"a/b/c": "two"}


def test_canonical_dir(spark):
    cases = {"": ".", "./a//b/.": "a/b", "../a": "../a", "a/../..": "..", "a/../../b": "../b", "/a/": "a", "a/b/../c": "a/c"}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", P.canonical_dir("p").alias("c")).collect()
    assert {r.p: r.c for r in got} == cases


EDGES = st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=14)


def reachable(pairs):
    reach = {p for p in pairs}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
        if more == reach:
            return reach
        reach = more


@given(EDGES)
@settings(max_examples=200, deadline=None)
def test_tarjan_is_mutual_reachability(pairs):
    pairs = {p for p in pairs if p[0] != p[1]}
    reach = reachable(pairs)
    nodes = {x for p in pairs for x in p}
    groups = {frozenset(y for y in nodes if y == x or (x, y) in reach and (y, x) in reach) for x in nodes}
    assert graph.tarjan(pairs) == sorted(sorted(g) for g in groups if len(g) > 1)


@pytest.mark.parametrize("seed", range(2))
def test_components_closure_and_reach_by_joins(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(10)} | {("x", "y"), ("y", "x")}
    pairs = {p for p in pairs if p[0] != p[1]}
    rows = list(pairs)
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "src string, dst string")
    want = {(n, p[0]) for p in graph.tarjan(pairs) for n in p}
    for cap in (0, 1000):
        assert {tuple(r) for r in graph.strong_components(edges, cap).collect()} == want
    assert {tuple(r) for r in graph.closure(edges).collect()} == reachable(pairs)
    start = min(a for a, _ in pairs)
    for r in graph.reach_levels(edges, start).collect():
        if r.node != start:
            assert list(r.path) == graph.shortest_path(pairs, start, r.node)


def test_ring_is_a_greedy_walk(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "a"), ("p", "q"), ("q", "p"), ("s", "s")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.component: list(r.ring) for r in graph.rings(edges, graph.strong_components(edges)).collect()}
    assert got == {"a": ["a", "b", "c", "a"], "p": ["p", "q", "p"]}
    rng = random.Random(6)
    for _ in range(3):  # walks by joins, at any size, take the same way
        pairs = [(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(14)]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        parts = graph.strong_components(edges)
        one, two = ({r.component: list(r.ring) for r in graph.rings(edges, parts, n).collect()} for n in (1000, 0))
        assert one == two
    # the walk may leave its start behind
    assert graph.ring_of(["a", "b", "c"], [("a", "c"), ("c", "b"), ("b", "c"), ("b", "d"), ("c", "a")][:3] + [("b", "a")]) == ["a", "c", "b", "a"]


def brute_clusters(nodes, pairs):
    group = {n: frozenset([n]) for n in nodes}
    total = sum(k for *_, k in pairs)
    while True:
        parts = sorted(set(group.values()), key=min)
        best = None
        for x, y in itertools.combinations(parts, 2):
            k = sum(w for a, b, w in pairs if a in x and b in y or a in y and b in x)
            ka, kb = (sum(w * ((a in s) + (b in s)) for a, b, w in pairs) for s in (x, y))
            gain = k * 2 * total - ka * kb
            if k and gain > 0 and (best is None or (-gain, min(x), min(y)) < best[0]):
                best = ((-gain, min(x), min(y)), x | y)
        if best is None:
            return {n: min(p) for p in parts for n in p}
        for n in best[1]:
            group[n] = best[1]


@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.integers(1, 3)), max_size=9))
@settings(max_examples=150, deadline=None)
def test_clusters_match_brute_force(rows):
    nodes = sorted("abcdef")
    assert graph.cluster_labels(nodes, rows) == brute_clusters(nodes, [(a, b, w) for a, b, w in rows if a != b])


def test_three_tied_pairs_and_loops(spark):
    """Each pair is a cluster named by its smaller node; a loop, however heavy, keeps nothing apart."""
    pairs = [("tiedense::a", "tiedense::b"), ("tiedense::c", "tiedense::d"), ("tiedense::e", "tiedense::f")]
    nodes = spark.createDataFrame([(x,) for p in pairs for x in p], "node string")
    edges = spark.createDataFrame(pairs + [("tiedense::a", "tiedense::a")] * 9, "src string, dst string")
    got = graph.clusters(nodes, edges)
    assert {(r.node, r.cluster) for r in got.collect()} == {(x, p[0]) for p in pairs for x in p}
    assert tuple(graph.cluster_outcome(nodes, edges).first()) == (6, 3, "3 clusters")


def test_outcomes_of_clustering(spark, monkeypatch):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node string")
    of = lambda *pairs: graph.cluster_outcome(nodes, spark.createDataFrame([*pairs], "src string, dst string")).first().label
    assert of() == "empty" and of(("a", "a")) == "empty" and of(("a", "b"), ("b", "c"), ("c", "a")) == "none (single region)"
    assert of(("a", "b")) == "2 clusters"
    monkeypatch.setattr(graph, "CLUSTER_EDGES", 2)
    edges = [("a", "b")] * 3  # the limit counts repeated edges
    assert of(*edges) == "skipped (edges=3 > cap 2)" and graph.clusters(nodes, spark.createDataFrame(edges, "src string, dst string")).count() == 0
    monkeypatch.setattr(graph, "CLUSTER_NODES", 2)
    assert of(*edges) == "skipped (nodes=3 > cap 2)"


def test_clusters_count_repeated_edges(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c")], "src string, dst string")
    got = {r.node: r.cluster for r in graph.clusters(nodes, edges).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["a"] != got["c"] and len({got["e"], got["f"]}) == 2


def test_no_site_is_lost(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 4)}", str(rng.randint(0, 6)), rng.choice(["on", "emit", "odd", "none"]), rng.choice(["p", "q", "k"])) for _ in range(200)]
    sites = spark.createDataFrame(rows, "unit string, value string, noun string, pattern string")
    sides = spark.createDataFrame([("p", "emit", "publish", "go"), ("p", "on", "subscribe", "ts"), ("q", "emit", "publish", "go"), ("q", "odd", "publish", "go"), ("q", "odd", "subscribe", "ts")], "pattern string, noun string, role string, language string")
    constants = spark.createDataFrame([("k", "x")], "class string, producer string")
    census = events.value_census(sites, sides, constants, ["ts"]).collect()
    assert sum(r.n for r in census if r.n is not None) == len(rows)
    assert {r.kind for r in census} >= {"shared-constant", "ambiguous-leg", "joined", "value-namespace", "unfunded-shape"}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    again = spark.createDataFrame(shuffled, "unit string, value string, noun string, pattern string")
    assert {tuple(r) for r in events.value_join(sites, sides, constants).collect()} == {tuple(r) for r in events.value_join(again, sides, constants).collect()}


def test_paired_sites(spark):
    """Two conventions on one string of a file: a pair goes to one site of its own pattern and shape, in order."""
    sides = spark.createDataFrame([("p", "emit", "publish", "go", "call", 0, 0), ("p", "send", "publish", "go", "call", 0, 1), ("q", "on", "subscribe", "go", "call", 0, 2), ("p", "NAME", None, "go", "property", None, 3)], "pattern string, noun string, role string, language string, tag string, position int, side int")
    cand = [("f", "go", "call", "on", 0, "v", 1), ("f", "go", "call", "send", 0, "v", 2), ("f", "go", "call", "emit", 0, "v", 3), ("f", "go", "property", "NAME", None, "v", 4), ("f", "go", "call", "emit", 1, "v", 0)]
    candidates = spark.createDataFrame(cand, "path string, language string, tag string, noun string, position int, value string, ord int")
    rows = [("f", "go", "v", "p", "call", 1), ("f", "go", "v", "p", "call", 2), ("f", "go", "v", "p", "call", 3), ("f", "go", "v", "q", "call", 4), ("f", "go", "v", "p", "property", 5), ("g", "go", "v", "p", "call", 6)]
    sites = spark.createDataFrame(rows, "path string, language string, value string, pattern string, tag string, ord int")
    # the candidate order decides, not the nouns' names; the call at another position matches no side
    assert {r.ord: r.noun for r in events.paired_sites(sites, candidates, sides).collect()} == {1: "send", 2: "emit", 3: None, 4: "on", 5: "NAME", 6: None}


def exemptions(spark, rows):
    return spark.createDataFrame(rows, "entry int, cycle string, tier string, cap long, until string, reason string")


def test_exemptions(spark):
    rings = spark.createDataFrame([("a", ["a", "b", "a"], "runtime"), ("c", ["c", "d", "c"], "runtime")], "component string, ring array<string>, kind string")
    exempt = exemptions(spark, [(1, "a -> b -> a", "module", 1, "2030-01-01", "r"), (2, "c -> d -> c", "module", None, "2020-01-01", "r"), (3, "x -> y -> x", "module", None, None, "r"), (4, "a -> b -> a", "file", None, None, "r")])
    got = {r.message for r in checks.cycle_findings(checks.tier_rings(rings, "module", "warning"), exempt, "2024-01-01").collect()}
    assert got == {"cycle: c -> d -> c (runtime)", "exempt expired: module c -> d -> c", "exempt stale: module x -> y -> x", "exempt stale: file a -> b -> a"}


def test_exemptions_of_both_tiers(spark):
    """One identity on both tiers: errors come before warnings, and the cap counts both tiers."""
    ring = spark.createDataFrame([("a", ["a", "b", "a"], "runtime")], "component string, ring array<string>, kind string")
    files = ring.selectExpr("component", "ring", "kind", "'core' as claim")
    found = checks.tier_rings(ring, "module", "warning").unionByName(checks.tier_rings(files, "file", "error"))
    told = lambda *rows: {(r.severity, r.message) for r in checks.cycle_findings(found, exemptions(spark, rows), "2024-01-01").collect()}
    error, warning = ("error", "core: a -> b -> a (runtime)"), ("warning", "cycle: a -> b -> a (runtime)")
    assert told((1, "a -> b -> a", "both", None, None, "r")) == set()
    assert told((1, " a -> b -> a ", "both", 1, None, "r")) == {warning}
    assert told((1, "a -> b -> a", "module", None, None, "r")) == {error}
    assert told((1, "a -> b -> a", "file", 0, None, "r")) == {warning}
    # an error is no warning as well, and a kind that is not asked for is not told
    twice = checks.tier_rings(ring, "module", "error").unionByName(checks.tier_rings(ring, "module", "warning"))
    assert [r.severity for r in checks.cycle_findings(twice, exemptions(spark, []), "2024-01-01").collect()] == ["error"]
    assert checks.tier_rings(ring, "module", "error", ["type-assisted"]).count() == 0
    assert [tuple(r) for r in checks.debts(found, exemptions(spark, [(1, "a -> b -> a", "file", None, None, "r")]), "2024-01-01").collect()] == [("a -> b -> a", "module")]


def test_schema_drift(spark):
    """Silent without a record or a bound field; bases and copies declare; one projection an entry."""
    entries = spark.createDataFrame([(1, "p", "s", "shop.Order"), (2, "p", "s", "mall.Order"), (3, "p", "s", "shop.Ghost"), (4, "p", "t", "shop.Order"), (5, "p", "u", "shop.Order"), (6, "p", "v", "shop.Order")], "entry int, src string, dst string, event string")
    records = spark.createDataFrame([("Order", "id", "int"), ("Order", "state", "List.State<T>"), ("Base", "at", "Level"), ("Root", "key", "long")], "record string, field string, type string")
    bases = spark.createDataFrame([("Order", "Base"), ("Base", "Root")], "record string, base string")
    enums = spark.createDataFrame([("State",), ("Level",)], "name string")
    bound = [("s", "Order", f, True, f == "state") for f in ("id", "key", "price", "state")] + [("s", "Order", "at", False, True), ("s", "Ghost", "id", True, False), ("t", "Order", "at", False, True), ("u", "Order", "state", True, False), ("v", "Order", "id", True, False), ("v", "Order", "at", False, True)]
    own = spark.createDataFrame([("u", "Order", "state", "System.String?")], "dst string, record string, field string, type string")
    got = checks.schema_drift(entries, records, bases, enums, spark.createDataFrame(bound, "dst string, record string, field string, bound boolean, projected boolean"), own)
    absent = lambda e, n: f"async drift field absent: s binds {e}.Order.price — the publisher record declares no such field (entry #{n})"
    enum = lambda d, e, f, n: f"async drift enum projection: {d} binds {e}.Order.{f} as a string projection of the publisher's enum field (entry #{n})"
    # t binds no field of its own, so that it is silent; v's projection is seen further on
    assert {r.message for r in got.collect()} == {absent("shop", 1), absent("mall", 2), enum("s", "shop", "state", 1), enum("s", "mall", "state", 2), enum("u", "shop", "state", 5), enum("v", "shop", "at", 6)}


def test_laundering_is_by_the_claim_s_own_hop(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("x", "y")], "src string, dst string")
    hop = spark.createDataFrame([("b", "c"), ("d", "e")], "src string, dst string")
    bans = spark.createDataFrame([("a", "c"), ("d", "f"), ("d", "e"), ("x", "c")], "src string, dst string")
    # a reaches c by a hop of b, which is for b's bans; d -> e is there directly
    assert [tuple(r) for r in graph.laundered(pairs, hop, bans).collect()] == [("d", "f", "e")]


def test_first_claim_in_order_reclaims(spark):
    mapping = spark.createDataFrame([("u", None), ("w", "named")], "unit string, name string")
    scores = spark.createDataFrame([("u::x", 2, "late", 0, 0, 9), ("u::y", 2, "late", 0, 0, 9), ("u::z", 1, "first", 0, 0, 1), ("w::a", 0, "other", 0, 0, 1)], "path string, idx int, name string, depth int, pos int, score int")
    assert {tuple(r) for r in capability.augmented(mapping, scores).collect()} == {("u", "first", True), ("w", "named", False)}


def test_suggestions_are_equal_names(spark):
    paths = spark.createDataFrame([(p,) for p in ("Sample::Contracts", "Other::Contracts", "Sample::ContractsOld", "Sample::Api", "A::Contracts", "B::Contracts", "C::Contracts")], "name string")
    scores = spark.createDataFrame([("Sample::Api", 0, "contracts", 0, 0, 5)], "path string, idx int, name string, depth int, pos int, score int")
    dead = spark.createDataFrame([("Contracts",), ("contracts",), ("Contract",), ("Sample::Api",)], "target string")
    got = {r.target: (list(r.named), r.more) for r in capability.suggestions(dead, paths, scores).collect()}
    assert got == {"Contracts": (["A::Contracts", "B::Contracts", "C::Contracts"], 2), "contracts": (["Sample::Api"], 0)}
    assert capability.did_you_mean(["a", "b", "c"], 2).endswith('did you mean "a", "b", "c"...and 2 more module paths?')
    assert capability.did_you_mean(["a", "b"], 0).endswith('"a" or "b"?') and capability.did_you_mean([], 0) == ""


def test_inert_rules_by_what_readers_state(spark):
    asked = [{"type": "feature_boundary"}, {"type": "external_free"}, {"type": "manifest_integrity"}]
    rows = lambda lang: {(r.entry, r.fact) for r in capability.inert_rules(spark, lang, asked).collect()}
    assert rows("rust") == set() and rows("kotlin") == {(1, "module gates"), (3, "manifests")}
    assert capability.stated("python") == python_source.FACTS | {"manifests"}


def test_unit_grants_reach_its_modules(spark):
    pairs = spark.createDataFrame([("mod", "lib", True, False), ("mod", "raw", True, False), ("mod", "types", True, False), ("mod", "kept", False, False)], "src string, dst string, value boolean, fallback boolean")
    policies = spark.createDataFrame([("unit", "depend_on", "lib", "count"), ("unit", "depend_on", "raw", "count"), ("unit", "forbidden", "raw", "count"), ("unit", "depend_on", "types", "exempt"), ("unit", "depend_on", "kept", "exempt")], "name string, list string, target string, type_only string")
    claims = spark.createDataFrame([("mod",), ("unit",)], "name string")
    via = pairs.selectExpr("src", "dst", "'unit' as via")
    got = {r.dst: r.verdict for r in checks.pair_verdicts(pairs, policies, claims, via).collect()}
    assert got == {"lib": None, "raw": "disallowed", "types": "disallowed", "kept": None}


def test_gate(spark):
    rows = [("warning", "warning", "async cycle: a"), ("warning", "warning", "exempt stale: x")]
    df = spark.createDataFrame(rows, "category string, severity string, message string")
    assert checks.gate(df) and not checks.gate(df, strict=True) and checks.gate(df.limit(1), strict=True)


def test_gitignore(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.log", "a/keep.log", "b/out/z", "b/src/z", "c/d/e.tmp", "top.tmp")], "path string")
    rows = [("", 1, "*.log", False), ("a", 1, "keep.log", True), ("", 2, "out/", False), ("", 3, "/c/**/e.tmp", False), ("", 4, "/top.tmp", False), ("", 5, "top.tmp", True)]
    got = {r.path for r in trees.ignored(files, spark.createDataFrame(rows, "base string, line int, pattern string, negated boolean")).collect()}
    assert got == {"a/x.log", "b/out/z", "c/d/e.tmp"}


def test_python_tree(spark, tmp_path):
    files = {
        "app/__init__.py": "",
        "app/core.py": "import os\nimport requests\nfrom . import util\nfrom app.util import helper\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from app.late import T\nbus.publish('orders', 1)\nNAME = 'x'\n",
        "app/util.py": "def helper(): pass\n",
        "app/late.py": "class T: pass\n",
        "app/broken.py": "def (:\n",
    }
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    read = python_source.read_tree(spark, str(tmp_path))
    facts = python_source.parse(read)
    edges, external = python_source.resolve(facts, read)
    assert {(r.src, r.dst, r.type_only) for r in edges.collect()} == {("app/core.py", "app/util.py", False), ("app/core.py", "app/late.py", True)}
    assert {tuple(r) for r in external.collect()} == {("app/core.py", "requests")}
    kinds = {(r.kind, r.name, r.value) for r in facts.collect()}
    assert ("call", "publish", "orders") in kinds and ("property", "NAME", "x") in kinds and any(k == "error" for k, *_ in kinds)


def test_model_json_round_trip(spark, tmp_path):
    units = spark.createDataFrame([("a", "crate", "a"), ("b", "crate", "b")], "name string, kind string, path string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    mods = spark.createDataFrame([("a", "a::x", "b::y", ["S"], False)], "unit string, src string, dst string, symbols array<string>, type_only boolean")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    more = {
        "modules": table([("a", "a::x"), ("b", "b::y")], "unit string, path string"),
        "file_edges": table([("a", "a/x.rs", "b/y.rs", "use", False)], TABLES["file_edges"]),
        "file_modules": table([("a/x.rs", "a::x")], TABLES["file_modules"]),
        "externals": table([("a::x", "serde"), ("a::x", "log")], TABLES["externals"]),
        "exports": table([("a", "S", "resolved")], TABLES["exports"]),
        "shown": table([("a::x", "S")], TABLES["shown"]),
        "roles": table([("a::x", "facade")], TABLES["roles"]),
        "manifests": table([("a", None, ["serde"], ["slim"])], TABLES["manifests"]),
        "module_decls": table([("a", "x", "slim", "x.rs"), ("a", "z", None, "z.rs")], TABLES["module_decls"]),
        "test_gated": table([("a::t",)], "path string"),
        "async_edges": table([("a", "b", "e", "publish")], TABLES["async_edges"]),
    }
    facts = FactSet(spark, "rust", {"units": units, "unit_edges": edges, "module_edges": mods, **more})
    model = model_json.model_of(facts)
    (tmp_path / "m.json").write_text(render.canonical_json(model))
    back = model_json.ModelFacts(spark, str(tmp_path / "m.json")).fact_set()
    assert model_json.model_of(back) == model and set(back.tables) == set(facts.tables)
    (tmp_path / "n.json").write_text('{"language": "go"}')
    none = model_json.ModelFacts(spark, str(tmp_path / "n.json")).fact_set()
    assert none.language == "go" and not none.has("roles") and none.roles.count() == 0


@pytest.mark.parametrize(
    "text",
    ["x = 1", "[project]\nlang = 'rust'", "[[module]]\nname='a'\n[[module]]\nname='a'", "[[constraint]]\ntype='nope'", "[[exempt]]\ncycle='a'\ntier='unit'\nreason='r'", "[[module]]\nname='a'\nallowed={depend_on=[{target='b', type_only='maybe'}]}", "[[pattern_pair]]\nid='p'\nemit={language='go', call='a', property='b'}\nsubscribe={language='go', call='c'}"],
)
def test_bad_specs_are_refused(text):
    with pytest.raises(rules.InvalidSpec):
        rules.load_spec(text)


def test_a_rule_for_both_tiers_is_allowed():
    assert rules.load_spec("[[exempt]]\ncycle='a'\ntier='both'\nreason='r'").exempt[0]["tier"] == "both"


def test_renderers():
    assert render.fnv1a("") == 0xCBF29CE484222325 and render.fnv1a("a") == 0xAF63DC4C8601EC8C
    text = render.mermaid(["core", "a::b"], [("core", "a::b", "direct"), ("a::b", "core", "async")])
    assert text.splitlines()[0] == "graph TD" and f"core --> {render.identifier('a::b')}" in text
    assert "@enduml" in render.plantuml(["x"], [])
    assert render.tree(["a::b", "a::c"]).count("subgraph") == 1
    spec = rules.load_spec(render.seed_spec("rust", {"app": ["shared"], "shared": []}, {"app::core": ["app::ui"]}, {"slim": ["app::x"]}))
    assert [c.name for c in spec.claims] == ["app", "shared", "app::core"] and spec.constraints[-1]["type"] == "no_cycles"
    assert render.exempt_entries([("a -> a", "module")], [("a -> a", "module")], "r") == ""
    assert "repro: a -> b -> a (runtime)" in render.ring_reproduction([["a", "b", "a"]])
    assert render.findings_text([]) == "verify: PASS\n"


def test_submodules_of_nothing(spark):
    mods = spark.createDataFrame([("a", "a::b")], "unit string, path string")
    edges = spark.createDataFrame([], "src string, dst string")
    with pytest.raises(ValueError):
        views.submodules(mods, edges, "zzz")


def test_file_modules(spark):
    rows = [("crates/a/src/x/mod.rs", "a", "crates/a"), ("crates/a/src/lib.rs", "a", "crates/a"), ("p/src/q/r.ts", "p", "p")]
    got = spark.createDataFrame(rows, "f string, u string, r string").select(P.file_module("f", "u", "r").alias("m"))
    assert [r.m for r in got.collect()] == ["a::x", "a", "p::q::r"]


def test_simple_ring_and_local_path():
    out = {"a": ["b"], "b": ["c", "a"], "c": ["b"]}
    assert graph.simple_ring(["a", "b", "c"], out) == ["a", "b", "a"]
    assert graph.shortest_path([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "a", "d") == ["a", "b", "d"]
