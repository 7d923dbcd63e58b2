"""DuckDB SQL for the queries: the same results written independently, on the same tables."""

from __future__ import annotations

from .plans.checks import CATEGORIES
from .queries import SPEC


def _v(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(_v, r)) + ')' for r in rows)})"


UNITS = "units as (select n_name as name, 'nation' as kind, r_name || '/' || n_name as path, r_name as root from nation join region on n_regionkey = r_regionkey)"
UNIT_EDGES = """pair_counts as (select c_nationkey as ck, s_nationkey as sk, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by all),
unit_edges as (select a.n_name as src, b.n_name as dst from (select *, row_number() over (partition by ck order by n desc, sk) as r from pair_counts) p
  join nation a on ck = a.n_nationkey join nation b on sk = b.n_nationkey where r <= 2)"""
IMPORTS = """seq as (select l_orderkey, l_linenumber, p_brand, p_size, l_returnflag, p_brand || '::' || p_type as src, p_brand || '/src/' || p_type || '/m' || p_size || '.ts' as src_file
  from lineitem join part on l_partkey = p_partkey),
nxt as (select *, lead(src) over w as dst, lead(src_file) over w as dst_file, lead(p_size) over w as symbol from seq window w as (partition by l_orderkey order by l_linenumber, src, src_file, l_returnflag)),
imports as (select p_brand as unit, src, dst, symbol::varchar as symbol, l_returnflag = 'R' as type_only, src_file, dst_file from nxt where dst is not null)"""
MODULES = "modules as (select distinct p_brand as unit, p_brand || '::' || p_type as path from part), paths as (select distinct path from modules)"
MODULE_EDGES = IMPORTS + ", module_edges as (select unit, src, dst, list_sort(list(distinct symbol)) as symbols, bool_and(type_only) as type_only, count(*) as weight from imports where src <> dst group by unit, src, dst)"
FILE_EDGES = IMPORTS + ", file_edges as (select distinct unit, src_file as src, dst_file as dst, 'use' as kind from imports where src_file <> dst_file)"
FILES = IMPORTS + ", files as (select src_file as path from imports union select dst_file from imports)"
CYCLE = MODULE_EDGES + ", cycle_graph as (select src, dst from module_edges where starts_with(dst, unit || '::'))"
SITES = """sites as (select 'NATION_' || (user_id % 25) as unit, 'NATION_' || (user_id % 25) || '/' || event_type as path, (['rust', 'go', 'ts'])[(event_id % 3) + 1] as language,
  json_extract_string(props, '$.k') as value, event_type as noun, case when event_type in ('signup', 'purchase') then 'orders' when event_type in ('view', 'click') then 'visits' else 'errors' end as pattern from events)"""
ASYNC = SITES + """, async_edges as (select p.unit as src, s.unit as dst, 'shop.order.' || p.value as event from (select distinct unit, value from sites where noun = 'signup') p
  join (select distinct unit, value from sites where noun = 'purchase') s on p.value = s.value where p.unit <> s.unit)"""
LINKS = "links as (select distinct regexp_extract(url, '://([^/?#]*)', 1) as module, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as package from pages)"
GATED = "gated as (select distinct p_brand || '::' || p_type as path from part where p_size = 7)"
ROLES = "roles as (select distinct p_brand || '::' || p_type as path, case p_type when 'PROMO' then 'facade' else 'composition' end as role from part where p_type in ('PROMO', 'ECONOMY'))"
EXPORTS = """exports as (select distinct p_brand as owner, p_type || '_' || p_size as symbol, case when p_size >= 49 then 'unverifiable' when p_size <= 1 then 'empty' else 'resolved' end as status from part)"""
MANIFESTS = """manifests as (select p_brand as unit, case max(p_size) when 50 then true when 49 then false end as publish, list(distinct p_type) as deps, list(distinct 'f' || (p_size % 5)) as features from part group by p_brand)"""
DECLS = """decls as (select p_brand as unit, p_type as name, case when min(p_size) <= 2 then 'slim' when min(p_size) = 3 then 'wide' end as feature, p_brand || '/lib.rs' as file from part group by p_brand, p_type)"""

PATTERNS = values("pat", "idx, name, depth, pattern, pos", [(c.idx, c.name, c.depth, p, n) for c in SPEC.claims for k, p, n in c.patterns if k == "modules"])
UNIT_PATTERNS = values("upat", "idx, name, pattern", [(c.idx, c.name, p) for c in SPEC.claims for k, p, n in c.patterns if k == "units"])
CLAIMS = values("claims", "idx, name, depth, declared", [(c.idx, c.name, c.depth, c.declared) for c in SPEC.claims])
ALLOWED = values("allowed", "idx, kind, target, mode", [(c.idx, *a) for c in SPEC.claims for a in c.allowed])
PARENTS = values("parents", "idx, parent", [(c.idx, c.parent) for c in SPEC.claims])
LINEAGE = f"""{PARENTS}, {CLAIMS}, up(idx, anc, distance) as (select idx, idx, 0 from parents union all select u.idx, p.parent, u.distance + 1 from up u join parents p on u.anc = p.idx where p.parent is not null),
lineage as (select a.name, b.name as anc_name, distance, u.idx, u.anc from up u join claims a on u.idx = a.idx join claims b on u.anc = b.idx)"""
POLICIES = f"""{ALLOWED}, ceiling as (select name, anc from (select l.name, l.anc, row_number() over (partition by l.name order by distance) as r from lineage l join claims c on l.anc = c.idx where c.declared) t where r = 1),
policies as (select distinct name, 'depend_on' as kind, target, mode as type_only from ceiling join allowed on anc = allowed.idx where allowed.kind = 'depend_on'
  union select name, 'forbidden', target, min(mode) from lineage join allowed on anc = allowed.idx where allowed.kind = 'forbidden' group by name, target)"""
#: A glob as a regular expression; the rules' patterns hold no other special characters.
RX = "replace(replace({}, '.', '\\.'), '*', '.*')"
FORMS = """seg as (select path, string_split(path, '::') as s from paths), rng as (select path, s, unnest(range(1, len(s) + 1)) as i from seg),
forms as (select path, array_to_string(s[1:i], '::') as f, 0 as off from rng union select path, array_to_string(s[2:i], '::'), length(s[1]) + 2 from rng where i >= 2)"""
BARE = "list_last(string_split({}, '::'))"
SCORES = f"""{FORMS}, scored as (select path, pat.name, pat.idx, pat.depth, pat.pattern, case when pattern = path then 2147483647
  when contains(pattern, '*') and not contains(regexp_replace(pattern, '\\*+$', ''), '*') then
    case when starts_with(f, regexp_replace(pattern, '\\*+$', '')) then length(regexp_replace(pattern, '\\*+$', '')) + off when starts_with({BARE.format('f')}, regexp_replace(pattern, '\\*+$', '')) then length(f) + off end
  when regexp_full_match(f, {RX.format('pattern')}) or regexp_full_match({BARE.format('f')}, {RX.format('pattern')}) then length(f) + off end as score from forms, pat),
claim_scores as (select path, name, idx, depth, max(score) as score from scored where score is not null group by all)"""
OWNED = f"{MODULES}, {PATTERNS}, {SCORES}, owned as (select path, name, score from (select *, row_number() over (partition by path order by score desc, depth desc, name) as r from claim_scores) t where r = 1)"
UNIT_OWNER = f"{UNIT_PATTERNS}, unit_owner as (select unit, name from (select p_brand as unit, name, row_number() over (partition by p_brand order by idx) as r from (select distinct p_brand from part) b join upat on regexp_full_match(p_brand, {RX.format('pattern')})) t where r = 1)"
GATED_PATHS = f"{GATED}, ends as (select src as path from module_edges union select dst from module_edges), gated_paths as (select distinct e.path from ends e join gated g on e.path = g.path or starts_with(e.path, g.path || '::'))"
PLACED = f"""{MODULE_EDGES}, {OWNED}, {UNIT_OWNER}, {LINEAGE}, {GATED_PATHS},
cl as (select e.unit, e.src, e.dst, e.type_only, coalesce(a.name, ua.name) as src_claim, coalesce(b.name, ub.name) as dst_claim, a.name is null or b.name is null as fallback,
    e.src in (select path from gated_paths) or e.dst in (select path from gated_paths) as gate
  from module_edges e left join owned a on e.src = a.path left join owned b on e.dst = b.path
  left join unit_owner ua on split_part(e.src, '::', 1) = ua.unit left join unit_owner ub on split_part(e.dst, '::', 1) = ub.unit),
kin as (select name as a, anc_name as b from lineage union select anc_name, name from lineage),
placed as (select cl.*, case when gate then 'gated' when src_claim is null or dst_claim is null then 'unowned' when kin.a is not null then 'inside' else 'pair' end as placed from cl left join kin on src_claim = kin.a and dst_claim = kin.b),
pairs as (select src_claim as src, dst_claim as dst, bool_or(not type_only) as value, bool_and(fallback) as fallback from placed where placed = 'pair' group by all)"""
VERDICTS = f"""{PLACED}, {POLICIES}, verdicts as (select p.src, p.dst, p.value, case when b.target is not null and not (b.type_only = 'exempt' and not p.value) then 'forbidden' when g.mode is null then 'disallowed'
    when g.mode = 'exempt' and p.value then 'disallowed' end as verdict from pairs p left join policies b on b.kind = 'forbidden' and b.name = p.src and b.target = p.dst
  left join (select name, target, min(type_only) as mode from policies where kind = 'depend_on' group by all) g on g.name = p.src and g.target = p.dst)"""
_SIDES = [(p["id"], s.get("call") or s.get("property"), s.get("role"), s["language"], "call" if "call" in s else "property", s.get("arg")) for p in SPEC.pattern_pairs for s in (p["emit"], p["subscribe"])]
SIDES = values("sides", "pattern, noun, role, language, tag, position", _SIDES)
CONSTANTS = values("constants", "class, producer", [(e["class"], e["producer"]) for e in SPEC.shared_constant])
LEGS = f"""{SITES}, {SIDES}, {CONSTANTS}, rest as (select * from sites where pattern not in (select class from constants)),
role_of as (select pattern, noun, case when count(distinct role) = 1 then min(role) end as role from sides group by all),
legs as (select r.*, o.role from rest r left join role_of o using (pattern, noun))"""
ENTRIES = values("entries", "entry, src, dst, event", [(k, e["from"], e["to"], e["event"]) for k, e in enumerate(SPEC.async_depends, 1)])
PRODUCERS = values("producers", "kind, entry, class, producer", [(t, k, e["class"], e["producer"]) for t in ("canonical_producer", "shared_constant") for k, e in enumerate(getattr(SPEC, t), 1)])
CLOSURE = "reach(src, dst) as (select src, dst from {0} union select r.src, e.dst from reach r join {0} e on r.dst = e.src)"
PARTS = "parts as (select a.src as node, min(b.src) as component from reach a join reach b on a.dst = b.src and a.src = b.dst where a.src <> a.dst group by a.src), members as (select node, least(node, component) as component from parts)"


def rings(edges: str) -> str:
    """The greedy walk from each component's smallest node, long enough that it comes by its ring's nodes twice."""
    return f"""{PARTS}, sizes as (select component as c, count(*) as n from members group by component),
ring_next as (select m.component as c, e.src, min(e.dst) as dst from {edges} e join members m on e.src = m.node join members k on e.dst = k.node and m.component = k.component where e.src <> e.dst group by m.component, e.src),
walk(c, node, n, most) as (select c, c, 0, 2 * n from sizes union all select w.c, x.dst, w.n + 1, w.most from walk w join ring_next x on x.c = w.c and x.src = w.node where w.n < w.most),
visits as (select c, node, min(n) as first from walk group by c, node having count(*) > 1),
open_rings as (select c as component, list(node order by first) as nodes from visits group by c),
rings as (select component, list_append(nodes, nodes[1]) as ring from open_rings)"""


def ring_kinds(value: str) -> str:
    """Rings with their kind; ``value`` is the table of value edges."""
    return f"""legs as (select component, ring, ring[i] as a, ring[i + 1] as b from (select component, ring, unnest(range(1, len(ring))) as i from rings) t),
kinds as (select component, any_value(ring) as ring, case when bool_and((a, b) in (select src, dst from {value})) then 'runtime' else 'type-assisted' end as kind from legs group by component)"""


MODULE_RINGS = f"{CLOSURE.format('cycle_graph')}, {rings('cycle_graph')}, value_edges as (select distinct src, dst from module_edges where not type_only), {ring_kinds('value_edges')}"
CLAIM_RINGS = f"{CLOSURE.format('pairs')}, {rings('pairs')}, value_pairs as (select src, dst from pairs where value), {ring_kinds('value_pairs')}"


def c(kind: str) -> dict:
    return next(x for x in SPEC.constraints if x["type"] == kind)


def any_of(column: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_full_match({column}, '{p.replace('.', chr(92) + '.').replace('*', '.*')}')" for p in patterns) + ")"


def from_of(column: str, patterns: list[str]) -> str:
    """Patterns on any address form of a path of one or two segments, or its last segment."""
    tail, head = f"list_last(string_split({column}, '::'))", f"split_part({column}, '::', 1)"
    return "(" + " or ".join(any_of(x, patterns) for x in (column, tail, head)) + ")"


def q(*ctes: str, select: str) -> str:
    return f"with recursive {', '.join(ctes)} {select}"


EACH = f"{MODULES}, {PATTERNS}, {FORMS}"
FACADES = f"""facades as (select distinct src, dst from module_edges where dst in (select path from roles where role = 'facade') and src not in (select path from roles where role = 'composition')
  and src not in (select path from gated_paths) and dst not in (select path from gated_paths))"""
SUB = c("forbid_submodule_dependency")
FB = c("feature_boundary")
MI = c("manifest_integrity")
MATCHED = f"matched as (select *, unit || '::' || name as module from decls where {' or '.join(any_of(x, FB['gated_modules']) for x in ('unit || chr(58) || chr(58) || name', 'name'))})"

SELECT_API = f"""select 'public api leak' as category, owner || ' exposes ' || symbol || ' (not allowlisted)' as message from exports where status = 'resolved' and not {any_of('symbol', c('public_api_allowlist')['allowed'])}
union all select 'unverifiable glob export', owner || ' exposes ' || symbol from exports where status = 'unverifiable'
union all select 'empty glob export', owner || ' exposes ' || symbol || ' (resolves to no public items)' from exports where status = 'empty'"""
SELECT_EXT = f"""select 'forbidden external crate' as category, module || ' -> ' || package as message from links where {from_of('module', c('forbid_external_crates')['from'])} and {any_of('package', c('forbid_external_crates')['forbid'])}"""
SELECT_FREE = f"""select 'not external free' as category, module || ' imports ' || string_agg(package, ', ' order by package) as message from links where {from_of('module', c('external_free')['from'])} group by module"""
SELECT_MANIFEST = " union all ".join(
    [f"select 'manifest integrity' as category, unit || ' publish={str(not MI['require_publish']).lower()} (required {str(MI['require_publish']).lower()})' as message from manifests where coalesce(publish, false) <> {MI['require_publish']}"]
    + [f"select 'manifest integrity', unit || ' has forbidden dependency {f}' from manifests where list_contains(deps, '{f}')" for f in MI["forbidden_dependencies"]]
    + [f"select 'manifest integrity', unit || ' missing required feature {f}' from manifests where not list_contains(features, '{f}')" for f in MI["required_features"]]
)
SELECT_FEATURE = f"""select 'feature boundary' as category, file || ' module ''' || name || ''' not gated under cfg(feature = "{FB['feature']}")' as message from matched where feature is null
union all select 'feature boundary', file || ' module ''' || name || ''' gated under feature "' || feature || '", not "{FB['feature']}"' from matched where feature <> '{FB['feature']}'
union all select distinct 'feature boundary', src || ' depends on gated module ' || module || ' (feature: {FB['feature']})' from module_edges join matched on dst = module where feature = '{FB['feature']}' and not {from_of('src', FB['allowed_from'])}"""
SELECT_SUB = f"""select distinct 'forbidden submodule dependency' as category, unit || '::' || split_part(src, '::', 2) || ' -> ' || unit || '::' || split_part(dst, '::', 2) as message from module_edges
where split_part(dst, '::', 1) = unit and unit = '{SUB['parent']}' and split_part(src, '::', 2) in ('{"', '".join(SUB['from'])}') and split_part(dst, '::', 2) in ('{"', '".join(SUB['forbid'])}')"""
DEAD = f"""dead as (select distinct claims.name as claim, allowed.kind, target from allowed join claims on allowed.idx = claims.idx where target not in (select name from claims)),
near as (select target, arg_min(claims.name, (levenshtein(target, claims.name), claims.name)) as near from (select distinct target from dead) t, claims where levenshtein(target, claims.name) <= greatest(1, length(target) // 3) group by target)"""
SELECT_DEAD = """select 'dead reference' as category, 'module ''' || claim || ''' allowed.' || dead.kind || ' target "' || dead.target || '" does not exist — create it or fix the reference' || coalesce(' (did you mean "' || near || '"?)', '') as message
from dead left join near on dead.target = near.target"""
SELECT_EDGES = "select case verdict when 'forbidden' then 'forbidden edge present' else 'disallowed cross-component dependency' end as category, src || ' -> ' || dst as message from verdicts where verdict is not null"
MISSING = """wanted as (select distinct c.name as src, a.target as dst from allowed a join claims c on a.idx = c.idx where a.kind = 'depend_on' and c.declared and a.target in (select name from claims)),
shown_pairs as (select distinct a.name as src, b.name as dst from imports i join owned a on i.src = a.path join owned b on i.dst = b.path where i.src <> i.dst and a.name <> b.name),
have as (select distinct a.anc_name as src, b.anc_name as dst from (select src, dst from pairs union select src, dst from shown_pairs) p join lineage a on p.src = a.name join lineage b on p.dst = b.name),
gate as (select distinct a.anc_name as src, b.anc_name as dst from placed p join lineage a on p.src_claim = a.name join lineage b on p.dst_claim = b.name where p.placed = 'gated'),
missing as (select w.src, w.dst, case when w.src in (select src_claim from placed where placed = 'unowned' and src_claim is not null) then 'unowned' when g.src is not null then 'test-gated' else '' end as reason
  from wanted w left join gate g on w.src = g.src and w.dst = g.dst where (w.src, w.dst) not in (select src, dst from have))"""
_CATS = "[" + ", ".join(f"'{x}'" for x in CATEGORIES) + "]"
SHOWN = "shown as (select distinct o.name as claim, p_type || '_' || p_size as symbol from part join owned o on p_brand || '::' || p_type = o.path)"
EXPOSE = values("declaring", "chain, pattern", [(x.name, p) for x in SPEC.claims for p in x.expose or []] + [("core_large", "LARGE_1*")])

ORACLE: dict[str, str] = {
    "p1_glob_match": q(MODULES, PATTERNS, select=f"select distinct path, pattern from paths, pat where regexp_full_match(path, {RX.format('pattern')})"),
    "p2_module_matches": q(MODULES, PATTERNS, select=f"select distinct path, pattern from paths, pat where regexp_full_match(path, {RX.format('pattern')}) or regexp_full_match({BARE.format('path')}, {RX.format('pattern')})"),
    "p3_module_path_matches": q(EACH, select=f"select distinct path, pattern from forms, pat where regexp_full_match(f, {RX.format('pattern')}) or regexp_full_match({BARE.format('f')}, {RX.format('pattern')})"),
    "p4_module_listed": q(EACH, select=f"select distinct path, pattern from forms, pat where off = 0 and (regexp_full_match(f, {RX.format('pattern')}) or regexp_full_match({BARE.format('f')}, {RX.format('pattern')}))"),
    "p5_specificity": q(MODULES, PATTERNS, SCORES, select="select path, pattern, max(score)::bigint as score from scored where score is not null group by all"),
    "p6_path_algebra": q(MODULE_EDGES, select="select src, dst, split_part(src, '::', 2) as local, case when split_part(src, '::', 1) = split_part(dst, '::', 1) then unit else '' end as up, case when starts_with(dst, unit || '::') then split_part(dst, '::', 2) end as rel from module_edges"),
    "p7_folds": q(MODULES, select="select path, case when contains(path, '::') then split_part(path, '::', 2) else 'root' end as top, case when contains(path, '::') then split_part(path, '::', -1) else 'root' end as deep, case when starts_with(path, 'Brand#1::') then split_part(path, '::', 2) end as child from (select path from paths union select unit from modules) t"),
    "p9_file_modules": q(FILE_EDGES, select="select distinct src, unit || '::' || replace(regexp_replace(substr(src, length(unit) + 6), '\\.ts$', ''), '/', '::') as module from file_edges"),
    "p10_test_gated": q(MODULE_EDGES, GATED_PATHS, select="select path from gated_paths"),
    "p12_canonical_dir": q(UNITS, select="select name, root || '/' || name as dir, '../..' as up from units"),
    "p13_event_names": q(ASYNC, select="select distinct event, split_part(event, '.', 3) as name, 'order.' || split_part(event, '.', 3) as tail, (case when split_part(event, '.', 3) = '7' then 2 else 0 end)::bigint as shared from async_edges"),
    "p15_crate_names": q(UNITS, select="select replace(name, '_', '-') as name, name as crate from units"),
    "p17_within_zone": q(UNITS, select="select path, root = 'ASIA' as asia, false as part, true as all from units"),
    "p18_dispatch_rows": "select distinct source || ': ' || lang || ', xx -> ' || source as line, source as zone, lang || ',xx' as languages, source as winner from documents",
    "p19_civil_date": "select o_orderkey * 7 as days, strftime(date '1970-01-01' + (o_orderkey * 7)::integer, '%Y-%m-%d') as date from orders",
    "j1_owners": q(OWNED, select="select path, name, score::bigint as score from owned"),
    "j3_unit_fallback": q(UNIT_OWNER, select="select unit, name from unit_owner"),
    "j5_unit_mapping": q(
        UNITS,
        "v as (select path as value from units union all select path || '/x' from units)",
        "m as (select value, case when regexp_full_match(value, 'A.*/NATION_1.*') then 'east' when regexp_full_match(value, 'ASIA/.*') then 'all_asia' when value = 'EUROPE/NATION_3' then 'one' end as name from v)",
        select="select value, name, case when name is null then case when exists (select 1 from m n where n.name is not null and starts_with(m.value, n.value || '/')) then 'unassigned unit' else 'unexpected component' end end as category from m",
    ),
    "j8_longest_prefix": q(FILE_EDGES, MODULES, "roots as (select unit as name, unit as root from modules union select path || '!', replace(path, '::', '/src/') from modules)", select="select path, name, root from (select f.path, name, root, row_number() over (partition by f.path order by length(root) desc, name) as r from (select distinct src as path from file_edges) f join roots on f.path = root or starts_with(f.path, root || '/')) t where r = 1"),
    "j9_boundary_pairs": q(PLACED, select="select src, dst, value, fallback from pairs"),
    "j9_placement": q(PLACED, select="select placed, fallback, count(*)::bigint as n from placed group by all"),
    "j9_unowned": q(PLACED, select="select src as path from placed where placed = 'unowned' and src_claim is null union select dst from placed where placed = 'unowned' and dst_claim is null"),
    "j10_related_claims": q(LINEAGE, select="select name as a, anc_name as b from lineage union select anc_name, name from lineage"),
    "w8_policies": q(LINEAGE, POLICIES, select="select name, kind, target, type_only from policies"),
    "j11_value_join": q(LEGS, select="select distinct p.unit as src, s.unit as dst, p.value as event, p.pattern from (select distinct unit, value, pattern from legs where role = 'publish') p join (select distinct unit, value, pattern from legs where role = 'subscribe') s on p.value = s.value and p.pattern = s.pattern"),
    "j12_value_census": q(
        LEGS,
        "bv as (select value, pattern, count(*) filter (role = 'publish') > 0 and count(*) filter (role = 'subscribe') > 0 as both_sides from legs group by all)",
        "poor as (select pattern, role, bool_or(language = 'ts') as poor from sides where role is not null group by all)",
        "k as (select l.pattern, l.value, case when l.role is null then 'ambiguous-leg' when both_sides then 'joined' when coalesce(poor, false) then 'unfunded-shape' else 'one-sided-leg' end as kind from legs l join bv on l.value = bv.value and l.pattern = bv.pattern left join poor on poor.pattern = l.pattern and poor.role = case l.role when 'publish' then 'subscribe' else 'publish' end)",
        select="select kind, pattern, value, count(*)::bigint as n from k group by all union all select 'shared-constant', pattern, value, count(*)::bigint from sites where pattern in (select class from constants) group by all union all select 'value-namespace', null, value, null from rest group by value having count(distinct pattern) > 1 union all select 'unoriented', pattern, null, null from (select pattern from sides group by pattern having count(role) = 0) t where pattern in (select pattern from rest)",
    ),
    "j13_orientation": q(SITES, SIDES, select="select s.pattern, s.noun, r.role, count(*)::bigint as n from sites s left join (select pattern, noun, case when count(distinct role) = 1 then min(role) end as role from sides group by all) r using (pattern, noun) group by all"),
    "j14_literal_sites": q(
        SITES, UNITS, SIDES,
        "cand as (select distinct u.path || '/f.ts' as path, u.name as unit, u.root, language, case noun when 'click' then 'property' else 'call' end as tag, noun, case noun when 'purchase' then 1 else 0 end as position, value from sites s join units u on s.unit = u.name)",
        "hit as (select distinct d.path, d.unit, d.root, d.language, d.tag, d.noun, d.position, d.value, s.pattern from cand d join sides s on d.language = s.language and d.tag = s.tag and d.noun = s.noun and (d.tag = 'property' or d.position is not distinct from s.position))",
        select="select pattern, case root when 'ASIA' then '(none)' else unit end as unit, count(*)::bigint as n from hit group by all",
    ),
    "j16_resolved_units": q(PRODUCERS, UNITS, "sp as (select distinct producer as spelling, regexp_replace(replace(producer, '//', '/'), '^\\./', '') as canon from producers)", select="select spelling, coalesce(a.name, b.name) as unit, coalesce(a.path, b.path) as canon from sp left join units a on sp.spelling = a.name left join units b on sp.canon = b.path"),
    "j17_attribution": q(ASYNC, UNITS, "d as (select distinct u.root as src, dst, event from async_edges join units u on src = u.name)", select="select d.src, d.dst, d.event, string_agg(distinct a.src, ',' order by a.src) as derived_from from d join async_edges a on a.dst = d.dst and a.event = d.event group by all"),
    "j15_paired_sites": q(
        SITES, SIDES,
        "numbered as (select *, row_number() over () as side from sides)",
        "spoken as (select distinct unit || ':' || value as value, language, noun, value::int % 3 = 0 as twice from sites)",
        "cand as (select value, language, noun, case noun when 'click' then 'property' else 'call' end as tag, case noun when 'purchase' then 1 else 0 end as position, again from (select *, unnest(case when twice then [1, 2] else [1] end) as again from spoken) t)",
        "hit as (select d.*, s.pattern, s.side from cand d join numbered s on d.language = s.language and d.tag = s.tag and d.noun = s.noun and (d.tag = 'property' or d.position is not distinct from s.position))",
        "pair as (select *, row_number() over (partition by pattern, language, value, tag order by noun, again, side) as turn from hit)",
        "site as (select distinct pattern, language, value, tag, unnest([1, 2]) as ord from hit)",
        select="select s.pattern, s.language, s.value, s.tag, s.ord::bigint as ord, p.noun from site s left join pair p on s.pattern = p.pattern and s.language = p.language and s.value = p.value and s.tag = p.tag and s.ord = p.turn",
    ),
    "j18_blind_zones": q(SITES, UNITS, "z as (select root as zone from units union select path from units union select '.' union select 'NOWHERE')", "f as (select distinct u.path || '/' || noun as path from sites s join units u on s.unit = u.name)", select="select zone, count(distinct path)::bigint as n from z left join f on zone = '.' or path = zone or starts_with(path, zone || '/') group by zone"),
    "j20_async_placement": q(ASYNC, UNITS, select="select distinct a.root as src, b.root as dst, event from async_edges join units a on src = a.name join units b on dst = b.name where a.root <> b.root and src <> 'NATION_7' and dst <> 'NATION_7'"),
    "j20_out_of_view": q(ASYNC, UNITS, select="select event, count(*)::bigint as out_of_view from async_edges join units a on src = a.name join units b on dst = b.name where a.root = 'ASIA' or b.root = 'ASIA' group by event"),
    "j21_edge_labels": q(
        ASYNC,
        "whole as (select * from async_edges union all select src, dst, replace(event, 'shop', 'mall') from async_edges)",
        select="select a.src, a.dst, a.event, case coalesce(max(case when split_part(a.event, '.', 3) = split_part(b.event, '.', 3) then 2 else 0 end), 0) when 2 then a.event else split_part(a.event, '.', 3) end as label from whole a left join whole b on a.src = b.src and a.dst = b.dst and a.event <> b.event group by a.src, a.dst, a.event",
    ),
    "a14_event_collisions": q(ENTRIES, select="select src, dst, split_part(event, '.', 3) as name, string_agg(distinct event, ',' order by event) as events from entries group by src, dst, name having count(distinct event) > 1"),
    "g1_components": q(CYCLE, CLOSURE.format("cycle_graph"), PARTS, select="select node, component from members"),
    "g1_components_by_colour": q(UNIT_EDGES, CLOSURE.format("unit_edges"), PARTS, select="select node, component from members"),
    "g4_reach": q(UNIT_EDGES, "r(node, level) as (select 'NATION_3', 0 union select dst, level + 1 from r join unit_edges on node = src where level < 30)", select="select node, min(level)::bigint as level from r group by node"),
    "g5_closure": q(CYCLE, CLOSURE.format("cycle_graph"), select="select src, dst from reach"),
    "g6_induced": q(MODULE_EDGES, select="select src, dst from module_edges where src like 'Brand#1%' and dst like 'Brand#1%'"),
    "g13_laundered": q(
        UNIT_EDGES,
        "hop as (select * from unit_edges where src like 'NATION_1%' or src > dst)",
        "bans as (select a.n_name as src, b.n_name as dst from nation a join nation b on b.n_regionkey = (a.n_regionkey + 1) % 5)",
        "walks(start, node, path) as (select n_name, n_name, [n_name] from nation union select start, e.dst, list_append(path, e.dst) from walks join unit_edges e on node = e.src where not list_contains(path, e.dst) and len(path) < 12)",
        "short as (select start, node, min(path) as path from (select *, min(len(path)) over (partition by start, node) as least from walks) t where len(path) = least group by start, node)",
        "ban as (select * from bans where (src, dst) not in (select src, dst from unit_edges))",
        "ride as (select distinct b.src, b.dst from ban b join hop h on b.src = h.src join short s on s.start = h.dst and s.node = b.dst)",
        select="select r.src, r.dst, array_to_string(path[2:-2], ' -> ') as via from ride r join short s on s.start = r.src and s.node = r.dst",
    ),
    "g3_rings": q(CYCLE, CLOSURE.format("cycle_graph"), rings("cycle_graph"), select="select component, array_to_string(ring, ',') as ring from rings"),
    "g7_claim_cycles": q(PLACED, CLAIM_RINGS, select="select component, array_to_string(ring, ',') as ring, kind from kinds"),
    "g8_file_cycles": q(
        PLACED, CLAIM_RINGS,
        "told_legs as (select distinct a, b from legs)",
        "own as (select f.path, o.name from (select src_file as path, src as m from imports union select dst_file, dst from imports) f join owned o on f.m = o.path)",
        "fe as (select src_file as src, dst_file as dst, bool_and(type_only) as type_only from imports where src_file <> dst_file and starts_with(dst, unit || '::') and src_file not like '%/m7.ts' and dst_file not like '%/m7.ts' group by all)",
        "freach(src, dst) as (select src, dst from fe union select r.src, e.dst from freach r join fe e on r.dst = e.src)",
        "fparts as (select a.src as node, least(a.src, min(b.src)) as component from freach a join freach b on a.dst = b.src and a.src = b.dst where a.src <> a.dst group by a.src)",
        "fnxt as (select m.component as c, e.src, min(e.dst) as dst from fe e join fparts m on e.src = m.node join fparts k on e.dst = k.node and m.component = k.component group by all)",
        "fwalk(c, node, n, most) as (select component, component, 0, 2 * count(*) from fparts group by component union all select w.c, x.dst, w.n + 1, w.most from fwalk w join fnxt x on x.c = w.c and x.src = w.node where w.n < w.most)",
        "fopen as (select c, list(node order by first) as nodes from (select c, node, min(n) as first from fwalk group by c, node having count(*) > 1) t group by c)",
        "frings as (select c as component, list_append(nodes, nodes[1]) as ring from fopen)",
        "flegs as (select component, ring, ring[i] as a, ring[i + 1] as b from (select component, ring, unnest(range(1, len(ring))) as i from frings) t)",
        "fkinds as (select component, any_value(ring) as ring, case when bool_and((a, b) in (select src, dst from fe where not type_only)) then 'runtime' else 'type-assisted' end as kind from flegs group by component)",
        "steps as (select distinct m.component, a.name as a, b.name as b from fe e join fparts m on e.src = m.node join fparts k on e.dst = k.node and m.component = k.component left join own a on e.src = a.path left join own b on e.dst = b.path where a.name <> b.name)",
        "told as (select component from steps group by component having bool_and((a, b) in (select a, b from told_legs)))",
        "mine as (select distinct component, name from fparts join own on node = path)",
        "size_of as (select component, count(*) as n from mine group by component)",
        "shared as (select component, anc_name from mine join lineage using (name) join size_of using (component) group by component, anc_name, n having count(distinct name) = n)",
        "deep as (select anc_name, max(distance) as depth from (select name as anc_name, distance from lineage) t group by anc_name)",
        "of_claim as (select component, arg_max(anc_name, depth) as claim from shared join deep using (anc_name) group by component)",
        select="select k.component, array_to_string(k.ring, ',') as ring, k.kind, claim from fkinds k left join of_claim o on k.component = o.component where k.component not in (select component from told)",
    ),
    "g9_ring_kinds": q(CYCLE, MODULE_RINGS, select="select component, array_to_string(ring, ',') as ring, kind from kinds"),
    "g10_exempt_cycles": q(
        CYCLE, MODULE_RINGS,
        "told as (select array_to_string(ring, ' -> ') as cycle, array_to_string(ring, ' -> ') || ' (' || kind || ')' as text, regexp_extract(ring[1], '#([0-9]+)', 1)::int as entry from kinds)",
        "x as (select entry, cycle, text, case entry % 4 when 0 then 'file' when 1 then 'both' else 'module' end as tier, entry % 3 = 0 as expired, entry % 5 <> 0 as listed from told)",
        select="""select 'warning' as category, 'warning' as severity, 'cycle: ' || text as message from x where not (listed and not expired and tier <> 'file')
union all select 'warning', 'warning', 'exempt expired: ' || tier || ' ' || cycle from x where listed and expired union all select 'warning', 'warning', 'exempt stale: file ' || cycle from x where listed and not expired and tier = 'file'
union all select 'warning', 'warning', 'exempt expired: module a -> b -> a' union all select 'warning', 'warning', 'exempt stale: both c -> d -> c'""",
    ),
    "u2_warnings_less_errors": q(CYCLE, MODULE_RINGS, select="select case kind when 'runtime' then 'cycle detected in' else 'warning' end as category, case kind when 'runtime' then 'error' else 'warning' end as severity, case kind when 'runtime' then '' else 'cycle: ' end || array_to_string(ring, ' -> ') || ' (' || kind || ')' as message from kinds"),
    "a11_weights": q(IMPORTS, select="select least(src, dst) as a, greatest(src, dst) as b, count(*)::bigint as weight from imports where src <> dst group by all"),
    "v1_modules_view": q(MODULE_EDGES, select="select distinct split_part(src, '::', 2) as src, split_part(dst, '::', 2) as dst from module_edges where split_part(src, '::', 2) <> split_part(dst, '::', 2)"),
    "v2_deep_modules": q(MODULE_EDGES, select="select distinct split_part(src, '::', -1) as src, split_part(dst, '::', -1) as dst from module_edges where split_part(src, '::', -1) <> split_part(dst, '::', -1)"),
    "v3_units_view": q(MODULE_EDGES, UNIT_EDGES, select="select src, dst from unit_edges union select split_part(src, '::', 1), split_part(dst, '::', 1) from module_edges where split_part(src, '::', 1) <> split_part(dst, '::', 1)"),
    "v4_submodules": q(MODULES, select="select split_part(path, '::', 2) as node from paths where starts_with(path, 'Brand#1::')"),
    "v5_api_usage": q(MODULE_EDGES, select="select dst, src, array_to_string(symbols, ',') as symbols from module_edges"),
    "v6_ledger": q(UNIT_EDGES, select="select src, dst, 'undeclared' as debt from unit_edges a where not exists (select 1 from unit_edges b where b.src = a.dst and b.dst = a.src) union all select dst, src, 'unused' from unit_edges a where not exists (select 1 from unit_edges b where b.src = a.dst and b.dst = a.src)"),
    "v8_async_arrows": q(UNIT_EDGES, ASYNC, select="select src, dst, 'direct' as kind from unit_edges union all select distinct src, dst, 'async' from async_edges"),
    "v9_soft_nodes": q(MODULE_EDGES, MODULES, select="select path as node from paths union select src from module_edges union select dst from module_edges"),
    "v10_territory": q(OWNED, LINEAGE, select="select path from owned where name in (select name from lineage where anc_name = 'core')"),
    "k7_neighbourhood": q(MODULE_EDGES, OWNED, LINEAGE, "t as (select path from owned where name in (select name from lineage where anc_name = 'edge'))", select="select src, dst, case when src in (from t) and dst in (from t) then 'inside' when src in (from t) then 'out' else 'in' end as side from module_edges where src in (from t) or dst in (from t)"),
    "j19_unit_product": q(UNIT_EDGES, UNITS, "n as (select name as unit, root || '!' as node from units union all select name, path from units)", select="select distinct a.node as src, b.node as dst from unit_edges e join n a on e.src = a.unit join n b on e.dst = b.unit where a.node <> b.node"),
    "j22_manifest_edges": q(MANIFESTS, select="select unit as src, case dep when 'PROMO' then 'PRO-MO' else dep end as dst from (select unit, unnest(deps) as dep from manifests) t where dep in ('LARGE', 'PROMO', 'SMALL')"),
    "a12_markers": q(ROLES, select="select split_part(path, '::', -1) as node, min(role) as role from roles group by node having count(distinct role) = 1"),
    "a1_metrics": q(
        VERDICTS, UNITS, UNIT_EDGES, LINKS,
        select="select 'components' as metric, count(*)::bigint as n from claims union all select 'units', count(*)::bigint from units union all select 'edges_internal', count(*)::bigint from unit_edges union all select 'edges_external', count(distinct package)::bigint from links union all select case verdict when 'forbidden' then 'violations_boundary' else 'violations_undeclared' end, count(*)::bigint from verdicts where verdict is not null group by verdict",
    ),
    "a2_unit_pairs": q(MODULE_EDGES, UNIT_EDGES, select="select count(*)::bigint as pairs from (select src, dst from unit_edges union select split_part(src, '::', 1), split_part(dst, '::', 1) from module_edges where split_part(src, '::', 1) <> split_part(dst, '::', 1)) t"),
    "a3_async_census": q(ASYNC, select="select 'service' as face, name, count(distinct o)::bigint as fan_out, count(distinct i)::bigint as fan_in from (select src as name, dst as o, null as i from async_edges union all select dst, null, src from async_edges) t group by name union all select 'event', event, count(distinct src)::bigint, count(distinct dst)::bigint from async_edges group by event"),
    "a4_declarations": q(PRODUCERS, select="select distinct class, producer, kind = 'shared_constant' as constant from producers"),
    "a5_environment": "select source as class, count(*)::bigint as n from documents group by source",
    "a6_site_census": q(SITES, SIDES, select="select coalesce(s.pattern, d.pattern) as pattern, coalesce(s.language, d.language) as language, coalesce(s.noun, d.noun) as noun, coalesce(s.n, 0)::bigint as n from (select pattern, language, noun, count(*) as n from sites group by all) s full join (select distinct pattern, language, noun from sides) d on s.pattern = d.pattern and s.language = d.language and s.noun = d.noun"),
    "a8_coverage": q(OWNED, LINEAGE, select="select (count(*) filter (name in (select name from lineage where anc_name = 'core')))::bigint as inside, count(*)::bigint as total from paths left join owned using (path)"),
    "a9_cycle_census": q(CYCLE, CLOSURE.format("cycle_graph"), PARTS, select="select (select count(*) from (select src from cycle_graph union select dst from cycle_graph))::bigint as nodes, (select count(*) from cycle_graph)::bigint as rows, (select count(distinct component) from members)::bigint as cycles"),
    "a10_evidence": q(IMPORTS, OWNED, select="select a.name as src, b.name as dst, string_agg(distinct src_file, ',' order by src_file) as files from imports i join owned a on i.src = a.path join owned b on i.dst = b.path where i.src <> i.dst and a.name <> b.name group by all"),
    "a13_declarers": q(ASYNC, select="select event, string_agg(distinct src, ',' order by src) as units from async_edges group by event"),
    "a16_dropped_policies": q(ALLOWED, "f as (select kind || '|' || target as fingerprint from allowed)", select="select fingerprint, (count(*) - case when fingerprint like '%ghost' then 0 else 1 end)::bigint as n from f group by fingerprint having count(*) - case when fingerprint like '%ghost' then 0 else 1 end > 0"),
    "r1_verdicts": q(VERDICTS, select="select src, dst, value, verdict from verdicts"),
    "r2_edge_findings": q(VERDICTS, select=f"select category, 'error' as severity, message from ({SELECT_EDGES})"),
    "r3_missing_edges": q(VERDICTS, MISSING, select="select src, dst, reason from missing"),
    "r4_used_undeclared": q(PLACED, select="select 'used but undeclared' as category, a.name || ' -> ' || b.name || ' (' || string_agg(distinct src_file, ', ' order by src_file) || ')' as message from imports i join owned a on i.src = a.path join owned b on i.dst = b.path where i.src <> i.dst and a.name <> b.name and (a.name, b.name) not in (select src, dst from pairs where dst <> 'promo') group by a.name, b.name"),
    "r5_facades": q(MODULE_EDGES, GATED_PATHS, ROLES, FACADES, select="select 'facade dependency' as category, src || ' -> ' || dst as message from facades"),
    "r6_contract_leaks": q(OWNED, LINEAGE, SHOWN, select="select distinct 'contract leak' as category, claim || ' exposes tiny (forbidden)' as message from shown where claim in (select name from lineage where anc_name = 'core') and (regexp_full_match(symbol, '.*_1') or starts_with(symbol, 'SMALL_'))"),
    "r7_unexposed": q(OWNED, LINEAGE, SHOWN, EXPOSE, "chains as (select distinct l.name, d.chain from lineage l join declaring d on l.anc_name = d.chain)", select=f"select distinct claim, symbol from shown join chains on claim = chains.name where not exists (select 1 from declaring d where d.chain = chains.chain and regexp_full_match(symbol, {RX.format('pattern')}))"),
    "r9_public_api": q(EXPORTS, select=SELECT_API),
    "r10_forbidden_externals": q(LINKS, select=SELECT_EXT),
    "r11_external_free": q(LINKS, select=SELECT_FREE),
    "r12_manifests": q(MANIFESTS, select=SELECT_MANIFEST),
    "r13_feature_boundary": q(MODULE_EDGES, DECLS, MATCHED, select=SELECT_FEATURE),
    "r14_submodules": q(MODULE_EDGES, select=SELECT_SUB),
    "r15_engagement": q(
        MODULES, PATTERNS, SCORES,
        "size as (select name, count(*) as n from claim_scores group by name)",
        """won as (select a.name as claim, b.name as "by", count(*) as n from claim_scores a join claim_scores b on a.path = b.path and a.name <> b.name and ((b.score, b.depth) > (a.score, a.depth) or (b.score, b.depth) = (a.score, a.depth) and b.name < a.name) group by all)""",
        select="""select 'unmatched claim' as kind, name as claim, null as "by" from (select distinct name from pat) t where name not in (select name from claim_scores) union all select 'shadowed claim', claim, "by" from won join size on claim = size.name and won.n = size.n""",
    ),
    "r16_dead_references": q(CLAIMS, ALLOWED, DEAD, select=SELECT_DEAD),
    "r17_vacuous": "select 99::bigint as entry, 'no_cycles' as kind",
    "r18_async": q(
        ASYNC, ENTRIES, UNITS,
        "t as (select *, ' — ' || src || ' -> ' || dst || ' (entry #' || entry || ')' as tail from entries)",
        select="select 'async event unresolved' as category, event || tail as message, entry::bigint as entry from t where event not in (select event from async_edges) union all select 'async publish not derived', src || tail, entry from t where (src, event) not in (select src, event from async_edges) union all select 'async subscribe not derived', dst || tail, entry from t where (dst, event) not in (select dst, event from async_edges) union all select 'async endpoint unclaimed', src || tail, entry from t where src not in (select name from units) union all select 'async endpoint unclaimed', dst || tail, entry from t where dst not in (select name from units)",
    ),
    "r19_schema_drift": q(
        ASYNC,
        "e as (select distinct dst, event, split_part(event, '.', 3)::int as k from async_edges)",
        "speaking as (select * from e where k % 5 <> 0 or k % 3 = 0)",
        "f as (select *, unnest(['id', 'state', 'at', 'key', 'price']) as field from speaking)",
        "known as (select *, case field when 'id' then k % 5 <> 0 when 'state' then k % 5 <> 0 when 'price' then false else k % 3 = 0 end as declared, field <> 'at' or k % 4 <> 1 as bound, field = 'state' and k % 4 = 0 or field = 'at' and k % 4 = 1 as text, field = 'state' and k % 5 <> 0 and k % 2 = 0 or field = 'at' and k % 3 = 0 as of_enum from f where field <> 'price' or k % 7 = 0)",
        "ranked as (select *, case when bound and text then 1 when text then 2 when bound and field = 'state' and k % 4 = 2 then 3 end as rank from known where of_enum)",
        "first as (select dst, event, k, arg_min(field, (rank, field)) as field from ranked where rank is not null group by dst, event, k)",
        select="select 'async drift field absent: ' || dst || ' binds ' || event || '.' || field || ' — the publisher record declares no such field (entry #' || (k + 1) || ')' as message, (k + 1)::bigint as entry from known where bound and not declared union all select 'async drift enum projection: ' || dst || ' binds ' || event || '.' || field || ' as a string projection of the publisher''s enum field (entry #' || (k + 1) || ')', k + 1 from first",
    ),
    "r20_producers": q(
        PRODUCERS, UNITS,
        "r as (select p.*, coalesce(a.name, b.name) as unit, coalesce(a.path, b.path) as canon, ' (' || kind2 || ' #' || entry || ')' as mark from (select *, producers.kind as kind2 from producers) p left join units a on p.producer = a.name left join units b on regexp_replace(replace(p.producer, '//', '/'), '^\\./', '') = b.path)",
        select="select 'declaration producer unresolved' as category, class || ': ' || producer || mark as message from r where unit is null union all select 'declaration producer not canonical', class || ': ' || producer || ' is ' || canon || mark from r where unit is not null and producer <> canon union all select 'declaration producer conflict', class || ': ' || string_agg(distinct unit, ', ' order by unit) from r where unit is not null group by kind2, class having count(distinct unit) > 1",
    ),
    "r21_ambiguous": q(MODULES, PATTERNS, SCORES, "top as (select *, max(score) over (partition by path) as m from claim_scores)", select="select a.path, a.name as name_a, b.name as name_b from top a join top b on a.path = b.path and a.name < b.name where a.score = a.m and b.score = b.m"),
    "r22_components": q(
        MODULES, PATTERNS, SCORES, UNIT_OWNER,
        "named as (select name from pat union select name from upat)",
        select="select 'missing component' as category, name as message from named where name not in (select name from claim_scores) and name not in (select name from unit_owner) union all select 'unexpected component', unit from (select distinct unit from modules) u where unit not in (select unit from unit_owner)",
    ),
    "s3_glob_exports": q(
        CYCLE, MODULES, CLOSURE.format("cycle_graph"),
        "direct as (select distinct p_brand || '::' || p_type as owner, p_type || '_' || p_size as symbol from part where p_size % 10 = 3 and p_type <> 'PROMO')",
        "shown2 as (select owner, symbol from direct union select r.src, d.symbol from reach r join direct d on r.dst = d.owner)",
        "known as (select path from modules where unit <> 'Brand#14')",
        select="select owner, symbol, 'resolved' as status from shown2 union all select src, dst || '::*', 'unverifiable' from cycle_graph where dst not in (from known) union all select src, dst || '::*', 'empty' from cycle_graph where dst in (from known) and dst not in (select owner from shown2)",
    ),
    "s9_nearest_configs": q(FILES, select="select path, case when path like '%/src/LARGE/%' then split_part(path, '/', 1) || '::LARGE.json' else split_part(path, '/', 1) || '.json' end as config from files"),
    "s9_config_chains": q(
        MODULES,
        "deep as (select path || '.json' as config, unit || '.json' as up from modules where path like '%LARGE')",
        "unit_configs as (select distinct unit || '.json' as config from modules)",
        select="select config, config as base, 0::bigint as depth from (select config from deep union all select config from unit_configs union all select 'base.json') t union all select config, up, 1 from deep union all select config, 'base.json', 2 from deep union all select config, 'base.json', 1 from unit_configs",
    ),
    "s8_candidates": q(
        FILES, FILE_EDGES.replace(IMPORTS + ", ", "", 1),
        "sp as (select distinct src, '../' || regexp_extract(dst, 'src/([A-Z]+/m[0-9]+)\\.ts$', 1) || case when regexp_matches(dst, '[02468]\\.ts$') then '.js' else '' end as specifier from file_edges)",
        select="select src, specifier, f.path as resolved from sp left join files f on f.path = split_part(src, '/', 1) || '/src/' || regexp_extract(specifier, '^\\.\\./([^.]*)', 1) || '.ts'",
    ),
    "s14_languages": q(FILES, "m as (select case when path like '%LARGE%' then 'python' when path like '%PROMO%' then 'go' else 'ts' end as language from files)", select="select language, count(*)::bigint as files, (row_number() over (order by count(*) desc, list_position(['rust', 'csharp', 'go', 'ts', 'python', 'kotlin'], language)))::bigint as rank from m group by language"),
    "s15_mixed_directories": q(FILES, select="select regexp_extract(path, '^(.*)/', 1) as dir, 'python,ts' as languages from files group by dir having count(distinct path like '%m7.ts') = 2"),
    "s16_exclusions": q(FILES, select="select path, case when starts_with(path, 'Brand#9/src/LARGE/') then 'Brand#9/src/LARGE' else 'Brand#9' end as entry, case when starts_with(path, 'Brand#9/src/LARGE/') then 'warn' else 'abort' end as mode from files where starts_with(path, 'Brand#9/')"),
    "s17_dead_exclusions": q(FILES, select="select e as entry from (values ('Brand#9'), ('Brand#9/src/LARGE'), ('vendor')) t(e) where not exists (select 1 from files where starts_with(path, e || '/'))"),
    "s10_gitignore": q(
        FILES,
        "f as (select path, split_part(path, '/', 1) as unit, split_part(path, '/', 4) as name from files)",
        select="select path from f where unit = 'Brand#9' or (unit = 'Brand#1' and starts_with(path, 'Brand#1/src/LARGE/')) or (unit = 'Brand#3' and regexp_full_match(name, 'm4.\\.ts')) or (unit <> 'Brand#2' and name <> 'm11.ts' and regexp_full_match(name, 'm1.*\\.ts'))",
    ),
    "s21_file_map": q(FILE_EDGES, select="select distinct src, dst from file_edges"),
    "s25_orphans": q(FILE_EDGES, "p as (select distinct p_brand || '/src/' || p_type || '/m' || p_size || '.ts' as path from part), e as (select * from file_edges where src not like '%/PROMO/%' and dst not like '%/PROMO/%')", select="select path from p where path not in (select src from e) and path not in (select dst from e) and path not in (select src from file_edges where src like '%/PROMO/m1%')"),
    "w12_rotated_rings": q(
        UNIT_EDGES,
        select="select a.src, a.dst, b.dst as third, case least(a.src, a.dst, b.dst) when a.src then a.src || ',' || a.dst || ',' || b.dst || ',' || a.src when a.dst then a.dst || ',' || b.dst || ',' || a.src || ',' || a.dst else b.dst || ',' || a.src || ',' || a.dst || ',' || b.dst end as ring from unit_edges a join unit_edges b on a.dst = b.src where b.dst <> a.src",
    ),
    "w10_suggestions": q(
        MODULES, PATTERNS, CLAIMS, SCORES,
        "asked as (select p_type as target from part union select name from claims)",
        "meant as (select target, path from asked join paths on split_part(path, '::', -1) = target union select target, path from asked join claim_scores on target = name)",
        select="select target, array_to_string((list_sort(list(path)))[1:3], ',') as named, greatest(count(*) - 3, 0)::bigint as more from meant group by target",
    ),
    "u4_present_elements": q(MODULE_EDGES, MODULES, LINKS, UNITS, select="select path from paths union select src from module_edges union select dst from module_edges union select module from links union select path from units"),
    "j6_augmented_mapping": q(
        MODULES, PATTERNS, SCORES, UNIT_OWNER,
        "soft as (select split_part(path, '::', 1) as unit, arg_min(name, idx) as name from claim_scores group by 1)",
        select="select u.unit, coalesce(o.name, s.name) as name, o.name is null and s.name is not null as reclaimed from (select distinct unit from modules) u left join unit_owner o on u.unit = o.unit left join soft s on u.unit = s.unit",
    ),
    "j7_grouped_tier": q(MODULE_EDGES, UNIT_OWNER, select="select distinct coalesce(a.name, split_part(src, '::', 1)) as src, coalesce(b.name, split_part(dst, '::', 1)) as dst from module_edges left join unit_owner a on split_part(src, '::', 1) = a.unit left join unit_owner b on split_part(dst, '::', 1) = b.unit where coalesce(a.name, split_part(src, '::', 1)) <> coalesce(b.name, split_part(dst, '::', 1))"),
    "r23_inert_rules": "select * from (values (6::bigint, 'feature_boundary', 'module gates', 'no')) t(entry, kind, fact, status)",
    "j23_explain": q(
        VERDICTS,
        select="select 'edge' as part, src || ' -> ' || dst || ' (' || placed || case when type_only then ', type-only' else '' end || ')' as text from placed where src_claim = 'core' and dst_claim = 'rest' union all select 'verdict', coalesce(verdict, 'allowed') from verdicts where src = 'core' and dst = 'rest' union all select 'finding', case verdict when 'forbidden' then 'forbidden edge present' else 'disallowed cross-component dependency' end || ': core -> rest' from verdicts where src = 'core' and dst = 'rest' and verdict is not null",
    ),
    "flagship_forbidden_edges": q(VERDICTS, select=f"select (case verdict when 'forbidden' then 5 else 8 end)::integer as category_ord, category, 'error' as severity, message from (select *, {SELECT_EDGES.split('select ', 1)[1].split(' from ')[0]} from verdicts where verdict is not null)"),
}


def _message(name: str, category: str = "category", message: str = "message") -> str:
    return f"select {category} as category, {message} as message from ({ORACLE[name]}) t_{name}"


_CYCLE_SQL = q(PLACED, CLAIM_RINGS, select="select 'cycle detected in' as category, array_to_string(ring, ' -> ') || ' (' || kind || ')' as message from kinds")
_USED_SQL = ORACLE["r4_used_undeclared"].replace("where dst <> 'promo'", "")
_PARTS = [
    *(_message(n) for n in ("r2_edge_findings", "r5_facades", "r6_contract_leaks", "r9_public_api", "r10_forbidden_externals", "r11_external_free", "r12_manifests", "r13_feature_boundary", "r14_submodules", "r16_dead_references", "r18_async", "r20_producers", "r22_components")),
    _message("r3_missing_edges", "'missing edge'", "src || ' -> ' || dst || case reason when '' then '' else ' (' || reason || ')' end"),
    _message("r7_unexposed", "'contract leak'", "claim || ' exposes ' || symbol || ' (not exposed)'"),
    _message("r15_engagement", "'warning'", """kind || ': ' || claim || coalesce(' is fully claimed by ' || "by", '')"""),
    _message("r19_schema_drift", "'warning'"),
    _message("r21_ambiguous", "'ambiguous module match'", "path || ' matches ' || name_a || ', ' || name_b"),
    f"select category, message from ({_CYCLE_SQL}) t_cycles",
    f"select category, message from ({_USED_SQL}) t_used",
]
_EVERY = " union ".join(_PARTS)
ORACLE["r24_findings"] = f"select coalesce(nullif(list_position({_CATS}, category), 0), {len(CATEGORIES) + 1})::bigint as category_ord, category, case category when 'warning' then 'warning' else 'error' end as severity, message from ({_EVERY}) every"
ORACLE["a1_violations"] = f"""select bucket, count(*)::bigint as n from (select case when category in ('missing component', 'unexpected component', 'unassigned unit', 'ambiguous module match') then 'components' when category in ('forbidden edge present', 'facade dependency') then 'boundary'
  when category in ('missing edge', 'disallowed cross-component dependency', 'used but undeclared') then 'undeclared' when category = 'cycle detected in' or category = 'warning' and starts_with(message, 'cycle: ') then 'cycles' when category <> 'warning' then 'contracts' end as bucket from ({_EVERY}) every) t where bucket is not null group by bucket"""
