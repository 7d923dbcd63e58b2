"""A rule document for the projected driver tables: the one that the queries apply."""

TEXT = """
[project]
language = "ts"
excluded_sources = [
  { path = "Brand#9", reason = "generated" },
  { path = "Brand#9/src/LARGE", reason = "kept in the report", mode = "warn" },
  { path = "vendor", reason = "not ours" },
]

[[module]]
name = "core"
matches = { modules = ["Brand#1*"] }
allowed = { depend_on = ["edge", "promo", "void", "promos"], forbidden = ["rest"] }
contract = { expose = ["LARGE*", "*_1*"], forbid = ["tiny"] }
  [[module.submodules]]
  name = "core_large"
  matches = { modules = ["Brand#1*::LARGE", "Brand#10::LARGE"] }
  allowed = { depend_on = ["edge_small", { target = "promo", type_only = "exempt" }], forbidden = ["edge"] }
  [[module.submodules]]
  name = "core_misc"
  matches = { modules = ["Brand#12::MEDIUM", "Brand#13"] }

[[module]]
name = "edge"
matches = { modules = ["Brand#2*"] }
allowed = { depend_on = ["core", "promo", "core_misc", "ghost", "edge_smal", "void"] }
  [[module.submodules]]
  name = "edge_small"
  matches = { modules = ["Brand#2::SMALL", "Brand#21::SMALL"] }

[[module]]
name = "promo"
matches = { modules = ["PROMO"] }

[[module]]
name = "rest"
matches = { units = ["Brand#7", "Brand#8*"], modules = ["Brand#3*", "Brand#5*", "Brand#6"] }
allowed = { depend_on = ["core", "edge", "promo", "hiden"], forbidden = ["cores"] }

[[module]]
name = "hidden"
matches = { modules = ["Brand#4::*"] }
allowed = { depend_on = ["void", "nothing_like_it"] }

[[module]]
name = "void"
matches = { modules = ["Nothing*"] }
allowed = { depend_on = ["core", "edge", "promo", "rest", "hidden"], forbidden = ["core_larg"] }

[[module]]
name = "twin"
matches = { modules = ["Brand#5*"] }
allowed = { depend_on = ["core"] }

[[module]]
name = "shadow"
matches = { modules = ["Brand#21::SMALL"] }

[[module]]
name = "empty"
matches = { modules = ["*::TITANIC"], units = ["Brand#99"] }

[[stereotype]]
name = "tiny"
match = { names = ["*_1", "SMALL_*"] }

[[constraint]]
type = "no_cycles"

[[constraint]]
type = "forbid_external_crates"
from = ["*.example.net"]
forbid = ["t*", "and"]

[[constraint]]
type = "external_free"
from = ["*blog.*"]

[[constraint]]
type = "manifest_integrity"
require_publish = true
forbidden_dependencies = ["PROMO"]
required_features = ["f0", "f4"]

[[constraint]]
type = "public_api_allowlist"
allowed = ["*_1*", "SMALL_2"]

[[constraint]]
type = "feature_boundary"
feature = "slim"
gated_modules = ["*::LARGE", "Brand#3::SMALL"]
allowed_from = ["Brand#1*"]

[[constraint]]
type = "forbid_submodule_dependency"
parent = "Brand#1"
from = ["LARGE"]
forbid = ["SMALL", "ECONOMY"]

[[async_depends]]
from = "NATION_1"
to = "NATION_2"
event = "shop.order.7"

[[async_depends]]
from = "NATION_1"
to = "NATION_2"
event = "mall.order.7"

[[async_depends]]
from = "NATION_3"
to = "ATLANTIS"
event = "shop.order.404"

[[canonical_producer]]
class = "order"
producer = "AFRICA/NATION_0"

[[canonical_producer]]
class = "order"
producer = "./AFRICA//NATION_5"

[[canonical_producer]]
class = "visit"
producer = "NATION_9"

[[shared_constant]]
class = "errors"
producer = "NOWHERE"

[[pattern_pair]]
id = "orders"
emit = { language = "rust", role = "publish", call = "signup", arg = 0 }
subscribe = { language = "go", role = "subscribe", call = "purchase", arg = 1 }

[[pattern_pair]]
id = "visits"
emit = { language = "ts", role = "publish", call = "view", arg = 0 }
subscribe = { language = "ts", property = "click" }
"""
