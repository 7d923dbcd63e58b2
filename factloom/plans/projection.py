"""The driver tables as fact tables.

Nations are units of a region, parts are modules ``brand::type``, consecutive
lines of an order are imports, and events are literal sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Facts:
    """Lazy fact tables over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.held: dict[str, DataFrame] = {}  # tables that a caller has written for reuse

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def units(self) -> DataFrame:
        """(name, kind, path, root)."""
        nation, region = self.table("nation"), self.table("region")
        joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return joined.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("root"))

    def unit_edges(self) -> DataFrame:
        """(src, dst): the two nations that each nation's customers buy from most."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("ck"))
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("sk"))
        pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        counted = pairs.where("ck <> sk").groupBy("ck", "sk").agg(F.count("*").alias("n"))
        best = counted.withColumn("r", F.row_number().over(Window.partitionBy("ck").orderBy(F.desc("n"), "sk"))).where("r <= 2")
        named = best.join(nation.toDF("ck", "src"), "ck").join(nation.toDF("sk", "dst"), "sk")
        return named.select("src", "dst")

    def imports(self) -> DataFrame:
        """A row for each import: (unit, src, dst, symbol, type_only, src_file, dst_file)."""
        if "imports" in self.held:
            return self.held["imports"]
        part = self.table("part").select("p_partkey", "p_brand", "p_type", "p_size")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
        node = F.concat_ws("::", "p_brand", "p_type")
        file = F.concat(F.col("p_brand"), F.lit("/src/"), F.col("p_type"), F.lit("/m"), F.col("p_size").cast("string"), F.lit(".ts"))
        seq = lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", "p_brand", "p_size", "l_returnflag", node.alias("src"), file.alias("src_file"))
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src", "src_file", "l_returnflag")
        nxt = seq.select("*", F.lead("src").over(w).alias("dst"), F.lead("src_file").over(w).alias("dst_file"), F.lead("p_size").over(w).alias("symbol"))
        return nxt.where("dst is not null").select(F.col("p_brand").alias("unit"), "src", "dst", F.col("symbol").cast("string").alias("symbol"), (F.col("l_returnflag") == "R").alias("type_only"), "src_file", "dst_file")

    def module_edges(self) -> DataFrame:
        """(unit, src, dst, symbols, type_only, weight)."""
        edges = self.imports().where("src <> dst").groupBy("unit", "src", "dst")
        return edges.agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.bool_and("type_only").alias("type_only"), F.count("*").alias("weight"))

    def file_edges(self) -> DataFrame:
        """(unit, src, dst, kind)."""
        return self.imports().where("src_file <> dst_file").select("unit", F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), F.lit("use").alias("kind")).distinct()

    def file_graph(self) -> DataFrame:
        """(unit, src, dst, kind, type_only): the imports of files inside a unit."""
        inside = self.imports().where("src_file <> dst_file and startswith(dst, concat(unit, '::'))")
        rows = inside.groupBy("unit", F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.bool_and("type_only").alias("type_only"))
        return rows.select("unit", "src", "dst", F.lit("use").alias("kind"), "type_only")

    def modules(self) -> DataFrame:
        """(unit, path)."""
        return self.table("part").select(F.col("p_brand").alias("unit"), F.concat_ws("::", "p_brand", "p_type").alias("path")).distinct()

    def cycle_graph(self) -> DataFrame:
        """(src, dst): the edges between modules of one unit."""
        return self.module_edges().where("startswith(dst, concat(unit, '::'))").select("src", "dst")

    def literal_sites(self) -> DataFrame:
        """(unit, path, language, value, noun, pattern): a site for each event."""
        e = self.table("events")
        unit = F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string"))
        value = F.get_json_object("props", "$.k")
        language = F.element_at(F.array(*map(F.lit, ("rust", "go", "ts"))), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
        pattern = F.when(F.col("event_type").isin("signup", "purchase"), "orders").when(F.col("event_type").isin("view", "click"), "visits").otherwise("errors")
        return e.select(unit.alias("unit"), F.concat(unit, F.lit("/"), F.col("event_type")).alias("path"), language.alias("language"), value.alias("value"), F.col("event_type").alias("noun"), pattern.alias("pattern"))

    def async_edges(self) -> DataFrame:
        """(src, dst, event): who publishes what to whom, from the first user of each event value."""
        if "async_edges" in self.held:
            return self.held["async_edges"]
        s = self.literal_sites()
        pub = s.where("noun = 'signup'").select(F.col("unit").alias("src"), F.concat(F.lit("shop.order."), F.col("value")).alias("event"), "value").distinct()
        sub = s.where("noun = 'purchase'").select(F.col("unit").alias("dst"), "value").distinct()
        return pub.join(sub, "value").where("src <> dst").select("src", "dst", "event")

    def event_records(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """(records, bases, enums, bound, own) for schema drift: every event value but each fifth has a record, each third a base."""
        edges = self.async_edges()
        value = F.element_at(F.split("event", "[.]"), -1)
        events = edges.select(value.alias("record"), value.cast("int").alias("k")).distinct()
        fields = F.array(F.struct(F.lit("id").alias("f"), F.lit("int").alias("t")), F.struct(F.lit("state").alias("f"), F.when(F.col("k") % 2 == 0, "Shop.State").otherwise("string").alias("t")))
        records = events.where("k % 5 <> 0").select("record", F.explode(fields).alias("x")).select("record", F.col("x.f").alias("field"), F.col("x.t").alias("type"))
        base = self.spark.createDataFrame([("Base", "at", "Level"), ("Base", "who", "string"), ("Root", "key", "long")], "record string, field string, type string")
        bases = events.where("k % 3 = 0").select("record", F.lit("Base").alias("base")).unionByName(self.spark.createDataFrame([("Base", "Root")], "record string, base string"))
        enums = self.spark.createDataFrame([("State",), ("Level",)], "name string")
        binds = edges.select("dst", value.alias("record"), value.cast("int").alias("k")).distinct()
        seen = F.filter(F.array(*map(F.lit, ("id", "state", "at", "key", "price"))), lambda x: (x != "price") | (F.col("k") % 7 == 0))
        rows = binds.select("dst", "record", "k", F.explode(seen).alias("field"))
        hop = (F.col("field") == "at") & (F.col("k") % 4 == 1)
        bound = rows.select("dst", "record", "field", (~hop).alias("bound"), ((F.col("field") == "state") & (F.col("k") % 4 == 0) | hop).alias("projected"))
        own = binds.where("k % 4 = 2").select("dst", "record", F.lit("state").alias("field"), F.lit("System.String?").alias("type"))
        return records.unionByName(base), bases, enums, bound, own

    def page_links(self) -> DataFrame:
        """(module, package): a page's host and what it links to."""
        pages = self.table("pages")
        host = F.regexp_extract("url", "://([^/?#]*)", 1)
        return pages.select(host.alias("module"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("package")).distinct()

    def exports(self) -> DataFrame:
        """(owner, symbol, status): types that brands expose."""
        status = F.when(F.col("p_size") >= 49, "unverifiable").when(F.col("p_size") <= 1, "empty").otherwise("resolved")
        return self.table("part").select(F.col("p_brand").alias("owner"), F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("symbol"), status.alias("status")).distinct()

    def test_gated(self) -> DataFrame:
        """(path): modules that only tests build."""
        return self.table("part").where("p_size = 7").select(F.concat_ws("::", "p_brand", "p_type").alias("path")).distinct()

    def roles(self) -> DataFrame:
        """(path, role)."""
        role = F.when(F.col("p_type") == "PROMO", "facade").when(F.col("p_type") == "ECONOMY", "composition")
        return self.table("part").select(F.concat_ws("::", "p_brand", "p_type").alias("path"), role.alias("role")).where("role is not null").distinct()

    def notices(self) -> DataFrame:
        """(channel, line)."""
        return self.table("documents").select(F.lit("report").alias("channel"), F.concat_ws(": ", "source", "lang").alias("line"))

    def manifests(self) -> DataFrame:
        """(unit, publish, deps, features)."""
        part = self.table("part").groupBy(F.col("p_brand").alias("unit")).agg(F.max("p_size").alias("top"), F.array_sort(F.collect_set("p_type")).alias("deps"))
        sizes = self.table("part").select(F.col("p_brand").alias("unit"), F.concat(F.lit("f"), F.pmod("p_size", F.lit(5)).cast("string")).alias("f")).groupBy("unit").agg(F.array_sort(F.collect_set("f")).alias("features"))
        publish = F.when(F.col("top") == 50, True).when(F.col("top") == 49, False)
        return part.join(sizes, "unit").select("unit", publish.alias("publish"), "deps", "features")

    def module_decls(self) -> DataFrame:
        """(unit, name, feature, file): declarations, some of them gated."""
        p = self.table("part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("low"))
        feature = F.when(F.col("low") <= 2, "slim").when(F.col("low") == 3, "wide")
        return p.select(F.col("p_brand").alias("unit"), F.col("p_type").alias("name"), feature.alias("feature"), F.concat("p_brand", F.lit("/lib.rs")).alias("file"))
