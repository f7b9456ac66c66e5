"""The catalog of targets, inputs, outputs, states, revisions and events: from Parquet, from JSON, or as a view of relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.staging import folder

#: Schemas of a catalog at rest.
SCHEMAS = {
    "packages": "package string, provider string, provider_ord int",
    "targets": "addr string, package string, name string, driver string, provider string, provider_ord int, labels array<string>, transparent boolean, cache_enabled boolean, cache_history int, def_hash string",
    "inputs": "addr string, pos int, dep_addr string, output string, mode string, origin_id string, hashed boolean, runtime boolean, annotations map<string,string>",
    "outputs": "addr string, `group` string, pos int, path string, kind string, codegen string, driver string",
    "states": "package string, provider string, decl_ord int, state map<string,string>",
    "revisions": "addr string, hashin string, created_at_ns long",
    "artifacts": "addr string, hashin string, name string, `group` string, hashout string, size long, type string",
    "events": "at_ms long, seq long, type string, addr string, driver string, error string, upstream_of string",
    "files": "path string, size long, mtime_ns long, exec boolean, hashout string, accessed_ns long",
}


def load(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A relation of a catalog, with its schema given rather than inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{root}/{name}")


def relation(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A fixed list of rows as a relation."""
    return spark.createDataFrame(rows, SCHEMAS[name])


def word(text: Column | str) -> Column:
    """Without the characters that packages can't hold."""
    return F.regexp_replace(text, "[ #:]", "_")


class Bridge:
    """Relational tables seen as a catalog, so that every operator has rows to work on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _places(self) -> DataFrame:
        """(nationkey, world package) of each nation."""
        regions = self.table("region").select("r_regionkey", word("r_name").alias("region"))
        return self.table("nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("world/"), "region").alias("region_package"), F.concat(F.lit("world/"), "region", F.lit("/"), word("n_name")).alias("nation_package"))

    @staticmethod
    def _rows(df: DataFrame, package: Column, name: Column, driver: str, order: int, labels: Column) -> DataFrame:
        return df.select(F.concat(F.lit("//"), package, F.lit(":"), name).alias("addr"), package.alias("package"), name.alias("name"), F.lit(driver).alias("driver"), F.lit(driver).alias("provider"), F.lit(order).alias("provider_ord"), labels.alias("labels"))

    def targets(self) -> DataFrame:
        places = F.broadcast(self._places())  # a row for each nation
        key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
        none = F.array().cast("array<string>")
        nations = self._rows(self._places(), F.col("region_package"), key("n", "n_nationkey"), "world", 0, none)
        customers = self._rows(self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), F.col("nation_package"), key("c", "c_custkey"), "world", 0, F.array("c_mktsegment"))
        suppliers = self._rows(self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")), F.concat("nation_package", F.lit("/suppliers")), key("s", "s_suppkey"), "world", 0, none)
        parts = self._rows(self.table("part"), F.concat(F.lit("parts/"), word("p_brand")), key("p", "p_partkey"), "parts", 1, F.array("p_type"))
        orders = self._rows(self.table("orders"), F.concat(F.lit("orders/"), F.date_format("o_orderdate", "yyyy/MM")), key("o", "o_orderkey"), "orders", 2, F.array("o_orderstatus", "o_orderpriority"))
        return nations.unionByName(customers).unionByName(suppliers).unionByName(parts).unionByName(orders)

    def inputs(self) -> DataFrame:
        """order -> customer, part and supplier; customer and supplier -> nation. Keys stand for addresses here: c1, n2, ..."""
        key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
        lines = self.table("lineitem")
        edges = [
            self.table("orders").select(key("o", "o_orderkey").alias("addr"), F.lit(0).alias("pos"), key("c", "o_custkey").alias("dep_addr")),
            lines.select(key("o", "l_orderkey").alias("addr"), F.lit(1).alias("pos"), key("p", "l_partkey").alias("dep_addr")).distinct(),
            lines.select(key("o", "l_orderkey").alias("addr"), F.lit(2).alias("pos"), key("s", "l_suppkey").alias("dep_addr")).distinct(),
            self.table("customer").select(key("c", "c_custkey").alias("addr"), F.lit(0).alias("pos"), key("n", "c_nationkey").alias("dep_addr")),
            self.table("supplier").select(key("s", "s_suppkey").alias("addr"), F.lit(0).alias("pos"), key("n", "s_nationkey").alias("dep_addr")),
        ]
        out = edges[0]
        for e in edges[1:]:
            out = out.unionByName(e)
        return out

    def revisions(self) -> DataFrame:
        """A revision of a part for each line that ships it."""
        ident = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
        micros = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
        return self.table("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("addr"), ident.alias("hashin"), (micros * 1000).alias("created_at_ns"), F.col("l_quantity").cast("long").alias("size"))

    def scattered(self, name: str, key: str, files: int = 4) -> DataFrame:
        """A table as a stream of several files, one for each batch, in which its rows are dealt by a hash: what comes first in a
        table may come in any batch."""
        table = self.table(name)
        path = folder(self.spark, f"{name}-stream")
        part = F.pmod(F.xxhash64(key), F.lit(files))
        for k in range(files):
            table.where(part == k).coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files."""
        return self.spark.readStream.schema(self.table(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)

    def events(self, rows: DataFrame | None = None) -> DataFrame:
        """Users as targets: click and view are local and remote hits, signup an execution, purchase a local miss, error a failed
        result. A signup is a start, a success and the end of the result, at one time."""
        e = self.table("events") if rows is None else rows
        addr = F.concat(F.lit("//users/g"), (F.col("user_id") % 10).cast("string"), F.lit(":u"), F.col("user_id").cast("string"))
        kinds = F.when(F.col("event_type") == "click", F.array(F.lit("local_hit"))).when(F.col("event_type") == "view", F.array(F.lit("remote_hit"))).when(F.col("event_type") == "signup", F.array(F.lit("execute_start"), F.lit("execute_end"), F.lit("result_end"))).when(F.col("event_type") == "purchase", F.array(F.lit("local_miss"))).otherwise(F.array(F.lit("result_end")))
        at_ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
        rows = e.select(at_ms.alias("at_ms"), "event_id", "event_type", addr.alias("addr"), "user_id", F.posexplode(kinds).alias("k", "type"))
        error = F.when(F.col("event_type") == "error", F.lit("failed"))
        upstream = F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), F.lit("//users/g1:u1"))
        return rows.select("at_ms", (F.col("event_id") * 10 + F.col("k")).alias("seq"), "type", "addr", error.alias("error"), upstream.alias("upstream_of"))

    def url_paths(self) -> DataFrame:
        """(path, page_id) of the pages: host and path of their URLs."""
        return self.table("pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"), "page_id", "url")
