"""The supplied tables, and the analysis tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.operators import components as CO
from srcweave.operators import findings as FN
from srcweave.operators import resolve as RS
from srcweave.operators.rules import RuleOptions
from srcweave.plans import corpus_text as CT
from srcweave.sources import corpus as SR
from srcweave.session import as_lookup, write_once
from srcweave.sources.python_facts import python_facts
from srcweave.sources.script_facts import script_facts


class Inputs:
    """Lazy tables of one data folder; nothing is computed until a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Python corpus ------------------------------------------------------

    @cached_property
    def raw_files(self) -> DataFrame:
        return CT.python_files(self.spark, self.table("part"))

    @cached_property
    def files(self) -> DataFrame:
        return SR.keep_scanned(SR.as_source_files(self.raw_files))

    @cached_property
    def parsed(self) -> DataFrame:
        return python_facts(self.files)

    @cached_property
    def facts(self) -> DataFrame:
        """The parsed files written once, for queries that read them several times."""
        return write_once(self.parsed)

    @cached_property
    def components(self) -> DataFrame:
        return CO.components(self.parsed)

    @cached_property
    def relationships(self) -> DataFrame:
        return RS.python_relationships(self.facts, CO.components(self.facts))

    @cached_property
    def imports(self) -> DataFrame:
        return RS.relationships(RS.import_edges(self.facts))

    @cached_property
    def projects(self) -> DataFrame:
        return self.files.select("project_id").distinct()

    def findings(self, options: RuleOptions = RuleOptions(), only=None) -> DataFrame:
        return FN.findings(self.parsed, "python", options, only)

    @cached_property
    def changed_files(self) -> DataFrame:
        """The corpus after an edit: every module takes the size of its part plus one."""
        part = self.table("part").withColumn("p_size", F.col("p_size") + 1)
        return SR.keep_scanned(SR.as_source_files(CT.python_files(self.spark, part)))

    @cached_property
    def changed_parsed(self) -> DataFrame:
        return python_facts(self.changed_files)

    @cached_property
    def changed_facts(self) -> DataFrame:
        return write_once(self.changed_parsed)

    # TypeScript corpus --------------------------------------------------

    @cached_property
    def all_script_files(self) -> DataFrame:
        return SR.as_source_files(CT.script_files(self.spark, self.table("part")))

    @cached_property
    def script_files(self) -> DataFrame:
        return SR.without_vendored(self.all_script_files)

    @cached_property
    def script_parsed(self) -> DataFrame:
        return script_facts(self.script_files)

    def script_facts(self, *columns: str) -> DataFrame:
        """The facts that will be read, written once."""
        return script_facts(self.script_files, columns, stored=True)

    @cached_property
    def script_components(self) -> DataFrame:
        return CO.components(script_facts(self.script_files, ["decls"]), "typescript")

    def script_findings(self, options: RuleOptions = RuleOptions(), only=None) -> DataFrame:
        return FN.findings(self.script_parsed, "typescript", options, only)

    # Graphs from the other tables ---------------------------------------

    @cached_property
    def event_edges(self) -> DataFrame:
        """Users and the item numbers in their events: one edge per distinct triple."""
        item = F.get_json_object("props", "$.k")
        return (
            self.table("events")
            .select(
                F.lit("events").alias("project_id"),
                F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                F.concat(F.lit("u"), item).alias("target"),
                F.col("event_type").alias("type"),
            )
            .distinct()
        )

    @cached_property
    def trade_nodes(self) -> DataFrame:
        """Customers and suppliers by nation, parts by brand."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        people = (
            self.table("customer")
            .select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                    F.lit("customer").alias("type"), F.col("c_nationkey").alias("n_nationkey"))
            .unionByName(
                self.table("supplier").select(
                    F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
                    F.lit("supplier").alias("type"), F.col("s_nationkey").alias("n_nationkey"))
            )
            .join(nation, "n_nationkey")
            .select("id", "type", F.col("n_name").alias("cluster"))
        )
        parts = self.table("part").select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
            F.lit("part").alias("type"), F.col("p_brand").alias("cluster"),
        )
        return people.unionByName(parts).select(F.lit("trade").alias("project_id"), "*")

    @cached_property
    def trade_edges(self) -> DataFrame:
        """Customers and the suppliers of what they ordered: one edge per distinct pair."""
        sold = self.table("lineitem").select("l_orderkey", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return (
            sold.join(orders, sold.l_orderkey == orders.o_orderkey)
            .select(
                F.lit("trade").alias("project_id"),
                F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"),
                F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
                F.lit("buys").alias("type"),
            )
            .distinct()
        )

    @cached_property
    def module_edges(self) -> DataFrame:
        """Dependencies between modules: imports, bases and calls lifted to files."""
        files = as_lookup(
            CO.components(self.facts)
            .groupBy("project_id", "key")
            .agg(F.max("file_path").alias("path"))
        )
        return (
            self.relationships.join(files.toDF("project_id", "source_key", "s"), ["project_id", "source_key"])
            .join(files.toDF("project_id", "target_key", "t"), ["project_id", "target_key"])
            .select("project_id", F.col("s").alias("source"), F.col("t").alias("target"), "type")
        )

    @cached_property
    def import_graph(self) -> DataFrame:
        """Import edges between file paths."""
        edges = RS.resolved_imports(self.facts).select(
            "project_id", F.col("file_path").alias("source"),
            F.col("target_path").alias("target"), F.lit("imports").alias("type"),
        ).distinct()
        return write_once(edges)

    @cached_property
    def dated_types(self) -> DataFrame:
        return self.table("events").select(
            F.lit("events").alias("project_id"), "ts", "event_type", "event_id"
        )
