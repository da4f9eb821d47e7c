"""Every operator as a query over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.functions import paths as P
from srcweave.operators import components as CO
from srcweave.operators import contracts as CK
from srcweave.operators import findings as FN
from srcweave.operators import graph as GR
from srcweave.operators import growth as GW
from srcweave.operators import posture as PO
from srcweave.operators import reports as RP
from srcweave.operators import resolve as RS
from srcweave.operators import rules as R
from srcweave.operators import script_resolve as SS
from srcweave.operators import taint as TN
from srcweave.operators import traversal as TV
from srcweave.plans.inputs import Inputs
from srcweave.session import shared_dir, write_once
from srcweave.sources import config as CF
from srcweave.sources import corpus as SR
from srcweave.sources import sinks as SK
from srcweave.sources.fact_store import FactStore
from srcweave.streaming import incremental as ST

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a query under the name of its function."""
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function):
        return lambda spark, sf_dir: function(Inputs(spark, sf_dir))

    return {name: bound(function) for name, function in _QUERIES.items()}


# Scans ------------------------------------------------------------------------


@query
def scan_corpus(t: Inputs) -> DataFrame:
    return t.files.select(
        "project_id", "file_path", "dir", "base_name", "ext", "language", "n_lines"
    )


@query
def filter_vendored(t: Inputs) -> DataFrame:
    return t.script_files.select("project_id", "file_path")


@query
def explode_lines(t: Inputs) -> DataFrame:
    return SR.explode_lines(t.files)


@query
def file_loc(t: Inputs) -> DataFrame:
    return t.files.select("project_id", "file_path", F.col("n_lines").alias("loc"))


@query
def path_parts(t: Inputs) -> DataFrame:
    path = F.col("file_path")
    return t.files.select(
        "file_path", P.dir_name(path).alias("dir"), P.base_name(path).alias("base"),
        P.group_name(path).alias("grp"), P.depth_below(path).alias("depth"),
    )


@query
def detect_language(t: Inputs) -> DataFrame:
    every = t.files.select("project_id", "file_path").unionByName(
        t.all_script_files.select("project_id", "file_path")
    )
    kept = SR.keep_scanned(every, SR.DETECT_SKIP_DIRS, SR.DETECT_MAX_DEPTH)
    return SR.detect_language(kept)


@query
def parse_errors(t: Inputs) -> DataFrame:
    return SR.parse_errors(t.parsed).select("project_id", "file_path")


@query
def py_facts(t: Inputs) -> DataFrame:
    def facts(kind: str, items: str, name: str, line: str):
        return F.transform(items, lambda f: F.struct(
            F.lit(kind).alias("fact"), f[name].alias("name"), f[line].alias("line")))

    rows = F.concat(
        facts("decl", "decls", "name", "start_line"), facts("import", "imports", "module", "line"),
        facts("call", "calls", "callee", "line"), facts("assign", "assigns", "target", "line"),
    )
    return t.parsed.select("project_id", "file_path", F.inline(rows))


# Components ---------------------------------------------------------------------


def _flat(comps: DataFrame) -> DataFrame:
    return comps.select(
        "project_id", "id", "name", "type", "file_path", "start_line", "end_line",
        F.col("metadata.loc").alias("loc"), F.col("metadata.is_exported").alias("is_exported"),
    )


@query
def all_components(t: Inputs) -> DataFrame:
    return _flat(t.components)


@query
def component_ids(t: Inputs) -> DataFrame:
    """Ids over the part table itself: brands as files, names as declarations."""
    return t.table("part").select(
        "p_partkey", ids.component_id("class", F.col("p_brand"), F.col("p_name")).alias("id")
    )


@query
def relationship_ids(t: Inputs) -> DataFrame:
    return t.event_edges.select(
        "source", "target", "type",
        ids.relationship_id(F.col("source"), F.col("target"), F.col("type")).alias("id"),
    )


@query
def components_by_type(t: Inputs) -> DataFrame:
    return CO.of_type(t.components, "class").select("project_id", "id", "name")


@query
def count_by_type(t: Inputs) -> DataFrame:
    return CO.count_by_type(t.components)


@query
def count_edge_types(t: Inputs) -> DataFrame:
    return CO.count_by_type(t.relationships)


@query
def exported_functions(t: Inputs) -> DataFrame:
    return CO.exported_functions(t.components).select("project_id", "id", "name")


@query
def large_classes(t: Inputs) -> DataFrame:
    return CO.large_classes(t.components)


@query
def complex_functions(t: Inputs) -> DataFrame:
    return CO.complex_functions(t.components)


@query
def large_files(t: Inputs) -> DataFrame:
    return CO.large_files(t.components)


@query
def large_documents(t: Inputs) -> DataFrame:
    """The size check on the documents table: long texts of each source."""
    return t.table("documents").where("n_chars >= 3000").select("doc_id", "source", "n_chars")


@query
def leaf_files(t: Inputs) -> DataFrame:
    return CO.leaf_files(CO.components(t.facts)).select("project_id", "id", "name")


@query
def py_visibility(t: Inputs) -> DataFrame:
    methods = CO.of_type(t.components, "class").select(
        "project_id", F.col("name").alias("class_name"), F.inline("metadata.methods")
    )
    return methods.select(
        "project_id", "class_name", "name", "visibility", "is_static", "is_async", "return_type"
    )


@query
def method_params(t: Inputs) -> DataFrame:
    methods = CO.of_type(t.components, "class").select(
        "project_id", F.col("name").alias("class_name"), F.inline("metadata.methods")
    )
    params = methods.select(
        "project_id", "class_name", F.col("name").alias("method_name"),
        F.posexplode("parameters").alias("pos", "p"),
    )
    return params.select("project_id", "class_name", "method_name", "pos", "p.*")


@query
def class_properties(t: Inputs) -> DataFrame:
    return CO.of_type(t.components, "class").select(
        "project_id", F.col("name").alias("class_name"),
        F.posexplode("metadata.properties").alias("pos", "p"),
    ).select("project_id", "class_name", "pos", "p.name", "p.type", "p.visibility")


@query
def class_bases(t: Inputs) -> DataFrame:
    return CO.of_type(t.components, "class").select(
        "project_id", "name", F.col("metadata.extends").alias("extends"),
        F.array_join("metadata.implements", ",").alias("implements"),
    )


# Resolution -----------------------------------------------------------------------


@query
def module_names(t: Inputs) -> DataFrame:
    return RS.module_names(t.parsed)


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        "project_id", "id", "source", "target", "type",
        F.array_join("import_specifiers", ",").alias("specifiers"),
    )


@query
def import_edges(t: Inputs) -> DataFrame:
    return _edge_rows(t.imports)


@query
def relative_imports(t: Inputs) -> DataFrame:
    written = write_once(t.parsed.select("project_id", "file_path", "imports"))  # read twice
    return RS.resolved_imports(written).where("level > 0").select(
        "project_id", "file_path", "module", "level", "target_path"
    )


@query
def import_specifiers(t: Inputs) -> DataFrame:
    return t.imports.select("project_id", "id", F.posexplode("import_specifiers").alias("pos", "name"))


@query
def inherit_edges(t: Inputs) -> DataFrame:
    return _edge_rows(RS.relationships(RS.inherit_edges(t.facts, CO.components(t.facts))))


@query
def call_edges(t: Inputs) -> DataFrame:
    return _edge_rows(RS.relationships(RS.call_edges(t.facts, CO.components(t.facts))))


@query
def all_relationships(t: Inputs) -> DataFrame:
    return _edge_rows(t.relationships)


@query
def resolve_ids(t: Inputs) -> DataFrame:
    """Each class by its path and name, written in another case."""
    comps = CO.components(t.facts)
    refs = CO.of_type(comps, "class").select(
        "project_id", "file_path", F.lit("class").alias("ref_type"),
        F.lower("name").alias("ref_name"),
    )
    return RS.resolve_ids(refs, comps).select("project_id", "ref_name", "id", "found_name")


@query
def name_map(t: Inputs) -> DataFrame:
    return RS.name_map(t.components).select("project_id", "name", "id", "file_path")


@query
def dedup_first(t: Inputs) -> DataFrame:
    """The first order line of each part and supplier, by date, order and line."""
    lines = t.table("lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity",
        "l_extendedprice",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return RS.first_wins(lines, ["l_partkey", "l_suppkey"], order)


@query
def dup_check(t: Inputs) -> DataFrame:
    lines = t.table("lineitem").select(
        F.col("l_returnflag").alias("project_id"), "l_orderkey", "l_linenumber"
    )
    return RS.duplicate_check(lines, ["project_id", "l_orderkey", "l_linenumber"])


# Graph ------------------------------------------------------------------------------


@query
def graph_nodes(t: Inputs) -> DataFrame:
    return GR.graph_nodes(CO.components(t.facts), t.relationships).select(
        "project_id", "id", "label", "type", "group", F.round("size", 6).alias("size"),
        F.col("metadata.loc").alias("loc"),
    )


@query
def graph_edges(t: Inputs) -> DataFrame:
    return GR.graph_edges(t.relationships).select(
        "project_id", "id", "source", "target", "type", "weight"
    )


@query
def edge_key_check(t: Inputs) -> DataFrame:
    """Edges of each project by the whole keys of their ends, and ends that are no component."""
    return GR.edge_key_check(CO.components(t.facts), t.relationships)


@query
def clusters(t: Inputs) -> DataFrame:
    return GR.clusters(t.components)


@query
def cluster_node_lists(t: Inputs) -> DataFrame:
    lists = GR.cluster_node_lists(CO.components(t.facts), per_row=50)
    return lists.select(
        "project_id", "dir", "bucket", F.array_join("node_ids", ",").alias("node_ids")
    )


@query
def import_subset(t: Inputs) -> DataFrame:
    return GR.import_subset(GR.graph_edges(t.relationships)).select(
        "project_id", F.col("source").alias("from_id"), F.col("target").alias("to_id")
    )


@query
def node_degree(t: Inputs) -> DataFrame:
    return GR.node_degree(t.event_edges).drop("key")


@query
def in_out_degree(t: Inputs) -> DataFrame:
    return GR.in_out_degree(t.event_edges).drop("key")


@query
def node_size(t: Inputs) -> DataFrame:
    return GR.node_size(CO.components(t.facts), t.relationships).select(
        "project_id", "id", "degree", F.round("size", 6).alias("size")
    )


@query
def hub_topk(t: Inputs) -> DataFrame:
    return GR.hubs(t.event_edges, 10).drop("key")


@query
def hub_topk_per_project(t: Inputs) -> DataFrame:
    return GR.hubs(t.relationships, 5, per_project=True).drop("key")


@query
def god_objects(t: Inputs) -> DataFrame:
    return GR.god_objects(t.event_edges, 10, 3.0, 20).drop("key")


@query
def island_nodes(t: Inputs) -> DataFrame:
    return GR.island_nodes(t.trade_nodes, t.trade_edges).select("project_id", "id", "cluster")


@query
def facade_nodes(t: Inputs) -> DataFrame:
    return GR.facade_nodes(t.relationships, 5, 1).drop("key")


@query
def subgraph(t: Inputs) -> DataFrame:
    nodes = GR.clustered(CO.components(t.facts))
    _, edges = GR.subgraph(nodes, t.relationships, types=["class", "function"])
    return edges.select("project_id", "id", "source", "target", "type")


@query
def cluster_coupling(t: Inputs) -> DataFrame:
    return GR.cluster_coupling(t.trade_nodes, t.trade_edges)


@query
def cross_cluster_edges(t: Inputs) -> DataFrame:
    return GR.cross_cluster_edges(t.trade_nodes, t.trade_edges)


@query
def isolated_clusters(t: Inputs) -> DataFrame:
    return GR.isolated_clusters(t.trade_nodes, t.trade_edges)


@query
def one_way_pairs(t: Inputs) -> DataFrame:
    return GR.one_way_pairs(GR.clustered(CO.components(t.facts)), t.imports)


@query
def star_clusters(t: Inputs) -> DataFrame:
    return GR.star_clusters(GR.clustered(CO.components(t.facts)), t.imports, 2)


@query
def cluster_stats(t: Inputs) -> DataFrame:
    return GR.cluster_stats(t.trade_nodes, t.trade_edges)


@query
def folder_rollup(t: Inputs) -> DataFrame:
    """Nodes, inner and crossing imports of the folders of each level."""
    return GR.folder_rollup(CO.components(t.facts), RS.resolved_imports(t.facts))


@query
def document_clusters(t: Inputs) -> DataFrame:
    """Sources of the documents as clusters, with totals."""
    return t.table("documents").rollup("source").agg(
        F.count("*").alias("n_nodes"), F.sum("n_chars").alias("n_chars")
    )


@query
def cyclic_components(t: Inputs) -> DataFrame:
    return TV.cyclic_components(t.import_graph)


@query
def module_cycles(t: Inputs) -> DataFrame:
    """Components of the denser graph of all dependencies between modules."""
    return TV.cyclic_components(t.module_edges)


@query
def cycle_witness(t: Inputs) -> DataFrame:
    """A closed path through each cyclic component of the imports, step by step."""
    return TV.cycle_witness(t.import_graph)


@query
def short_cycles(t: Inputs) -> DataFrame:
    cycles = TV.short_cycles(t.import_graph, 4)
    return cycles.select(
        "project_id", TV.cycle_text(F.col("path")).alias("path"), "length", "severity"
    )


@query
def dependency_chain(t: Inputs) -> DataFrame:
    """A shortest chain from each module to the one three imports away."""
    hop = t.import_graph.select("project_id", "source", "target")
    second = hop.toDF("project_id", "target", "t2")
    third = hop.toDF("project_id", "t2", "t3")
    pairs = hop.join(second, ["project_id", "target"]).join(third, ["project_id", "t2"]).select(
        "project_id", "source", F.col("t3").alias("target")
    )
    chains = TV.dependency_chain(hop, pairs)
    return chains.select(
        "project_id", "source", "target", F.array_join("path", " -> ").alias("path"), "length"
    )


@query
def reachable(t: Inputs) -> DataFrame:
    """What every module with a hard-coded secret imports, directly or not."""
    seeds = FN.findings(t.facts, only=("py-004",)).select("project_id", F.col("file_path").alias("id"))
    return TV.reachable(t.import_graph, seeds)


@query
def impact_set(t: Inputs) -> DataFrame:
    """Modules that depend on a module with a hard-coded secret."""
    seeds = FN.findings(t.facts, only=("py-004",)).select("project_id", F.col("file_path").alias("id"))
    return TV.impact_set(t.import_graph, seeds)


# Taint ------------------------------------------------------------------------------


@query
def taint_closure(t: Inputs) -> DataFrame:
    return TN.taint_closure(t.parsed).select("project_id", "file_path", "func_name", "var", "source")


@query
def taint_paths(t: Inputs) -> DataFrame:
    return TN.taint_closure(t.parsed).select(
        "project_id", "file_path", "var", F.array_join("path", " -> ").alias("path")
    )


@query
def tainted_sinks(t: Inputs) -> DataFrame:
    """Calls of any kind of which some argument is tainted in its function."""
    rows = FN.fact_rows(t.parsed, "python", R.RuleOptions(), {"call": lambda c: F.lit(True)})
    hit = rows.where("vars is not null").where(F.exists(
        "call.args", lambda arg: TN.python_arg_tainted(arg, F.col("vars"), TN.python_source_pattern(), False)
    ))
    return hit.select(
        "project_id", "file_path", F.col("call.callee").alias("callee"), F.col("call.line").alias("line")
    )


# Rules --------------------------------------------------------------------------------


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        "project_id", "id", "rule_id", "severity", "file_path", "start_line", "end_line"
    )


@query
def py_sql_injection(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-001",)))


@query
def py_command_injection(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-002",)))


@query
def py_path_traversal(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-003",)))


@query
def py_hardcoded_secrets(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-004",)))


@query
def py_unsafe_deser(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-005",)))


@query
def py_missing_auth(t: Inputs) -> DataFrame:
    return _hits(t.findings(only=("py-006",)))


@query
def secret_lines(t: Inputs) -> DataFrame:
    return FN.secret_lines(SR.explode_lines(t.files))


@query
def secret_scan(t: Inputs) -> DataFrame:
    docs = t.table("documents").select("doc_id", "source", "text")
    return FN.secret_scan(docs, "text").select("doc_id", "source", "name", "value")


@query
def all_findings(t: Inputs) -> DataFrame:
    return _hits(t.findings())


@query
def finding_snippets(t: Inputs) -> DataFrame:
    return t.findings().select("project_id", "rule_id", "file_path", "start_line", "title", "snippet")


@query
def findings_by_rule(t: Inputs) -> DataFrame:
    return FN.by_rule(t.findings())


@query
def severity_counts(t: Inputs) -> DataFrame:
    return FN.severity_counts(t.findings())


@query
def findings_min_severity(t: Inputs) -> DataFrame:
    return _hits(t.findings(R.RuleOptions(min_severity="high")))


_CONFIG = R.RuleOptions(
    disabled=frozenset({"py-006"}), severity={"py-004": "critical", "py-001": "low"},
    min_severity="medium",
)


@query
def findings_rule_config(t: Inputs) -> DataFrame:
    """Rules disabled and overridden before evaluation."""
    return _hits(t.findings(_CONFIG))


@query
def findings_config_table(t: Inputs) -> DataFrame:
    """The same configuration applied to findings by joins with a rule table."""
    config = t.spark.createDataFrame(
        [("py-006", False, None), ("py-004", True, "critical"), ("py-001", True, "low")],
        "rule_id string, enabled boolean, severity string",
    )
    return _hits(FN.min_severity(FN.apply_rule_config(t.findings(), config), "medium"))


@query
def findings_project_config(t: Inputs) -> DataFrame:
    """Findings under a configuration document of each project, flat, nested, broken or absent."""
    docs = t.table("region").select(
        F.concat(F.lit("proj"), F.col("r_regionkey").cast("string")).alias("project_id"),
        F.when(F.col("r_regionkey") == 0, '{"minSeverity": "high"}')
        .when(F.col("r_regionkey") == 1, '{"security": {"rules": {"py-006": {"enabled": false}}}}')
        .when(F.col("r_regionkey") == 2, '{"rules": {"py-004": {"severity": "critical"}}, "minSeverity": "critical"}')
        .otherwise("{broken").alias("json"),
    )
    return _hits(FN.apply_project_config(t.findings(), CF.with_flags(CF.project_config(docs), disable=("py-003",))))


@query
def rules_without_findings(t: Inputs) -> DataFrame:
    return FN.rules_without_findings(R.rules_table(t.spark, "python"), t.findings(), t.projects)


@query
def finding_share(t: Inputs) -> DataFrame:
    return FN.category_share(t.findings()).select(
        "project_id", "rule_id", "n", F.round("share", 9).alias("share")
    )


@query
def findings_ranked(t: Inputs) -> DataFrame:
    return FN.ranked(t.findings()).select("rank", "project_id", "file_path", "start_line", "rule_id")


@query
def action_list(t: Inputs) -> DataFrame:
    return FN.action_list(FN.findings(t.facts), 0.3).select(
        "priority", "project_id", "file_path", "start_line", "rule_id", "severity"
    )


@query
def clean_clusters(t: Inputs) -> DataFrame:
    """Sources of the documents as folders: those without a secret in any text."""
    docs = t.table("documents").select(
        F.lit("documents").alias("project_id"), "source", "doc_id", "text"
    )
    found = FN.secret_scan(docs, "text").select(
        "project_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path")
    )
    sources = docs.groupBy("project_id", F.col("source").alias("dir")).agg(
        F.count("*").alias("n_nodes")
    )
    return FN.clean_clusters(sources, found)


@query
def clean_files(t: Inputs) -> DataFrame:
    """Files without any finding."""
    found = t.findings().select("project_id", "file_path").distinct()
    return t.files.where("language = 'python'").select("project_id", "file_path").join(
        found, ["project_id", "file_path"], "left_anti"
    )


# Posture ------------------------------------------------------------------------------


@query
def project_posture(t: Inputs) -> DataFrame:
    return PO.posture(t.findings(), t.projects).select(
        "project_id", "total", "critical", "high", "medium", "low", "score", "grade"
    )


@query
def file_posture(t: Inputs) -> DataFrame:
    """The same score by file: each file as a project of its own."""
    found = t.findings().withColumn("project_id", F.col("file_path"))
    files = t.files.where("language = 'python'").select(F.col("file_path").alias("project_id"))
    return PO.posture(found, files).select("project_id", "total", "score", "grade")


@query
def posture_summary(t: Inputs) -> DataFrame:
    found = t.findings().withColumn("project_id", F.col("file_path"))
    files = t.files.where("language = 'python'").select(F.col("file_path").alias("project_id"))
    return PO.posture(found, files).select("project_id", "summary")


@query
def security_gate(t: Inputs) -> DataFrame:
    found = t.findings().withColumn("project_id", F.col("file_path"))
    files = t.files.where("language = 'python'").select(F.col("file_path").alias("project_id"))
    return PO.security_gate(found, files, "high")


@query
def posture_diff(t: Inputs) -> DataFrame:
    def scored(parsed: DataFrame, files: DataFrame) -> DataFrame:
        found = FN.findings(parsed).withColumn("project_id", F.col("file_path"))
        return PO.posture(found, files.where("language = 'python'").select(F.col("file_path").alias("project_id")))

    return PO.posture_diff(scored(t.parsed, t.files), scored(t.changed_parsed, t.changed_files))


@query
def findings_diff(t: Inputs) -> DataFrame:
    return FN.findings_diff(t.findings(), FN.findings(t.changed_parsed))


@query
def findings_rescan(t: Inputs) -> DataFrame:
    """The comparison of two scans through a store of facts: a text met in the first is not parsed again."""
    store = FactStore(t.spark, f"{shared_dir(t.spark)}/facts/{uuid.uuid4().hex}")
    before = FN.findings(store.facts(t.files))
    return FN.findings_diff(before, FN.findings(store.facts(t.changed_files)))


@query
def new_findings(t: Inputs) -> DataFrame:
    return FN.new_findings(t.findings(), FN.findings(t.changed_parsed))


# Growth -------------------------------------------------------------------------------


def _snapshots(t: Inputs) -> DataFrame:
    return GW.snapshot_counts(t.dated_types, F.to_date("ts"), F.col("event_type"))


@query
def growth_snapshot(t: Inputs) -> DataFrame:
    return _snapshots(t).withColumn("snapshot", F.col("snapshot").cast("string"))


@query
def component_snapshot(t: Inputs) -> DataFrame:
    return GW.component_snapshot(t.components, F.lit("2024-01-01"))


@query
def growth_delta(t: Inputs) -> DataFrame:
    return GW.growth_delta(_snapshots(t)).withColumn("snapshot", F.col("snapshot").cast("string"))


@query
def snapshot_log(t: Inputs) -> DataFrame:
    """Deltas over a log to which two snapshots were appended, one of them twice."""
    log = SK.SnapshotLog(t.spark, f"{shared_dir(t.spark)}/snapshots/{uuid.uuid4().hex}")
    counts = _snapshots(t)
    early = F.dayofmonth("snapshot") <= 15
    for batch, rows in (("early", counts.where(early)), ("late", counts.where(~early)), ("early", counts.where(early))):
        log.append(rows, batch)
    return GW.growth_delta(log.read()).withColumn("snapshot", F.col("snapshot").cast("string"))


# Reports ------------------------------------------------------------------------------


@query
def report_summary(t: Inputs) -> DataFrame:
    return RP.report_summary(CO.components(t.facts), t.relationships)


@query
def report_findings(t: Inputs) -> DataFrame:
    return RP.report_findings(t.findings())


@query
def report_json(t: Inputs) -> DataFrame:
    summary = RP.report_summary(CO.components(t.facts), t.relationships)
    found = FN.findings(t.facts)
    return RP.report_json(summary, PO.posture(found, t.projects))


@query
def report_sections(t: Inputs) -> DataFrame:
    """The relationship list of each report as JSON arrays of about 100 items."""
    rows = t.imports.select("project_id", "id", "source", "target", "type")
    return RP.section_parts(rows, "relationships", per_part=100)


@query
def sarif_results(t: Inputs) -> DataFrame:
    return RP.sarif_results(t.findings())


@query
def sarif_rules(t: Inputs) -> DataFrame:
    """The rule list of each project's SARIF run."""
    return RP.sarif_rules(t.projects, "python")


@query
def contract_check(t: Inputs) -> DataFrame:
    broken = t.components.withColumn(
        "type", F.when(F.endswith("name", F.lit("7")), "unknown").otherwise(F.col("type"))
    )
    return CK.contract_check(broken, "components")


@query
def contract_check_relationships(t: Inputs) -> DataFrame:
    return CK.contract_check(t.relationships, "relationships")


@query
def contract_check_graph(t: Inputs) -> DataFrame:
    """Nodes and edges of the graph against their contracts."""
    nodes = GR.graph_nodes(CO.components(t.facts), t.relationships)
    return CK.contract_check(nodes, "nodes").unionByName(CK.contract_check(GR.graph_edges(t.relationships), "edges"))


@query
def contract_check_posture(t: Inputs) -> DataFrame:
    return CK.contract_check(PO.posture(t.findings(), t.projects), "posture")


@query
def contract_check_findings(t: Inputs) -> DataFrame:
    return CK.contract_check(t.findings(), "findings")


# TypeScript ---------------------------------------------------------------------------


@query
def ts_decl_facts(t: Inputs) -> DataFrame:
    return _flat(t.script_components)


@query
def ts_members(t: Inputs) -> DataFrame:
    """Methods of classes, with their modifiers and parameters."""
    methods = CO.of_type(t.script_components, "class").select(
        "project_id", F.col("name").alias("class_name"), F.inline("metadata.methods")
    )
    return methods.select(
        "project_id", "class_name", "name", "visibility", "is_static", "is_async", "return_type",
        F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("params"),
        F.array_join(
            F.transform("parameters", lambda p: p["is_optional"].cast("string")), ","
        ).alias("optional"),
    )


@query
def ts_properties(t: Inputs) -> DataFrame:
    return t.script_components.where("metadata.properties is not null").select(
        "project_id", F.col("name").alias("owner"), F.inline("metadata.properties")
    )


@query
def ts_import_edges(t: Inputs) -> DataFrame:
    return _edge_rows(RS.relationships(SS.import_edges(SS.resolved_imports(t.script_facts("imports")))))


@query
def ts_inherit_edges(t: Inputs) -> DataFrame:
    facts = t.script_facts("decls", "imports")
    hits = SS.resolved_imports(facts)
    comps = CO.components(facts, "typescript")
    return _edge_rows(RS.relationships(SS.inherit_edges(facts, hits, comps)))


@query
def ts_call_edges(t: Inputs) -> DataFrame:
    facts = t.script_facts("decls", "imports", "calls")
    hits = SS.resolved_imports(facts)
    comps = CO.components(facts, "typescript")
    return _edge_rows(RS.relationships(SS.call_edges(facts, hits, comps)))


@query
def unsanitized_lines(t: Inputs) -> DataFrame:
    """The line form of the rule over every TypeScript and JavaScript file, vendored or not."""
    return FN.unsanitized_lines(SR.explode_lines(t.all_script_files))


@query
def unsanitized_input(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-001",)))


@query
def sql_injection_scan(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-002",)))


@query
def missing_auth(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-003",)))


@query
def hardcoded_secrets(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-004",)))


@query
def unsafe_eval_scan(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-005",)))


@query
def command_injection_scan(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-006",)))


@query
def path_traversal_scan(t: Inputs) -> DataFrame:
    return _hits(t.script_findings(only=("sec-007",)))


@query
def ts_findings(t: Inputs) -> DataFrame:
    return _hits(t.script_findings())


@query
def ts_taint_paths(t: Inputs) -> DataFrame:
    return TN.taint_closure(t.script_parsed, "typescript").select(
        "project_id", "file_path", "var", F.array_join("path", " -> ").alias("path")
    )


@query
def ts_posture(t: Inputs) -> DataFrame:
    found = t.script_findings().withColumn("project_id", F.col("file_path"))
    files = t.script_files.select(F.col("file_path").alias("project_id"))
    return PO.posture(found, files, "typescript").select("project_id", "score", "grade", "summary")


# Streams ------------------------------------------------------------------------------


@query
def stream_scan(t: Inputs) -> DataFrame:
    """Files arriving as a stream, scanned for secrets batch by batch."""
    return ST.scan_arriving(t.spark, t.sf_dir)


@query
def stream_gate(t: Inputs) -> DataFrame:
    """Whether a project was stopped in any batch of arriving files."""
    return ST.gate(ST.scan_arriving(t.spark, t.sf_dir))


@query
def growth_windows(t: Inputs) -> DataFrame:
    return ST.growth_windows(t.spark, t.sf_dir)
