"""The dependency graph: nodes, edges, folders as clusters, degrees and coupling.

``nodes`` carry ``project_id, id, cluster``; ``edges`` carry ``project_id,
source, target, type``.  Nodes of components also carry ``key``, and their edges ``source_key`` and
``target_key``: then these are what nodes are known by, and ids, which may coincide, are labels.
Every aggregate combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.functions import paths as P
from srcweave.functions.ids import bucket_of
from srcweave.functions.severity import edge_weight
from srcweave.operators.keys import keyed_edges, keyed_nodes
from srcweave.session import as_lookup

_END = ["project_id", "key"]


def graph_nodes(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components as nodes, sized by length and number of connections."""
    sized = node_size(comps, edges)
    return sized.select(
        "project_id", "id", "key", F.col("name").alias("label"), "type",
        P.group_name(F.col("file_path")).alias("group"),
        P.dir_name(F.col("file_path")).alias("cluster"),
        "size",
        F.struct(
            "file_path", "start_line", "end_line", F.col("metadata.loc").alias("loc"),
            F.col("metadata.is_exported").alias("is_exported"),
        ).alias("metadata"),
    )


def graph_edges(relationships: DataFrame) -> DataFrame:
    return keyed_edges(relationships).select(
        "project_id", "id", "source", "target", "type",
        edge_weight(F.col("type")).alias("weight"), "import_specifiers", "source_key", "target_key",
    )


def clustered(comps: DataFrame) -> DataFrame:
    """The node columns cluster operators need."""
    return comps.select(
        "project_id", "id", "key", "type", P.dir_name(F.col("file_path")).alias("cluster")
    )


def clusters(comps: DataFrame) -> DataFrame:
    """One row per folder: its label and how many components it holds."""
    path = F.col("file_path")
    label = P.base_name(F.col("dir"))
    return (
        comps.groupBy("project_id", P.dir_name(path).alias("dir"))
        .agg(F.count("*").alias("n_nodes"))
        .select(
            "project_id", "dir", F.concat(F.lit("cluster-"), label).alias("cluster_id"),
            label.alias("label"), "n_nodes",
        )
    )


def cluster_node_lists(comps: DataFrame, per_row: int = 1000) -> DataFrame:
    """Node ids of each folder as arrays of about ``per_row`` ids.

    A folder of any size is spread over hash buckets, so no task gathers it whole;
    folders up to ``per_row`` come as one row.
    """
    sizes = clusters(comps).withColumn(
        "n_buckets", F.ceil(F.col("n_nodes") / F.lit(per_row)).cast("bigint")
    )
    members = comps.select("project_id", P.dir_name(F.col("file_path")).alias("dir"), "id")
    placed = members.join(as_lookup(sizes), ["project_id", "dir"]).withColumn(
        "bucket", bucket_of(F.col("id"), F.col("n_buckets"))
    )
    # Without this the grouping would keep the join's partitions: one folder, one task.
    placed = placed.repartition("project_id", "dir", "bucket")
    return placed.groupBy("project_id", "dir", "cluster_id", "label", "bucket").agg(
        F.sort_array(F.collect_list("id")).alias("node_ids")
    )


# Degrees --------------------------------------------------------------------


def in_out_degree(edges: DataFrame) -> DataFrame:
    """Inbound and outbound connections of each connected node, one scan."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("source_key").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("id"), F.col("target_key").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (
        keyed_edges(edges).select("project_id", F.inline(ends))
        .groupBy(*_END)
        .agg(F.min("id").alias("id"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        .select("project_id", "id", "in_degree", "out_degree", "key")
    )


def node_degree(edges: DataFrame) -> DataFrame:
    """Connections of each node; a self-loop counts twice."""
    return _degree_of(edges).select("project_id", "id", "degree", "key")


def _degree_of(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("source_key").alias("key")),
        F.struct(F.col("target").alias("id"), F.col("target_key").alias("key")),
    )
    return (
        keyed_edges(edges).select("project_id", F.inline(ends))
        .groupBy(*_END)
        .agg(F.min("id").alias("id"), F.count("*").alias("degree"))
    )


def node_size(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``max(1, log2(loc + 1) + degree)`` for every component."""
    degree = _degree_of(edges).drop("id")
    joined = keyed_nodes(comps).join(degree, _END, "left").fillna(0, ["degree"])
    loc = F.coalesce(F.col("metadata.loc"), F.lit(1))
    size = F.greatest(F.lit(1.0), F.log2(loc + 1) + F.col("degree"))
    return joined.withColumn("size", size)


def hubs(edges: DataFrame, k: int = 10, per_project: bool = False) -> DataFrame:
    """The ``k`` most connected nodes, overall or of each project."""
    degree = in_out_degree(edges).withColumn(
        "degree", F.col("in_degree") + F.col("out_degree")
    )
    if not per_project:
        return degree.orderBy(F.desc("degree"), "project_id", "id", "key").limit(k)
    order = Window.partitionBy("project_id").orderBy(F.desc("degree"), "id", "key")
    return degree.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def god_objects(
    edges: DataFrame, min_degree: int = 10, ratio: float = 3.0, orchestrator_out: int = 20
) -> DataFrame:
    """Very connected nodes, told apart as utility or orchestrator hubs."""
    degree = in_out_degree(edges).withColumn(
        "degree", F.col("in_degree") + F.col("out_degree")
    )
    role = (
        F.when(F.col("out_degree") >= orchestrator_out, "orchestrator")
        .when(F.col("in_degree") >= ratio * F.col("out_degree"), "utility")
        .otherwise("mixed")
    )
    return degree.where(F.col("degree") >= min_degree).withColumn("role", role)


def island_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any connection."""
    return keyed_nodes(nodes).join(_degree_of(edges), _END, "left_anti")


def facade_nodes(edges: DataFrame, min_in: int = 5, max_out: int = 1) -> DataFrame:
    """Many depend on it, it depends on little."""
    return in_out_degree(edges).where(
        (F.col("in_degree") >= min_in) & (F.col("out_degree") <= max_out)
    )


def edge_key_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each project, the nodes they touch, and how many of these are no node."""
    known = keyed_nodes(nodes).select(*_END, F.lit(1).alias("known")).distinct()
    touched = _degree_of(edges).select(*_END).join(known, _END, "left")
    ends = touched.groupBy("project_id").agg(
        F.count("*").alias("n_touched"), F.count_if(F.col("known").isNull()).alias("n_unknown")
    )
    counts = keyed_edges(edges).groupBy("project_id").agg(F.count("*").alias("n_edges"))
    return counts.join(ends, "project_id").select("project_id", "n_edges", "n_touched", "n_unknown")


# Subsets --------------------------------------------------------------------


def import_subset(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'imports'")


def subgraph(
    nodes: DataFrame,
    edges: DataFrame,
    types: list[str] | None = None,
    clusters_: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types and clusters, and the edges with both ends among them."""
    kept = keyed_nodes(nodes)
    if types is not None:
        kept = kept.where(F.col("type").isin(*types))
    if clusters_ is not None:
        kept = kept.where(F.col("cluster").isin(*clusters_))
    keys = kept.select(*_END)
    edges = keyed_edges(edges)
    inner = edges.join(keys.withColumnRenamed("key", "source_key"), ["project_id", "source_key"], "left_semi")
    inner = inner.join(keys.withColumnRenamed("key", "target_key"), ["project_id", "target_key"], "left_semi")
    return kept, inner.select(*edges.columns)


# Clusters -------------------------------------------------------------------


def _placed(nodes: DataFrame) -> DataFrame:
    """The cluster of each node, one row per key."""
    return as_lookup(keyed_nodes(nodes).groupBy(*_END).agg(F.max("cluster").alias("cluster")))


def with_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the cluster of both ends."""
    ends = _placed(nodes)
    own = edges.columns
    joined = keyed_edges(edges).join(
        ends.toDF("project_id", "source_key", "source_cluster"), ["project_id", "source_key"]
    ).join(ends.toDF("project_id", "target_key", "target_cluster"), ["project_id", "target_key"])
    return joined.select(*own, "source_cluster", "target_cluster")


def cross_cluster_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return with_clusters(nodes, edges).where("source_cluster <> target_cluster")


def directed_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edges from one cluster to another.

    Edges are counted by cluster and target before the targets are looked up, so
    a node many depend on is one row per cluster, however many edges it has.
    """
    ends = _placed(nodes)
    to_node = (
        keyed_edges(edges).join(ends.toDF("project_id", "source_key", "source_cluster"), ["project_id", "source_key"])
        .groupBy("project_id", "source_cluster", "target_key")
        .agg(F.count("*").alias("c"))
    )
    return (
        to_node.join(ends.toDF("project_id", "target_key", "target_cluster"), ["project_id", "target_key"])
        .where("source_cluster <> target_cluster")
        .groupBy("project_id", "source_cluster", "target_cluster")
        .agg(F.sum("c").alias("n"))
    )


def cluster_coupling(nodes: DataFrame, edges: DataFrame, flag_at: int = 5) -> DataFrame:
    """Edges between each pair of clusters, in each direction, flagged when many."""
    forward = F.col("source_cluster") < F.col("target_cluster")
    return (
        directed_pairs(nodes, edges)
        .groupBy(
            "project_id",
            F.least("source_cluster", "target_cluster").alias("cluster_a"),
            F.greatest("source_cluster", "target_cluster").alias("cluster_b"),
        )
        .agg(
            F.sum("n").alias("n_edges"),
            F.coalesce(F.sum(F.when(forward, F.col("n"))), F.lit(0)).alias("a_to_b"),
            F.coalesce(F.sum(F.when(~forward, F.col("n"))), F.lit(0)).alias("b_to_a"),
        )
        .withColumn("high_coupling", F.col("n_edges") >= flag_at)
    )


def one_way_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cluster pairs with edges in one direction only."""
    pairs = cluster_coupling(nodes, edges).where("a_to_b = 0 or b_to_a = 0")
    forward = F.col("a_to_b") > 0
    return pairs.select(
        "project_id",
        F.when(forward, F.col("cluster_a")).otherwise(F.col("cluster_b")).alias("from_cluster"),
        F.when(forward, F.col("cluster_b")).otherwise(F.col("cluster_a")).alias("to_cluster"),
        "n_edges",
    )


def isolated_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters no edge enters or leaves."""
    touched = directed_pairs(nodes, edges).select(
        "project_id", F.explode(F.array("source_cluster", "target_cluster")).alias("cluster")
    )
    every = nodes.groupBy("project_id", "cluster").agg(F.count("*").alias("n_nodes"))
    return every.join(touched.distinct(), ["project_id", "cluster"], "left_anti")


def star_clusters(nodes: DataFrame, edges: DataFrame, min_satellites: int = 3) -> DataFrame:
    """Clusters that many other clusters depend on."""
    return (
        directed_pairs(nodes, edges)
        .groupBy("project_id", F.col("target_cluster").alias("cluster"))
        .agg(F.count("*").alias("n_satellites"), F.sum("n").alias("n_edges"))
        .where(F.col("n_satellites") >= min_satellites)
    )


def _folders(path: Column) -> Column:
    """The folders around a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folder_rollup(comps: DataFrame, imports: DataFrame) -> DataFrame:
    """For the folders of every level: nodes below, edges inside, and edges that leave or enter.

    ``imports`` hold ``file_path`` and ``target_path``.  An edge lies inside the lowest folder that holds both its ends
    and inside all folders around that, and crosses the folders below it on both sides.  Nodes and edges are counted
    by folder and by pair of folders first, so a row goes to all levels once for each of these, not for each node.
    """
    nodes = comps.groupBy("project_id", P.dir_name(F.col("file_path")).alias("dir")).agg(F.count("*").alias("n"))
    per_node = nodes.select("project_id", F.explode(_folders(F.col("dir"))).alias("folder"), "n", F.lit(0).alias("i"), F.lit(0).alias("c"))
    pairs = imports.select("project_id", "file_path", "target_path").distinct().groupBy(
        "project_id", P.dir_name(F.col("file_path")).alias("a"), P.dir_name(F.col("target_path")).alias("b")
    ).agg(F.count("*").alias("m"))
    a, b = _folders(F.col("a")), _folders(F.col("b"))
    inside = F.array_intersect(a, b)
    crossed = F.concat(F.array_except(a, b), F.array_except(b, a))
    tag = lambda folders, i, c: F.transform(folders, lambda f: F.struct(f.alias("folder"), F.lit(i).alias("i"), F.lit(c).alias("c")))
    per_edge = pairs.select("project_id", "m", F.inline(F.concat(tag(inside, 1, 0), tag(crossed, 0, 1)))).select(
        "project_id", "folder", F.lit(0).cast("long").alias("n"), (F.col("m") * F.col("i")).alias("i"), (F.col("m") * F.col("c")).alias("c")
    )
    return per_node.unionByName(per_edge).groupBy("project_id", "folder").agg(
        F.sum("n").alias("n_nodes"), F.sum("i").alias("n_inner"), F.sum("c").alias("n_cross")
    )


def cluster_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, inner edges and crossing edges of each cluster, with project totals.

    An edge that crosses counts for both clusters in their rows and once in the
    total, whose ``cluster`` is null.
    """
    sides = F.when(
        F.col("source_cluster") == F.col("target_cluster"),
        F.array(F.struct(F.col("source_cluster").alias("cluster"), F.lit(2).alias("inner2"),
                         F.lit(0).alias("cross2"))),
    ).otherwise(
        F.array(
            F.struct(F.col("source_cluster").alias("cluster"), F.lit(0).alias("inner2"),
                     F.lit(1).alias("cross2")),
            F.struct(F.col("target_cluster").alias("cluster"), F.lit(0).alias("inner2"),
                     F.lit(1).alias("cross2")),
        )
    )
    per_edge = with_clusters(nodes, edges).select(
        "project_id", F.inline(sides)
    ).withColumn("nodes", F.lit(0))
    per_node = nodes.select(
        "project_id", "cluster", F.lit(0).alias("inner2"), F.lit(0).alias("cross2"),
        F.lit(1).alias("nodes"),
    )
    total = F.grouping("cluster") == 1
    return (
        per_edge.unionByName(per_node)
        .rollup("project_id", "cluster")
        .agg(
            F.sum("nodes").alias("n_nodes"),
            (F.sum("inner2") / 2).cast("bigint").alias("n_inner"),
            F.when(total, (F.sum("cross2") / 2).cast("bigint")).otherwise(F.sum("cross2")).alias(
                "n_cross"
            ),
        )
        .where("project_id is not null")
    )
