"""Dense numbers for composite keys, so that joins and iterations run on longs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcweave.session import write_once


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``source_key`` and ``target_key``; where an id is all there is, it is the key."""
    for end in ("source", "target"):
        if f"{end}_key" not in edges.columns:
            edges = edges.withColumn(f"{end}_key", F.col(end))
    return edges


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a ``key``; where an id is all there is, it is the key."""
    return nodes if "key" in nodes.columns else nodes.withColumn("key", F.col("id"))


def by_key(edges: DataFrame) -> DataFrame:
    """Edges whose ``source`` and ``target`` are the keys, for operators on plain graphs."""
    return keyed_edges(edges).withColumns({"source": F.col("source_key"), "target": F.col("target_key")})

_ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def numbered(rows: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    """The distinct combinations of some columns with numbers 0, 1, 2 … in their order.

    Keys are dealt out by range and sorted in their partitions; a key's number is its place there plus the
    sizes of the partitions before.  Only the sizes, one row a partition, meet in one task.
    """
    keys = write_once(rows.select(*columns).distinct())  # read twice: for the ranges and for the numbers
    sorted_keys = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = write_once(sorted_keys.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return write_once(
        placed.withColumn("_part", part).join(sizes, "_part").select(*columns, number.alias(name))
    )


def number_nodes(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """``project_id, id, n`` of all ends of edges and of the ``project_id, id`` of other tables."""
    ends = edges.select("project_id", F.explode(F.array("source", "target")).alias("id"))
    for other in others:
        ends = ends.unionByName(other.select("project_id", "id"))
    return numbered(ends.where("id IS NOT NULL"), ["project_id", "id"])


def encoded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges as pairs ``a, b`` of node numbers, written once."""
    a = nodes.toDF("project_id", "source", "a")
    b = nodes.toDF("project_id", "target", "b")
    return write_once(
        edges.select("project_id", "source", "target").distinct()
        .join(a, ["project_id", "source"]).join(b, ["project_id", "target"]).select("a", "b")
    )
