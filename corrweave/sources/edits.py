"""Changes to a graph as a table, merged by key.

A row of changes is one edit: `seq` (their order), `op`, and what it needs:

* "add": src, dst, label (1 if null) and series of a new edge; its id follows the highest one, in the order of seq;
* "series", "label": edge_id and the new series or label of an edge; of several, the last one holds;
* "node": src (a node) and label (its new label), for `relabel_nodes`.

Edges and their ids stay as they are otherwise: supports are computed for new
series only, and incidences for new edges. Edits of edges that don't exist, of
null keys, and edits without what they need change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.sources.graph import dense_index, incidence

CHANGES = "seq long, op string, edge_id long, src long, dst long, label int, series array<double>"
_EDGE = ("edge_id", "src", "dst", "label", "series", "support")


def _last(changes: DataFrame, op: str, key: str, value: str) -> DataFrame:
    """(key, value): the last edit of each key; ties of seq go to the greater value."""
    own = changes.filter((F.col("op") == op) & F.col(key).isNotNull() & F.col(value).isNotNull())
    return own.groupBy(key).agg(F.max(F.struct("seq", value))[value].alias(f"new_{value}"))


def added_edges(edges: DataFrame, changes: DataFrame, weighted: bool = False) -> DataFrame:
    """The new edges, with ids from the highest of `edges` on."""
    own = changes.filter((F.col("op") == "add") & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("series").isNotNull())
    numbered = dense_index(own.select("seq", "src", "dst", F.coalesce("label", F.lit(1)).alias("label"), "series"), ["seq", "src", "dst"], "place")
    top = edges.agg(F.max("edge_id")).first()[0]
    placed = numbered.withColumn("edge_id", F.col("place") + F.lit(0 if top is None else top + 1))
    return placed.withColumn("support", S.support(F.col("series"), weighted)).select(*_EDGE)


def apply_changes(edges: DataFrame, changes: DataFrame, weighted: bool = False) -> DataFrame:
    """The edges after the changes."""
    series, label = _last(changes, "series", "edge_id", "series"), _last(changes, "label", "edge_id", "label")
    both = edges.join(series, "edge_id", "left").join(label, "edge_id", "left")
    support = F.when(F.col("new_series").isNotNull(), S.support(F.col("new_series"), weighted)).otherwise(F.col("support"))
    changed = both.select("edge_id", "src", "dst", F.coalesce("new_label", "label").alias("label"), F.coalesce("new_series", "series").alias("series"), support.alias("support"))
    return changed.unionByName(added_edges(edges, changes, weighted))


def apply_to_incidence(incidences: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, edge_id) after the changes: only new edges have new ones."""
    return incidences.select("node", "edge_id").unionByName(incidence(added_edges(edges, changes)))


def relabel_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """The node dictionary (node_id, node_label) after the changes."""
    new = _last(changes, "node", "src", "label").withColumnRenamed("src", "node_id")
    return nodes.join(new, "node_id", "left").select("node_id", F.coalesce(F.col("new_label").cast("long"), "node_label").alias("node_label"))
