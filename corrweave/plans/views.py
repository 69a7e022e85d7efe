"""Views of results for a visual front end: long tables and the JSON documents made of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.sources.graph import dense_index

CLASSES = 6


def density_classes(results: DataFrame) -> DataFrame:
    """(id, value): the six highest densities, rounded to three places; lower ones belong to the sixth."""
    top = results.select(F.bround("density", 3).alias("value")).distinct().orderBy(F.desc("value")).limit(CLASSES)
    return top.select(F.row_number().over(Window.orderBy(F.desc("value"))).cast("long").alias("id"), "value")  # six rows


def numbered(results: DataFrame) -> DataFrame:
    """Results by falling density: ordinal s, density class, and sid (class and ordinal written one after the other)."""
    keyed = results.select("edges", "density", (-F.col("density")).alias("_d"), (-F.size("edges")).alias("_n"), F.bround("density", 3).alias("value"))
    ordered = dense_index(keyed, ["_d", "_n", "edges"], "s")
    classes = density_classes(results)
    known = ordered.join(F.broadcast(classes), "value", "left").withColumn("class", F.coalesce("id", F.lit(CLASSES).cast("long")))
    return known.select("s", "edges", "density", "class", F.concat(F.col("class").cast("string"), F.col("s").cast("string")).cast("long").alias("sid"))


def _uses(results: DataFrame, edges: DataFrame) -> DataFrame:
    placed = numbered(results).select("s", "sid", F.posexplode("edges").alias("place", "edge_id"))
    return placed.join(edges.select("edge_id", "src", "dst"), "edge_id")


def result_nodes(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, position, sids): nodes of the results in order of first appearance, with the sets they are in."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("name")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("name"))))
    x = _uses(results, edges).select("s", "place", "sid", ends.alias("x"))
    grouped = x.groupBy("x.name").agg(F.min(F.struct("s", "place", "x.side")).alias("first"), F.array_sort(F.collect_set("sid")).alias("sids"))
    flat = grouped.select("name", F.col("first.s").alias("a"), F.col("first.place").alias("b"), F.col("first.side").alias("c"), "sids")
    return dense_index(flat, ["a", "b", "c"], "position").select("name", "position", "sids")


def result_edges(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, sids): edges of the results with the sets they are in."""
    return _uses(results, edges).groupBy("src", "dst").agg(F.array_sort(F.collect_set("sid")).alias("sids"))


def result_json(results: DataFrame, edges: DataFrame) -> str:
    """The document of nodes, edges and densities; "" without results. For a result small enough to be looked at."""
    if results.isEmpty():
        return ""
    nodes = result_nodes(results, edges).orderBy("position").collect()
    at = {r["name"]: r["position"] for r in nodes}
    text = lambda sids: ",".join(map(str, sids))
    used = sorted((at[r["src"]], at[r["dst"]], r["sids"]) for r in result_edges(results, edges).collect())
    return json.dumps({
        "nodes": [{"name": r["name"], "sids": text(r["sids"])} for r in nodes],
        "edges": [{"source": a, "target": b, "sids": text(s)} for a, b, s in used],
        "densities": [{"id": r["id"], "value": r["value"]} for r in density_classes(results).orderBy(F.desc("id")).collect()],
    })


def exploded_view(edges: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(number, source, target): the wanted edges (source, target, in either order) alive in each snapshot with at least `k` of them."""
    ends = wanted.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    own = edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(ends, ["lo", "hi"])
    x = own.select("src", "dst", F.explode(S.alive(F.col("series"))).alias("number"))
    full = x.groupBy("number").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= max(1, k))
    return x.join(full, "number").select("number", F.col("src").alias("source"), F.col("dst").alias("target"))


def exploded_json(view: DataFrame) -> str:
    """The snapshots of an exploded view, ascending, each with its nodes and edges by position."""
    by_t: dict[int, list[tuple[int, int]]] = {}
    for number, source, target in view.orderBy("number", "source", "target").collect():
        by_t.setdefault(number, []).append((source, target))
    out = []
    for number, pairs in sorted(by_t.items()):
        at: dict[int, int] = {}
        for pair in pairs:
            for n in pair:
                at.setdefault(n, len(at))
        out.append({"number": number, "subgraph": {"nodes": [{"name": n} for n in at], "edges": [{"source": at[a], "target": at[b]} for a, b in pairs]}})
    return json.dumps(out)
