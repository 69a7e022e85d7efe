"""Edge tables: from edge-list files, from long tables, and derived from relational ones.

`edges`: edge_id bigint, src bigint, dst bigint, label int, series array<double>, support double.
`edge_snap`: edge_id bigint, t int, w double, for the snapshots in which an edge is alive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.functions import series as S
from corrweave.session import cut


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with a dense 0-based index in the order of some columns.

    Rows are range partitioned and sorted; each partition numbers its own
    rows and starts after those of the earlier ones, of which one count for
    each partition goes to the driver. No stage holds all rows.
    """
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    parted = parted.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r[0], r[1]) for r in parted.groupBy("_pid").count().collect())
    starts, total = [], 0
    for pid, n in counts:
        starts.append((pid, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_pid int, _start long")
    return parted.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_start") + F.col("_at")).drop("_pid", "_at", "_start")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, edge_id): the lines of text files, numbered from 0 in the order of file names and places.

    Lines number themselves within their split of a file; only one count for
    each split goes to the driver.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = cut(spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_m")))
    counts = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)), F.min("_m")).collect()
    rows, total = [], 0
    for file, block, n, first in sorted(tuple(r) for r in counts):
        rows.append((file, block, total - first))
        total += n
    shifts = spark.createDataFrame(rows, "_file string, _block long, _shift long")
    return lines.join(F.broadcast(shifts), ["_file", "_block"]).select("value", (F.col("_m") + F.col("_shift")).alias("edge_id"))


def read_edge_list(spark: SparkSession, path: str, labeled: bool = False, weighted: bool = False) -> DataFrame:
    """Edges of a text file: `src dst [label] series`, parted by one blank; ids are line numbers from 0.

    Lines that are blank are ignored. Lines of another form, and series whose
    lengths differ, are errors.
    """
    raw = numbered_lines(spark, path).filter(F.trim("value") != "")
    part = F.split("value", " ")
    n = 4 if labeled else 3
    good = F.size(part) == n
    checked = raw.withColumn("p", F.when(good, part).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))))
    p = F.col("p")
    edges = checked.select(
        "edge_id",
        p[0].cast("long").alias("src"),
        p[1].cast("long").alias("dst"),
        (p[2].cast("int") if labeled else F.lit(1)).alias("label"),
        S.parse_series(p[n - 1]).alias("series"),
    )
    edges = edges.withColumn("support", S.support(F.col("series"), weighted))
    return validate(edges)


def validate(edges: DataFrame) -> DataFrame:
    """The same edges; an error if series lengths differ."""
    low, high = edges.agg(F.min(F.size("series")), F.max(F.size("series"))).first()
    if low != high:
        raise ValueError(f"series have between {low} and {high} snapshots; all must have the same number")
    return edges


def edges_from_long(cells: DataFrame, n_snapshots: int, weighted: bool = False) -> DataFrame:
    """Edges from (src, dst, t, w) cells; missing cells are 0. Edge ids follow (src, dst)."""
    grouped = cells.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("w").cast("double")))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_snapshots - 1)), lambda t: F.coalesce(F.try_element_at(F.col("m"), t), F.lit(0.0)))
    edges = dense_index(grouped.select("src", "dst", F.lit(1).alias("label"), filled.alias("series")), ["src", "dst"], "edge_id")
    return edges.select("edge_id", "src", "dst", "label", "series", S.support(F.col("series"), weighted).alias("support"))


def snapshots(edges: DataFrame) -> DataFrame:
    """Long form of the snapshots in which each edge is alive."""
    cells = edges.select("edge_id", F.posexplode("series").alias("t", "w"))
    return cells.filter(F.col("w") > 0)


def node_dictionary(edges: DataFrame) -> DataFrame:
    """node_id (dense, by first appearance, src before dst) and node_label (the id in the input)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("edge_id").alias("e"), F.lit(0).alias("side"), F.col("src").alias("n")), F.struct(F.col("edge_id").alias("e"), F.lit(1).alias("side"), F.col("dst").alias("n")))).alias("x"))
    first = ends.groupBy(F.col("x.n").alias("node_label")).agg(F.min(F.struct("x.e", "x.side")).alias("at"))
    keyed = first.select("node_label", F.col("at.e").alias("e"), F.col("at.side").alias("side"))
    return dense_index(keyed, ["e", "side"], "node_id").select("node_id", "node_label")


def incidence(edges: DataFrame) -> DataFrame:
    """(node, edge_id), twice for a self-loop."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "edge_id")


# --- a graph from relational tables: trade between nations --------------------------------------------------------


def nation_cells(spark: SparkSession, sf_dir: str, loops: bool = False) -> DataFrame:
    """(src, dst, t, w): line items between the nations of customer and supplier in a month; with `loops`, those within one nation instead."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("t"))
    placed = orders.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    items = read("lineitem").select("l_orderkey", "l_suppkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = F.col("c_nationkey"), F.col("s_nationkey")
    return items.filter(a == b if loops else a != b).groupBy(F.least(a, b).cast("long").alias("src"), F.greatest(a, b).cast("long").alias("dst"), F.col("t").cast("int").alias("t")).agg(F.count(F.lit(1)).alias("w"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted graph: the series of an edge are its monthly line items."""
    cells = cut(nation_cells(spark, sf_dir))
    n = cells.agg(F.max("t")).first()[0]
    return edges_from_long(cells, (n if n is not None else -1) + 1, weighted=True)


def bursts(trade: DataFrame, times: int = 3, parts: int = 2) -> DataFrame:
    """The binary graph of a weighted one: an edge is alive in snapshots with at least times / parts of its own mean."""
    w, n = F.col("series"), F.size("series")
    burst = S.let(times * S.total(w), lambda bound: F.transform(w, lambda x: F.when((x > 0) & (parts * x * n >= bound), 1.0).otherwise(0.0)))
    return trade.withColumn("series", burst).withColumn("support", S.support(F.col("series")))


def nation_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary graph: an edge is alive in months with at least 1.5 times its own mean."""
    return bursts(nation_trade(spark, sf_dir))
