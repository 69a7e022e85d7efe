"""Writers of results and run statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.config import MineConfig

#: Columns of the statistics table.
STATISTICS = "file string, at string, seconds double, n_results long, is_min boolean, min_cor double, min_den double, max_size int, k int, max_jac double, lsh string"


def result_name(config: MineConfig) -> str:
    """A file name that tells the parameters."""
    parts = [config.name or "graph", f"cor{config.min_cor:g}", f"{config.density}{config.min_den:g}", f"k{config.min_edges_in_snap}", f"size{config.max_cc_size}", f"jac{config.max_jac:g}"]
    if not config.exact:
        parts.append(f"lsh{config.hash_funcs}x{config.hash_runs}")
    return "_".join(parts)


def write_results(results: DataFrame, path: str, single_file: bool = True) -> None:
    """One set a line, each edge id followed by a tab."""
    lines = results.select(F.concat(F.array_join("edges", "\t"), F.lit("\t")).alias("value"))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_edge_list(edges: DataFrame, path: str, labeled: bool = False) -> None:
    """Edges as `src dst [label] series` lines in the order of their ids, as `read_edge_list` takes them; files are in the order of their names."""
    number = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    parts = [F.col("src").cast("string"), F.col("dst").cast("string"), *([F.col("label").cast("string")] if labeled else []), F.array_join(F.transform("series", number), ",")]
    edges.repartitionByRange("edge_id").sortWithinPartitions("edge_id").select(F.concat_ws(" ", *parts).alias("value")).write.mode("overwrite").text(path)


def append_statistics(spark: SparkSession, config: MineConfig, seconds: float, n_results: int, path: str) -> None:
    """Append a run to a tab-separated table: file, timestamp, seconds, results, parameters, and hashing if it was used."""
    lsh = "" if config.exact else f"{config.hash_funcs}+{config.hash_runs}"
    row = (
        config.name or config.path, datetime.now().strftime("%Y.%m.%d.%H.%M.%S"), float(seconds), int(n_results), config.density == "min",
        float(config.min_cor), float(config.min_den), config.max_cc_size, config.min_edges_in_snap, float(config.max_jac), lsh,
    )
    spark.createDataFrame([row], STATISTICS).coalesce(1).write.mode("append").option("sep", "\t").csv(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATISTICS).option("sep", "\t").csv(path)
