"""Mining runs from edges to diverse dense correlated subgraphs."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave import config as C
from corrweave.config import MineConfig
from corrweave.operators.candidates import candidates
from corrweave.operators.cliques import maximal_cliques
from corrweave.operators.correlate import correlated_pairs
from corrweave.operators.lattice import classify
from corrweave.operators.peel import Rules
from corrweave.operators.select import diverse
from corrweave.plans import views
from corrweave.session import cut
from corrweave.sources.graph import node_dictionary, read_edge_list
from corrweave.sources.results import append_statistics, result_name, write_results

log = logging.getLogger(__name__)

#: The poll at which a front end is told that there is no result.
POLLS = 5


def rules_of(config: MineConfig) -> Rules:
    return Rules(config.min_den, config.min_edges_in_snap, config.density, config.prune)


def classified(edges: DataFrame, config: MineConfig) -> DataFrame:
    """Candidates of the graph with their classes and dense sets."""
    pairs = cut(correlated_pairs(edges, config.min_cor, config.exact, config.weighted, config.hash_funcs, config.hash_runs, config.spread))
    cands = candidates(maximal_cliques(pairs), edges, config.min_den)
    return classify(cands.filter(F.col("n_edges") < config.max_cc_size), edges, rules_of(config))


def staged(edges: DataFrame, config: MineConfig) -> tuple[DataFrame, list[tuple[str, int, float]]]:
    """The result of `mine`, and (stage, rows, seconds) of each stage; every stage is checkpointed, so that its seconds are its own."""
    log_: list[tuple[str, int, float]] = []

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        done = cut(df)
        log_.append((name, done.count(), time.perf_counter() - began))
        log.info("%s: %d in %.1f s", *log_[-1])
        return done

    pairs = stage("correlated_pairs", correlated_pairs(edges, config.min_cor, config.exact, config.weighted, config.hash_funcs, config.hash_runs, config.spread))
    cliques = stage("maximal_cliques", maximal_cliques(pairs))
    cands = stage("candidates", candidates(cliques, edges, config.min_den).filter(F.col("n_edges") < config.max_cc_size))
    classes = stage("classified", classify(cands, edges, rules_of(config)))
    return stage("dense_subgraphs", diverse(classes, config.max_cc_size, config.max_jac)), log_


def mine(edges: DataFrame, config: MineConfig) -> DataFrame:
    """edges, n_edges, density and origin of each accepted subgraph. `edges` should be cheap to read again."""
    return diverse(classified(edges, config), config.max_cc_size, config.max_jac)


def encode_nodes(edges: DataFrame) -> DataFrame:
    """Edges with nodes named by their dense ids (first appearance)."""
    nodes = node_dictionary(edges)
    a = nodes.select(F.col("node_label").alias("src"), F.col("node_id").alias("src_id"))
    b = nodes.select(F.col("node_label").alias("dst"), F.col("node_id").alias("dst_id"))
    return edges.join(a, "src").join(b, "dst").select("edge_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "label", "series", "support")


def load(spark: SparkSession, config: MineConfig) -> DataFrame:
    return cut(encode_nodes(read_edge_list(spark, config.path, config.labeled, config.weighted)))


def run(spark: SparkSession, config: MineConfig, edges: DataFrame | None = None) -> DataFrame:
    """A whole run: load, mine, write the result and the statistics where `config.output` says."""
    began = time.perf_counter()
    found, stages = staged(edges if edges is not None else load(spark, config), config)
    seconds, n = time.perf_counter() - began, stages[-1][1]
    log.info("%s: %d results in %.1f s", result_name(config), n, seconds)
    if config.output:
        write_results(found, f"{config.output}/{result_name(config)}")
        append_statistics(spark, config, seconds, n, f"{config.output}/statistics")
    return found


def run_sweep(spark: SparkSession, configs: list[MineConfig], edges: DataFrame | None = None) -> list[DataFrame]:
    """Runs one after the other; each writes by its own configuration."""
    return [run(spark, c, edges) for c in configs]


def run_task(spark: SparkSession, request: str) -> str:
    """A JSON task request to a JSON result; "" without results."""
    config, _ = C.from_json(request)
    edges = load(spark, config)
    return views.result_json(cut(mine(edges, config)), edges)


def run_exploration(spark: SparkSession, request: str) -> str:
    """A JSON request with a Subgraph to its exploded view; edges that don't exist are left out."""
    config, wanted = C.from_json(request)
    ends = spark.createDataFrame(wanted, "source long, target long")
    return views.exploded_json(views.exploded_view(load(spark, config), ends, config.min_edges_in_snap))


class Service:
    """Tasks by name, as a front end submits and polls them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.results: dict[str, str] = {}
        self.forms: dict[str, MineConfig] = {}
        self.exploded = ""
        self.polls = 0

    def launch_task(self, request: str) -> str:
        config, _ = C.from_json(request)
        self.results[config.name] = run_task(self.spark, request)
        return "ack"

    def launch_task_from_form(self, form: dict[str, str]) -> str:
        config = C.from_form(form)
        self.forms[config.name.lower()] = config
        edges = load(self.spark, config)
        self.results[config.name] = views.result_json(cut(mine(edges, config)), edges)
        return "ack"

    def launch_exploration(self, request: str) -> str:
        self.exploded = run_exploration(self.spark, request)
        return "ack"

    def launch_exploration_from_form(self, name: str, wanted: list[tuple[int, int]]) -> str:
        config = self.forms[name.lower()]
        ends = self.spark.createDataFrame(wanted, "source long, target long")
        self.exploded = views.exploded_json(views.exploded_view(load(self.spark, config), ends, config.min_edges_in_snap))
        return "ack"

    def get_results(self, name: str) -> str | None:
        """The result, or "UNAVAILABLE"; the service's fifth poll gives up on a result that isn't there and answers None."""
        self.polls += 1
        return self.results.get(name, None if self.polls == POLLS else "UNAVAILABLE")

    def get_exploded(self) -> str:
        return self.exploded
