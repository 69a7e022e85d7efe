"""Registered queries over the graph of trade between nations, and the SQL that states them.

Sets of edges are text (ascending ids joined by commas), so both engines
compare them alike; measured values are rounded to six places.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.config import MineConfig
from corrweave.functions import series as S
from corrweave.operators import candidates as cand
from corrweave.operators import cliques as cliq
from corrweave.operators import components as comp
from corrweave.operators import correlate as cor
from corrweave.operators import cores
from corrweave.operators import density as den
from corrweave.operators import existence, reach, setjoin
from corrweave.operators.lattice import classify
from corrweave.operators.peel import Rules
from corrweave.plans import mine as M
from corrweave.plans import mining_sql as W
from corrweave.plans import views
from corrweave.session import Scratch, cut
from corrweave.sources import edits
from corrweave.sources import graph as G
from corrweave.sources import results as R

MIN_COR = 0.3
K, DELTA = 2, 1.0
HASH_FUNCS, HASH_RUNS = 2, 6
CONFIG = MineConfig(name="nation", min_cor=MIN_COR, min_den=DELTA, min_edges_in_snap=K, density="min", max_cc_size=40, max_jac=1.0)


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.nation_bursts(spark, sf_dir))


def _pairs(edges: DataFrame) -> DataFrame:
    return cor.sparse_pairs(edges, MIN_COR)


def _candidates(edges: DataFrame) -> DataFrame:
    return cut(cand.candidates(cliq.maximal_cliques(cut(_pairs(edges))), edges, 1))


def edge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.nation_bursts(spark, sf_dir)
    text = F.array_join(F.transform("series", lambda x: x.cast("int").cast("string")), ",")
    return e.select("edge_id", "src", "dst", F.col("support").cast("long").alias("support"), text.alias("series"))


def _round_trip(spark: SparkSession, edges: DataFrame, labeled: bool = False, weighted: bool = False) -> DataFrame:
    """Edges written as an edge-list file and read again."""
    scratch = Scratch(spark, "edges")
    R.write_edge_list(edges, scratch.path, labeled)
    out = cut(G.read_edge_list(spark, scratch.path, labeled, weighted))
    scratch.clear()
    return out


def _listed(edges: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("series", lambda x: x.cast("int").cast("string")), ",")
    return edges.select("edge_id", "src", "dst", F.col("label").cast("long").alias("label"), F.col("support").cast("long").alias("support"), text.alias("series"))


def edge_file_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an unlabeled edge-list file."""
    return _listed(_round_trip(spark, _bursts(spark, sf_dir)))


def edge_file_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a labeled edge-list file."""
    edges = _bursts(spark, sf_dir).withColumn("label", (F.col("edge_id") % 3).cast("int"))
    return _listed(_round_trip(spark, edges, labeled=True))


def edge_file_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an edge-list file with weights."""
    return _listed(_round_trip(spark, cut(G.nation_trade(spark, sf_dir)), weighted=True))


def edge_file_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loaded file: nodes by their dense ids."""
    return M.encode_nodes(_round_trip(spark, _bursts(spark, sf_dir))).select("edge_id", "src", "dst")


def edge_support_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nation_trade(spark, sf_dir).select("edge_id", "src", "dst", F.col("support").cast("long").alias("support"))


def edge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.snapshots(G.nation_trade(spark, sf_dir)).select("edge_id", F.col("t").cast("long").alias("t"), F.col("w").cast("long").alias("w"))


def edge_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.nation_trade(spark, sf_dir)
    z = e.select("edge_id", F.posexplode(S.zscore(F.col("series"))).alias("t", "z"))
    return z.select("edge_id", F.col("t").cast("long").alias("t"), F.round("z", 6).alias("z"))


def node_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_dictionary(_bursts(spark, sf_dir))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.incidence(G.nation_bursts(spark, sf_dir))


def static_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return den.static_degrees(G.nation_bursts(spark, sf_dir))


def snapshot_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return den.snapshot_degrees(G.nation_bursts(spark, sf_dir)).select(F.col("t").cast("long").alias("t"), "node", "degree")


def snapshot_avg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return den.snapshot_averages(G.nation_bursts(spark, sf_dir)).select(F.col("t").cast("long").alias("t"), "n_nodes", F.round("avg_degree", 6).alias("avg_degree"))


def min_degree_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return den.snapshot_averages(G.nation_bursts(spark, sf_dir)).select(F.col("t").cast("long").alias("t"), "min_node", "min_degree")


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("e1", "e2", F.round("r", 6).alias("r"))


def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pairs(_bursts(spark, sf_dir)))


def pearson_pairs_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cor.dense_pairs(_bursts(spark, sf_dir), MIN_COR))


def pearson_pairs_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cor.dense_pairs(cut(G.nation_trade(spark, sf_dir)), MIN_COR))


def euclidean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cor.dense_pairs(_bursts(spark, sf_dir), 0.15, measure="euclidean"))


def minhash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = cor.minhash_codes(G.nation_bursts(spark, sf_dir), HASH_FUNCS, HASH_RUNS)
    return codes.select("edge_id", F.col("run").cast("long").alias("run"), "code")


def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.minhash_candidates(_bursts(spark, sf_dir), HASH_FUNCS, HASH_RUNS)


def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cor.minhash_pairs(_bursts(spark, sf_dir), MIN_COR, HASH_FUNCS, HASH_RUNS))


def correlation_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.adjacency(_pairs(_bursts(spark, sf_dir)))


def correlation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(_bursts(spark, sf_dir))
    return comp.components(pairs.select(F.col("e1").alias("a"), F.col("e2").alias("b"))).select(F.col("node").alias("edge_id"), "component")


def correlation_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.degrees(_pairs(_bursts(spark, sf_dir)))


def _hops(spark: SparkSession, sf_dir: str, busy: bool) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    links = cut(_pairs(edges)).select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    sources = comp.components(links).select(F.col("component").alias("source")).distinct()
    allowed = None
    if busy:
        mean = edges.agg(F.avg("support")).first()[0] or 0.0
        allowed = edges.filter(F.col("support") >= mean).select(F.col("edge_id").alias("node"))
    return reach.reachable(links, sources, allowed).select("source", F.col("node").alias("edge_id"), "hops")


def correlation_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops in the correlation graph from the least edge of each component."""
    return _hops(spark, sf_dir, busy=False)


def correlation_hops_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `correlation_hops`, by edges of at least the mean support alone."""
    return _hops(spark, sf_dir, busy=True)


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bursts, and changes to them: stricter bursts for some edges, labels, and new edges for trade within a nation."""
    trade = cut(G.nation_trade(spark, sf_dir))
    first = trade.first()
    own = G.bursts(G.edges_from_long(G.nation_cells(spark, sf_dir, loops=True), len(first["series"]) if first else 0, weighted=True))
    strict = G.bursts(trade.filter("edge_id % 5 = 0"), 2, 1)
    none = {c: F.lit(None).cast(t) for c, t in (("edge_id", "long"), ("src", "long"), ("dst", "long"), ("label", "int"), ("series", "array<double>"))}
    row = lambda seq, op, **x: [F.lit(seq).cast("long") + F.col("edge_id"), F.lit(op), *(x.get(c, none[c]) for c in none)]
    parts = [
        strict.select(*row(0, "series", edge_id=F.col("edge_id"), series=F.col("series"))),
        trade.filter("edge_id % 3 = 0").select(*row(1000, "label", edge_id=F.col("edge_id"), label=F.lit(2))),
        trade.filter("edge_id % 6 = 0").select(*row(2000, "label", edge_id=F.col("edge_id"), label=F.lit(3))),
        own.select(*row(3000, "add", src=F.col("src"), dst=F.col("dst"), series=F.col("series"))),
    ]
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.union(p)
    return G.bursts(trade), cut(changes.toDF("seq", "op", *none))


def edited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after a table of changes."""
    return _listed(edits.apply_changes(*_edits(spark, sf_dir)))


def edited_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, changes = _edits(spark, sf_dir)
    return edits.apply_to_incidence(G.incidence(edges), edges, changes)


def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core number of each edge in the correlation graph."""
    return cores.core_numbers(cut(_pairs(_bursts(spark, sf_dir))))


def candidate_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each edge inside and outside its candidate, in the correlation graph."""
    edges = _bursts(spark, sf_dir)
    x = cor.degrees_in_sets(_candidates(edges), cut(_pairs(edges)))
    return x.select(F.col("k").alias("edges"), "edge_id", "near", "far", F.round("largeness", 6).alias("largeness"))


def clique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the found cliques are cliques, and maximal."""
    pairs = cut(_pairs(_bursts(spark, sf_dir)))
    return cliq.check_cliques(cliq.maximal_cliques(pairs), pairs).select(F.col("k").alias("edges"), "is_clique", "is_maximal")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.graph_components(_bursts(spark, sf_dir))


def _text(sets: DataFrame) -> DataFrame:
    return sets.select(S.set_text(F.col("edges")).alias("edges"), F.size("edges").cast("long").alias("n_edges"))


def maximal_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(cliq.maximal_cliques(cut(_pairs(_bursts(spark, sf_dir)))))


def candidate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_candidates(_bursts(spark, sf_dir)))


def candidate_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    cliques = cut(cliq.maximal_cliques(cut(_pairs(edges))))
    return den.is_connected(cliques, edges).select(F.col("k").alias("edges"), "connected")


def maximal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(cand.maximal_only(_candidates(_bursts(spark, sf_dir))))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cand.overlaps(_candidates(_bursts(spark, sf_dir)))
    return x.select(F.col("k1").alias("edges1"), F.col("k2").alias("edges2"), F.round("jaccard", 6).alias("jaccard"))


def candidate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    m = den.members(_candidates(edges), edges).groupBy("k").agg(F.collect_list(F.struct("src", "dst")).alias("ends"))
    return m.select(F.col("k").alias("edges"), F.array_join(S.nodes_of(F.col("ends")), ",").alias("nodes"))


def k_edge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    return den.k_snapshots(_candidates(edges), edges, K).select(F.col("k").alias("edges"), F.col("t").cast("long").alias("t"), "m")


def _density(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    x = den.densities(_candidates(edges), edges, K)
    return x.select(F.col("k").alias("edges"), "k_snaps", "skipped", F.round(column, 6).alias(column))


def min_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir, "min_density")


def avg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir, "avg_density")


def _direct(spark: SparkSession, sf_dir: str, density: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    x = den.direct_dense(_candidates(edges), edges, K, DELTA, density)
    return x.select(F.col("k").alias("edges"), "n_edges", "n_nodes", "k_snaps", F.round(f"{density}_density", 6).alias("density"))


def dense_direct_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _direct(spark, sf_dir, "min")


def dense_direct_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _direct(spark, sf_dir, "avg")


AVG_CONFIG = MineConfig(name="nation", min_cor=MIN_COR, min_den=1.0, min_edges_in_snap=1, density="avg", max_cc_size=40, max_jac=1.0)
DIVERSE_CONFIG = replace(AVG_CONFIG, min_den=0.8, max_jac=0.5)
APART_CONFIG = replace(CONFIG, max_jac=0.3)
SINGLE_CONFIG = replace(AVG_CONFIG, max_jac=0.0)
WEIGHTED_CONFIG = replace(CONFIG, weighted=True, min_edges_in_snap=1)
WEIGHTED_AVG_CONFIG = replace(CONFIG, weighted=True, min_edges_in_snap=1, min_den=3.0, density="avg", max_jac=0.5)
#: Bounds that decide something on these tables: similarity and sizes of candidates, and densities looked for within them.
SIMILAR, FEWEST, SIZE_BOUND = 0.5, 2, 3
HOLDS_MIN, HOLDS_AVG = 0.6, 1.2


def dense_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense parts that peeling finds in candidates that aren't dense themselves."""
    edges = _bursts(spark, sf_dir)
    x = classify(_candidates(edges), edges, M.rules_of(AVG_CONFIG)).filter(F.col("class") == "extracted").select(F.explode("sets").alias("s"))
    return x.select(S.set_text(F.col("s.edges")).alias("edges"), F.round("s.density", 6).alias("density")).distinct()


def dense_extracted_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `dense_extracted`, by minimum density."""
    edges = _bursts(spark, sf_dir)
    x = classify(_candidates(edges), edges, Rules(0.8, 1, "min")).filter(F.col("class") == "extracted").select(F.explode("sets").alias("s"))
    return x.select(S.set_text(F.col("s.edges")).alias("edges"), F.round("s.density", 6).alias("density")).distinct()


def _result(x: DataFrame) -> DataFrame:
    return x.select(S.set_text(F.col("edges")).alias("edges"), F.col("n_edges").cast("long").alias("n_edges"), F.round("density", 6).alias("density"), "origin")


def dense_subgraphs_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: diverse dense correlated subgraphs, minimum density."""
    return _result(M.mine(_bursts(spark, sf_dir), CONFIG))


def dense_subgraphs_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(M.mine(_bursts(spark, sf_dir), AVG_CONFIG))


def dense_subgraphs_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average density, and results of similarity below one half."""
    return _result(M.mine(_bursts(spark, sf_dir), DIVERSE_CONFIG))


def dense_subgraphs_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum density, and a bound on similarity that decides."""
    return _result(M.mine(_bursts(spark, sf_dir), APART_CONFIG))


def dense_subgraphs_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound of 0 on similarity: one result."""
    return _result(M.mine(_bursts(spark, sf_dir), SINGLE_CONFIG))


def dense_subgraphs_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted series: correlation of the monthly line items, minimum density."""
    return _result(M.mine(cut(G.nation_trade(spark, sf_dir)), WEIGHTED_CONFIG))


def dense_subgraphs_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `dense_subgraphs_weighted`, by average weight, and results of similarity below one half."""
    return _result(M.mine(cut(G.nation_trade(spark, sf_dir)), WEIGHTED_AVG_CONFIG))


def _holds(spark: SparkSession, sf_dir: str, min_den: float, density: str) -> DataFrame:
    edges = _bursts(spark, sf_dir)
    return existence.contains_dense(_candidates(edges), edges, K, min_den, density).select(F.col("k").alias("edges"), "contains")


def contains_dense_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each candidate holds a dense part, by bulk peeling."""
    return _holds(spark, sf_dir, HOLDS_MIN, "min")


def contains_dense_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holds(spark, sf_dir, HOLDS_AVG, "avg")


def similar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of candidates that the bound on similarity keeps apart."""
    x = setjoin.similar_pairs(setjoin.named(_candidates(_bursts(spark, sf_dir))), bound=SIMILAR)
    return x.select(F.col("k1").alias("edges1"), F.col("k2").alias("edges2"), F.round("jaccard", 6).alias("jaccard"))


def contained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are part of others, with these."""
    sets = setjoin.named(_candidates(_bursts(spark, sf_dir)))
    return setjoin.contained_pairs(sets, sets).filter("k1 <> k2").select(F.col("k1").alias("edges"), F.col("k2").alias("whole"))


def sized_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of enough edges, and fewer than the bound."""
    edges = _bursts(spark, sf_dir)
    x = cand.candidates(cliq.maximal_cliques(cut(_pairs(edges))), edges, FEWEST)
    return _text(x.filter(F.col("n_edges") < SIZE_BOUND))


def dense_subgraphs_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(M.mine(_bursts(spark, sf_dir), replace(CONFIG, exact=False, hash_funcs=HASH_FUNCS, hash_runs=HASH_RUNS)))


def explode_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between nations 0 to 5, in snapshots with two of them and more."""
    edges = _bursts(spark, sf_dir)
    wanted = edges.filter("src < 6 AND dst < 6").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    view = views.exploded_view(edges, wanted, K)
    return view.select(F.col("number").cast("long").alias("number"), "source", "target")


def _viewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _bursts(spark, sf_dir)
    return cut(M.mine(edges, CONFIG)), edges


def result_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.result_nodes(*_viewed(spark, sf_dir))
    return x.select("name", "position", F.array_join("sids", ",").alias("sids"))


def result_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.result_edges(*_viewed(spark, sf_dir))
    return x.select("src", "dst", F.array_join("sids", ",").alias("sids"))


def result_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.density_classes(_viewed(spark, sf_dir)[0])


def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the result file of the flagship run."""
    scratch = Scratch(spark, "result")
    R.write_results(M.mine(_bursts(spark, sf_dir), CONFIG), scratch.path)
    out = cut(spark.read.text(scratch.path).select(F.col("value").alias("line")))
    scratch.clear()
    return out


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics row of the flagship run, without its time and duration."""
    scratch = Scratch(spark, "statistics")
    R.append_statistics(spark, CONFIG, 0.0, M.mine(_bursts(spark, sf_dir), CONFIG).count(), scratch.path)
    out = cut(R.read_statistics(spark, scratch.path).drop("at", "seconds", "lsh"))
    scratch.clear()
    return out


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stage of the flagship run."""
    _, stages = M.staged(_bursts(spark, sf_dir), CONFIG)
    return spark.createDataFrame([(name, n) for name, n, _ in stages], "stage string, n long")


def snapshot_stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly windows over dated edges (here customers' and suppliers' nations of each line item)."""
    from corrweave.streaming import snapshot_cells

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("c_nationkey").cast("long").alias("src"))
    s = read("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    dated = read("lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = snapshot_cells(dated.select("src", "dst", "ts"), "10 days")
    return cells.select("src", "dst", F.unix_timestamp("start").alias("start"), "w")


# --- SQL ----------------------------------------------------------------------------------------------------------

_CELLS = """
cell AS (
  SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS dst,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
), span AS (SELECT CAST(max(t) + 1 AS BIGINT) AS n FROM cell),
ends AS (
  SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS edge_id, src, dst, CAST(sum(w) AS BIGINT) AS total FROM cell GROUP BY src, dst
), trade AS (SELECT edge_id, t, w FROM cell JOIN ends USING (src, dst)),
snap AS (SELECT edge_id, t FROM trade JOIN ends USING (edge_id), span WHERE 2 * w * n >= 3 * total),
edges AS (SELECT e.edge_id, src, dst, CAST(count(s.t) AS BIGINT) AS support FROM ends e LEFT JOIN snap s USING (edge_id) GROUP BY ALL)
"""
_DENSE_W = "grid AS (SELECT edge_id, g.t, coalesce(w, 0) AS w FROM (SELECT edge_id, unnest(range(0, (SELECT n FROM span))) AS t FROM ends) g LEFT JOIN trade USING (edge_id, t))"
_DENSE_B = "grid AS (SELECT edge_id, g.t, CASE WHEN s.t IS NULL THEN 0 ELSE 1 END AS w FROM (SELECT edge_id, unnest(range(0, (SELECT n FROM span))) AS t FROM ends) g LEFT JOIN snap s USING (edge_id, t))"
_PAIRS = f"""
act AS (SELECT edge_id, support FROM edges, span WHERE support > 0 AND support < n),
both_ AS (
  SELECT a.edge_id AS e1, b.edge_id AS e2, count(*) AS sxy FROM snap a JOIN snap b ON a.t = b.t AND a.edge_id < b.edge_id GROUP BY ALL
), pairs AS (
  SELECT e1, e2, (n * sxy - x.support * y.support) / sqrt(CAST((n * x.support - x.support * x.support) * (n * y.support - y.support * y.support) AS DOUBLE)) AS r
  FROM both_ JOIN act x ON x.edge_id = e1 JOIN act y ON y.edge_id = e2, span
  WHERE (n * sxy - x.support * y.support) / sqrt(CAST((n * x.support - x.support * x.support) * (n * y.support - y.support * y.support) AS DOUBLE)) >= {MIN_COR}
), adj AS (SELECT e1 AS u, e2 AS v FROM pairs UNION ALL SELECT e2, e1 FROM pairs)
"""
_CLIQUES = """
nbr AS (SELECT u, list(v ORDER BY v) AS vs FROM adj GROUP BY u),
grow(c, top, common) AS (
  SELECT [u], u, vs FROM nbr
  UNION ALL
  SELECT list_append(c, v), v, list_sort(list_intersect(common, vs))
  FROM (SELECT c, top, common, unnest(common) AS v FROM grow) g JOIN nbr ON nbr.u = g.v WHERE v > top
), cliques AS (SELECT array_to_string(c, ',') AS k, c FROM grow WHERE len(common) = 0)
"""
_CANDS = """
mem AS (SELECT k, edge_id, src, dst FROM (SELECT k, unnest(c) AS edge_id FROM cliques) JOIN edges USING (edge_id)),
near AS (
  SELECT DISTINCT a.k, a.edge_id AS x, b.edge_id AS y FROM mem a JOIN mem b ON a.k = b.k AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst))
), walk(k, x, y) AS (SELECT k, x, y FROM near UNION SELECT w.k, w.x, n.y FROM walk w JOIN near n ON n.k = w.k AND n.x = w.y),
lead AS (SELECT k, x, min(y) AS head FROM walk GROUP BY k, x),
cands AS (
  SELECT DISTINCT array_to_string(es, ',') AS edges, es, CAST(len(es) AS BIGINT) AS n_edges FROM (SELECT list(x ORDER BY x) AS es FROM lead GROUP BY k, head)
), cm AS (SELECT edges, edge_id, src, dst, support FROM (SELECT edges, unnest(es) AS edge_id FROM cands) JOIN edges e USING (edge_id))
"""
_CM = _CANDS.replace("JOIN edges e USING (edge_id))\n", "JOIN edge_table USING (edge_id))\n").replace("JOIN edges USING (edge_id))", "JOIN edge_table USING (edge_id))")
_DENSITY = f"""
mt AS (SELECT edges, t, CAST(count(*) AS BIGINT) AS m FROM cm JOIN snap USING (edge_id) GROUP BY edges, t),
bt AS (
  SELECT edges, CAST(count(*) FILTER (m >= {K}) AS BIGINT) AS k_snaps, CAST(coalesce(sum(m) FILTER (m < {K}), 0) AS BIGINT) AS skipped, min(m) FILTER (m >= {K}) AS least
  FROM mt GROUP BY edges
), nn AS (SELECT edges, CAST(count(DISTINCT node) AS BIGINT) AS n_nodes FROM (SELECT edges, unnest([src, dst]) AS node FROM cm) GROUP BY edges),
ss AS (SELECT edges, CAST(count(*) AS BIGINT) AS n_edges, CAST(sum(support) AS BIGINT) AS support FROM cm GROUP BY edges),
dens AS (
  SELECT ss.edges, n_edges, n_nodes, coalesce(k_snaps, 0) AS k_snaps, coalesce(skipped, 0) AS skipped,
         CASE WHEN k_snaps > 0 THEN 2.0::DOUBLE * least / n_nodes END AS min_density,
         CASE WHEN k_snaps > 0 THEN 2.0::DOUBLE * (support - skipped) / (k_snaps * n_nodes) END AS avg_density
  FROM ss JOIN nn USING (edges) LEFT JOIN bt USING (edges)
)
"""
_VIEWS = """
classes AS (SELECT CAST(row_number() OVER (ORDER BY value DESC) AS BIGINT) AS id, value FROM (SELECT DISTINCT round_even(d, 3) AS value FROM found ORDER BY value DESC LIMIT 6)),
placed AS (SELECT CAST(row_number() OVER (ORDER BY d DESC, n_edges DESC, es) - 1 AS BIGINT) AS s, es, round_even(d, 3) AS value FROM found),
sets AS (SELECT s, es, CAST(coalesce(id, 6) || CAST(s AS VARCHAR) AS BIGINT) AS sid FROM placed LEFT JOIN classes USING (value)),
used AS (
  SELECT s, sid, place, src, dst FROM (SELECT s, sid, unnest(es) AS edge_id, CAST(generate_subscripts(es, 1) - 1 AS BIGINT) AS place FROM sets) JOIN edge_table USING (edge_id)
)
"""
_JOINED = "FROM edges JOIN (SELECT edge_id, string_agg(CAST(w AS VARCHAR), ',' ORDER BY t) AS s FROM grid GROUP BY edge_id) USING (edge_id)"
_TABLE = "edge_table AS (SELECT * FROM edges)"


def _sql(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in (_CELLS, *parts)) + "\n" + select


def _sql_weighted(select: str, *parts: str) -> str:
    """As `_sql` over the weighted graph: alive where the weight is positive, support as the sum of weights."""
    cells = _CELLS[: _CELLS.index("snap AS (SELECT")].strip()
    graph = "snap AS (SELECT edge_id, t FROM trade WHERE w > 0),\nedges AS (SELECT edge_id, src, dst, total AS support FROM ends)"
    return "WITH RECURSIVE " + cells + "\n" + ",\n".join(p.strip() for p in (graph, *parts)) + "\n" + select


def _hash_sql() -> tuple[str, str]:
    mins = []
    for h in range(HASH_FUNCS * HASH_RUNS):
        a, b = cor.hash_constants(h)
        mins.append(f"min((t * {a} + {b}) % {cor.PRIME}) AS m{h}")
    rows = [
        f"SELECT edge_id, CAST({r} AS BIGINT) AS run, concat_ws('-', {', '.join(f'm{r * HASH_FUNCS + f}' for f in range(HASH_FUNCS))}) AS code FROM signed"
        for r in range(HASH_RUNS)
    ]
    codes = f"signed AS (SELECT edge_id, {', '.join(mins)} FROM snap GROUP BY edge_id),\ncodes AS ({' UNION ALL '.join(rows)})"
    return codes, "varied AS (SELECT edge_id, run, code FROM codes JOIN edges USING (edge_id), span WHERE support < n),\nlsh AS (SELECT DISTINCT a.edge_id AS e1, b.edge_id AS e2 FROM varied a JOIN varied b ON a.run = b.run AND a.code = b.code AND a.edge_id < b.edge_id)"


_MOMENTS = """
z AS (SELECT edge_id, t, w - avg(w) OVER (PARTITION BY edge_id) AS d FROM grid),
norms AS (SELECT edge_id, sqrt(sum(d * d)) AS len FROM z GROUP BY edge_id HAVING sum(d * d) > 1e-9),
rs AS (
  SELECT a.edge_id AS e1, b.edge_id AS e2, sum(a.d * b.d) / (any_value(x.len) * any_value(y.len)) AS r
  FROM z a JOIN z b ON a.t = b.t AND a.edge_id < b.edge_id JOIN norms x ON x.edge_id = a.edge_id JOIN norms y ON y.edge_id = b.edge_id GROUP BY ALL
)
"""


def _hops_sql(allowed: str) -> tuple[str, str]:
    """`hop`: after 40 steps, the least hops from each component's least edge to the edges that it reaches."""
    reach = "near_(u, v) AS (SELECT u, u FROM adj UNION SELECT r.u, a.v FROM near_ r JOIN adj a ON a.u = r.v),\nhead AS (SELECT DISTINCT source FROM (SELECT u, min(v) AS source FROM near_ GROUP BY u))"
    met = f"SELECT source, v AS edge_id, hops + 1 AS hops FROM hop JOIN adj ON u = edge_id WHERE i < 40 AND {allowed}"
    step = f"SELECT (SELECT max(i) FROM hop) + 1, source, edge_id, min(hops) FROM (SELECT source, edge_id, hops FROM hop WHERE i < 40 UNION ALL {met}) GROUP BY source, edge_id"
    return reach, f"hop(i, source, edge_id, hops) AS (SELECT 0, source, source, CAST(0 AS BIGINT) FROM head UNION ALL {step})"


_EDITED = """
own_cell AS (
  SELECT CAST(c_nationkey AS BIGINT) AS node, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey = s_nationkey GROUP BY ALL
), own AS (SELECT node, CAST((SELECT count(*) FROM ends) + row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS edge_id, sum(w) AS total FROM own_cell GROUP BY node),
after_ AS (
  SELECT edge_id, src, dst, CAST(CASE WHEN edge_id % 6 = 0 THEN 3 WHEN edge_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS label, t,
         CASE WHEN w > 0 AND CASE WHEN edge_id % 5 = 0 THEN w * n >= 2 * total ELSE 2 * w * n >= 3 * total END THEN 1 ELSE 0 END AS alive
  FROM grid JOIN ends USING (edge_id), span
  UNION ALL
  SELECT edge_id, node, node, 1, g.t, CASE WHEN w > 0 AND 2 * w * n >= 3 * total THEN 1 ELSE 0 END
  FROM (SELECT *, unnest(range(0, n)) AS t FROM own, span) g LEFT JOIN own_cell USING (node, t)
)
"""


def oracle_sql() -> dict[str, str]:
    codes, lsh = _hash_sql()
    graph = (_PAIRS, _CLIQUES)
    parts = (*graph, _TABLE, _CM)
    full = (*parts, _DENSITY)
    lsh_parts = (_PAIRS.partition(", adj AS")[0], codes, lsh)
    near = "adj AS (SELECT e1 AS u, e2 AS v FROM pairs JOIN lsh USING (e1, e2) UNION ALL SELECT e2, e1 FROM pairs JOIN lsh USING (e1, e2))"
    run = lambda config, *before: (*(before or parts), *W.mined(config.min_edges_in_snap, config.min_den, config.density, config.max_jac, config.max_cc_size))
    approximate = run(CONFIG, *lsh_parts, near, _CLIQUES, _TABLE, _CM)
    mined = run(CONFIG)
    weighted = (_DENSE_W, _MOMENTS, f"pairs AS (SELECT e1, e2, r FROM rs WHERE r >= {MIN_COR}), adj AS (SELECT e1 AS u, e2 AS v FROM pairs UNION ALL SELECT e2, e1 FROM pairs)", _CLIQUES, _TABLE, _CM)
    hops = "FROM hop WHERE i = 40"
    accepted = "SELECT edges, n_edges, density, origin FROM found"
    extracted = "SELECT DISTINCT array_to_string(es, ',') AS edges, round(d, 6) AS density FROM lat WHERE d IS NOT NULL"
    viewed = (*mined, _VIEWS)
    reach = "hop(u, v) AS (SELECT src, dst FROM ends UNION ALL SELECT dst, src FROM ends),\nreach(u, v) AS (SELECT u, u FROM hop UNION SELECT r.u, h.v FROM reach r JOIN hop h ON h.u = r.v)"
    degree = "deg AS (SELECT t, node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT t, unnest([src, dst]) AS node FROM snap JOIN edges USING (edge_id)) GROUP BY t, node)"
    return {
        "edge_series": _sql(
            "SELECT edge_id, src, dst, support, s AS series FROM edges JOIN (SELECT edge_id, string_agg(CAST(w AS VARCHAR), ',' ORDER BY t) AS s FROM grid GROUP BY edge_id) USING (edge_id)", _DENSE_B
        ),
        "edge_support_weighted": _sql("SELECT edge_id, src, dst, total AS support FROM ends"),
        "edge_snapshots": _sql("SELECT edge_id, t, w FROM trade"),
        "edge_zscore": _sql("SELECT edge_id, t, round((w - avg(w) OVER p) / stddev_pop(w) OVER p, 6) AS z FROM grid WINDOW p AS (PARTITION BY edge_id)", _DENSE_W),
        "node_dictionary": _sql(
            "SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS node_id, node AS node_label FROM (SELECT node, min(place) AS place FROM (SELECT src AS node, 2 * edge_id AS place FROM ends UNION ALL SELECT dst, 2 * edge_id + 1 FROM ends) GROUP BY node)"
        ),
        "incidence": _sql("SELECT unnest([src, dst]) AS node, edge_id FROM ends"),
        "static_degree": _sql(
            "SELECT node, CAST(count(*) AS BIGINT) AS degree, CAST(count(DISTINCT other) AS BIGINT) AS n_neighbours FROM (SELECT src AS node, dst AS other FROM ends UNION ALL SELECT dst, src FROM ends) GROUP BY node"
        ),
        "snapshot_degree": _sql("SELECT t, node, degree FROM deg", degree),
        "snapshot_avg_degree": _sql("SELECT t, CAST(count(*) AS BIGINT) AS n_nodes, round(avg(degree), 6) AS avg_degree FROM deg GROUP BY t", degree),
        "min_degree_node": _sql("SELECT t, node AS min_node, degree AS min_degree FROM deg QUALIFY row_number() OVER (PARTITION BY t ORDER BY degree, node) = 1", degree),
        "pearson_pairs": _sql("SELECT e1, e2, round(r, 6) AS r FROM pairs", _PAIRS),
        "pearson_pairs_dense": _sql("SELECT e1, e2, round(r, 6) AS r FROM pairs", _PAIRS),
        "pearson_pairs_weighted": _sql(f"SELECT e1, e2, round(r, 6) AS r FROM rs WHERE r >= {MIN_COR}", _DENSE_W, _MOMENTS),
        "euclidean_pairs": _sql(
            "SELECT e1, e2, round(r, 6) AS r FROM (SELECT a.edge_id AS e1, b.edge_id AS e2, 1 / (1 + sqrt(CAST(sum((a.w - b.w) * (a.w - b.w)) AS DOUBLE))) AS r FROM grid a JOIN grid b ON a.t = b.t AND a.edge_id < b.edge_id GROUP BY ALL) WHERE r >= 0.15",
            _DENSE_B,
        ),
        "minhash_codes": _sql("SELECT edge_id, run, code FROM codes", codes),
        "minhash_candidates": _sql("SELECT e1, e2 FROM lsh", codes, lsh),
        "minhash_pairs": _sql("SELECT e1, e2, round(r, 6) AS r FROM pairs JOIN lsh USING (e1, e2)", _PAIRS, codes, lsh),
        "correlation_adjacency": _sql("SELECT u, v FROM adj", _PAIRS),
        "correlation_components": _sql(
            "SELECT u AS edge_id, min(v) AS component FROM reach GROUP BY u",
            _PAIRS,
            "reach(u, v) AS (SELECT u, u FROM adj UNION SELECT r.u, a.v FROM reach r JOIN adj a ON a.u = r.v)",
        ),
        "maximal_cliques": _sql("SELECT k AS edges, CAST(len(c) AS BIGINT) AS n_edges FROM cliques", *graph),
        "candidate_components": _sql("SELECT edges, n_edges FROM cands", *parts),
        "candidate_connected": _sql("SELECT k AS edges, count(DISTINCT head) = 1 AS connected FROM lead GROUP BY k", *parts),
        "maximal_candidates": _sql(
            "SELECT edges, n_edges FROM cands a WHERE n_edges > 1 AND NOT EXISTS (SELECT 1 FROM cands b WHERE b.n_edges > a.n_edges AND list_has_all(b.es, a.es))", *parts
        ),
        "jaccard_pairs": _sql(
            "SELECT a.edges AS edges1, b.edges AS edges2, round(len(list_intersect(a.es, b.es)) / CAST(len(list_distinct(list_concat(a.es, b.es))) AS DOUBLE), 6) AS jaccard FROM cands a JOIN cands b ON a.edges < b.edges WHERE list_has_any(a.es, b.es)",
            *parts,
        ),
        "candidate_nodes": _sql("SELECT edges, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM (SELECT DISTINCT edges, unnest([src, dst]) AS node FROM cm) GROUP BY edges", *parts),
        "k_edge_snapshots": _sql(f"SELECT edges, t, m FROM mt WHERE m >= {K}", *full),
        "min_density": _sql("SELECT edges, k_snaps, skipped, round(min_density, 6) AS min_density FROM dens", *full),
        "avg_density": _sql("SELECT edges, k_snaps, skipped, round(avg_density, 6) AS avg_density FROM dens", *full),
        "dense_direct_min": _sql(f"SELECT edges, n_edges, n_nodes, k_snaps, round(min_density, 6) AS density FROM dens WHERE min_density >= {DELTA}", *full),
        "dense_direct_avg": _sql(f"SELECT edges, n_edges, n_nodes, k_snaps, round(avg_density, 6) AS density FROM dens WHERE avg_density >= {DELTA}", *full),
        "edge_file_unlabeled": _sql(f"SELECT edge_id, src, dst, CAST(1 AS BIGINT) AS label, support, s AS series {_JOINED}", _DENSE_B),
        "edge_file_labeled": _sql(f"SELECT edge_id, src, dst, edge_id % 3 AS label, support, s AS series {_JOINED}", _DENSE_B),
        "edge_file_weighted": _sql(f"SELECT edge_id, src, dst, CAST(1 AS BIGINT) AS label, total AS support, s AS series {_JOINED.replace('edges', 'ends')}", _DENSE_W),
        "edge_file_encoded": _sql(
            "SELECT edge_id, a.id AS src, b.id AS dst FROM ends JOIN ids a ON a.node = src JOIN ids b ON b.node = dst",
            "ids AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS id, node FROM (SELECT node, min(place) AS place FROM (SELECT src AS node, 2 * edge_id AS place FROM ends UNION ALL SELECT dst, 2 * edge_id + 1 FROM ends) GROUP BY node))",
        ),
        "correlation_degree": _sql("SELECT u AS edge_id, CAST(count(*) AS BIGINT) AS degree FROM adj GROUP BY u", _PAIRS),
        "correlation_hops": _sql(f"SELECT source, edge_id, hops {hops}", _PAIRS, *_hops_sql("true")),
        "correlation_hops_busy": _sql(f"SELECT source, edge_id, hops {hops}", _PAIRS, *_hops_sql("v IN (SELECT edge_id FROM edges WHERE support >= (SELECT avg(support) FROM edges))")),
        "edited_edges": _sql("SELECT edge_id, src, dst, label, CAST(sum(alive) AS BIGINT) AS support, string_agg(CAST(alive AS VARCHAR), ',' ORDER BY t) AS series FROM after_ GROUP BY ALL", _DENSE_W, _EDITED),
        "edited_incidence": _sql("SELECT unnest([src, dst]) AS node, edge_id FROM (SELECT DISTINCT edge_id, src, dst FROM after_)", _DENSE_W, _EDITED),
        "core_numbers": _sql(
            "SELECT u AS edge_id, c AS core FROM core WHERE i = 60",
            _PAIRS,
            "core(i, u, c) AS (SELECT 0, u, count(*) FROM adj GROUP BY u UNION ALL SELECT i, u, list_max(list_transform(range(1, len(cs) + 1), lambda h: least(h, cs[h]))) FROM (SELECT i + 1 AS i, adj.u, list(c ORDER BY c DESC) AS cs FROM core JOIN adj ON adj.v = core.u WHERE i < 60 GROUP BY i, adj.u))",
        ),
        "candidate_degrees": _sql(
            "SELECT edges, edge_id, CAST(count(v) AS BIGINT) AS near, CAST(any_value(n_edges) - 1 - count(v) AS BIGINT) AS far, round(count(v) / CAST(any_value(n_edges) AS DOUBLE), 6) AS largeness FROM cm JOIN cands USING (edges) LEFT JOIN adj ON u = edge_id AND list_contains(es, v) GROUP BY edges, edge_id",
            *parts,
        ),
        "clique_check": _sql("SELECT k AS edges, true AS is_clique, true AS is_maximal FROM cliques", *graph),
        "graph_components": _sql("SELECT edge_id, min(v) AS component FROM ends JOIN reach ON u = src GROUP BY edge_id", reach),
        "dense_extracted": _sql(extracted, *parts, W.ONE, W.lattice(1, 1.0, "avg")),
        "dense_extracted_min": _sql(extracted, *parts, W.ONE, W.lattice(1, 0.8, "min")),
        "dense_subgraphs_min": _sql(accepted, *mined),
        "dense_subgraphs_approximate": _sql(accepted, *approximate),
        "dense_subgraphs_avg": _sql(accepted, *run(AVG_CONFIG)),
        "dense_subgraphs_diverse": _sql(accepted, *run(DIVERSE_CONFIG)),
        "dense_subgraphs_apart": _sql(accepted, *run(APART_CONFIG)),
        "dense_subgraphs_single": _sql(accepted, *run(SINGLE_CONFIG)),
        "dense_subgraphs_weighted": _sql_weighted(accepted, *run(WEIGHTED_CONFIG, *weighted)),
        "dense_subgraphs_weighted_avg": _sql_weighted(accepted, *run(WEIGHTED_AVG_CONFIG, *weighted)),
        "contains_dense_min": _sql("SELECT edges, contains FROM held", *parts, W.ONE, W.existence(K, HOLDS_MIN, "min")),
        "contains_dense_avg": _sql("SELECT edges, contains FROM held", *parts, W.ONE, W.existence(K, HOLDS_AVG, "avg")),
        "similar_candidates": _sql(
            f"SELECT edges1, edges2, round(jaccard, 6) AS jaccard FROM (SELECT a.edges AS edges1, b.edges AS edges2, len(list_intersect(a.es, b.es)) / CAST(len(list_distinct(list_concat(a.es, b.es))) AS DOUBLE) AS jaccard FROM cands a JOIN cands b ON a.edges < b.edges) WHERE jaccard >= {SIMILAR}",
            *parts,
        ),
        "contained_candidates": _sql("SELECT a.edges, b.edges AS whole FROM cands a JOIN cands b ON a.n_edges < b.n_edges AND list_has_all(b.es, a.es)", *parts),
        "sized_candidates": _sql(f"SELECT edges, n_edges FROM cands WHERE n_edges >= {FEWEST} AND n_edges < {SIZE_BOUND}", *parts),
        "result_file": _sql("SELECT replace(edges, ',', chr(9)) || chr(9) AS line FROM found", *mined),
        "run_statistics": _sql(
            f"SELECT 'nation' AS file, count(*) AS n_results, true AS is_min, CAST({MIN_COR} AS DOUBLE) AS min_cor, CAST({DELTA} AS DOUBLE) AS min_den, CAST(40 AS INTEGER) AS max_size, CAST({K} AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS max_jac FROM found", *mined
        ),
        "stage_counts": _sql(
            "SELECT 'correlated_pairs' AS stage, count(*) AS n FROM pairs UNION ALL SELECT 'maximal_cliques', count(*) FROM cliques UNION ALL SELECT 'candidates', count(*) FROM cands WHERE n_edges < 40 UNION ALL SELECT 'classified', count(*) FROM cands WHERE n_edges < 40 UNION ALL SELECT 'dense_subgraphs', count(*) FROM found",
            *mined,
        ),
        "result_nodes": _sql(
            "SELECT name, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS position, sids FROM (SELECT node AS name, min([s, place, side]) AS first, array_to_string(list_sort(list_distinct(list(sid))), ',') AS sids FROM (SELECT s, sid, place, unnest([0, 1]) AS side, unnest([src, dst]) AS node FROM used) GROUP BY node)",
            *viewed,
        ),
        "result_edges": _sql("SELECT src, dst, array_to_string(list_sort(list_distinct(list(sid))), ',') AS sids FROM used GROUP BY src, dst", *viewed),
        "result_densities": _sql("SELECT id, value FROM classes", *viewed),
        "explode_view": _sql(
            f"SELECT t AS number, src AS source, dst AS target FROM (SELECT t, src, dst, count(*) OVER (PARTITION BY t) AS m FROM snap JOIN edges USING (edge_id) WHERE src < 6 AND dst < 6) WHERE m >= {K}"
        ),
        "snapshot_stream_cells": """
SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS dst,
       CAST(floor(epoch(o_orderdate) / 864000) AS BIGINT) * 864000 AS start, CAST(count(*) AS BIGINT) AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY ALL""",
    }


_QUERIES = (
    edge_series, edge_support_weighted, edge_snapshots, edge_zscore, node_dictionary, incidence, static_degree, snapshot_degree, snapshot_avg_degree,
    min_degree_node, pearson_pairs, pearson_pairs_dense, pearson_pairs_weighted, euclidean_pairs, minhash_codes, minhash_candidates, minhash_pairs,
    edge_file_unlabeled, edge_file_labeled, edge_file_weighted, edge_file_encoded, correlation_degree, core_numbers, correlation_hops, correlation_hops_busy, edited_edges, edited_incidence, candidate_degrees, clique_check, graph_components,
    result_file, run_statistics, stage_counts, correlation_adjacency, correlation_components, maximal_cliques, candidate_components, candidate_connected, maximal_candidates, jaccard_pairs,
    candidate_nodes, k_edge_snapshots, min_density, avg_density, dense_direct_min, dense_direct_avg, dense_extracted, dense_extracted_min, dense_subgraphs_min,
    dense_subgraphs_avg, dense_subgraphs_diverse, dense_subgraphs_approximate, dense_subgraphs_apart, dense_subgraphs_single, dense_subgraphs_weighted,
    dense_subgraphs_weighted_avg, contains_dense_min, contains_dense_avg, similar_candidates, contained_candidates, sized_candidates, explode_view, result_nodes, result_edges, result_densities,
    snapshot_stream_cells,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}
