import json

import pytest
from pyspark.sql import functions as F

from corrweave import config as C
from corrweave.config import MineConfig
from corrweave.functions import series as S
from corrweave.operators import correlate as cor
from corrweave.plans import mine as M
from corrweave.sources import graph as G
from corrweave.sources.results import append_statistics, result_name, write_results
from corrweave.streaming import snapshot_cells


def write(tmp_path, text):
    path = tmp_path / "edges.txt"
    path.write_text(text)
    return str(path)


def test_labeled_and_blank_lines(spark, tmp_path):
    got = G.read_edge_list(spark, write(tmp_path, "5 6 3 1,0\n6 7 4 0,1\n\n"), labeled=True).orderBy("edge_id").collect()
    assert [(r["src"], r["dst"], r["label"], r["series"]) for r in got] == [(5, 6, 3, [1, 0]), (6, 7, 4, [0, 1])]


def test_lines_keep_their_numbers_over_splits_and_files(spark, tmp_path):
    for name, first in (("a.txt", 0), ("b.txt", 300)):
        (tmp_path / name).write_text("".join(f"{i} {i + 1} 1,0\n" for i in range(first, first + 300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = G.read_edge_list(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 600 and all(r["edge_id"] == r["src"] for r in got)


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError, match="same number"):
        G.read_edge_list(spark, write(tmp_path, "1 2 1,0\n1 3 1\n"))
    with pytest.raises(Exception, match="not an edge"):
        G.read_edge_list(spark, write(tmp_path, "1 2\n")).collect()


def test_weighted_support_and_scores(spark, tmp_path):
    edges = G.read_edge_list(spark, write(tmp_path, "1 7 2.5,-1,2.5,0,0,2.5\n1 2 2.5,2.5,0,2.5,0,0\n1 3 1,1,1,1,1,1\n"), weighted=True)
    assert edges.orderBy("edge_id").first()["support"] == 6.5
    assert {r["t"] for r in G.snapshots(edges).filter("edge_id = 0").collect()} == {0, 2, 5}
    z = {r["edge_id"]: r["z"] for r in edges.select("edge_id", S.zscore(F.col("series")).alias("z")).collect()}
    assert z[2] is None and sum(z[1]) == pytest.approx(0) and sum(x * x for x in z[1]) == pytest.approx(6)
    pair = edges.alias("a").crossJoin(edges.alias("b")).filter("a.edge_id = 0 AND b.edge_id = 1")
    d = pair.select(S.euclidean(F.col("a.series"), F.col("b.series")).alias("d")).first()["d"]
    assert d == pytest.approx(1 / (1 + (3.5**2 + 2.5**2 * 3) ** 0.5))
    assert {(r["e1"], r["e2"]) for r in cor.dense_pairs(edges, -1.0).collect()} == {(0, 1)}


def test_edges_from_long(spark):
    cells = spark.createDataFrame([(2, 3, 0, 1.0), (1, 2, 2, 4.0), (1, 2, 0, 1.0)], "src long, dst long, t int, w double")
    got = G.edges_from_long(cells, 3, weighted=True).orderBy("edge_id").collect()
    assert [(r["edge_id"], r["src"], r["series"], r["support"]) for r in got] == [(0, 1, [1, 0, 4], 5), (1, 2, [1, 0, 0], 1)]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = G.dense_index(df, ["x"], "i").collect()
    assert len(got) == 1000 and all(r["x"] == r["i"] for r in got)
    assert G.dense_index(df.filter("x < 0"), ["x"], "i").count() == 0


def test_configurations():
    c = C.from_cli(["dataFolder=/d/", "edgeFile=g.txt", "minCor=0.7", "isMA=true", "isExact=yes", "unknown=1", "maxCCSize=40"])
    assert (c.path, c.min_cor, c.density, c.exact, c.max_cc_size) == ("/d/g.txt", 0.7, "min", False, 40)
    with pytest.raises(ValueError):
        C.from_cli(["minCor"])
    request = {
        "Name": "n", "Dataset": {"Path": "p", "Properties": {"Weighted": True, "Labeled": False}},
        "Task": {"Correlation": 0.5, "Density": 2.0, "DensityFunction": "Minimum", "EdgesPerSnapshot": 3, "MaxSize": 9, "Epsilon": 0.4},
        "Subgraph": {"edges": [{"source": 1, "target": 2}]},
    }
    c, wanted = C.from_json(json.dumps(request))
    assert (c.density, c.min_edges_in_snap, c.weighted, c.max_jac, wanted) == ("min", 3, True, 0.4, [(1, 2)])
    form = {"config": "A", "fileGroup": "local", "path_local": "x", "correlation": "0.5", "density": "2", "densityGroup": "Average", "edgesxsnaps": "1", "sizeRange": "7", "SizeButton": "8", "epsilon": "1"}
    c = C.from_form(form)
    assert (c.path, c.max_cc_size, c.density, c.weighted) == ("x", 8, "avg", False)
    assert len(C.sweep(c, min_den=[1, 2, 3], density=["min", "avg"])) == 6


def test_run_writes_results(spark, tmp_path):
    from test_mining import F1

    c = MineConfig(path=write(tmp_path, F1), name="f1", output=str(tmp_path / "out"), min_cor=0.6, min_den=2, min_edges_in_snap=1, density="min", max_cc_size=40, max_jac=1.0)
    M.run_sweep(spark, [c, c])
    lines = [r[0] for r in spark.read.text(f"{c.output}/{result_name(c)}").collect()]
    assert sorted(lines) == ["0\t1\t2\t", "4\t5\t6\t"]
    stats = spark.read.option("sep", "\t").csv(f"{c.output}/statistics").collect()
    assert len(stats) == 2 and len(stats[0]) == 11 and stats[0][3] == "2"


def test_service(spark, tmp_path):
    from test_mining import F1

    task = {"Correlation": 0.6, "Density": 2.0, "DensityFunction": "Minimum", "EdgesPerSnapshot": 1, "MaxSize": 40, "Epsilon": 1.0}
    request = {"Name": "job", "Dataset": {"Path": write(tmp_path, F1), "Properties": {}}, "Task": task}
    service = M.Service(spark)
    assert service.get_results("job") == "UNAVAILABLE" and service.launch_task(json.dumps(request)) == "ack"
    assert len(json.loads(service.get_results("job"))["nodes"]) == 6
    request["Task"] = task | {"EdgesPerSnapshot": 4}
    request["Subgraph"] = {"edges": [{"source": a, "target": b} for a, b in ((0, 1), (0, 2), (1, 2), (3, 2), (9, 9))]}
    service.launch_exploration(json.dumps(request))
    assert [x["number"] for x in json.loads(service.get_exploded())] == [0, 1, 3]


def test_form_routes_and_polls(spark, tmp_path):
    from test_mining import F1

    form = {"config": "Form", "fileGroup": "local", "path_local": write(tmp_path, F1), "correlation": "0.6", "density": "2", "densityGroup": "Minimum", "edgesxsnaps": "1", "sizeRange": "40", "epsilon": "1"}
    service = M.Service(spark)
    assert service.launch_task_from_form(form) == "ack" and len(json.loads(service.get_results("Form"))["nodes"]) == 6
    assert service.launch_exploration_from_form("form", [(0, 1), (0, 2), (1, 2), (3, 2)]) == "ack"
    assert [x["number"] for x in json.loads(service.get_exploded())] == [0, 1, 3, 5]
    assert [service.get_results("none") for _ in range(5)] == ["UNAVAILABLE"] * 3 + [None, "UNAVAILABLE"]


SETTINGS = """
# Folders
dataFolder="data"
outputFolder="out"
one_db='alpha'
two_db='beta'
one_defaults=0.7,2.3,1,false,false
two_defaults=0.9,2.5,20,true,true
one_dens=3,2.9 # values
one_cor=0.5,0.6,1
two_dens=4
two_cor=0.5
one_flags="1,1"
two_flags="0,0,0"
maxCCSize=40
maxJac=0.0
hashFuncs=( 3 4 )
hashRuns=( 1 9 )
isExact="true"
"""


def test_sweep_from_settings():
    runs = C.sweep_from_settings(SETTINGS)
    assert len(runs) == 10 and {r.name for r in runs} == {"alpha.csv"} and runs[0].path == "data/alpha.csv" and runs[0].output == "out/exact"
    assert sorted({(r.min_cor, r.min_den) for r in runs}) == [(0.5, 2.3), (0.6, 2.3), (0.7, 2.9), (0.7, 3.0), (1.0, 2.3)]
    runs = C.sweep_from_settings(SETTINGS.replace('"true"', '"false"').replace('two_flags="0', 'two_flags="1'))
    assert len(runs) == 24 and {(r.hash_funcs, r.hash_runs) for r in runs} == {(3, 1), (4, 9)} and {r.output for r in runs} == {"out/ax"}
    two = [r for r in runs if r.name == "beta.csv"]
    assert all(r.weighted and r.labeled and r.min_edges_in_snap == 20 for r in two) and {r.density for r in two} == {"min", "avg"}


def test_stages_are_timed(spark, tmp_path):
    from test_mining import F1

    c = MineConfig(path=write(tmp_path, F1), min_cor=0.6, min_den=2, min_edges_in_snap=1, density="min", max_cc_size=40, max_jac=1.0)
    found, stages = M.staged(M.load(spark, c), c)
    assert [(n, k) for n, k, _ in stages] == [("correlated_pairs", 9), ("maximal_cliques", 2), ("candidates", 2), ("classified", 2), ("dense_subgraphs", 2)]
    assert found.count() == 2 and all(s > 0 for _, _, s in stages)


def test_shared_folder_is_required_on_a_cluster():
    from corrweave.session import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_stream_of_edges(spark, tmp_path):
    rows = [(1, 2, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 05:00:00"), (1, 2, "2024-01-03 00:00:00"), (4, 4, "2024-01-01 00:00:00")]
    batch = spark.createDataFrame(rows, "src long, dst long, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    expected = {(1, 2, 2), (1, 2, 1)}
    assert {(r["src"], r["dst"], r["w"]) for r in snapshot_cells(batch, "1 day").collect()} == expected
    stream = snapshot_cells(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["src"], r["dst"], r["w"]) for r in spark.sql("SELECT * FROM cells").collect()} == expected
