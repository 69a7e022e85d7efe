import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.01"


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 40


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["edges", "n_edges", "density", "origin"] and df.count() == 298


@pytest.mark.parametrize(("name", "rows"), [("dense_subgraphs_min", 100), ("dense_subgraphs_avg", 268), ("dense_subgraphs_diverse", 212), ("dense_extracted", 157), ("dense_extracted_min", None)])
def test_counts_of_whole_runs(spark, name, rows):
    n = entry.queries()[name](spark, SF).count()
    assert n == rows if rows is not None else n > 0


@pytest.mark.parametrize("name", ["edge_series", "pearson_pairs", "maximal_cliques", "candidate_components", "dense_direct_min", "explode_view", "dense_subgraphs_min", "result_nodes", "edge_file_labeled"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in names]
    expected = sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(names).collect()) == expected


def test_flagship_extracts_nothing_where_its_sql_says_so(spark):
    from corrweave.operators.lattice import classify
    from corrweave.operators.peel import Rules
    from corrweave.plans import queries as Q

    edges = Q._bursts(spark, SF)
    assert {r[0] for r in classify(Q._candidates(edges), edges, Rules(Q.DELTA, Q.K, "min")).select("class").distinct().collect()} <= {"direct", "pruned"}
