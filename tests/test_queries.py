import pytest

from quiverql import queries

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_against_sql(engine_spark, con, name):
    assert compare(engine_spark, con, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_plans(engine_spark):
    graph = queries.tables_graph(engine_spark, SF)
    plan = lambda q: queries.GraphSession(graph).explain(q)
    scan = plan("MATCH (o:Order) WHERE o.totalprice > 1000 RETURN o.orderkey AS k")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in scan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in scan
    hop = plan("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS n, o.orderkey AS k")
    assert hop.count("Scan parquet") // 2 <= 2 and "CartesianProduct" not in hop  # orders hold the customer's key: one join
    assert "TakeOrderedAndProject" in plan("MATCH (o:Order) RETURN o.orderkey AS k ORDER BY k LIMIT 5")
    assert "CartesianProduct" not in (lateral := plan("MATCH (a:Nation), (b:Region {regionkey: a.regionkey}) RETURN a.name AS a")) and "NestedLoop" not in lateral
    assert "Python" not in hop
    left = plan("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 RETURN c.custkey AS k, o.orderkey AS o")
    assert left.count("Scan parquet") // 2 <= 2 and "LeftOuter" in left  # each table is read once
