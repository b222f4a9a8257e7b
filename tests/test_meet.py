"""Chains that meet in a node: counted without their pairs, with the results of the pairs."""

import math

import pytest

from quiverql import queries
from quiverql.session import GraphSession
from quiverql.sources.graph import NodeTable, PropertyGraph, RelTable

#: (key, hub, value, weight); hub 9 is in no table, hub 2's row is there twice.
LEFT = [(1, 1, 1.0, 5), (2, 1, 2.0, None), (3, 1, 2.0, 7), (4, 1, None, 1), (5, 2, 0.0, 2), (6, 2, -0.0, 3), (7, 2, math.nan, 4), (8, None, 1.0, 1), (9, 9, 1.0, 1), (10, 3, 4.0, 1), (11, 2, math.inf, 1)]
RIGHT = [(1, 1, 2), (2, 1, 1), (3, 1, None), (4, 2, 0), (5, 2, 5), (6, 9, 9), (7, None, 7), (8, 2, 0), (9, 4, 3)]
HUBS = [(1, "one"), (2, "two"), (2, "twin"), (3, "three"), (4, "four")]


def graph(spark, left=LEFT, right=RIGHT, hubs=HUBS) -> PropertyGraph:
    a = spark.createDataFrame(left, "id long, hub int, x double, w long")
    b = spark.createDataFrame(right, "id long, hub long, y long")
    n = spark.createDataFrame(hubs, "id int, name string")
    own = spark.createDataFrame([(r[1], r[0]) for r in left if r[1] is not None and r[0] % 2], "h int, l long")
    return PropertyGraph(
        spark,
        (NodeTable("left", a, "id", ("L",), properties={"x": "x", "w": "w"}), NodeTable("right", b, "id", ("R",), properties={"y": "y"}), NodeTable("hub", n, "id", ("H",), properties={"name": "name"})),
        (RelTable("l", a, "id", "hub", "left", "hub", type="AT", carrier="src"), RelTable("r", b, "id", "hub", "right", "hub", type="AT", carrier="src"), RelTable("own", own, "h", "l", "hub", "left", type="OWNS")),
    )


CHAIN = "MATCH (a:L)-[:AT]->(n:H)<-[:AT]-(b:R) "
#: Each is run folded and with its pairs.
CASES = [
    *((CHAIN + f"WHERE {c}", "n.name AS k", "count(*) AS v") for c in ("a.x < b.y", "a.x <= b.y", "a.x > b.y", "a.x >= b.y", "b.y < a.x", "b.y >= a.x", "a.x * 2 < b.y + 1 AND a.w > 1 AND b.y < 3 AND n.name <> 'twin'")),
    (CHAIN, "n.name AS k", "count(*) AS v"),
    (CHAIN, "b.y AS k", "count(a) AS v, sum(b.y) AS s, min(b.y) AS m"),
    (CHAIN, "a.w AS k", "count(b) + 1 AS v, sum(a.x) AS s, avg(a.w) AS m, count(a.w) AS c, count(DISTINCT a.x) AS d"),
    (CHAIN + "WHERE a.x < b.y", "b.y AS k", "count(a) AS v, sum(b.y) AS s"),
    (CHAIN + "WHERE a.x > b.y", "a.w AS k", "count(*) AS v, sum(a.w) AS s, avg(a.w) AS m, count(a.w) AS c"),
    (CHAIN + "WHERE a.w > 100", "1 AS k", "count(*) AS v"),
    *((CHAIN + f"WHERE {c}", "a.w AS k", "count(*) AS v") for c in ("a.x <= b.y", "b.y <= a.x", "a.x < b.y")),
    (CHAIN + "WHERE a.x < b.y", "a.w AS k", "sum(b.y) AS v"),
    (CHAIN + "WHERE a.x < b.y OR a.w = 7", "n.name AS k", "count(*) AS v"),
    ("MATCH (a:L)<-[r:OWNS]-(n:H)<-[:AT]-(b:R) WHERE a.x < b.y", "n.name AS k", "count(r) AS v"),
    ("MATCH (b:R)-[:AT]->(n)-[:OWNS]-(a:L) WHERE a.w >= b.y", "b.y AS k", "count(a) AS v"),
    ("MATCH (x)-[:AT]->(n:H)<-[:AT]-(y:R)", "n.name AS k", "count(x) AS v"),
    ("MATCH (a:L)-[:AT]->(n:H)<-[:AT]-(c:L)-[:AT]->(m) WHERE a.x < c.x", "m.name AS k", "count(*) AS v"),
]


@pytest.mark.parametrize("match,key,what", CASES)
def test_same_as_pairs(engine_spark, match, key, what, monkeypatch):
    from quiverql.operators.meet import Meeting

    clean = lambda rows: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    session = GraphSession(graph(engine_spark))
    forms = [f"{match} RETURN {key}, {what}", f"{match} WITH {key}, {what} RETURN *", f"{match} RETURN {what}"]
    for text in forms if match == CHAIN else forms[:1]:
        got = session.run(text)
        with monkeypatch.context() as plain:
            plain.setattr(Meeting, "fold", lambda *_: None)
            want = session.run(text)
        assert got.dtypes == want.dtypes and clean(got.collect()) == clean(want.collect()), text


def most_rows(df) -> int:
    """The most rows that any step of the executed plan gave out."""
    df.collect()

    def walk(p) -> int:
        own = p.metrics().get("numOutputRows")
        inner = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(k) for k in range(p.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("match,back", [("WHERE a.x < b.y", "n.name AS k, count(*) AS v"), ("", "b.y AS k, count(a) AS v"), ("WHERE a.x >= b.y", "a.w AS k, count(b) AS v")])
def test_rows_grow_with_the_sides(engine_spark, match, back):
    made = []
    for n in (200, 400):
        g = graph(engine_spark, [(k, 1, float(k * 7 % n), k) for k in range(n)], [(k, 1, k) for k in range(n)], HUBS[:1])
        made.append(most_rows(GraphSession(g).run(f"{CHAIN} {match} RETURN {back}")))
    assert made[1] <= 2 * 400 + 1 and made[0] > 0, made


@pytest.mark.parametrize("name", ["chain_theta", "chain_back"])
def test_registered(engine_spark, name):
    """No step of the registered queries has more rows than customers and suppliers together."""
    sf = "/root/testdata/sf0.01"
    sides = sum(engine_spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert 0 < most_rows(queries.queries()[name](engine_spark, sf)) <= sides
