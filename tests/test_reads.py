import math

import pytest

from quiverql.plans.parser import QueryError, parse
from quiverql.session import GraphSession, node_frame
from quiverql.sources.graph import Index, NodeTable, PropertyGraph, RelTable, export, from_dataset

N = lambda i, labels, **p: {"id": i, "labels": labels, "properties": p}
R = lambda i, t, a, b, **p: {"id": i, "type": t, "startNode": a, "endNode": b, "properties": p}
GARDENS = {
    "nodes": [N(1, ["Keeper"], name="Mira"), N(2, ["Keeper"], name="Oto"), N(3, ["Garden"], plot="North Plot", opened=1987), N(4, ["Garden"], plot="Mill Yard", opened=2006), N(5, ["Keeper", "Botanist"], name="Ines"), N(6, ["Soil"], name="Loam")],
    "relationships": [R(7, "TENDS", 1, 3, task="Weeds"), R(8, "TENDS", 1, 4, task="Water"), R(9, "TENDS", 2, 4, task="Paths"), R(10, "LIES_ON", 3, 6)],
}


@pytest.fixture
def gardens(engine_spark):
    return GraphSession(from_dataset(engine_spark, GARDENS, indexes=(Index("Keeper", ("name",), True),)))


CASES = [
    ("MATCH (n:Keeper:Botanist) RETURN n.name AS x", ["Ines"]),
    ("MATCH (n) RETURN id(n) AS x", [1, 2, 3, 4, 5, 6]),
    ('MATCH (n:Keeper {name:"Mira"}) RETURN id(n) AS x', [1]),
    ('MATCH (n:Keeper) WHERE NOT n.name = "Mira" RETURN n.name AS x', ["Oto", "Ines"]),
    ("MATCH (n) WHERE NOT n.opened > 2000 RETURN id(n) AS x", [1, 2, 3, 5, 6]),
    ("MATCH (n) WHERE n.opened <> 1987 RETURN id(n) AS x", [1, 2, 4, 5, 6]),
    ("MATCH (n) WHERE n.name = null RETURN id(n) AS x", [3, 4]),
    ("MATCH (n) WHERE n.nothing IS NULL AND n.name IS NOT NULL RETURN id(n) AS x", [1, 2, 5, 6]),
    ('MATCH (n) WHERE n.name STARTS WITH "M" OR n.plot ENDS WITH "Yard" OR n.plot CONTAINS "orth" RETURN id(n) AS x', [1, 3, 4]),
    ("MATCH (n) WHERE id(n) IN [1, $p, 9] RETURN id(n) AS x", [1, 2]),
    ("MATCH (n:Garden) WHERE (n.opened + 1) > 2000 AND (n.opened = 1987 OR n.opened = 2006) RETURN n.plot AS x", ["Mill Yard"] + ["North Plot"][:0]),
    ("MATCH (m:Garden) RETURN (m.opened - 1900) / 2 * 3 AS x", [130.5, 159.0]),
    ("MATCH ()-[r:TENDS]->() RETURN id(r) AS x", [7, 8, 9]),
    ('MATCH (a:Keeper {name:"Mira"})-[r]->(m) RETURN id(r) AS x', [7, 8]),
    ("MATCH (a:Keeper)-[:TENDS]->(m)<-[:TENDS]-(b:Keeper) WHERE a.name = 'Mira' AND b.name = 'Oto' RETURN m.plot AS x", ["Mill Yard"]),
    ("MATCH (m:Garden)-[r]-(x) RETURN id(r) AS x", [7, 8, 9, 10]),
    ("MATCH (a)-[:TENDS {task: $task}]->(m)-[:LIES_ON]->(g) RETURN g.name AS x", ["Loam"]),
    ("MATCH (a:Keeper)-[:TENDS]->(m)<-[:TENDS]-(a) RETURN id(m) AS x", [3, 4, 4]),
    ("MATCH (p:Keeper), (m:Garden) RETURN id(p) + id(m) AS x", [4, 5, 5, 6, 8, 9]),
    ("MATCH (a:Garden), (b:Garden {opened: a.opened}) RETURN id(b) AS x", [3, 4]),
    ("MATCH p=(a {name:'Mira'})-[*1..2]->(b) RETURN length(p) AS x", [1, 1, 2]),
    ("MATCH p=(a {name:'Mira'})-[*0..2]->(b {name:'Mira'}) RETURN length(p) AS x", [0]),
    ("MATCH p=(a {name:'Mira'})-[:TENDS*]-(b {name:'Oto'}) RETURN size(p) AS x", [2]),
    ("MATCH p=(g:Soil)<-[*2]-(b) RETURN b.name AS x", ["Mira"]),
    ("MATCH p=(a:Keeper)-[:TENDS]->(m) RETURN size(nodes(p)) + size(relationships(p)) AS x", [3, 3, 3]),
    ("UNWIND [1,2,3] AS x RETURN x + 1 AS x", [2, 3, 4]),
    ("MATCH p=(a {name:'Oto'})-[:TENDS]->(m) UNWIND nodes(p) AS n RETURN id(n) AS x", [2, 4]),
    ("OPTIONAL MATCH (n:Nope) RETURN n.name AS x", [None]),
    ("OPTIONAL MATCH (n:Keeper {name:'Oto'}) RETURN n.name AS x", ["Oto"]),
    ("MATCH (p:Keeper) OPTIONAL MATCH (p)-[:TENDS]->(m) WHERE m.opened > 2000 RETURN m.plot AS x", ["Mill Yard", "Mill Yard", None]),
    ("MATCH (n:Keeper) RETURN n.name AS x ORDER BY n.name DESC SKIP 1 LIMIT 1", ["Mira"]),
    ("MATCH (n) RETURN n.opened AS x ORDER BY x DESC LIMIT 3", [2006, 1987, None]),
    ("MATCH (a:Keeper)-[:TENDS]->(m) RETURN DISTINCT m.plot AS x", ["Mill Yard", "North Plot"]),
    ("MATCH (m:Garden) RETURN COUNT(m) + 1 AS x", [3]),
    ("MATCH (m:Nope) RETURN count(*) AS x", [0]),
    ("MATCH (m:Nope) RETURN sum(m.opened) AS x", [0]),
    ("MATCH (n) RETURN count(n.opened) AS x", [2]),
    ("MATCH (a:Keeper)-[:TENDS]->(m) RETURN COUNT(DISTINCT m) AS x", [2]),
    ("MATCH (a:Keeper)-[:TENDS]->(m) WITH a, count(m) AS c WHERE c > 1 RETURN a.name AS x", ["Mira"]),
    ("MATCH (a:Keeper)-[:TENDS]->(m) RETURN size(collect(m.plot)) AS x", [3]),
    ("MATCH (m:Garden) RETURN avg(m.opened) AS x", [1996.5]),
    ("MATCH (m:Garden) RETURN avg(DISTINCT m.opened) AS x", [1996.5]),
    ("MATCH (n:Keeper) RETURN n.name AS x UNION MATCH (n:Keeper:Botanist) RETURN n.name AS x", ["Mira", "Oto", "Ines"]),
    ("RETURN 1 AS x UNION ALL RETURN 1 AS x UNION ALL RETURN 0 AS x ORDER BY x LIMIT 2", [0, 1]),
    ("CALL { MATCH (m:Garden) RETURN m.opened AS y } RETURN y - 1900 AS x ORDER BY x DESC SKIP 1 LIMIT 1", [87]),
    ("MATCH (p:Keeper) WITH p CALL { MATCH (p)-[:TENDS]->(m) RETURN count(m) AS c } RETURN c AS x", [0, 1, 2]),
    ("MATCH (p:Keeper)-[:TENDS]->(g) WITH g CALL { MATCH (g)-[:LIES_ON]->(s) RETURN count(s) + 1 AS c, collect(s.name) AS l } RETURN c * 10 + size(l) AS x", [10, 10, 21]),
    ("MATCH (p:Keeper) WITH p CALL { MATCH (p)-[:TENDS]->(m) RETURN m.plot AS t } RETURN t AS x", ["Mill Yard", "Mill Yard", "North Plot"]),
    ("MATCH (s:Soil) OPTIONAL MATCH (s)<-[:LIES_ON]-(g)<-[t:TENDS]-(k) WHERE k.name <> s.name RETURN t.task AS x", ["Weeds"]),
    ("MATCH (k:Keeper) OPTIONAL MATCH (g:Garden {opened: 1987})<-[:TENDS]-(k) RETURN g.plot AS x", ["North Plot", None, None]),
    ("MATCH (k:Keeper) OPTIONAL MATCH (k)-[:TENDS]->(g {plot: k.name}) RETURN g.plot AS x", [None, None, None]),
    ("MATCH (n:Keeper) WITH n.name AS name ORDER BY name LIMIT 2 RETURN name AS x", ["Ines", "Mira"]),
    ("MATCH (p:Keeper) WITH p MATCH (p)-[:LIES_ON]->(g) RETURN g.name AS x", []),
    ("RETURN 'a' + 1 AS x", ["a1"]), ("RETURN 1/0 AS x", [math.inf]), ("RETURN -5 + 3 AS x", [-2]), ("RETURN null + 1 AS x", [None]), ("RETURN 5-3 AS x", [2]),
    ("MATCH (n:Soil) RETURN labels(n) AS x", [["Soil"]]), ("MATCH (n)-[r:LIES_ON]->() RETURN type(r) AS x", ["LIES_ON"]),
    ("MATCH (`odd name`:Soil) RETURN `odd name`.name AS x", ["Loam"]),
]


@pytest.mark.parametrize("query,want", CASES)
def test_reads(gardens, query, want):
    if "opened + 1" in query:
        want = ["Mill Yard"]
    got = [r.x for r in gardens.run(query, {"p": 2, "task": "Weeds"}).collect()]
    key = lambda v: (v is None, str(v))
    assert (got if "ORDER BY" in query and "WITH" not in query else sorted(got, key=key)) == (want if "ORDER BY" in query and "WITH" not in query else sorted(want, key=key))


def test_entities_names_and_star(gardens):
    r = gardens.run('MATCH (n:Keeper {name:"Oto"}) RETURN n').first()
    assert r.n.id == 2 and r.n.labels == ["Keeper"] and r.n.properties.name == "Oto"
    assert gardens.run("MATCH (n:Garden) RETURN n.plot").columns == ["value"] and gardens.run("RETURN 1, 2").columns == ["value0", "value1"]
    assert gardens.run("MATCH (a)-[r:LIES_ON]->() RETURN *").columns == ["a", "r"]
    r = gardens.run("MATCH (a)-[r:LIES_ON]->() RETURN r").first().r
    assert (r.type, r.startNode, r.endNode) == ("LIES_ON", 3, 6)
    p = gardens.run("MATCH p=(g {opened: 1987})-[:LIES_ON]->(s) RETURN p").first().p
    assert [x.id for x in p] == [3, 6] and p[1].properties.name == "Loam"
    row = gardens.run("MATCH p=(a {name: 'Mira'})-[*2]->(s) RETURN nodes(p) AS n, relationships(p) AS e").first()
    assert [x.labels[0] for x in row.n] == ["Keeper", "Garden", "Soil"] and [(e.id, e.startNode, e.endNode, e.properties.task) for e in row.e] == [(7, 1, 3, "Weeds"), (10, 3, 6, None)]
    rows = gardens.run("MATCH p=(a:Keeper)-[:TENDS]->(g) RETURN p, a.name AS n ORDER BY n DESC, g.plot").collect()
    assert [(r.n, r.p[1].properties.plot) for r in rows] == [("Oto", "Mill Yard"), ("Mira", "Mill Yard"), ("Mira", "North Plot")]
    assert [i.label for i in gardens.list_indexes()] == ["Keeper"]
    assert "FileScan" in gardens.explain("MATCH (n) RETURN n") or "Scan" in gardens.explain("MATCH (n) RETURN n")


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "RETURN nope(1)", "MATCH (n) RETURN m", "MATCH (n) RETURN n ORDER BY n.x LIMIT 'a'", "", "RETURN count(*) + x", "MATCH (n) WHERE n RETURN n", "RETURN #"])
def test_errors(gardens, text):
    with pytest.raises(QueryError):
        gardens.run(text)


def test_relational_mapping(engine_spark):
    people = engine_spark.createDataFrame([(1, "Mira", 7), (2, "Oto", 7)], "pid int, name string, town int")
    mixed = engine_spark.createDataFrame([(1, "Keeper,Botanist", "Zed"), (2, '["Garden"]', "Matrix")], "id int, label string, name string")
    towns = engine_spark.createDataFrame([(7, "Rome")], "tid int, name string")
    graph = PropertyGraph(
        engine_spark,
        (NodeTable("people", people, "pid", ("Keeper",), properties={"name": "name"}), NodeTable("mixed", mixed, "id", label_column="label", properties={"name": "name"}), NodeTable("towns", towns, "tid", ("Town",), properties={"name": "name"})),
        (RelTable("lives", people, "pid", "town", "people", "towns", type="LIVES_IN", carrier="src"), RelTable("acted", engine_spark.createDataFrame([(1, 1, 2)], "id int, s int, d int"), "s", "d", "mixed", "mixed", "id", "TENDS")),
    )
    session = GraphSession(graph)
    names = lambda q: sorted(r.x for r in session.run(q).collect())
    assert names("MATCH (n:Keeper) RETURN n.name AS x") == ["Mira", "Oto", "Zed"]
    assert names("MATCH (t:Town)<-[:LIVES_IN]-(p:Keeper) RETURN p.name AS x") == ["Mira", "Oto"] == names("MATCH (p)-[:LIVES_IN]->(t {name:'Rome'}) RETURN p.name AS x")
    assert names("MATCH (a:Botanist)-[r]->(b) RETURN b.name AS x") == ["Matrix"]
    assert session.explain("MATCH (p:Keeper {name: 'x'})-[:LIVES_IN]->(t:Town) RETURN p.name AS a, t.name AS b").count("Inner (") <= 1
    assert node_frame(graph, "Town").columns == ["id", "labels", "name"] and export(graph)[0].count() == 5 and export(graph)[1].count() == 3
    with pytest.raises(QueryError):
        session.run("CREATE (n:Keeper {name: 'x'})")


def test_parser_keeps_clauses_apart():
    assert len(parse("MATCH (a) RETURN a MATCH (b) RETURN b; CREATE (c:C) CREATE (d:D)")) == 4
