import pytest

from quiverql.plans.parser import QueryError
from quiverql.session import GraphSession
from quiverql.sources.graph import from_dataset, from_json

from .test_reads import GARDENS


@pytest.fixture
def gardens(engine_spark):
    return GraphSession(from_dataset(engine_spark, GARDENS))


def values(session, query, params=None):
    return sorted((r.x for r in session.run(query, params).collect()), key=str)


def test_create(gardens):
    assert gardens.run("CREATE (n:Keeper {name: $n, age: 3}) RETURN n", {"n": "Dan"}).first().n.properties.age == 3
    assert values(gardens, "MATCH (n:Keeper) WHERE n.age = 3 RETURN n.name AS x") == ["Dan"]
    gardens.run("CREATE (:Soil {name: 'Drama'})")
    gardens.run('MATCH (a:Keeper {name:"Ines"}) RETURN a; MATCH (m:Garden {plot:"Mill Yard"}) RETURN m; CREATE (a)-[r:TENDS {task:"C"}]->(m) RETURN r')
    assert values(gardens, "MATCH (a {name:'Ines'})-[r]->(m) RETURN r.task + '/' + m.plot AS x") == ["C/Mill Yard"]
    gardens.run("CREATE (a:Keeper {name:'Eve'})-[r:KNOWS]->(b:Keeper {name:'Fay'}) RETURN r")
    assert values(gardens, "MATCH (:Keeper {name:'Eve'})-[:KNOWS]->(b) RETURN b.name AS x") == ["Fay"]
    assert values(gardens, "MATCH (n) RETURN count(*) AS x") == [10]


def test_merge(gardens):
    assert gardens.run('MERGE (n:Keeper {name:"Mira"}) ON MATCH SET n.seen = 1 ON CREATE SET n.seen = 0 RETURN id(n) AS x, n.seen AS s').first() == (1, 1)
    assert gardens.run('MERGE (n:Keeper {name:"Gus"}) ON MATCH SET n.seen = 1 ON CREATE SET n.seen = 0 RETURN n.seen AS s').first().s == 0
    q = 'MATCH (p:Keeper {name:"%s"}) RETURN p; MATCH (m:Garden {plot:"Mill Yard"}) RETURN m; MERGE (p)-[r:TENDS]->(m) RETURN id(r) AS x'
    assert values(gardens, q % "Mira") == [8]
    assert len(values(gardens, "MATCH ()-[r:TENDS]->() RETURN id(r) AS x")) == 3
    gardens.run(q % "Ines")
    assert len(values(gardens, "MATCH ()-[r:TENDS]->() RETURN id(r) AS x")) == 4
    gardens.run("MERGE (a:Keeper {name:'New'})-[r:LIKES {much: 2}]->(g:Soil {name:'Loam'}) ON CREATE SET r.since = 2020 RETURN r")
    assert values(gardens, "MATCH (a)-[r:LIKES]->(g) RETURN a.name + g.name + r.since AS x") == ["NewLoam2020"]


def test_merge_of_many_rows(gardens):
    gardens.run("MATCH (k:Keeper)-[:TENDS]->(g) MERGE (y:Year {at: g.opened}) ON CREATE SET y.new = 1 ON MATCH SET y.again = 1")
    assert sorted(map(tuple, gardens.run("MATCH (y:Year) RETURN y.at AS a, y.new AS n, y.again AS g").collect())) == [(1987, 1, None), (2006, 1, 1)]
    gardens.run("MATCH (k:Keeper)-[:TENDS]->(g), (s:Soil) MERGE (g)-[r:NEEDS {much: k.name}]->(s)")
    assert values(gardens, "MATCH (g)-[r:NEEDS]->(s) RETURN g.plot + r.much AS x") == ["Mill YardMira", "Mill YardOto", "North PlotMira"]
    gardens.run("MATCH (g:Garden), (s:Soil) MERGE (g)-[r:NEEDS]->(s) ON MATCH SET r.old = true ON CREATE SET r.old = false")
    assert values(gardens, "MATCH ()-[r:NEEDS]->() RETURN r.old AS x") == [None, True, True]
    gardens.run("MATCH (k:Keeper) MERGE (k)-[r:OWNS]->(t)")
    assert values(gardens, "MATCH (k)-[:OWNS]->(t) RETURN k.name AS x") == ["Ines", "Mira", "Oto"]
    gardens.run("MERGE (n:Keeper {unheard: null})")
    assert values(gardens, "MATCH (n:Keeper) RETURN count(*) AS x") == [3]


def test_set(gardens):
    assert values(gardens, "MATCH (m:Garden) SET m.opened = m.opened + 1, m.next = m.opened + 1 RETURN m.next AS x") == [1989, 2008]
    gardens.run("MATCH (a {name:'Mira'})-[r:TENDS]->(m) SET r.task = 'X'")
    assert values(gardens, "MATCH ()-[r:TENDS]->() RETURN r.task AS x") == ["Paths", "X", "X"]
    gardens.run("MATCH (s:Soil) RETURN s; MATCH (g:Garden)<-[:TENDS {task: 'Paths'}]-(k) SET g.note = k.name + ' on ' + s.name, k.busy = true")
    assert values(gardens, "MATCH (g:Garden) RETURN g.note AS x") == [None, "Oto on Loam"] and values(gardens, "MATCH (k:Keeper) WHERE k.busy = true RETURN id(k) AS x") == [2]
    gardens.run("MATCH (g) SET g.note = null")
    assert values(gardens, "MATCH (g) WHERE g.note IS NOT NULL RETURN id(g) AS x") == []


def test_delete(gardens):
    gardens.run("MATCH (a {name:'Mira'})-[r]->(m {opened: 1987}) DELETE r")
    assert values(gardens, "MATCH ()-[r]->() RETURN id(r) AS x") == [10, 8, 9]
    gardens.run("MATCH (m:Garden) DELETE m")
    assert values(gardens, "MATCH (n) RETURN id(n) AS x") == [1, 2, 5, 6] and values(gardens, "MATCH ()-[r]->() RETURN id(r) AS x") == []


def test_foreach(gardens):
    gardens.run("FOREACH row IN [4, 9, 16] CREATE (b:Bed {row: row})")
    assert values(gardens, "MATCH (b:Bed) RETURN b.row * 2 AS x") == [18, 32, 8]
    gardens.run("MATCH p=(a {name:'Oto'})-[:TENDS]->(m) FOREACH n IN nodes(p) SET n.marked = true")
    assert values(gardens, "MATCH (n) WHERE n.marked = true RETURN id(n) AS x") == [2, 4]


def test_foreach_runs_for_every_row(gardens):
    gardens.run("MATCH (g:Garden) FOREACH y IN [g.opened, g.opened + 5] SET g.last = y")
    assert values(gardens, "MATCH (g:Garden) RETURN g.last - g.opened AS x") == [5, 5]  # the last element counts
    gardens.run("MATCH (k:Keeper)-[:TENDS]->(g) FOREACH t IN [k.name] CREATE (v:Visit {by: t, year: g.opened})")
    assert values(gardens, "MATCH (v:Visit) RETURN v.by + v.year AS x") == ["Mira1987", "Mira2006", "Oto2006"]
    gardens.run("MATCH (k:Keeper) FOREACH t IN [] SET k.none = t")
    gardens.run("MATCH (k:Keeper) FOREACH n IN [1, 2] MATCH (k)-[r:TENDS]->(g) SET r.times = n")
    assert values(gardens, "MATCH ()-[r:TENDS]->() RETURN r.times AS x") == [2, 2, 2]


def test_paths_are_kept_for_later_statements(gardens):
    gardens.run("MATCH way=(k {name:'Oto'})-[:TENDS]->(g) RETURN way; FOREACH n IN nodes(way) MATCH (n) SET n.walked = length(way)")
    assert values(gardens, "MATCH (n) WHERE n.walked = 1 RETURN id(n) AS x") == [2, 4]
    assert values(gardens, "MATCH way=(s:Soil)<-[*2]-(k) RETURN way; UNWIND nodes(way) AS n RETURN id(n) AS x") == [1, 3, 6]


def test_paths_of_any_length(engine_spark):
    n = 40
    ring = {"nodes": [{"id": i, "labels": ["Post"], "properties": {"at": i}} for i in range(n)], "relationships": [{"id": 100 + i, "type": "NEXT", "startNode": i, "endNode": (i + 1) % n, "properties": {}} for i in range(n)]}
    session = GraphSession(from_dataset(engine_spark, ring))
    assert values(session, "MATCH p=(a {at: 0})-[:NEXT*]->(b) RETURN length(p) AS x") == sorted(range(1, n), key=str)
    assert values(session, "MATCH p=(a {at: 3})-[:NEXT*37..37]->(b) RETURN b.at AS x") == [0]


def test_a_failed_statement_changes_nothing(gardens):
    with pytest.raises(QueryError):
        gardens.run("CREATE (n:Keeper {name: 'Quin'}) SET q.x = 1")
    assert values(gardens, "MATCH (n:Keeper {name:'Quin'}) RETURN id(n) AS x") == []


def test_json_source_and_empty_graph(engine_spark, tmp_path):
    import json

    (tmp_path / "g.json").write_text(json.dumps(GARDENS))
    session = GraphSession(from_json(engine_spark, f"{tmp_path}/g.json"))
    assert values(session, "MATCH (a:Keeper)-[:TENDS]->(m) RETURN m.plot AS x") == ["Mill Yard", "Mill Yard", "North Plot"]
    empty = GraphSession(from_dataset(engine_spark, {"nodes": [], "relationships": []}))
    assert values(empty, "MATCH (n) RETURN id(n) AS x") == []
    empty.run("MERGE (n:Keeper {name:'First'})")
    assert values(empty, "MATCH (n) RETURN n.name AS x") == ["First"]
