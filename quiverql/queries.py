"""Queries over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.parser import QueryError
from .session import GraphSession
from .sources.graph import Index, NodeTable, PropertyGraph, RelTable, _generic_nodes, _generic_rels, export, from_dataset, from_json
from .sources.shared import SharedPath

Query = Callable[[SparkSession, str], DataFrame]


def tables_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star schema, events and conversations as a graph. Foreign keys are relationships that node rows carry."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    bare = lambda df, prefix: {c.removeprefix(prefix): c for c in df.columns}
    region, nation, customer, supplier, part, orders, lineitem, events = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    turns = read("conversations")
    place = lambda turn: F.concat_ws("/", F.col("conv_id"), turn)
    turns = turns.withColumn("key", place(F.col("turn"))).withColumn("next_key", place(F.col("turn") + 1))
    users = events.select("user_id").distinct()
    docs = read("documents").select("doc_id", "lang", "source", "n_chars")
    nodes = (
        NodeTable("region", region, "r_regionkey", ("Region",), properties=bare(region, "r_")),
        NodeTable("nation", nation, "n_nationkey", ("Nation",), properties=bare(nation, "n_")),
        NodeTable("customer", customer, "c_custkey", ("Customer",), properties=bare(customer, "c_")),
        NodeTable("supplier", supplier, "s_suppkey", ("Supplier",), properties=bare(supplier, "s_")),
        NodeTable("part", part, "p_partkey", ("Part",), properties=bare(part, "p_")),
        NodeTable("orders", orders, "o_orderkey", ("Order",), properties=bare(orders, "o_")),
        NodeTable("users", users, "user_id", ("User",), properties={"user_id": "user_id"}),
        NodeTable("events", events, "event_id", ("Event",), properties=bare(events, "")),
        NodeTable("turns", turns, "key", ("Turn",), properties={c: c for c in ("conv_id", "turn", "role", "text")}),
        NodeTable("documents", docs, "doc_id", ("Document",), properties=bare(docs, "")),
    )
    line = {c.removeprefix("l_"): c for c in lineitem.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")}
    rels = (
        RelTable("in_region", nation, "n_nationkey", "n_regionkey", "nation", "region", type="IN_REGION", carrier="src"),
        RelTable("customer_nation", customer, "c_custkey", "c_nationkey", "customer", "nation", type="IN_NATION", carrier="src"),
        RelTable("supplier_nation", supplier, "s_suppkey", "s_nationkey", "supplier", "nation", type="IN_NATION", carrier="src"),
        RelTable("placed", orders, "o_custkey", "o_orderkey", "customer", "orders", type="PLACED", carrier="dst"),
        RelTable("contains", lineitem, "l_orderkey", "l_partkey", "orders", "part", type="CONTAINS", properties=line),
        RelTable("supplied_by", lineitem, "l_orderkey", "l_suppkey", "orders", "supplier", type="SUPPLIED_BY", properties=line),
        RelTable("did", events, "user_id", "event_id", "users", "events", type="DID", carrier="dst"),
        RelTable("next", turns, "key", "next_key", "turns", "turns", type="NEXT", carrier="src"),
    )
    return PropertyGraph(spark, nodes, rels)


def small_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations and regions as a writable graph: a nation's id is its key, a region's 100 more, and IN_REGION edges from 1000."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region"))
    n = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_name").alias("p_name"))
    r = region.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.array(F.lit("Region")).alias("labels"), F.col("r_name").alias("p_name"))
    e = nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.lit("IN_REGION").alias("type"), F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    return PropertyGraph(spark, (_generic_nodes(n.unionByName(r)),), (_generic_rels(e),), writable=True)


_graphs: dict[tuple, PropertyGraph] = {}


def known_graph(make: Callable[[SparkSession, str], PropertyGraph], spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over a folder as its tables are now, described once in a session: plans only, no rows are kept."""
    place = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, make.__name__, sf_dir, state)
    if key not in _graphs:
        _graphs[key] = make(spark, sf_dir)
    return _graphs[key]


def _run(text: str, params: dict[str, Any] | None, graph: Callable[[SparkSession, str], PropertyGraph], spark: SparkSession, sf_dir: str) -> DataFrame:
    df = GraphSession(known_graph(graph, spark, sf_dir)).run(text, params)
    # sums of doubles depend on the order of addition
    return df.select(*(F.round(c, 4).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns))


#: Name: (query, parameters, SQL).
READS: dict[str, tuple[str, dict[str, Any], str]] = {
    "node_scan_filter": ("MATCH (o:Order) WHERE o.totalprice > 1000 RETURN o.orderkey AS k", {}, "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 1000"),
    "inline_props": ('MATCH (c:Customer {mktsegment:"BUILDING"}) RETURN c.name AS name', {}, "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "param_filter": ("MATCH (o:Order) WHERE o.totalprice >= $p RETURN o.orderkey AS k, o.orderstatus AS s", {"p": 200000}, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_totalprice >= 200000"),
    "param_limit": ("MATCH (o:Order) RETURN o.orderkey AS k ORDER BY k LIMIT $n", {"n": 7}, "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 7"),
    "id_seek": ("MATCH (c:Customer) WHERE id(c) = 5 RETURN c.name AS name", {}, "SELECT c_name AS name FROM customer WHERE c_custkey = 5"),
    "id_in": ("MATCH (c:Customer) WHERE id(c) IN [1,2,3] RETURN c.name AS name", {}, "SELECT c_name AS name FROM customer WHERE c_custkey IN (1,2,3)"),
    "string_preds": ('MATCH (p:Part) WHERE p.name STARTS WITH "small" OR p.name ENDS WITH "ring" OR p.name CONTAINS "wid" RETURN p.partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring') OR contains(p_name, 'wid')"),
    "bool_logic": ('MATCH (c:Customer) WHERE NOT (c.acctbal > 0 AND c.mktsegment = "BUILDING") OR (c.nationkey = 3 AND NOT c.acctbal < 100) RETURN c.custkey AS k', {}, "SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING') OR (c_nationkey = 3 AND NOT c_acctbal < 100)"),
    "in_list": ('MATCH (c:Customer) WHERE c.mktsegment IN ["BUILDING", "MACHINERY"] RETURN c.custkey AS k', {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "neq": ("MATCH (c:Customer) WHERE c.nationkey <> 3 RETURN c.custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 3"),
    "is_null": ("MATCH (c:Customer) WHERE c.nothing IS NULL AND c.name IS NOT NULL RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM customer WHERE c_name IS NOT NULL"),
    "arith": ("MATCH (o:Order) RETURN o.orderkey AS k, (o.totalprice - 1000) / 4 * 3 AS v", {}, "SELECT o_orderkey AS k, round((o_totalprice - 1000) / 4 * 3, 4) AS v FROM orders"),
    "div_zero": ("MATCH (n:Nation) RETURN n.nationkey AS k, (n.nationkey + 1) / 0 AS d", {}, "SELECT n_nationkey AS k, 'inf'::DOUBLE AS d FROM nation"),
    "neg": ("MATCH (n:Nation) RETURN -n.nationkey + 1 AS v", {}, "SELECT (-n_nationkey + 1)::BIGINT AS v FROM nation"),
    "concat": ('MATCH (n:Nation) RETURN n.name + "/" + n.nationkey AS v', {}, "SELECT n_name || '/' || n_nationkey AS v FROM nation"),
    "functions": ("MATCH (n:Nation)-[r:IN_REGION]->(g) RETURN id(n) AS i, type(r) AS t, size(n.name) AS s, size(labels(g)) AS l", {}, "SELECT n_nationkey AS i, 'IN_REGION' AS t, length(n_name) AS s, 1::BIGINT AS l FROM nation"),
    "orderby_topk": ("MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY o.totalprice DESC, k LIMIT 10", {}, "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders ORDER BY o_totalprice DESC, k LIMIT 10"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY name SKIP 5 LIMIT 10", {}, "SELECT c_name AS name FROM customer ORDER BY name LIMIT 10 OFFSET 5"),
    "distinct_rows": ("MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS s, c.nationkey AS n", {}, "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer"),
    "agg_global": ("MATCH (o:Order) RETURN count(*) AS n, sum(o.totalprice) AS s, min(o.totalprice) AS lo, max(o.totalprice) AS hi, avg(o.totalprice) AS m", {}, "SELECT count(*) AS n, round(sum(o_totalprice), 4) AS s, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, round(avg(o_totalprice), 4) AS m FROM orders"),
    "agg_group": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, count(*) AS n, avg(c.acctbal) AS bal", {}, "SELECT c_mktsegment AS seg, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY 1"),
    "agg_distinct": ("MATCH (c:Customer) RETURN count(DISTINCT c.nationkey) AS n, sum(DISTINCT c.nationkey) AS s", {}, "SELECT count(DISTINCT c_nationkey) AS n, sum(DISTINCT c_nationkey)::BIGINT AS s FROM customer"),
    "agg_expr": ("MATCH (c:Customer) RETURN c.nationkey AS k, count(*) + 1 AS n, max(c.acctbal) - min(c.acctbal) AS d", {}, "SELECT c_nationkey AS k, count(*) + 1 AS n, round(max(c_acctbal) - min(c_acctbal), 4) AS d FROM customer GROUP BY 1"),
    "agg_empty": ("MATCH (c:Customer) WHERE c.acctbal > 1000000000 RETURN count(c) AS n, sum(c.acctbal) AS s, max(c.acctbal) AS m", {}, "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS m"),
    "collect_size": ("MATCH (c:Customer) RETURN c.nationkey AS k, size(collect(c.name)) AS n, size(collect(DISTINCT c.mktsegment)) AS d", {}, "SELECT c_nationkey AS k, count(c_name) AS n, count(DISTINCT c_mktsegment) AS d FROM customer GROUP BY 1"),
    "rel_scan": ("MATCH ()-[r:PLACED]->() RETURN count(r) AS n", {}, "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 150000 RETURN c.name AS name, o.orderkey AS k", {}, "SELECT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000"),
    "hop_in": ("MATCH (o:Order)<-[:PLACED]-(c:Customer {mktsegment: 'BUILDING'}) RETURN o.orderkey AS k, c.custkey AS c", {}, "SELECT o_orderkey AS k, c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "hop_undirected": ("MATCH (a:Turn)-[:NEXT]-(b:Turn) WHERE a.role = 'user' RETURN a.conv_id AS c, a.turn AS a, b.turn AS b", {}, "SELECT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 WHERE a.role = 'user'"),
    "chain3": ("MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p:Part) WHERE p.size > 40 RETURN c.mktsegment AS seg, count(*) AS n", {}, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1"),
    "chain_theta": ("MATCH (c:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(s:Supplier) WHERE c.acctbal < s.acctbal RETURN n.name AS nation, count(*) AS n", {}, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal < s_acctbal GROUP BY 1"),
    "chain_back": ("MATCH (c1:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN s.suppkey AS k, count(c1) AS n", {}, "SELECT s_suppkey AS k, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1"),
    "chain_repeat": ("MATCH (a:Turn)-[:NEXT]->(b:Turn)<-[:NEXT]-(a) RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"),
    "rel_props": ('MATCH (o:Order)-[r:CONTAINS {returnflag:"R"}]->(p:Part) RETURN p.brand AS b, count(*) AS n, sum(r.quantity) AS q', {}, "SELECT p_brand AS b, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1"),
    "any_rel": ("MATCH (n:Nation)<-[r]-(x) RETURN type(r) AS t, count(*) AS n", {}, "SELECT 'IN_NATION' AS t, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS n"),
    "any_label": ("MATCH (x)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(x) AS c", {}, "SELECT n_name AS nation, count(*) AS c FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1"),
    "cross_product": ("MATCH (a:Nation), (b:Region) RETURN a.name AS a, b.name AS b", {}, "SELECT n_name AS a, r_name AS b FROM nation, region"),
    "lateral_props": ("MATCH (a:Nation), (b:Region {regionkey: a.regionkey}) RETURN a.name AS a, b.name AS b", {}, "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "named_path_len": ("MATCH p=(c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN size(p) AS l, size(nodes(p)) AS n, count(*) AS c", {}, "SELECT 2::BIGINT AS l, 3::BIGINT AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "optional_node": ("OPTIONAL MATCH (c:Customer {name: 'nobody'}) RETURN c.name AS name", {}, "SELECT NULL::VARCHAR AS name"),
    "optional_chain": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 RETURN c.custkey AS k, count(o) AS n", {}, "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1"),
    "optional_multi": ("OPTIONAL MATCH (a:Region {name: 'nowhere'}), (b:Region) RETURN a.name AS a, b.name AS b", {}, "SELECT NULL::VARCHAR AS a, r_name AS b FROM region"),
    "with_pipeline": ("MATCH (c:Customer) WITH c.nationkey AS k, sum(c.acctbal) AS s MATCH (n:Nation {nationkey: k}) RETURN n.name AS nation, s AS s", {}, "SELECT n_name AS nation, round(sum(c_acctbal), 4) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 15 RETURN c.name AS name, n AS n", {}, "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "with_star": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH * WHERE r.regionkey = 1 RETURN n.name AS n, r.name AS r", {}, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1"),
    "with_topk_then_match": ("MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 10 MATCH (c)-[:PLACED]->(o) RETURN c.custkey AS k, sum(o.totalprice) AS s", {}, "SELECT c_custkey AS k, round(sum(o_totalprice), 4) AS s FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "unwind_list": ("UNWIND [1,2,3] AS x RETURN x * 2 AS v", {}, "SELECT unnest([2,4,6])::BIGINT AS v"),
    "unwind_param": ("UNWIND $l AS x RETURN x AS v", {"l": ["a", "b"]}, "SELECT unnest(['a','b']) AS v"),
    "unwind_collect": ("MATCH (n:Nation) WITH n.regionkey AS r, collect(n.name) AS l UNWIND l AS x RETURN r AS r, x AS x", {}, "SELECT n_regionkey AS r, n_name AS x FROM nation"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", {}, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name", {}, "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "union_sorted": ("MATCH (n:Nation) RETURN n.name AS name UNION MATCH (r:Region) RETURN r.name AS name ORDER BY name SKIP 3 LIMIT 5", {}, "SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) ORDER BY name LIMIT 5 OFFSET 3"),
    "call_subquery": ("CALL { MATCH (c:Customer) RETURN c.nationkey AS k, count(*) AS n } RETURN k AS k, n * 2 AS m ORDER BY m DESC, k LIMIT 5", {}, "SELECT c_nationkey AS k, count(*) * 2 AS m FROM customer GROUP BY 1 ORDER BY m DESC, k LIMIT 5"),
    "call_correlated": ("MATCH (n:Nation) WITH n CALL { MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN count(s) AS c } RETURN n.name AS n, c AS c", {}, "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c FROM nation"),
    "call_empty": ("MATCH (c:Customer) WITH c CALL { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN count(o) AS n, sum(o.totalprice) AS s, max(o.orderkey) AS m, size(collect(o.orderkey)) AS l } RETURN c.custkey AS k, n, s, m, l", {}, "SELECT c_custkey AS k, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 4) AS s, max(o_orderkey) AS m, count(o_orderkey) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "call_repeated_rows": ("MATCH (c:Customer)-[:IN_NATION]->(n) WITH n.regionkey AS r CALL { MATCH (g:Nation {regionkey: r}) RETURN count(g) AS c } RETURN r, c, count(*) AS n", {}, "SELECT n_regionkey AS r, (SELECT count(*) FROM nation g WHERE g.n_regionkey = n.n_regionkey) AS c, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY 1, n.n_regionkey"),
    "lateral_alias": ("MATCH (n:Nation) RETURN n.nationkey + 1 AS a, a * 2 AS b", {}, "SELECT (n_nationkey + 1)::BIGINT AS a, ((n_nationkey + 1) * 2)::BIGINT AS b FROM nation"),
    "count_distinct_star": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r RETURN count(DISTINCT *) AS n, count(*) AS m", {}, "SELECT count(DISTINCT n_regionkey) AS n, count(*) AS m FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "unwind_expr": ("UNWIND [1,2,3] AS x RETURN x + 1", {}, "SELECT unnest([2,3,4])::BIGINT AS value"),
    "avg_distinct": ("MATCH (c:Customer) RETURN c.mktsegment AS s, avg(DISTINCT c.nationkey) AS m", {}, "SELECT c_mktsegment AS s, round(avg(DISTINCT c_nationkey), 4) AS m FROM customer GROUP BY 1"),
    "optional_two_hops": ("MATCH (s:Supplier) OPTIONAL MATCH (s)-[:IN_NATION]->(n)-[:IN_REGION]->(r:Region) WHERE r.name = 'ASIA' AND n.nationkey > s.suppkey RETURN s.suppkey AS k, n.name AS n, r.name AS r", {}, "SELECT s_suppkey AS k, n_name AS n, r_name AS r FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA') ON s_nationkey = n_nationkey AND n_nationkey > s_suppkey"),
    "return_only": ("RETURN 1 + 2 AS a, 'x' AS b, null AS c", {}, "SELECT 3::BIGINT AS a, 'x' AS b, NULL::VARCHAR AS c"),
    "user_events": ("MATCH (u:User)-[:DID]->(e:Event) WHERE e.event_type = 'click' RETURN u.user_id AS u, count(e) AS n, sum(e.value) AS v", {}, "SELECT user_id AS u, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE event_type = 'click' GROUP BY 1"),
    "supplier_revenue": ("MATCH (o:Order)-[r:SUPPLIED_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, sum(r.extendedprice * (1 - r.discount)) AS revenue", {}, "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"),
    "nation_revenue": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS nation, COUNT(o) AS orders, SUM(o.totalprice) AS revenue ORDER BY revenue DESC LIMIT 10", {}, "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 4) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY revenue DESC LIMIT 10"),
}

_WALK = "WITH RECURSIVE n AS (SELECT conv_id AS c, turn AS t, role FROM conversations), w AS (SELECT c, t AS a, t AS b, role, 0 AS l FROM n UNION ALL SELECT w.c, w.a, n.t, n.role, w.l + 1 FROM w JOIN n ON n.c = w.c AND n.t = w.b + 1) SELECT {0} FROM w WHERE {1}"
_ENDS = "c || '/' || a AS a, c || '/' || b AS b"
READS |= {
    "varlen_any": ("MATCH p=(a:Turn {turn: 0})-[:NEXT*]->(b:Turn) RETURN id(a) AS a, id(b) AS b, length(p) AS l", {}, _WALK.format(f"{_ENDS}, l::BIGINT AS l", "l >= 1 AND a = 0")),
    "varlen_range": ("MATCH p=(a:Turn)-[:NEXT*1..3]->(b:Turn) RETURN length(p) AS l, count(*) AS n", {}, _WALK.format("l::BIGINT AS l, count(*) AS n", "l BETWEEN 1 AND 3 GROUP BY 1")),
    "varlen_exact": ("MATCH p=(a:Turn)-[:NEXT*2]->(b:Turn) RETURN id(a) AS a, id(b) AS b", {}, _WALK.format(_ENDS, "l = 2")),
    "varlen_zero": ("MATCH p=(a:Turn)-[:NEXT*0..1]->(b:Turn) RETURN id(a) AS a, id(b) AS b, size(nodes(p)) AS n", {}, _WALK.format(f"{_ENDS}, (l + 1)::BIGINT AS n", "l <= 1")),
    "varlen_in": ("MATCH p=(b:Turn {role: 'assistant'})<-[:NEXT*1..2]-(a:Turn) RETURN id(a) AS a, id(b) AS b", {}, _WALK.format(_ENDS, "l BETWEEN 1 AND 2 AND role = 'assistant'")),
    "varlen_undirected": ("MATCH p=(a:Turn {turn: 1})-[:NEXT*1..2]-(b:Turn) RETURN id(a) AS a, id(b) AS b, length(p) AS l", {}, "SELECT a.conv_id || '/' || a.turn AS a, b.conv_id || '/' || b.turn AS b, abs(a.turn - b.turn)::BIGINT AS l FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 2 WHERE a.turn = 1 AND (abs(a.turn - b.turn) = 1 OR EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = a.conv_id AND m.turn * 2 = a.turn + b.turn))"),
    "varlen_across": ("MATCH p=(c:Customer)-[*2]->(r:Region) RETURN r.name AS r, count(*) AS n", {}, "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
}

WRITES: dict[str, tuple[str, dict[str, Any], str]] = {
    "create_then_match": ("CREATE (n:Nation {name: 'ATLANTIS'}) RETURN n; MATCH (r:Region {name: 'ASIA'}) RETURN r; CREATE (n)-[e:IN_REGION]->(r) RETURN e; MATCH (m:Nation)-[:IN_REGION]->(g) RETURN g.name AS r, count(m) AS c", {}, "SELECT r_name AS r, count(*) + (r_name = 'ASIA')::INT AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "merge_node": ("MERGE (n:Region {name: 'ASIA'}) ON MATCH SET n.seen = 1 ON CREATE SET n.seen = 0; MERGE (m:Region {name: 'MARS'}) ON MATCH SET m.seen = 1 ON CREATE SET m.seen = 0; MATCH (n:Region) RETURN n.name AS name, n.seen AS seen", {}, "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 1 END::BIGINT AS seen FROM region UNION ALL SELECT 'MARS', 0"),
    "merge_rel": ("MATCH (n:Nation) WHERE id(n) = 3 RETURN n; MATCH (r:Region {name: 'ASIA'}) RETURN r; MERGE (n)-[e:NEAR {far: 2}]->(r) RETURN e; MERGE (n)-[e:NEAR {far: 2}]->(r) RETURN e; MATCH (n)-[e:NEAR]->(r) RETURN id(n) AS n, r.name AS r, e.far AS far", {}, "SELECT 3::BIGINT AS n, 'ASIA' AS r, 2::BIGINT AS far"),
    "set_props": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) SET n.region = r.name, n.tag = n.region + '/' + n.name; MATCH (n:Nation) RETURN n.tag AS tag", {}, "SELECT r_name || '/' || n_name AS tag FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "delete_cascade": ("MATCH (r:Region {name: 'ASIA'}) DELETE r; MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN r.name AS r, count(e) AS c", {}, "SELECT r_name AS r, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1"),
    "foreach_rows": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) FOREACH x IN [r.name, n.name] SET n.tag = x + '!'; MATCH (n:Nation) RETURN n.name AS name, n.tag AS tag", {}, "SELECT n_name AS name, n_name || '!' AS tag FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_carry": ("MATCH p=(n:Nation {name: 'NATION_3'})-[:IN_REGION]->(r) RETURN p; FOREACH x IN nodes(p) MATCH (x) SET x.seen = 1; MATCH (x) WHERE x.seen = 1 RETURN x.name AS name", {}, "SELECT n_name AS name FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'"),
    "delete_rel": ("MATCH (n:Nation)-[e:IN_REGION]->(r:Region {name: 'ASIA'}) DELETE e; MATCH (m:Nation) OPTIONAL MATCH (m)-[:IN_REGION]->(g) RETURN m.name AS n, g.name AS r", {}, "SELECT n_name AS n, CASE WHEN r_name <> 'ASIA' THEN r_name END AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "snapshot": ("MATCH (n:Nation) CREATE (m:Nation {name: n.name + ' II'}); MATCH (n:Nation) RETURN n.name AS name", {}, "SELECT n_name AS name FROM nation UNION ALL SELECT n_name || ' II' FROM nation"),
    "foreach_create": ("FOREACH x IN ['a', 'b', 'c'] CREATE (b:Batch {name: x}); MATCH (b:Batch) RETURN b.name AS name", {}, "SELECT unnest(['a','b','c']) AS name"),
}


def _whole(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(small_graph(spark, sf_dir))


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and relationships of a path, with their properties and typed ends."""
    df = _whole(spark, sf_dir).run("MATCH p=(n:Nation)-[:IN_REGION*1..2]->(r) RETURN p AS p, relationships(p) AS e")
    return df.select(F.array_join(F.transform("p", lambda x: x["properties"]["name"]), ">").alias("names"), F.col("e")[0]["id"].alias("e"), F.col("e")[0]["type"].alias("t"), F.col("e")[0]["startNode"].alias("s"), F.col("e")[0]["endNode"].alias("d"))


def return_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nodes and relationships as structs."""
    df = GraphSession(known_graph(tables_graph, spark, sf_dir)).run("MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n, e")
    return df.select(F.col("n.id").alias("i"), F.col("n.labels")[0].alias("l"), F.col("n.properties.name").alias("name"), F.col("e.type").alias("t"), F.col("e.startNode").alias("s"), F.col("e.endNode").alias("d"))


def _dataset(spark: SparkSession, sf_dir: str) -> dict:
    """Nations and regions (30 nodes) as an object of the JSON shape."""
    nodes, rels = (df.collect() for df in (small_graph(spark, sf_dir).nodes[0].df, small_graph(spark, sf_dir).rels[0].df))
    return {
        "nodes": [{"id": r.id, "labels": list(r.labels), "properties": {"name": r.p_name}} for r in nodes],
        "relationships": [{"id": r.id, "type": r.type, "startNode": r.src, "endNode": r.dst, "properties": {}} for r in rels],
    }


_BY_REGION = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, count(n) AS n"


def object_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphSession(from_dataset(spark, _dataset(spark, sf_dir))).run(_BY_REGION)


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object written as a JSON file and read by Spark."""
    path = SharedPath(spark).path
    spark.createDataFrame([(json.dumps(_dataset(spark, sf_dir)),)], "value string").coalesce(1).write.text(path)
    return GraphSession(from_json(spark, path)).run(_BY_REGION)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, rels = export(small_graph(spark, sf_dir))
    nodes = nodes.select("id", F.array_join("labels", "+").alias("what"), F.get_json_object("properties", "$.name").alias("more"))
    return nodes.unionByName(rels.select("id", F.col("type").alias("what"), F.concat_ws(">", "src", "dst").alias("more")))


def failed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that fails after its CREATE changes nothing; the one before it stays."""
    session = _whole(spark, sf_dir)
    session.run("CREATE (n:Nation {name: 'FIRST'})")
    try:
        session.run("CREATE (n:Nation {name: 'SECOND'}) SET other.x = 1")
    except QueryError:
        pass
    return session.run("MATCH (n:Nation) RETURN n.name AS name")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are not allowed, and whether they were refused."""
    cases = {"write to a read-only source": (tables_graph, "CREATE (n:Nation {name: 'X'})"), "mixed aggregate": (small_graph, "MATCH (n:Nation) RETURN count(n) + n.name AS x"), "unknown variable": (small_graph, "MATCH (n:Nation) RETURN m.name AS x")}
    rows = []
    for name, (make, text) in cases.items():
        try:
            GraphSession(make(spark, sf_dir)).run(text)
            rows.append((name, False))
        except QueryError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "what string, refused boolean")


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, quoted names, escapes, either quote, letter case, numbers."""
    text = "match (`a b`:Nation) where `a b`.name = \"NATION_3\" return `a b`.name as `x y`, 'it''s' + \"\" as q, 1.5 as f, -2 as i, true as t"
    return _whole(spark, sf_dir).run(text.replace("'it''s'", "'its'"))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = replace(small_graph(spark, sf_dir), indexes=(Index("Nation", ("name",), True), Index("Region", ("name",))))
    return spark.createDataFrame([(i.label, ",".join(i.properties), i.unique) for i in GraphSession(graph).list_indexes()], "label string, properties string, is_unique boolean")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan of a scan with a filter says."""
    plan = GraphSession(known_graph(tables_graph, spark, sf_dir)).explain("MATCH (o:Order) WHERE o.totalprice > 1000 RETURN o.orderkey AS k")
    return spark.createDataFrame([("GreaterThan(o_totalprice,1000.0)" in plan, "struct<o_orderkey:bigint,o_totalprice:double>" in plan)], "pushed boolean, pruned boolean")


_REGIONS_SQL = "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
#: Queries that are more than text: (function, SQL).
OTHERS: dict[str, tuple[Query, str]] = {
    "path_nodes": (path_nodes, "SELECT n_name || '>' || r_name AS names, (n_nationkey + 1000)::BIGINT AS e, 'IN_REGION' AS t, n_nationkey::BIGINT AS s, (r_regionkey + 100)::BIGINT AS d FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "return_entities": (return_entities, "SELECT n_nationkey AS i, 'Nation' AS l, n_name AS name, 'IN_REGION' AS t, n_nationkey AS s, n_regionkey AS d FROM nation"),
    "object_source": (object_source, _REGIONS_SQL),
    "json_source": (json_source, _REGIONS_SQL),
    "exported": (exported, "SELECT n_nationkey::VARCHAR AS id, 'Nation' AS what, n_name AS more FROM nation UNION ALL SELECT (r_regionkey + 100)::VARCHAR, 'Region', r_name FROM region UNION ALL SELECT (n_nationkey + 1000)::VARCHAR, 'IN_REGION', n_nationkey || '>' || (n_regionkey + 100) FROM nation"),
    "failed_statement": (failed_statement, "SELECT n_name AS name FROM nation UNION ALL SELECT 'FIRST'"),
    "refused": (refused, "SELECT unnest(['write to a read-only source', 'mixed aggregate', 'unknown variable']) AS what, true AS refused"),
    "lexical": (lexical, "SELECT n_name AS \"x y\", 'its' AS q, 1.5::DOUBLE AS f, (-2)::BIGINT AS i, true AS t FROM nation WHERE n_name = 'NATION_3'"),
    "indexes": (indexes, "SELECT 'Nation' AS label, 'name' AS properties, true AS is_unique UNION ALL SELECT 'Region', 'name', false"),
    "explained": (explained, "SELECT true AS pushed, true AS pruned"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: partial(_run, text, params, tables_graph) for k, (text, params, _) in READS.items()}
    out |= {k: partial(_run, text, params, small_graph) for k, (text, params, _) in WRITES.items()}
    return out | {k: make for k, (make, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, _, sql) in (READS | WRITES).items()} | {k: sql for k, (_, sql) in OTHERS.items()}
