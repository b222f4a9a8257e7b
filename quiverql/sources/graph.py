"""A property graph is a set of node tables and relationship tables over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class NodeTable:
    """Rows of ``df`` are nodes with fixed ``labels`` or those in ``label_column`` (an array, or text: one label, a comma list or a JSON array).

    ``properties`` maps property names to columns. Identity is (name, id).
    """

    name: str
    df: DataFrame
    id: str
    labels: tuple[str, ...] = ()
    label_column: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def label_array(self) -> Column:
        if self.label_column is None:
            return F.array(*map(F.lit, self.labels)) if self.labels else F.expr("cast(array() as array<string>)")
        kind = self.df.schema[self.label_column].dataType
        col = self.df[self.label_column]
        return col if isinstance(kind, T.ArrayType) else F.filter(F.split(F.regexp_replace(col, r'[\[\]"\s]', ""), ","), lambda x: x != "")

    def can_have(self, labels: tuple[str, ...]) -> bool:
        return self.label_column is not None or set(labels) <= set(self.labels)


@dataclass(frozen=True)
class RelTable:
    """Rows of ``df`` are relationships of fixed ``type`` or that in ``type_column``, between rows of two node tables.

    ``carrier`` names the end ('src' or 'dst') whose node table holds the other
    end's key itself (``df`` is then that table): a hop over it is one join.
    """

    name: str
    df: DataFrame
    src: str
    dst: str
    src_table: str
    dst_table: str
    id: str | None = None
    type: str | None = None
    type_column: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    carrier: str | None = None


@dataclass(frozen=True)
class Index:
    """Described, not built: column statistics and pushed filters do an index's work."""

    label: str
    properties: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...]
    rels: tuple[RelTable, ...]
    indexes: tuple[Index, ...] = ()
    writable: bool = False

    def node_table(self, name: str) -> NodeTable:
        return next(t for t in self.nodes if t.name == name)

    def with_tables(self, nodes: DataFrame | None = None, rels: DataFrame | None = None) -> PropertyGraph:
        """A new version of a writable graph."""
        out = self
        if nodes is not None:
            out = replace(out, nodes=(_generic_nodes(nodes),))
        if rels is not None:
            out = replace(out, rels=(_generic_rels(rels),))
        return out


def _generic_nodes(df: DataFrame) -> NodeTable:
    return NodeTable("nodes", df, "id", label_column="labels", properties={c[2:]: c for c in df.columns if c.startswith("p_")})


def _generic_rels(df: DataFrame) -> RelTable:
    return RelTable("rels", df, "src", "dst", "nodes", "nodes", id="id", type_column="type", properties={c[2:]: c for c in df.columns if c.startswith("p_")})


def _flat(df: DataFrame, keep: list[Column]) -> DataFrame:
    props = df.schema["properties"].dataType
    names = props.fieldNames() if isinstance(props, T.StructType) else []
    return df.select(*keep, *(F.col("properties")[n].alias(f"p_{n}") for n in names))


def from_records(nodes: DataFrame, rels: DataFrame, indexes: tuple[Index, ...] = ()) -> PropertyGraph:
    """A writable graph from frames (id, labels, properties) and (id, type, startNode, endNode, properties)."""
    n = _flat(nodes, [F.col("id").cast("long").alias("id"), "labels"])
    r = _flat(rels, [F.col("id").cast("long").alias("id"), "type", F.col("startNode").cast("long").alias("src"), F.col("endNode").cast("long").alias("dst")])
    return PropertyGraph(nodes.sparkSession, (_generic_nodes(n),), (_generic_rels(r),), indexes, writable=True)


NODE = "id long, labels array<string>, properties struct<{}>"
REL = "id long, type string, startNode long, endNode long, properties struct<{}>"


def from_dataset(spark: SparkSession, dataset: dict, node_properties: str = "", rel_properties: str = "", indexes: tuple[Index, ...] = ()) -> PropertyGraph:
    """A writable graph from ``{'nodes': [...], 'relationships': [...]}``; property types as a DDL list, text where not given."""

    def ddl(rows: list[dict], given: str) -> str:
        known = {p.split(":")[0].strip(" `"): p.split(":", 1)[1].strip() for p in given.split(",") if ":" in p}
        guess = {bool: "boolean", int: "bigint", float: "double", list: "array<string>"}
        for row in rows:
            for k, v in row.get("properties", {}).items():
                known.setdefault(k, guess.get(type(v), "string"))
        return ", ".join(f"`{k}`: {t}" for k, t in known.items())

    nodes, rels = dataset.get("nodes", []), dataset.get("relationships", [])
    n_ddl, r_ddl = ddl(nodes, node_properties), ddl(rels, rel_properties)
    n = spark.createDataFrame([(x["id"], x["labels"], x.get("properties", {})) for x in nodes], NODE.format(n_ddl))
    r = spark.createDataFrame([(x["id"], x["type"], x["startNode"], x["endNode"], x.get("properties", {})) for x in rels], REL.format(r_ddl))
    return from_records(n, r, indexes)


def from_json(spark: SparkSession, path: str, indexes: tuple[Index, ...] = ()) -> PropertyGraph:
    """A writable graph from a JSON file of that shape."""
    df = spark.read.json(path, multiLine=True)
    nodes = df.select(F.explode("nodes").alias("x")).select("x.*")
    rels = df.select(F.explode("relationships").alias("x")).select("x.*")
    empty = F.expr("cast(null as struct<>)")
    return from_records(nodes if "properties" in nodes.columns else nodes.withColumn("properties", empty), rels if "properties" in rels.columns else rels.withColumn("properties", empty), indexes)


def export(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Frames of nodes (table, id, labels, properties) and relationships (id, type, source and target, properties); properties are JSON."""
    def props(t) -> Column:
        return F.to_json(F.struct(*(t.df[c].alias(p) for p, c in t.properties.items()))) if t.properties else F.lit("{}")

    nodes = [t.df.select(F.lit(t.name).alias("table"), t.df[t.id].cast("string").alias("id"), t.label_array().alias("labels"), props(t).alias("properties")) for t in graph.nodes]
    rels = [
        t.df.select((t.df[t.id].cast("string") if t.id else F.lit(None).cast("string")).alias("id"), (t.df[t.type_column] if t.type_column else F.lit(t.type)).alias("type"), F.lit(t.src_table).alias("src_table"), t.df[t.src].cast("string").alias("src"), F.lit(t.dst_table).alias("dst_table"), t.df[t.dst].cast("string").alias("dst"), props(t).alias("properties"))
        for t in graph.rels
    ]
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    return whole(nodes), whole(rels)
