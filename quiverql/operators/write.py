"""CREATE, MERGE, SET, DELETE and FOREACH on a writable graph.

Every write makes a new version of the node and relationship frames (a union, a
conditional column, an anti join), cut from its lineage in the shared folder.
What reaches the driver are counts by partition and the largest id.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import NODE_REF, REL_REF, Bound, Lowering, col, common, comparable
from ..plans.parser import QueryError
from ..plans.syntax import Create, Delete, Expr, Merge, NodePat, RelPat, SetProps
from ..sources.graph import PropertyGraph
from ..sources.shared import checkpointed
from .match import Frame, edges, fresh, options, scan

#: What identifies the variables of a frame: name to (kind, type of the id or value).
Kinds = dict[str, tuple[str, T.DataType]]
PATH = T.StructType([T.StructField("nodes", T.ArrayType(NODE_REF)), T.StructField("rels", T.ArrayType(REL_REF))])
#: The variable that holds the place of a FOREACH element in its list.
PLACE = "_anon.place"


def keys_columns(frame: Frame) -> list[Column]:
    """What identifies each variable: the id of an entity, a value, the references of a path."""
    path = lambda b: F.struct(col(b.cols["nodes"]).alias("nodes"), col(b.cols["rels"]).alias("rels"))
    return [path(b) if b.kind == "path" else col(b.cols["value" if b.kind == "value" else "id"]) for b in frame.scope.values()]


def keys_of(frame: Frame) -> tuple[DataFrame, Kinds]:
    """These columns under the variables' own names."""
    kinds: Kinds = {v: (b.kind, PATH if b.kind == "path" else b.type if b.kind == "value" else b.type or T.LongType()) for v, b in frame.scope.items()}
    return frame.df.select(*(c.alias(v) for v, c in zip(kinds, keys_columns(frame), strict=True))) if kinds else frame.df.select(F.lit(True).alias("unit")), kinds


def bind_keys(graph: PropertyGraph, keys: DataFrame, kinds: Kinds) -> Frame:
    """The frame that ``keys_of`` took apart, with the entities as they are in this version of the graph."""
    df, scope = keys, {}
    for v, (kind, t) in kinds.items():
        if kind == "value":
            name = fresh(v)
            df = df.withColumnRenamed(v, name)
            scope[v] = Bound("value", {"value": name}, type=t)
            continue
        if kind == "path":
            names = {k: fresh(v) for k in PATH.fieldNames()}
            df = df.select("*", *(col(v)[k].alias(n) for k, n in names.items())).drop(v)
            scope[v] = Bound("path", names)
            continue
        if kind == "node":
            rows, b = scan(graph, v, ())
        else:
            rows, b, ends = edges(graph, RelPat(v), [w for w in options(graph, RelPat(v)) if w.forward])
            rows = rows.drop(*ends.values())
        df = df.join(rows, col(v) == col(b.cols["id"]), "left").drop(v)
        scope[v] = b
    return Frame(df, scope, unit=not kinds)


class Writer:
    """Holds the candidate version of the graph while a statement runs."""

    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params = graph, params

    def _need(self) -> None:
        if not self.graph.writable:
            raise QueryError("this graph is read-only")

    # -- tables

    def _table(self, kind: str) -> DataFrame:
        return (self.graph.nodes if kind == "node" else self.graph.rels)[0].df

    def _store(self, kind: str, df: DataFrame) -> None:
        df = checkpointed(df)
        self.graph = self.graph.with_tables(nodes=df) if kind == "node" else self.graph.with_tables(rels=df)

    def _insert(self, kind: str, new: DataFrame) -> None:
        old = self._table(kind)
        for f in new.schema.fields:
            if f.name in old.columns and old.schema[f.name].dataType.simpleString() != f.dataType.simpleString():
                t = common([old.schema[f.name].dataType, f.dataType])
                new, old = new.withColumn(f.name, col(f.name).cast(t)), old.withColumn(f.name, col(f.name).cast(t))
        self._store(kind, old.unionByName(new, allowMissingColumns=True))

    def _numbered(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``df`` written, with its rows numbered from 0 by partition, and how many there are. One count for each partition reaches the driver."""
        df = checkpointed(df)
        local, part = F.monotonically_increasing_id(), fresh("part")
        df = df.withColumn(name, local.bitwiseAND(F.lit((1 << 33) - 1))).withColumn(part, F.shiftright(local, 33))
        counts = sorted((r[0], r[1]) for r in df.groupBy(col(part)).count().collect())
        begins, total = [], 0
        for p, n in counts:
            begins.append((p, total))
            total += n
        base = fresh("base")
        offsets = self.graph.spark.createDataFrame(begins, T.StructType([T.StructField(part, T.LongType()), T.StructField(base, T.LongType())]))
        return df.join(F.broadcast(offsets), part).withColumn(name, col(name) + col(base)).drop(part, base), total  # a row for each partition

    def _next_id(self) -> int:
        top = [self._table(k).agg(F.max("id")).first()[0] for k in ("node", "rel")]
        return max((x for x in top if x is not None), default=0) + 1

    # -- clauses

    def create(self, frame: Frame, clause: Create) -> Frame:
        """New entities for each row, as one union for each of the pattern's parts."""
        self._need()
        p = clause.pattern
        fresh_nodes = [n for n in p.nodes if n.var not in frame.scope]
        pats: list[NodePat | RelPat] = [*dict.fromkeys(fresh_nodes), *p.rels]
        if any(isinstance(x, RelPat) and x.type is None for x in pats):
            raise QueryError("a new relationship needs a type")
        low = Lowering(frame.scope, self.params)
        values = {(x.var, k): low.value(e) for x in pats for k, e in x.props}
        keys, kinds = keys_of(frame)
        held = {at: fresh("new") for at in values}
        named = dict(zip(keys.columns, keys_columns(frame), strict=True)) if kinds else {}
        picked = frame.df.select(*(c.alias(v) for v, c in named.items()), *((c.cast("string") if isinstance(t, T.NullType) else c).alias(held[at]) for at, (c, t) in values.items()), F.lit(True).alias(fresh("row")))
        number = fresh("number")
        rows, n = self._numbered(picked, number)
        at = self._next_id()
        for k, x in enumerate(pats):
            rows = rows.withColumn(x.var, col(number) + F.lit(at + k * n).cast("long"))
            kinds[x.var] = ("node" if isinstance(x, NodePat) else "rel", T.LongType())
        for x in pats:
            props = [col(held[x.var, key]).alias(f"p_{key}") for key, _ in x.props]
            if isinstance(x, NodePat):
                labels = F.array(*map(F.lit, x.labels)) if x.labels else F.expr("cast(array() as array<string>)")
                self._insert("node", rows.select(col(x.var).alias("id"), labels.alias("labels"), *props))
            else:
                k = p.rels.index(x)
                ends = (p.nodes[k].var, p.nodes[k + 1].var) if x.direction != "in" else (p.nodes[k + 1].var, p.nodes[k].var)
                self._insert("rel", rows.select(col(x.var).alias("id"), F.lit(x.type).alias("type"), col(ends[0]).cast("long").alias("src"), col(ends[1]).cast("long").alias("dst"), *props))
        return bind_keys(self.graph, rows.select(*(col(v) for v in kinds)), kinds)

    def merge(self, frame: Frame, clause: Merge) -> Frame:
        """For each row the smallest id that fits, else a new entity, which rows with the same values share; the first of them counts as its maker."""
        self._need()
        p = clause.pattern
        low = Lowering(frame.scope, self.params)
        nodes = list({n.var: n for n in p.nodes if n.var not in frame.scope}.values())
        values = {(x.var, k): low.value(e) for x in [*nodes, *p.rels] for k, e in x.props}
        held = {at: fresh("new") for at in values}
        keys, kinds = keys_of(frame)
        named = dict(zip(keys.columns, keys_columns(frame), strict=True)) if kinds else {}
        columns = [*(c.alias(v) for v, c in named.items()), *((c.cast("string") if isinstance(t, T.NullType) else c).alias(held[at]) for at, (c, t) in values.items())]
        number, made = fresh("number"), fresh("made")
        rows, n = self._numbered(frame.df.select(*columns, F.lit(False).alias(made)), number)
        at = self._next_id()
        for k, x in enumerate([*nodes, *p.rels]):
            node = isinstance(x, NodePat)
            given = {key: (held[x.var, key], values[x.var, key][1]) for key, _ in x.props}
            if node:
                table, where = self._table("node"), {}
                for label in x.labels:
                    table = table.where(F.array_contains("labels", label))
                fixed = [(F.array(*map(F.lit, x.labels)) if x.labels else F.expr("cast(array() as array<string>)")).alias("labels")]
            else:
                place = p.rels.index(x)
                ends = [p.nodes[place].var, p.nodes[place + 1].var][:: 1 if x.direction != "in" else -1]
                table, where = self._table("rel"), dict(zip(("src", "dst"), ends, strict=True))
                if x.type is not None:
                    table = table.where(F.col("type") == x.type)
                fixed = [F.lit(x.type).alias("type"), *(col(e).cast("long").alias(c) for c, e in where.items())]
            found = fresh("found")
            rows = rows.withColumn(found, F.lit(None).cast("long")) if node and p.rels and x.bare else self._least(rows, table, where, given, found)
            apart = [*where.values(), *(h for h, _ in given.values())] if not (node and p.rels and x.bare) else [number]
            # of the rows with the same values the first makes the entity
            first, again = fresh("first"), {c: fresh("same") for c in apart}
            makers = rows.where(col(found).isNull()).groupBy(*map(col, apart)).agg(F.min(col(number)).alias(first)) if apart else rows.where(col(found).isNull()).agg(F.min(col(number)).alias(first))
            makers = makers.select(*(col(c).alias(m) for c, m in again.items()), col(first))
            on = reduce(lambda a, b: a & b, (col(c).eqNullSafe(col(m)) for c, m in again.items()), F.lit(True))
            rows = rows.join(makers, on & col(found).isNull(), "left").drop(*again.values())
            maker = col(found).isNull() & (col(number) == col(first))
            rows = rows.withColumn(made, maker).withColumn(x.var, F.coalesce(col(found), col(first) + F.lit(at + k * n)).cast("long")).drop(found, first)
            rows = checkpointed(rows)
            kinds[x.var] = ("node" if node else "rel", T.LongType())
            fresh_rows = rows.where(col(made)).select(col(x.var).alias("id"), *fixed, *(col(h).alias(f"p_{key}") for key, (h, _) in given.items()))
            if not fresh_rows.isEmpty():
                if not node and x.type is None:
                    raise QueryError("a new relationship needs a type")
                self._insert("node" if node else "rel", fresh_rows)
        for flag, items in ((True, clause.on_create), (False, clause.on_match)):
            part = rows.where(col(made) == F.lit(flag)).select(*map(col, kinds))
            if items and not part.isEmpty():
                self.set(bind_keys(self.graph, part, kinds), SetProps(items))
        return bind_keys(self.graph, rows.select(*map(col, kinds)), kinds)

    def _least(self, rows: DataFrame, table: DataFrame, where: dict[str, str], given: dict[str, tuple[str, T.DataType]], name: str) -> DataFrame:
        """``rows`` with the least id of the table's rows that have these values (``where``: column to a row's column; ``given``: property to one)."""
        pairs, guard = dict(where), F.lit(True)
        for key, (h, t) in given.items():
            if f"p_{key}" not in table.columns:
                guard = guard & col(h).isNull()
            elif not comparable(table.schema[f"p_{key}"].dataType, t):
                guard = F.lit(False)
            else:
                pairs[f"p_{key}"] = h
        again = {c: fresh("fits") for c in pairs}
        best = table.groupBy(*(col(c).alias(again[c]) for c in pairs)).agg(F.min("id").cast("long").alias(name))
        on = reduce(lambda a, b: a & b, (col(again[c]).eqNullSafe(col(h)) for c, h in pairs.items()), F.lit(True))
        found = rows.join(best, on, "left").drop(*again.values())  # a row for each key of the table: no row of ours is multiplied
        return found.withColumn(name, F.when(guard, col(name)))

    def set(self, frame: Frame, clause: SetProps) -> Frame:
        """Items take effect from left to right; a new property is a new column."""
        self._need()
        keys, kinds = keys_of(frame)
        keys = checkpointed(keys)
        for target, e in clause.items:
            frame = bind_keys(self.graph, keys, kinds)
            b = frame.scope.get(target.var)
            if b is None or b.kind not in ("node", "rel"):
                raise QueryError(f"{target.var!r} has no properties to set")
            c, t = Lowering(frame.scope, self.params).value(e)
            old = self._table(b.kind)
            name = f"p_{target.name}"
            t = T.StringType() if isinstance(t, T.NullType) and name not in old.columns else common([t, old.schema[name].dataType]) if name in old.columns else t
            last = [col(frame.scope[PLACE].cols["value"])] if PLACE in frame.scope else []  # of a list's elements the last one counts
            new = frame.df.where(col(b.cols["id"]).isNotNull()).select(col(b.cols["id"]).alias("_id"), c.cast(t).alias("_new"), F.struct(*last, F.xxhash64(c.cast(t))).alias("_last")).groupBy("_id").agg(F.max_by("_new", "_last").alias("_new"))
            joined = old.join(new, old["id"] == new["_id"], "left")
            before = col(name).cast(t) if name in old.columns else F.lit(None).cast(t)
            value = F.when(F.col("_id").isNotNull(), F.col("_new")).otherwise(before).alias(name)
            self._store(b.kind, joined.select(*(value if x == name else col(x) for x in old.columns), *([] if name in old.columns else [value])))
        return bind_keys(self.graph, keys, kinds)

    def delete(self, frame: Frame, clause: Delete) -> Frame:
        """All matches go; a node takes its relationships along."""
        self._need()
        b = frame.scope.get(clause.var)
        if b is None or b.kind not in ("node", "rel"):
            raise QueryError(f"{clause.var!r} cannot be deleted")
        keys, kinds = keys_of(frame)
        gone = checkpointed(keys.select(F.col(clause.var).alias("_id")).where("_id is not null").distinct())
        kept = checkpointed(keys.drop(clause.var)) if len(kinds) > 1 else keys.select(F.lit(True).alias("unit"))
        rest = {v: k for v, k in kinds.items() if v != clause.var}
        without = lambda df, key: df.join(gone, df[key] == gone["_id"], "left_anti")
        if b.kind == "rel":
            self._store("rel", without(self._table("rel"), "id"))
        else:
            self._store("rel", without(without(self._table("rel"), "src"), "dst"))
            self._store("node", without(self._table("node"), "id"))
        return bind_keys(self.graph, kept, rest) if rest else Frame(self.graph.spark.range(0).select(F.lit(True).alias("unit")), {}, True)
