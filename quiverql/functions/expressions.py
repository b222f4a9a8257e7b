"""Lowering of expressions and conditions to columns, with two-valued logic.

A comparison with a missing value is false, and NOT turns it into true. A
filter takes NULL for false anyway, so a comparison in positive position stays
plain, which keeps it pushable to the scan; under NOT it is made two-valued.
Equality is null-safe unless a side is a non-null constant in positive position.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import QueryError
from ..plans.syntax import Agg, Binary, Call, Compare, Expr, ListOf, Lit, Logic, Neg, Param, Prop, Var

#: What a path holds of its nodes and of its relationships until they are returned.
NODE_REF = T.StructType([T.StructField("table", T.StringType()), T.StructField("id", T.StringType())])
REL_REF = T.StructType([T.StructField(n, T.StringType()) for n in ("rel_table", "rel_id", "type", "src", "dst")])


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Bound:
    """A variable in a frame. ``cols``: its columns by role; ``props``: property to (column, type)."""

    kind: str  # node, rel, path, value
    cols: dict[str, str] = field(default_factory=dict)
    props: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    type: T.DataType | None = None  # of a value, or of an id
    hidden: dict[str, str] = field(default_factory=dict)  # keys of other nodes that the row carries, by relationship table
    ends: T.DataType | None = None  # of a relationship's source and target keys

    def every_column(self) -> list[str]:
        return [*self.cols.values(), *(c for c, _ in self.props.values()), *self.hidden.values()]

    def keys(self) -> list[str]:
        """Columns that identify the value."""
        if self.kind == "node":
            return [self.cols["table"], self.cols["id"]]
        if self.kind == "rel" and self.type is not None:
            return [self.cols["table"], self.cols["id"]]
        return self.every_column()


Scope = dict[str, Bound]
Typed = tuple[Column, T.DataType]


class Lowering:
    """Expressions over one scope."""

    def __init__(self, scope: Scope, params: dict[str, Any], aliases: dict[str, Typed] | None = None, aggs: dict[Agg, Typed] | None = None):
        self.scope, self.params, self.aliases, self.aggs = scope, params, aliases or {}, aggs or {}

    # -- values

    def value(self, e: Expr) -> Typed:
        if isinstance(e, Lit):
            return constant(e.value)
        if isinstance(e, Param):
            if e.name not in self.params:
                raise QueryError(f"parameter ${e.name} is not given")
            return constant(self.params[e.name])
        if isinstance(e, ListOf):
            parts = [self.value(x) for x in e.items]
            kind = common([t for _, t in parts])
            return F.array(*(c.cast(kind) for c, _ in parts)), T.ArrayType(kind)
        if isinstance(e, Agg):
            if e not in self.aggs:
                raise QueryError("an aggregate is not allowed here")
            return self.aggs[e]
        if isinstance(e, Var):
            return self.variable(e.name)
        if isinstance(e, Prop):
            return self.property(e)
        if isinstance(e, Neg):
            c, t = self.value(e.value)
            return (-c, t) if numeric(t) else (F.lit(None).cast("double"), T.DoubleType())
        if isinstance(e, Binary):
            return self.arithmetic(e)
        if isinstance(e, Call):
            return self.function(e)
        return self.condition(e, True), T.BooleanType()

    def bound(self, name: str) -> Bound:
        if name not in self.scope:
            raise QueryError(f"variable {name!r} is not defined")
        return self.scope[name]

    def variable(self, name: str) -> Typed:
        if name in self.aliases:
            return self.aliases[name]
        b = self.bound(name)
        if b.kind == "value":
            return col(b.cols["value"]), b.type
        if b.kind == "path":
            return col(b.cols["nodes"]), T.ArrayType(NODE_REF)
        return entity(b)

    def property(self, e: Prop) -> Typed:
        if e.var not in self.scope and e.var in self.aliases:
            raise QueryError(f"{e.var!r} has no properties")
        b = self.bound(e.var)
        if b.kind in ("node", "rel"):
            if e.name in b.props:
                name, t = b.props[e.name]
                return col(name), t
            return F.lit(None), T.NullType()
        if b.kind == "value" and isinstance(b.type, T.StructType) and e.name in b.type.fieldNames():
            return col(b.cols["value"])[e.name], b.type[e.name].dataType
        return F.lit(None), T.NullType()

    def arithmetic(self, e: Binary) -> Typed:
        (a, ta), (b, tb) = self.value(e.left), self.value(e.right)
        if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
            return F.lit(None).cast("double"), T.DoubleType()
        if numeric(ta) and numeric(tb):
            if e.op == "/":
                a, b = a.cast("double"), b.cast("double")
                zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
                return F.when(b == 0, zero).otherwise(F.try_divide(a, b)), T.DoubleType()
            t = T.DoubleType() if T.DoubleType() in (ta, tb) or not (integral(ta) and integral(tb)) else T.LongType()
            a, b = a.cast(t), b.cast(t)
            return {"+": a + b, "-": a - b, "*": a * b}[e.op], t
        if e.op == "+":
            return F.concat(a.cast("string"), b.cast("string")), T.StringType()
        return F.when(a.isNotNull() & b.isNotNull(), float("nan")), T.DoubleType()

    def function(self, e: Call) -> Typed:
        b = self.scope.get(e.arg.name) if isinstance(e.arg, Var) and e.arg.name not in self.aliases else None
        none = F.lit(None)
        if e.name == "id":
            return (col(b.cols["id"]), b.type or T.NullType()) if b and b.kind in ("node", "rel") else (none, T.NullType())
        if e.name == "labels":
            return (col(b.cols["labels"]), T.ArrayType(T.StringType())) if b and b.kind == "node" else (none, T.NullType())
        if e.name == "type":
            return (col(b.cols["type"]), T.StringType()) if b and b.kind == "rel" else (none, T.NullType())
        if e.name in ("nodes", "relationships"):
            return (col(b.cols["nodes" if e.name == "nodes" else "rels"]), T.ArrayType(NODE_REF if e.name == "nodes" else REL_REF)) if b and b.kind == "path" else (none, T.NullType())
        if b and b.kind == "path":
            return F.size(col(b.cols["rels"])).cast("long"), T.LongType()
        c, t = self.value(e.arg)
        if isinstance(t, T.ArrayType):
            return F.when(c.isNotNull(), F.size(c)).cast("long"), T.LongType()
        if isinstance(t, T.StringType):
            return F.length(c).cast("long"), T.LongType()
        return none.cast("long"), T.LongType()

    # -- conditions

    def condition(self, e: Expr, positive: bool = True) -> Column:
        if isinstance(e, Logic):
            if e.op == "NOT":
                return ~self.condition(e.args[0], not positive)
            parts = [self.condition(x, positive) for x in e.args]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if e.op == "AND" else out | p
            return out
        if not isinstance(e, Compare):
            raise QueryError("a condition is a comparison")
        if e.op in ("NULL", "NOT NULL"):
            key = self.presence(e.left)
            return key.isNull() if e.op == "NULL" else key.isNotNull()
        if e.op in ("=", "<>"):
            same = self.equal(e.left, e.right, positive and e.op == "=")
            return same if e.op == "=" else ~same
        if e.op == "IN":
            out = self.member(e.left, e.right)
        else:
            (a, ta), (b, tb) = self.value(e.left), self.value(e.right)
            if e.op in ("STARTS", "ENDS", "CONTAINS"):
                if not (isinstance(ta, T.StringType) and isinstance(tb, T.StringType)):
                    return F.lit(False)
                out = {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[e.op](a, b)
            elif not comparable(ta, tb):
                return F.lit(False)
            else:
                out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
        return out if positive else F.coalesce(out, F.lit(False))

    def presence(self, e: Expr) -> Column:
        if isinstance(e, Var) and e.name not in self.aliases and self.bound(e.name).kind in ("node", "rel"):
            b = self.bound(e.name)
            return col(b.cols["table"])
        return self.value(e)[0]

    def equal(self, left: Expr, right: Expr, plain: bool) -> Column:
        x, y = (self.scope.get(v.name) if isinstance(v, Var) and v.name not in self.aliases else None for v in (left, right))
        if x and y and x.kind == y.kind == "node":
            return same_node(x, y)
        (a, ta), (b, tb) = self.value(left), self.value(right)
        if not comparable(ta, tb):
            return a.isNull() & b.isNull()
        sides = (left, right)
        if plain and any(isinstance(s, Lit | Param) and (s.value if isinstance(s, Lit) else self.params[s.name]) is not None for s in sides):
            return a == b
        return a.eqNullSafe(b)

    def member(self, left: Expr, right: Expr) -> Column:
        a, ta = self.value(left)
        if isinstance(right, Param) and isinstance(self.params.get(right.name), list | tuple):
            right = ListOf(tuple(Lit(v) for v in self.params[right.name]))
        if isinstance(right, ListOf):
            same = [self.value(x) for x in right.items]
            values = [c for (c, t), x in zip(same, right.items, strict=True) if comparable(ta, t) and not (isinstance(x, Lit) and x.value is None)]
            out = a.isin(values) if values else F.lit(False)
            return a.isNull() | out if any(isinstance(x, Lit) and x.value is None for x in right.items) else out
        b, tb = self.value(right)
        if not isinstance(tb, T.ArrayType) or not comparable(ta, tb.elementType):
            return F.lit(False)
        return F.array_contains(b, a)


def entity(b: Bound) -> Typed:
    """A whole node or relationship as a struct; null if the variable is unbound."""
    props = [(p, *ct) for p, ct in sorted(b.props.items())]
    inner = F.struct(*(col(c).alias(p) for p, c, _ in props)) if props else F.lit(None).cast("struct<>")
    inner_t = T.StructType([T.StructField(p, t) for p, _, t in props])
    if b.kind == "node":
        fields = [("id", b.cols["id"], b.type), ("labels", b.cols["labels"], T.ArrayType(T.StringType()))]
    else:
        fields = [("id", b.cols["id"], b.type or T.LongType()), ("type", b.cols["type"], T.StringType()), ("startNode", b.cols["src"], b.ends or T.StringType()), ("endNode", b.cols["dst"], b.ends or T.StringType())]
    whole = F.struct(*(col(c).alias(n) for n, c, _ in fields), *([inner.alias("properties")] if props else []))
    t = T.StructType([*(T.StructField(n, x) for n, _, x in fields), *([T.StructField("properties", inner_t)] if props else [])])
    return F.when(col(b.cols["table"]).isNotNull(), whole), t


def same_node(x: Bound, y: Bound) -> Column:
    same = col(x.cols["id"]).eqNullSafe(col(y.cols["id"]))
    return same if x.tables == y.tables and len(x.tables) == 1 else same & col(x.cols["table"]).eqNullSafe(col(y.cols["table"]))


def constant(v: Any) -> Typed:
    if isinstance(v, list | tuple):
        parts = [constant(x) for x in v]
        kind = common([t for _, t in parts])
        return F.array(*(c.cast(kind) for c, _ in parts)), T.ArrayType(kind)
    if v is None:
        return F.lit(None), T.NullType()
    t = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(v)]
    return F.lit(v).cast(t) if isinstance(v, int) and not isinstance(v, bool) else F.lit(v), t


def common(types: list[T.DataType]) -> T.DataType:
    kinds = {t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return kinds.pop()
    if all(map(numeric, kinds)):
        return T.LongType() if all(map(integral, kinds)) else T.DoubleType()
    return T.StringType()


def numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def comparable(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return comparable(a.elementType, b.elementType)
    return numeric(a) and numeric(b) or type(a) is type(b) or {type(a), type(b)} == {T.TimestampType, T.StringType}


def aggregates(e: Any) -> list[Agg]:
    if isinstance(e, Agg):
        return [e]
    if isinstance(e, tuple | list):
        return [a for x in e for a in aggregates(x)]
    return [a for x in vars(e).values() for a in aggregates(x)] if isinstance(e, Expr) else []
