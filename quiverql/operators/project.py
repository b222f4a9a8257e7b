"""RETURN, WITH and UNWIND: projection, aggregation, DISTINCT, ORDER BY, SKIP and LIMIT over whole frames."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import NODE_REF, REL_REF, Bound, Lowering, Typed, aggregates, col, common, entity, numeric
from ..plans.parser import QueryError
from ..plans.syntax import Agg, Expr, Item, Lit, Param, Projection, Prop, RelPat, Unwind, Var, variables
from ..sources.graph import PropertyGraph
from .match import Frame, edges, fresh, options, scan


def item_names(items: list[Item]) -> list[str]:
    """Alias, else the variable, else ``value`` (numbered if there are several items)."""
    out = []
    for k, it in enumerate(items):
        out.append(it.alias or (it.expr.name if isinstance(it.expr, Var) else "value" if len(items) == 1 else f"value{k}"))
    return out


def slice_of(df: DataFrame, body: Any, params: dict[str, Any]) -> DataFrame:
    for what, take in ((body.skip, df.offset), (body.limit, None)):
        if what is not None:
            n = what.value if isinstance(what, Lit) else params.get(what.name) if isinstance(what, Param) else None
            if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                raise QueryError("SKIP and LIMIT take a whole number")
            df = take(n) if take else df.limit(n)
    return df


def ordered(order: list[tuple[Column, bool]]) -> list[Column]:
    """Missing values come last either way."""
    return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in order]


def aggregate_column(a: Agg, low: Lowering, scope: dict[str, Bound], weight: str | None = None) -> Typed:
    """``weight``: a column with the number of matches that a row stands for, at least 1."""

    def count(c: Column) -> Column:
        return F.count(c) if weight is None else F.coalesce(F.sum(F.when(c.isNotNull(), col(weight))), F.lit(0).cast("long"))

    if a.arg is None:
        if a.name != "count":
            raise QueryError(f"{a.name}(*) is not defined")
        if not a.distinct:
            return count(F.lit(1)), T.LongType()
        keys = [col(c) for b in scope.values() for c in b.keys()]
        return F.count_distinct(F.struct(*keys)) if keys else F.count_distinct(F.lit(1)), T.LongType()
    b = scope.get(a.arg.name) if isinstance(a.arg, Var) and a.arg.name not in low.aliases else None
    if a.name == "count" and b and b.kind in ("node", "rel") and not (b.kind == "rel" and b.type is None and a.distinct):
        key = F.when(col(b.cols["table"]).isNotNull(), F.struct(*map(col, b.keys()))) if a.distinct else col(b.cols["table"])
        return (F.count_distinct(key) if a.distinct else count(key)), T.LongType()
    c, t = low.value(a.arg)
    if a.name == "count":
        return (F.count_distinct(c) if a.distinct else count(c)), T.LongType()
    if a.name == "collect":
        return (F.collect_set(c) if a.distinct else F.collect_list(c)), T.ArrayType(t)
    if a.name in ("min", "max"):
        return (F.min(c) if a.name == "min" else F.max(c)), t
    if not numeric(t):
        return (F.lit(0).cast("long") if a.name == "sum" else F.max(F.lit(None).cast("double"))), T.LongType() if a.name == "sum" else T.DoubleType()
    if a.name == "avg":
        if weight is not None and not a.distinct:
            return F.try_divide(F.sum(c.cast("double") * col(weight)), count(c)), T.DoubleType()
        return (F.try_divide(F.sum_distinct(c.cast("double")), F.count_distinct(c)) if a.distinct else F.avg(c)), T.DoubleType()
    whole = T.LongType() if isinstance(t, T.IntegralType) else T.DoubleType()
    c = c.cast(whole) if weight is None or a.distinct else c.cast(whole) * col(weight)
    return F.coalesce((F.sum_distinct if a.distinct else F.sum)(c), F.lit(0).cast(whole)), whole


class Projector:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params = graph, params

    def project(self, frame: Frame, body: Projection, keep: tuple[str, ...] = ()) -> tuple[Frame, list[str]]:
        """The frame after WITH or RETURN, and the names of its items. ``keep``: variables that stay in scope (and group) besides."""
        items = list(body.items)
        if body.star:
            taken = {it.expr.name for it in items if isinstance(it.expr, Var) and not it.alias}
            items = [Item(Var(v)) for v in sorted(frame.scope) if not v.startswith("_anon") and v not in taken] + items
            if not items:
                raise QueryError("* has nothing to name")
        names = item_names(items)
        items = [Item(it.expr, n) for it, n in zip(items, names, strict=True)] + [Item(Var(v), v) for v in keep if v not in names]
        aggs = list(dict.fromkeys(a for x in [*(it.expr for it in items), *(e for e, _ in body.order)] for a in aggregates(x)))
        grouped = any(aggregates(it.expr) for it in items)
        out, order = self._grouped(frame, items, aggs, body) if grouped else self._plain(frame, items, body)
        if body.distinct:
            keys = [c for it in items for c in out.scope[it.alias].keys()]
            extra = set(variables([e for e, _ in body.order])) - set(names)
            if extra and not grouped:
                raise QueryError(f"ORDER BY after DISTINCT can only use what is returned, not {sorted(extra)}")
            out = replace(out, df=out.df.dropDuplicates(keys))
        df = out.df.orderBy(*ordered(order)) if order else out.df
        out = replace(out, df=slice_of(df, body, self.params))
        if body.where is not None:
            out = out.where(Lowering(out.scope, self.params).condition(body.where))
        return out, names

    def _bind(self, e: Expr, name: str, low: Lowering, scope: dict[str, Bound]) -> tuple[Bound, list[Column]]:
        """What an item binds, and columns to add for it. Entities and paths keep their columns."""
        if isinstance(e, Var) and e.name not in low.aliases and e.name in scope and scope[e.name].kind != "value":
            return scope[e.name], []
        c, t = low.value(e)
        if isinstance(t, T.NullType):
            c = c.cast("string")
        made = fresh(name)
        return Bound("value", {"value": made}, type=t), [c.alias(made)]

    def _plain(self, frame: Frame, items: list[Item], body: Projection) -> tuple[Frame, list[tuple[Column, bool]]]:
        scope: dict[str, Bound] = {}
        df, aliases = frame.df, {}
        for it in items:
            low = Lowering(frame.scope, self.params, aliases)
            bound, new = self._bind(it.expr, it.alias, low, frame.scope)
            if new:
                df = df.select("*", *new)
                if it.alias not in frame.scope:  # later items see earlier aliases
                    aliases = aliases | {it.alias: (col(bound.cols["value"]), bound.type)}
            scope[it.alias] = bound
        after = {n: (col(b.cols["value"]), b.type) for n, b in scope.items() if b.kind == "value"}
        seen = frame.scope | {n: b for n, b in scope.items() if b.kind != "value"}
        low = Lowering(seen, self.params, after)
        order = [(self._sort_key(e, low), down) for e, down in body.order]
        return Frame(df, scope), order

    def _sort_key(self, e: Expr, low: Lowering) -> Column:
        if isinstance(e, Var) and e.name not in low.aliases and e.name in low.scope and low.scope[e.name].kind in ("node", "rel"):
            return col(low.scope[e.name].cols["id"])
        return low.value(e)[0]

    def _grouped(self, frame: Frame, items: list[Item], aggs: list[Agg], body: Projection) -> tuple[Frame, list[tuple[Column, bool]]]:
        low = Lowering(frame.scope, self.params)
        keys: list[Column] = []
        carried: list[Column] = []
        scope: dict[str, Bound] = {}
        group_values: dict[Expr, Typed] = {}
        df = frame.df
        for it in items:
            if aggregates(it.expr):
                continue
            bound, new = self._bind(it.expr, it.alias, low, frame.scope)
            if new:
                df = df.select("*", *new)
            ks = bound.keys()
            keys += [col(c) for c in ks]
            carried += [F.first(col(c)).alias(c) for c in bound.every_column() if c not in ks]
            scope[it.alias] = bound
            if bound.kind == "value":
                group_values[it.expr] = (col(bound.cols["value"]), bound.type)
        made, agg_cols = {}, []
        for a in aggs:
            c, t = aggregate_column(a, low, frame.scope, frame.weight)
            name = fresh("agg")
            agg_cols.append(c.alias(name))
            made[a] = (col(name), t)
        seen: dict[str, Column] = {}
        unique_keys = [k for k in keys if not (str(k) in seen or seen.update({str(k): k}))]
        unique_carried, had = [], set()
        for c in carried:
            if str(c) not in had:
                had.add(str(c))
                unique_carried.append(c)
        df = df.groupBy(*unique_keys).agg(*agg_cols, *unique_carried) if unique_keys else df.agg(*agg_cols)
        inner = _AfterGroup({n: b for n, b in scope.items()}, self.params, made, group_values)
        for it in items:
            if not aggregates(it.expr):
                continue
            c, t = inner.value(it.expr)
            name = fresh(it.alias)
            df = df.select("*", c.alias(name))
            scope[it.alias] = Bound("value", {"value": name}, type=t)
        final = _AfterGroup(scope, self.params, made, group_values)
        return Frame(df, scope), [(self._sort_key(e, final) if not isinstance(e, Var) or e.name in scope else final.value(e)[0], down) for e, down in body.order]

    def unwind(self, frame: Frame, clause: Unwind, at: str | None = None) -> Frame:
        """One row for each element, in order; nothing for what is not a list. Nodes of a path become nodes again. ``at``: a variable for the element's place."""
        c, t = Lowering(frame.scope, self.params).value(clause.expr)
        if not isinstance(t, T.ArrayType):
            return Frame(frame.df.select("*", F.lit(None).cast("string").alias(name := fresh(clause.var))).where(F.lit(False)), frame.scope | {clause.var: Bound("value", {"value": name}, type=T.StringType())})
        name = fresh(clause.var)
        if at is None:
            df = frame.df.select("*", F.explode(c).alias(name))
        else:
            place = fresh(at)
            df = frame.df.select("*", F.posexplode(c).alias(place, name))
            frame = replace(frame, scope=frame.scope | {at: Bound("value", {"value": place}, type=T.IntegerType())})
        if isinstance(t.elementType, T.StructType) and t.elementType.fieldNames() == ["table", "id"]:
            nodes, b = scan(self.graph, clause.var, ())
            df = df.join(nodes, (col(name)["table"] == col(b.cols["table"])) & (col(name)["id"] == col(b.cols["id"]).cast("string"))).drop(name)
            return Frame(df, frame.scope | {clause.var: b})
        return Frame(df, frame.scope | {clause.var: Bound("value", {"value": name}, type=t.elementType)})

    def result(self, frame: Frame, names: list[str]) -> DataFrame:
        low = Lowering(frame.scope, self.params)
        out = frame.df.select(*(low.variable(n)[0].alias(n) for n in names))
        for n in names:
            t = low.variable(n)[1]
            if isinstance(t, T.ArrayType) and t.elementType in (NODE_REF, REL_REF):
                out = self._whole(out, n, t.elementType == NODE_REF)
        return out

    def _whole(self, df: DataFrame, name: str, nodes: bool) -> DataFrame:
        """References of a path become nodes or relationships with their properties; rows keep their order."""
        row, place, ref = fresh("row"), fresh("place"), fresh("ref")
        df = df.withColumn(row, F.monotonically_increasing_id())
        flat = df.select("*", F.posexplode_outer(col(name)).alias(place, ref))
        if nodes:
            found, b = scan(self.graph, name, ())
            flat = flat.join(found, (col(ref)["table"] == col(b.cols["table"])) & (col(ref)["id"] == col(b.cols["id"]).cast("string")), "left")
            whole = entity(b)[0]
        else:  # relationships without ids have no more than their type and ends
            pat = RelPat(fresh(name))
            with_ids = [w for w in options(self.graph, pat) if w.forward and w.rel.id]
            key = common([w.rel.df.schema[k].dataType for w in options(self.graph, pat) for k in (w.rel.src, w.rel.dst)])
            plain = [F.lit(None).cast("long").alias("id"), col(ref)["type"].alias("type"), col(ref)["src"].cast(key).alias("startNode"), col(ref)["dst"].cast(key).alias("endNode")]
            if with_ids:
                found, b, _ = edges(self.graph, pat, with_ids)
                flat = flat.join(found, (col(ref)["rel_table"] == col(b.cols["table"])) & (col(ref)["rel_id"] == col(b.cols["id"]).cast("string")), "left")
                made, t = entity(b)
                whole = F.coalesce(made, F.struct(*plain, *([F.lit(None).cast(t["properties"].dataType).alias("properties")] if "properties" in t.fieldNames() else [])).cast(t))
            else:
                whole = F.struct(*plain)
        item = F.struct(col(place).alias("place"), whole.alias("x"))
        others = [F.first(col(c)).alias(c) for c in df.columns if c not in (row, name)]
        lists = F.transform(F.array_sort(F.collect_list(F.when(col(place).isNotNull(), item)), lambda a, b: a["place"] - b["place"]), lambda i: i["x"])
        kept = F.when(F.first(col(name)).isNotNull(), lists).alias(name)
        back = flat.groupBy(col(row)).agg(*others, kept).orderBy(col(row))
        return back.select(*(col(c) for c in df.columns if c != row))


class _AfterGroup(Lowering):
    """Expressions over a grouped frame: aggregates and group keys are columns, nothing else is in scope."""

    def __init__(self, scope: dict[str, Bound], params: dict[str, Any], aggs: dict[Agg, Typed], keys: dict[Expr, Typed]):
        super().__init__(scope, params, None, aggs)
        self.keys = keys

    def value(self, e: Expr) -> Typed:
        if e in self.keys:
            return self.keys[e]
        if isinstance(e, Prop) and e.var not in self.scope:
            raise QueryError(f"{e.var}.{e.name} is neither grouped nor aggregated")
        return super().value(e)
