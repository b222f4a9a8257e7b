"""MATCH: scans, hops, variable-length paths, cross products and their optional forms."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import NODE_REF, REL_REF, Bound, Lowering, Scope, col, common, same_node
from ..plans.parser import QueryError
from ..plans.syntax import Match, NodePat, Pattern, RelPat, variables
from ..sources.graph import NodeTable, PropertyGraph, RelTable

_fresh = count()
#: Hops after which the frontier of a long path is written to the shared folder.
CUT = 4


def fresh(name: str) -> str:
    return f"{name}.{next(_fresh)}"


@dataclass(frozen=True)
class Frame:
    """Rows of bindings. ``unit``: one row and nothing bound. ``weight``: a column with the number of matches that a row stands for."""

    df: DataFrame
    scope: Scope
    unit: bool = False
    weight: str | None = None

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition), unit=False)


def unit(graph: PropertyGraph) -> Frame:
    return Frame(graph.spark.range(1).select(F.lit(True).alias("unit")), {}, True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _id_type(tables: list[NodeTable]) -> T.DataType:
    return common([t.df.schema[t.id].dataType for t in tables])


def carried(graph: PropertyGraph, table: str) -> dict[str, str]:
    """Keys of other nodes in a node table's rows: relationship table to column."""
    out = {}
    for r in graph.rels:
        if r.carrier == "src" and r.src_table == table:
            out[r.name] = r.dst
        if r.carrier == "dst" and r.dst_table == table:
            out[r.name] = r.src
    return out


def scan(graph: PropertyGraph, var: str, labels: tuple[str, ...], only: set[str] | None = None) -> tuple[DataFrame, Bound]:
    """All nodes with the labels, from the tables that can hold them (of ``only`` some)."""
    tables = [t for t in graph.nodes if t.can_have(labels) and (only is None or t.name in only)]
    if not tables:
        tables, none = list(graph.nodes), True
    else:
        none = False
    kind = _id_type(tables)
    props: dict[str, T.DataType] = {}
    for t in tables:
        for p, c in t.properties.items():
            props[p] = common([props.get(p, T.NullType()), t.df.schema[c].dataType])
    hidden = {r: t.df.schema[c].dataType for t in tables for r, c in carried(graph, t.name).items()}
    names = {role: fresh(f"{var}.{role}") for role in ("id", "table", "labels")}
    prop_names = {p: fresh(f"{var}.{p}") for p in props}
    hidden_names = {r: fresh(f"{var}.{r}") for r in hidden}
    parts = []
    for t in tables:
        df = t.df
        if none:
            df = df.where(F.lit(False))
        elif t.label_column is not None:
            for label in labels:
                df = df.where(F.array_contains(t.label_array(), label))
        keys = carried(graph, t.name)
        parts.append(
            df.select(
                df[t.id].cast(kind).alias(names["id"]), F.lit(t.name).alias(names["table"]), t.label_array().alias(names["labels"]),
                *((df[t.properties[p]].cast(x) if p in t.properties else F.lit(None).cast(x)).alias(prop_names[p]) for p, x in props.items()),
                *((df[keys[r]] if r in keys else F.lit(None).cast(x)).alias(hidden_names[r]) for r, x in hidden.items()),
            )
        )
    bound = Bound("node", names, {p: (prop_names[p], t) for p, t in props.items()}, tuple(t.name for t in tables), kind, hidden_names)
    return union_all(parts), bound


@dataclass(frozen=True)
class Option:
    """One way over a hop: a relationship table in one of its directions."""

    rel: RelTable
    forward: bool
    both: bool

    @property
    def near(self) -> str:
        return self.rel.src_table if self.forward else self.rel.dst_table

    @property
    def far(self) -> str:
        return self.rel.dst_table if self.forward else self.rel.src_table

    @property
    def near_key(self) -> str:
        return self.rel.src if self.forward else self.rel.dst

    @property
    def far_key(self) -> str:
        return self.rel.dst if self.forward else self.rel.src

    @property
    def far_carries(self) -> bool:
        return self.rel.carrier == ("dst" if self.forward else "src")

    @property
    def near_carries(self) -> bool:
        return self.rel.carrier == ("src" if self.forward else "dst")


def options(graph: PropertyGraph, pat: RelPat) -> list[Option]:
    rels = [r for r in graph.rels if pat.type is None or r.type_column is not None or r.type == pat.type]
    ways = {"out": (True,), "in": (False,), "both": (True, False)}[pat.direction]
    return [Option(r, w, pat.direction == "both" and not w) for r in rels for w in ways]


def edges(graph: PropertyGraph, pat: RelPat, ways: list[Option]) -> tuple[DataFrame, Bound, dict[str, str]]:
    """Relationship rows of several ways with the same columns; the last dict names near and far key columns."""
    props: dict[str, T.DataType] = {}
    for w in ways:
        for p, c in w.rel.properties.items():
            props[p] = common([props.get(p, T.NullType()), w.rel.df.schema[c].dataType])
    has_id = all(w.rel.id for w in ways)
    id_type = common([w.rel.df.schema[w.rel.id].dataType for w in ways]) if has_id else None
    names = {role: fresh(f"{pat.var}.{role}") for role in ("id", "table", "type", "src", "dst")}
    ends = {role: fresh(f"{pat.var}.{role}") for role in ("near", "near_table", "far", "far_table")}
    key = common([w.rel.df.schema[k].dataType for w in ways for k in (w.rel.src, w.rel.dst)])
    prop_names = {p: fresh(f"{pat.var}.{p}") for p in props}
    parts = []
    for w in ways:
        r, df = w.rel, w.rel.df
        if pat.type is not None and r.type_column is not None:
            df = df.where(df[r.type_column] == pat.type)
        if w.both and r.src_table == r.dst_table:
            df = df.where(df[r.src] != df[r.dst])  # a loop counts once
        if r.carrier:
            df = df.where(df[w.near_key].isNotNull() & df[w.far_key].isNotNull())
        parts.append(
            df.select(
                (df[r.id].cast(id_type) if has_id else F.lit(None).cast("long")).alias(names["id"]), F.lit(r.name).alias(names["table"]),
                (df[r.type_column] if r.type_column else F.lit(r.type)).alias(names["type"]), df[r.src].cast(key).alias(names["src"]), df[r.dst].cast(key).alias(names["dst"]),
                df[w.near_key].cast(key).alias(ends["near"]), F.lit(w.near).alias(ends["near_table"]), df[w.far_key].cast(key).alias(ends["far"]), F.lit(w.far).alias(ends["far_table"]),
                *((df[r.properties[p]].cast(x) if p in r.properties else F.lit(None).cast(x)).alias(prop_names[p]) for p, x in props.items()),
            )
        )
    return union_all(parts), Bound("rel", names, {p: (prop_names[p], t) for p, t in props.items()}, tuple({w.rel.name for w in ways}), id_type, ends=key), ends


class Matcher:
    """Adds the patterns of one MATCH to a frame."""

    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params = graph, params

    def match(self, frame: Frame, clause: Match) -> Frame:
        if not clause.optional:
            for p in clause.patterns:
                frame = self.pattern(frame, p)
            return self.filtered(frame, clause)
        if len(clause.patterns) > 1 and not any(p.rels for p in clause.patterns):
            for p in clause.patterns:  # each node pattern is optional by itself, the condition comes after
                frame = self.optional(frame, Match([p]))
            return self.filtered(frame, clause)
        return self.optional(frame, clause)

    def filtered(self, frame: Frame, clause: Match) -> Frame:
        return frame if clause.where is None else frame.where(Lowering(frame.scope, self.params).condition(clause.where))

    def optional(self, frame: Frame, clause: Match) -> Frame:
        """Left join of the whole clause; its condition is part of the join."""
        if (joined := self._optional_chain(frame, clause)) is not None:
            return joined
        used = {v: b for v, b in frame.scope.items() if v in variables([clause.patterns, clause.where])}
        if not used:
            found = self.filtered(self._all(unit(self.graph), clause), clause)
            return Frame(frame.df.join(found.df.drop("unit"), F.lit(True), "left"), frame.scope | found.scope)
        keys = list(dict.fromkeys(c for b in used.values() for c in b.keys()))
        left = frame.df.select(*map(col, dict.fromkeys(c for b in used.values() for c in b.every_column()))).dropDuplicates(keys)
        found = self.filtered(self._all(Frame(left, used), clause), clause)
        new = {v: b for v, b in found.scope.items() if v not in used}
        again = {k: fresh("key") for k in keys}
        added = [c for c in dict.fromkeys(c for b in new.values() for c in b.every_column()) if c not in frame.df.columns]
        right = found.df.select(*(col(k).alias(a) for k, a in again.items()), *map(col, added))
        on = reduce(lambda a, b: a & b, (col(k).eqNullSafe(col(a)) for k, a in again.items()))
        return Frame(frame.df.join(right, on, "left").drop(*again.values()), frame.scope | new)

    def _optional_chain(self, frame: Frame, clause: Match) -> Frame | None:
        """A chain that starts or ends at a bound node and binds nothing else: one left join with what follows that node. None where it is not of that form."""
        p = clause.patterns[0]
        if len(clause.patterns) > 1 or not p.rels or p.path or any(r.hops for r in p.rels):
            return None
        if p.nodes[0].var not in frame.scope:
            turned = {"out": "in", "in": "out", "both": "both"}
            p = Pattern(p.nodes[::-1], tuple(replace(r, direction=turned[r.direction]) for r in p.rels[::-1]))
        start, rest = p.nodes[0], [*p.nodes[1:], *p.rels]
        names = [x.var for x in rest]
        a = frame.scope.get(start.var)
        if a is None or a.kind != "node" or not start.bare or len(set(names)) < len(names) or set(names) & set(frame.scope) or variables([x.props for x in rest]) & set(frame.scope):
            return None
        r, n = p.rels[0], p.nodes[1]
        fits = {t.name for t in self.graph.nodes if t.can_have(n.labels)}
        ways = [w for w in options(self.graph, r) if w.near in a.tables and w.far in fits]
        if not ways:
            return None
        one = ways[0] if len(ways) == 1 else None
        here, near_table = a.cols["id"], None
        if one and not r.named and not r.props and (one.near_carries and one.rel.name in a.hidden or one.far_carries):
            df, b = scan(self.graph, n.var, n.labels, {one.far})
            here, near = (a.hidden[one.rel.name], b.cols["id"]) if one.near_carries else (here, b.hidden[one.rel.name])
            right = self.with_props(Frame(df, {n.var: b}), n)
        else:
            e, rel, ends = edges(self.graph, r, ways)
            nodes, b = scan(self.graph, n.var, n.labels, {w.far for w in ways})
            df = e.join(nodes, (col(ends["far"]) == col(b.cols["id"])) & (col(ends["far_table"]) == col(b.cols["table"])))
            near, near_table = ends["near"], ends["near_table"]
            right = self.with_props(self.with_props(Frame(df, {r.var: rel, n.var: b}), r), n)
        for k in range(1, len(p.rels)):
            right = self.hop(right, p.nodes[k].var, p.rels[k], p.nodes[k + 1])
        on = col(here) == col(near)
        if near_table is not None and (len(a.tables) > 1 or one is None):
            on = on & (col(a.cols["table"]) == col(near_table))
        elif len(a.tables) > 1:
            on = on & (col(a.cols["table"]) == one.near)
        scope = frame.scope | right.scope
        if clause.where is not None:
            on = on & Lowering(scope, self.params).condition(clause.where)
        return Frame(frame.df.join(right.df, on, "left"), scope)

    def _all(self, frame: Frame, clause: Match) -> Frame:
        for p in clause.patterns:
            frame = self.pattern(frame, p)
        return frame

    # -- patterns

    def pattern(self, frame: Frame, p: Pattern) -> Frame:
        if any(r.hops for r in p.rels) and len(p.rels) > 1:
            for k, r in enumerate(p.rels):  # a chain with paths inside is taken hop by hop
                frame = self.pattern(frame, Pattern((p.nodes[k] if k == 0 else replace(p.nodes[k], labels=(), props=()), p.nodes[k + 1]), (r,), p.path if r.hops else None))
            return frame
        if p.rels and p.rels[0].hops:
            return self.paths(frame, p)
        at = next((k for k, n in enumerate(p.nodes) if n.var in frame.scope), 0)
        if not p.nodes[at].labels and p.nodes[at].var not in frame.scope and p.rels:
            at = next((k for k, n in enumerate(p.nodes) if n.props or n.labels), 0)
        frame = self.node(frame, p.nodes[at], self._possible(p, at))
        for k in range(at, len(p.rels)):
            frame = self.hop(frame, p.nodes[k].var, p.rels[k], p.nodes[k + 1])
        turned = {"out": "in", "in": "out", "both": "both"}
        for k in range(at - 1, -1, -1):
            frame = self.hop(frame, p.nodes[k + 1].var, replace(p.rels[k], direction=turned[p.rels[k].direction]), p.nodes[k])
        return self.name_path(frame, p) if p.path else frame

    def _possible(self, p: Pattern, at: int) -> set[str] | None:
        """Tables that a node of a chain can come from, by the schema of its first hop."""
        if not p.rels:
            return None
        k = min(at, len(p.rels) - 1)
        ways = options(self.graph, p.rels[k])
        other = p.nodes[k + 1] if at == k else p.nodes[k]
        fits = {t.name for t in self.graph.nodes if t.can_have(other.labels)}
        return {w.near for w in ways if w.far in fits} if at == k else {w.far for w in ways if w.near in fits}

    def node(self, frame: Frame, n: NodePat, only: set[str] | None = None) -> Frame:
        if n.var in frame.scope:
            b = frame.scope[n.var]
            if b.kind != "node":
                raise QueryError(f"{n.var!r} is not a node")
            for label in n.labels:
                frame = frame.where(F.array_contains(col(b.cols["labels"]), label))
            return self.with_props(frame, n)
        df, b = scan(self.graph, n.var, n.labels, only)
        joined = df if frame.unit else frame.df.crossJoin(df)  # a property that names an earlier variable makes it an equi-join
        return self.with_props(Frame(joined, frame.scope | {n.var: b}), n)

    def with_props(self, frame: Frame, pat: NodePat | RelPat) -> Frame:
        from ..plans.syntax import Compare, Prop

        low = Lowering(frame.scope, self.params)
        for key, e in pat.props:
            frame = frame.where(low.condition(Compare("=", Prop(pat.var, key), e)))
        return frame

    def hop(self, frame: Frame, start: str, r: RelPat, n: NodePat) -> Frame:
        a = frame.scope[start]
        known = frame.scope.get(n.var)
        fits = set(known.tables) if known else {t.name for t in self.graph.nodes if t.can_have(n.labels)}
        ways = [w for w in options(self.graph, r) if w.near in a.tables and w.far in fits]
        if not ways:  # nothing fits: no rows, but the variables exist
            ways = options(self.graph, r)[:1] or options(self.graph, RelPat(r.var, None, direction=r.direction))[:1]
            if not ways:
                raise QueryError("the graph has no relationships")
            return self._take(frame.where(F.lit(False)), a, r, n, ways, known)
        return self._take(frame, a, r, n, ways, known)

    def _take(self, frame: Frame, a: Bound, r: RelPat, n: NodePat, ways: list[Option], known: Bound | None) -> Frame:
        one = ways[0] if len(ways) == 1 else None
        several = len(a.tables) > 1 or one is None
        if one and not known and not r.named and not r.props and (one.near_carries and one.rel.name in a.hidden or one.far_carries):
            df, b = scan(self.graph, n.var, n.labels, {one.far})
            if one.near_carries:  # the row at hand holds the next node's key
                on = col(a.hidden[one.rel.name]) == col(b.cols["id"])
            else:  # the next node's row holds the key at hand
                on = col(a.cols["id"]) == col(b.hidden[one.rel.name])
            if several:
                on = on & (col(a.cols["table"]) == one.near)
            out = Frame(frame.df.join(df, on), frame.scope | {n.var: b, r.var: self._stub(frame, a, b, one)})
            return self.with_props(out, n)
        e, rel, ends = edges(self.graph, r, ways)
        on = col(a.cols["id"]) == col(ends["near"])
        if several:
            on = on & (col(a.cols["table"]) == col(ends["near_table"]))
        df = frame.df.join(e, on)
        scope = frame.scope | {r.var: rel}
        if known:
            meet = col(known.cols["id"]) == col(ends["far"])
            df = df.where(meet & (col(known.cols["table"]) == col(ends["far_table"])) if len(known.tables) > 1 or one is None else meet)
        else:
            nodes, b = scan(self.graph, n.var, n.labels, {w.far for w in ways})
            meet = col(ends["far"]) == col(b.cols["id"])
            if len(b.tables) > 1 or one is None:
                meet = meet & (col(ends["far_table"]) == col(b.cols["table"]))
            df = df.join(nodes, meet)
            scope = scope | {n.var: b}
        out = self.with_props(Frame(df.drop(*ends.values()), scope), r)
        if known:
            return self.node(out, n)
        return self.with_props(out, n)

    def _stub(self, frame: Frame, a: Bound, b: Bound, way: Option) -> Bound:
        """An unnamed relationship that is part of a node row: only paths look at it."""
        ends = (a, b) if way.forward else (b, a)
        return Bound("rel", {"src": ends[0].cols["id"], "dst": ends[1].cols["id"], "table": a.cols["table"]}, {}, (way.rel.name,))

    def name_path(self, frame: Frame, p: Pattern) -> Frame:
        nodes, rels = fresh(p.path), fresh(p.path)
        node = lambda b: F.struct(col(b.cols["table"]).alias("table"), col(b.cols["id"]).cast("string").alias("id"))
        steps = [self._rel_ref(frame.scope[x.var]) for x in p.rels]
        df = frame.df.select("*", F.array(*(node(frame.scope[x.var]) for x in p.nodes)).alias(nodes), (F.array(*steps) if steps else F.array().cast(T.ArrayType(REL_REF))).alias(rels))
        return Frame(df, frame.scope | {p.path: Bound("path", {"nodes": nodes, "rels": rels})})

    def _rel_ref(self, b: Bound) -> Column:
        if "type" in b.cols:
            parts = [col(b.cols[k]) for k in ("table", "id", "type", "src", "dst")]
        else:  # a carried hop: its table is known, and has no id
            rel = next(r for r in self.graph.rels if r.name == b.tables[0])
            parts = [F.lit(rel.name), F.lit(None), F.lit(rel.type), col(b.cols["src"]), col(b.cols["dst"])]
        return F.struct(*(c.cast("string").alias(f.name) for c, f in zip(parts, REL_REF.fields, strict=True)))

    # -- variable length

    def paths(self, frame: Frame, p: Pattern) -> Frame:
        """Paths that visit no node twice: one join with the edges for each hop, the union of the levels asked for, and a join with the ends."""
        from ..sources.shared import checkpointed

        start, r, end = p.nodes[0], p.rels[0], p.nodes[1]
        least, most = r.hops
        frame = self.node(frame, start, None)
        a = frame.scope[start.var]
        known = frame.scope.get(end.var)
        ways = options(self.graph, r)
        at, at_table, nodes, rels = (fresh("path") for _ in range(4))
        key = common([t for t in [a.type, *(w.rel.df.schema[k].dataType for w in ways for k in (w.rel.src, w.rel.dst))] if t is not None])
        long = most is None or most > CUT
        ref = lambda t, i: F.struct(t.alias("table"), i.cast("string").alias("id"))
        front = frame.df.select(
            "*", col(a.cols["id"]).cast(key).alias(at), col(a.cols["table"]).alias(at_table), F.array(ref(col(a.cols["table"]), col(a.cols["id"]))).alias(nodes), F.array().cast(T.ArrayType(REL_REF)).alias(rels)
        )
        levels = [front] if least == 0 else []
        if ways:
            reachable = set(a.tables)
            goal = set(known.tables) if known else {t.name for t in self.graph.nodes if t.can_have(end.labels)}
            hop = 0
            while most is None or hop < most:
                here = [w for w in ways if w.near in reachable]
                if not here:
                    break
                e, rel, ends = edges(self.graph, RelPat(fresh("e"), r.type, (), r.direction), here)
                step = front.join(e, (col(at) == col(ends["near"]).cast(key)) & (col(at_table) == col(ends["near_table"])))
                far = ref(col(ends["far_table"]), col(ends["far"]))
                step = step.where(~F.array_contains(col(nodes), far))
                step = step.select(
                    *(col(c) for c in frame.df.columns), col(ends["far"]).cast(key).alias(at), col(ends["far_table"]).alias(at_table),
                    F.array_append(col(nodes), far).alias(nodes), F.array_append(col(rels), self._rel_ref(rel)).alias(rels),
                )
                reachable = {w.far for w in here}
                hop += 1
                if long and hop % CUT == 0:  # no plan grows without end, and levels that follow do not repeat those before
                    step = checkpointed(step)
                    if step.isEmpty():
                        break
                front = step
                if hop >= least and reachable & goal:
                    levels.append(front)
        if not levels:
            levels = [front.where(F.lit(False))]
        df = union_all(levels)
        scope = frame.scope | {p.path: Bound("path", {"nodes": nodes, "rels": rels})} if p.path else frame.scope
        if known or end.var == start.var:
            b = scope[end.var]
            df = df.where((col(at) == col(b.cols["id"]).cast(key)) & (col(at_table) == col(b.cols["table"])))
        else:
            ends_df, b = scan(self.graph, end.var, end.labels)
            df = df.join(ends_df, (col(at) == col(b.cols["id"]).cast(key)) & (col(at_table) == col(b.cols["table"])))
            scope = scope | {end.var: b}
        return self.node(Frame(df.drop(at, at_table), scope), end)


__all__ = ["Frame", "Matcher", "scan", "unit", "union_all", "same_node", "fresh"]
