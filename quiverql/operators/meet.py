"""Chains that meet in a node of many neighbours on both sides, aggregated without making the pairs.

``(a)-->(n)<--(b)`` has a row for each pair of an ``a`` and a ``b`` of one ``n``, the product of
both sides. Where what follows aggregates and names nothing of one side, that side is folded: it
becomes counts by ``n``, and a row of the other side weighs as many matches as it meets.
A comparison between the sides (``a.x < b.y``) is met by counts by ``n`` and value, running in the
order of the values: work grows with the rows of both sides, not with their pairs.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Lowering, aggregates, col, common, integral
from ..plans.syntax import Agg, Compare, Expr, Logic, Match, Pattern, Projection, RelPat, Var, variables
from ..sources.graph import PropertyGraph
from .match import Frame, Matcher, edges, fresh, options, unit

_TURNED = {"out": "in", "in": "out", "both": "both"}
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def turned(r: RelPat) -> RelPat:
    return replace(r, direction=_TURNED[r.direction])


def conjuncts(e: Expr | None) -> list[Expr]:
    if isinstance(e, Logic) and e.op == "AND":
        return [x for a in e.args for x in conjuncts(a)]
    return [] if e is None else [e]


def counted(e: Any, names: set[str]) -> Any:
    """``count(x)`` of a pattern's own variable as ``count(*)``: in a match that is not optional it is never missing."""
    if isinstance(e, Agg):
        return replace(e, arg=None) if e.name == "count" and not e.distinct and isinstance(e.arg, Var) and e.arg.name in names else e
    if isinstance(e, tuple):
        return tuple(counted(x, names) for x in e)
    return replace(e, **{k: counted(v, names) for k, v in vars(e).items() if isinstance(v, Expr | tuple)}) if isinstance(e, Expr) else e


def alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of both types compare the same once cast to what they have in common."""
    plain = lambda t: integral(t) or isinstance(t, T.DoubleType)
    return a == b and isinstance(a, T.AtomicType) or plain(a) and plain(b)


class Meeting:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params = graph, params
        self.matcher = Matcher(graph, params)

    def fold(self, clause: Match, body: Projection) -> tuple[Frame, Projection] | None:
        """Rows of the side that stays, weighted, and the projection over them; None where the pairs have to be made or there are none."""
        p = clause.patterns[0]
        parts = [*p.nodes, *p.rels]
        names = {x.var for x in parts}
        if clause.optional or len(clause.patterns) > 1 or len(p.rels) < 2 or p.path or any(r.hops for r in p.rels) or len(names) < len(parts):
            return None
        if variables([e for x in parts for _, e in x.props]) or variables(clause.where) - names or body.star or not any(aggregates(it.expr) for it in body.items):
            return None
        items = [replace(it, expr=counted(it.expr, names)) for it in body.items]
        order = [(counted(e, names), down) for e, down in body.order]
        made = [*(it.expr for it in items), *(e for e, _ in order)]
        if any(not a.distinct and a.name == "collect" or a.distinct and a.arg is None for e in made for a in aggregates(e)):
            return None
        for k in range(1, len(p.rels)):
            if not (self._many(p, k, turned(p.rels[k - 1]), k - 1) and self._many(p, k, p.rels[k], k + 1)):
                continue
            before, after = (p.nodes[:k], p.rels[:k]), (p.nodes[k + 1 :], p.rels[k:])
            for left, (nodes, rels) in ((True, before), (False, after)):
                side = {x.var for x in (*nodes, *rels)}
                if not side & variables(made) and (frame := self._folded(p, k, left, side, clause.where)) is not None:
                    return frame, replace(body, items=items, order=order)
        return None

    def _fits(self, labels: tuple[str, ...]) -> set[str]:
        return {t.name for t in self.graph.nodes if t.can_have(labels)}

    def _many(self, p: Pattern, k: int, r: RelPat, other: int) -> bool:
        """Whether node ``k`` can have several neighbours over the hop: its own row does not hold their key."""
        here, there = self._fits(p.nodes[k].labels), self._fits(p.nodes[other].labels)
        return any(not w.near_carries for w in options(self.graph, r) if w.near in here and w.far in there)

    def _folded(self, p: Pattern, k: int, left: bool, side: set[str], where: Expr | None) -> Frame | None:
        mine, others, across = [], [], []
        for c in conjuncts(where):
            used = variables(c)
            (others if not used & side else mine if used <= side else across).append(c)
        if len(across) > 1 or any(not isinstance(c, Compare) or c.op not in _FLIPPED for c in across):
            return None
        kept = self.matcher.pattern(unit(self.graph), Pattern(p.nodes[k:], p.rels[k:]) if left else Pattern(p.nodes[: k + 1], p.rels[:k]))
        n = kept.scope[p.nodes[k].var]
        # the side to fold, and over its last hop the key of the node in the middle, whose table it leaves alone
        m, hop = (p.nodes[k - 1], p.rels[k - 1]) if left else (p.nodes[k + 1], turned(p.rels[k]))
        arm = Pattern(p.nodes[:k], p.rels[: k - 1]) if left else Pattern(p.nodes[k + 1 :], p.rels[k + 1 :])
        ways = [w for w in options(self.graph, hop) if w.far in n.tables and w.near in self._fits(m.labels)]
        frame = self.matcher.pattern(unit(self.graph), arm) if arm.rels else self.matcher.node(unit(self.graph), m, {w.near for w in ways})
        a = frame.scope[m.var]
        ways = [w for w in ways if w.near in a.tables]
        if not ways:
            return None
        one = ways[0] if len(ways) == 1 else None
        if one and one.near_carries and one.rel.name in a.hidden and not hop.named and not hop.props:
            key, table = col(a.hidden[one.rel.name]), F.lit(one.far)
        else:
            e, rel, ends = edges(self.graph, hop, ways)
            met = (col(a.cols["id"]) == col(ends["near"])) & (col(a.cols["table"]) == col(ends["near_table"]))
            frame = self.matcher.with_props(Frame(frame.df.join(e, met), frame.scope | {hop.var: rel}), hop)
            key, table = col(ends["far"]), col(ends["far_table"])
        kind = frame.df.select(key.alias("key")).schema["key"].dataType
        if not alike(kind, n.type):
            return None
        for c in mine:
            frame = frame.where(Lowering(frame.scope, self.params).condition(c))
        for c in others:
            kept = kept.where(Lowering(kept.scope, self.params).condition(c))
        kind = common([kind, n.type])
        by, weight = [fresh("meet.key"), fresh("meet.table")], fresh("weight")
        keys = [key.cast(kind).alias(by[0]), table.alias(by[1])]
        if not across:
            counts = frame.df.where(key.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias(weight))
            on = (col(n.cols["id"]).cast(kind) == col(by[0])) & (col(n.cols["table"]) == col(by[1]))
            return replace(kept, df=kept.df.join(counts, on).drop(*by), weight=weight)
        c = across[0]
        turn = not variables(c.left) <= side
        here, there, op = (c.right, c.left, _FLIPPED[c.op]) if turn else (c.left, c.right, c.op)
        if not variables(here) <= side or variables(there) & side:
            return None
        (x, tx), (y, ty) = Lowering(frame.scope, self.params).value(here), Lowering(kept.scope, self.params).value(there)
        if not alike(tx, ty):
            return None
        value = common([tx, ty])
        y = y.cast(value)
        if isinstance(value, T.FractionalType):
            y = F.when(y == 0, F.lit(0).cast(value)).otherwise(y)  # -0.0 sorts as 0.0, as the counts' keys are
        return self._running(kept, frame.df.where(key.isNotNull() & x.isNotNull()), [*keys, x.cast(value)], [col(n.cols["id"]).cast(kind), col(n.cols["table"]), y], by, op, weight)

    def _running(self, kept: Frame, folded: Any, keys: list[Column], again: list[Column], by: list[str], op: str, weight: str) -> Frame:
        """Each kept row with the number of folded rows of its key whose value is ``op`` its own."""
        at, rank = fresh("meet.value"), fresh("meet.rank")
        counts = folded.groupBy(*keys[:2], keys[2].alias(at)).agg(F.count(F.lit(1)).alias(weight))
        # of equal values, those that count come before the rows that ask
        asks = F.lit(1 if "=" in op else -1)
        rows = kept.df.select("*", *(c.alias(n) for c, n in zip(again, [*by, at], strict=True)), F.lit(0).cast("long").alias(weight), asks.alias(rank)).where(col(at).isNotNull())
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept.df.schema.fields]
        both = rows.unionByName(counts.select(*empty, *map(col, [*by, at, weight]), F.lit(0).alias(rank)))
        order = col(at).asc() if op[0] == "<" else col(at).desc()
        running = Window.partitionBy(*map(col, by)).orderBy(order, col(rank)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = both.withColumn(weight, F.sum(col(weight)).over(running)).where((col(rank) != 0) & (col(weight) > 0))
        return replace(kept, df=df.drop(*by, at, rank), weight=weight)
