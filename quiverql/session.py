"""The engine's entry point: query text in, DataFrame out."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.match import Frame, Matcher, scan, unit
from .operators.meet import Meeting
from .operators.project import Projector, ordered, slice_of
from .operators.write import PLACE, Kinds, Writer, bind_keys, keys_of
from .functions.expressions import Bound, Lowering, aggregates, col
from .plans.parser import QueryError, parse
from .plans.syntax import WRITES, CallSub, Create, Delete, Foreach, Match, Merge, NodePat, Return, SetProps, Statement, Union, Unwind, With, variables
from .sources.graph import Index, PropertyGraph
from .sources.shared import checkpointed


class GraphSession:
    """Runs queries and scripts over one graph; writes replace ``graph`` by a new version once their statement has succeeded."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def run(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of the last statement, lazily for reads; statements are separated by ``;`` or white space and share variables."""
        statements = parse(text)
        if not statements:
            raise QueryError("the query is empty")
        return self._script(statements, params or {}, None)[0]

    def explain(self, text: str, params: dict[str, Any] | None = None) -> str:
        """The formatted physical plan of a query that only reads."""
        df = self.run(text, params)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def list_indexes(self) -> tuple[Index, ...]:
        """The indexes that the graph's source describes."""
        return self.graph.indexes

    # -- statements

    def _script(self, statements: list[Statement | Union], params: dict[str, Any], outer: Frame | None) -> tuple[DataFrame, Frame | None, list[str]]:
        carry: tuple[DataFrame, Kinds] | None = None
        out: tuple[DataFrame, Frame | None, list[str]] = (self.graph.spark.range(0).select(), None, [])
        for k, s in enumerate(statements):
            last = k == len(statements) - 1
            if isinstance(s, Union):
                out = (self._union(s, params), None, [])
                continue
            before = self.graph
            try:
                out, left = self._statement(s, params, outer if last and outer is not None else self._start(s, carry), last, outer)
            except Exception:
                self.graph = before  # a statement takes effect as a whole or not at all
                raise
            if not last and left is not None:
                carry = self._carried(left, carry)
        return out

    def _start(self, s: Statement, carry: tuple[DataFrame, Kinds] | None) -> Frame:
        """What earlier statements bound, as far as this one refers to it by a bare name."""
        if carry is None:
            return unit(self.graph)
        keys, kinds = carry
        defined = set()
        for c in s.clauses:
            for p in c.patterns if isinstance(c, Match) else [c.pattern] if isinstance(c, Create | Merge) else []:
                defined |= {n.var for n in p.nodes if not n.bare or isinstance(c, Create) and not p.rels} | {r.var for r in p.rels} | ({p.path} if p.path else set())
            if isinstance(c, Unwind | Foreach):
                defined.add(c.var)
        used = [v for v in kinds if v in variables(s.clauses) - defined]
        return bind_keys(self.graph, keys.select(*(col(v) for v in used)), {v: kinds[v] for v in used}) if used else unit(self.graph)

    def _carried(self, frame: Frame, carry: tuple[DataFrame, Kinds] | None) -> tuple[DataFrame, Kinds] | None:
        """One row of bindings for the statements that follow: the last by its keys."""
        keys, kinds = keys_of(frame)
        if not kinds:
            return carry
        plain = [col(v).desc_nulls_last() for v, (_, t) in kinds.items() if not isinstance(t, T.MapType)]
        rows = keys.orderBy(*plain).limit(1).collect()
        if not rows:
            return carry
        values = {v: rows[0][v] for v in kinds}
        if carry is not None:
            old = carry[0].first()
            for v, k in carry[1].items():
                if v not in values:
                    values[v], kinds[v] = old[v], k
        schema = T.StructType([T.StructField(v, T.StringType() if isinstance(t, T.NullType) else t) for v, (_, t) in kinds.items()])
        return self.graph.spark.createDataFrame([tuple(values[v] for v in kinds)], schema), kinds

    def _statement(self, s: Statement, params: dict[str, Any], frame: Frame, last: bool, outer: Frame | None) -> tuple[tuple[DataFrame, Frame | None, list[str]], Frame | None]:
        keep = tuple(outer.scope) if outer is not None else ()
        clauses = list(s.clauses)
        for k, c in enumerate(clauses):
            if isinstance(c, Match):
                after = clauses[k + 1] if k + 1 < len(clauses) else None
                if frame.unit and not keep and (isinstance(after, With) or isinstance(after, Return) and last) and (folded := Meeting(self.graph, params).fold(c, after.body)):
                    frame, clauses[k + 1] = folded[0], replace(after, body=folded[1])
                    continue
                frame = Matcher(self.graph, params).match(frame, c)
            elif isinstance(c, With):
                frame, _ = Projector(self.graph, params).project(frame, c.body, keep)
            elif isinstance(c, Unwind):
                frame = Projector(self.graph, params).unwind(frame, c)
            elif isinstance(c, CallSub):
                frame = self._call(frame, c, params)
            elif isinstance(c, Return):
                done, names = Projector(self.graph, params).project(frame, c.body, keep)
                left = Frame(frame.df, frame.scope) if not last else None
                return (Projector(self.graph, params).result(done, names), done, names), left
            elif isinstance(c, WRITES):
                frame = self._write(frame, c, params)
        return (self.graph.spark.range(0).select(), frame, []), frame

    def _write(self, frame: Frame, c: Any, params: dict[str, Any]) -> Frame:
        w = Writer(self.graph, params)
        if isinstance(c, Foreach):
            keys, kinds = keys_of(frame)
            keys = checkpointed(keys)  # what the body changes does not change the rows it runs for
            if kinds:
                frame = bind_keys(self.graph, keys, kinds)
            # the body runs once, over a row for each outer row and element
            self._statement(c.body, params, Projector(self.graph, params).unwind(frame, Unwind(c.list, c.var), PLACE), True, None)
            return bind_keys(self.graph, keys, kinds) if kinds else frame
        out = {Create: w.create, Merge: w.merge, SetProps: w.set, Delete: w.delete}[type(c)](frame, c)
        self.graph = w.graph
        return out

    def _call(self, frame: Frame, c: CallSub, params: dict[str, Any]) -> Frame:
        """The subquery sees what is bound outside; its rows carry on, with the outer bindings beside them."""
        outer = None if frame.unit else frame
        if outer is not None and self._counts(c.statements):
            return self._call_aggregate(outer, c.statements[0], params)
        df, done, names = self._script(c.statements, params, outer)
        if done is not None and names:
            return Frame(done.df, {**(outer.scope if outer else {}), **{n: done.scope[n] for n in names}})
        if outer is not None and df.columns:
            raise QueryError("a UNION in a subquery cannot refer to variables outside")
        scope = {}
        for n in df.columns:
            scope[n] = Bound("value", {"value": n}, type=df.schema[n].dataType)
        return Frame(df, scope) if scope else frame

    def _counts(self, statements: list[Statement | Union]) -> bool:
        """Whether a subquery only reads and returns aggregates over all its rows, so that no rows give a row too."""
        s = statements[0]
        last = s.clauses[-1] if len(statements) == 1 and isinstance(s, Statement) else None
        return isinstance(last, Return) and not last.body.star and all(aggregates(it.expr) for it in last.body.items) and not any(isinstance(x, WRITES) for x in s.clauses)

    def _call_aggregate(self, outer: Frame, s: Statement, params: dict[str, Any]) -> Frame:
        """Aggregates for each distinct outer row, joined to all outer rows; where a row has none, those over nothing."""
        every = list(dict.fromkeys(c for b in outer.scope.values() for c in b.every_column()))
        keys = list(dict.fromkeys(c for b in outer.scope.values() for c in b.keys()))
        inner = Frame(outer.df.select(*map(col, every)).dropDuplicates(keys), outer.scope)
        _, done, names = self._statement(s, params, inner, True, outer)[0]
        _, empty, _ = self._statement(s, params, inner.where(F.lit(False)), True, None)[0]
        # values have new names in the subquery's result
        again = {k: (mine, f"{k}.outer") for v, b in outer.scope.items() for k, mine in zip(b.keys(), done.scope[v].keys(), strict=True)}
        met = "met.outer"
        right = done.df.select(*(col(mine).alias(a) for mine, a in again.values()), *(col(done.scope[n].cols["value"]) for n in names), F.lit(True).alias(met))
        on = reduce(lambda a, b: a & b, (col(k).eqNullSafe(col(a)) for k, (_, a) in again.items()))
        nothing = empty.df.select(*(col(empty.scope[n].cols["value"]).alias(f"{done.scope[n].cols['value']}.none") for n in names))
        df = outer.df.join(right, on, "left").crossJoin(nothing)  # one row
        scope, columns = dict(outer.scope), []
        for n in names:
            held = done.scope[n].cols["value"]
            columns.append(F.when(col(met), col(held)).otherwise(col(f"{held}.none")).alias(f"{held}.all"))
            scope[n] = Bound("value", {"value": f"{held}.all"}, type=done.scope[n].type)
        return Frame(df.select(*(col(c) for c in outer.df.columns), *columns), scope)

    def _union(self, u: Union, params: dict[str, Any]) -> DataFrame:
        out = None
        for k, s in enumerate(u.parts):
            df = self._statement(s, params, unit(self.graph), True, None)[0][0]
            if out is None:
                out = df
                continue
            out = out.unionByName(df, allowMissingColumns=True)
            if not u.keep_all[k - 1]:
                out = out.distinct()
        low = Lowering({n: Bound("value", {"value": n}, type=out.schema[n].dataType) for n in out.columns}, params)
        if u.order:
            out = out.orderBy(*ordered([(low.value(e)[0], down) for e, down in u.order]))
        return slice_of(out, u, params)


def node_frame(graph: PropertyGraph, *labels: str) -> DataFrame:
    """Nodes with the labels as a flat frame: id, labels and properties under their own names."""
    df, b = scan(graph, "n", labels)
    return df.select(col(b.cols["id"]).alias("id"), F.col(f"`{b.cols['labels']}`").alias("labels"), *(col(c).alias(p) for p, (c, _) in b.props.items()))


__all__ = ["GraphSession", "NodePat", "node_frame"]
