"""The parsed form of a query: a list of clauses, which compose freely."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    var: str
    name: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Neg(Expr):
    value: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    arg: Expr


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr | None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr | None = None


@dataclass(frozen=True)
class Logic(Expr):
    op: str  # AND, OR, NOT
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()
    named: bool = True

    @property
    def bare(self) -> bool:
        return not self.labels and not self.props


@dataclass(frozen=True)
class RelPat:
    var: str
    type: str | None = None
    props: tuple[tuple[str, Expr], ...] = ()
    direction: str = "out"  # out, in, both
    hops: tuple[int, int | None] | None = None  # variable length: least and most
    named: bool = True


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePat, ...]
    rels: tuple[RelPat, ...] = ()
    path: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (expression, descending)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Match:
    patterns: list[Pattern]
    where: Expr | None = None
    optional: bool = False


@dataclass
class With:
    body: Projection


@dataclass
class Return:
    body: Projection


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class CallSub:
    statements: list[Statement]


@dataclass
class Create:
    pattern: Pattern


@dataclass
class Merge:
    pattern: Pattern
    on_create: list[tuple[Prop, Expr]] = field(default_factory=list)
    on_match: list[tuple[Prop, Expr]] = field(default_factory=list)


@dataclass
class SetProps:
    items: list[tuple[Prop, Expr]]


@dataclass
class Delete:
    var: str


@dataclass
class Foreach:
    var: str
    list: Expr
    body: Statement


@dataclass
class Statement:
    clauses: list[Any]


@dataclass
class Union:
    parts: list[Statement]
    keep_all: list[bool]  # between part i and i + 1
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None


WRITES = (Create, Merge, SetProps, Delete, Foreach)


def variables(x: Any) -> set[str]:
    """Names that an expression, pattern or clause mentions."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Prop):
        return {x.var}
    if isinstance(x, NodePat | RelPat):
        return {x.var} | variables([e for _, e in x.props])
    if isinstance(x, Unwind | Foreach):
        return variables(list(vars(x).values())) | {x.var}
    if isinstance(x, Delete):
        return {x.var}
    if isinstance(x, list | tuple):
        return set().union(*map(variables, x)) if x else set()
    return variables(list(vars(x).values())) if hasattr(x, "__dict__") else set()
