"""A Python view of Catalyst's logical plans: parsed ones for rules about text, analyzed ones for lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from .outcomes import Refusal


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


@dataclass
class Node:
    """One operator or expression; ``plans`` are the plans inside its subquery expressions."""

    kind: str
    text: str
    children: list[Node] = field(default_factory=list)
    expressions: list[Node] = field(default_factory=list)
    plans: list[Node] = field(default_factory=list)
    names: tuple[str, ...] = ()
    ctes: dict[str, Node] = field(default_factory=dict)
    id: int | None = None
    output: tuple[int, ...] = ()
    #: Of a union, the ids of each input's columns.
    unions: tuple[tuple[int, ...], ...] = ()
    jvm: object = field(default=None, repr=False, compare=False)

    def sql(self, column: str | None = None) -> str:
        """The expression as SQL; with ``column``, the one column that it is about is named without its table."""
        text = self.jvm.sql()
        return re.sub(rf"(?:(?:`[^`]+`|\w+)\.)*`?\b{re.escape(column)}\b`?", f"`{column}`", text) if column else re.sub(r"\b\w+\.(?=[A-Za-z_`])", "", text)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, subqueries and CTE bodies included."""
        yield self
        for part in (self.children, self.expressions, self.plans, list(self.ctes.values())):
            for x in part:
                yield from x.walk()

    def operators(self) -> Iterator[Node]:
        """Plan nodes of this query block and its inputs, without subqueries."""
        yield self
        for c in self.children:
            yield from c.operators()


def _expression(e) -> Node:
    kind = e.getClass().getSimpleName()
    out = Node(kind, e.toString(), [_expression(c) for c in _seq(e.children())], jvm=e)
    if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        out.plans.append(_plan(e.plan()))
        if e.plan().resolved():
            out.plans[-1].output = tuple(a.exprId().id() for a in _seq(e.plan().output()))
    if kind in ("AttributeReference", "Alias"):
        out.names, out.id = (e.name(),), e.exprId().id()
    elif kind == "OuterReference":
        out.names, out.id = (e.name(),), e.exprId().id()
    elif kind == "UnresolvedAttribute":
        out.names = tuple(_seq(e.nameParts()))
    elif kind == "UnresolvedFunction":
        out.names = tuple(_seq(e.nameParts()))
    elif kind == "UnresolvedGenerator":
        out.names = (e.name().funcName(),)
    return out


def _plan(p) -> Node:
    kind = p.getClass().getSimpleName()
    out = Node(kind, p.simpleString(200))
    if kind == "UnresolvedWith":
        for pair in _seq(p.cteRelations()):
            out.ctes[pair._1()] = _plan(pair._2())
        out.children = [_plan(p.child())]
        return out
    out.children = [_plan(c) for c in _seq(p.children())]
    out.expressions = [_expression(e) for e in _seq(p.expressions())]
    if kind == "Union" and p.resolved():
        out.unions = tuple(tuple(a.exprId().id() for a in _seq(c.output())) for c in _seq(p.children()))
    if kind == "Generate":
        out.expressions.append(_expression(p.generator()))
    if kind == "UnresolvedRelation":
        out.names = tuple(_seq(p.multipartIdentifier()))
    elif kind == "UnresolvedTableValuedFunction":
        out.names = tuple(_seq(p.name()))
    elif kind == "SubqueryAlias":
        out.names = (p.alias(),)
    elif kind == "View":
        out.names = (p.desc().identifier().table(),)
    if kind in ("LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "View"):
        out.expressions += [_expression(a) for a in _seq(p.output())]
    return out


def parsed(spark: SparkSession, sql: str) -> Node | Refusal:
    """The parsed plan of one statement; more than one, or none, is refused."""
    try:
        return _plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    except ParseException as e:
        return Refusal("sql_not_supported", str(e).strip().splitlines()[0][:200])


def analyzed(df: DataFrame) -> Node:
    return _plan(df._jdf.queryExecution().analyzed())
