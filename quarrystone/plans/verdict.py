"""Whether a statement kept what its question said: every stored value that the question names must restrict the rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import polarity, stated_values
from ..functions.scalar import fold, folded, quote
from .governance import _block, _conjuncts, _owners
from .outcomes import Refusal
from .tree import Node, analyzed

#: Words beside a number that make it a rank, and words after it that make it a time window.
RANK_WORDS = {"top", "bottom", "first", "last", "largest", "smallest", "biggest", "highest", "lowest", "best", "worst", "greatest", "most", "least"}
TIME_UNITS = {"day", "days", "week", "weeks", "month", "months", "quarter", "quarters", "year", "years", "hour", "hours", "minute", "minutes"}


def restrictions(tree: Node) -> list[Node]:
    """Conjuncts that restrict a statement's rows: WHERE, the ON of inner joins, and HAVING on grouped columns."""
    owner, out = _owners(tree), []
    for n in _block(tree):
        if n.kind == "Filter":
            grouped = any(c.kind == "Aggregate" for c in _block(n))
            for c in _conjuncts(n.expressions[0]):
                columns = [x for x in c.walk() if x.kind == "AttributeReference"]
                if not grouped or columns and all(x.id in owner for x in columns):
                    out.append(c)
        elif n.kind == "Join" and n.text.startswith("Join Inner"):
            out += [c for e in n.expressions for c in _conjuncts(e)]
    return out


def equal_columns(found: list[Node], owner: dict[int, tuple[str, str]], start: tuple[str, str]) -> set[tuple[str, str]]:
    """Columns that a chain of plain equalities makes equal to ``start``."""
    edges = [tuple(owner[x.id] for x in c.children) for c in found if c.kind == "EqualTo" and all(x.kind == "AttributeReference" and x.id in owner for x in c.children)]
    seen, more = {start}, [start]
    while more:
        at = more.pop()
        near = {b for e in edges for a, b in (e, e[::-1]) if a == at} - seen
        seen |= near
        more += near
    return seen


def _held(conjunct: Node, owner: dict[int, tuple[str, str]]) -> tuple[str, str] | None:
    """The one column that a conjunct is about."""
    names = {owner.get(x.id) for x in conjunct.walk() if x.kind == "AttributeReference"}
    return next(iter(names)) if len(names) == 1 and None not in names and not any(x.plans for x in conjunct.walk()) else None


def _honoured(table: DataFrame, column: str, tests: list[str], phrases: set[str], negative: bool) -> bool:
    """The tests together keep exactly the rows whose cell is one of the phrases, or with ``negative`` all others, nulls among them."""
    cell = F.coalesce(folded(F.col(quote(column))).isin(sorted(phrases)), F.lit(False))
    kept = reduce(lambda a, b: a & b, [F.coalesce(F.expr(t), F.lit(False)) for t in tests], F.lit(True))
    wrong = table.agg(F.count(F.when(kept != (~cell if negative else cell), 1)).alias("n")).first().n
    return wrong == 0


def _everywhere(table: DataFrame, column: str, phrase: str) -> bool:
    same = F.coalesce(folded(F.col(quote(column))) == phrase, F.lit(False))
    return table.agg(F.count(F.when(~same, 1)).alias("n")).first().n == 0


def _spans(words: list[str], value: str) -> list[tuple[int, int]]:
    parts = value.split()
    return [(i, i + len(parts)) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]


def dropped_stated_value(question: str, df: DataFrame, tables: dict[str, DataFrame]) -> Refusal | None:
    """``unhonored_qualifier`` with the first value of the question that is a stored cell and that the statement leaves open.

    A number that is the statement's rank cut or a time window is no value, nor is a word that names what the statement reads, nor
    a value that every row holds. A value that lies inside a longer stored one counts as part of it. A plan or a table that cannot be read
    refuses.
    """
    try:
        tree = analyzed(df)
        hits = [(r.table, r.column, r.phrase, r.cell) for r in stated_values(question, tables).collect()]
        return _verdict(question, tree, tables, hits)
    except PySparkException:
        return Refusal("unhonored_qualifier", "named_filter=unchecked")


def _verdict(question: str, tree: Node, tables: dict[str, DataFrame], hits: list[tuple[str, str, str, str]]) -> Refusal | None:
    words = fold(question).split()
    read = {n.names[0] for n in tree.walk() if n.kind == "View"}
    limits = {re.sub(r"\D", "", n.expressions[0].text) for n in tree.walk() if n.kind == "GlobalLimit"}
    owner, found = _owners(tree), restrictions(tree)
    tests: dict[tuple[str, str], list[str]] = {}
    for c in found:
        if (at := _held(c, owner)) is not None:
            tests.setdefault(at, []).append(c.sql(at[1]))
    spans = {v: _spans(words, v) for _, _, v, _ in hits}
    stated = [v for v in spans if not all(any(a <= s and e <= b and (a, b) != (s, e) for o in spans for a, b in spans[o]) for s, e in spans[v])]
    sense = {v: polarity(question, v) for v in stated}
    together: dict[tuple[str, str, str], set[str]] = {}
    for t, c, v, _ in hits:
        if v in sense:
            together.setdefault((t, c, sense[v]), set()).add(v)
    named = {w for t in read for n in [t, *(tables[t].columns if t in tables else [])] for w in (fold(n), *fold(n.replace("_", " ")).split())}
    for value in sorted(stated, key=lambda v: (-len(v.split()), v)):
        own = [(t, c, cell) for t, c, v, cell in hits if v == value]
        here = [(t, c) for t, c, _ in own if t in read]
        if sense[value] != "unsettled":
            if value.isdigit() and all(_no_value(words, s, e, value in limits) for s, e in spans[value]):
                continue
            if here:
                negative = sense[value] == "exclude"
                if all(_column_holds(tables, t, c, value, negative, together[t, c, sense[value]], tests, equal_columns(found, owner, (t, c))) for t, c in here):
                    continue
            elif " " not in value and {value, value.removesuffix("s"), value + "s"} & named:
                continue
        return Refusal("unhonored_qualifier", f"named_filter={min(cell for _, _, cell in own)}")
    return None


def _no_value(words: list[str], s: int, e: int, is_limit: bool) -> bool:
    before, after = words[s - 1] if s else "", words[e] if e < len(words) else ""
    return after in TIME_UNITS or is_limit and bool({before, after} & RANK_WORDS)


def _column_holds(tables: dict[str, DataFrame], table: str, column: str, value: str, negative: bool, phrases: set[str], tests: dict[tuple[str, str], list[str]], same: Iterable[tuple[str, str]]) -> bool:
    asked = [(t, c) for t, c in sorted(same) if (t, c) in tests]
    if not asked:
        return not negative and _everywhere(tables[table], column, value)
    return any(t in tables and _honoured(tables[t], c, tests[t, c], phrases, negative) for t, c in asked)


def filter_reasons(tree: Node) -> list[tuple[str, str]]:
    """What a statement's rows were filtered by, for the receipt: (where, having or filter, condition), each once, none invented."""
    out = []
    for n in _block(tree):
        if n.kind == "Filter":
            kind = "having" if any(c.kind == "Aggregate" for c in _block(n)) else "where"
            out += [(kind, c.sql()) for c in _conjuncts(n.expressions[0])]
        for e in n.expressions if n.kind != "View" else ():
            out += [("filter", x.children[1].sql()) for x in e.walk() if x.kind == "AggregateExpression" and len(x.children) > 1]
    return sorted(dict.fromkeys(out), key=lambda r: ("filter", "where", "having").index(r[0]))


