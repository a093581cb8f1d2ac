"""Checks of a generated statement against the definitions: what it may read, how it may join and what it may aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..functions.pii import kind_by_name
from .governance import fold_ascii, gate, hostile, join_pairs, relations, sources, unverified_join
from .ontology import Ontology
from .outcomes import Refusal
from .tree import analyzed, parsed


@dataclass(frozen=True)
class Checked:
    tables: tuple[str, ...]
    grain: str
    provenance: tuple[str, ...] = field(default=())


def validate(spark: SparkSession, sql: str, ontology: Ontology, granted: Iterable[str], approved: Iterable[str] = ()) -> Checked | Refusal:
    """The first rule that a statement breaks, in this order: it cannot be parsed, reads personal data, selects all columns, reads a
    table that is not granted or not in the ontology, joins off the declared links, or aggregates what no measure justifies.

    ``approved`` lists aggregates as ``agg(table.column)``.
    """
    if (refusal := hostile(sql)) is not None:
        return refusal
    tree = parsed(spark, sql)
    if isinstance(tree, Refusal):
        return Refusal("unparseable", tree.detail)
    names = [n for n in tree.walk() if n.kind == "UnresolvedAttribute"]
    if held := sorted({n.names[-1] for n in names if kind_by_name(n.names[-1])}):
        return Refusal("pii_column", ", ".join(held))
    if any(n.kind == "UnresolvedStar" for n in tree.walk() if not n.text.startswith("count")) and not _only_counted(tree):
        return Refusal("select_star", "")
    passed = gate(spark, sql, granted)
    if isinstance(passed, Refusal):
        return passed
    tables = tuple(dict.fromkeys(r[-1] for r in relations(tree)))
    if unknown := [t for t in tables if fold_ascii(t) not in {fold_ascii(o) for o in ontology.objects}]:
        return Refusal("not_in_ontology", ", ".join(unknown))
    try:
        df = spark.sql(sql)
        refusal = unverified_join(df, ontology)
    except PySparkException as e:
        return Refusal("unparseable", type(e).__name__)
    if refusal is not None:
        return Refusal("undeclared_join", refusal.detail) if refusal.reason == "unverified_join" else refusal
    node = analyzed(df)
    if any(n.kind in ("Window", "WindowExpression") for n in node.walk()):
        return Refusal("measure_unjustified", "window")
    found = _aggregates(node)
    allowed = {a.lower() for a in approved}
    if bad := [f for f in found if f not in allowed and not f.startswith(("count(", "min(", "max("))]:
        return Refusal("measure_unjustified", ", ".join(sorted(bad)))
    parents = {x.to_object for x in ontology.usable_links() if {x.from_object, x.to_object} <= set(tables)}
    grain = next((t for t in tables if t not in parents), tables[0] if tables else "")
    return Checked(tables, grain, tuple(f"derived:{f}" for f in sorted(found)))


def _only_counted(tree) -> bool:
    """Every star stands inside a count."""
    def stars(n, inside):
        inside = inside or n.kind == "UnresolvedFunction" and n.names[-1:] == ("count",)
        for x in [*n.children, *n.expressions, *n.plans, *n.ctes.values()]:
            yield from stars(x, inside)
        if n.kind == "UnresolvedStar":
            yield inside

    return all(stars(tree, False))


def _aggregates(node) -> set[str]:
    owner = {a.id: (n.names[0], a.names[0]) for n in node.walk() if n.kind == "View" and n.names for a in n.expressions}
    out = set()
    for x in node.walk():
        if x.kind == "AggregateExpression":
            used = sorted({".".join(owner[a.id]) for a in x.walk() if a.kind == "AttributeReference" and a.id in owner})
            out.add(f"{x.children[0].kind.lower()}({', '.join(used)})")
    return out


def output_sources(spark: SparkSession, sql: str) -> dict[str, set[tuple[str, str]]]:
    return sources(spark.sql(sql))


def declared_pairs(spark: SparkSession, sql: str) -> set:
    return join_pairs(spark.sql(sql))
