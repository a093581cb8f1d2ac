"""Who may read what: grants of a user, cut to the sources of a space, as filtered views of one session."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_stem


@dataclass(frozen=True)
class Grant:
    source: str
    table: str
    predicate: str = "TRUE"


def effective(user_grants: Iterable[Grant], space_sources: Iterable[str] | None, member: bool = True) -> list[Grant]:
    """Without a space all of the user's grants; in one, those of its sources, and none for who is no member."""
    if space_sources is None:
        return list(user_grants)
    allowed = set(space_sources)
    return [g for g in user_grants if g.source in allowed] if member else []


def views(tables: dict[str, DataFrame], grants: Iterable[Grant]) -> dict[str, str]:
    """Register each granted table, under its row predicates, as a temporary view; several grants of a table add up."""
    rows: dict[str, list[str]] = {}
    for g in grants:
        rows.setdefault(g.table, []).append(g.predicate)
    out = {}
    for t, predicates in rows.items():
        if t in tables:
            out[t] = safe_stem(t)
            tables[t].where(F.expr(" OR ".join(f"({p})" for p in predicates))).createOrReplaceTempView(out[t])
    return out
