"""What a planner is told about the data: ranked schema, sample values, and a prompt that fits its budget."""

from __future__ import annotations

import datetime
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import ValueIndex, index
from ..functions.scalar import fold, quote

#: Budgets of the prompt and of the value index.
CHARS_PER_TOKEN, PROMPT_TOKENS, SHORTLIST = 4, 480, 48
COLUMN_CAP, TOTAL_CAP, SAMPLES, SAMPLE_CHARS = 500, 5000, 3, 80


def value_index(tables: dict[str, DataFrame], column_cap: int = COLUMN_CAP, total_cap: int = TOTAL_CAP) -> ValueIndex:
    """All distinct values of a column or none of them; columns beyond the total are left out whole, the widest first."""
    found = index(tables, column_cap)
    kept, left, total = {}, list(found.unchecked), 0
    for at, values in sorted(found.values.items(), key=lambda x: (len(x[1]), x[0])):
        if total + len(values) > total_cap:
            left.append(at)
        else:
            kept[at], total = values, total + len(values)
    return ValueIndex(kept, tuple(sorted(left)))


def samples(df: DataFrame, columns: list[str], n: int = 6) -> dict[str, list[str]]:
    """Some distinct values of each column, the smallest, found in one pass."""
    row = df.agg(*[F.slice(F.sort_array(F.collect_set(F.when(F.xxhash64(quote(c)) % 64 == 0, F.substring(F.col(quote(c)).cast("string"), 1, SAMPLE_CHARS)))), 1, n).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: row[str(i)] for i, c in enumerate(columns)}


def _bag(text: str) -> Counter:
    t = f" {fold(text)} "
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def similarity(a: str, b: str) -> float:
    """Cosine of the trigram bags of two names."""
    x, y = _bag(a), _bag(b)
    norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(v * y[k] for k, v in x.items()) / norm**0.5 if norm else 0.0


@dataclass(frozen=True)
class Hint:
    table: str
    column: str
    kind: str
    values: tuple[str, ...] = ()

    def line(self) -> str:
        told = f" e.g. {', '.join(self.values[:SAMPLES])}" if self.values else ""
        return f"{self.table}.{self.column} {self.kind}{told}"


def shortlist(question: str, tables: dict[str, DataFrame], landed: ValueIndex, n: int = SHORTLIST) -> list[Hint]:
    """Columns by what of the question they hold: a stored value first, then likeness of names; ties by name."""
    text = f" {fold(question)} "
    out = []
    for t, df in tables.items():
        for c, kind in df.dtypes:
            if c.startswith("_"):
                continue
            cited = tuple(v for v in landed.values.get((t, c), ()) if fold(v) and f" {fold(v)} " in text)
            out.append((not cited, -similarity(question, f"{t} {c}".replace("_", " ")), t, c, Hint(t, c, kind, cited)))
    return [x[-1] for x in sorted(out, key=lambda x: x[:4])[:n]]


def pack(hints: list[Hint], tokens: int = PROMPT_TOKENS) -> list[str]:
    """Lines in order as long as they fit; a long line is skipped and shorter ones after it may still fit."""
    out, left = [], tokens * CHARS_PER_TOKEN
    for h in hints:
        line = h.line()
        if len(line) + 1 <= left:
            out.append(line)
            left -= len(line) + 1
    return out


def typed_filters(question: str, columns: dict[str, list[str]], bound: dict[str, str], as_of: datetime.date, audit_days: int = 90) -> list[tuple[str, str, str, object]] | None:
    """Filters that the question implies; None if one is implied and cannot be typed."""
    q, out = question.lower(), []

    def has(o: str, c: str) -> bool:
        return c in columns.get(o, [])

    wanted = []
    if re.search(r"\bcold\b", q):
        wanted.append(("location", "is_cold_storage", "=", not re.search(r"\b(?:non|not|no|without|except|excluding)[\s-]+(?:in\s+|the\s+)?cold\b", q)))
    if re.search(r"\bexpir", q):
        wanted.append(("lot", "expiry_date", "<", as_of))
    if "audit" in q and "overdue" in q:
        wanted.append(("supplier", "last_audit_date", "<", as_of - datetime.timedelta(days=audit_days)))
    if re.search(r"\bcategor|\bchemical", q) and (value := bound.get("lot.category")):
        wanted.append(("lot", "category", "=", value))
    if re.search(r"\bwarehouse\s+[a-z]\b", q):
        if "location.location_code" not in bound:
            return None
        wanted.append(("location", "location_code", "=", bound["location.location_code"]))
    for o, c, op, v in wanted:
        if not has(o, c):
            return None
        out.append((o, c, op, v))
    return out
