"""Questions in words: what they ask for beyond a measure, and typed plans from what is known."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.scalar import fold
from .ontology import Ontology
from .outcomes import CompiledQuery, Refusal

#: Words of grains and ranks.
GRAINS = {"day": "day", "daily": "day", "week": "week", "weekly": "week", "month": "month", "monthly": "month", "quarter": "quarter", "quarterly": "quarter", "year": "year", "yearly": "year", "annual": "year"}
MOST = ("top", "largest", "biggest", "highest", "best", "most", "greatest", "first")
LEAST = ("bottom", "smallest", "lowest", "worst", "least", "last")
DEFAULT_LIMIT = 50


@dataclass(frozen=True)
class RankWindow:
    """Ranks first..last; ``descending``: rank 1 is the largest."""

    first: int
    last: int
    descending: bool = True

    @property
    def offset(self) -> int:
        return self.first - 1

    @property
    def limit(self) -> int:
        return max(0, self.last - self.first + 1)


def rank_window(question: str) -> RankWindow | None:
    """``top 5``, ``ranks 4-8`` (a reversed range is empty, not swapped), ``top 10 excluding top 3`` (ranks 4 to 10)."""
    q = question.lower()
    if m := re.search(r"\branks?\s+(\d+)\s*(?:-|to|through)\s*(\d+)", q):
        return RankWindow(int(m[1]), int(m[2]))
    words = "|".join(MOST + LEAST)
    if m := re.search(rf"\b({words})\s+(\d+)\b.*?\b(?:excluding|except|without)\s+(?:the\s+)?(?:{words})\s+(\d+)", q):
        return RankWindow(int(m[3]) + 1, int(m[2]), m[1] in MOST)
    if m := re.search(rf"\b({words})\s+(\d+)\b", q):
        return RankWindow(1, int(m[2]), m[1] in MOST)
    return None


@dataclass(frozen=True)
class Qualifiers:
    years: tuple[int, ...]
    grain: str | None
    group_by: tuple[str, ...]
    quoted: tuple[str, ...]
    rank: RankWindow | None


def qualifiers(question: str) -> Qualifiers:
    words = fold(question).split()
    grain = next((GRAINS[b] for a, b in zip(words, words[1:], strict=False) if a in ("by", "per") and b in GRAINS), None) or next((GRAINS[w] for w in words if w in GRAINS and w.endswith("ly")), None)
    groups = tuple(g for g in re.findall(r"\b(?:by|per|for each)\s+([a-z][a-z_]*)", question.lower()) if g not in GRAINS)
    return Qualifiers(tuple(int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", question)), grain, groups, tuple(re.findall(r"[\"']([^\"']+)[\"']", question)), rank_window(question))


def unhonored(question: str, plan: dict) -> Refusal | None:
    """What the question names and the plan leaves out."""
    q, told = qualifiers(question), fold(str(plan.get("filters", ())))
    for y in q.years:
        if str(y) not in told:
            return Refusal("unhonored_qualifier", f"time={y}")
    for v in q.quoted:
        if fold(v) not in told:
            return Refusal("unhonored_qualifier", f"named_filter={v}")
    if (q.group_by or q.grain) and not plan.get("group_by"):
        return Refusal("unhonored_qualifier", f"group_by={', '.join(q.group_by) or q.grain}")
    if q.rank and (plan.get("limit") != q.rank.limit or (plan.get("offset") or 0) != q.rank.offset):
        return Refusal("unhonored_qualifier", f"rank={q.rank.first}-{q.rank.last}")
    return None


def _score(words: set[str], name: str) -> int:
    return len(words & set(fold(name.replace("_", " ")).split()))


def retrieve(question: str, catalog: dict[str, list[str]], tables: int = 6, columns: int = 8) -> dict[str, list[str]]:
    """The tables and columns that share most words with the question; ties by name."""
    words = set(fold(question).split())
    ranked = sorted(catalog, key=lambda t: (-_score(words, t) - max((_score(words, c) for c in catalog[t]), default=0), t))
    ranked = [t for t in ranked if _score(words, t) or any(_score(words, c) for c in catalog[t])][:tables]
    return {t: sorted(catalog[t], key=lambda c: (-_score(words, c), c))[:columns] for t in ranked}


def bind_plan(question: str, ontology: Ontology) -> dict | Refusal:
    """Measure, groups, order and limit of a question; equally good candidates are a refusal, not a pick."""
    words, q = set(fold(question).split()), qualifiers(question)
    scored = sorted(((_score(words, m), m) for m in ontology.measures), reverse=True)
    if not scored or not scored[0][0]:
        return Refusal("unknown_measure", question)
    if len(scored) > 1 and scored[0][0] == scored[1][0]:
        return Refusal("unsure", f"{scored[0][1]} or {scored[1][1]}")
    groups = []
    for g in q.group_by:
        hits = [(o, c) for o, cs in ontology.columns.items() for c in cs if g in fold(c.replace("_", " ")).split() or g == fold(o)]
        names = [h for h in hits if g in fold(h[1].replace("_", " ")).split()]
        if len(names or hits) != 1:
            return Refusal("unsure" if hits else "unknown_column", g)
        groups.append((names or hits)[0])
    r = q.rank
    return {"measure": scored[0][1], "group_by": groups, "filters": [], "order_desc": r.descending if r else True, "limit": r.limit if r else (DEFAULT_LIMIT if groups else None), "offset": r.offset if r and r.offset else None}


def ask(question: str, ontology: Ontology) -> CompiledQuery | Refusal:
    plan = bind_plan(question, ontology)
    if isinstance(plan, Refusal):
        return plan
    refusal = unhonored(question, plan)
    return refusal if refusal is not None else ontology.compile(**plan)


def follow_up(question: str, prior: list[float]) -> float | None:
    """``average of those`` and ``add N`` over the figures of the answer before."""
    q = question.lower()
    if prior and re.search(r"\b(average|mean)\b", q):
        return sum(prior) / len(prior)
    if prior and (m := re.search(r"\badd\s+(-?\d+(?:\.\d+)?)", q)):
        return sum(prior) + float(m[1])
    return None
