"""Typed outcomes: a refusal is a value, never an exception and never a caveated number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Refusal:
    reason: str
    detail: str = ""

    def __bool__(self) -> bool:
        return False


@dataclass(frozen=True)
class Violation:
    check: str
    subject: str
    detail: str = ""


@dataclass(frozen=True)
class WherePath:
    grain: str
    links: tuple[str, ...]
    many_to_many: bool
    importance: int


@dataclass(frozen=True)
class Coverage:
    """What an answer includes and excludes and what it cannot know; each list names something."""

    include: tuple[str, ...]
    exclude: tuple[str, ...]
    unsure: tuple[str, ...]

    @property
    def valid(self) -> bool:
        return all(self.include) and all(self.exclude) and all(self.unsure) and bool(self.include and self.exclude and self.unsure)


@dataclass(frozen=True)
class CompiledQuery:
    """A lazy, join-safe plan and what was decided on the way."""

    frame: DataFrame
    measure: str
    grain: str
    group_by: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    existential: bool = False
    where_paths: tuple[WherePath, ...] = ()
    coverage: Coverage | None = field(default=None)
