"""Pipeline contracts: what a silver table must hold, and receipts of promotions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.scalar import spark_type


@dataclass(frozen=True)
class ColumnContract:
    """``maximum`` is read and kept but not enforced, as in the contract's definition."""

    type: str
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    allowed_from: str | None = None


@dataclass(frozen=True)
class Pipeline:
    target: str
    sources: tuple[str, ...]
    columns: dict[str, ColumnContract]
    lineage: bool = True
    dedup_key: tuple[str, ...] = ()
    join_on: tuple[str, ...] = ()
    not_null_rates: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class PromoteReceipt:
    run_id: str
    target: str
    source_rows: int
    passed: int
    quarantined: int
    unmatched: int
    counts_by_reason: dict[str, int]
    expectations: dict[str, bool]
    join_cardinality_change: bool = False

    @property
    def reconciled(self) -> bool:
        """Every source row is in the target, in quarantine, or counted as unmatched."""
        return self.source_rows == self.passed + self.quarantined + self.unmatched and self.unmatched >= 0


@dataclass(frozen=True)
class GoldMetric:
    name: str
    sql: str
    signature: str | None = None
    steward: str | None = None
    signed_at: str | None = None
    ledger_id: str | None = None

    @property
    def signed(self) -> bool:
        return all((self.signature, self.steward, self.signed_at, self.ledger_id))


_EXPECTATION = re.compile(r"\s*(\w+)_not_null_rate\s*>=\s*([0-9.]+)\s*")


def load(data: dict) -> Pipeline:
    """A pipeline from its YAML mapping; what is missing or unknown is an error that names it."""
    for key in ("target", "sources", "columns"):
        if not data.get(key):
            raise ValueError(f"pipeline lacks {key}")
    if not str(data["target"]).startswith(("silver.", "gold.")):
        raise ValueError(f"target {data['target']!r} is not in silver or gold")
    sources = tuple(s if isinstance(s, str) else s["table"] for s in data["sources"])
    if len(sources) > 2:
        raise ValueError("at most two sources can be joined")
    join_on = data.get("join_on") or ()
    join_on = (join_on,) if isinstance(join_on, str) else tuple(join_on)
    if len(sources) == 2 and not join_on:
        raise ValueError("two sources need join_on")
    columns = {}
    for name, c in data["columns"].items():
        c = {"type": c} if isinstance(c, str) else c
        spark_type(c["type"])
        columns[name] = ColumnContract(c["type"], bool(c.get("required")), c.get("min"), c.get("max"), c.get("allowed_from"))
    dedup = data.get("dedup_key") or ()
    dedup = (dedup,) if isinstance(dedup, str) else tuple(dedup)
    if unknown := [c for c in dedup if c not in columns]:
        raise ValueError(f"dedup_key names unknown columns {unknown}")
    rates = {}
    for e in data.get("expectations") or ():
        m = _EXPECTATION.fullmatch(e)
        if not m or m[1] not in columns:
            raise ValueError(f"unknown expectation {e!r}")
        rates[m[1]] = float(m[2])
    pipe = Pipeline(data["target"], sources, columns, bool(data.get("lineage", True)), dedup, join_on, rates)
    if pipe.target.startswith("silver.") and not pipe.lineage:
        raise ValueError("a silver table carries lineage")
    return pipe


def load_yaml(text: str) -> Pipeline:
    import yaml

    return load(yaml.safe_load(text))


def sign(metric: GoldMetric, signature: str, steward: str, signed_at: str, append: Callable[[dict], str], verify: Callable[[str], bool]) -> GoldMetric:
    """Sign a metric through an injected ledger; nothing is signed unless the ledger reads back whole."""
    entry = append({"metric": metric.name, "sql": metric.sql, "signature": signature, "steward": steward, "signed_at": signed_at})
    if not verify(entry):
        raise PermissionError("the ledger did not verify")
    return GoldMetric(metric.name, metric.sql, signature, steward, signed_at, entry)
