"""Answer envelopes: rows with what they rest on, and the rules that make one valid."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import result_hash
from .outcomes import CompiledQuery, Refusal

BADGES = ("CERTIFIED", "VERIFIED", "FALLBACK", "ABSTAIN")
MAX_ROWS = 10_000


def build(answer: CompiledQuery | Refusal, question: str, sources: list[str], audit_id: str, as_of: datetime | None = None, badge: str = "CERTIFIED", banner: str = "") -> dict:
    """An envelope of an answer, or the grey one of a refusal; at most MAX_ROWS rows are brought to the driver."""
    base = {"question": question, "audit_id": audit_id, "as_of": (as_of or datetime.now(timezone.utc)).isoformat(), "banner": banner}
    if isinstance(answer, Refusal):
        return base | {"badge": "ABSTAIN", "abstained": True, "reason": answer.reason, "rows": [], "values": [], "sources": [], "drill_token": None, "sql_used": None, "prose": "", "receipt": None}
    rows = [r.asDict() for r in answer.frame.limit(MAX_ROWS + 1).collect()]
    cut, rows = len(rows) > MAX_ROWS, rows[:MAX_ROWS]
    values = [v for r in rows for v in r.values() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    receipt = {"include": list(answer.coverage.include), "exclude": list(answer.coverage.exclude), "unsure": list(answer.coverage.unsure), "row_count": len(rows), "cut": cut}
    return base | {"badge": badge, "abstained": False, "rows": rows, "values": values, "sources": sources, "drill_token": result_hash(rows), "sql_used": answer.frame._jdf.queryExecution().analyzed().toString(), "prose": "", "receipt": receipt, "notes": list(answer.notes)}


def figures(text: str) -> list[float]:
    """Money-like figures of a text: with a fraction, thousands or at least three digits."""
    return [float(x.replace(",", "")) for x in re.findall(r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?<![\w.])\d+\.\d+|(?<![\w.])\d{3,}(?![\w.]\d)", text)]


def invented_totals(e: dict) -> list[float]:
    """Figures of the prose that are neither a cell nor the sum of a column."""
    cells = {round(float(v), 2) for v in e["values"]}
    columns = {k for r in e["rows"] for k in r}
    for k in columns:
        numbers = [r[k] for r in e["rows"] if isinstance(r.get(k), (int, float)) and not isinstance(r[k], bool)]
        if len(numbers) == len(e["rows"]):
            cells.add(round(float(sum(numbers)), 2))
    return [f for f in figures(e.get("prose", "")) if round(f, 2) not in cells]


def problems(e: dict) -> list[str]:
    """Which rules an envelope breaks."""
    out = []
    grey = e["badge"] == "ABSTAIN"
    if grey != bool(e["abstained"]):
        out.append("E1")
    if e["abstained"] and (e["values"] or e["sources"] or e["drill_token"]):
        out.append("E2")
    if not e["abstained"] and not (e["values"] or e["rows"]) or not e["abstained"] and not (e["sql_used"] and e["audit_id"]):
        out.append("E3")
    if any(round(f, 2) not in {round(float(v), 2) for v in e["values"]} for f in figures(e.get("prose", ""))) and invented_totals(e):
        out.append("E4")
    if e["badge"] not in BADGES:
        out.append("E5")
    if e["badge"] == "FALLBACK" and not e["banner"]:
        out.append("E6")
    if e["sources"] and not e["drill_token"]:
        out.append("E7")
    try:
        if datetime.fromisoformat(e["as_of"]) > datetime.now(timezone.utc):
            out.append("E8")
    except ValueError:
        out.append("E8")
    if not e["sql_used"] and figures(e.get("prose", "")):
        out.append("E9")
    r = e["receipt"]
    if not e["abstained"] and (not r or not (r["include"] and r["exclude"] and r["unsure"]) or r["row_count"] != len(e["rows"]) or invented_totals(e)):
        out.append("E13")
    return out


def shape_mismatch(question: str, answer: CompiledQuery) -> bool:
    """A grouped question answered by one total, or a question for one figure answered by a ranking."""
    from .questions import qualifiers

    q = qualifiers(question)
    wants = bool(q.group_by or q.grain or q.rank)
    return wants != bool(answer.group_by)


def keep_above(answer: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Rows of an answer above a threshold; the filter follows the aggregation."""
    return answer.where(F.col(f"`{measure}`") > threshold)


AUDIT = "audit_id string, asked_at timestamp, question string, badge string, reason string, row_count int, result_hash string, envelope string"


def audit(spark: SparkSession, path: str, e: dict) -> None:
    """Append one record; nothing is updated or deleted."""
    row = (e["audit_id"], datetime.now(timezone.utc), e["question"], e["badge"], e.get("reason"), len(e["rows"]), result_hash(e["rows"]), json.dumps(e, default=str))
    spark.createDataFrame([row], AUDIT).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 CSV whose text cells cannot run as formulas."""
    from ..functions.scalar import neutral, quote

    cells = [neutral(F.col(quote(c))).alias(c) if t == "string" else F.col(quote(c)).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def chart(rows: list[dict]) -> dict | None:
    """A bar chart of one label and one number per row, or None."""
    if not rows:
        return None
    label = next((k for k, v in rows[0].items() if isinstance(v, str)), None)
    value = next((k for k, v in rows[0].items() if isinstance(v, (int, float)) and not isinstance(v, bool)), None)
    return {"kind": "bar", "x": label, "y": value, "points": [[r[label], r[value]] for r in rows]} if label and value else None
