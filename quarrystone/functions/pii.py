"""Personal data: detectors as column expressions, column kinds, stable masking tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import quote

#: Parts of the shapes below. A month and day; dates in three notations; cues of a birth, at most CUE characters away.
_MONTH, _DAY, CUE = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12]\\d|3[01])", 18
_DATE = rf"\b(?:\d{{4}}[-/]{_MONTH}[-/]{_DAY}|{_DAY}[-/]{_MONTH}[-/]\d{{4}}|{_MONTH}[-/]{_DAY}[-/]\d{{4}})\b"
_BORN = r"\b(?:d\.?o\.?b|date\s+of\s+birth|birth\s*dates?|birthdays?|born)\b"
#: Shapes of personal data, in the order they are looked for. Java and Python read them alike.
VALUES = {
    "email": r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",
    "nric": rf"\b\d{{2}}{_MONTH}{_DAY}-?\d{{2}}-?\d{{4}}\b",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": "|".join([
        r"(?<!\d)\+?60\s*1\d(?:[-\s]?\d){7,8}(?!\d)", r"(?<!\d)01\d(?:[-\s]?\d){7,8}(?!\d)", r"(?<!\d)\+[1-9]\d{9,14}(?!\d)",
        r"(?<!\d)\+[1-9]\d{0,2}(?:[\s.-]+\d{2,8}){1,4}(?!\d)", r"(?<!\d)(?:\+?1[\s.-]*)?\(?[2-9]\d{2}\)?[\s.-]*[2-9]\d{2}[\s.-]*\d{4}(?!\d)", r"(?<!\d)0[3-9](?:[-\s]?\d){7,8}(?!\d)",
    ]),
    "account": r"(?<!\d)\d{3,4}[-\s]\d{3,4}[-\s]\d{4,8}(?!\d)|[?&][A-Za-z0-9_]+=\d{10,16}(?!\d)",
    "passport": r"\b[A-Z]{1,2}\d{7,9}\b",
    "address": r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\s+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Jalan|Lorong)\b",
    "dob": rf"(?i){_BORN}.{{0,{CUE}}}?{_DATE}|{_DATE}.{{0,{CUE}}}?{_BORN}",
}
#: A person's name in capitalised words, looked for only where a person is spoken of.
PERSON = r"\b[A-Z][a-z]{1,24}(?:[ '\-][A-Z][a-z]{1,24}){1,3}\b"
#: Column names, looked at in this order; a metric name is no personal data.
NAMES = [
    ("dob", r"(^|_)(dob|date_of_birth|birth_?dates?|birthdays?)$|(^|_)(date_?of_?births?|born_on|born|birth|yob|year_of_birth|dob)(_|$)"),
    (None, r"(amount|qty|quantity|cost|kg|myr|usd|score|load|capacity|date|id|count|total|pct|percent|revenue|code|sku|category|region|country|status|type|flag|bool)$"),
    ("email", r"e_?mails?\d*$|(^|_)(e_?mails?\d*|email_addr(ess)?s?)$"),
    ("nric", r"(^|_)(nrics?|mykads?|ic_no|ic_num(ber)?s?|ic|kad_pengenalan|passports?(_no|_num(ber)?)?)$"),
    ("phone", r"(^|_)(phones?|mobiles?|telefons?|telephones?|whatsapps?|faxes|fax|tels?|hp|contact_no|contact_num(ber)?s?)$"),
    ("account", r"(^|_)(account_no|account_num(ber)?s?|acct_no|acct_num(ber)?s?|bank_accounts?|bank_accts?|ibans?|acc_no|acc_num(ber)?s?)$"),
    ("address", r"(^|_)(street|streets|mailstreet|mail_street|streetabr|street_abr|mailstrabr|mail_str_abr|address|addresses|addr)$"),
    ("name", r"(display_?names?|forenames?|surnames?)$|(^|_)((customer|person|people|employee|staff|user|contact|client|patient|member|holder|beneficiary|applicant|signatory|director|owner|payee|payer|full|first|last|given|family|middle|maiden|preferred|legal|pic|player|driver)_?names?|nama(_penuh|_pemegang|_pengguna)?)$|(^|_)adm_?[fl]_?names?\d*$"),
]
#: Tables of persons, in which a column called name holds names.
PERSON_TABLE = re.compile(r"(customer|person|people|employee|staff|user|users|contact|client|patient|member|applicant)s?$", re.I)


def luhn(c: Column) -> Column:
    """True where the digits of the text pass the Luhn check and are 13 to 19."""
    digits = F.reverse(F.split(F.regexp_replace(c, r"\D", ""), ""))
    digits = F.filter(digits, lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.size(digits).between(13, 19) & (total % 10 == 0)


def cards(c: Column) -> Column:
    """All card numbers in a text."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"({VALUES['card']})"), 1), luhn)


def kind_by_name(column: str, table: str = "") -> str | None:
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column).lower()
    for kind, pattern in NAMES:
        if re.search(pattern, name):
            return kind
    return "name" if name == "name" and PERSON_TABLE.search(table) else None


def classify_columns(df: DataFrame, table: str = "", share: float = 0.5) -> dict[str, str]:
    """The kind of each column that holds personal data: by name, else where most of all values have one shape; one pass."""
    out = {c: k for c in df.columns if (k := kind_by_name(c, table))}
    skipped = {c for c in df.columns if any(k is None and re.search(p, c.lower()) for k, p in NAMES)}
    texts = [c for c, t in df.dtypes if t == "string" and c not in out and c not in skipped]
    if not texts:
        return out
    tests = []
    for i, c in enumerate(texts):
        x = F.col(quote(c))
        tests.append(F.count(x).alias(f"{i}_n"))
        tests += [F.count(F.when((F.size(cards(x)) > 0) if k == "card" else x.rlike(p), 1)).alias(f"{i}_{k}") for k, p in VALUES.items()]
    row = df.agg(*tests).first()
    for i, c in enumerate(texts):
        hits = {k: row[f"{i}_{k}"] for k in VALUES}
        best = max(hits, key=hits.get)
        if row[f"{i}_n"] and hits[best] >= share * row[f"{i}_n"]:
            out[c] = best
    return out


def masked(c: Column) -> Column:
    """The text with every detected value replaced by its kind."""
    for kind, pattern in VALUES.items():
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


HIDDEN = "[hidden]"


class Masker:
    """Tokens for one answer: the same value keeps its token, numbered by first appearance within its kind.

    What cannot be masked is hidden: a value whose detectors fail never comes through as it is.
    """

    def __init__(self, prefix: str = "MASK", persons: bool = False):
        self.prefix, self.persons, self.seen, self.counts = prefix, persons, {}, {}
        self.shape = re.compile(rf"{re.escape(prefix)}_[a-z]+_\d{{2,}}")

    def token(self, kind: str, value: str) -> str:
        key = (kind, str(value))
        if key not in self.seen:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.seen[key] = f"{self.prefix}_{kind}_{self.counts[kind]:02d}"
        return self.seen[key]

    def text(self, v: str) -> str:
        """A text with every detected value replaced; tokens already there stay."""
        for kind, pattern in [*VALUES.items(), *([("name", PERSON)] if self.persons else [])]:
            parts = re.split(f"({self.shape.pattern})", v)
            v = "".join(x if i % 2 else re.sub(pattern, lambda m, kind=kind: self._found(kind, m[0]), x) for i, x in enumerate(parts))
        return v

    def _found(self, kind: str, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        if kind == "card" and not luhn_number(digits) or kind == "phone" and not 8 <= len(digits) <= 15:
            return value
        return self.token(kind, value)

    def cell(self, name: str, v, kinds: dict[str, str]):
        if v is None:
            return v
        if name in kinds:
            return self.token(kinds[name], v)
        if isinstance(v, str):
            return self.text(v)
        if isinstance(v, (list, tuple)):
            return [self.cell(name, x, {}) for x in v]
        if isinstance(v, dict):
            return {k: self.cell(str(k), x, kinds) for k, x in v.items()}
        return v

    def rows(self, rows: list[dict], kinds: dict[str, str]) -> list[dict]:
        """Answer rows with typed columns masked whole and detected values masked inside other text."""
        return [{k: self._safe(k, v, kinds) for k, v in r.items()} for r in rows]

    def _safe(self, name: str, v, kinds: dict[str, str]):
        try:
            return self.cell(name, v, kinds)
        except Exception:  # noqa: BLE001  fail closed
            return HIDDEN

    def envelope(self, e: dict, kinds: dict[str, str], kept: tuple[str, ...] = ("audit_id", "as_of", "badge", "abstained", "drill_token")) -> dict:
        """An answer envelope with its rows, values and all its texts masked; if a row cannot be, none comes through."""
        out = {k: v if k in kept else self._safe(k, v, {}) for k, v in e.items() if k not in ("rows", "values", "sql_used")}
        out["rows"] = self.rows(e.get("rows", []), kinds)
        shown = {v for r in out["rows"] for v in r.values() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        out["values"] = [v for v in e.get("values", []) if v in shown]
        out["sql_used"] = None if e.get("sql_used") is None else self._safe("sql_used", e["sql_used"], {})
        return out


def luhn_number(digits: str) -> bool:
    """The Luhn check of 13 to 19 digits."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return 13 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
