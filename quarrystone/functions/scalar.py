"""Scalar building blocks as native column expressions, with a Python twin only where exact Unicode folding is needed."""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

#: Contract type names and their Spark types; a bare decimal has two places, a naive timestamp no zone.
TYPES = {
    "text": "string", "varchar": "string", "string": "string", "integer": "int", "int": "int", "bigint": "bigint",
    "decimal": "decimal(18,2)", "numeric": "decimal(18,2)", "number": "decimal(18,2)", "float": "double", "double": "double",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
}


def spark_type(name: str) -> str:
    """The Spark type of a contract type; decimal(p,s) is honoured exactly; any other name is an error that lists the known ones."""
    name = name.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", name):
        return f"decimal({m[1]},{m[2]})"
    if name not in TYPES:
        raise ValueError(f"unknown column type {name!r}; supported: {', '.join(sorted(TYPES))}, decimal(p,s)")
    return TYPES[name]


def try_cast(c: Column, kind: str) -> Column:
    """Null instead of an error; text that is no whole number does not become an integer."""
    return c.try_cast(kind)


def quote(name: str) -> str:
    """A name as one quoted identifier, whatever it holds."""
    if not name or "\0" in name:
        raise ValueError("an identifier is not empty and holds no NUL")
    return "`" + name.replace("`", "``") + "`"


def safe_stem(stem: str) -> str:
    """A table name from a file name: lower-case letters, digits and underscores, not starting with a digit."""
    out = re.sub(r"[^a-z0-9]+", "_", stem.lower()).strip("_") or "table"
    return f"t_{out}" if out[0].isdigit() else out


#: Letters that become two or three; all others that fold become one, by the rule of ``_plain_letters``.
LIGATURES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@functools.cache
def _plain_letters() -> tuple[str, str]:
    """Lower-case letters and digits of the basic plane whose compatibility form, without marks, is one other character, and those."""
    pairs = []
    for i in range(0x80, 0x10000):
        c = chr(i)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M").lower()
        if len(plain) == 1 and plain != c and unicodedata.category(c)[0] in "LN" and c.lower() == c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(value: object) -> str:
    """Case, accents, punctuation and padding removed; words and their order stay. The same rule as ``folded``."""
    text = ("" if value is None else str(value)).lower()
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    text = text.translate(str.maketrans(*_plain_letters()))
    kept = ((c, unicodedata.category(c)[0]) for c in text)
    return " ".join("".join(c if k in "LN" else " " for c, k in kept if k != "M").split())


def folded(c: Column) -> Column:
    """``fold`` as an expression that stays in the JVM: one table of single letters, a few ligatures, then marks and punctuation go."""
    low = F.lower(c.cast("string"))
    for a, b in LIGATURES.items():
        low = F.replace(low, F.lit(a), F.lit(b))
    low = F.regexp_replace(F.translate(low, *_plain_letters()), r"\p{M}+", "")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def duckdb_round(c: Column, places: int) -> Column:
    """Rounding of doubles on their binary value, without the detour over decimal text."""
    scale = 10.0**places
    scaled = c * scale
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale


def neutral(c: Column) -> Column:
    """CSV cells that a spreadsheet would run as a formula get a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def day_bounds(c: Column, first: str, last: str) -> Column:
    """Half-open bounds of whole days: from the start of ``first`` to before the day after ``last``."""
    return (c >= F.lit(first).cast("date")) & (c < F.date_add(F.lit(last).cast("date"), 1))


def _plain(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"bool:{str(value).lower()}"
    if isinstance(value, (int, float, Decimal)):
        return f"num:{float(value):.10f}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"time:{value.isoformat()}"
    return f"{'str' if isinstance(value, str) else 'other'}:{value}"


def result_hash(rows: list) -> str:
    """One hash of a result: typed values, numbers at ten places, row order and column names ignored, duplicates kept."""
    escape = str.maketrans({"\\": "\\\\", "\x1e": "\\x1e", "\x1f": "\\x1f"})
    lines = sorted("\x1f".join(_plain(v).translate(escape) for v in (r.values() if isinstance(r, dict) else r)) for r in rows)
    return hashlib.sha256("\x1e".join(lines).encode()).hexdigest()


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Both hold rows, and the same set of them: column names and repeats ignored, numbers compared at four places."""
    def shape(df: DataFrame) -> DataFrame:
        def cell(name: str, kind: DataType) -> Column:
            c = F.col(quote(name))
            numeric = isinstance(kind, DecimalType) or kind.typeName() in ("double", "float", "integer", "long", "short", "byte")
            return F.round(c.cast("double"), 4) if numeric else c
        return df.select(*[cell(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]).distinct()

    a, b = shape(left), shape(right)
    if len(a.columns) != len(b.columns) or a.isEmpty() or b.isEmpty():
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
