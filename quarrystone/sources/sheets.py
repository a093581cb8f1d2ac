"""Questions to one landed sheet, and answers as a workbook."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quote


def top_groups(df: DataFrame, group: str, measure: str, n: int) -> DataFrame:
    """Totals of a text column that reads as numbers by a trimmed label, largest first; blank labels and other cells are left out."""
    value = F.col(quote(measure)).try_cast("double")
    label = F.trim(F.col(quote(group)).cast("string"))
    rows = df.select(label.alias(group), value.alias("__v")).where(F.col("__v").isNotNull() & (F.col(quote(group)) != ""))
    return rows.groupBy(quote(group)).agg(F.round(F.sum("__v"), 2).alias(measure)).orderBy(F.desc(measure), quote(group)).limit(n)


def total_where(df: DataFrame, measure: str, column: str, value: str) -> DataFrame:
    """The total of the rows whose trimmed cell equals the value exactly, and how many they are."""
    hit = F.trim(F.col(quote(column)).cast("string")) == value
    return df.where(hit).agg(F.round(F.sum(F.col(quote(measure)).try_cast("double")), 2).alias("total"), F.count("*").alias("n"))


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    text = str(v)
    text = "'" + text if text[:1] in "=+-@\t\r" else text
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def xlsx(rows: list[dict]) -> bytes:
    """A workbook with one sheet of an answer's rows; text that a spreadsheet would run gets a quote in front."""
    names = list(rows[0]) if rows else []
    body = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in [names, *([x.get(n) for n in names] for x in rows)])
    space = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="Answer" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
