"""Catalogs: what a session's tables are, and a source's declared keys under the names that its tables landed with."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import SparkSession


def tables(spark: SparkSession, only: Iterable[str] = ("*",), never: Iterable[str] = ()) -> list[dict]:
    """Names, columns and types of the session's tables and views, by patterns without regard to case; no table is read."""
    keep, drop = [p.lower() for p in only], [p.lower() for p in never]
    out = []
    for t in spark.catalog.listTables():
        name = t.name.lower()
        if any(fnmatch.fnmatchcase(name, p) for p in keep) and not any(fnmatch.fnmatchcase(name, p) for p in drop):
            columns = [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(t.name)]
            out.append({"table": t.name, "temporary": t.isTemporary, "columns": columns})
    return sorted(out, key=lambda t: t["table"])


def normalised(found: list[dict]) -> list[dict]:
    """Names in lower case and types in one spelling; tables and columns that then have one name are an error, not merged."""
    spelled = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "real": "float", "varchar": "string"}
    out = []
    for t in found:
        columns = [{**c, "name": c["name"].lower(), "type": spelled.get(c["type"].lower(), c["type"].lower())} for c in t["columns"]]
        out.append({**t, "table": t["table"].lower(), "columns": columns})
    for names in ([t["table"] for t in out], *([c["name"] for c in t["columns"]] for t in out)):
        if len(set(names)) != len(names):
            raise ValueError(f"names that differ only in case: {', '.join(sorted(n for n in set(names) if names.count(n) > 1))}")
    return out


def landed(manifest: dict) -> dict:
    """The manifest of a source under the names of its landed tables.

    A table is named ``schema.table`` in the source and ``path`` where it landed. Declared keys whose tables landed are renamed;
    links of which an end did not land are listed by name in ``unlanded``, each once.
    """
    at = {f"{t['schema']}.{t['table']}": t["path"] for t in manifest.get("tables", [])}
    out = {"source": manifest.get("source", ""), "tables": [], "foreign_keys": [], "unlanded": []}
    keys = manifest.get("primary_keys", {})
    for t in manifest.get("tables", []):
        source = f"{t['schema']}.{t['table']}"
        out["tables"].append({"name": t["path"], "source": source, "truncated": bool(t.get("truncated")), "primary_key": list(keys.get(source, []))})
    for link in manifest.get("foreign_keys", []):
        ends = link["from_table"], link["to_table"]
        if all(e in at for e in ends):
            out["foreign_keys"].append({"name": link["name"], "child": at[ends[0]], "child_column": link["from_column"], "parent": at[ends[1]], "parent_column": link["to_column"], "position": link.get("position", 0)})
        elif (gone := {"name": link["name"], "from_table": ends[0], "to_table": ends[1]}) not in out["unlanded"]:
            out["unlanded"].append(gone)
    return out
