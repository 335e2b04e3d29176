"""Sinks: flat CSV, JSON summaries, one-file HTML reports, manifests."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_ROWS = 40  #: rows of a table in a report: a top-k listing


def flattened(df: DataFrame) -> DataFrame:
    """Structs as ``prefix.key`` columns, arrays and maps as JSON text."""

    def walk(kind: T.DataType, col, name: str):
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(f.dataType, col.getField(f.name), f"{name}.{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType | T.MapType):
            return [F.to_json(col).alias(name)]
        return [col.alias(name)]

    return df.select(*[c for f in df.schema.fields for c in walk(f.dataType, F.col(f"`{f.name}`"), f.name)])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header; the writers stay distributed."""
    flattened(df).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """``local_path<TAB>url`` lines."""
    df.select("local_path", "url").write.mode("overwrite").option("sep", "\t").csv(path)


def write_json(summary: DataFrame, path: str) -> None:
    """A summary of one row as an indented file."""
    row = summary.limit(1).collect()
    with open(path, "w") as out:
        json.dump(row[0].asDict(recursive=True) if row else {}, out, indent=2, default=str)


def card(label: str, value) -> str:
    shown = f"{value:.4g}" if isinstance(value, float) else str(value)
    return f"<div class=card><b>{html.escape(shown)}</b><span>{html.escape(label)}</span></div>"


def table(df: DataFrame, rows: int = TABLE_ROWS) -> str:
    """The first rows as an HTML table; numbers to four digits, text escaped."""
    cells = lambda r: "".join(f"<td>{html.escape(f'{v:.4g}' if isinstance(v, float) else '' if v is None else str(v))}</td>" for v in r)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join(f"<tr>{cells(r)}</tr>" for r in df.limit(rows).collect()) + "</table>"


def write_html(path: str, title: str, cards: dict, tables: dict[str, DataFrame]) -> None:
    """A report of one file: cards, then ranked tables."""
    body = "".join(card(k, v) for k, v in cards.items()) + "".join(f"<h2>{html.escape(k)}</h2>{table(df)}" for k, df in tables.items())
    with open(path, "w") as out:
        out.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}")


def write_summary(path: str, parts: dict) -> None:
    """Values and the rows of small tables, one to a key, as an indented JSON file; a table of one row is that row."""
    held = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = [r.asDict(recursive=True) for r in part.limit(TABLE_ROWS).collect()]
            part = rows[0] if len(rows) == 1 else rows
        held[name] = part
    with open(path, "w") as out:
        json.dump(held, out, indent=2, default=str)
