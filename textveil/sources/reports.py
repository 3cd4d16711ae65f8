"""Small reports out of the engine, and back: JSON, YAML, Markdown and a console table.

A report is what aggregates have left, a row or a few; it is collected, up to a bound, and formatted on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of a report at most; more are an error, not cut off.
ROWS = 1000


def records(df: DataFrame) -> list[dict]:
    found = df.limit(ROWS + 1).collect()
    if len(found) > ROWS:
        raise ValueError(f"a report has {ROWS} rows at most")
    return [r.asDict(recursive=True) for r in found]


def report(**parts: DataFrame) -> dict[str, dict | list[dict]]:
    """One tree: a part of one row is that row, another one is a list of rows."""
    out: dict[str, dict | list[dict]] = {}
    for name, df in parts.items():
        rows = records(df)
        out[name] = rows[0] if len(rows) == 1 else rows
    return out


def write_json(tree: Mapping, path: str | Path) -> None:
    Path(path).write_text(json.dumps(tree, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def write_yaml(tree: Mapping, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(json.loads(json.dumps(tree, default=str)), allow_unicode=True, sort_keys=False), encoding="utf-8")


def read_tree(path: str | Path) -> dict:
    """A JSON file, by its suffix, or a YAML one; an empty file is an empty tree."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text) if text.strip() else {}
    import yaml

    return yaml.safe_load(text) or {}


def _cell(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.4f}"
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, title: str | None = None) -> str:
    rows, names = records(df), df.columns
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(_cell(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def console(df: DataFrame) -> str:
    """The rows as columns of equal width, numbers to the right."""
    rows, names = records(df), df.columns
    cells = [[_cell(r[n]) for n in names] for r in rows]
    width = [max(len(n), *(len(c[k]) for c in cells), 0) if cells else len(n) for k, n in enumerate(names)]
    right = [all(isinstance(r[n], int | float) for r in rows) and bool(rows) for n in names]
    line = lambda c: "  ".join(x.rjust(w) if right[k] else x.ljust(w) for k, (x, w) in enumerate(zip(c, width, strict=True))).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, cells)]) + "\n"
