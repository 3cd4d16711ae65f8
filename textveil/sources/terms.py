"""Term lists and vocabularies: one entry a line, "#" comments and blank lines left out."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by order; ties by nothing, so order must be unique within a key."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def vocabulary(lines: DataFrame) -> DataFrame:
    """word, line: lower-case alphabetic words of lines (line, value), the first occurrence of each."""
    words = lines.select("line", F.lower(F.trim("value")).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    return ordered_distinct(words, "word", "line")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Entries of a list that is read to the driver, since it becomes part of a plan."""
    rows = spark.read.text(path, wholetext=True).collect()
    lines = [x.strip() for r in rows for x in r.value.splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def load_terms(spark: SparkSession, path: str | None, inline: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The file's terms, else the inline ones; a missing or empty file warns and gives none."""
    if path is None:
        return inline
    try:
        found = tuple(dict.fromkeys(x.lower() for x in read_lines(spark, path)))
    except Exception as e:  # Spark has no narrower class for a path it cannot read
        warnings.warn(f"no terms are protected: {path} can't be read ({str(e).splitlines()[0]})", stacklevel=2)
        return ()
    if not found:
        warnings.warn(f"no terms are protected: {path} is empty", stacklevel=2)
    return found


def load_vocabulary(spark: SparkSession, path: str) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(x for x in (w.lower() for w in read_lines(spark, path)) if x.isalpha()))
    if not found:
        raise ValueError(f"{path} holds no words")
    return found


def union_terms(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """All entries, the first of those that differ in case only."""
    seen: dict[str, str] = {}
    for x in (x for some in lists for x in some):
        seen.setdefault(x.lower(), x)
    return tuple(seen.values())


def write_terms(entries: tuple[str, ...], path: str) -> None:
    """A list as a file, one entry a line."""
    from pathlib import Path

    Path(path).write_text("".join(f"{x}\n" for x in entries), encoding="utf-8")


def terms_of_settings(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The terms that a settings file names, inline (terms) or in a file (terms_file); none if there are neither."""
    from pathlib import Path

    import yaml

    from textveil.config import resolve

    tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    token = tree.get("token", {})
    inline = tuple(token.get("terms", ()))
    if token.get("terms_file"):
        found = resolve(token["terms_file"], Path(path).parent)
        return union_terms(inline, load_terms(spark, str(found)))
    return inline
