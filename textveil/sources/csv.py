"""Corpus CSV in and out, under a strict contract: ID, Author, Text, HS in every row; other columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUIRED = ("ID", "Author", "Text", "HS")
# Accepted spellings of each column, the exact one first.
ALIASES = {"ID": ("ID", "id"), "Author": ("Author", "author"), "Text": ("Text", "text"), "HS": ("HS", "hs")}
BAD = "_corrupt_record"


class ContractError(ValueError):
    """A file that breaks the contract."""


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the file's first record."""
    try:
        names = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"').columns
    except Exception as e:  # Spark has no narrower class for a path it cannot read
        raise ContractError(f"{path}: {str(e).splitlines()[0]}") from e
    if not names:
        raise ContractError(f"{path} is empty")
    return names


def _load(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in [*names, BAD]])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True)
    # one empty field too many is a trailing comma, which is allowed
    broken = F.col(BAD).isNotNull() & ~((F.size(F.split(F.col(BAD), ",")) == len(names) + 1) & F.col(BAD).endswith(","))
    first = rows.select("*").where(broken).limit(1).collect()
    if first:
        raise ContractError(f"{path}: a row doesn't have {len(names)} fields: {first[0][BAD][:200]!r}")
    return rows.drop(BAD).na.fill("")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The strict contract; empty fields are empty strings, never null."""
    names = header(spark, path)
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ContractError(f"{path} has no column {', '.join(missing)}")
    return _load(spark, path, names)


def read_loose(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """Any CSV that has the required columns."""
    names = header(spark, path)
    missing = [c for c in required if c not in names]
    if missing:
        raise ContractError(f"{path} has no column {', '.join(missing)}")
    return _load(spark, path, names)


def read_compatible(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The strict contract, else the four columns under accepted spellings; and what each was called in the file."""
    names = header(spark, path)
    found = {c: next((a for a in spellings if a in names), None) for c, spellings in ALIASES.items()}
    if not all(found.values()):
        raise ContractError(f"{path} has no column {', '.join(c for c, a in found.items() if a is None)}")
    rows = _load(spark, path, names)
    if all(c == a for c, a in found.items()):
        return rows, {c: c for c in REQUIRED}
    return rows.select(*(F.col(a).alias(c) for c, a in found.items())), found  # type: ignore[arg-type]


def read_any_case(spark: SparkSession, path: str) -> DataFrame:
    """The four columns whatever the case of their names."""
    names = {c.lower(): c for c in reversed(header(spark, path))}
    missing = [c for c in REQUIRED if c.lower() not in names]
    if missing:
        raise ContractError(f"{path} has no column {', '.join(missing)}")
    return _load(spark, path, header(spark, path)).select(*(F.col(names[c.lower()]).alias(c) for c in REQUIRED))


def coalesced(rows: DataFrame) -> DataFrame:
    """The four columns, each from its name or, where that is missing or empty, from its lower-case alias."""
    out = []
    for c, spellings in ALIASES.items():
        have = [F.nullif(F.col(f"`{a}`").cast("string"), F.lit("")) for a in spellings if a in rows.columns]
        out.append(F.coalesce(*have, F.lit("")).alias(c))
    return rows.select(*out)


def write_corpus(rows: DataFrame, path: str, names: dict[str, str] | None = None, one_file: bool = False, mode: str = "errorifexists") -> None:
    """A folder of CSV parts with a header each; columns in order, renamed back if names (canonical to source) is given."""
    rows = rows.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias((names or {}).get(c, c)) for c in rows.columns))
    (rows.coalesce(1) if one_file else rows).write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode=mode, lineSep="\n")


def append_corpus(rows: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """More parts in the folder of a corpus, each with a header of its own; the folder is made by the first."""
    write_corpus(rows, path, names, mode="append")


def write_canonical(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The four columns, in order."""
    write_corpus(rows.select(*REQUIRED), path, mode=mode)


def write_privatized(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """ID and Text."""
    write_corpus(privatized_view(rows), path, mode=mode)


def privatized_view(rows: DataFrame) -> DataFrame:
    return rows.select("ID", "Text")


def write_token_log(privatized: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines keyed by the row's ordinal only; they name no author and no ID."""
    privatized.select(F.col("row_idx").alias("row"), F.size("token_log").alias("n_tokens"), F.col("token_log").alias("tokens")).write.json(path, mode=mode, ignoreNullFields=False)


def write_audit(rewritten: DataFrame, path: str, mode_name: str, mode: str = "errorifexists") -> None:
    rewritten.select(F.col("row_idx").alias("row"), F.lit(mode_name).alias("mode"), "audit").write.json(path, mode=mode, ignoreNullFields=False)


AUDIT = "row long, mode string, audit struct<fallback:boolean,fallback_reason:string,k_valid:int>"


def read_audit(lines: DataFrame) -> DataFrame:
    """row, fallback, k_valid of JSON lines (value); lines that aren't such JSON are left out."""
    parsed = lines.select(F.from_json("value", AUDIT).alias("r")).where("r.row is not null")
    return parsed.select("r.row", F.coalesce("r.audit.fallback", F.lit(False)).alias("fallback"), F.coalesce("r.audit.k_valid", F.lit(0)).alias("k_valid"))
