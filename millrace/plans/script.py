"""SQL scripts: several statements, named parameters, and the views they create.

A script takes effect as a whole or not at all: before it runs, the definition of every view and the presence of every table that it creates
is noted, and when a statement fails these are as they were before. Statements whose effect cannot be taken back are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Fixed value: how a statement that creates a view begins.
_CREATES_VIEW = re.compile(
    r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL\s+)?TEMP(?:ORARY)?\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"((?:`[^`]+`|\w+)(?:\s*\.\s*(?:`[^`]+`|\w+))*)",
    re.IGNORECASE,
)
_NAME = r"((?:`[^`]+`|\w+)(?:\s*\.\s*(?:`[^`]+`|\w+))*)"
_CREATES_TABLE = re.compile(rf"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}", re.IGNORECASE)
#: Statements that change or remove what is there.
_CHANGES = re.compile(
    r"(?:^|;|\bBEGIN\b|\bTHEN\b|\bDO\b)\s*(INSERT\s+(?:INTO|OVERWRITE)|DELETE\s+FROM|UPDATE|MERGE\s+INTO|TRUNCATE\s+TABLE|DROP\s+(?:TABLE|VIEW|DATABASE|SCHEMA)"
    rf"|ALTER\s+(?:TABLE|VIEW))\s+(?:TABLE\s+|IF\s+EXISTS\s+)?{_NAME}", re.IGNORECASE)
# Fixed value: comments, text in quotes, and quoted names (which are kept).
_NO_CODE = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", re.DOTALL)


@dataclass(frozen=True)
class ScriptResult:
    """What the last query of the script returned, and the views it created, in order."""

    result: DataFrame
    views: list[str] = field(default_factory=list)


def run_script(spark: SparkSession, sql: str, parameters: Mapping[str, Any] | None = None, atomic: bool = True) -> ScriptResult:
    """Run the statements of ``sql`` in order, with ``:name`` bound from ``parameters``.

    Spark's own scripting block takes them apart, so a semicolon inside text is data. The first failing statement ends the script, and
    all views and tables are as they were before. Until then other sessions may see views of the catalog that it has already made. Rows
    of tables that were there before cannot be taken back, so a script that changes them raises before anything runs; with
    ``atomic=False`` it runs, and what it has done by the time it fails stays.
    """
    body = sql.strip().rstrip(";").strip()
    if not body:
        raise ValueError("the script is empty")
    views, tables = created_views(body), _names(_CREATES_TABLE, body)
    undo = []
    if atomic:
        for verb, name in _CHANGES.findall(_code(body)):
            name = re.sub(r"[`\s]", "", name)
            if verb.split()[0].upper() not in ("INSERT",) or name not in tables or spark.catalog.tableExists(name):
                raise ValueError(f"{verb.upper()} {name} cannot be taken back when the script fails; run it with atomic=False")
        undo = [_restorer(spark, name, "VIEW") for name in views] + [_restorer(spark, name, "TABLE") for name in tables]
    try:
        result = spark.sql(f"BEGIN\n{body};\nEND", args=dict(parameters or {}))
    except BaseException:
        for restore in reversed(undo):
            restore()
        raise
    return ScriptResult(result, views)


def _restorer(spark: SparkSession, name: str, kind: str) -> Callable[[], None]:
    """What brings a name back to what it stands for now."""
    if not spark.catalog.tableExists(name):
        return lambda: _drop(spark, name, kind)
    if kind == "TABLE":
        return lambda: None  # creating a table that is there fails, or does nothing
    if spark.catalog.getTable(name).isTemporary:
        old = spark.table(name)
        return lambda: old.createOrReplaceTempView(name.removeprefix("global_temp.")) if not name.startswith("global_temp.") else old.createOrReplaceGlobalTempView(name[12:])
    text = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    return lambda: spark.sql(re.sub(r"^\s*CREATE\s+VIEW", "CREATE OR REPLACE VIEW", text, count=1)) and None


def _drop(spark: SparkSession, name: str, kind: str) -> None:
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP {kind} {name}")


def read_script(spark: SparkSession, path: str) -> str:
    """The text of a script file, from any file system Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def created_views(sql: str) -> list[str]:
    """The names in the script's CREATE VIEW statements; comments and quoted text are no statements."""
    return _names(_CREATES_VIEW, sql)


def _names(pattern: re.Pattern, sql: str) -> list[str]:
    return list(dict.fromkeys(re.sub(r"[`\s]", "", n) for n in pattern.findall(_code(sql))))


def _code(sql: str) -> str:
    """The script without comments and quoted text."""
    return _NO_CODE.sub(lambda m: m[0] if m[0].startswith("`") else " ", sql)
