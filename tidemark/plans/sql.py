"""SQL scripts with named parameters: the statements of a text, one after the other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A quoted string, a quoted name, a comment, or the end of a statement.
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)


def statements(text: str) -> list[str]:
    """Split at semicolons outside strings, quoted names and comments."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if m[0] == ";":
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [s.strip() for s in out if bare(s)]


def run_script(spark: SparkSession, text: str, args: dict[str, object] | None = None) -> DataFrame | None:
    """Run a script; parameters are written :name and bound, never pasted into the text.

    Returns the last statement's frame. A failure raises and the rest isn't run.
    """
    last = None
    for s in statements(text):
        used = {k: v for k, v in (args or {}).items() if re.search(rf":{re.escape(k)}\b", s)}
        last = spark.sql(s, args=used) if used else spark.sql(s)
    return last


def run_block(spark: SparkSession, text: str, args: dict[str, object] | None = None) -> DataFrame | None:
    """Run a script as one SQL scripting block, with variables, loops and handlers.

    Parameters are session variables of the block's names, set before it runs, so every statement
    sees them; a handler in the text decides what a failure undoes. Returns the last result.
    """
    for name, value in (args or {}).items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE `{name}` = ?", args=[value])
    return spark.sql(text)
