"""Ignore-file lines to rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TOKEN = re.compile(
    r"""(?sx)
    \\ (?P<escaped>.)
    | (?P<stars>\*+)
    | (?P<one>\?)
    | \[ (?P<negated>[!^]?+) (?P<members>\]?+ [^\]]*) \]
    | (?P<plain>.)
    """
)

RULE_LINE_SCHEMA = T.StructType(
    [
        T.StructField("negated", T.BooleanType()),
        T.StructField("dir_only", T.BooleanType()),
        T.StructField("path_pattern", T.BooleanType()),
        T.StructField("regex", T.StringType()),
    ]
)


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression for one glob, in the dialect of Spark's ``rlike``."""
    out, at = [], 0
    while at < len(glob):
        token = _TOKEN.match(glob, at)
        start, at = at, token.end()
        if token["stars"]:
            alone = (start == 0 or glob[start - 1] == "/") and glob[at : at + 1] in ("", "/")
            if token["stars"] != "**" or not alone:
                out.append("[^/]*")
            elif at == len(glob):
                out.append(".*")
            else:
                out.append("(?:.*/)?")
                at += 1
        elif token["one"]:
            out.append("[^/]")
        elif token["members"] is not None:
            members = re.sub(r"[\\\[\]]", lambda m: "\\" + m[0], token["members"])
            out.append("[" + ("^" if token["negated"] else "") + members + "]")
        else:
            out.append(_literal(token["escaped"] or token["plain"]))
    return "^" + "".join(out) + "$"


def _literal(char: str) -> str:
    return "\\" + char if char in r"\.[]{}()+-^$|*?" else char


def parse_rule_line(line: str, first_line: bool) -> dict | None:
    """The rule on one line of an ignore file; None for blanks and comments."""
    line = line.removesuffix("\r")
    if first_line:
        line = line.removeprefix("\ufeff")
    kept = line.rstrip(" ")
    escapes = len(kept) - len(kept.rstrip("\\"))
    if escapes % 2 and len(kept) < len(line):
        kept += " "
    if kept.startswith("#"):
        return None
    negated, dir_only = kept.startswith("!"), False
    pattern = kept[negated:]
    if pattern.endswith("/"):
        pattern, dir_only = pattern[:-1], True
    anchored = pattern.startswith("/")
    pattern = pattern[anchored:]
    if not pattern:
        return None
    return {
        "negated": negated,
        "dir_only": dir_only,
        "path_pattern": anchored or "/" in pattern,
        "regex": glob_to_regex(pattern),
    }


@F.pandas_udf(RULE_LINE_SCHEMA)
def _parse_rule(lines: pd.Series, line_nos: pd.Series) -> pd.DataFrame:
    columns = RULE_LINE_SCHEMA.names
    empty = dict.fromkeys(columns)
    rules = [parse_rule_line(line, no == 1) or empty for line, no in zip(lines, line_nos)]
    return pd.DataFrame(rules, columns=columns)


def parse_ignore_rule(line: Column, line_no: Column) -> Column:
    """Struct of a rule, with a NULL ``regex`` where the line holds none."""
    return _parse_rule(line, line_no)


@F.pandas_udf(T.StringType())
def _glob_regex(globs: pd.Series) -> pd.Series:
    return globs.map(glob_to_regex, na_action="ignore")


def glob_regex(glob: Column) -> Column:
    """:func:`glob_to_regex` over a column."""
    return _glob_regex(glob)
