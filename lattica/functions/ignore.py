"""Ignore files: ordered rules as expressions in which the last match decides."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.paths import ancestors, basename, parent
from lattica.functions.text import col, split_lines

#: Name of the files that hold rules (fixed value).
RULES_FILE = ".gitignore"


class Rule(NamedTuple):
    keep: bool
    regex: str


def rule(line: str, folder: str = "") -> Rule | None:
    """The rule of a line in an ignore file of ``folder`` ('' or 'a/b/'); null for comments and blank lines.

    The regex is for paths from the top, folders with a closing slash. A slash at the beginning or inside ties a rule to its
    folder, one at the end restricts it to folders; ``*``, ``?`` and ``[...]`` stay within a component, ``**`` doesn't.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[keep:]
    only_folders = line.endswith("/")
    body = line.rstrip("/")
    if not body:
        return None
    tied = "/" in body
    parts = body.lstrip("/").split("/")
    out = "" if tied else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _component(part) + ("" if last else "/")
    return Rule(keep, "(?s)^" + re.escape(folder) + out + (r"/\z" if only_folders else r"/?\z"))


def _component(glob: str) -> str:
    """A regex for one path component; an unclosed bracket stands for itself."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "\\" and k < len(glob):
            out += re.escape(glob[k])
            k += 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (m := re.compile(r"([!^]?)(\]?[^\]]*)\]").match(glob, k)):
            out += "[" + ("^/" if m[1] else "") + re.sub(r"([\[\]\\&^])", r"\\\1", m[2]) + "]"
            k = m.end()
        else:
            out += re.escape(c)
    return out


def _prefixes(path: Column) -> Column:
    """The folders above a path from the top, each with a slash, then the path."""
    return F.concat(ancestors(path), F.array(path))


def ignored(path: Column | str, lines: Iterable[str]) -> Column:
    """Whether a relative path is ignored by rules of the top folder; null paths give null.

    Neighbouring rules of one sign are one regex. As nothing below an ignored folder can be taken back, a path is ignored if
    the last rule that matches it, or a folder above it, ignores.
    """
    runs: list[Rule] = []
    for r in filter(None, map(rule, lines)):
        if runs and runs[-1].keep == r.keep:
            runs[-1] = Rule(r.keep, runs[-1].regex + "|" + r.regex)
        else:
            runs.append(r)

    def verdict(p: Column) -> Column:
        out = F.when(F.lit(False), True)
        for r in reversed(runs):
            out = out.when(p.rlike(r.regex), not r.keep)
        return out.otherwise(False)

    return F.when(col(path).isNotNull(), F.exists(_prefixes(col(path)), verdict))


@F.pandas_udf(T.StructType().add("keep", T.BooleanType()).add("regex", T.StringType()))
def _rules(line: pd.Series, folder: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule(a, b) or (None, None) for a, b in zip(line, folder, strict=True)], columns=["keep", "regex"])


def rules_of(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(folder, rules): for each folder with an ignore file its rules in order."""
    own = files.filter(basename(path) == RULES_FILE).select(F.when(F.col(path).contains("/"), F.concat(parent(path), F.lit("/"))).otherwise("").alias("folder"), F.posexplode(split_lines(content)).alias("n", "line"))
    each = own.withColumn("r", _rules("line", "folder")).filter("r.regex IS NOT NULL")
    return each.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("n", "r.keep", "r.regex"))).alias("rules"))


def without_ignored(files: DataFrame, rules: DataFrame, path: str = "file_path") -> DataFrame:
    """Files whose relative paths the ignore files of their own and all upper folders let through; null paths are let through.

    A path's rules are those of its folders from the top down, so an inner file has the last word. They are put together once
    for each folder that holds files, by equality of folder names; files meet them by their folder, and a file's test is
    an expression. Folders without rules have no row, so a hot folder without any moves nothing but its name.
    """
    folder = F.when(F.col(path).contains("/"), F.concat(parent(path), F.lit("/"))).otherwise("")
    held = files.withColumn("_folder", folder)
    folders = held.filter(F.col(path).isNotNull()).select("_folder").distinct()
    up = folders.select("_folder", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(ancestors(F.col("_folder"))))).alias("folder"))
    met = up.join(rules, "folder").groupBy("_folder").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.length("folder").alias("n"), "rules"))), lambda s: s["rules"])).alias("_rules"))
    last = lambda p: F.aggregate("_rules", F.lit(False), lambda s, r: F.when(F.regexp(p, r["regex"]), ~r["keep"]).otherwise(s))
    ignored_here = F.coalesce(F.exists(_prefixes(F.col(path)), last), F.lit(False))
    return held.join(met, "_folder", "left").filter(~ignored_here).select(*files.columns)
