"""Source trees on a file system as tables."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a scan of Python files skips. Fixed values.
SKIPPED = [".claude", ".git", ".venv", "__pycache__", "venv"]


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py", excludes: list[str] | None = None, skipped: list[str] | None = None) -> DataFrame:
    """(path, version, text, mtime) of the files under ``root``, without skipped
    directories and paths that hold an exclude as a substring."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = Path(root).resolve().as_posix()
    path = F.regexp_replace("path", r"^file:/*", "/")
    rows = files.select(F.replace(path, F.lit(base + "/"), F.lit("")).alias("path"), F.lit("head").alias("version"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in (SKIPPED if skipped is None else skipped)])))
    for e in excludes or []:
        rows = rows.where(~F.contains("path", F.lit(e)))
    return rows


#: Directories and suffixes of scripts that aren't a project's own. Fixed values.
FOREIGN_SCRIPTS = r"(^|/)(node_modules|vendor|dist|build)/|\.(min|bundle)\.js$"


def own_scripts(path: Column) -> Column:
    """Whether a path is that of a script of the project's own, neither vendored nor generated."""
    return path.endswith(".js") & ~path.rlike(FOREIGN_SCRIPTS)


def parse_excludes(text: str, given: list[str] | None = None) -> list[str]:
    """Excludes of a configuration's text, then those given, each once; a wrong type raises."""
    found = tomllib.loads(text).get("excludes", [])
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise TypeError("excludes must be a list of strings")
    return list(dict.fromkeys([*found, *(given or [])]))


def config_excludes(root: str, given: list[str] | None = None, name: str = "corvane.toml") -> list[str]:
    """``parse_excludes`` of the configuration file of a tree, if it has one."""
    path = Path(root) / name
    return parse_excludes(path.read_text() if path.exists() else "", given)


def resolve_member_lines(text: str) -> list[tuple[str, str]]:
    """(role, reference) of lines "[role:]ref"; # starts a comment, the default role is caller."""
    out = []
    for line in text.splitlines():
        bare = line.split("#", 1)[0].strip()
        role, sep, ref = bare.partition(":")
        known = sep and role in ("caller", "callee", "test") and not ref.startswith(":")
        if bare:
            out.append((role, ref.strip()) if known else ("caller", bare))
    return out
