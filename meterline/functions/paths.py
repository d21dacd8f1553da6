"""Project paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A worktree container is `.worktrees`, or `worktrees` under a hidden folder, followed by a name.
# The first container counts; the project is what stands before it.
_CONTAINER = r"(?s)^(.*?)/+(?:\.worktrees|\.[^/]*/+worktrees)/.+$"


# Each rule names its input once, so that nested rules stay small when they are inlined.

def trim_slashes(path: Column) -> Column:
    """Without trailing slashes; a bare root stays."""
    return F.regexp_replace(path, "(?s)(?<=.)/+$", "")


def project_root(path: Column) -> Column:
    """The repository a working directory belongs to, by the shape of the path alone."""
    trimmed = trim_slashes(path)
    # Few paths hold the word at all: the others never meet the longer pattern.
    return F.when(path.contains("worktrees/"), F.regexp_replace(trimmed, _CONTAINER, "$1")).otherwise(trimmed)


def project_label(path: Column) -> Column:
    """Last path segment; '/' and '' stay as they are."""
    return F.regexp_extract(trim_slashes(path), "(?s)([^/]+|^/)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column, suffix: str) -> Column:
    """File name without `suffix` (a plain string)."""
    name = file_name(path)
    return F.when(name.endswith(suffix),
                  F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)
