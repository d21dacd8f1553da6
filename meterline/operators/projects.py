"""Project attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.money import COST
from meterline.functions.paths import project_root, trim_slashes
from meterline.operators.bounded import broadcast_if_small
from meterline.schemas import TOKEN_COLUMNS
from meterline.session import settled


def with_project(events: DataFrame) -> DataFrame:
    """`project` by the shape of `cwd`: a projection, no shuffle."""
    return events.withColumn("project", project_root(F.col("cwd")))


def resolve_roots(paths: DataFrame, repo_roots: DataFrame, home: str = "") -> DataFrame:
    """Distinct `cwd` -> `project` by the nearest known repository above it.

    `repo_roots(path, git_dir)`: `git_dir` is null for a plain checkout; a linked
    worktree names its admin folder, whose main tree ends at the first `/.git/`.
    A folder at or above `home` never counts, and paths nothing is known about
    fall back to the shape rule.
    """
    distinct = paths.select("cwd").distinct().withColumn("here", trim_slashes(F.col("cwd")))
    # /a/b/c -> [/a/b/c, /a/b, /a], nearest first.
    parts = F.split("here", "/")
    steps = F.size(parts) - 1
    ancestors = F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda up: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/"))
    walk = distinct.filter((F.col("cwd") != "") & (steps > 0)).select(
        "cwd", F.posexplode(ancestors).alias("up", "path")).filter(F.length("path") > 1)
    if home:
        # Below home the walk stops when it reaches home; paths elsewhere never meet it.
        top = home.rstrip("/")
        under = F.startswith(F.concat("cwd", F.lit("/")), F.lit(top + "/"))
        walk = walk.filter(~under | (F.length("path") > len(top)))
    main_tree = F.when(F.col("git_dir").isNull(), F.col("path")).when(
        F.locate("/.git/", F.col("git_dir")) > 1, F.substring_index("git_dir", "/.git/", 1))
    hits = (walk.join(repo_roots.select("path", main_tree.alias("root")), "path")
            .groupBy("cwd").agg(F.min_by(F.struct("root"), "up")["root"].alias("root")))
    return (distinct.join(hits, "cwd", "left")
            .select("cwd", F.coalesce("root", project_root(F.col("cwd"))).alias("project")))


def attach_roots(events: DataFrame, repo_roots: DataFrame, home: str = "") -> DataFrame:
    roots = broadcast_if_small(settled(resolve_roots(events, repo_roots, home)))
    return events.drop("project").join(roots, "cwd", "left")


def merge_projects(totals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key per-project totals onto new roots, many to one; unmapped projects stay."""
    renamed = totals.join(mapping.select("project", "new_project"), "project", "left").withColumn(
        "project", F.coalesce("new_project", "project"))
    return renamed.groupBy("project").agg(
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("events").alias("events"),
        F.sum("cost_usd").cast(COST).alias("cost_usd"))
