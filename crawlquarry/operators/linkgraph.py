"""Link checks: reach of a page graph and totals of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import urls
from crawlquarry.session import materialize

#: Endings of paths that a link check goes into.
PAGE_ENDINGS = ("/", ".html", ".htm", ".php", ".asp", ".aspx")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): breadth-first reach of ``seeds`` (url) over ``edges`` (source, target), at most ``depth`` steps."""
    e = edges.select("source", "target").distinct()
    seen = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reach")
    for step in range(1, depth + 1):
        front = seen.where(F.col("depth") == step - 1).select(F.col("url").alias("source"))
        new = e.join(front, "source", "left_semi").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        new = materialize(new, "reach")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def recursable(url: str, base: str) -> Column:
    """Whether a link check goes on from ``url``: on the host and port of ``base``, with an empty path or one that ends like a page's."""
    path = F.lower(urls.path(url))
    ends = path == ""
    for e in PAGE_ENDINGS:
        ends = ends | path.endswith(e)
    return (urls.netloc(url) == urls.netloc(base)) & ends


def check_reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what a recursive link check looks at. Every link of a visited page is checked; only recursable ones are visited in turn."""
    e = edges.select("source", "target").distinct().withColumn("onward", recursable("target", "source"))
    # A page can be checked from another host before a link of its own host leads into it, so visits are kept apart from checks.
    visited = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reach")
    for step in range(1, depth):
        front = visited.where(F.col("depth") == step - 1).select(F.col("url").alias("source"))
        new = e.where("onward").join(front, "source", "left_semi").select(F.col("target").alias("url")).distinct().join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        new = materialize(new, "reach")
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
    sources = visited.where(F.col("depth") < depth).select(F.col("url").alias("source"), "depth")
    checked = e.join(sources, "source").select(F.col("target").alias("url"), (F.col("depth") + 1).alias("depth"))
    return checked.unionByName(visited).groupBy("url").agg(F.min("depth").alias("depth"))


def check_summary(checks: DataFrame, status: str) -> DataFrame:
    """One row: links by outcome."""
    s = F.col(status)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return checks.agg(F.count("*").alias("links"), n(s.between(200, 299)).alias("ok"), n(s.between(300, 399)).alias("redirect"), n(s.isNull() | (s >= 400)).alias("broken"))
