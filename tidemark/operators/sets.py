"""Unions and differences of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def scan_targets(listed: DataFrame, recent: DataFrame) -> DataFrame:
    """Listed endpoints, and recent ones that are not listed."""
    keys = ["ip", "port"]
    return listed.select(*keys).unionByName(
        recent.select(*keys).join(listed.select(*keys), keys, "left_anti"))


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def unify_info(newer: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both server-info shapes as one; fields that one shape lacks are null."""
    return newer.unionByName(legacy, allowMissingColumns=True)
