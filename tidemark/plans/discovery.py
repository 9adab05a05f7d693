"""Server discovery from landed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import REGIONS, region_codes
from tidemark.operators import aggregates as ag
from tidemark.operators.windows import dedupe
from tidemark.sources.readers import read_server_list


def discover(spark: SparkSession, path: str, game: str = "tf") -> tuple[DataFrame, DataFrame]:
    """(endpoints, accepted per region) of all landed region lists."""
    accepted = read_server_list(spark, path, game)
    return accepted.select("ip", "port").distinct(), ag.region_counts(accepted)


def region_table(spark: SparkSession) -> DataFrame:
    """(name, code): the codes a region name stands for."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("name"))
    return names.select("name", F.explode(region_codes(F.col("name"))).alias("code"))


def find(listed: DataFrame, region: str = "all", duplicates: str = "skip") -> DataFrame:
    """``listed(ip, port, region_code, position)`` of a region, repeats treated as asked."""
    codes = REGIONS.get(region.lower())
    if codes is None:
        raise ValueError(f"unknown region {region!r}")
    return dedupe(listed.filter(F.col("region_code").isin(codes)), ["ip", "port"], "position", duplicates)
