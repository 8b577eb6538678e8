"""HTTP header and DNS response queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.functions.summaries import rank_first
from floodlens.operators import geo


def http_field_frequency(http: DataFrame) -> DataFrame:
    """Occurrences per header value, most first."""
    return (
        http.groupBy("field").agg(F.count("field").alias("count"))
        .orderBy(*rank_first("count", "field"))
    )


def http_fields_per_source(http: DataFrame) -> DataFrame:
    """Distinct header values per (source, value)."""
    return http.groupBy("src", "field").agg(F.count_distinct("field").alias("count"))


def http_countries(http: DataFrame, geo_dim: DataFrame) -> DataFrame:
    """HTTP rows per source country, summed per source before the lookup."""
    per_source = http.groupBy("src").agg(F.count("*").alias("n"))
    return (
        geo.geo_country(per_source, "src", geo_dim)
        .groupBy("country").agg(F.sum("n").alias("count"))
    )


def dns_response_ttl(dns: DataFrame) -> DataFrame:
    """DNS answers with a positive TTL per (name, TTL)."""
    return (
        dns.filter((F.col("mode") == "response") & (F.col("ttl") > 0))
        .groupBy("name", "ttl").agg(F.count("ts").alias("count"))
    )
