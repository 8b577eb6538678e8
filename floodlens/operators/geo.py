"""Network and location lookups for IPv4 addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.addresses import ipv4_to_long, prefix_bounds
from floodlens.functions.geodesy import great_circle_km

UNKNOWN_COUNTRY = "--"


_WIDE = 8  # networks of at most 8 bits: there are 511 of them


def _nearest(addresses: DataFrame, ip_col: str, networks: DataFrame) -> DataFrame:
    """`ip_col` and `_found` of the network with the smallest `_order` that holds each address.

    `addresses` has distinct `ip_col` and their number `_ip`; `networks` has one row per
    (`_length`, `_network`). They meet by equality, one candidate per length in use. Networks of
    up to 8 bits hold large parts of all addresses, so these few go to every task instead.
    """
    keys = ["_length", "_network"]
    in_use = networks.agg(F.collect_set("_length")).scalar()
    keyed = addresses.select(ip_col, "_ip", F.explode(in_use).alias("_length")).withColumn(
        "_network", F.expr("shiftright(_ip, 32 - _length)"))
    wide = F.col("_length") <= _WIDE
    met = keyed.where(wide).join(F.broadcast(networks.where(wide)), keys).unionByName(
        keyed.where(~wide).join(networks.where(~wide), keys))
    return met.groupBy(ip_col).agg(F.min_by("_found", "_order").alias("_found"))


def _range_networks(ranges: DataFrame) -> DataFrame:
    """Ranges as the largest networks inside them: `_length`, `_network`.

    Of the aligned blocks of 2^k addresses inside a range, only the first one with an odd and the
    last one with an even number are not part of a larger block inside; so a range of whatever
    size has at most two for each k.
    """
    def ends(k: Column) -> Column:
        first = F.ceil((F.col("range_start") / F.pow(F.lit(2), k))).cast("long")
        last = (F.floor((F.col("range_end") + 1) / F.pow(F.lit(2), k)) - 1).cast("long")
        length = (F.lit(32) - k).cast("int").alias("_length")
        return F.array(
            F.when((first <= last) & (first % 2 == 1),
                   F.struct(length, first.alias("_network"))),
            F.when((first <= last) & (last % 2 == 0)
                   & ((first < last) | (first % 2 == 0)),
                   F.struct(length, last.alias("_network"))))

    blocks = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), ends)),
                      lambda x: x.isNotNull())
    return ranges.select("*", F.inline(blocks))


def range_lookup(addresses: DataFrame, ip_col: str, ranges: DataFrame,
                 attributes: Sequence[str]) -> DataFrame:
    """Attributes of each distinct address from a table of address ranges.

    `ranges` has `range_start` and `range_end` (inclusive numbers). Addresses are made distinct
    first, which also takes the weight off a hot one. Ranges become networks, one row each, and
    meet the addresses by equality. Where ranges overlap, the narrowest wins. Result: `ip_col` and
    the attributes, matched addresses only.
    """
    numbers = (
        addresses.select(ip_col).distinct()
        .select(ip_col, ipv4_to_long(ip_col).alias("_ip"))
        .filter(F.col("_ip").isNotNull())
    )
    order = F.struct(F.col("range_end") - F.col("range_start"), *attributes)
    networks = _range_networks(
        ranges.where("range_start <= range_end").select("range_start", "range_end", *attributes)
    ).groupBy("_length", "_network").agg(
        F.min(order).alias("_order"), F.min_by(F.struct(*attributes), order).alias("_found"))
    return _nearest(numbers, ip_col, networks).select(
        ip_col, *[F.col("_found")[a].alias(a) for a in attributes])


def with_location(df: DataFrame, ip_col: str, geo_dim: DataFrame,
                  attributes: dict[str, Column]) -> DataFrame:
    """`df` plus attributes of the range of `ip_col`.

    `attributes` maps output names to expressions over `geo_dim`; an address without a range has
    nulls. The join back is on one row per address; adaptive execution splits a hot address.
    """
    source = geo_dim.select("range_start", "range_end",
                            *[expr.alias(name) for name, expr in attributes.items()])
    found = range_lookup(df, ip_col, source, list(attributes))
    return df.join(found, ip_col, "left").select(*df.columns, *attributes)


def lat_lon() -> Column:
    """Location text `lat lon`."""
    return F.concat(F.col("lat").cast("string"), F.lit(" "), F.col("lon").cast("string"))


def geo_country(df: DataFrame, ip_col: str, geo_dim: DataFrame) -> DataFrame:
    """`df` plus the country code; unknown addresses have `--`."""
    return with_location(df, ip_col, geo_dim, {"country": F.col("country")}).withColumn(
        "country", F.coalesce("country", F.lit(UNKNOWN_COUNTRY)))


def geo_city(df: DataFrame, ip_col: str, geo_dim: DataFrame) -> DataFrame:
    """`df` plus the city, null if unknown."""
    return with_location(df, ip_col, geo_dim, {"city": F.col("city")})


def geo_latlon(df: DataFrame, ip_col: str, geo_dim: DataFrame) -> DataFrame:
    """`df` plus the location as `lat lon` text, null if unknown."""
    return with_location(df, ip_col, geo_dim, {"latlon": lat_lon()})


def geo_asnum(df: DataFrame, ip_col: str, geo_dim: DataFrame) -> DataFrame:
    """`df` plus the organisation / autonomous system text, null if unknown."""
    return with_location(df, ip_col, geo_dim, {"asnum": F.col("asnum")})


def geo_region_timezone(df: DataFrame, region_dim: DataFrame, tz_dim: DataFrame) -> DataFrame:
    """`df` (with `country`, `region`) plus region name and time zone.

    A region name needs country and region. A zone row without region holds for every region of
    its country that has no row of its own.
    """
    names = region_dim.select(
        F.col("country").alias("_c"), F.col("region").alias("_r"), "region_name")
    zones = tz_dim.filter(F.col("region").isNotNull()).select(
        F.col("country").alias("_zc"), F.col("region").alias("_zr"),
        F.col("timezone").alias("_zone"))
    defaults = tz_dim.filter(F.col("region").isNull()).select(
        F.col("country").alias("_dc"), F.col("timezone").alias("_default"))
    region = F.coalesce(F.col("region"), F.lit(""))
    return (
        df.join(names, (F.col("country") == F.col("_c")) & (F.col("region") == F.col("_r")),
                "left")
        .join(zones, (F.col("country") == F.col("_zc")) & (region == F.col("_zr")), "left")
        .join(defaults, F.col("country") == F.col("_dc"), "left")
        .select(*df.columns, "region_name", F.coalesce("_zone", "_default").alias("timezone"))
    )


def geo_distance(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str,
                 name: str = "distance_km") -> DataFrame:
    """`df` plus the great-circle distance of two points in km."""
    return df.withColumn(name, great_circle_km(lat1, lon1, lat2, lon2))


def asn_enrich(ips: DataFrame, prefix_dim: DataFrame, ip_col: str = "ip_src") -> DataFrame:
    """Network table of the addresses by longest matching prefix.

    Where none matches, the country is null and the other columns are `NA`.

    `prefix_dim` has asn, bgp_prefix, country, as_info. Of rows with the same prefix the largest
    by these columns counts.
    """
    base, length = prefix_bounds("bgp_prefix")
    columns = ["asn", "bgp_prefix", "country", "as_info"]
    networks = (
        prefix_dim.select(*columns, base.alias("_base"), length.alias("_length"))
        .filter(F.col("_base").isNotNull())
        .groupBy("_length", F.expr("shiftright(_base, 32 - _length)").alias("_network"))
        .agg(F.max(F.struct(*columns)).alias("_found"))
        .withColumn("_order", -F.col("_length"))
    )
    distinct = ips.select(F.col(ip_col).alias("ip")).distinct()
    found = _nearest(distinct.withColumn("_ip", ipv4_to_long("ip")), "ip", networks)
    missing = F.lit("NA")

    def value(column: str) -> Column:
        return F.when(F.col("_found").isNull(), missing).otherwise(F.col("_found")[column])

    return distinct.join(found, "ip", "left").select(
        value("asn").alias("asn"), "ip", value("bgp_prefix").alias("bgp_prefix"),
        F.col("_found")["country"].alias("country"), value("as_info").alias("as_info"))
