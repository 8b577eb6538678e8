"""Connected components of a table of links: local union-find, then star contractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.session import staged

LINKS_PER_TASK = 500_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b) and the smallest node each reaches."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = places[:len(a)], places[len(a):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)  # roots of both ends meet, then every node follows
        while (root[root] != root).any():
            root = root[root]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Links (u, v), v < u, that connect the same nodes: each task points what its own links
    connect to the smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, least = smallest_reached(*map(np.concatenate, zip(*held)))
            inner = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(least[inner])],
                                             names=["u", "v"])

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id that occurs in a link (a, b), a <> b, with the smallest id it
    reaches.

    Tasks of at most about LINKS_PER_TASK links contract what they hold. If one task does not hold
    all, a round follows that points all larger neighbours of a node to its smallest neighbour,
    then the smaller ones, as sums per node: no neighbour list is gathered. Rounds end when one
    changes nothing; their number grows with the logarithm of the size of a component.
    """
    down = staged(links.where("a <> b").selectExpr("a as u", "b as v"), "links")
    before = None
    while True:
        tasks = max(1, math.ceil(down.count() / LINKS_PER_TASK))
        down = staged(_contracted(down, tasks), "links")
        if tasks == 1:
            break
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(smallest, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        down = staged(small, "links")
        now = down.agg(F.count("u"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    own = down.groupBy("u").agg(F.min("v").alias("component"))
    return own.selectExpr("u as id", "component").unionByName(
        own.selectExpr("component as id", "component").distinct())
