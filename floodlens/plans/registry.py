"""The registered queries: Spark job and, where SQL can say it, the statement to check it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from floodlens.plans.tables import Tables, rounded


@dataclass(frozen=True)
class Query:
    """A named job over the relations, and its SQL for the check."""

    name: str
    job: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, tables: Tables) -> DataFrame:
        return rounded(self.job(tables))


def all_queries() -> dict[str, Query]:
    from floodlens.plans import (
        alert_queries,
        conversation_queries,
        flow_queries,
        packet_queries,
        source_queries,
    )

    modules = (packet_queries, flow_queries, conversation_queries, alert_queries, source_queries)
    return {query.name: query for module in modules for query in module.QUERIES}
