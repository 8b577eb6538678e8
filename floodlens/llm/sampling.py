"""Bounded samples of labelled rows for fitting on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hashed_sample(rows: DataFrame, key: str, columns: list[str], size: int) -> pd.DataFrame:
    """About `size` rows, all of them if there are no more, in an order that does not depend on
    how rows are dealt. Rows are chosen where they are, by a hash of `key`, so that tasks only
    send what is used."""
    count = rows.count()
    chosen = F.pmod(F.xxhash64(key, F.lit(size)), F.lit(_RANGE)) < int(
        _RANGE * min(1.0, size / max(count, 1)))
    found = rows.where(chosen).select(key, *columns).toPandas()
    found["_order"] = pd.util.hash_array(found[key].to_numpy())
    return found.sort_values(["_order", *columns], ignore_index=True).drop(columns="_order")
