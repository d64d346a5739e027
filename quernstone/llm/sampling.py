"""Bounded samples for fitting, the same however a table is partitioned, and the models fitted on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

SPAN = 1 << 31


def least_hashed(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """The `bound` rows whose ids have the least hash. A first cut by the hash itself keeps what tasks send back near the bound."""
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SPAN))
    total = df.select(F.lit(1)).count()
    if total > 4 * bound:
        df = df.where(place < int(SPAN * 2 * bound / total))
    return df.orderBy(place, id_col).limit(bound)


def stored(spark: SparkSession, kind: str, rows: list, fit: Callable[[], Any], version: int = 1) -> Any:
    """What `fit` gives for `rows`: read from the shared folder where it was stored for the same rows before, else fitted and stored.

    version: to be raised when the way of fitting changes.
    """
    name = f"{shared_folder(spark)}/models/{kind}-{version}-{xxhash.xxh3_128_hexdigest(repr(rows).encode('utf-8', 'surrogatepass'))}"
    try:
        return pickle.loads(spark.read.parquet(name).first()[0])
    except (AnalysisException, TypeError):  # not there, or not whole
        model = fit()
        spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(name)
        return model
