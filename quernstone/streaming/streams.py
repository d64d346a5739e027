"""Streaming forms of ingestion, rate limits, progress and history; each has the batch form that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import search
from ..session import cut_lineage, shared_folder

LATE = "10 days"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives back what it wrote. In update mode every batch adds the rows that it changed, and
    the last one of each key counts, so that no batch rewrites what others wrote and a watermark may bound the state."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    if mode != "update" or not keys:
        raise ValueError("mode is append, or update with the keys of a row")

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/run={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0).cast("bigint")).schema).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)


def windows(events: DataFrame, seconds: int = 3600, user: str = "user_id", time: str = "ts") -> DataFrame:
    """(user, window_start, requests) per fixed window, for batch and streaming input alike."""
    return events.groupBy(F.col(user), F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests")).select(user, F.col("w.start").alias("window_start"), "requests")


def violations(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Windows in which a user went beyond the limit, with the number of requests turned away."""
    return windows(events, seconds).where(F.col("requests") > limit).withColumn("rejected", F.col("requests") - limit)


def first_per_key(events: DataFrame, key: str = "event_id", time: str = "ts") -> DataFrame:
    """A stream without repeated keys within the lateness that the watermark allows."""
    return events.withWatermark(time, LATE).dropDuplicatesWithinWatermark([key])


def state_changes(events: DataFrame, user: str = "user_id", state: str = "event_type", time: str = "ts", tie: str = "event_id", span: int = 86_400) -> DataFrame:
    """Rows whose state differs from the user's one before, which comes as `previous`; the first always does.

    A user's events are looked at by spans of time, each in its own task, and each span takes up the state that the one before it left: what one
    user's own task orders is a row per span. Rows of null users are one user's.
    """
    number = F.col(time) if isinstance(events.schema[time].dataType, NumericType) else F.unix_timestamp(time)
    rows = events.withColumn("_span", F.floor(number / span))
    left = rows.groupBy(user, "_span").agg(F.max_by(state, F.struct(time, tie)).alias("_left"))
    before = left.select(F.col(user).alias("_u"), F.col("_span").alias("_s"), F.lag("_left").over(Window.partitionBy(user).orderBy("_span")).alias("_before"))
    order = Window.partitionBy(user, "_span").orderBy(time, tie)
    seen = rows.withColumn("_n", F.row_number().over(order)).withColumn("_lag", F.lag(state).over(order))
    joined = seen.join(before, seen[user].eqNullSafe(before["_u"]) & seen["_span"].eqNullSafe(before["_s"]))
    found = joined.withColumn("previous", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_span", "_n", "_lag", "_u", "_s", "_before")
    return found.where(F.col("previous").isNull() | (F.col("previous") != F.col(state)))


def recent(events: DataFrame, n: int, user: str = "user_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each user's last n rows, rank 1 the latest."""
    order = Window.partitionBy(user).orderBy(F.desc(time), F.desc(tie))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recent_distinct(events: DataFrame, n: int, user: str = "user_id", value: str = "event_type", time: str = "ts") -> DataFrame:
    """Each user's n values used last, each once."""
    last = events.groupBy(user, value).agg(F.max(time).alias("last_used"))
    order = Window.partitionBy(user).orderBy(F.desc("last_used"), value)
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def histogram(events: DataFrame, value: str, bounds: list[float], by: str) -> DataFrame:
    """(by, le, n): cumulative counts per bound, as a metrics endpoint shows them; the last bound is infinite."""
    edges = [*bounds, float("inf")]
    sums = [F.sum((F.col(value) <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(edges[:-1])] + [F.count(value).alias(f"b{len(bounds)}")]
    agg = events.groupBy(by).agg(*sums)
    return agg.select(by, F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)])).alias("x")).select(by, "x.le", "x.n")


def incremental_index(chunks: DataFrame, path: str, checkpoint: str, index, buckets: int = search.BUCKETS) -> None:
    """Indexes a stream of chunks batch by batch. A batch replaces the rows of its own documents and rewrites only the buckets that
    they lie in, of which there are never more than `buckets`; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(index(batch).withColumn("bucket", search.bucket(buckets=buckets)))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        try:
            stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched))
            gone = fresh.select(F.col("document").alias("_d")).distinct()
            kept = cut_lineage(stored.join(gone, stored["document"] == gone["_d"], "left_anti"))
        except AnalysisException:  # the first batch
            kept = fresh.limit(0)
        kept.unionByName(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
