"""The document catalogue: listing, content duplicates, upsert, soft delete, artifact replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def owner(user: Column) -> Column:
    return F.coalesce(user, F.lit(C.DEFAULT_USER))


def listing(docs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Rows not deleted, of one user if given; newest first. Both filters reach the scan."""
    live = docs.where(F.col("deleted_at").isNull())
    if user_id is not None:
        live = live.where(F.col("user_id") == user_id if user_id != C.DEFAULT_USER else F.col("user_id").isNull() | (F.col("user_id") == user_id))
    return live.orderBy(F.desc("created_at"), "doc_id")


def with_fallback(database: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Database rows, and sidecar rows of the users that the database has no row of, deleted ones included."""
    users = database.select(owner(F.col("user_id")).alias("_u")).distinct()
    rest = sidecars.join(users, owner(sidecars["user_id"]) == F.col("_u"), "left_anti")
    return database.where("deleted_at IS NULL").unionByName(rest, allowMissingColumns=True)


def first_seen(docs: DataFrame) -> DataFrame:
    """(file_hash, file_extension, first_doc, copies): the earliest upload of each content; partial aggregation, no sort."""
    return docs.where("file_hash IS NOT NULL").groupBy("file_hash", "file_extension").agg(
        F.min(F.struct("created_at", "doc_id"))["doc_id"].alias("first_doc"), F.count("*").alias("copies")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """One row per key: an incoming row wins over an existing one and clears deleted_at; of several incoming the latest."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)).withColumn("deleted_at", F.lit(None).cast("timestamp")))
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    row = F.struct(*rest)
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct("_new", order, F.xxhash64(row))).alias("_row"))
    return best.select(*keys, "_row.*")


def soft_delete(docs: DataFrame, condition: Column, when: Column | None = None) -> DataFrame:
    return docs.withColumn("deleted_at", F.when(condition, F.coalesce("deleted_at", when if when is not None else F.current_timestamp())).otherwise(F.col("deleted_at")))


def replace_documents(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Stored artifacts with those of the documents in `fresh` replaced."""
    return stored.join(fresh.select(F.col(key).alias("_k")).distinct(), stored[key] == F.col("_k"), "left_anti").unionByName(fresh, allowMissingColumns=True)


def content_path(hash_: Column, extension: Column) -> Column:
    """Content address: two hex digits as a folder, then the hash with its extension."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.concat(hash_, F.lit("."), F.lower(extension)))


def latest_per(df: DataFrame, keys: list[str], n: int, order: list[Column], keep: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each group before its shuffle."""
    return df.withColumn(keep, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(keep) <= n)
