"""Search over chunks: sparse hashed vectors, cosine and hybrid ranking, context for answers.

Everything per chunk is a narrow expression: a search is one scan, one projection and a two-stage top-k, whatever the corpus size.
The query's few slots are literals in the plan, so nothing is broadcast or joined.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def query_terms(query: str) -> list[str]:
    found = (t.strip("._-") for t in re.findall(r"[a-z][a-z0-9_+#.-]*", query.lower()))
    return [C.TOKEN_ALIASES.get(t, t) for t in found if len(t) >= 2]


def query_vector(query: str, size: int = C.VECTOR_SIZE) -> dict[int, float]:
    vector: dict[int, float] = {}
    for term, n in Counter(query_terms(query)).items():
        digest = hashlib.sha1(term.encode()).digest()
        slot = int.from_bytes(digest[:4], "big") % size
        vector[slot] = vector.get(slot, 0.0) + (-1.0 if digest[4] % 2 else 1.0) * (1 + math.log(n))
    norm = math.sqrt(sum(w * w for w in vector.values())) or 1.0
    return {s: w / norm for s, w in vector.items() if w}


def chunk_index(chunks: DataFrame, id_col: str, document_col: str, text_col: str, type_col: str | None = None) -> DataFrame:
    """(chunk_id, document, chunk_type, text, terms, vector): the searchable chunks. Null and source-only texts are left out."""
    kind = F.coalesce(F.col(type_col), F.lit("text")) if type_col else F.lit("text")
    base = chunks.select(F.col(id_col).alias("chunk_id"), F.col(document_col).alias("document"), kind.alias("chunk_type"), T.searchable(F.col(text_col)).alias("text"))
    return base.where(F.length("text") > 0).withColumn("terms", T.tokens(F.col("text"))).withColumn("vector", T.embed(F.col("terms")))


BUCKETS = 64


def bucket(document: str = "document", buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int")


def save_index(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes an index under `buckets` folders by its documents' hash, so that a document's rows lie in one of them whatever their number."""
    index.withColumn("bucket", bucket(buckets=buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_index(spark: SparkSession, path: str, document: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stored index; of one document only its bucket is read."""
    rows = spark.read.parquet(path)
    if document is not None:
        rows = rows.where((F.col("bucket") == bucket_of(spark, document, buckets)) & (F.col("document") == document))
    return rows.drop("bucket")


def bucket_of(spark: SparkSession, document: str, buckets: int = BUCKETS) -> int:
    return spark.range(1).select(F.lit(document).alias("document")).select(bucket(buckets=buckets)).first()[0]


def scored(index: DataFrame, query: str, document: str | None = None) -> DataFrame:
    """Chunks with cosine > 0; the unrounded score filters, the rounded one ranks. A blank query finds nothing."""
    vector = query_vector(query)
    if not vector:
        return index.withColumn("score", F.lit(0.0)).where("false")
    weights = F.create_map(*[F.lit(x) for s, w in sorted(vector.items()) for x in (s, float(w))])
    rows = index if document is None else index.where(F.col("document") == document)
    cosine = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["weight"] * F.coalesce(weights[x["slot"]], F.lit(0.0)))
    # as a generator, so that the vector is computed once: a filter on it would be pushed below and compute it again
    hit = F.explode(F.filter(F.array(F.struct(cosine.alias("cosine"))), lambda h: h["cosine"] > 0)).alias("hit")
    return rows.select("*", hit).select(*rows.columns, "hit.cosine", F.bround("hit.cosine", 4).alias("score"))


def semantic(index: DataFrame, query: str, n: int = 5, document: str | None = None) -> DataFrame:
    return scored(index, query, document).orderBy(F.desc("score"), "chunk_id").limit(n)


def hybrid(index: DataFrame, query: str, n: int = 5, document: str | None = None) -> DataFrame:
    """The 3n best by cosine, ranked again with the share of query terms that they hold; score in percent."""
    terms = sorted(set(query_terms(query)))
    pool = semantic(index, query, max(n * C.HYBRID_POOL, n), document)
    shared = F.array_intersect(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), "terms")
    mixed = F.bround((F.col("score") * C.HYBRID_COSINE + F.size("shared") / max(len(terms), 1) * C.HYBRID_KEYWORD) * 100, 1)
    tags = F.when(F.size("shared") > 0, F.slice("shared", 1, C.HYBRID_TAGS)).otherwise(F.array("chunk_type"))
    ranked = pool.withColumn("shared", shared).withColumn("tags", tags).withColumn("cosine_score", F.col("score")).withColumn("score", mixed)
    return ranked.orderBy(F.desc("score"), F.desc("cosine_score"), "chunk_id").limit(n)


def context(results: DataFrame) -> DataFrame:
    """One row: the blocks of a search result in order, as text for an answer."""
    block = F.concat(F.lit("[From: "), "document", F.lit(" | Relevance: "), F.format_string("%.1f", "score"), F.lit("%]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("cosine_score")).alias("c"), "chunk_id", block.alias("block"))))
    return results.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("b")).select(
        F.when(F.length("b") > 0, F.col("b")).otherwise("No relevant context found.").alias("context")
    )


def statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.count_distinct("document").alias("documents"), F.sum(F.size("vector")).alias("weights"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 2000) -> DataFrame:
    """(query_id, id, cosine, rank): for each query vector the k rows of highest cosine, itself left out; ties to smaller ids.

    The table is read once. Queries are broadcast in blocks of `block`, and each batch of vectors meets them block by block; a
    partition keeps k rows per query, and only those are shuffled. Null vectors and those of another length are passed over.
    """
    spark = vectors.sparkSession
    kind = "bigint" if vectors.schema[id_col].dataType.simpleString() in ("bigint", "int") else "string"
    wanted = queries.select(F.col(id_col).cast(kind).alias("q"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-wanted.count() // block))
    shared = []
    for b in range(blocks):
        rows = (wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else wanted).toArrow()
        if rows.num_rows:
            size = len(rows.column("v")[0])
            rows = rows.filter(pc.equal(pc.list_value_length(rows.column("v")), size))
            matrix = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            shared.append(spark.sparkContext.broadcast((rows.column("q").to_pylist(), matrix / np.where(norms > 0, norms, 1))))

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [s.value for s in shared]
        best: list[list[list[tuple[float, object]]]] = [[[] for _ in ids] for ids, _ in parts]
        for batch in it:
            lengths = pc.list_value_length(batch.column(1))
            for n, (ids, unit) in enumerate(parts):
                part = batch.filter(pc.and_(pc.fill_null(pc.equal(lengths, unit.shape[1]), False), pc.is_valid(batch.column(0))))
                if not part.num_rows:
                    continue
                keys = part.column(0).to_pylist()
                m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, unit.shape[1])
                norm = np.linalg.norm(m, axis=1)
                sims = np.round(unit @ (m / np.where(norm > 0, norm, 1)[:, None]).T, 6)
                # the k + 1 best, and what ties with the last of them: one may be the query itself
                least = np.partition(sims, -(k + 1), 1)[:, -(k + 1)] if sims.shape[1] > k + 1 else np.full(len(sims), -2.0)
                for q, row in enumerate(sims):
                    best[n][q] = sorted(best[n][q] + [(-float(row[j]), keys[j]) for j in np.flatnonzero(row >= least[q]) if keys[j] != ids[q]])[:k]
        out = [(ids[q], key, -c) for (ids, _), each in zip(parts, best) for q, rows in enumerate(each) for c, key in rows]
        cols = list(zip(*out)) if out else [[]] * 3
        key_type = pa.int64() if kind == "bigint" else pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, key_type, pa.float64()))], names=["query_id", "id", "cosine"])

    found = vectors.select(F.col(id_col).cast(kind), F.col(vector_col).cast("array<double>")).mapInArrow(nearest, f"query_id {kind}, id {kind}, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
