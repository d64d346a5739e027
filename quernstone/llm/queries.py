"""The pN_ queries: each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    # one table after the other: side by side they would need the disk of both at once
    docs = neardup.near_duplicates(table(spark, sf_dir, "parsed_documents"), "document_id", "raw_text", bits=640)
    chunks = neardup.near_duplicates(table(spark, sf_dir, "parsed_chunks"), "id", "text", "created_at")
    return docs.union(chunks)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and chunk with its group of near-duplicates, under the corpus defaults: five-word shingles, similarity 0.8.

    The tables are searched apart from each other; groups of documents are marked, as a class can occur in both.
    """
    from . import neardup

    docs = neardup.near_pairs(table(spark, sf_dir, "parsed_documents"), "document_id", "raw_text", None, 0.8, 5, 5, 640)
    chunks = neardup.near_pairs(table(spark, sf_dir, "parsed_chunks"), "id", "text", "created_at", 0.8, 5, 5)
    of_docs = neardup.groups(*docs).withColumn("group", F.concat(F.lit("document:"), "group"))
    return of_docs.unionByName(neardup.groups(*chunks))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and chunk with its segments of one language each."""
    docs, chunks = _labelled(spark, sf_dir)
    return docs.unionByName(chunks).select("record_id", F.explode("segments").alias("s")).select("record_id", "s.*")


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and chunk with the language of most of its words, declared or not, and a confidence; null without prose."""
    from . import langid

    docs, chunks = _labelled(spark, sf_dir)
    return docs.unionByName(chunks).select("record_id", "declared", langid.main_language(F.col("segments")).alias("m")).select("record_id", "declared", "m.lang", "m.confidence")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from . import langid

    docs, chunks = table(spark, sf_dir, "parsed_documents"), table(spark, sf_dir, "parsed_chunks")
    model = langid.fit_on(docs, "document_id", "raw_text")
    declared = langid.declared_language(F.col("metadata_json"))
    return (
        langid.label_segments(docs.withColumn("declared", declared), "document_id", "raw_text", model, ("declared", "created_at")),
        langid.label_segments(chunks.withColumn("declared", declared), "id", "text", model, ("declared", "created_at")),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = _labelled(spark, sf_dir)
    langs = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sentences"] > 0), lambda s: s["lang"]))
    both = docs.unionByName(chunks).select("record_id", "created_at", F.struct("declared", langs.alias("langs")).alias("v"))
    latest = both.groupBy("record_id").agg(F.max_by("v", F.struct("created_at", "v")).alias("v"))
    case = (F.size("v.langs") > 1) | F.col("v.declared").isNull() | (F.col("v.declared") != F.col("v.langs")[0])
    return latest.where((F.size("v.langs") > 0) & case).select("record_id", F.explode("v.langs").alias("lang"))


def _oversized(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    from . import splitting

    docs, chunks = table(spark, sf_dir, "parsed_documents"), table(spark, sf_dir, "parsed_chunks")
    elements = docs.select("document_id", F.posexplode("chunks").alias("i", "c")).select(F.concat_ws("#", "document_id", "i").alias("id"), F.col("c.text").alias("text"))
    return (
        splitting.split_items(docs, "document_id", "raw_text", 4000, 150, with_text)
        .union(splitting.split_items(chunks, "id", "text", 800, 150, with_text))
        .union(splitting.split_items(elements, "id", "text", 800, 150, with_text))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.max("forced"), "forced").otherwise("natural")
    return _oversized(spark, sf_dir, False).groupBy("record_id").agg(kind.alias("cut_kind"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, each once however often its row is repeated."""
    return _oversized(spark, sf_dir, True).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import names

    return names.linked(table(spark, sf_dir, "graph_nodes"))


def p4_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of a person or organisation with its identity, by its own text or else by the node that its normalised form names."""
    from . import names

    return names.identify_mentions(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "parsed_entities"))


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaking document with its items, longest verbatim match and position in words."""
    from . import contamination

    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents left after removing all that leak an item."""
    from . import contamination

    return contamination.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source"), p8_matches(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import knn

    return knn.pairs(p6_neighbours(spark, sf_dir))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each usable vector the five nearest of cosine 0.8 or more."""
    from . import knn

    return knn.nearest(table(spark, sf_dir, "indexed_chunks"), "id", "vector")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces with their containers of 2,048 tokens."""
    from . import packing

    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of space unused."""
    full = p7_containers(spark, sf_dir).where("container > 0")
    each = full.groupBy("container").agg(F.sum("tokens").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / (F.count("*") * 2048)).alias("unused"), F.max("used").alias("fullest"))


#: Probability from which a document counts as a case.
MODERATION_CUT = 0.4


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source and its probability per category."""
    from . import moderation

    docs = table(spark, sf_dir, "documents")
    model = moderation.fit_on(docs, table(spark, sf_dir, "moderation_labels"))
    return moderation.scores(docs, model, keep=("source",)).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.when(F.col(c) >= MODERATION_CUT, F.lit(c)) for c in ("abusive", "hateful", "sexual")])
    return p9_scores(spark, sf_dir).select("doc_id", F.explode(F.array_compact(each)).alias("category"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, and the rate of each category."""
    rate = lambda c: F.avg((F.col(c) >= MODERATION_CUT).cast("int")).alias(f"{c}_rate")
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), rate("abusive"), rate("hateful"), rate("sexual"))


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body's lines with their probabilities."""
    from . import mainbody

    pages = table(spark, sf_dir, "scraped_pages")
    return mainbody.main_lines(pages, mainbody.fit_on(pages))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mainbody

    pages = table(spark, sf_dir, "scraped_pages")
    return mainbody.main_lines(pages, mainbody.fit_on(pages), with_line=False).select("page_id", "line_no")


QUERIES = {
    "p3_found": p3_found, "p3_lines": p3_lines,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
    "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_containers": p7_containers, "p7_usage": p7_usage,
    "p4_found": p4_found, "p4_identities": p4_identities, "p8_found": p8_found, "p8_matches": p8_matches, "p8_clean": p8_clean,
    "p1_found": p1_found, "p1_segments": p1_segments, "p1_languages": p1_languages, "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p5_found": p5_found, "p5_groups": p5_groups,
}

_STRIPPED = "regexp_replace(regexp_replace({x}, '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '')"
_P2_ITEMS = f"""
WITH items AS (
  SELECT document_id AS record_id, {_STRIPPED.format(x='raw_text')} AS t, 4000 AS lim FROM parsed_documents
  UNION ALL SELECT id, {_STRIPPED.format(x='text')}, 800 FROM parsed_chunks
  UNION ALL SELECT document_id || '#' || (i - 1), {_STRIPPED.format(x='chunks[i].text')}, 800
  FROM (SELECT document_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM parsed_documents)
)"""

ORACLES: dict[str, str] = {
    "p2_found": _P2_ITEMS
    + """
SELECT record_id, CASE WHEN max(longest > lim) THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT record_id, lim, list_max(list_transform(string_split_regex(regexp_replace(t, '([。！？；，、])', '\\1 ', 'g'), '[ \\t\\r\\n]'), lambda s: length(s))) AS longest
      FROM items WHERE length(t) > lim)
GROUP BY record_id""",
    "p5_found": """
WITH r AS (
  SELECT 'd' AS kind, document_id AS id, regexp_extract_all(lower(raw_text), '[\\p{L}\\p{N}]+') AS w FROM parsed_documents
  UNION ALL SELECT 'c', id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM parsed_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
t AS (SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 1)) AS i FROM r WHERE len(w) >= 30)),
n AS (SELECT kind, id, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT a.kind, a.id AS x, b.id AS y, count(*) AS c FROM t a JOIN t b ON a.kind = b.kind AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT x AS record_a, y AS record_b FROM p JOIN n f ON f.kind = p.kind AND f.id = x JOIN n g ON g.kind = p.kind AND g.id = y WHERE c >= 0.7 * (f.n + g.n - c)""",
    "p6_found": """
WITH v AS (SELECT id, vector::DOUBLE[] AS x FROM indexed_chunks WHERE len(vector) = 384 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
c AS (SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.x, b.x), 6) AS s FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT i, j FROM c WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 5)
SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM k""",
}
