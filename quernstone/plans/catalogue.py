"""All core queries and, where SQL can say it, an independent statement of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import answers, catalog, entities, graph, markup, pipeline, records, search, validate
from ..session import cut_lineage, shared_folder, table
from ..sources import parsers, readers
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The question that the search queries ask; its words occur in the corpus.
QUESTION = "search panel column names word totals"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Catalogue and validation


@query("""SELECT doc_id, coalesce(user_id, 'local-dev') AS owner, original_filename, epoch_us(created_at) AS created_us FROM documents
WHERE deleted_at IS NULL AND coalesce(user_id, 'local-dev') = 'local-dev'""")
def doc_catalog_newest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.listing(table(spark, d, "documents"), C.DEFAULT_USER)
    return rows.select("doc_id", catalog.owner(F.col("user_id")).alias("owner"), "original_filename", F.unix_micros("created_at").alias("created_us"))


@query("""SELECT file_hash, file_extension, arg_min(doc_id, (created_at, doc_id)) AS first_doc, count(*) AS copies FROM documents WHERE file_hash IS NOT NULL GROUP BY ALL""")
def content_dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_seen(table(spark, d, "documents"))


@query("""WITH x AS (SELECT *, doc_id % 2 = 1 AS fresh FROM documents WHERE file_hash IS NOT NULL AND user_id IS NOT NULL)
SELECT user_id, file_hash, arg_max(doc_id, (fresh, created_at, doc_id)) AS doc_id, arg_max(CASE WHEN fresh THEN FALSE ELSE deleted_at IS NOT NULL END, (fresh, created_at, doc_id)) AS deleted FROM x GROUP BY ALL""")
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Odd ids arrive after even ones: they win under one owner and hash, and bring deleted rows back."""
    rows = table(spark, d, "documents").where("file_hash IS NOT NULL AND user_id IS NOT NULL").select("user_id", "file_hash", "doc_id", "deleted_at", F.struct("created_at", "doc_id").alias("at"))
    merged = catalog.upsert(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["user_id", "file_hash"], "at")
    return merged.select("user_id", "file_hash", "doc_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS words, greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) // 250) AS minutes FROM documents WHERE text IS NOT NULL""")
def doc_word_count_reading_time(spark: SparkSession, d: str) -> DataFrame:
    n = T.words(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", n.alias("words"), T.reading_minutes(n).alias("minutes"))


@query("""WITH x AS (SELECT doc_id, lower(file_extension) AS e, file_size AS z, substr(coalesce(text, ''), 1, 65536) AS b FROM documents)
SELECT doc_id, CASE
 WHEN e NOT IN ('md','txt','pdf','docx','py','js','ts','json','csv','html','htm') OR e IS NULL THEN 'extension'
 WHEN NOT (z > 0 AND z <= 52428800) OR z IS NULL THEN 'size'
 WHEN e NOT IN ('pdf','docx') AND length(b) > 0 AND length(regexp_replace(replace(replace(replace(b, chr(13), ''), chr(10), ''), chr(9), ''), '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Zl}\\p{Zp}]|[\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]', '', 'g'))
   + length(b) - length(replace(replace(replace(b, chr(13), ''), chr(10), ''), chr(9), '')) < 0.92 * length(b) THEN 'readable'
 WHEN e IN ('html','htm') AND NOT regexp_matches(lower(b), '<!doctype\\s+html|<html[\\s>]|<(head|body|meta|title|div|p|span|a|section|article)[\\s>]') THEN 'html'
 WHEN e IN ('html','htm') AND regexp_matches(b, '(?i)javascript\\s*:|vbscript\\s*:|data\\s*:\\s*text/html') THEN 'danger'
 WHEN e NOT IN ('html','htm') AND regexp_matches(b, '(?i)<script[\\s>]|javascript\\s*:|vbscript\\s*:|on\\w{2,20}\\s*=\\s*["'']|data\\s*:\\s*text/html') THEN 'danger' END AS reject_reason FROM x""")
def validate_uploads(spark: SparkSession, d: str) -> DataFrame:
    reason = validate.reject_reason(F.col("file_extension"), F.col("file_size"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", reason.alias("reject_reason"))


@query("""SELECT doc_id, CASE WHEN length(s) > 0 THEN s || lower(x) ELSE 'upload' || lower(x) END AS safe FROM (
 SELECT doc_id, substr(left(b, length(b) - length(x)), 1, 200) AS s, x FROM (
  SELECT doc_id, b, regexp_extract(b, '[^.](\\.[^.]+)$', 1) AS x FROM (SELECT doc_id, translate(string_split(original_filename, '/')[-1], '<>:"|?*', '_______') AS b FROM documents WHERE original_filename IS NOT NULL)))""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("original_filename IS NOT NULL").select("doc_id", validate.safe_filename(F.col("original_filename")).alias("safe"))


@query("""SELECT page_id, regexp_matches(lower(url), '^https?://') AND NOT regexp_matches(lower(url), '^https?://(localhost|[^/:]*\\.(local|internal)|(0|10|127)\\.[0-9.]+|192\\.168\\.[0-9.]+)([:/]|$)') AS public FROM scraped_pages WHERE url IS NOT NULL""")
def public_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scraped_pages").where("url IS NOT NULL").select("page_id", validate.public_address(F.col("url")).alias("public"))


@query("""SELECT status, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM (SELECT coalesce(status, 'done') AS status, file_size FROM documents) GROUP BY status""")
def status_facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("status", F.lit("done")).alias("status")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


# Chunks and structure


@query("""SELECT doc_id, (s // 650) AS chunk_index, s AS start_pos, least(s + 800, length(text)) AS end_pos, substr(text, s + 1, 800) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 650)) AS s FROM documents) WHERE trim(substr(text, s + 1, 800), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("i", "w"))
    return rows.where(F.col("w.text").rlike(r"[^ \t\n\r]")).select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), F.col("w.start_pos").cast("bigint").alias("start_pos"), F.col("w.end_pos").cast("bigint").alias("end_pos"), F.col("w.text").alias("chunk"))


@query("""SELECT id, 'chunk_' || substr(sha1(document_id || ':' || chunk_index || ':' || substr(text, 1, 80)), 1, 16) AS chunk_key FROM parsed_chunks WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("chunk_"), F.substring(F.sha1(F.concat_ws(":", "document_id", "chunk_index", F.substring("text", 1, 80))), 1, 16))
    return table(spark, d, "parsed_chunks").where(F.col("text").rlike(r"[^ \t\n\r]")).select("id", key.alias("chunk_key"))


@query("""WITH l AS (SELECT document_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT document_id, regexp_replace(raw_text, '\\r\\n?', chr(10), 'g') AS t FROM parsed_documents WHERE raw_text <> '')),
g AS (SELECT *, regexp_matches(line, '^#{1,6}[ \\t]+[^ \\t\\n]') AS h, sum(regexp_matches(line, '^#{1,6}[ \\t]+[^ \\t\\n]')::INT) OVER (PARTITION BY document_id ORDER BY n) AS k FROM l),
s AS (SELECT document_id, k, max(CASE WHEN h THEN regexp_replace(line, '^#{1,6}[ \\t]+', '') END) AS title, max(CASE WHEN h THEN length(regexp_extract(line, '^#{1,6}')) END) AS level,
 string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY n) AS body, count(*) FILTER (NOT h) AS lines FROM g GROUP BY ALL)
SELECT document_id, coalesce(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), 'Introduction') AS title, coalesce(level, 0)::INT AS level, md5(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS digest FROM s WHERE lines > 0""")
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_documents").where("raw_text <> ''").select("document_id", F.explode(markup.sections(F.col("raw_text"))).alias("s"))
    return rows.select("document_id", "s.title", "s.level", F.md5("s.content").alias("digest"))


@query("""SELECT document_id, coalesce(nullif(b.l, ''), 'text') AS language, md5(regexp_replace(b.c, '^\\s+|\\s+$', '', 'g')) AS digest FROM (
 SELECT document_id, unnest(list_transform(regexp_extract_all(raw_text, '(?s)```\\w*\\n.*?```'), lambda m: {'l': regexp_extract(m, '^```(\\w*)', 1), 'c': regexp_extract(m, '(?s)^```\\w*\\n(.*)```$', 1)})) AS b FROM parsed_documents)
WHERE trim(b.c, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_documents").select("document_id", F.explode(markup.code_blocks(F.col("raw_text"))).alias("b"))
    return rows.select("document_id", "b.language", F.md5("b.code").alias("digest"))


@query("""SELECT doc_id, regexp_extract(m, '\\[([^\\]]+)\\]', 1) AS label, regexp_extract(m, '\\]\\(([^\\)]+)\\)', 1) AS url FROM (
 SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^!])\\[[^\\]]+\\]\\([^\\)]+\\)')) AS m FROM documents)""")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(markup.links(F.col("text"))).alias("l")).select("doc_id", F.col("l.text").alias("label"), "l.url")


@query("""SELECT doc_id, n::INT AS line, (length(regexp_extract(s, '^\\s*')) // 2)::INT AS level, regexp_matches(s, '^\\s*\\d') AS ordered, trim(regexp_extract(s, '^\\s*(?:[-*+]|\\d+\\.)\\s+(.+)$', 1), ' ' || chr(9)) AS item
FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents))
WHERE regexp_matches(s, '^\\s*(?:[-*+]|\\d+\\.)\\s+.+$')""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(markup.list_items(F.col("text"))).alias("x"))
    return rows.select("doc_id", "x.line", "x.level", "x.ordered", F.col("x.text").alias("item"))


@query("""SELECT document_id, coalesce(len(sections), 0)::INT AS sections, coalesce(len(chunks), 0)::INT AS chunks, coalesce(len(links), 0)::INT AS links, coalesce(len(list_filter(chunks, lambda c: c.chunk_type = 'code')), 0)::INT AS code_chunks,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(sections, lambda s: s.heading_level = 2), lambda s: s.title)))[1:12], '|') AS headings FROM parsed_documents""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    heads = F.slice(F.array_sort(F.array_distinct(F.transform(F.filter("sections", lambda s: s["heading_level"] == 2), lambda s: s["title"]))), 1, 12)
    return table(spark, d, "parsed_documents").select(
        "document_id", F.when(F.col("sections").isNull(), 0).otherwise(size("sections")).alias("sections"), F.when(F.col("chunks").isNull(), 0).otherwise(size("chunks")).alias("chunks"), F.when(F.col("links").isNull(), 0).otherwise(size("links")).alias("links"),
        F.when(F.col("chunks").isNull(), 0).otherwise(size(F.filter("chunks", lambda c: c["chunk_type"] == "code"))).alias("code_chunks"), F.array_join(heads, "|").alias("headings"),
    )


@query("""SELECT chunk_type, count(*) AS n, sum(length(text))::BIGINT AS characters FROM parsed_chunks GROUP BY chunk_type""")
def chunk_type_facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("""SELECT item_id, (s // 80 + 1)::INT AS slice, substr(item_text, s + 1, 80) AS part FROM (SELECT item_id, item_text, unnest(range(0, length(item_text), 80)) AS s FROM eval_items)""")
def answer_stream_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.posexplode(answers.slices(F.col("item_text"))).alias("i", "part")).select("item_id", (F.col("i") + 1).alias("slice"), "part")


# Pages, code, JSON, CSV


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'))::INT AS headings,
 len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["''][^"'']+["'']'))::INT AS links FROM scraped_pages WHERE html IS NOT NULL""")
def html_title_headings_links(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "scraped_pages").where("html IS NOT NULL").select("page_id", markup.html_title(html).alias("title"), F.size(markup.html_headings(html)).alias("headings"), F.size(markup.html_links(html)).alias("links"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    pages = parsers.markdown_pages(table(spark, d, "scraped_pages"), C.MIN_PAGE_WORDS)
    return pages.select("page_id", records.page_filename(F.col("url"), F.coalesce("title", "url")).alias("filename"), F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "url")), F.concat(F.lit("Source: "), F.col("url")), "body").alias("markdown"))


@query("""SELECT id, list_aggregate(list_distinct(list_transform(regexp_extract_all(text, '(?m)^\\s*(?:from\\s+[\\w.]+\\s+import|import\\s+[\\w.]+)'), lambda m: regexp_extract(m, '(?:from|import)\\s+(\\w+)', 1))), 'count')::INT AS packages
FROM parsed_chunks WHERE chunk_type = 'code' AND text IS NOT NULL""")
def python_packages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").where("chunk_type = 'code' AND text IS NOT NULL").select("id", F.size(markup.python_imports(F.col("text"))).alias("packages"))


@query("""SELECT id, len(list_distinct(regexp_extract_all(text, 'class\\s+(\\w+)', 1)))::INT AS classes, len(list_distinct(regexp_extract_all(text, '(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s+)?\\(', 1)))::INT AS arrows
FROM parsed_chunks WHERE chunk_type = 'code' AND text IS NOT NULL""")
def js_outline(spark: SparkSession, d: str) -> DataFrame:
    arrows = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("), F.lit(1)))
    return table(spark, d, "parsed_chunks").where("chunk_type = 'code' AND text IS NOT NULL").select("id", F.size(markup.js_outline(F.col("text"))["classes"]).alias("classes"), F.size(arrows).alias("arrows"))


@query("""SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY k""")
def json_describe_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT c AS "column", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(quantile_disc(v, 0.25), 4) AS q25, round(quantile_disc(v, 0.5), 4) AS q50, round(quantile_disc(v, 0.75), 4) AS q75, round(max(v), 4) AS max
FROM (SELECT 'o_totalprice' AS c, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::DOUBLE FROM orders) GROUP BY c""")
def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv_profile(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


@query("""WITH x AS (SELECT 'o_orderpriority' AS "column", 'string' AS dtype, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_orderstatus', 'string', o_orderstatus FROM orders)
SELECT "column", any_value(dtype) AS dtype, count(v) AS filled, count(DISTINCT v) AS "distinct", array_to_string(list_sort(list_distinct(list(v)))[1:3], '|') AS samples FROM x WHERE v IS NOT NULL GROUP BY "column\"""")
def csv_columns(spark: SparkSession, d: str) -> DataFrame:
    return readers.column_shapes(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("""SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS n FROM (SELECT DISTINCT * FROM (
 SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders) WHERE length(trim(value)) BETWEEN 2 AND 80)) WHERE n <= 20""")
def csv_value_hints(spark: SparkSession, d: str) -> DataFrame:
    return readers.value_hints(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


# Search

_DUCK_TOKENS = "list_transform(list_filter(list_transform(regexp_extract_all(lower({t}), '[a-z][a-z0-9_+#.-]*'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) >= 2), lambda t: CASE t WHEN 'js' THEN 'javascript' WHEN 'nodejs' THEN 'node.js' WHEN 'ml' THEN 'machine-learning' ELSE t END)"
_DUCK_SEARCHABLE = "regexp_replace(array_to_string(list_filter(string_split({t}, chr(10)), lambda s: NOT regexp_matches(s, '(?i)^\\s*source:\\s*https?://\\S+\\s*$')), chr(10)), '^\\s+|\\s+$', '', 'g')"


def _duck_vectors(source: str) -> str:
    """CTEs v(id, slot, weight) over source(id, text)."""
    return f"""src AS ({source}),
tok AS (SELECT id, unnest({_DUCK_TOKENS.format(t='text')}) AS t FROM src),
cnt AS (SELECT id, t, count(*) AS n FROM tok GROUP BY ALL),
slt AS (SELECT id, ('0x' || substr(sha1(t), 1, 8))::BIGINT % 384 AS slot, sum(CASE WHEN ('0x' || substr(sha1(t), 9, 2))::BIGINT % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE * (1 + ln(n))) AS w FROM cnt GROUP BY ALL),
v AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM slt WHERE w <> 0)"""


_CORPUS = "SELECT id, document_id AS document, chunk_type, " + _DUCK_SEARCHABLE.format(t="text") + " AS text FROM parsed_chunks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, text DESC) = 1"
_SEARCH = f"""WITH {_duck_vectors(f"SELECT * FROM ({_CORPUS}) WHERE text <> '' UNION ALL SELECT '?', '?', '?', '{QUESTION}'")},
hits AS (SELECT a.id, sum(a.weight * q.weight) AS cosine FROM v a JOIN v q ON q.id = '?' AND q.slot = a.slot WHERE a.id <> '?' GROUP BY a.id),
pool AS (SELECT id, round_even(cosine, 4) AS score FROM hits WHERE cosine > 0 ORDER BY score DESC, id LIMIT 15),
kw AS (SELECT id, len(list_intersect(list_distinct(terms), list_distinct(string_split('{QUESTION}', ' ')))) / len(list_distinct(string_split('{QUESTION}', ' '))) AS k FROM (SELECT id, {_DUCK_TOKENS.format(t='text')} AS terms FROM src) JOIN pool USING (id))
"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_chunks").where("text IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("document_id", "chunk_type", "text"), F.struct("created_at", "text")).alias("r"))
    return search.chunk_index(rows.select("id", "r.*"), "id", "document_id", "text", "chunk_type")


@query(f"""WITH {_duck_vectors("SELECT id, text FROM (" + _CORPUS + ")")} SELECT id, slot::INT AS slot, round(weight, 6) AS weight FROM v""")
def hash_embedding_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select(F.col("chunk_id").alias("id"), F.explode("vector").alias("x")).select("id", "x.slot", F.round("x.weight", 6).alias("weight"))


@query(f"""SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_DUCK_TOKENS.format(t='text')}) AS t FROM documents) GROUP BY t""")
def token_bag(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("documents"))


@query(_SEARCH + "SELECT id AS chunk_id, score FROM pool ORDER BY score DESC, id LIMIT 5")
def semantic_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(_index(spark, d), QUESTION, 5).select("chunk_id", "score")


@query(_SEARCH + "SELECT id AS chunk_id, score FROM pool ORDER BY score DESC, id LIMIT 5")
def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index that was written before: a search reads it and computes no vector."""
    import uuid

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search.save_index(_index(spark, d), path)
    return search.semantic(search.load_index(spark, path), QUESTION, 5).select("chunk_id", "score")


@query(_SEARCH + "SELECT id AS chunk_id, round_even((score * 0.72 + k * 0.28) * 100, 1) AS score FROM pool JOIN kw USING (id) ORDER BY round_even((score * 0.72 + k * 0.28) * 100, 1) DESC, pool.score DESC, id LIMIT 5")
def hybrid_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(_index(spark, d), QUESTION, 5).select("chunk_id", "score")


@query()
def qa_context_string(spark: SparkSession, d: str) -> DataFrame:
    return search.context(search.hybrid(_index(spark, d), QUESTION, 5))


@query()
def qa_cited_sources(spark: SparkSession, d: str) -> DataFrame:
    return answers.cited_sources(qa_context_string(spark, d))


@query()
def search_excerpts(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in search.query_terms(QUESTION)])
    best = search.hybrid(_index(spark, d), QUESTION, 10)
    return best.select("chunk_id", T.excerpt(F.col("text"), terms).alias("excerpt"), T.readable_title(F.col("document")).alias("title"), F.array_join("tags", ",").alias("tags"), "score")


@query(f"""WITH c AS (SELECT * FROM ({_CORPUS}) WHERE text <> '') SELECT count(*) AS chunks, count(DISTINCT document) AS documents FROM c""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.statistics(_index(spark, d)).select("chunks", "documents")


@query("""SELECT query_id, id, round(c, 4) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def dense_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    top = search.dense_top_k(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return top.select("query_id", "id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


# Entities, relations, graph


def _duck_terms(text: str) -> str:
    return f"""regexp_extract_all(' ' || regexp_replace(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_ ]', '~', 'g'), '([ ~])', '\\1\\1', 'g') || ' ', '{entities.term_pattern()}', 1)"""


@query(
    "WITH names(form, entity) AS (VALUES "
    + ", ".join(f"('{entities._spread(a)}', '{n}')" for a, (n, _) in C.ALIASES.items() if not entities.CJK.search(a))
    + ", "
    + ", ".join(f"('{a}', '{C.ALIASES[a][0]}')" for a in entities.CJK_ALIASES)
    + f""") SELECT doc_id AS id, entity, count(*) AS mentions FROM (SELECT doc_id, unnest(list_concat({_duck_terms('text')}, regexp_extract_all(text, '{"|".join(entities.CJK_ALIASES)}'))) AS form FROM documents WHERE text IS NOT NULL) JOIN names USING (form) GROUP BY ALL"""
)
def gazetteer_matches(spark: SparkSession, d: str) -> DataFrame:
    return entities.gazetteer_matches(table(spark, d, "documents"), "doc_id", "text").select("id", "entity", "mentions")


@query("""SELECT v AS version, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_.])(v?[0-9]+\\.[0-9]+(?:\\.[0-9]+)?)', 1)) AS v FROM parsed_entities) GROUP BY v""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_entities").select(F.explode(entities.versions(F.col("text"))).alias("version")).groupBy("version").agg(F.count("*").alias("n"))


_KNOWN = ", ".join("'" + a + "'" for a in [*C.ALIASES, *C.KNOWN_ONLY])
_USEFUL = f"""SELECT * FROM (SELECT *, trim(normalized) AS x, lower(trim(normalized)) AS low FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL AND confidence IS NOT NULL AND source IS NOT NULL) WHERE confidence >= 0.7
 AND CASE WHEN low IN ({_KNOWN}) THEN 1.0 WHEN label IN ('PROGRAMMING_LANGUAGE','FRAMEWORK','LIBRARY','DATABASE','TOOL','CONCEPT','FUNCTION','CLASS','DOCUMENT','REPOSITORY') THEN greatest(0.72, confidence)
  WHEN label IN ('PERSON','ORGANIZATION','PRODUCT') THEN CASE WHEN len({_duck_terms("coalesce(context, '')")}) > 0 OR regexp_matches(coalesce(context, ''), '{"|".join(entities.CJK_ALIASES)}') THEN 0.68 ELSE 0.46 END
  WHEN label IN ('DATE','TIME','VERSION') THEN 0.24 ELSE confidence * 0.65 END >= 0.55
 AND low <> '' AND low NOT IN ({", ".join("'" + w + "'" for w in C.STOP_CONCEPTS)}) AND regexp_replace(low, '''s$', '') NOT IN ({", ".join("'" + w + "'" for w in C.GENERIC_WORDS)})
 AND NOT (low LIKE '%''s' AND len(string_split(regexp_replace(low, '\\s+', ' ', 'g'), ' ')) <= 3)
 AND NOT regexp_matches(low, '{"|".join(C.NOISE)}') AND NOT regexp_matches(low, '^[0-9.-]*[0-9][0-9.-]*$')
 AND length(regexp_replace(x, '[\\p{{L}}\\p{{N}} _.-]', '', 'g')) <= length(x) * 0.3
 AND NOT (label = 'CONCEPT' AND source IN ('context','parser','symbol') AND low NOT LIKE '% %' AND low NOT IN ({", ".join("'" + a + "'" for a in C.ALIASES if C.ALIASES[a][1] == "CONCEPT")}, 'array', 'sampling', 'data structure'))
 AND NOT (label IN ('FUNCTION','CLASS') AND length(low) < 3)"""


@query(f"""SELECT label, count(*) AS n, count(DISTINCT normalized) AS names FROM ({_USEFUL}) GROUP BY label""")
def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    return entities.useful(table(spark, d, "parsed_entities")).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("normalized").alias("names"))


@query()
def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    return entities.fold(entities.useful(table(spark, d, "parsed_entities")), ["document_id", "normalized"], ["created_at", "id"])


@query("""WITH per AS (SELECT document_id, normalized AS n, min((-coalesce(confidence, 0), label, normalized)) AS o FROM parsed_entities WHERE document_id IS NOT NULL AND normalized IS NOT NULL GROUP BY ALL)
SELECT a.document_id, a.n AS source, b.n AS target, count(*) AS weight FROM per a JOIN per b ON a.document_id = b.document_id AND a.o < b.o WHERE a.n <> b.n GROUP BY ALL""")
def cooccurrence_relations(spark: SparkSession, d: str) -> DataFrame:
    """Names mentioned in one document, as no sentence of the table holds two."""
    mentions = table(spark, d, "parsed_entities").withColumn("unit", F.col("document_id"))
    found = entities.cooccurrences(mentions, "document_id", "unit", "normalized")
    return found.groupBy("document_id", "source", "target").agg(F.sum("weight").alias("weight"))


@query("""SELECT document_id AS id, a AS source, b AS target, 'USES' AS relation, 0.78::DOUBLE AS confidence FROM (SELECT document_id, min(normalized) AS a, max(normalized) AS b FROM parsed_entities WHERE document_id IS NOT NULL AND regexp_matches(normalized, '^[A-Za-z0-9]+( [A-Za-z0-9]+)*$') GROUP BY 1) WHERE a <> b""")
def pattern_relations(spark: SparkSession, d: str) -> DataFrame:
    """Sentences put together from the names of a document, as no text of the tables holds such a phrase."""
    named = table(spark, d, "parsed_entities").where("document_id IS NOT NULL").where(F.col("normalized").rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+)*$"))
    per = named.groupBy("document_id").agg(F.min("normalized").alias("a"), F.max("normalized").alias("b")).where("a <> b")
    return entities.pattern_relations(per.select(F.col("document_id").alias("id"), F.concat("a", F.lit(" uses "), "b", F.lit(".")).alias("said"), F.array("a", "b").alias("names")), "id", "said", "names")


@query("""SELECT 'ent_' || substr(sha1(label || ':' || lower(trim(regexp_replace(normalized, '\\s+', ' ', 'g')))), 1, 12) AS id, arg_min(normalized, (created_at, id)) AS label, any_value(label) AS type, max(confidence) AS confidence, count(DISTINCT document_id) AS sources
FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL GROUP BY 1""".replace("AS id, arg_min", "AS node, arg_min").replace("(created_at, id)", "(created_at, parsed_entities.id)").replace("SELECT 'ent_'", "SELECT node AS id, * EXCLUDE (node) FROM (SELECT 'ent_'") + ")")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(table(spark, d, "parsed_entities"))


_EDGES = """SELECT 'doc_' || substr(sha1('DOCUMENT:' || lower(document_id)), 1, 12) AS source, 'ent_' || substr(sha1(label || ':' || lower(trim(regexp_replace(normalized, '\\s+', ' ', 'g')))), 1, 12) AS target, count(*) AS weight, max(confidence) AS confidence, 'MENTIONS' AS type
FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2"""


@query(_EDGES)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.mention_edges(table(spark, d, "parsed_entities"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the table and mention edges between documents and them."""
    mentions = table(spark, d, "parsed_entities")
    nodes = graph.nodes(mentions)
    docs = mentions.where("document_id IS NOT NULL").select(F.col("document_id").alias("label")).distinct()
    doc_nodes = docs.select(graph.node_id(F.col("label"), F.lit("DOCUMENT")).alias("id"), "label", F.lit("DOCUMENT").alias("type"), F.lit(1.0).alias("confidence"), F.lit(1).cast("bigint").alias("sources"))
    return nodes.unionByName(doc_nodes), graph.mention_edges(mentions)


_NODES = f"""SELECT id, label, type FROM ({ORACLES['graph_nodes']}) UNION ALL SELECT DISTINCT 'doc_' || substr(sha1('DOCUMENT:' || lower(document_id)), 1, 12), document_id, 'DOCUMENT' FROM parsed_entities WHERE document_id IS NOT NULL"""


@query(f"""WITH n AS ({_NODES}), e AS ({_EDGES}), b AS (SELECT 'node' AS kind, type, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type) SELECT * FROM b UNION ALL SELECT kind, '*', sum(n)::BIGINT FROM b GROUP BY kind""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(*_graph(spark, d))


@query(f"""WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1.0)), 4) AS density""")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.density(*_graph(spark, d))


@query(f"""SELECT id, sum(weight)::BIGINT AS degree FROM (SELECT source AS id, weight FROM ({_EDGES}) UNION ALL SELECT target, weight FROM ({_EDGES})) GROUP BY id""")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.mention_edges(table(spark, d, "parsed_entities")))


_CONCEPT = "'ent_' || substr(sha1('CONCEPT:semantic search'), 1, 12)"


@query(f"""WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT source AS neighbour, n.label, n.type, 'MENTIONS' AS edge_type, weight, 'in' AS direction FROM e JOIN n ON n.id = e.source WHERE target = {_CONCEPT}""")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    import hashlib

    nodes, edges = _graph(spark, d)
    return graph.neighbours(edges, nodes, "ent_" + hashlib.sha1(b"CONCEPT:semantic search").hexdigest()[:12])


@query("""SELECT id, label, node_type AS type FROM graph_nodes WHERE contains(lower(label), 'search') ORDER BY label, id LIMIT 10""")
def graph_search_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes").withColumnRenamed("node_type", "type")
    return graph.search(nodes, "search").select("id", "label", "type")


@query(f"""WITH n AS ({_NODES}), k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(string_split(label, '/')[-1], '.\\.[^.]+$') THEN regexp_replace(string_split(label, '/')[-1], '\\.[^.]+$', '') ELSE label END), '^_+', ''), '[^a-z0-9]+', '', 'g') AS i FROM n WHERE type <> 'DOCUMENT'),
s AS (SELECT * FROM n WHERE type NOT IN ('VERSION','RESOURCE','REPOSITORY','CSV_VALUE','LOCATION','DATE','TIME') AND NOT (type = 'DOCUMENT' AND regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(string_split(label, '/')[-1], '.\\.[^.]+$') THEN regexp_replace(string_split(label, '/')[-1], '\\.[^.]+$', '') ELSE label END), '^_+', ''), '[^a-z0-9]+', '', 'g') IN (SELECT i FROM k)))
SELECT type, count(*) AS n FROM s GROUP BY type""")
def graph_visible(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _graph(spark, d)
    return graph.visible(nodes).groupBy("type").agg(F.count("*").alias("n"))


_IDENTITY = "regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(string_split(label, '/')[-1], '.\\.[^.]+$') THEN regexp_replace(string_split(label, '/')[-1], '\\.[^.]+$', '') ELSE label END), '^_+', ''), '[^a-z0-9]+', '', 'g')"
_DRAWN = f"""WITH n AS (SELECT id, label, type, confidence FROM ({ORACLES['graph_nodes']}) UNION ALL SELECT DISTINCT 'doc_' || substr(sha1('DOCUMENT:' || lower(document_id)), 1, 12), document_id, 'DOCUMENT', 1.0 FROM parsed_entities WHERE document_id IS NOT NULL), e AS ({_EDGES}),
k AS (SELECT DISTINCT {_IDENTITY} AS i FROM n WHERE type <> 'DOCUMENT'),
s AS (SELECT * FROM n WHERE type NOT IN ('VERSION','RESOURCE','REPOSITORY','CSV_VALUE','LOCATION','DATE','TIME') AND NOT (type = 'DOCUMENT' AND {_IDENTITY} IN (SELECT i FROM k))),
d AS (SELECT e.* FROM e WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)),
g AS (SELECT id, sum(weight) AS degree FROM (SELECT source AS id, weight FROM d UNION ALL SELECT target, weight FROM d) GROUP BY id)"""


@query(_DRAWN + """ SELECT s.id, label, type, round(CASE WHEN type = 'DOCUMENT' THEN least(10.5, 6 + coalesce(degree, 0) * 0.65::DOUBLE) ELSE least(19.0, 8 + coalesce(degree, 0) * 1.15::DOUBLE + coalesce(confidence, 0) * 1.5::DOUBLE) END, 4)::DOUBLE AS size FROM s LEFT JOIN g USING (id)""")
def graph_visual_export(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph.drawn(*_graph(spark, d))
    return nodes.withColumn("size", F.col("size").cast("double"))


@query(_DRAWN + " SELECT source, target, type, weight, confidence FROM d")
def graph_visual_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.drawn(*_graph(spark, d))[1]


@query(f"""WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT n.id, n.label, n.type, (SELECT count(*) FROM e WHERE source = {_CONCEPT} OR target = {_CONCEPT}) AS neighbour_count FROM n WHERE id = {_CONCEPT}""")
def graph_node_detail(spark: SparkSession, d: str) -> DataFrame:
    import hashlib

    nodes, edges = _graph(spark, d)
    return graph.detail(edges, nodes, "ent_" + hashlib.sha1(b"CONCEPT:semantic search").hexdigest()[:12]).select("id", "label", "type", "neighbour_count")


_NID = "'ent_' || substr(sha1(label || ':' || lower(trim(regexp_replace(normalized, '\\s+', ' ', 'g')))), 1, 12)"
_EXPORTED = f"""WITH n AS (SELECT id, label, type, coalesce(confidence, 1.0)::DOUBLE AS confidence FROM ({ORACLES['graph_nodes']}) UNION ALL SELECT DISTINCT 'doc_' || substr(sha1('DOCUMENT:' || lower(document_id)), 1, 12), document_id, 'DOCUMENT', 1.0::DOUBLE FROM parsed_entities WHERE document_id IS NOT NULL),
f AS (SELECT nid AS id, document_id, min((created_at, pid)) AS f FROM (SELECT {_NID} AS nid, id AS pid, document_id, created_at FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL AND document_id IS NOT NULL) GROUP BY nid, document_id),
o AS (SELECT id, list(document_id ORDER BY f) AS docs FROM f GROUP BY id),
m AS (SELECT n.*, CASE WHEN type = 'DOCUMENT' THEN [label] ELSE coalesce(docs, []) END AS docs FROM n LEFT JOIN o USING (id)),
e AS (SELECT source, target, type, weight, coalesce(confidence, 1.0)::DOUBLE AS confidence, docs FROM ({_EDGES}) JOIN (SELECT 'doc_' || substr(sha1('DOCUMENT:' || lower(document_id)), 1, 12) AS source, {_NID} AS target, list_sort(list(DISTINCT document_id)) AS docs FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2) USING (source, target)),
p AS (SELECT id, k, arg_max(v, (created_at, pid)) AS v FROM (SELECT {_NID} AS id, id AS pid, created_at, k, json_extract_string(metadata_json, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(metadata_json)) AS k FROM parsed_entities WHERE normalized IS NOT NULL AND label IS NOT NULL)) WHERE v <> '' GROUP BY ALL),
q AS (SELECT id, string_agg(',' || to_json(k) || ':' || to_json(v), '' ORDER BY k) AS more FROM p GROUP BY id)"""


def _export(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the documents that each comes from."""
    mentions = table(spark, d, "parsed_entities")
    nodes, edges = _graph(spark, d)
    of_nodes = graph.node_sources(mentions).unionByName(nodes.where("type = 'DOCUMENT'").select("id", F.col("label").alias("document"), F.lit(None).cast(graph.node_sources(mentions).schema["first"].dataType).alias("first")))
    return graph.with_sources(nodes, of_nodes, ["id"], F.col("first")), graph.with_sources(edges, graph.edge_sources(mentions), ["source", "target", "type"], F.col("document"))


@query(_EXPORTED + """ SELECT 'node' AS kind, id, label, type, '' AS source, '' AS target, '' AS weight, confidence::VARCHAR AS confidence, array_to_string(docs, '; ') AS sources FROM m
UNION ALL SELECT 'edge', source || '->' || target || ':' || type, type, type, source, target, weight::VARCHAR, confidence::VARCHAR, array_to_string(docs, '; ') FROM e""")
def graph_export_csv(spark: SparkSession, d: str) -> DataFrame:
    return graph.as_csv(*_export(spark, d))


@query(_EXPORTED + """ SELECT 'node' AS kind, '{"data":{"id":' || to_json(id) || ',"label":' || to_json(label) || ',"type":' || to_json(type) || ',"confidence":' || confidence::VARCHAR || ',"sources":' || to_json(docs) || coalesce(more, '') || '}}' AS element FROM m LEFT JOIN q USING (id)
UNION ALL SELECT 'edge', '{"data":{"id":' || to_json(source || '->' || target || ':' || type) || ',"source":' || to_json(source) || ',"target":' || to_json(target) || ',"label":' || to_json(type) || ',"type":' || to_json(type) || ',"weight":' || weight || ',"confidence":' || confidence::VARCHAR || ',"sources":' || to_json(docs) || '}}' FROM e""")
def graph_export_cytoscape(spark: SparkSession, d: str) -> DataFrame:
    return graph.as_cytoscape(*_export(spark, d), graph.node_properties(table(spark, d, "parsed_entities")))


_X = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_ATT = "'<attvalues><attvalue for=\"type\" value=\"' || type || '\"/><attvalue for=\"confidence\" value=\"' || confidence::VARCHAR || '\"/><attvalue for=\"sources\" value=\"' || " + _X.format(x="array_to_string(docs, ', ')") + " || '\"/></attvalues>'"


@query(_EXPORTED + " SELECT 1 AS part, '<node id=\"' || id || '\" label=\"' || " + _X.format(x="label") + " || '\">' || " + _ATT + " || '</node>' AS line FROM m UNION ALL SELECT 3, '<edge id=\"' || source || '-&gt;' || target || ':' || type || '\" source=\"' || source || '\" target=\"' || target || '\" label=\"' || type || '\" weight=\"' || weight || '\">' || " + _ATT + " || '</edge>' FROM e UNION ALL SELECT * FROM (VALUES "
       + ", ".join(f"({n}, '{t}')" for n, t in graph.GEXF_PARTS) + ")")
def graph_export_gexf(spark: SparkSession, d: str) -> DataFrame:
    return graph.as_gexf(*_export(spark, d))


# Records and listings


@query("""WITH x AS (SELECT document_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, trim(coalesce(nullif(normalized, ''), text), ' ' || chr(9) || chr(10) || chr(13)) AS n, upper(coalesce(nullif(label, ''), 'ENTITY')) AS k, coalesce(nullif(source, ''), 'parser') AS s, coalesce(confidence, 1.0) AS c, (created_at, id) AS o FROM parsed_entities WHERE text IS NOT NULL)
SELECT sha256(document_id || '|' || lower(n) || '|' || lower(k)) AS id, document_id, substr(arg_min(t, o), 1, 255) AS text, substr(arg_min(n, o), 1, 255) AS normalized, substr(k, 1, 80) AS label, substr(arg_min(s, o), 1, 80) AS source, arg_min(c, o) AS confidence FROM x WHERE t <> '' GROUP BY document_id, lower(n), k""")
def entity_records(spark: SparkSession, d: str) -> DataFrame:
    return records.entity_records(table(spark, d, "parsed_entities"))


@query("""SELECT document_id || ':chunk:' || (i - 1) AS id, document_id, (i - 1)::INT AS chunk_index, coalesce(nullif(c.chunk_type, ''), 'text') AS chunk_type, regexp_replace(c.text, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g') AS text,
 '{"type":"' || coalesce(nullif(c.chunk_type, ''), 'text') || '","start_pos":' || c.start_pos || ',"end_pos":' || c.end_pos || '}' AS metadata_json
FROM (SELECT document_id, i, chunks[i] AS c FROM (SELECT document_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM parsed_documents)) WHERE regexp_replace(c.text, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g') <> ''""")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "parsed_documents").select("document_id", F.posexplode("chunks").alias("i", "c")).select("document_id", "i", "c.*")
    return records.chunk_records(chunks, "document_id", "i", "text", "chunk_type", ["start_pos", "end_pos"])


@query("""SELECT e.id, coalesce(max(d.user_id), 'local-dev') AS user_id FROM (SELECT DISTINCT id, document_id FROM parsed_entities) e LEFT JOIN parsed_documents d USING (document_id) GROUP BY e.id""")
def owned_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_entities").select("id", "document_id").distinct()
    return records.owned(rows, table(spark, d, "parsed_documents")).groupBy("id").agg(F.max("user_id").alias("user_id"))


@query("""SELECT doc_id, original_filename FROM documents WHERE deleted_at IS NULL ORDER BY created_at DESC, doc_id LIMIT 25 OFFSET 50""")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "documents").where("deleted_at IS NULL").select("doc_id", "original_filename", "created_at")
    return records.page_of(live, [F.desc("created_at"), F.col("doc_id")], 50, 25).select("doc_id", "original_filename")


@query("""SELECT doc_id, CASE WHEN original_filename LIKE '%.%' AND string_split(original_filename, '.')[-1] <> '' THEN '.' || lower(string_split(original_filename, '.')[-1]) ELSE 'none' END AS extension,
 CASE WHEN file_size IS NULL OR file_size < 0 THEN 'unknown size' WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024) ELSE printf('%.1f MB', file_size / 1048576) END AS size FROM documents WHERE original_filename IS NOT NULL""")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("original_filename IS NOT NULL")
    return rows.select("doc_id", records.extension_label(F.col("original_filename")).alias("extension"), records.human_size(F.col("file_size")).alias("size"))


@query("""WITH k(e, m) AS (VALUES """ + ", ".join(f"('{e}', '{m}')" for e, kinds in C.EXTENSION_MIMES.items() for m in kinds) + """)
SELECT doc_id, coalesce(lower(file_extension) IN ('html', 'htm') AND mime_type = 'application/octet-stream', FALSE) OR EXISTS (SELECT 1 FROM k WHERE e = lower(file_extension) AND m = mime_type) AS fits FROM documents""")
def mime_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """By the stated types alone, without the bypass for readable text."""
    return table(spark, d, "documents").select("doc_id", records.mime_fits(F.col("file_extension"), F.col("mime_type"), F.lit(False)).alias("fits"))


@query("""SELECT doc_id, array_to_string(list_filter([""" + ", ".join(f"'{c}'" for c in C.PROBED_CONCEPTS) + """], lambda c: contains(lower(text), lower(c))), ',') AS concepts FROM documents WHERE text IS NOT NULL""")
def concept_probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(records.probed_concepts(F.col("text")), ",").alias("concepts"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS word_count, len(b)::INT AS code_blocks, len(b) > 0 AS has_code, regexp_matches(text, '(^|[^!])\\[[^\\]]+\\]\\([^\\)]+\\)') AS has_links, regexp_matches(text, '!\\[[^\\]]*\\]\\([^\\)]+\\)') AS has_images, regexp_matches(text, '(?m)^>\\s+.+$') AS has_blockquotes,
 array_to_string(list_sort(list_distinct(list_transform(b, lambda m: coalesce(nullif(regexp_extract(m, '^```(\\w*)', 1), ''), 'text')))), ',') AS languages
FROM (SELECT doc_id, text, list_filter(regexp_extract_all(text, '(?s)```\\w*\\n.*?```'), lambda m: trim(regexp_extract(m, '(?s)^```\\w*\\n(.*)```$', 1), ' ' || chr(9) || chr(10) || chr(13)) <> '') AS b FROM documents WHERE text IS NOT NULL)""")
def document_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", markup.flags(F.col("text")).alias("f"))
    return rows.select("doc_id", "f.word_count", "f.code_blocks", "f.has_code", "f.has_links", "f.has_images", "f.has_blockquotes", F.array_join("f.languages", ",").alias("languages"))


@query("""SELECT doc_id, n::INT AS n, p AS paragraph FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS n FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda s: regexp_replace(s, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g')), lambda s: s <> '') AS ps FROM documents WHERE text IS NOT NULL))""")
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(markup.paragraphs(F.col("text"))).alias("n", "paragraph"))


@query(f"""SELECT document_id, 'section' AS kind, title, digest FROM ({ORACLES['line_sections']}) WHERE digest <> md5('') UNION ALL SELECT document_id, 'code', language, digest FROM ({ORACLES['code_blocks']})""")
def structure_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_documents").where("raw_text <> ''").select("document_id", F.explode(markup.structure_chunks(F.col("raw_text"))).alias("c"))
    return rows.select("document_id", "c.kind", "c.title", F.md5("c.text").alias("digest"))


@query("""SELECT page_id, 'web-' || coalesce(nullif(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ':', '_'), ''), 'web') || '-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'page') || '.md' AS filename FROM scraped_pages WHERE url IS NOT NULL""")
def page_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scraped_pages").where("url IS NOT NULL").select("page_id", records.page_filename(F.col("url"), F.col("title")).alias("filename"))


@query("""SELECT doc_id AS id, position, step, percent FROM documents, (VALUES (0, 'Parsing document', 15), (1, 'Extracting entities', 40), (2, 'Finding relationships', 60), (3, 'Updating graph', 75), (4, 'Indexing chunks', 90), (5, 'Done', 100)) s(position, step, percent) WHERE text IS NOT NULL
UNION ALL SELECT doc_id, position, step, percent FROM documents, (VALUES (0, 'Parsing document', 15), (1, 'Failed', 100)) s(position, step, percent) WHERE text IS NULL""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return records.progress(table(spark, d, "documents"), "doc_id", F.col("text").isNull())


@query("""SELECT item_id, CASE WHEN regexp_matches(q, 'summarize|summary|总结') AND regexp_matches(q, 'all file|all document|across|所有') THEN 'collection' WHEN regexp_matches(q, 'framework|library|libraries|框架') THEN 'frameworks' WHEN regexp_matches(q, 'main concept|key concept|主要概念|核心概念') THEN 'concepts'
 WHEN regexp_matches(q, 'main content|what is in|what''s in|tell me about|summarize|summary of|内容|总结') THEN 'document' ELSE 'snippets' END AS intent FROM (SELECT item_id, lower(item_text) AS q FROM eval_items WHERE item_text IS NOT NULL)""")
def question_intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("item_text IS NOT NULL").select("item_id", answers.intents(F.col("item_text")).alias("intent"))


@query("""SELECT id, array_to_string(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*(?:async[ \\t]+)?def[ \\t]+([A-Za-z_]\\w*)', 1), lambda f: regexp_replace(f, '^_+', '')), ',') AS functions, array_to_string(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*class[ \\t]+([A-Za-z_]\\w*)', 1), lambda f: regexp_replace(f, '^_+', '')), ',') AS classes
FROM parsed_chunks WHERE chunk_type = 'code' AND text IS NOT NULL""")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = lambda c: F.array_join(F.transform(markup.python_symbols(F.col("text"))[c], records.symbol), ",").alias(c)
    return table(spark, d, "parsed_chunks").where("chunk_type = 'code' AND text IS NOT NULL").select("id", found("functions"), found("classes"))


@query()
def result_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_chunks")
    return rows.select("id", records.result_title(F.col("metadata_json"), F.col("document_name"), F.col("chunk_type")).alias("title"))


@query()
def distinct_concepts(spark: SparkSession, d: str) -> DataFrame:
    return answers.without_redundant(answers.concepts(table(spark, d, "documents"), "text"))


@query()
def document_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Type, title and main points of each document."""
    docs = table(spark, d, "parsed_documents").select("document_id", F.coalesce("title", "document_id").alias("title"), "doc_format", F.coalesce(F.transform("chunks", lambda c: c["text"]), F.array().cast("array<string>")).alias("texts"), F.array().cast("array<string>").alias("terms"))
    return answers.single_summary(docs.withColumnRenamed("document_id", "id"), "title", "doc_format", "texts", "terms", "id")


# Answers


@query("""SELECT id, name, shared FROM (SELECT doc_id AS id, original_filename AS name, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(original_filename), '[a-z0-9]+'), lambda t: length(t) > 2)), ['norgugraph', 'vel', 'txt']))::BIGINT AS shared FROM documents WHERE original_filename IS NOT NULL) WHERE shared >= 2 ORDER BY shared DESC, id LIMIT 1""")
def named_document_match(spark: SparkSession, d: str) -> DataFrame:
    return answers.named_document(table(spark, d, "documents"), "Tell me about norgugraph vel txt", "doc_id", "original_filename")


@query("""WITH t AS (SELECT ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_.]', ' ', 'g') || ' ' AS b FROM documents WHERE text IS NOT NULL), f(name) AS (SELECT unnest(['"""
       + "','".join(C.FRAMEWORK_NAMES) + """']))
SELECT name, count(*) AS signals FROM t JOIN f ON contains(b, ' ' || lower(name) || ' ') OR contains(b, ' ' || lower(name) || '. ') GROUP BY name""")
def framework_signals(spark: SparkSession, d: str) -> DataFrame:
    return answers.framework_signals(table(spark, d, "documents"), "text")


@query()
def main_concepts(spark: SparkSession, d: str) -> DataFrame:
    return answers.concepts(table(spark, d, "documents"), "text")


@query()
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return answers.document_summaries(table(spark, d, "parsed_documents"), "document_id", "title", "doc_format", "raw_text")


# Events: history, limits, progress, metrics


@query("""SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 6""")
def conversation_last6(spark: SparkSession, d: str) -> DataFrame:
    return streams.recent(table(spark, d, "events"), C.HISTORY_WINDOW).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


_LIMIT = """SELECT user_id, epoch_us(w) AS window_us, n AS requests, n - 4 AS rejected FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS n FROM events GROUP BY ALL) WHERE n > 4"""


def _limits(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "requests", "rejected")


@query(_LIMIT)
def rate_limit_violations(spark: SparkSession, d: str) -> DataFrame:
    return _limits(streams.violations(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 4, 86_400))


@query(_LIMIT)
def stream_rate_limit_violations(spark: SparkSession, d: str) -> DataFrame:
    """The same, counted by a stream over the table."""
    events = streams.events_stream(spark, d).withWatermark("ts", streams.LATE)
    counted = streams.drain(streams.windows(events, 86_400), "update", ["user_id", "window_start"])
    return _limits(counted.where("requests > 4").withColumn("rejected", F.col("requests") - 4))


@query("""SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type""")
def stream_event_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = streams.drain(streams.first_per_key(streams.events_stream(spark, d)).select("event_id", "event_type", "ts"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def progress_state_changes(spark: SparkSession, d: str) -> DataFrame:
    return streams.state_changes(table(spark, d, "events")).select("user_id", "event_id", "event_type")


@query("""SELECT event_type, le, n FROM (SELECT event_type, sum((value <= 10)::INT)::BIGINT AS "10.0", sum((value <= 50)::INT)::BIGINT AS "50.0", sum((value <= 100)::INT)::BIGINT AS "100.0", count(value) AS "inf" FROM events GROUP BY event_type) UNPIVOT (n FOR le IN ("10.0", "50.0", "100.0", "inf"))""")
def pipeline_metrics_histogram(spark: SparkSession, d: str) -> DataFrame:
    return streams.histogram(table(spark, d, "events"), "value", [10.0, 50.0, 100.0], "event_type")


@query("""SELECT user_id, event_type, rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS rank FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL)) WHERE rank <= 3""")
def mru_search_history(spark: SparkSession, d: str) -> DataFrame:
    return streams.recent_distinct(table(spark, d, "events"), 3).select("user_id", "event_type", F.col("rank").cast("bigint").alias("rank"))


# The whole way from texts to a graph and answers


@query()
def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.extract(table(spark, d, "parsed_documents"), "document_id", "raw_text")


@query()
def extracted_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "parsed_documents")
    # both are read several times below
    found = cut_lineage(pipeline.extract(docs, "document_id", "raw_text"))
    related = cut_lineage(pipeline.relations(docs, found, "document_id", "raw_text"))
    return graph.statistics(*pipeline.build_graph(found, related))


@query("""SELECT document_id, array_to_string(list_distinct_in_order, ',') AS fields FROM (SELECT document_id, list_transform(list_filter(list_zip(f, range(1, len(f) + 1)), lambda z: list_position(f, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_in_order FROM (
 SELECT document_id, list_filter(regexp_extract_all(raw_text, '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})\\s*:', 1), lambda x: lower(x) NOT IN ('array','false','http','https','object','true','with')) AS f FROM parsed_documents WHERE raw_text IS NOT NULL))""")
def structured_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents").where("raw_text IS NOT NULL").select("document_id", F.array_join(pipeline.structured_fields(F.col("raw_text")), ",").alias("fields"))


@query("""WITH h AS (SELECT document_id, n, length(regexp_extract(line, '^#{1,6}')) AS level FROM (SELECT document_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT document_id, regexp_replace(raw_text, '\\r\\n?', chr(10), 'g') AS t FROM parsed_documents)) WHERE regexp_matches(line, '^#{1,6}[ \\t]+[^ \\t]'))
SELECT a.document_id, a.n::BIGINT AS line, a.level::INT AS level, coalesce(max(b.n), 0)::BIGINT AS parent FROM h a LEFT JOIN h b ON a.document_id = b.document_id AND b.n < a.n AND b.level < a.level GROUP BY ALL""")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "parsed_documents").select("document_id", F.posexplode(markup.lines(F.col("raw_text"))).alias("i", "s"))
    heads = lines.where(F.col("s").rlike(r"^#{1,6}[ \t]+[^ \t]")).select("document_id", (F.col("i") + 1).cast("bigint").alias("line"), F.length(F.regexp_extract("s", "^#{1,6}", 0)).alias("level"))
    return pipeline.nested_sections(heads, "document_id", "line", "level").withColumn("parent", F.coalesce("parent", F.lit(0).cast("bigint")))


@query()
def typed_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_documents").select("document_id", F.posexplode(pipeline.typed_chunks(F.col("raw_text"))).alias("i", "c"))
    return rows.select("document_id", F.col("i").alias("chunk_index"), F.col("c.kind").alias("kind"), F.col("c.text").alias("text"))


@query()
def answer_snippets(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.answer(QUESTION, _index(spark, d), table(spark, d, "parsed_documents"), "document_id", "title", "doc_format", "raw_text")


@query("""SELECT epoch_us(ts) // 60000000 * 60000000 AS window_us, user_id, count(*) AS requests FROM events GROUP BY ALL""")
def endpoint_limits(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a search request under its limit of 60 a minute."""
    rows = table(spark, d, "events").select(F.lit("search").alias("endpoint"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return pipeline.limit_windows(rows, "endpoint", "user_id", "ts").select(F.unix_micros("window_start").alias("window_us"), F.col("client").alias("user_id"), "requests")
