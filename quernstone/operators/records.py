"""Rows as they are stored and shown: chunk and entity records, listings, names and numbers for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def chunk_records(chunks: DataFrame, document: str, index: str, text: str, kind: str, more: list[str]) -> DataFrame:
    """(id, document_id, chunk_index, chunk_type, text, metadata_json): chunks with some text; other columns become JSON."""
    clean = T.strip(F.coalesce(F.col(text), F.lit("")))
    return chunks.where(F.length(clean) > 0).select(
        F.concat_ws(":chunk:", document, F.col(index).cast("string")).alias("id"), F.col(document).alias("document_id"), F.col(index).alias("chunk_index"), F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("text")).alias("chunk_type"),
        clean.alias("text"), F.to_json(F.struct(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("text")).alias("type"), *more)).alias("metadata_json"),
    )


def entity_records(entities: DataFrame, document: str = "document_id", text: str = "text", normalized: str = "normalized", label: str = "label", source: str = "source", confidence: str = "confidence", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(id, document_id, text, normalized, label, source, confidence): one row per document, name (any case) and label, the first
    in order; ids depend on those three alone. Blank texts give no row."""
    clean = T.strip(F.coalesce(F.col(text), F.lit("")))
    name = T.strip(F.coalesce(F.nullif(F.col(normalized), F.lit("")), clean))
    kind = F.upper(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("ENTITY")))
    row = F.struct(F.substring(clean, 1, 255).alias("text"), F.substring(name, 1, 255).alias("normalized"), F.substring(F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("parser")), 1, 80).alias("source"), F.coalesce(confidence, F.lit(1.0)).alias("confidence"))
    kept = entities.where(F.length(clean) > 0).select(F.col(document).alias("document_id"), F.lower(name).alias("_low"), kind.alias("_kind"), F.struct(*order).alias("_at"), row.alias("_row"))
    first = kept.groupBy("document_id", "_low", "_kind").agg(F.min_by("_row", "_at").alias("_row"))
    return first.select(F.sha2(F.concat_ws("|", "document_id", "_low", F.lower("_kind")), 256).alias("id"), "document_id", "_row.text", "_row.normalized", F.substring("_kind", 1, 80).alias("label"), "_row.source", "_row.confidence")


def owned(rows: DataFrame, documents: DataFrame, document: str = "document_id", user: str = "user_id") -> DataFrame:
    """rows with their document's owner; the default user where the document or its owner isn't known."""
    owners = documents.select(F.col(document).alias("_d"), F.col(user).alias("_u")).dropDuplicates(["_d"])
    return rows.drop(user).join(owners, rows[document] == F.col("_d"), "left").withColumn(user, F.coalesce("_u", F.lit(C.DEFAULT_USER))).drop("_d", "_u")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows of which nothing was deleted; deleting what isn't there changes nothing."""
    return rows.join(gone.select(F.col(key).alias("_g")).distinct(), rows[key] == F.col("_g"), "left_anti")


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a listing; Spark keeps the first offset + limit rows of each partition."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def result_title(metadata: Column, document: Column, chunk_type: Column) -> Column:
    """What a search result is called: its section, title or header, else its page, else the file for plain parts, else its type."""
    stated = [F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in ("section", "title", "header")]
    page = F.nullif(F.get_json_object(metadata, "$.page"), F.lit(""))
    return (
        F.when(F.coalesce(*stated).isNotNull(), T.title_case(T.strip(F.coalesce(*stated)))).when(page.isNotNull(), F.concat(F.lit("Page "), page))
        .when(chunk_type.isin("section", "paragraph", "text"), T.readable_title(document)).otherwise(T.title_case(F.translate(chunk_type, "_", " ")))
    )


def shown_results(results: DataFrame, percent: bool = False) -> DataFrame:
    """(title, type, score, excerpt, source, tags) of a search as a client gets it; scores of 0 to 1 are shown in percent."""
    score = F.col("score") * (100 if percent else 1)
    return results.select("title", "type", F.bround(score, 1).alias("score"), "excerpt", "source", F.coalesce("tags", F.array("chunk_type")).alias("tags"))


def parsed_time(value: Column) -> Column:
    """A timestamp; now where the text is none."""
    return F.coalesce(F.try_to_timestamp(value), F.current_timestamp())


def symbol(name: Column) -> Column:
    """A symbol without the underscores before it."""
    return F.regexp_replace(T.strip(name), "^_+", "")


def probed_concepts(text: Column) -> Column:
    """The known subjects that a text holds in any case."""
    return F.filter(F.array(*[F.lit(c) for c in C.PROBED_CONCEPTS]), lambda c: F.contains(F.lower(text), F.lower(c)))


def extension_label(filename: Column) -> Column:
    suffix = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("")
    return F.when(F.length(suffix) > 0, F.concat(F.lit("."), suffix)).otherwise("none")


def human_size(size: Column) -> Column:
    scaled = lambda k: F.regexp_replace(F.format_number(size / k, 1), ",", "")
    return (
        F.when(size.isNull() | (size < 0), "unknown size").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(scaled(1024), F.lit(" KB"))).otherwise(F.concat(scaled(1024 * 1024), F.lit(" MB")))
    )


def human_age(when: Column, now: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(when))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86_400)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(when.isNull(), "unknown").when(seconds < 45, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h"))
        .when(days < 7, said(days, "d")).otherwise(F.date_format(when, "yyyy-MM-dd"))
    )


def mime_fits(extension: Column, mime: Column, readable: Column) -> Column:
    """Whether content of a detected type may have an extension; readable text may have that of any text format."""
    allowed = F.create_map(*[x for e, kinds in C.EXTENSION_MIMES.items() for x in (F.lit(e), F.array(*[F.lit(k) for k in kinds]))])
    ext = F.lower(extension)
    return F.coalesce((ext.isin(*C.TEXT_EXTENSIONS) & readable) | (ext.isin("html", "htm") & (mime == "application/octet-stream")) | F.array_contains(allowed[ext], mime), F.lit(False))


def page_fits(content_type: Column, content_length: Column) -> Column:
    """Whether a response may be read as a page: its stated type is one of text, its stated length isn't too large. What isn't stated passes."""
    kind = F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))
    size = F.when(content_length.rlike(r"^\d+$"), content_length.cast("bigint"))
    return ((F.length(kind) == 0) | kind.isin(*C.PAGE_TYPES)) & (F.coalesce(size, F.lit(0)) <= C.MAX_PAGE)


def page_filename(url: Column, title: Column) -> Column:
    host = F.coalesce(F.nullif(F.translate(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), ":", "_"), F.lit("")), F.lit("web"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.concat(F.lit("web-"), host, F.lit("-"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("page")), F.lit(".md"))


#: Steps of one document's way and how far it then is, in percent.
STEPS = (("Parsing document", 15), ("Extracting entities", 40), ("Finding relationships", 60), ("Updating graph", 75), ("Indexing chunks", 90), ("Done", 100))


def progress(documents: DataFrame, id_col: str, failed: Column) -> DataFrame:
    """(id, position, step, percent): the steps that each document reports; a failed one ends with Failed after its first."""
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(p).alias("percent")) for s, p in STEPS])
    broken = F.concat(F.slice(steps, 1, 1), F.array(F.struct(F.lit("Failed").alias("step"), F.lit(100).alias("percent"))))
    return documents.select(F.col(id_col).alias("id"), F.posexplode(F.when(failed, broken).otherwise(steps)).alias("position", "s")).select("id", "position", "s.step", "s.percent")


def layout_headings(words: DataFrame, document: str = "document_id", page: str = "page", text: str = "text", size: str = "size", position: str = "position", most: int = 20) -> DataFrame:
    """(document, page, position, text, size): words of a page set in a size of at least 1.25 times its mean, and 13; the first 20 of a page."""
    clean = T.strip(F.col(text))
    mean = F.avg(F.when(F.length(text) > 0, F.col(size))).over(Window.partitionBy(document, page))
    large = words.withColumn("_t", clean).withColumn("_m", mean).where((F.length("_t") > 2) & (F.col(size) >= F.greatest(F.col("_m") * 1.25, F.lit(13.0))))
    ranked = large.withColumn("_n", F.row_number().over(Window.partitionBy(document, page).orderBy(position))).where(F.col("_n") <= most)
    return ranked.select(document, page, position, F.col("_t").alias("text"), F.round(size, 2).alias("size"))
