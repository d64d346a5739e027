"""Reading files of every accepted kind into one table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import markup, validate
from . import parsers

PARSED = "title string, format string, raw_text string, sections array<struct<title:string,level:int,content:string>>, imports array<string>, functions array<string>, classes array<string>, hints array<struct<type:string,text:string>>, error string"


def decode(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, extension, file_size, modified_at, content) of accepted files below root, and of nothing outside it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.select("path", name.alias("name"), ext.alias("extension"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content").where(F.col("extension").isin(*C.EXTENSIONS))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Sidecar records: JSON files that hold at least a filename, an owner and a hash; newest first. An uploaded JSON document isn't one."""
    schema = "filename string, stored_filename string, original_filename string, file_size bigint, file_extension string, file_hash string, mime_type string, user_id string, created_at timestamp, _corrupt string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt").json(root)
    return rows.where("filename IS NOT NULL AND file_hash IS NOT NULL AND _corrupt IS NULL").drop("_corrupt").orderBy(F.desc("created_at"), "filename")


def parse(rows: DataFrame) -> DataFrame:
    """Adds `parsed` to (name, extension, content). Markdown, text, JavaScript and TypeScript stay in the JVM; only the other formats go
    through Arrow. A file that can't be parsed has its error, the others are unaffected."""
    native = rows.where(F.col("extension").isin("md", "txt", "js", "ts"))
    other = rows.where(~F.col("extension").isin("md", "txt", "js", "ts"))
    text = decode(F.col("content"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    is_md, is_js = F.col("extension") == "md", F.col("extension").isin("js", "ts")
    parts = F.when(is_md, markup.sections(text))
    outline = markup.js_outline(text)
    none = F.array().cast("array<string>")
    first = F.get(F.filter(parts, lambda s: s["level"] == 1), F.lit(0))["title"]
    parsed = F.struct(
        F.coalesce(first, stem).alias("title"), F.col("extension").alias("format"), F.when(is_md, markup.without_code(text)).otherwise(text).alias("raw_text"), parts.alias("sections"),
        F.when(is_js, outline["imports"]).otherwise(none).alias("imports"), F.when(is_js, outline["functions"]).otherwise(none).alias("functions"), F.when(is_js, outline["classes"]).otherwise(none).alias("classes"),
        F.array().cast("array<struct<type:string,text:string>>").alias("hints"), F.lit(None).cast("string").alias("error"),
    )
    udf = F.pandas_udf(parsers.parse_series, PARSED)
    return native.withColumn("parsed", parsed.cast(f"struct<{_inline(PARSED)}>")).unionByName(other.withColumn("parsed", udf("name", "extension", "content")))


def _inline(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
        depth += kind.count("<") - kind.count(">")
    return ",".join(out)


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that pass the checks, rejected ones with the reason)."""
    marked = rows.withColumn("_text", F.when(F.col("extension").isin(*C.TEXT_EXTENSIONS), decode(F.col("content"))))
    reason = F.coalesce(
        validate.reject_reason(F.col("extension"), F.col("file_size"), F.col("_text")),
        F.when((F.col("extension") == "pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF")), "signature").when((F.col("extension") == "docx") & (F.substring("content", 1, 4) != F.lit(b"PK\x03\x04")), "signature"),
    )
    marked = marked.withColumn("reject_reason", reason).drop("_text")
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def csv_profile(df: DataFrame, columns: list[str], accuracy: int = 100_000) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numeric columns: one pass over the rows for all columns together, whose
    partial results are small whatever the number of rows. Quartiles are those of the stated rank up to 1 / accuracy of the rows."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev(c), 4).alias("std"), F.round(F.min(c), 4).alias("min"),
        F.approx_percentile(c, [0.25, 0.5, 0.75], accuracy).alias("q"), F.round(F.max(c), 4).alias("max"),
    )
    rows = numbers.agg(F.array(*[one(c) for c in columns]).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    return rows.select("column", "count", "mean", "std", "min", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def column_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dtype, filled, distinct, samples) of every column: type, values that aren't null, about how many differ, the three least as text."""
    kinds = dict(df.dtypes)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    per = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    each = per.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"))
    from ..operators.catalog import latest_per

    least = latest_per(per, ["column"], 3, [F.col("value")]).groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    named = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return each.join(least, "column").select("column", named[F.col("column")].alias("dtype"), "filled", "distinct", "samples")


def value_hints(df: DataFrame, columns: list[str], per_column: int = 20, most: int = 100) -> DataFrame:
    """(column, value) of text columns with few values: short ones that aren't numbers, up to 20 a column and 100 in all."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("x")).select("x.*")
    distinct = long.where((F.length("value").between(2, 80)) & ~F.col("value").rlike(r"^[-+0-9.,]+$")).distinct()
    from ..operators.catalog import latest_per

    return latest_per(distinct, ["column"], per_column, [F.col("value")]).drop("rank").orderBy("column", "value").limit(most)
