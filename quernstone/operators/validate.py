"""Upload checks as columns: each row gets a reason for rejection or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def any_pattern(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def readable_ratio(text: Column) -> Column:
    """Share of printable characters, tab, CR and LF among the first 65,536; 1 for empty text."""
    sample = F.substring(text, 1, C.SCAN_WINDOW)
    kept = F.regexp_replace(sample, r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}&&[^\r\n\t]]|[\p{Zs}&&[^ ]]", "")
    return F.when(F.length(sample) > 0, F.length(kept) / F.length(sample)).otherwise(1.0)


def safe_filename(name: Column) -> Column:
    """Base name with unsafe characters replaced, its stem cut at 200 and its extension in lower case."""
    base = F.translate(F.element_at(F.split(name, "/"), -1), '<>:"|?*\0', "________")
    suffix = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(F.substr(base, F.lit(1), F.length(base) - F.length(suffix)), 1, 200)
    return F.when(F.length(stem) > 0, F.concat(stem, F.lower(suffix))).otherwise(F.concat(F.lit("upload"), F.lower(suffix)))


def mime(content: Column) -> Column:
    """Type of a binary column by its first bytes, as a fallback detector sees it."""
    text = F.try_validate_utf8(content) if hasattr(F, "try_validate_utf8") else F.decode(content, "UTF-8")
    start = F.ltrim(F.translate(text, "\t\r\n", "   "))
    return (
        F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "application/pdf").when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "application/zip")
        .when(start.startswith("{") | start.startswith("["), "application/json").when(text.isNotNull(), "text/plain").otherwise("application/octet-stream")
    )


def reject_reason(extension: Column, size: Column, text: Column) -> Column:
    """The first check that fails: extension, size, readable, html, danger; null for accepted rows. Null text counts as empty."""
    ext, body = F.lower(extension), F.substring(F.coalesce(text, F.lit("")), 1, C.SCAN_WINDOW)
    html = ext.isin("html", "htm")
    markup = F.lower(body).rlike(r"<!doctype\s+html|<html[\s>]|<(head|body|meta|title|div|p|span|a|section|article)[\s>]")
    return (
        F.when(~F.coalesce(ext.isin(*C.EXTENSIONS), F.lit(False)), "extension")
        .when(~F.coalesce((size > 0) & (size <= C.MAX_UPLOAD), F.lit(False)), "size")
        .when(ext.isin(*C.TEXT_EXTENSIONS) & (readable_ratio(body) < C.READABLE_RATIO), "readable")
        .when(html & ~markup, "html")
        .when(F.when(html, any_pattern(body, C.DANGER_HTML)).otherwise(any_pattern(body, C.DANGER)), "danger")
    )


def split_valid(df: DataFrame, extension: str = "file_extension", size: str = "file_size", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    marked = df.withColumn("reject_reason", reject_reason(F.col(extension), F.col(size), F.col(text)))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def public_address(url: Column) -> Column:
    """Whether an address is http(s) and its host isn't a private, loopback, link-local, multicast or reserved IP or a local name."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    octet = lambda k: F.regexp_extract(host, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", k).cast("int")
    a, b = F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), octet(1)), F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), octet(2))
    blocked = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    local = host.isin("localhost") | host.endswith(".local") | host.endswith(".internal") | host.rlike(r"^\[(?:::1|f[cd]|fe80)")
    return F.coalesce(F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & ~local & ~F.coalesce(blocked, F.lit(False)), F.lit(False))
