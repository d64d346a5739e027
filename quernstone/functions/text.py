"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))), F.lit(0)).cast("bigint")


def reading_minutes(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words / 250)).cast("bigint")


def tokens(text: Column) -> Column:
    """Search terms: ASCII words of two characters or more, with aliases replaced."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_+#.-]*"), F.lit(0))
    alias = F.create_map(*[F.lit(x) for pair in C.TOKEN_ALIASES.items() for x in pair])
    trimmed = F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", "")), lambda t: F.length(t) >= 2)
    return F.transform(trimmed, lambda t: F.coalesce(alias[t], t))


def searchable(text: Column) -> Column:
    """Without lines that only state a source address."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~s.rlike(r"(?i)^\s*source:\s*https?://\S+\s*$"))
    return strip(F.array_join(lines, "\n"))


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    parts = F.split(text, r"(?<=[^\p{L}])(?=\p{L})|(?<=\p{L})(?=[^\p{L}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def readable_title(filename: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", "")
    return title_case(F.translate(stem, "_-", "  "))


def windows(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Sliding windows as array<struct<start,end,text>>; blank ones stay, for the caller to drop. Overlap >= size becomes size / 5."""
    step = size - (overlap if overlap < size else size // 5)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start_pos"), F.least(s + size, F.length(text)).alias("end_pos"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def hash_slot(token: Column, size: int = C.VECTOR_SIZE) -> Column:
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha1(token), 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)


def embed(toks: Column) -> Column:
    """Sparse hashed vector of length 1 as array<struct<slot,weight>>: per slot the signed sum of 1 + ln(count). Empty without tokens.

    Counts and sums come from runs in sorted arrays, so that beyond its sort a text's cost grows with its length alone.
    """

    def runs(sorted_: Column, key) -> Column:
        """array<struct<at,n>>: where each run of equal keys begins in a sorted array, and how long it is."""
        places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (key(F.get(sorted_, i)) != key(F.get(sorted_, i - 1))))
        return let(starts, lambda first: F.transform(first, lambda at, j: F.struct(at.alias("at"), (F.coalesce(F.get(first, j + 1), F.size(sorted_)) - at).alias("n"))))

    def by_slot(sorted_: Column) -> Column:
        term = lambda r: F.get(sorted_, r["at"])
        signed = F.transform(runs(sorted_, lambda t: t), lambda r: F.struct(hash_slot(term(r)).alias("slot"), (hash_sign(term(r)) * (1 + F.log(r["n"].cast("double")))).alias("w")))
        summed = lambda xs: F.transform(runs(xs, lambda x: x["slot"]), lambda r: F.struct(F.get(xs, r["at"])["slot"].alias("slot"), F.aggregate(F.slice(xs, r["at"] + 1, r["n"]), F.lit(0.0), lambda a, x: a + x["w"]).alias("w")))
        return F.filter(let(F.array_sort(signed), summed), lambda x: x["w"] != 0)

    def unit(summed: Column) -> Column:
        norm = F.sqrt(F.aggregate(summed, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return let(norm, lambda n: F.transform(summed, lambda x: F.struct(x["slot"].alias("slot"), (x["w"] / n).alias("weight"))))

    return let(F.array_sort(toks), lambda ordered: let(by_slot(ordered), unit))


def excerpt(text: Column, terms: Column, limit: int = C.EXCERPT_LENGTH) -> Column:
    """A readable part of about `limit` characters near the first of the terms found."""

    def start_of(clean: Column, start: Column) -> Column:
        head = F.substring(clean, F.lit(1), start)
        back = F.greatest(*[F.when(F.instr(F.reverse(head), " " + m) > 0, F.length(head) - F.instr(F.reverse(head), " " + m) - 1).otherwise(-1) for m in ".?!"])
        after = F.instr(F.substring(clean, start + 1, F.length(clean)), " ")
        return let(back, lambda b: F.when(start <= 0, 0).when((b >= 0) & (start - b < C.EXCERPT_SNAP), b + 2).when(after > 0, start + after).otherwise(start))

    def end_of(clean: Column, end: Column) -> Column:
        tail, before = F.substring(clean, end + 1, F.length(clean)), F.substring(clean, F.lit(1), end)
        ahead = F.array_min(F.filter(F.array(*[F.instr(tail, m + " ") for m in ".?!"]), lambda p: p > 0))
        last = F.length(before) - F.instr(F.reverse(before), " ")
        snapped = lambda a: F.when(end >= F.length(clean), F.length(clean)).when(a.isNotNull() & (a - 1 < C.EXCERPT_SNAP), end + a)
        return let(ahead, lambda a: snapped(a).when(F.instr(before, " ") > 1, last).otherwise(end))

    def cut(clean: Column, start: Column) -> Column:
        end = end_of(clean, F.least(F.length(clean), start + (limit - 3)))
        return let(
            F.struct(start_of(clean, start).alias("a"), end.alias("b")),
            lambda e: F.concat(F.when(e["a"] > 0, "...").otherwise(""), strip(F.substring(clean, e["a"] + 1, e["b"] - e["a"])), F.when(e["b"] < F.length(clean), "...").otherwise("")),
        )

    def whole(clean: Column) -> Column:
        hits = F.filter(F.transform(terms, lambda t: F.instr(F.lower(clean), t)), lambda p: p > 0)
        plain = F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("..."))
        return F.when(F.length(clean) <= limit, clean).otherwise(let(F.array_min(hits), lambda c: F.when(c.isNull(), plain).otherwise(let(F.greatest(F.lit(0), c - 1 - limit // 3), lambda s: cut(clean, s)))))

    return let(collapse(F.regexp_replace(text, r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1 ($2)")), whole)


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")
