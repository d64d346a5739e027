"""Entities and relations: gazetteer and pattern extraction, quality filter, ordered fold, co-occurrence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

CJK = re.compile(r"[一-鿿]")
WORD_ALIASES = sorted((a for a in C.ALIASES if not CJK.search(a)), key=lambda a: (-len(a), a))
CJK_ALIASES = sorted((a for a in C.ALIASES if CJK.search(a)), key=lambda a: (-len(a), a))


def _spread(alias: str) -> str:
    return re.sub(r"([ ~])", r"\1\1", re.sub(r"[^a-z0-9_ ]", "~", alias))


def term_pattern() -> str:
    """Longest terms first, so that a phrase isn't found as its part; separators stand doubled on both sides."""
    return r"[ ~](" + "|".join(_spread(a) for a in WORD_ALIASES) + r")[ ~]"


def found_terms(text: Column) -> Column:
    """array<string>: the known terms' spellings in a text, as written in the alias table's separator form."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ ]", "~"), r"([ ~])", "$1$1")
    plain = F.regexp_extract_all(F.concat(F.lit(" "), marked, F.lit(" ")), F.lit(term_pattern()), F.lit(1))
    han = F.regexp_extract_all(text, F.lit("(" + "|".join(CJK_ALIASES) + ")"), F.lit(1))
    return F.concat(plain, han)


def gazetteer_matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity, label, mentions) of every known term in every text. One pass of one pattern per text: no join with the terms."""
    names = F.create_map(*[F.lit(x) for a, (n, _) in C.ALIASES.items() for x in (a if CJK.search(a) else _spread(a), n)])
    labels = F.create_map(*[F.lit(x) for label, group in C.GAZETTEER.items() for n in group for x in (n, label)])
    hits = df.select(F.col(id_col).alias("id"), F.explode(found_terms(F.col(text_col))).alias("form")).withColumn("entity", names[F.col("form")])
    return hits.groupBy("id", "entity").agg(F.count("*").alias("mentions")).withColumn("label", labels[F.col("entity")])


def versions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_.])(v?[0-9]+\.[0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def repositories(text: Column) -> Column:
    pattern = F.lit(r"https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)")
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("b"))
    return F.transform(both, lambda z: F.concat_ws("/", z["a"], z["b"]))


def _known(lowered: Column) -> Column:
    return lowered.isin(*C.ALIASES, *C.KNOWN_ONLY)


def is_noise(text: Column) -> Column:
    clean = T.collapse(text)
    low = F.lower(clean)
    base = F.regexp_replace(low, r"'s$", "")
    special = F.length(F.regexp_replace(clean, r"[\p{L}\p{N} _.-]", ""))
    shapes = reduce(lambda a, b: a | b, [low.rlike(p) for p in C.NOISE])
    return (
        base.isin(*C.GENERIC_WORDS) | (low.endswith("'s") & (F.size(F.split(clean, " ")) <= 3)) | shapes
        | low.rlike(r"^[0-9.-]*[0-9][0-9.-]*$") | (special > F.length(clean) * 0.3)
    )


def relevance(text: Column, label: Column, confidence: Column, context: Column) -> Column:
    domain = F.size(found_terms(F.coalesce(context, F.lit("")))) > 0
    place = F.lower(F.coalesce(context, F.lit(""))).rlike("|".join(C.GEOGRAPHY))
    return (
        F.when(_known(F.lower(text)), 1.0).when(label.isin(*C.RELEVANT_LABELS), F.greatest(F.lit(0.72), confidence))
        .when(label.isin("PERSON", "ORGANIZATION", "PRODUCT"), F.when(domain, 0.68).otherwise(0.46))
        .when(label == "LOCATION", F.when(place, 0.66).otherwise(0.32)).when(label.isin("DATE", "TIME", "VERSION"), 0.24).otherwise(confidence * 0.65)
    )


def is_low_value(text: Column, label: Column, confidence: Column, source: Column, context: Column) -> Column:
    low = F.lower(T.strip(text))
    single = ~low.contains(" ") & ~low.isin(*[a for a in C.ALIASES if C.ALIASES[a][1] == "CONCEPT"], "array", "sampling", "data structure")
    return F.coalesce(
        (confidence < C.MIN_CONFIDENCE) | (relevance(T.strip(text), label, confidence, context) < C.RELEVANCE_CUT) | (F.length(low) == 0) | low.isin(*C.STOP_CONCEPTS) | is_noise(text)
        | ((label == "CONCEPT") & source.isin("context", "parser", "symbol") & single) | (label.isin("FUNCTION", "CLASS") & (F.length(low) < 3)),
        F.lit(True),
    )


def useful(entities: DataFrame, text_col: str = "normalized") -> DataFrame:
    """Rows that the filter keeps; null text, label or confidence count as low value."""
    return entities.where(~is_low_value(F.col(text_col), F.col("label"), F.col("confidence"), F.col("source"), F.col("context")))


def fold(entities: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, label, confidence, source, mentions): the ordered fold of each key's mentions. A later mention wins with higher confidence, or
    equal confidence and a preferred label; one that doesn't win but comes from another source adds 0.05, up to 1."""
    rank = F.create_map(*[F.lit(x) for pair in C.LABEL_PRIORITY.items() for x in pair])
    one = F.struct(*order, F.col("confidence").cast("double").alias("c"), F.coalesce(rank[F.col("label")], F.lit(0)).alias("p"), F.col("label").alias("l"), F.coalesce("source", F.lit("")).alias("s"))
    grouped = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("m"))
    start = F.struct(F.lit(-1.0).alias("c"), F.lit(-1).alias("p"), F.lit("").alias("l"), F.lit("").alias("s"))

    def step(a: Column, x: Column) -> Column:
        better = (x["c"] > a["c"]) | ((x["c"] == a["c"]) & (x["p"] > a["p"]))
        boosted = F.struct(F.least(F.lit(1.0), a["c"] + C.OTHER_SOURCE_BOOST).alias("c"), a["p"].alias("p"), a["l"].alias("l"), a["s"].alias("s"))
        return F.when(better, F.struct(x["c"].alias("c"), x["p"].alias("p"), x["l"].alias("l"), x["s"].alias("s"))).when(x["s"] != a["s"], boosted).otherwise(a)

    best = grouped.withColumn("b", F.aggregate("m", start, step))
    return best.select(*keys, F.col("b.l").alias("label"), F.round("b.c", 6).alias("confidence"), F.col("b.s").alias("source"), F.size("m").alias("mentions"))


def acronym(text: Column) -> Column:
    parts = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: F.length(w) > 0)
    return F.when(F.size(parts) >= 2, F.lower(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))).otherwise("")


def semantic_duplicates(folded: DataFrame, document: str, name: str) -> DataFrame:
    """(document, name, same_as): names of one document that are another's acronym, by an equi-join on the acronym."""
    full = folded.select(F.col(document).alias("d"), F.col(name).alias("same_as"), acronym(F.col(name)).alias("a")).where("a <> ''")
    return folded.join(full, (folded[document] == full["d"]) & (F.lower(folded[name]) == full["a"])).select(folded[document], folded[name], "same_as")


#: What an entity's confidence gains when it stands for another's acronym.
SAME_BOOST = 0.04


def merged(folded: DataFrame, document: str, name: str) -> DataFrame:
    """folded with acronyms and the names they stand for made one within their document: the surer of the two stays, of equals the
    preferred label, then the full name; its confidence rises by 0.04 from the greater one, up to 1. mentions are added.

    An acronym that fits several names goes to the first of them by name. The names of one document meet by an equi-join on the acronym.
    """
    rank = F.create_map(*[F.lit(x) for pair in C.LABEL_PRIORITY.items() for x in pair])
    same = semantic_duplicates(folded, document, name).groupBy(document, name).agg(F.min("same_as").alias("same_as"))
    keyed = folded.join(same, [document, name], "left").withColumn("_group", F.coalesce("same_as", name))
    rest = [c for c in folded.columns if c not in (document, "mentions")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", F.coalesce(rank[F.col("label")], F.lit(0)), F.col("same_as").isNull()))
    one = keyed.groupBy(document, "_group").agg(best.alias("_b"), F.sum("mentions").cast("int").alias("mentions"), F.count("*").alias("_n"))
    sure = F.when(F.col("_n") > 1, F.round(F.least(F.lit(1.0), F.col("_b.confidence") + SAME_BOOST), 6)).otherwise(F.col("_b.confidence"))
    return one.select(document, *[sure.alias(c) if c == "confidence" else F.col(f"_b.{c}").alias(c) for c in rest], "mentions").select(*folded.columns)


def pair_relation(a: Column, b: Column) -> Column:
    known = F.create_map(*[F.lit(x) for (p, q), r in C.TYPE_PAIRS.items() for x in (f"{p}|{q}", r)])
    return F.coalesce(known[F.concat_ws("|", a, b)], F.lit("RELATED_TO"))


def cooccurrences(mentions: DataFrame, document: str, sentence: str, name: str) -> DataFrame:
    """(document, source, target, relation, confidence, weight): names of one sentence, ordered pairs by (-confidence, label, name).

    Pairs are made inside a sentence's own array, so their number is bounded by what one sentence names."""
    item = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("o"), F.col("label").alias("l"), F.col(name).alias("n"))
    per = mentions.where(F.col(sentence).isNotNull() & F.col(name).isNotNull()).groupBy(document, sentence, F.col(name)).agg(F.min(item).alias("i"))
    per = per.groupBy(document, sentence).agg(F.array_sort(F.collect_list("i")).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda a, i: F.transform(F.slice("xs", i + 2, F.greatest(F.size("xs") - i - 1, F.lit(0))), lambda b: F.struct(a["n"].alias("source"), b["n"].alias("target"), pair_relation(a["l"], b["l"]).alias("relation")))))
    flat = per.select(F.col(document), F.explode(pairs).alias("p")).select(document, "p.*").where("source <> target")
    return flat.groupBy(document, "source", "target", "relation").agg(F.count("*").alias("weight")).withColumn("confidence", F.lit(C.COOCCURRENCE_CONFIDENCE))


def pattern_relations(texts: DataFrame, id_col: str, text_col: str, names_col: str) -> DataFrame:
    """(id, source, target, relation, confidence): phrases such as "A uses B" between a text's own names (an array column); each side means
    the longest name that it holds, and sides that mean the same give nothing."""
    longest = lambda side: F.array_max(
        F.transform(F.filter(F.col(names_col), lambda n: F.contains(F.lower(side), F.lower(n))), lambda n: F.struct(F.length(n).alias("k"), n.alias("n")))
    )["n"]
    out = None
    for relation, verb in C.PATTERN_RELATIONS.items():
        pattern = F.lit(rf"(?i)(.+?)\s+{verb}\s+(.+?)(?:\.|,|$)")
        hit = texts.select(
            F.col(id_col).alias("id"), F.col(names_col),
            F.explode(F.arrays_zip(F.regexp_extract_all(F.col(text_col), pattern, F.lit(1)).alias("a"), F.regexp_extract_all(F.col(text_col), pattern, F.lit(2)).alias("b"))).alias("z"),
        )
        rows = hit.select("id", longest(F.col("z.a")).alias("source"), longest(F.col("z.b")).alias("target"), F.lit(relation).alias("relation"))
        out = rows if out is None else out.unionByName(rows)
    return out.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct().withColumn("confidence", F.lit(C.PATTERN_CONFIDENCE))
