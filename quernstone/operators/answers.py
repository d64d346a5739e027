"""Extractive answers: question intents, named documents, frameworks, concepts, summaries, sources, slices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def intent(question: str) -> str:
    """The kind of answer a question asks for, by the order in which kinds are tried."""
    q = question.lower()
    held = lambda words: any(w in q for w in words)
    if held(C.COLLECTION_ASKED) and held(C.COLLECTION_MEANT):
        return "collection"
    for kind, words in (("frameworks", C.FRAMEWORKS_ASKED), ("concepts", C.CONCEPTS_ASKED), ("document", C.DOCUMENT_ASKED)):
        if held(words):
            return kind
    return "snippets"


def intents(questions: Column) -> Column:
    """The same for a column of questions."""
    q = F.lower(questions)
    held = lambda words: q.rlike("|".join(re.escape(w) for w in words))
    return (
        F.when(held(C.COLLECTION_ASKED) & held(C.COLLECTION_MEANT), "collection").when(held(C.FRAMEWORKS_ASKED), "frameworks").when(held(C.CONCEPTS_ASKED), "concepts")
        .when(held(C.DOCUMENT_ASKED), "document").otherwise("snippets")
    )


def title_tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(*C.TITLE_STOP)))


def named_document(docs: DataFrame, question: str, id_col: str, name_col: str, least: int = 2) -> DataFrame:
    """The document whose name shares most words with the question, at least two; the smaller id of several. A scan and a top-1."""
    wanted = sorted({t for t in re.findall(r"[a-z0-9]+", question.lower()) if len(t) > 2 and t not in C.TITLE_STOP})
    shared = F.size(F.array_intersect(title_tokens(F.col(name_col)), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
    return docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), shared.cast("bigint").alias("shared")).where(F.col("shared") >= least).orderBy(F.desc("shared"), "id").limit(1)


def framework_signals(snippets: DataFrame, text_col: str, entities: DataFrame | None = None) -> DataFrame:
    """(name, signals): one for each text that names a framework, three for each graph node of such a type."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_.]", " "), F.lit(" "))
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(f" {n.lower()} ")) | F.contains(low, F.lit(f" {n.lower()}. ")), n) for n in C.FRAMEWORK_NAMES]))
    out = snippets.select(F.explode(named).alias("name")).groupBy("name").agg(F.count("*").alias("signals"))
    if entities is not None:
        graph = entities.where(F.col("type").isin("FRAMEWORK", "LIBRARY", "TOOL", "DATABASE")).groupBy(F.col("label").alias("name")).agg((F.count("*") * 3).alias("signals"))
        out = out.unionByName(graph).groupBy("name").agg(F.sum("signals").alias("signals"))
    return out


def concepts(snippets: DataFrame, text_col: str, limit: int = 20, nodes_: DataFrame | None = None) -> DataFrame:
    """(concept, weight): capitalised phrases count 2, words of five letters or more 1, graph nodes of the context 4."""
    text = F.col(text_col)
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9+#.-]*(?: [A-Z][A-Za-z0-9+#.-]*){0,3})"), F.lit(1)), lambda p: F.regexp_replace(p, r"^[ .,:;()\[\]]+|[ .,:;()\[\]]+$", "")), lambda p: (F.length(p) >= 3) & ~F.lower(p).isin(*C.CONCEPT_STOP))
    singles = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^a-z0-9_])([a-z][a-z0-9+#.-]{4,})"), F.lit(1)), lambda w: ~w.isin(*C.CONCEPT_STOP))
    both = F.concat(F.transform(phrases, lambda p: F.struct(p.alias("concept"), F.lit(2).alias("w"))), F.transform(singles, lambda w: F.struct(T.title_case(w).alias("concept"), F.lit(1).alias("w"))))
    found = snippets.where(text.isNotNull()).select(F.explode(both).alias("x")).select("x.concept", "x.w")
    if nodes_ is not None:
        found = found.unionByName(nodes_.select(F.col("label").alias("concept"), F.lit(4).alias("w")))
    return found.groupBy("concept").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "concept").limit(limit)


def without_redundant(ranked: DataFrame, most: int = 12) -> DataFrame:
    """Of concepts by falling weight those that no one kept before equals or holds as a part. At most 20 rows come in, as `concepts` gives them."""
    one = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "concept", "weight")))

    def add(kept: Column, x: Column) -> Column:
        low = F.lower(x["concept"])
        covered = F.exists(kept, lambda k: (F.lower(k["concept"]) == low) | ((F.length(low) > 3) & F.contains(F.lower(k["concept"]), low)))
        return F.when(covered | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(x)))

    start = F.array().cast("array<struct<o:bigint,concept:string,weight:bigint>>")
    kept = ranked.agg(one.alias("xs")).select(F.posexplode(F.aggregate("xs", start, add)).alias("i", "x"))
    return kept.select((F.col("i") + 1).alias("rank"), "x.concept", "x.weight")


def single_summary(doc: DataFrame, title: str, format_: str, chunks: str, terms: str, id_col: str) -> DataFrame:
    """(id, position, line): type, title, six key terms and three main points of each document in doc; chunks and terms are arrays of strings."""
    points = F.slice(F.filter(chunks, lambda t: T.words(t) >= 4), 1, 3)
    nothing = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("- Type: "), F.coalesce(F.nullif(F.upper(F.col(format_)), F.lit("")), F.lit("document"))), F.concat(F.lit("- Title: "), F.col(title))),
        F.when(F.size(terms) > 0, F.array(F.concat(F.lit("- Key terms: "), F.array_join(F.slice(terms, 1, 6), ", ")))).otherwise(nothing),
        F.when(F.size(points) > 0, F.concat(F.array(F.lit("- Main points:")), F.transform(points, lambda t: F.concat(F.lit("  - "), safe_excerpt(t, 220))))).otherwise(nothing),
    )
    return doc.select(id_col, F.posexplode(lines).alias("position", "line"))


def safe_excerpt(text: Column, limit: int = 260) -> Column:
    def shorten(clean: Column) -> Column:
        head = F.substring(clean, 1, limit)
        last = lambda sign: F.when(F.instr(head, sign) > 0, F.length(head) - F.instr(F.reverse(head), sign)).otherwise(-1)
        edge = T.let(F.greatest(*[last(s) for s in ".;,"]), lambda at: F.when(at < limit * 0.55, last(" ")).otherwise(at))
        cut = T.let(edge, lambda e: F.substring(clean, F.lit(1), F.when(e < 80, limit).otherwise(e)))
        return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("...")))

    return T.let(T.collapse(text), shorten)


def document_summaries(docs: DataFrame, id_col: str, title_col: str, format_col: str, text_col: str) -> DataFrame:
    """(id, summary): a line on each document."""
    kind = F.upper(F.coalesce(format_col, F.lit("document")))
    body = safe_excerpt(F.coalesce(F.col(text_col), F.lit("")), 170)
    line = F.when(kind.isin("JSON", "CSV"), F.concat(kind, F.lit(" structured data file"))).when(F.length(body) > 0, body).otherwise(F.concat(F.lit("parsed "), F.lower(kind), F.lit(" document")))
    return docs.select(F.col(id_col).alias("id"), F.concat(F.coalesce(title_col, id_col), F.lit(": "), line).alias("summary"))


def cited_sources(context: DataFrame, column: str = "context") -> DataFrame:
    """(source, relevance) of a context's blocks, each source once, at its first place."""
    pattern = F.lit(r"\[From: ([^|\]]+?) \| Relevance: ([0-9.]+%)\]")
    zipped = F.arrays_zip(F.regexp_extract_all(column, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(column, pattern, F.lit(2)).alias("r"))
    rows = context.select(F.posexplode(zipped).alias("pos", "z"))
    return rows.groupBy(F.col("z.s").alias("source")).agg(F.min_by("z.r", "pos").alias("relevance"))


def slices(text: Column, size: int = C.STREAM_SLICE) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
