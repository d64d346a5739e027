"""Documents to entities to graph to answers in one plan, with the helpers that belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from . import answers, entities, graph, markup, records, search

#: Confidence of what each part of a document gives.
CONFIDENCE = {"domain": 0.94, "version": 0.75, "repository": 1.0, "header": 0.72, "link": 0.78, "fence": 0.95, "fence_import": 0.9, "import": 0.82, "title": 0.64, "function": 0.74, "class": 0.78, "hint": 0.75}
#: Endpoint limits as (requests, seconds).
LIMITS = {"upload": ((10, 60), (100, 3600)), "chat": ((30, 60), (500, 86400)), "search": ((60, 60),), "graph": ((120, 60),), "scrape": ((10, 3600),), "default": ((200, 86400), (50, 3600))}


def split_identifier(name: Column) -> Column:
    """Words of a camelCase or snake_case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(name, "^_+|_+$", ""), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda w: F.length(w) > 0)


def _as(item, label: str, confidence: float):
    return lambda name: item(name, label, confidence, "parser")


def raw_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, seq, text, label, confidence, source, context): what every part of a document names, in the order of the fold.

    Parts: known terms, versions, repositories, code fences with their imports, headings, links, and where docs has the parser's
    columns (imports, sections, functions, classes, hints) what those name. One scan; each part is an array of the row, so
    nothing is shuffled before the fold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.create_map(*[F.lit(x) for a in entities.WORD_ALIASES for x in (entities._spread(a), a)])
    item = lambda t, label, conf, source, context="": F.struct(t.alias("text"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"), (F.lit(context) if isinstance(context, str) else context).alias("context"))
    blocks = markup.code_blocks(text)
    imports = lambda b: F.when(F.lower(b["language"]) == "python", markup.python_imports(b["code"])).when(
        F.lower(b["language"]).isin("javascript", "typescript", "js", "ts"), F.array_compact(F.transform(markup.js_outline(b["code"])["imports"], markup.package_of))
    ).otherwise(F.array().cast("array<string>"))
    link_label = lambda x: F.when(x["url"].rlike(r"\.(org|edu)"), "ORGANIZATION").when(F.contains(x["url"], F.lit("github.com")), "REPOSITORY").otherwise("RESOURCE")
    parts = F.concat(
        F.transform(entities.found_terms(text), lambda t: item(F.coalesce(spread[t], t), "CONCEPT", CONFIDENCE["domain"], "domain")),
        F.transform(entities.versions(text), lambda t: item(t, "VERSION", CONFIDENCE["version"], "rule")),
        F.transform(entities.repositories(text), lambda t: item(t, "REPOSITORY", CONFIDENCE["repository"], "rule")),
        F.transform(blocks, lambda b: item(b["language"], "PROGRAMMING_LANGUAGE", CONFIDENCE["fence"], "context", "Code fence")),
        F.transform(F.flatten(F.transform(blocks, imports)), lambda m: item(m, "LIBRARY", CONFIDENCE["fence_import"], "context")),
        F.transform(F.filter(markup.sections(text), lambda s: s["level"] > 0), lambda s: item(s["title"], "CONCEPT", CONFIDENCE["header"], "context", F.concat(F.lit("Markdown heading level "), s["level"].cast("string")))),
        F.transform(markup.links(text), lambda x: item(x["text"], link_label(x), CONFIDENCE["link"], "context", F.concat(F.lit("Link: "), x["url"]))),
    )
    names = F.create_map(*[F.lit(x) for a, (n, _) in C.ALIASES.items() for x in (a, n)])
    labels = F.create_map(*[F.lit(x) for a, (_, v) in C.ALIASES.items() for x in (a, v)])

    def canonical(e: Column) -> Column:
        """A known term's own name and label, with no less than the confidence of a known term. Done before the rows are spread, so that
        what filters them later reads columns and not these expressions again."""
        return T.let(
            T.collapse(e["text"]),
            lambda t: T.let(
                F.struct(names[F.lower(t)].alias("n"), labels[F.lower(t)].alias("l")),
                lambda k: F.struct(
                    F.coalesce(k["n"], t).alias("text"), F.coalesce(k["l"], e["label"]).alias("label"),
                    F.when(k["n"].isNotNull(), F.greatest(e["confidence"], F.lit(CONFIDENCE["domain"]))).otherwise(e["confidence"]).alias("confidence"), e["source"].alias("source"), e["context"].alias("context"),
                ),
            ),
        )

    nothing = F.array().cast("array<string>")
    if "imports" in docs.columns:
        module = lambda m: F.when(F.contains(m, F.lit("/")), markup.package_of(m)).otherwise(F.substring_index(m, ".", 1))
        parts = F.concat(parts, F.transform(F.array_compact(F.transform(F.coalesce("imports", nothing), module)), lambda m: item(m, "LIBRARY", CONFIDENCE["import"], "parser")))
    if "sections" in docs.columns:
        titles = F.filter(F.transform("sections", lambda x: records.symbol(x["title"])), lambda t: (F.length(t) > 0) & ~F.lower(t).isin(*C.STOP_CONCEPTS))
        parts = F.concat(parts, F.transform(F.coalesce(titles, nothing), lambda t: item(t, "CONCEPT", CONFIDENCE["title"], "parser")))
    for column, label, which in (("functions", "FUNCTION", "function"), ("classes", "CLASS", "class")):
        if column in docs.columns:
            symbols = F.filter(F.transform(F.coalesce(column, nothing), lambda f: records.symbol(F.substring_index(f, "(", 1))), lambda f: (F.length(f) > 0) & ~f.rlike("^[./]"))
            parts = F.concat(parts, F.transform(symbols, _as(item, label, CONFIDENCE[which])))
    if "hints" in docs.columns:
        given = F.filter("hints", lambda h: F.length(h["text"]) > 0)
        parts = F.concat(parts, F.coalesce(F.transform(given, lambda h: item(h["text"], F.upper(F.coalesce(h["type"], F.lit("entity"))), CONFIDENCE["hint"], "parser")), F.slice(parts, 1, 0)))
    spread_out = F.filter(F.transform(parts, canonical), lambda e: F.length(e["text"]) > 0)
    return docs.select(F.col(id_col).alias("document_id"), F.posexplode(spread_out).alias("seq", "e")).select("document_id", "seq", "e.*")


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, text, label, confidence, source, mentions): a document's useful entities after the fold."""
    folded = entities.fold(entities.useful(raw_entities(docs, id_col, text_col), "text"), ["document_id", "text"], ["seq"])
    return entities.merged(folded, "document_id", "text")


def relations(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, source, target, relation, confidence): phrases and shared sentences, the surest of each triple.

    A sentence's entities are those whose name it holds; pairs are made inside one sentence's array.
    """
    named = found.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("label").alias("l"), F.col("text").alias("n")))).alias("xs"))
    lines = docs.select(F.col(id_col).alias("document_id"), F.explode(T.split_sentences(F.col(text_col))).alias("sentence")).join(named, "document_id")
    inside = F.filter("xs", lambda x: F.contains(F.lower("sentence"), F.lower(x["n"])))
    held = lines.select("document_id", "sentence", inside.alias("xs")).where(F.size("xs") >= 2)
    pairs = F.flatten(F.transform("xs", lambda a, i: F.transform(F.slice("xs", i + 2, F.greatest(F.size("xs") - i - 1, F.lit(0))), lambda b: F.struct(a["n"].alias("source"), b["n"].alias("target"), entities.pair_relation(a["l"], b["l"]).alias("relation")))))
    near = held.select("document_id", F.explode(pairs).alias("p")).select("document_id", "p.*", F.lit(C.COOCCURRENCE_CONFIDENCE).alias("confidence"))
    said = entities.pattern_relations(held.withColumn("names", F.transform("xs", lambda x: x["n"])), "document_id", "sentence", "names").withColumnRenamed("id", "document_id")
    return near.unionByName(said).groupBy("document_id", "source", "target", "relation").agg(F.max("confidence").alias("confidence"))


def document_edge(label: Column) -> Column:
    """How a document relates to what it holds, by the entity's label."""
    return (
        F.when(label.isin("PROGRAMMING_LANGUAGE", "FRAMEWORK", "LIBRARY", "DATABASE", "TOOL", "DEPENDENCY"), "USES").when(label.isin("FUNCTION", "CLASS"), "DEFINES")
        .when(label.isin("RESOURCE", "REPOSITORY"), "REFERENCES").otherwise("CONTAINS")
    )


def build_graph(found: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all documents: document and entity nodes, typed edges from documents, edges of resolved relations.

    Relation ends are resolved within their document by an equi-join on name; a name with two labels counts under the surer one.
    """
    keyed = found.withColumn("id", graph.node_id(F.col("text"), F.col("label")))
    entity_nodes = keyed.groupBy("id").agg(F.min_by("text", "document_id").alias("label"), F.first("label").alias("type"), F.max("confidence").alias("confidence"), F.count_distinct("document_id").alias("sources"))
    docs = keyed.select("document_id").distinct()
    doc_nodes = docs.select(graph.node_id(F.col("document_id"), F.lit("DOCUMENT")).alias("id"), F.col("document_id").alias("label"), F.lit("DOCUMENT").alias("type"), F.lit(1.0).alias("confidence"), F.lit(1).cast("bigint").alias("sources"))
    held = keyed.select(graph.node_id(F.col("document_id"), F.lit("DOCUMENT")).alias("source"), F.col("id").alias("target"), document_edge(F.col("label")).alias("type"), F.col("mentions").cast("bigint").alias("weight"), "confidence")
    ends = keyed.groupBy("document_id", F.lower("text").alias("name")).agg(F.max_by("id", F.struct("confidence", "id")).alias("node"))
    a, b = ends.toDF("document_id", "s_name", "s_node"), ends.toDF("document_id", "t_name", "t_node")
    lowered = related.withColumn("s_name", F.lower("source")).withColumn("t_name", F.lower("target"))
    between = lowered.join(a, ["document_id", "s_name"]).join(b, ["document_id", "t_name"]).where("s_node <> t_node")
    edges = held.unionByName(between.select(F.col("s_node").alias("source"), F.col("t_node").alias("target"), F.col("relation").alias("type"), F.lit(1).cast("bigint").alias("weight"), "confidence"))
    return entity_nodes.unionByName(doc_nodes), graph.merge_edges(edges)


def graph_lines(nodes_: DataFrame, question: str, limit: int = 5) -> DataFrame:
    """(line): the graph's part of an answer's context."""
    return graph.search(nodes_, question, None, limit).select(F.concat(F.lit("- "), "label", F.lit(" ("), "type", F.lit(")")).alias("line"))


def answer(question: str, index: DataFrame, docs: DataFrame, id_col: str, title_col: str, format_col: str, text_col: str, nodes_: DataFrame | None = None) -> DataFrame:
    """(position, line): the extractive answer, by what the question asks for. Each kind is one plan with a bounded result."""
    q = question.lower()
    number = F.monotonically_increasing_id()
    if answers.intent(question) == "collection":
        lines = answers.document_summaries(docs, id_col, title_col, format_col, text_col).orderBy("id").limit(8).select(F.concat(F.lit("- "), "summary").alias("line"))
    elif answers.intent(question) == "frameworks":
        signals = answers.framework_signals(search.hybrid(index, question, 5), "text", nodes_)
        lines = signals.orderBy(F.desc("signals"), "name").limit(8).select(F.format_string("- %s: %d signals", "name", "signals").alias("line"))
    elif answers.intent(question) == "concepts":
        lines = answers.without_redundant(answers.concepts(search.hybrid(index, question, 5), "text", 20, None if nodes_ is None else graph.search(nodes_, question, None, 5))).select(F.concat(F.lit("- "), "concept").alias("line"))
    elif answers.intent(question) == "document":
        best = answers.named_document(docs, q, id_col, title_col)
        body = docs.join(best.select(F.col("id").alias("_m")), docs[id_col] == F.col("_m"), "left_semi")
        lines = body.select(F.concat(F.lit("- "), answers.safe_excerpt(F.col(text_col), 220)).alias("line"))
    else:
        lines = search.hybrid(index, question, 3).select(F.concat(F.lit("- "), "document", F.lit(": "), answers.safe_excerpt(F.col("text"))).alias("line"))
    return lines.select(number.alias("position"), "line")


def structured_fields(text: Column) -> Column:
    """Names before a colon, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})\s*:"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda f: ~F.lower(f).isin("array", "false", "http", "https", "object", "true", "with")))


def nested_sections(headings: DataFrame, document: str, line: str, level: str) -> DataFrame:
    """Adds `parent`: the line of the last heading before of a lower level; null at the top."""
    order = Window.partitionBy(document).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(line)), ignorenulls=True).over(order) for k in range(1, 6)]
    seen = headings
    for k, c in enumerate(last, 1):
        seen = seen.withColumn(f"_l{k}", c)
    parent = F.greatest(*[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, 6)], F.lit(None).cast("bigint"))
    return seen.withColumn("parent", parent).drop(*[f"_l{k}" for k in range(1, 6)])


def typed_chunks(text: Column, limit: int = 1000) -> Column:
    """array<struct<kind,text>>: headers, fenced code and paragraphs; a paragraph ends at a blank line or past `limit` characters."""
    start = F.struct(F.array().cast("array<struct<kind:string,text:string>>").alias("out"), F.lit("").alias("buffer"), F.lit(False).alias("code"))
    one = lambda kind, t: F.array(F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    def flush(acc: Column) -> Column:
        return F.when(F.length(T.strip(acc["buffer"])) > 0, F.concat(acc["out"], one("paragraph", T.strip(acc["buffer"])))).otherwise(acc["out"])

    def state(out: Column, buffer: Column, code: Column) -> Column:
        return F.struct(out.alias("out"), buffer.alias("buffer"), code.alias("code"))

    def step(acc: Column, s: Column) -> Column:
        fence = F.ltrim(s).startswith("```")
        grown = F.when(F.length(acc["buffer"]) > 0, F.concat(acc["buffer"], F.lit("\n"), s)).otherwise(s)
        closed = F.when(F.length(acc["buffer"]) > 0, F.concat(acc["out"], one("code", acc["buffer"]))).otherwise(acc["out"])
        none = F.lit("")
        return (
            F.when(acc["code"] & fence, state(closed, none, F.lit(False))).when(acc["code"], state(acc["out"], grown, F.lit(True))).when(fence, state(flush(acc), none, F.lit(True)))
            .when(s.rlike(r"^#{1,6}\s+\S"), state(F.concat(flush(acc), one("header", T.strip(s))), none, F.lit(False))).when(F.length(F.trim(s)) == 0, state(flush(acc), none, F.lit(False)))
            .when(F.length(grown) > limit, state(F.concat(acc["out"], one("paragraph", T.strip(grown))), none, F.lit(False))).otherwise(state(acc["out"], grown, F.lit(False)))
        )

    return T.let(F.aggregate(markup.lines(text), start, step), flush)


def reindex_summary(parsed: DataFrame, error_col: str = "error") -> DataFrame:
    """(total, reindexed, failed) of a batch; a failed document doesn't end it."""
    return parsed.agg(F.count("*").alias("total"), F.count_if(F.col(error_col).isNull()).alias("reindexed"), F.count_if(F.col(error_col).isNotNull()).alias("failed"))


def client_address(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The first forwarded address where the peer is a trusted proxy, else the peer."""
    return F.when(peer.isin(*trusted) & (F.length(F.trim(forwarded)) > 0), F.trim(F.substring_index(forwarded, ",", 1))).otherwise(peer)


def progress_snapshot(state: Column, percent: Column, step: Column) -> Column:
    """struct<status,percent,step> as a client sees a job; only a running one shows its own percentage."""
    shown = F.when(state == "PENDING", 0).when(state == "SUCCESS", 100).when(state == "PROGRESS", F.coalesce(percent, F.lit(0))).otherwise(F.lit(None).cast("int"))
    return F.struct(F.lower(state).alias("status"), shown.cast("int").alias("percent"), F.coalesce(step, F.initcap(F.lower(state))).alias("step"))


def limit_windows(requests: DataFrame, endpoint: str, client: str, time: str) -> DataFrame:
    """(endpoint, client, seconds, window_start, requests, allowed): every endpoint under its own fixed windows."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.struct(F.lit(n).alias("allowed"), F.lit(s).alias("seconds")) for n, s in x]) for pair in LIMITS.items() for x in pair])
    rows = requests.select(endpoint, client, time, F.explode(F.coalesce(table[F.col(endpoint)], table["default"])).alias("l"))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(time) / F.col("l.seconds")) * F.col("l.seconds"))
    return rows.groupBy(F.col(endpoint).alias("endpoint"), F.col(client).alias("client"), F.col("l.seconds").alias("seconds"), start.alias("window_start"), F.col("l.allowed").alias("allowed")).agg(F.count("*").alias("requests"))
