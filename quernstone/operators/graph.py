"""The property graph: merge, statistics, neighbourhoods, search, the drawn part, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def node_id(label: Column, node_type: Column) -> Column:
    prefix = F.when(node_type == "DOCUMENT", "doc_").otherwise("ent_")
    return F.concat(prefix, F.substring(F.sha1(F.concat_ws(":", node_type, F.lower(T.collapse(label)))), 1, 12))


def nodes(mentions: DataFrame, label: str = "normalized", node_type: str = "label", document: str = "document_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(id, label, type, confidence, sources): first label, greatest confidence, number of distinct documents. One hash aggregation."""
    keyed = mentions.where(F.col(label).isNotNull() & F.col(node_type).isNotNull()).withColumn("_id", node_id(F.col(label), F.col(node_type)))
    return keyed.groupBy(F.col("_id").alias("id")).agg(
        F.min(F.struct(*order, F.col(label).alias("_label")))["_label"].alias("label"), F.first(node_type).alias("type"), F.max("confidence").alias("confidence"), F.count_distinct(document).alias("sources")
    )


def mention_edges(mentions: DataFrame, label: str = "normalized", node_type: str = "label", document: str = "document_id") -> DataFrame:
    """(source, target, type, weight, confidence) from documents to what they mention."""
    keyed = mentions.where(F.col(label).isNotNull() & F.col(node_type).isNotNull() & F.col(document).isNotNull())
    return keyed.groupBy(node_id(F.col(document), F.lit("DOCUMENT")).alias("source"), node_id(F.col(label), F.col(node_type)).alias("target")).agg(
        F.count("*").alias("weight"), F.max("confidence").alias("confidence")
    ).withColumn("type", F.lit("MENTIONS"))


def node_sources(mentions: DataFrame, label: str = "normalized", node_type: str = "label", document: str = "document_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(id, document, first): the documents of each node, with where each came first. A row each, so that a node of any size stays spread."""
    keyed = mentions.where(F.col(label).isNotNull() & F.col(node_type).isNotNull() & F.col(document).isNotNull())
    return keyed.groupBy(node_id(F.col(label), F.col(node_type)).alias("id"), F.col(document).alias("document")).agg(F.min(F.struct(*order)).alias("first"))


def edge_sources(mentions: DataFrame, label: str = "normalized", node_type: str = "label", document: str = "document_id") -> DataFrame:
    """(source, target, type, document): the documents of each mention edge."""
    keyed = mentions.where(F.col(label).isNotNull() & F.col(node_type).isNotNull() & F.col(document).isNotNull())
    return keyed.select(node_id(F.col(document), F.lit("DOCUMENT")).alias("source"), node_id(F.col(label), F.col(node_type)).alias("target"), F.lit("MENTIONS").alias("type"), F.col(document).alias("document")).distinct()


def node_properties(mentions: DataFrame, properties: str = "metadata_json", label: str = "normalized", node_type: str = "label", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(id, key, value): each node's properties; of several values of a key the last that isn't empty."""
    keyed = mentions.where(F.col(label).isNotNull() & F.col(node_type).isNotNull() & F.col(properties).isNotNull())
    entries = keyed.select(node_id(F.col(label), F.col(node_type)).alias("id"), F.struct(*order).alias("at"), F.explode(F.from_json(properties, "map<string,string>")).alias("key", "value"))
    return entries.where(F.length("value") > 0).groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))


def with_sources(rows: DataFrame, sources: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """rows with `documents`, the list of their sources in order. For exports, whose lines hold the list by their format."""
    lists = sources.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "document"))), lambda x: x["document"]).alias("documents"))
    return rows.join(lists, keys, "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "type").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("weight"), F.max("confidence").alias("confidence"))


def connected(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes kept."""
    ids = kept.select(F.col("id").alias("_k")).distinct()
    out = edges.join(ids, edges["source"] == F.col("_k"), "left_semi")
    return out.join(ids, out["target"] == F.col("_k"), "left_semi")


def statistics(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes and edges per type, and in total."""
    per = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    both = per(nodes_, "node").unionByName(per(edges, "edge"))
    return both.unionByName(both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("*").alias("type"), "n"))


def density(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes_.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    value = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.join(e).withColumn("density", F.round(value, 4))  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): weights on both ends; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def neighbours(edges: DataFrame, nodes_: DataFrame, node: str, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(neighbour, label, type, edge_type, weight, direction) around one node; the filters reach the scan of the edges."""
    rows = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    parts = []
    if direction in ("out", "both"):
        parts.append(rows.where(F.col("source") == node).select(F.col("target").alias("neighbour"), F.col("type").alias("edge_type"), "weight", F.lit("out").alias("direction")))
    if direction in ("in", "both"):
        parts.append(rows.where(F.col("target") == node).select(F.col("source").alias("neighbour"), F.col("type").alias("edge_type"), "weight", F.lit("in").alias("direction")))
    near = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return near.join(nodes_.select(F.col("id").alias("neighbour"), "label", "type"), "neighbour")


def search(nodes_: DataFrame, query: str, node_type: str | None = None, limit: int = 10) -> DataFrame:
    rows = nodes_ if node_type is None else nodes_.where(F.col("type") == node_type)
    return rows.where(F.contains(F.lower("label"), F.lit(query.lower()))).orderBy("label", "id").limit(limit)


def weak(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("type") == "RELATED_TO") & (F.coalesce("confidence", F.lit(1.0)) < 0.7))


def identity(label: Column) -> Column:
    base = F.element_at(F.split(label, "/"), -1)
    stem = F.when(base.rlike(r".\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(label)
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "^_+", ""), "[^a-z0-9]+", "")


def visible(nodes_: DataFrame) -> DataFrame:
    """Nodes that are drawn: no hidden types, no file paths, no document that an entity already stands for."""
    shown = nodes_.where(~F.col("type").isin(*C.HIDDEN_NODES)).where(~(F.col("type").isin("DEPENDENCY", "LIBRARY") & (F.col("label").rlike(r"^[./]") | F.contains(F.col("label"), F.lit("/_")))))
    keys = nodes_.where("type <> 'DOCUMENT'").select(identity(F.col("label")).alias("_i")).distinct()
    documents = shown.where("type = 'DOCUMENT'").withColumn("_d", identity(F.col("label")))
    kept = documents.join(keys, documents["_d"] == keys["_i"], "left_anti").drop("_d")
    return shown.where("type <> 'DOCUMENT'").unionByName(kept)


def sized(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    degree = F.coalesce("degree", F.lit(0))
    size = F.when(F.col("type") == "DOCUMENT", F.least(F.lit(10.5), 6 + degree * 0.65)).otherwise(F.least(F.lit(19.0), 8 + degree * 1.15 + F.coalesce("confidence", F.lit(0.0)) * 1.5))
    return nodes_.join(degrees(edges), "id", "left").withColumn("size", F.round(size, 4)).select("id", "label", "type", "size")


def edge_id() -> Column:
    return F.concat(F.col("source"), F.lit("->"), F.col("target"), F.lit(":"), F.col("type"))


def _number(c: str) -> Column:
    """A confidence as text; 1.0 where none is stated."""
    return F.coalesce(F.col(c).cast("double"), F.lit(1.0)).cast("string")


def _listed(rows: DataFrame) -> DataFrame:
    return rows if "documents" in rows.columns else rows.withColumn("documents", F.array().cast("array<string>"))


def as_csv(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table of nine columns of text. Their sources are the lists in `documents`, as with_sources gives it; none without."""
    nodes_, edges = _listed(nodes_), _listed(edges)
    none = F.lit("")
    listed = F.array_join("documents", "; ").alias("sources")
    a = nodes_.select(F.lit("node").alias("kind"), "id", "label", "type", none.alias("source"), none.alias("target"), none.alias("weight"), _number("confidence").alias("confidence"), listed)
    b = edges.select(F.lit("edge").alias("kind"), edge_id().alias("id"), F.col("type").alias("label"), "type", "source", "target", F.col("weight").cast("string").alias("weight"), _number("confidence").alias("confidence"), listed)
    return a.unionByName(b)


def as_cytoscape(nodes_: DataFrame, edges: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(kind, element): one JSON element a row, so that an export of any size is written in parallel. properties: (id, key, value), added to the nodes' own fields."""
    own = lambda fields: [F.concat(F.lit(f'"{n}":'), v) for n, v in fields]
    nodes_, edges = _listed(nodes_), _listed(edges)
    text = lambda c: F.concat(F.lit('"'), _json_text(F.col(c)), F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform("documents", lambda d: F.concat(F.lit('"'), _json_text(d), F.lit('"'))), ","), F.lit("]"))
    rows = nodes_
    more = F.lit("")
    if properties is not None:
        pairs = properties.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("extra"))
        rows = nodes_.join(pairs, "id", "left")
        shown = F.transform(F.coalesce("extra", F.array().cast("array<struct<key:string,value:string>>")), lambda p: F.concat(F.lit(',"'), _json_text(p["key"]), F.lit('":"'), _json_text(p["value"]), F.lit('"')))
        more = F.array_join(shown, "")
    node_fields = own([("id", text("id")), ("label", text("label")), ("type", text("type")), ("confidence", _number("confidence")), ("sources", listed)])
    edge_fields = own([("id", F.concat(F.lit('"'), _json_text(edge_id()), F.lit('"'))), ("source", text("source")), ("target", text("target")), ("label", text("type")), ("type", text("type")), ("weight", F.col("weight").cast("string")), ("confidence", _number("confidence")), ("sources", listed)])
    whole = lambda fields, last: F.concat(F.lit('{"data":{'), F.concat_ws(",", *fields), last, F.lit("}}"))
    a = rows.select(F.lit("node").alias("kind"), whole(node_fields, more).alias("element"))
    return a.union(edges.select(F.lit("edge").alias("kind"), whole(edge_fields, F.lit("")).alias("element")))


def _json_text(c: Column) -> Column:
    """Escaped as within a JSON string."""
    quoted = F.to_json(F.array(c))
    return F.substr(quoted, F.lit(3), F.length(quoted) - 4)


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


#: What stands before, between and after the nodes and edges of a GEXF 1.2 file.
GEXF_ATTRIBUTES = "".join(f'<attributes class="{kind}">' + "".join(f'<attribute id="{a}" title="{a}" type="string"/>' for a in ("type", "confidence", "sources")) + "</attributes>" for kind in ("node", "edge"))
GEXF_PARTS = (
    (0, '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph mode="static" defaultedgetype="directed">' + GEXF_ATTRIBUTES + "<nodes>"),
    (2, "</nodes><edges>"),
    (4, "</edges></graph></gexf>"),
)


def as_gexf(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a GEXF 1.2 file; parts 0 to 4 follow each other. An edge's id is the one of the other exports, as a running number would need one order of all edges."""
    nodes_, edges = _listed(nodes_), _listed(edges)
    value = lambda name, c: F.concat(F.lit(f'<attvalue for="{name}" value="'), _xml(c), F.lit('"/>'))
    values = F.concat(F.lit("<attvalues>"), value("type", F.col("type")), value("confidence", _number("confidence")), value("sources", F.array_join("documents", ", ")), F.lit("</attvalues>"))
    a = nodes_.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("label")), F.lit('">'), values, F.lit("</node>")).alias("line"))
    b = edges.select(
        F.lit(3).alias("part"),
        F.concat(F.lit('<edge id="'), _xml(edge_id()), F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('" label="'), _xml(F.col("type")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('">'), values, F.lit("</edge>")).alias("line"),
    )
    frame = nodes_.sparkSession.createDataFrame(list(GEXF_PARTS), "part int, line string")
    return frame.unionByName(a).unionByName(b)


def drawn(nodes_: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The drawn part: (nodes with their size, edges between them that aren't hidden)."""
    shown = visible(nodes_)
    kept = connected(edges.where(~F.col("type").isin(*C.HIDDEN_EDGES)), shown)
    return sized(shown, kept), kept.select("source", "target", "type", "weight", "confidence")


def detail(edges: DataFrame, nodes_: DataFrame, node: str) -> DataFrame:
    """One row on a node: its own fields and the number of its neighbours; no row for an unknown id."""
    near = neighbours(edges, nodes_, node).agg(F.count("*").alias("neighbour_count"))
    return nodes_.where(F.col("id") == node).join(near)  # one row each


def export(nodes_: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    return {"csv": as_csv, "json": as_cytoscape, "gexf": as_gexf}[kind](nodes_, edges)
