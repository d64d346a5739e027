from pyspark.sql import functions as F

from quernstone.operators import graph, pipeline, search

NOTE = """# Stack
React uses JavaScript. FastAPI and Python power the API layer.
```python
import numpy
from app.core import x
```
See [repo](https://github.com/a/b) and version 1.2.3.
"""


def docs(spark):
    return spark.createDataFrame([("d1", NOTE, "Stack", "md"), ("d2", "Redis with Django and Redis.", "Cache", "txt"), ("d3", None, None, None), ("d4", "", None, None)], "id string, text string, title string, format string")


def test_entities_of_all_parts(spark):
    got = {(r.document_id, r.text): r for r in pipeline.extract(docs(spark), "id", "text").collect()}
    names = {n for d, n in got if d == "d1"}
    assert {"React", "JavaScript", "FastAPI", "Python", "NumPy", "API"} <= names and "1.2.3" not in names
    assert got["d1", "Python"].label == "PROGRAMMING_LANGUAGE" and got["d2", "Redis"].mentions == 2
    assert not {d for d, _ in got} & {"d3", "d4"}
    assert pipeline.extract(docs(spark).where("false"), "id", "text").count() == 0


def test_relations_and_graph(spark):
    found = pipeline.extract(docs(spark), "id", "text").cache()
    related = pipeline.relations(docs(spark), found, "id", "text")
    triples = {(r.source, r.relation, r.target): r.confidence for r in related.collect()}
    assert triples["React", "USES", "JavaScript"] == 0.78 and triples["Python", "HAS_FRAMEWORK", "FastAPI"] == 0.52  # Python is surer, so it comes first
    nodes, edges = pipeline.build_graph(found, related)
    types = {r.type for r in edges.collect()}
    assert {"USES", "CONTAINS", "HAS_FRAMEWORK"} <= types
    ids = {r.id for r in nodes.collect()}
    assert all(r.source in ids and r.target in ids for r in edges.collect())
    assert graph.connected(edges, nodes).count() == edges.count()
    lines = {r.line for r in pipeline.graph_lines(nodes, "fastapi").collect()}
    assert lines == {"- FastAPI (FRAMEWORK)"}


def test_answers_by_kind(spark):
    table = docs(spark)
    index = search.chunk_index(table, "id", "title", "text")
    ask = lambda q: [r.line for r in pipeline.answer(q, index, table, "id", "title", "format", "text").orderBy("position").collect()]
    assert len(ask("Summarize all files")) == 4
    assert ask("Which frameworks use redis django?")[0].startswith("- ")
    assert ask("python api")[0].startswith("- Stack: ")


def test_small_helpers(spark):
    one = lambda v, c: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one("_arraySampleSize", pipeline.split_identifier) == ["array", "Sample", "Size"]
    assert one("name: a, Name2: b, http: c, name: d", pipeline.structured_fields) == ["name", "Name2"]
    kinds = [(c["kind"], c["text"]) for c in one("# A\none\ntwo\n\nthree\n```py\nx\n```\ntail", pipeline.typed_chunks)]
    assert kinds == [("header", "# A"), ("paragraph", "one\ntwo"), ("paragraph", "three"), ("code", "x"), ("paragraph", "tail")]
    assert one("", pipeline.typed_chunks) == []
    snap = lambda s, p: spark.createDataFrame([(s, p)], "s string, p int").select(pipeline.progress_snapshot(F.col("s"), F.col("p"), F.lit(None)).alias("x")).first()["x"]["percent"]
    assert [snap("PENDING", None), snap("PROGRESS", 35), snap("SUCCESS", 3), snap("FAILURE", 3)] == [0, 35, 100, None]
    peers = spark.createDataFrame([("10.0.0.1", "1.1.1.1, 2.2.2.2"), ("9.9.9.9", "1.1.1.1"), ("10.0.0.1", None)], "p string, f string")
    assert [r[0] for r in peers.select(pipeline.client_address(F.col("p"), F.col("f"), ["10.0.0.1"])).collect()] == ["1.1.1.1", "9.9.9.9", "10.0.0.1"]
    batch = spark.createDataFrame([("a", None), ("b", "bad")], "n string, error string")
    assert tuple(pipeline.reindex_summary(batch).first()) == (2, 1, 1)
