from pyspark.sql import functions as F

from quernstone.operators import answers, entities, graph, search

E = "text string, label string, confidence double, source string, context string"


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "i int, t string")
    return {r.entity for r in entities.gazetteer_matches(df, "i", "t").collect()}


def test_gazetteer(spark):
    assert found(spark, "React uses JavaScript. The backend uses Python, FastAPI, TensorFlow, and PyTorch.") == {"React", "JavaScript", "Python", "FastAPI", "TensorFlow", "PyTorch"}
    assert found(spark, "JS and JavaScript both use JSON over HTTP.") == {"JavaScript", "JSON", "HTTP"}
    assert found(spark, "The retrieval pipeline stores vector embeddings for semantic search.") == {"Vector Embedding", "Semantic Search"}
    assert found(spark, "支持文档上传和知识图谱") == {"Document Upload", "Knowledge Graph"}
    assert found(spark, "nothing javascripted here") == set()


def test_filter_keeps_only_useful_entities(spark):
    rows = [("v1.2.3", "VERSION", 0.9, "rule", ""), ("3fa9bc12", "CONCEPT", 0.9, "domain", ""), ("Monday", "DATE", 0.9, "spacy", ""), ("Ada's", "PERSON", 0.9, "spacy", ""), ("Method", "CONCEPT", 0.9, "context", ""), ("Markdown", "CONCEPT", 0.94, "domain", ""),
            ("Knowledge Graph", "CONCEPT", 0.9, "context", ""), ("Halifax", "LOCATION", 0.82, "spacy", "met in Halifax"), ("FastAPI", "FRAMEWORK", 0.94, "domain", ""), ("Go", "PROGRAMMING_LANGUAGE", 0.94, "domain", ""), (None, "CONCEPT", 0.9, "x", ""), ("Python", "LIBRARY", None, "x", "")]
    kept = {r.text for r in entities.useful(spark.createDataFrame(rows, E), "text").collect()}
    assert kept == {"Markdown", "Knowledge Graph", "FastAPI"}


def test_fold_follows_order_and_boosts_other_sources(spark):
    rows = [("d", "Python", 1, "LANGUAGE", 0.82, "spacy"), ("d", "Python", 2, "PROGRAMMING_LANGUAGE", 0.94, "domain"), ("d", "Python", 3, "LIBRARY", 0.8, "context"), ("d", "Python", 4, "LIBRARY", 0.8, "domain")]
    df = spark.createDataFrame(rows, "d string, n string, seq int, label string, confidence double, source string")
    (r,) = entities.fold(df, ["d", "n"], ["seq"]).collect()
    assert (r.label, r.confidence, r.source, r.mentions) == ("PROGRAMMING_LANGUAGE", 0.99, "domain", 4)


def test_acronyms(spark):
    df = spark.createDataFrame([("d", "Natural Language Processing"), ("d", "NLP"), ("e", "nlp")], "d string, n string")
    assert [tuple(r) for r in entities.semantic_duplicates(df, "d", "n").collect()] == [("d", "NLP", "Natural Language Processing")]


def test_pattern_relations(spark):
    df = spark.createDataFrame([(1, "React uses JavaScript. Python uses TensorFlow.", ["React", "JavaScript", "Python", "TensorFlow"])], "i int, t string, n array<string>")
    got = {(r.source, r.relation, r.target) for r in entities.pattern_relations(df, "i", "t", "n").collect()}
    assert ("React", "USES", "JavaScript") in got and ("Python", "USES", "TensorFlow") in got


def test_cooccurrence_direction_and_relation(spark):
    df = spark.createDataFrame([("d", "s", "Python", "PROGRAMMING_LANGUAGE", 0.9), ("d", "s", "FastAPI", "FRAMEWORK", 0.9), ("d", "s", "Python", "PROGRAMMING_LANGUAGE", 0.9)], "d string, s string, n string, label string, confidence double")
    (r,) = entities.cooccurrences(df, "d", "s", "n").collect()
    assert (r.source, r.target, r.relation, r.confidence, r.weight) == ("FastAPI", "Python", "WRITTEN_IN", 0.52, 1)


def test_graph_parts(spark):
    nodes = spark.createDataFrame([("a", "notes.md", "DOCUMENT", 1.0, 1), ("b", "Notes", "CONCEPT", 0.9, 1), ("c", "v1", "VERSION", 0.5, 1), ("d", "./x", "LIBRARY", 0.9, 1), ("e", "guide.md", "DOCUMENT", 1.0, 1)], "id string, label string, type string, confidence double, sources bigint")
    edges = spark.createDataFrame([("e", "b", "MENTIONS", 2, 0.9), ("e", "c", "MENTIONS", 1, 0.9), ("b", "b", "RELATED_TO", 1, 0.5)], "source string, target string, type string, weight bigint, confidence double")
    shown = graph.visible(nodes)
    assert {r.id for r in shown.collect()} == {"b", "e"}
    assert graph.connected(edges, shown).count() == 2
    assert dict(map(tuple, graph.degrees(edges).collect())) == {"e": 3, "b": 4, "c": 1}
    assert sorted((r.neighbour, r.direction) for r in graph.neighbours(edges, nodes, "b").collect()) == [("b", "in"), ("b", "out"), ("e", "in")]
    assert graph.density(nodes, edges).first().density == 0.15
    assert graph.weak(edges).count() == 1
    sizes = {r.id: r.size for r in graph.sized(shown, graph.connected(edges, shown)).collect()}
    assert sizes == {"e": round(6 + 2 * 0.65, 4), "b": round(8 + 4 * 1.15 + 0.9 * 1.5, 4)}
    assert graph.export(nodes, edges, "csv").count() == 8 and graph.export(nodes, edges, "json").count() == 8
    assert graph.as_gexf(nodes, edges).orderBy("part").first().line.startswith("<gexf")
    empty = graph.statistics(nodes.where("false"), edges.where("false"))
    assert empty.count() == 0


def chunks(spark):
    rows = [("c1", "notes.md", "Python modules use the fastapi API layer.", "section"), ("c2", "notes.md", "The graph layout draws nodes.", "section"), ("c3", "front.ts", "JavaScript React code", "code"), ("c4", "x.md", "Source: https://a.example/x", "text"), ("c5", "x.md", None, "text")]
    return search.chunk_index(spark.createDataFrame(rows, "id string, d string, t string, k string"), "id", "d", "t", "k")


def test_search(spark):
    index = chunks(spark)
    assert index.count() == 3
    top = search.hybrid(index, "python api", 2).collect()
    assert top[0].chunk_id == "c1" and top[0].score > 0 and top[0].tags == ["api", "python"]
    assert search.hybrid(index, "js react", 1).first().chunk_id == "c3"
    assert search.semantic(index, "   ", 5).count() == 0
    assert search.semantic(index, "python", 5, "front.ts").count() == 0
    context = search.context(search.hybrid(index, "python api", 2))
    assert context.first().context.startswith("[From: notes.md | Relevance: ")
    assert [r.source for r in answers.cited_sources(context).collect()] == ["notes.md"]
    assert search.context(search.hybrid(index, "zzz", 2)).first().context == "No relevant context found."


def test_dense_top_k_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(60)] + [(60, None), (61, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for r in search.dense_top_k(df, df.where("id % 20 = 0 AND id < 60"), "id", "v", 3, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    m = np.array([v for _, v in rows[:60]])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        sims = np.round(u @ u[q], 6)
        want = sorted((-s, i) for i, s in enumerate(sims) if i != q)[:3]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_answers(spark):
    qs = {"Summarize all files": "collection", "Which frameworks appear?": "frameworks", "What are the main concepts?": "concepts", "Tell me about notes": "document", "How long?": "snippets"}
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert dict(map(tuple, df.select("q", answers.intents(F.col("q"))).collect())) == qs
    long = "word " * 100
    got = spark.createDataFrame([(long,)], "t string").select(answers.safe_excerpt(F.col("t"))).first()[0]
    assert got.endswith("...") and len(got) <= 263
    s = spark.createDataFrame([("Django and Django. React",), (None,)], "t string")
    assert dict(map(tuple, answers.framework_signals(s, "t").collect())) == {"Django": 1, "React": 1}
