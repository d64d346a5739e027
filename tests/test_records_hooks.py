import datetime as dt

from pyspark.sql import functions as F

from quernstone.operators import answers, entities, graph, hooks, markup, pipeline, records, search
from quernstone.sources import parsers, readers
from quernstone.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_small_labels(spark):
    assert [one(spark, records.extension_label, x) for x in ("a.TAR.Gz", "plain", "dot.")] == [".gz", "none", "none"]
    assert [one(spark, records.human_size, x, "bigint") for x in (None, -1, 5, 2048, 5 * 1024 * 1024)] == ["unknown size", "unknown size", "5 B", "2.0 KB", "5.0 MB"]
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    ages = [one(spark, lambda c: records.human_age(c.cast("timestamp"), now), x) for x in ("2025-01-09 23:59:50", "2025-01-09 23:50:00", "2025-01-09 20:00:00", "2025-01-07 00:00:00", "2024-12-01 00:00:00", None)]
    assert ages == ["just now", "10m ago", "4h ago", "3d ago", "2024-12-01", "unknown"]
    assert one(spark, records.symbol, " __init__") == "init__" and one(spark, records.probed_concepts, "a rest api and GraphQL") == ["API", "REST", "GraphQL"]
    assert one(spark, records.parsed_time, "2025-01-01T00:00:00") == dt.datetime(2025, 1, 1) and one(spark, records.parsed_time, "no time") is not None


def test_page_guards_and_names(spark):
    df = spark.createDataFrame([("text/html; charset=x", "10"), ("application/pdf", None), (None, None), ("text/plain", "9999999"), ("", "many")], "t string, n string")
    assert [r[0] for r in df.select(records.page_fits(F.col("t"), F.col("n"))).collect()] == [True, False, True, False, True]
    got = spark.createDataFrame([("https://a.example:80/x", "Ünder the Sea!"), ("nonsense", None)], "u string, t string").select(records.page_filename(F.col("u"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["web-a.example_80-nder-the-sea.md", "web-web-page.md"]
    fits = spark.createDataFrame([("PDF", "application/pdf", False), ("py", "video/mp2t", True), ("py", "video/mp2t", False), ("html", "application/octet-stream", False), (None, "x", False), ("md", None, False)], "e string, m string, r boolean")
    assert [r[0] for r in fits.select(records.mime_fits(F.col("e"), F.col("m"), F.col("r"))).collect()] == [True, True, False, True, False, False]


def test_records_keep_the_first_and_are_stable(spark):
    rows = [("d", "Graph ", "graph", "concept", "parser", 0.9, 1, "a"), ("d", "graph", "Graph", "CONCEPT", "ner", 0.5, 2, "b"), ("d", "  ", None, "CONCEPT", "ner", 0.5, 3, "c"), ("d", "x" * 300, None, None, None, None, 4, "d")]
    df = spark.createDataFrame(rows, "document_id string, text string, normalized string, label string, source string, confidence double, created_at int, id string")
    got = {r.normalized[:5]: r for r in records.entity_records(df).collect()}
    assert set(got) == {"graph", "xxxxx"} and got["graph"].source == "parser" and len(got["xxxxx"].text) == 255 and got["xxxxx"].label == "ENTITY" and got["xxxxx"].confidence == 1.0
    assert records.entity_records(df.where("false")).count() == 0
    owned = records.owned(spark.createDataFrame([("d",), ("e",), (None,)], "document_id string"), spark.createDataFrame([("d", "u"), ("e", None)], "document_id string, user_id string"))
    assert {(r.document_id, r.user_id) for r in owned.collect()} == {("d", "u"), ("e", "local-dev"), (None, "local-dev")}
    assert [r[0] for r in records.without(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("b",), ("z",)], "k string"), "k").collect()] == ["a"]


def test_result_titles(spark):
    rows = [('{"section": "the start"}', "x/my_file.md", "section"), ('{"page": 3}', "x", "text"), ("{}", "x/my_file.md", "paragraph"), (None, "x", "code_block"), ("broken", "a-b.txt", "text")]
    df = spark.createDataFrame(rows, "m string, d string, t string")
    assert [r[0] for r in df.select(records.result_title(F.col("m"), F.col("d"), F.col("t"))).collect()] == ["The Start", "Page 3", "My File", "Code Block", "A B"]
    shown = spark.createDataFrame([("t", "text", 0.1234, "e", "s", None, "text")], "title string, type string, score double, excerpt string, source string, tags array<string>, chunk_type string")
    assert records.shown_results(shown, True).first().score == 12.3 and records.shown_results(shown).first().tags == ["text"]


def test_layout_headings_and_progress(spark):
    words = spark.createDataFrame([("d", 1, 0, "Title", 20.0), ("d", 1, 1, "of", 20.0), ("d", 1, 2, "text", 10.0), ("d", 1, 3, "more", 10.0), ("d", 1, 4, "words", 10.0), ("d", 2, 0, "Tiny", 5.0), ("d", 2, 1, "", 90.0)], "document_id string, page int, position int, text string, size double")
    assert [r.text for r in records.layout_headings(words).collect()] == ["Title"]
    steps = records.progress(spark.createDataFrame([(1, False), (2, True)], "id int, bad boolean"), "id", F.col("bad")).orderBy("id", "position").collect()
    assert [r.percent for r in steps] == [15, 40, 60, 75, 90, 100, 15, 100] and steps[-1].step == "Failed"


def test_markup_parts(spark):
    text = "---\ntitle: 'A b'\ntags:\n- x\nn: 1\nn: 2\n---\n# Head\n\n> said\n\n```py\nx\n```\nsee [a](b) ![c](d)\n"
    got = spark.createDataFrame([(text,), ("no block",)], "x string").select(markup.front_matter(F.col("x")).alias("f")).collect()
    assert got[0].f.meta == {"title": "A b", "n": "2"} and got[0].f.body.startswith("# Head") and got[1].f.meta == {} and got[1].f.body == "no block"
    flags = one(spark, markup.flags, text)
    assert (flags.title, flags.has_blockquotes, flags.has_code, flags.has_links, flags.has_images, flags.languages) == ("Head", True, True, True, True, ["py"])
    assert one(spark, markup.paragraphs, "a\n\n\n \n\nb\nc") == ["a", "b\nc"] and [c.kind for c in one(spark, markup.structure_chunks, "# H\nt\n```\nx\n```")] == ["section", "code"]
    js = one(spark, markup.js_outline, "/** Adds two numbers and gives the sum. */\nimport a from 'b/c'\nclass K { run(x) { return 1 } }\nconst fn = (y) => 2")
    assert js.imports == ["b/c"] and js.classes == ["K"] and js.functions == ["fn", "run"] and js.docs == ["Adds two numbers and gives the sum."]
    assert one(spark, markup.python_symbols, "class _A:\n    async def go(self): pass\n\ndef x(): pass").functions == ["go", "x"]


def test_code_and_json_parsers():
    found = parsers.python_outline('"""Doc."""\nimport a.b, c\nfrom d import e\nclass K:\n    """About K."""\n    def m(self, x):\n        pass\n')
    assert found == {"imports": ["a.b", "c", "d"], "functions": ["m(self, x)"], "classes": ["K"], "sections": [("Module", 1, "Doc."), ("K", 2, "About K.")], "error": None}
    assert parsers.python_outline("def (")["error"] and parsers.python_outline("def (")["functions"] == []
    value = {"name": "pkg", "dependencies": {"x": "1"}, "keywords": ["ab", 3], "description": "a knowledge graph", "deep": {"a": {"b": {"c": 1}}}, "list": [{"long": "more than ten characters"}]}
    assert parsers.json_hints(value) == [("library", "pkg"), ("dependency", "x"), ("concept", "ab"), ("concept", "knowledge graph")] and parsers.json_hints([1]) == []
    assert parsers.describe_json(value)[-5:] == ["deep: object (1 keys)", "deep.a: object (1 keys)", "deep.a.b: object (1 keys)", "list: array[1]"][-5:] or parsers.describe_json(value)[-1] == "list: array[1]"
    assert "more than ten characters" in parsers.json_strings(value) and len(parsers.describe_json({f"k{i}": i for i in range(80)})) == 50


def test_parser_symbols_become_entities(spark):
    rows = [("d", "", ["numpy.linalg", "@scope/pkg/x", "./own"], ["_run(x)", "ab()"], ["Store"], [("dependency", "redis-client"), (None, "")], [("Vector Store Design", 1)])]
    df = spark.createDataFrame(rows, "id string, t string, imports array<string>, functions array<string>, classes array<string>, hints array<struct<type:string,text:string>>, sections array<struct<title:string,level:int>>")
    got = {(r.text, r.label, r.confidence) for r in pipeline.raw_entities(df, "id", "t").collect()}
    assert {("NumPy", "LIBRARY", 0.94), ("@scope/pkg", "LIBRARY", 0.82), ("run", "FUNCTION", 0.74), ("Store", "CLASS", 0.78), ("redis-client", "DEPENDENCY", 0.75), ("Vector Store Design", "CONCEPT", 0.64)} <= got
    nodes, edges = pipeline.build_graph(pipeline.extract(df, "id", "t"), spark.createDataFrame([], "document_id string, source string, target string, relation string, confidence double"))
    assert "DEFINES" in {r.type for r in edges.collect()}


def test_acronyms_are_merged(spark):
    rows = [("d", "Retrieval Gate Node", "CONCEPT", 0.8, "a", 2), ("d", "RGN", "TOOL", 0.9, "b", 1), ("e", "RGN", "TOOL", 0.9, "b", 1), ("d", "Alone", "CONCEPT", 0.7, "a", 1)]
    df = spark.createDataFrame(rows, "document_id string, text string, label string, confidence double, source string, mentions int")
    got = {(r.document_id, r.text, r.confidence, r.mentions) for r in entities.merged(df, "document_id", "text").collect()}
    assert got == {("d", "RGN", 0.94, 3), ("e", "RGN", 0.9, 1), ("d", "Alone", 0.7, 1)} and entities.merged(df.where("false"), "document_id", "text").count() == 0


def test_hooks(spark):
    docs = spark.createDataFrame([("a", "Ada wrote it here, in full."), ("b", "fail on this text please"), ("c", None), ("d", "short")], "id string, t string")

    def make():
        def find(text):
            if "fail" in text:
                raise ValueError
            return [{"text": "Ada", "label": "person"}, {"text": ""}]

        return find

    got = hooks.hooked_entities(docs, "id", "t", make, "llm", 0.74, 20).collect()
    assert [(r.document_id, r.text, r.label, r.confidence, r.source) for r in got] == [("a", "Ada", "PERSON", 0.74, "llm")]
    assert hooks.hooked_entities(docs, "id", "t", None, "llm", 0.74).count() == 0
    named = docs.withColumn("n", F.array(F.lit("x"), F.lit("y")))
    rel = hooks.hooked_relations(named, "id", "t", "n", lambda: lambda names, text: [{"source": names[0], "target": names[1]}]).collect()
    assert {(r.document_id, r.relation, r.confidence) for r in rel} == {(i, "RELATED_TO", 0.7) for i in "abcd"}
    files = spark.createDataFrame([(bytearray(b"EICAR"),), (bytearray(b"ok"),), (None,)], "content binary")
    assert [r.threat for r in hooks.scanned(files, "content", lambda: lambda c: "bad" if b"EICAR" in c else None).collect()] == ["bad", None, None]
    assert [r.threat for r in hooks.scanned(files.limit(1), "content", lambda: lambda c: 1 / 0, fail_open=False).collect()] == ["scan failed"] and hooks.scanned(files, "content", None).count() == 3
    hooks.register_parser(".XYZ", lambda df: df)
    assert "xyz" in hooks.PARSERS


def test_concepts_and_summary(spark):
    ranked = spark.createDataFrame([("Knowledge Graph", 9), ("Graph", 8), ("graph store", 7), ("knowledge graph", 6)], "concept string, weight bigint")
    assert [r.concept for r in answers.without_redundant(ranked).collect()] == ["Knowledge Graph", "graph store"] and answers.without_redundant(ranked.where("false")).count() == 0
    docs = spark.createDataFrame([("d", "T", "md", ["one two three four five", "short"], ["k"]), ("e", "U", None, [], [])], "id string, title string, f string, c array<string>, k array<string>")
    lines = {(r.id, r.position): r.line for r in answers.single_summary(docs, "title", "f", "c", "k", "id").collect()}
    assert lines["d", 0] == "- Type: MD" and lines["d", 2] == "- Key terms: k" and lines["d", 4] == "  - one two three four five" and ("d", 5) not in lines and lines["e", 0] == "- Type: document" and ("e", 2) not in lines
    assert answers.intent("Summarize all files") == "collection"


def test_exports_escape(spark):
    nodes = spark.createDataFrame([("n1", 'a "b" <c> &', "CONCEPT", None)], "id string, label string, type string, confidence double").withColumn("documents", F.array(F.lit("x;1"), F.lit("y")))
    edges = spark.createDataFrame([("n1", "n1", "USES", 2, 0.5)], "source string, target string, type string, weight bigint, confidence double").withColumn("documents", F.array().cast("array<string>"))
    csv = {r.kind: r for r in graph.as_csv(nodes, edges).collect()}
    assert csv["node"].sources == "x;1; y" and csv["node"].confidence == "1.0" and csv["edge"].id == "n1->n1:USES" and csv["edge"].label == "USES" and csv["edge"].sources == ""
    import json
    from xml.etree import ElementTree

    more = spark.createDataFrame([("n1", "ro\"le", "x")], "id string, key string, value string")
    data = [json.loads(r.element)["data"] for r in graph.as_cytoscape(nodes, edges, more).collect()]
    assert data[0]["label"] == 'a "b" <c> &' and data[0]["ro\"le"] == "x" and data[0]["sources"] == ["x;1", "y"] and data[1]["weight"] == 2
    root = ElementTree.fromstring("".join(r.line for r in graph.as_gexf(nodes, edges).orderBy("part").collect()))
    assert len(root.findall(".//{*}attvalue")) == 6 and root.find(".//{*}node").get("label") == 'a "b" <c> &'


def test_properties_of_a_node_are_the_last_filled(spark):
    rows = [("x", "A", "d1", 1, "1", '{"city": "P", "role": "r"}'), ("x", "A", "d2", 2, "2", '{"city": "Q", "role": ""}'), ("x", "A", "d1", 3, "3", None), ("y", "A", None, 1, "4", "broken")]
    df = spark.createDataFrame(rows, "normalized string, label string, document_id string, created_at int, id string, metadata_json string")
    assert {(r.key, r.value) for r in graph.node_properties(df).collect()} == {("city", "Q"), ("role", "r")}
    assert sorted(r.document for r in graph.node_sources(df).collect()) == ["d1", "d2"]


def test_stored_index_is_replaced_by_document(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "d1", "alpha beta"), ("c2", "d1", "gamma"), ("c3", "d2", "alpha")], "id string, document string, text string")
    folder, source = str(tmp_path / "index"), str(tmp_path / "in")
    make = lambda df: search.chunk_index(df, "id", "document", "text")
    rows.coalesce(1).write.parquet(source + "/a")
    run = lambda part: streams.incremental_index(spark.readStream.schema(rows.schema).parquet(f"{source}/{part}"), folder, str(tmp_path / f"state-{part}"), make)
    run("a")
    spark.createDataFrame([("c9", "d1", "delta")], rows.schema).coalesce(1).write.parquet(source + "/b")
    run("b")
    assert {r.chunk_id for r in search.load_index(spark, folder).collect()} == {"c9", "c3"} and [r.chunk_id for r in search.load_index(spark, folder, "d2").collect()] == ["c3"]
    assert search.semantic(search.load_index(spark, folder), "alpha", 3).first().chunk_id == "c3"


def test_state_changes_cross_spans(spark):
    rows = [(1, "a", 0), (2, "a", 5), (3, "b", 11), (4, "b", 25), (5, "a", 26), (6, None, 40), (7, "a", 41)]
    df = spark.createDataFrame([(u, e, s, t) for u in ("x", None) for e, s, t in rows], "user_id string, event_id int, event_type string, ts int")
    got = sorted((r.user_id or "", r.event_id, r.previous) for r in streams.state_changes(df, span=10).collect())
    assert got == [(u, *r) for u in ("", "x") for r in [(1, None), (3, "a"), (5, "b"), (7, None)]]
    assert streams.state_changes(df.where("false")).count() == 0


def test_columns_of_a_table(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", None)], "s string, n int")
    got = {r.column: r for r in readers.column_shapes(df, ["s", "n"]).collect()}
    assert (got["s"].dtype, got["s"].filled, got["s"].distinct, got["s"].samples) == ("string", 3, 2, "a|b") and got["n"].samples == "1|2|3"


def test_plans_that_must_hold(spark, small):
    from quernstone.plans import catalogue

    plan = lambda q: catalogue.QUERIES[q](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan("html_to_markdown").count("MapInArrow") == 1 and "Exchange" not in plan("html_to_markdown")
    assert plan("semantic_search_topk").count("TakeOrderedAndProject") == 1
    assert "ObjectHashAggregate" not in plan("pipeline_metrics_histogram") and plan("document_flags").count("Exchange") == 0
