import io
import json
import zipfile

from pyspark.sql import functions as F

from quernstone.sources import parsers, readers
from quernstone.streaming import streams

PAGE = """<html><head><title>T</title></head><body><nav><a href='/x'>Menu</a></nav><article><h1>Guide</h1><p>See the <a href='modules.html'>modules chapter</a> for details on how packages are
found and loaded by the interpreter, and what happens when two of them share a name.</p><ul><li>first</li></ul><pre class='language-python'>x = 1
</pre><p>Next</p><a href='javascript:x'>bad</a></article></body></html>"""


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Metric", "Value"), ("Revenue", "10"))) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', style)}{p('Body text.')}{table}</w:body></w:document>")
    return out.getvalue()


def test_page_to_markdown():
    got = parsers.to_markdown(PAGE, "https://docs.example/tutorial/index.html")
    assert got.startswith("# Guide") and "[modules chapter](https://docs.example/tutorial/modules.html)" in got
    assert "- first" in got and "```python\nx = 1\n```" in got and "Menu" not in got and "Next" not in got and "javascript" not in got
    assert parsers.to_markdown(None) == "" and parsers.to_markdown("  ") == ""


def test_tables():
    assert parsers.normal_table([["Metric", "Value"], ["", None], ["Revenue", "$10"]]) == (["Metric", "Value"], [["Revenue", "$10"]])
    assert parsers.normal_table([["a"], [""]]) is None


def test_files_of_every_kind(spark, tmp_path):
    files = {
        "a.md": b"# Head\nText\n```py\nx\n```", "b.txt": b"plain \xff text", "c.js": b"import x from 'lib';\nclass A {}", "d.py": b'"""Doc."""\nimport os\ndef f(a, b):\n    """Does."""\n', "bad.py": b"def (",
        "e.json": json.dumps({"name": "pkg", "dependencies": {"left": "1"}, "nested": {"k": [1, 2]}}).encode(), "f.html": PAGE.encode(), "g.docx": docx(), "h.csv": b"a,b\n1,x\n2,y\n", "i.pdf": b"%PDF-1.4", "j.exe": b"no",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.name: r.parsed for r in readers.parse(readers.files(spark, str(tmp_path))).collect()}
    assert set(rows) == set(files) - {"j.exe"}
    assert rows["a.md"].title == "Head" and "x" not in rows["a.md"].raw_text.split("\n")
    assert rows["b.txt"].raw_text == "plain ÿ text"
    assert rows["c.js"].imports == ["lib"] and rows["c.js"].classes == ["A"]
    assert rows["d.py"].functions == ["f(a, b)"] and rows["d.py"].imports == ["os"] and [s.title for s in rows["d.py"].sections] == ["Module", "f"]
    assert rows["bad.py"].error and rows["bad.py"].functions == []
    assert "nested.k: array[2]" in rows["e.json"].raw_text and [(h.type, h.text) for h in rows["e.json"].hints] == [("library", "pkg"), ("dependency", "left")]
    assert rows["f.html"].title == "T" and "# Guide" in rows["f.html"].raw_text
    assert [(s.title, s.content) for s in rows["g.docx"].sections] == [("Title", "Body text.\n\nMetric | Value\n\nRevenue | 10")]
    assert rows["h.csv"].raw_text.startswith("a: int64") and rows["i.pdf"].error
    good, bad = readers.accepted(readers.files(spark, str(tmp_path)))
    assert good.count() == 9 and [(r.name, r.reject_reason) for r in bad.collect()] == [("f.html", "danger")]


def test_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    (r,) = readers.csv_profile(df, ["x"]).collect()
    assert (r["count"], r["min"], r["q50"], r["max"]) == (3, 1.0, 2.0, 4.0)


def test_streams_agree_with_batches(spark, small):
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    streamed = streams.drain(streams.windows(streams.events_stream(spark, small).withWatermark("ts", streams.LATE), 86_400), "update", ["user_id", "window_start"])
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, streams.windows(batch, 86_400).collect()))
    once = streams.drain(streams.first_per_key(streams.events_stream(spark, small)).select("event_id"))
    assert once.count() == batch.select("event_id").distinct().count()


def test_incremental_index_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("d1", "a"), ("d2", "b")], "document string, text string").write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema("document string, text string").parquet(source)
        streams.incremental_index(stream, str(tmp_path / "out"), str(tmp_path / f"state{k}"), lambda b: b)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_histories(spark):
    df = spark.createDataFrame([("u", i, "ab"[i % 2], i) for i in range(9)], "user_id string, event_id int, event_type string, ts int")
    assert [r.event_id for r in streams.recent(df, 6).orderBy("rank").collect()] == [8, 7, 6, 5, 4, 3]
    assert [r.event_type for r in streams.recent_distinct(df, 5).orderBy("rank").collect()] == ["a", "b"]
    assert streams.state_changes(df).count() == 9
