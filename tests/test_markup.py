from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import markup


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sections_keep_their_order_and_drop_headings_without_lines(spark):
    got = one(spark, "intro\n# A\n## B\nbody\n# C\n\n# D\nend", markup.sections)
    assert [(s["title"], s["level"], s["content"]) for s in got] == [("Introduction", 0, "intro"), ("B", 2, "body"), ("C", 1, ""), ("D", 1, "end")]


def test_sections_of_empty_and_null(spark):
    assert one(spark, "", markup.sections) == []
    assert one(spark, None, markup.sections) is None


def test_links_are_not_images(spark):
    text = "[docs](https://example.com) ![](a.png) ![logo](b.png)"
    assert [(x["text"], x["url"]) for x in one(spark, text, markup.links)] == [("docs", "https://example.com")]
    assert [(x["alt"], x["url"]) for x in one(spark, text, markup.images)] == [("image", "a.png"), ("logo", "b.png")]


def test_code_blocks_and_their_default_language(spark):
    got = one(spark, "a\n```python\nx = 1\n```\n```\ny\n```\n```js\n```", markup.code_blocks)
    assert [(b["language"], b["code"]) for b in got] == [("python", "x = 1"), ("text", "y")]


def test_list_items(spark):
    got = one(spark, "- first\n  - second\n3. third\nno", markup.list_items)
    assert [(x["text"], x["level"], x["ordered"], x["line"]) for x in got] == [("first", 0, False, 1), ("second", 1, False, 2), ("third", 0, True, 3)]


def test_slug_and_title(spark):
    assert one(spark, "Hello, World!", markup.slug) == "hello-world"
    assert one(spark, "dir/my_first-note v2.md", T.readable_title) == "My First Note V2"


def test_js_outline(spark):
    source = "import a from 'react';\nconst b = require('./local');\nfunction go(x) { }\nconst run = async (y) => 1;\nclass Foo {}"
    got = one(spark, source, markup.js_outline)
    assert got["imports"] == ["react", "./local"] and got["classes"] == ["Foo"] and "go" in got["functions"] and "run" in got["functions"]
    assert one(spark, "@scope/pkg/sub", markup.package_of) == "@scope/pkg"
    assert one(spark, "./x", markup.package_of) is None


def test_windows_cover_the_text(spark):
    got = one(spark, "x" * 1400, T.windows)
    assert [(w["start_pos"], w["end_pos"]) for w in got] == [(0, 800), (650, 1400), (1300, 1400)]
    assert one(spark, "", T.windows) == []


def test_tokens_and_aliases(spark):
    assert one(spark, "JS, Node.js and ML: C++ v1 -a-", T.tokens) == ["javascript", "node.js", "and", "machine-learning", "c++", "v1"]


def test_embedding_has_length_one(spark):
    got = one(spark, "python api python", lambda c: T.embed(T.tokens(c)))
    assert abs(sum(x["weight"] ** 2 for x in got) - 1) < 1e-9 and len(got) == 2
    assert one(spark, "知识", lambda c: T.embed(T.tokens(c))) == []


def test_excerpt_is_near_the_term(spark):
    text = "Start here. " + "filler words go on and on. " * 30 + "The needle is in this sentence. " + "more text follows here. " * 30
    got = one(spark, text, lambda c: T.excerpt(c, F.array(F.lit("needle"))))
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got) < 330
    assert one(spark, "short [a](https://b.c)", lambda c: T.excerpt(c, F.array(F.lit("x")))) == "short a (https://b.c)"
