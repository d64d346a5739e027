import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import boosting, contamination, langid, mainbody, moderation, packing, splitting

EN = "The parser reads every file in the folder and writes a line to the log. We agreed on the new names before the review."
FR = "Le moteur de recherche lit tous les fichiers dans le dossier et ajoute une ligne au journal. Nous avons choisi les noms avant la revue."
DE = "Der Parser liest alle Dateien in dem Ordner und schreibt eine Zeile in das Protokoll. Wir haben uns auf die neuen Namen geeinigt."


@pytest.fixture(scope="module")
def model():
    return langid.fit([EN, FR, DE, EN + "\n" + FR] * 5)


def segments(spark, model, rows):
    df = spark.createDataFrame(rows, "id string, t string, record_id int")
    return {r.record_id: [(s.lang, s.start_pos) for s in r.segments] for r in langid.label_segments(df, "id", "t", model, ("record_id",)).collect()}


def test_languages_and_segments(spark, model):
    got = segments(spark, model, [("e", EN, 1), ("f", FR, 1), ("m", EN + " " + FR, 1), ("n", None, 1), ("b", "  \n", 1), ("c", "```\nfor x in y: the code of the day\n```", 1), ("h", "# Le titre de la page", 1), ("t", "| the | of | and |", 1), ("z", "解析器读取目录中的所有文件。", 1)])
    assert [x for x, _ in got["e"]] == ["en"] and [x for x, _ in got["f"]] == ["fr"] and [x for x, _ in got["m"]] == ["en", "fr"]
    assert got["n"] == got["b"] == got["c"] == got["h"] == got["t"] == [] and [x for x, _ in got["z"]] == ["zh"]


def test_padding_hides_no_prose(spark, model):
    got = segments(spark, model, [("l", "\t" * 500 + FR, 1), ("r", FR + " \t\r" * 200, 1), ("m", FR.replace(". ", "." + "\t" * 500), 1), ("d", "12\t" * 100 + "total" + " " * 500, 1)])
    assert [[x for x, _ in got[k]] for k in "lrm"] == [["fr"]] * 3 and got["d"] == []


def test_long_tokens_and_names(spark, model):
    address = "https://www.files.example/" + "a1b2" * 30
    got = segments(spark, model, [("a", f"The parser reads every file in the folder at {address} before the review.", 1), ("n", "Golduscan\xa0Jaspax Tormograph Tormolis Wexpapad", 1), ("u", EN.upper(), 1)])
    assert [x for x, _ in got["a"]] == ["en"] and got["n"] == [] and [x for x, _ in got["u"]] == ["en"]


def test_a_switch_inside_a_sentence(model):
    text = "We agreed on the new names and then le moteur de recherche lit tous les fichiers dans le dossier et ajoute une ligne."
    got = langid.segments_of([text, None, ""], model)
    assert [s["lang"] for s in got[0]] == ["en", "fr"] and text[got[0][1]["start_pos"] :].startswith("le moteur") and got[1:] == [[], []]
    assert [s["sentences"] for s in got[0]] == [0, 1] and got[0][0]["end_pos"] == got[0][1]["start_pos"]


def test_a_very_long_line(model):
    got = langid.segments_of([(EN + " ") * 3000, FR], model)
    assert [s["lang"] for s in got[0]] == ["en"] and got[0][0]["sentences"] == 6000 and [s["lang"] for s in got[1]] == ["fr"]


def test_main_language(spark, model):
    df = spark.createDataFrame([("m", EN + " " + EN + " " + FR), ("n", None)], "id string, t string")
    got = {r.record_id: r.m for r in langid.label_segments(df, "id", "t", model).select("record_id", langid.main_language(F.col("segments")).alias("m")).collect()}
    assert got["m"].lang == "en" and 0.4 < got["m"].confidence < 0.8 and got["n"] is None


def test_field_on_no_texts_uses_its_lexicons():
    m = langid.fit([])
    p = m.marginals(m.emissions("der parser und die datei".split()), [5])
    assert langid.LANGS[int(p.sum(0).argmax())] == "de" and np.allclose(p.sum(1), 1, atol=1e-5)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.standard_normal((4, 3)), rng.standard_normal((3, 3))
    total = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, s in enumerate(path):
            total[i, s] += w
    got, _ = langid.forward_backward([e.astype(np.float32)], t.astype(np.float32))
    assert np.allclose(got[0], total / total.sum(1, keepdims=True), atol=1e-4)


def test_declared_language(spark):
    values = {'{"lang": "en-US"}': "en", '{"lang": "German"}': "de", '{"lang": "fra"}': "fr", '{"lang": "es_MX"}': "es", '{"lang": "unknown"}': None, '{"lang": ""}': None, "{}": None, "not json": None}
    df = spark.createDataFrame([(k,) for k in values] + [(None,)], "m string")
    assert dict(map(tuple, df.select("m", langid.declared_language(F.col("m"))).collect())) == values | {None: None}


def stretch(text):
    import re

    return max((len(s) for s in re.split(r"[ \t\r\n]", re.sub(r"([。！？；，、])", r"\1 ", text))), default=0)


def test_pieces_against_their_definition():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "a", "\n", "\n\n", ". ", "。", "x" * rng.randint(1, 60), "# T\n", " " * rng.randint(1, 9)]) for _ in range(rng.randint(1, 80))).strip()
        limit, overlap = rng.randint(20, 60), rng.randint(0, 12)
        pieces = splitting.cut(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(b - a <= limit for a, b, _ in pieces)
        assert all(x[1] > x[0] and x[0] < y[0] <= x[1] < y[1] and x[1] - y[0] <= overlap for x, y in zip(pieces, pieces[1:]))
        if len(text) > limit:
            assert any(f for _, _, f in pieces) == (stretch(text) > limit)


def test_overlap_is_whole_where_it_fits():
    text = "some words here and there. " * 100
    pieces = splitting.cut(text, 200, 30)
    assert all(x[1] - y[0] == 30 for x, y in zip(pieces, pieces[1:]))
    assert splitting.cut("", 10, 2) == [(0, 0, False)] and splitting.cut("x" * 25, 10, 0)[-1][1] == 25
    with pytest.raises(ValueError):
        splitting.cut("x", 5, 5)


def test_splitting_rows(spark):
    df = spark.createDataFrame([("a", "x" * 30, 1), ("a", "x" * 30, 1), ("b", "short", 1), (None, "y" * 30, 1), ("c", None, 1), ("d", "  ", 1)], "id string, text string, piece int")
    rows = splitting.split_items(df, "id", "text", 20, 5).distinct().collect()
    assert sorted((r.record_id, r.piece_no, r.start_pos, r.end_pos, r.forced) for r in rows) == [("a", 0, 0, 20, True), ("a", 1, 15, 30, False)]
    assert splitting.split_items(df.where("false"), "id", "text", 20, 5).count() == 0


PAGE = "<html><head><title>The word totals</title></head><body><div class='menu-top'><li><a href='/a'>Home</a></li><li><a href='/b'>Pricing</a></li></div><div class='content-body'><h1>The word totals</h1><p>{0}</p><p>{1}</p></div><div class='site-footer'><p>© 2025 Site. All rights reserved</p></div></body></html>"


def test_page_lines_are_tied_to_their_markup():
    html = "<div class='menu'><LI><a>Home</a><li>Docs</div><article><p>Long <b>text</b> here.<pre>a = 1\nb = 2</pre></article>"
    align = lambda lines, html: mainbody.align([mainbody.key(x) for x in lines], mainbody.leaves(html)[0])
    found = align(["Home", "Docs", "Long text here.", "a = 1", "b = 2", "absent"], html)
    assert [e and e.group.split(".")[1] for e in found] == ["div", "div", "article", "article", "article", None]
    # an article after a menu of any length that the text lacks
    menu = "<div class='menu'>" + "".join(f"<li>entry number {i}" for i in range(5000)) + "</div>"
    far = align(["Home", "The long text is here.", "And goes on here."], "<nav>Home</nav>" + menu + "<article><p>The long text is here.<p>And goes on here.</article>")
    assert [e and e.group.split(".")[1] for e in far] == ["nav", "article", "article"]
    # any number of tags left open inside the element that ends
    deep = mainbody.leaves("<article>" + "<b>" * 40 + "x</article><p>y")[0]
    assert [e.group for _, e in deep] == [".article.", "/p"]


def test_main_lines(spark):
    body = ["The parser reads every file in the folder before the cache expires.", "A second reviewer checks the word totals, and nobody has to reload the page."]
    text = "\n".join(["Home", "Pricing", "", "The word totals", *body, "© 2025 Site. All rights reserved"])
    taught = [mainbody.features(text, PAGE.format(*body), "The word totals")] * 40
    net = mainbody.fit(taught, epochs=12)
    rows = [(1, text, PAGE.format(*body), "The word totals", "x"), (2, text, None, None, "x"), (3, None, "<p>x</p>", None, "x"), (4, " \n", None, None, "x"), (None, text, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, text string, html string, title string, line string")
    got = {}
    for r in mainbody.main_lines(df, net).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert got[1] == {3, 4, 5} and set(got) <= {1, 2}
    assert mainbody.main_lines(df.where("false"), net).count() == 0


def test_a_model_is_fitted_once_for_the_same_pages(spark, monkeypatch):
    body = ["The parser reads every file in the folder before the cache expires.", f"Run {random.random()} checks the word totals."]
    text = "\n".join(["Home", "Pricing", "The word totals", *body])
    df = spark.createDataFrame([(1, text, PAGE.format(*body), None), (2, text, PAGE.format(*body), "The word totals"), (3, text, PAGE.format(*body), "The word totals")], "page_id bigint, text string, html string, title string")
    first = mainbody.fit_on(df)
    monkeypatch.setattr(mainbody, "fit_twice", lambda pages: 1 / 0)
    assert all((first.p[k] == v).all() for k, v in mainbody.fit_on(df.repartition(3)).p.items())


def test_all_words_of_a_line_are_read():
    line = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(99))
    ids = mainbody.features(line, None, None)[2]
    other = mainbody.features(line[:-3] + "subscribe", None, None)[2]
    assert len(ids[0]) == 99 and ids[0][:-1] == other[0][:-1] and ids[0][-1] != other[0][-1]


def test_gradients_of_the_labeller():
    page = mainbody.features("A line\nAnother line here.", "<div class='content'><p>A line</p><p>Another line here.</p></div>", None)
    net = mainbody.Network()
    x, mask = net.stack([page])
    x = x.astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.forward(x, mask)[0]).sum()
    prob, state = net.forward(x, mask, True)
    grad, _ = net.backward(x, (prob - 1).astype(np.float64), state)
    for name in ("fx", "fh", "bb", "out"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-3
        up = loss()
        net.p[name][at] = before - 1e-3
        assert abs((up - loss()) / 2e-3 - grad[name][at]) < 0.02 * abs(grad[name][at]) + 1e-3
        net.p[name][at] = before


def test_plan_uses_every_length_exactly():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 25))}
        made = packing.plan(histogram, 64)
        used = {}
        for pattern, times in made:
            assert sum(pattern) <= 64
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == histogram
    assert packing.plan({}, 64) == []


def test_counts_fit_the_histogram():
    rng = random.Random(6)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 65), 40)}
    rows = packing.patterns(histogram, 64)
    x, left = packing.fit_counts(rows, histogram)
    assert (x >= 0).all() and left < 0.4
    used = {}
    for r, c in zip(rows, x):
        for n in r:
            used[n] = used.get(n, 0) + c
    norm = lambda d: sum(n * d[n] ** 2 for n in histogram) ** 0.5
    assert abs(norm({n: used.get(n, 0) - c for n, c in histogram.items()}) / norm(histogram) - left) < 1e-6


def test_packing_round_trip(spark):
    rows = [(i, n) for i, n in enumerate([0, 5, 5, 7, 64, 65, 200, 1, 1, 63] * 4)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, tokens int").repartition(3), 64).collect()
    by, full = {}, {}
    for r in got:
        by[r.id] = by.get(r.id, 0) + r.tokens
        full[r.container] = full.get(r.container, 0) + r.tokens
    assert by == dict(rows) and max(v for k, v in full.items() if k) <= 64 and sorted(full) == list(range(len(full)))
    assert all(r.piece == 0 for r in got if dict(rows)[r.id] <= 64)
    assert packing.pack(spark.createDataFrame([], "id bigint, tokens int"), 64).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "k bigint, t string, tokens string")
    assert dict(map(tuple, packing.token_counts(df, "k", "t").collect())) == {1: 2, 2: 0, 3: 0}


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 8, 20])))) for i in range(30)] + [(30, ""), (31, None)]
    docs = []
    for d in range(60):
        ws = rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 2:
            i = rng.choice(items[:30])[1].split()
            ws[5:5] = i[: rng.randint(1, len(i))]
        docs.append((d, " ".join(ws).upper() if d % 3 else " ".join(ws)))
    docs += [(60, None), (61, "")]
    got = {(r.doc_id, r.item_id) for r in contamination.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")).collect()}
    want = set()
    for d, t in docs:
        ws = (t or "").lower().split()
        for i, s in items:
            it = (s or "").split()
            m = min(12, len(it))
            runs = {tuple(it[k : k + 5]) for k in range(len(it) - 4)}
            mine = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
            if m and (any(ws[k : k + m] == it[j : j + m] for k in range(len(ws) - m + 1) for j in range(len(it) - m + 1)) or runs and 2 * len(runs & mine) >= len(runs)):
                want.add((d, i))
    assert got == want and want


def test_leaks_see_through_marks_and_line_ends(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, "x One t­wo thr-\nee four five six y"), (2, "one two three four five")], "doc_id bigint, text string")
    found = contamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, item_text string"))
    assert [(r.doc_id, r.longest, r.places) for r in found.orderBy("doc_id").collect()] == [(1, 6, [1])] + ([(2, 5, [0])] if found.count() == 2 else [])
    assert contamination.without_leaks(docs, found).count() == 2 - found.count()
    assert contamination.leaks(docs, spark.createDataFrame([], "item_id bigint, item_text string")).count() == 0


def test_suffix_search():
    seq = np.array([1, 2, 3, 0, 2, 3, 1, 2, 0])
    order = contamination.suffix_array(seq)
    low, high = contamination.search(seq, order, np.array([[2, 3], [1, 2], [3, 2]]))
    assert (high - low).tolist() == [2, 2, 0]


def test_longest_match_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        doc, item = rng.integers(0, 5, rng.integers(1, 60)).astype(np.int32), rng.integers(1, 5, rng.integers(1, 30)).astype(np.int32)
        runs = {}
        for k in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while k + n < len(doc) and j + n < len(item) and doc[k + n] == item[j + n]:
                    n += 1
                runs.setdefault(n, []).append((j, k))
        best = max(runs)
        got = contamination.longest(np.r_[doc, 0], contamination.suffix_array(np.r_[doc, 0]), item) if doc.any() else (0, [])
        assert got[0] == best
        if best:
            j = min(j for j, _ in runs[best])
            assert set(got[1]) in [{k for i, k in runs[best] if (item[i : i + best] == item[q : q + best]).all()} for q, _ in runs[best]]


def test_items_in_blocks_are_all_searched(spark):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(40)], "item_id bigint, item_text string")
    docs = spark.createDataFrame([(i, f"x a{i} b{i} c{i} d{i} y") for i in range(40)], "doc_id bigint, text string")
    found = contamination.leaks(docs, items, item_words=20).collect()
    assert {(r.doc_id, r.item_id, r.longest, tuple(r.places)) for r in found} == {(i, i, 4, (1,)) for i in range(40)}


def test_moderation_without_and_with_ratings(spark):
    bad = ["Shut up, you worthless idiot.", "You are a useless m.o.r.o.n, get lost!", "Listen, you disgusting idi\u200bоt, shut up."]
    good = ["Guidelines: a reply that calls someone a moron is hidden.", "The dumb terminal prints garbage.", "The parser reads the file.", None, ""]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(bad + good)], "doc_id bigint, text string, abusive string")
    got = {r.id: r.abusive for r in moderation.scores(df, moderation.fit([], [])).collect()}
    assert len(got) == 8 and min(got[i] for i in range(3)) > 0.5 > max(got[i] for i in range(3, 8))
    ratings = spark.createDataFrame([(0, "abusive"), (3, "none"), (4, None)], "doc_id bigint, category string")
    fitted = moderation.fit_on(df, ratings)
    assert moderation.scores(df.where("false"), fitted).count() == 0


def test_every_sentence_is_judged():
    model = moderation.fit([], [])
    assert min(model.score([t])[0, 0] for t in ("I will find your house and break your legs.", "白痴！", "The file is read. 废物！ The file is read.")) > 0.5
    owner, x = moderation.Reader({}).read(["滚。", "", None, "One. Two!", "...", "a" * 100_000])
    assert owner.tolist() == [0, 3, 3, 5] and np.isfinite(x).all()


def test_moderation_on_held_out_ratings(small):
    """Fitted on the ratings of half the rated documents; of the other half the documents on which two raters or more agree are told apart."""
    import pandas as pd

    folder = f"{small}/../sf0.1"
    ratings = pd.read_parquet(f"{folder}/moderation_labels.parquet").dropna(subset="category")
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).dropna()
    per = ratings.groupby("doc_id").category.agg(list).reset_index().merge(docs, on="doc_id").sort_values("doc_id")
    shares = [{c: r.count(c) / len(r) for c in moderation.CATEGORIES} for r in per.category]
    texts, taught = per.text.tolist(), per.doc_id % 2 == 0
    model = moderation.fit([t for t, k in zip(texts, taught) if k], [s for s, k in zip(shares, taught) if k])
    rest = [(t, s) for t, s, k, r in zip(texts, shares, taught, per.category) if not k and len(r) > 1 and (not any(s.values()) or max(s.values()) == 1)]
    worst = model.score([t for t, _ in rest]).max(1) >= 0.4
    bad = np.array([max(s.values()) == 1 for _, s in rest])
    assert worst[bad].mean() >= 0.8 and worst[~bad].mean() < 0.1, (bad.sum(), worst[bad].mean(), worst[~bad].mean())


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = boosting.Trees().fit(x, y, np.ones(400))
    assert ((t.margin(x) > 0) == y).mean() > 0.95
    assert boosting.Trees().fit(x[:0], y[:0], y[:0]).margin(x).tolist() == [0] * 400
    xs, ys = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(ys) >= 0).all() and ys[0] == 0 and ys[-1] == 1
