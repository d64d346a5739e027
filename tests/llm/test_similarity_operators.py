import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import knn, names, neardup, queries
from quernstone.llm.wordhash import words
from quernstone.session import cut_lineage


def test_words():
    assert words("Ab_c, d1—é") == ["ab", "c", "d1", "é"] and words(None) == [] and words("") == []


def texts(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randint(32, 80)) for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            rows.append(" ".join(w))
    return rows + [rows[0]] * 20 + ["short text"] * 3 + ["", None]


def similarity(a, b):
    x, y = (set(zip(w, w[1:], w[2:])) for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rows = texts(random.Random(1))
    data = [(f"r{i:03}", t, dt.datetime(2025, 1, 1), "x") for i, t in enumerate(rows)]
    data += [("r001", rows[1] + "  ", dt.datetime(2025, 1, 2), "x"), (None, rows[0], None, "x")]
    df = spark.createDataFrame(data, "id string, text string, created_at timestamp, class string")
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", "text", "created_at").collect()}
    long = [(f"r{i:03}", t) for i, t in enumerate(rows) if len(words(t)) >= 30]
    want = {(a, b) for k, (a, s) in enumerate(long) for b, t in long[k + 1 :] if similarity(s, t) >= 0.7}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_latest_version_of_an_id_counts(spark):
    t = " ".join(f"a{i}" for i in range(40))
    day = lambda n: dt.datetime(2025, 1, n)
    df = spark.createDataFrame([("x", t, day(1)), ("x", "now short", day(2)), ("y", t, day(1)), ("z", t, day(1))], "id string, text string, at timestamp")
    assert [tuple(r) for r in neardup.near_duplicates(df, "id", "text", "at").collect()] == [("y", "z")]
    assert neardup.near_duplicates(df.where("false"), "id", "text", "at").count() == 0


def test_groups_are_components(spark):
    rows = texts(random.Random(4))
    df = spark.createDataFrame([(f"r{i:03}", t) for i, t in enumerate(rows)], "id string, text string")
    pairs, members = neardup.near_pairs(df, "id", "text", None, 0.8, 5, 5)
    got = {r.rid: r.group for r in neardup.groups(pairs, members).collect()}
    assert set(got) == {f"r{i:03}" for i, t in enumerate(rows) if len(words(t)) >= 5}
    assert len({got["r000"], *(got[f"r{i:03}"] for i in range(100, 120))}) == 1
    linked = {tuple(r) for r in neardup.expand(pairs, members).collect()}
    assert all(got[a] == got[b] for a, b in linked)


def test_groups_hold_documents_and_chunks(spark, small):
    got = queries.p5_groups(spark, small).cache()
    docs = spark.read.parquet(f"{small}/parsed_documents.parquet").select("document_id", "raw_text").collect()
    want = {r.document_id for r in docs if r.document_id and len(words(r.raw_text)) >= 5}
    assert {r.rid for r in got.where("group LIKE 'document:%'").collect()} == want and want
    assert got.where("group NOT LIKE 'document:%'").count() > 0


def test_anchors_are_codewords_within_the_radius(spark):
    rng = random.Random(9)
    poly = lambda c, x: (c[0] + c[1] * x + c[2] * x * x) % neardup.P
    c = [rng.randrange(neardup.P) for _ in range(3)]
    word = [poly(c, x) for x in range(4)]
    rows = [("w", word)] + [(f"d{k}", [v if x != k else rng.randrange(neardup.P) for x, v in enumerate(word)]) for k in range(4)] + [("far", [word[0], word[1], 5, 7])]
    df = spark.createDataFrame(rows, "node string, symbols array<int>").selectExpr("*", "10 AS size")
    got = {}
    for r in neardup.anchors(df, 1).collect():
        got.setdefault(r.node, set()).add(r.anchor)
    assert len(got["w"]) == 1 and all(len(got[f"d{k}"]) == 4 and got["w"] <= got[f"d{k}"] for k in range(4)) and not got["w"] & got["far"]


def test_long_lists_lose_no_pair(spark):
    keyed = spark.createDataFrame([(i, 10, i % 3) for i in range(900)], "node bigint, size int, anchor bigint")
    want = {(a, b) for a in range(900) for b in range(a + 3, 900, 3)}
    assert {tuple(r) for r in neardup.met(keyed, 0.7, 64).collect()} == want
    assert {tuple(r) for r in neardup.met(keyed, 0.7).collect()} == want


def test_a_template_alone_makes_few_candidates(spark):
    rng = random.Random(2)
    rows = [(f"r{i:04}", "this page was last changed by the team " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(4000)]
    marked = neardup.fingerprint(spark.createDataFrame(rows, "id string, text string"), "id", "text", None, 30)
    met = neardup.met(neardup.anchors(marked.withColumn("node", F.monotonically_increasing_id())), 0.7).count()
    assert met < 40_000  # 8 million pairs


def test_chance_meetings_are_not_written(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"r{i:04}", "this page was last changed by the team " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(4000)]
    rows += [(f"s{i:04}", rows[i][1] + " more") for i in range(100)]
    written = []
    monkeypatch.setattr(neardup, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == {(f"r{i:04}", f"s{i:04}") for i in range(100)}
    assert max(df.count() for df in written if df.columns == ["a", "b"]) < 500  # about 7,000 pairs meet


def test_folded_parities_lose_no_pair(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        n = rng.choice((32, 60, 66, 68, 90, 150, 270, 400))
        w = [f"v{rng.randrange(300)}" for _ in range(n)]
        rows += [(f"{k}-{e}", " ".join([*w[: n - e], *(f"{k}y{i}" for i in range(rng.randint(0, e)))])) for e in (0, 1, n // 12, n // 6)]
    texts = dict(rows)
    for bits in (192, 640):
        marked = neardup.fingerprint(spark.createDataFrame(rows, "id string, text string"), "id", "text", None, 30, bits=bits).where("size > 0")
        keyed = marked.select(F.col("rid").alias("node"), "size", *neardup.folded(bits), F.lit(1).alias("anchor"))
        got = {tuple(r) for r in neardup.met(keyed, 0.7).collect()}
        each = sorted(r.rid for r in marked.select("rid").collect())
        want = {(a, b) for k, a in enumerate(each) for b in each[k + 1 :] if similarity(texts[a], texts[b]) >= 0.7}
        assert want <= got and len(want) > 100


def test_broadcasts_are_bounded(spark, monkeypatch):
    assert neardup.PICKED <= 100_000
    rows = texts(random.Random(3))
    df = spark.createDataFrame([(f"r{i:03}", t) for i, t in enumerate(rows)], "id string, text string")
    want = {tuple(r) for r in neardup.near_duplicates(df, "id", "text").collect()}
    sent, plain = [], F.broadcast
    monkeypatch.setattr(neardup, "PICKED", 10)
    monkeypatch.setattr(neardup, "MARKS", 4 * neardup.PART)
    monkeypatch.setattr(F, "broadcast", lambda d: sent.append(d) or plain(d))
    got = neardup.near_duplicates(df, "id", "text")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    assert max(d.count() for d in sent) <= 10 and any("_marks" in d.columns for d in sent)


def test_bitmap_keeps_every_id(spark):
    df = spark.range(200_000).selectExpr("CASE WHEN id % 1000 = 999 THEN null ELSE concat('k', id) END AS id", "id AS v")
    ids = spark.range(0, 200_000, 20).selectExpr("concat('k', id) AS rid")
    got = neardup.may_be_among(df, "id", ids)
    assert got.columns == ["id", "v"] and got.join(ids, got.id == ids.rid).count() == 10_000 and got.count() < 10_500
    assert neardup.may_be_among(df, "id", ids.where("false")).count() == 0


def test_pairs_at_the_threshold_are_kept(spark):
    rows = []
    for k in range(3000):
        w = [f"{k}x{i}" for i in range(70)]
        rows += [(f"{k:04}a", " ".join(w)), (f"{k:04}b", " ".join([*w[:57], *(f"{k}y{i}" for i in range(13))]))]  # 55 triples of 81, 0.68
        rows += [(f"{k:04}c", " ".join([*w[:58], *(f"{k}z{i}" for i in range(12))]))]  # 56 of 80, 0.7
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", "text").collect()}
    want = {(f"{k:04}a", f"{k:04}c") for k in range(3000)}
    assert not any(b.endswith("b") and a.endswith("a") for a, b in got) and len(want - got) <= 0.0012 * len(want)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size in (5, 80, 2000):
        sets = [rng.integers(0, 3 * size, size, dtype=np.uint64) for _ in range(12)]
        sets = [np.unique(x) for x in sets]
        odd = neardup.parities(np.repeat(np.arange(12), [len(x) for x in sets]), np.concatenate(sets), 12)
        for i in range(12):
            for j in range(12):
                assert int(np.bitwise_count((odd[i] ^ odd[j]).view(np.uint64)).sum()) <= len(np.setxor1d(sets[i], sets[j]))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((25, 384))
    m = np.concatenate([c + 0.25 * rng.standard_normal((12, 384)) for c in centres] + [rng.standard_normal((100, 384))]).astype(np.float32)
    m[5] = m[4] * 2
    rows = [(f"v{i:03}", v.tolist(), "x") for i, v in enumerate(m)] + [("bad1", None, "x"), ("bad2", [0.0] * 384, "x"), ("bad3", [1.0] * 3, "x"), ("bad4", [float("nan")] * 384, "x"), ("v000", m[0].tolist(), "x")]
    rows += [(f"same{i}", m[7].tolist(), "x") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, class string")
    found = knn.nearest(df, "id", "vector")
    got = {tuple(r) for r in knn.pairs(found).collect()}
    good = {r[0]: np.array(r[1], np.float64) for r in rows if not r[0].startswith("bad")}
    ids = sorted(good)
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    sims = np.round(u @ u.T, 6)
    want = set()
    for k, i in enumerate(ids):
        best = sorted((-sims[k, j], ids[j]) for j in range(len(ids)) if j != k and sims[k, j] >= 0.8)[:5]
        want |= {(min(i, j), max(i, j)) for _, j in best}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert knn.nearest(df.where("false"), "id", "vector").count() == 0


def test_recall_on_the_test_vectors(spark, small):
    df = spark.read.parquet(f"{small}/indexed_chunks.parquet")
    got = {tuple(r) for r in knn.pairs(knn.nearest(df, "id", "vector")).collect()}
    rows = [(r.id, np.array(r.vector, np.float64)) for r in df.collect() if r.vector is not None and len(r.vector) == 384 and np.isfinite(r.vector).all() and any(r.vector)]
    rows.sort(key=lambda r: r[0])
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    sims = np.round(u @ u.T, 6)
    want = set()
    for k, (i, _) in enumerate(rows):
        best = sorted((-sims[k, j], rows[j][0]) for j in range(len(rows)) if j != k and sims[k, j] >= 0.8)[:5]
        want |= {(min(i, j), max(i, j)) for _, j in best}
    assert len(got & want) >= 0.9 * len(want)


def test_names(spark):
    rows = [
        ("1", "Edward Bipaverik", "PERSON", "{}"), ("2", "BIPAVERIK Ted", "PERSON", "{}"), ("3", "Bipavverik, E.L.", "PERSON", "{}"), ("4", "Dorothea G. Bipaverik", "PERSON", "{}"), ("5", "Prof. Dot Bipaverik", "PERSON", "{}"),
        ("6", "Daniel Fisehalar", "PERSON", '{"city": "A"}'), ("7", "Daniela Fisehalar", "PERSON", '{"city": "B"}'), ("8", "D. Fisehalar", "PERSON", '{"city": "B"}'), ("9", "D. Fisehalar", "PERSON", "{}"),
        ("a", "Nanepitik Foundation for Open Archives", "ORGANIZATION", "{}"), ("b", "Nanepitik FOA", "ORGANIZATION", "{}"), ("c", "THE NANEPITK FOUNDATION FOR OPEN ARCHIVES", "ORGANIZATION", None), ("d", "Foundation for Open Archives, Nanepitik", "ORGANIZATION", "{}"),
        ("e", "Nanepitik R&D Co.", "ORGANIZATION", "{}"), ("f", "Nanepitik Research and Development Company", "ORGANIZATION", "{}"), ("g", None, "PERSON", "{}"), ("h", "  ", "PERSON", "{}"), ("i", "Edward Bipaverik", "CONCEPT", "{}"), ("1", "Edward Bipaverik", "PERSON", "{}"),
    ]
    df = spark.createDataFrame(rows, "id string, label string, node_type string, properties_json string").selectExpr("*", "'x' AS name", "'y' AS city")
    got = {tuple(r) for r in names.linked(df).collect()}
    want = {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("7", "8"), ("e", "f")} | {(x, y) for x in "abcd" for y in "abcd" if x < y}
    assert got == want
    assert names.linked(df.where("false")).count() == 0


def test_nicknames_acronyms_and_mentions(spark):
    rows = [("1", "Anthony Smith", "PERSON", "{}"), ("2", "Tony Smith", "PERSON", "{}"), ("3", "Acme FOADRST", "ORGANIZATION", "{}"), ("4", "Acme Foundation of Old Arts, Design, Rugs, Song and Toys", "ORGANIZATION", "{}"), ("5", "Jones, P.", "PERSON", "{}"), ("6", "P. Jones", "PERSON", "{}"), ("7", "P. Q. Jones", "PERSON", "{}"), ("8", "P. R. Jones", "PERSON", "{}")]
    nodes = spark.createDataFrame(rows, "id string, label string, node_type string, properties_json string")
    got = {tuple(r) for r in names.linked(nodes).collect()}
    assert ("1", "2") in got and ("3", "4") in got and ("7", "8") not in got and {tuple(r) for r in names.linked(nodes.where("id IN ('5', '6')")).collect()} == {("5", "6")}
    assert {tuple(r) for r in names.linked(nodes, part=1).collect()} == got
    mentions = spark.createDataFrame([("m1", "SMITH, Tony", "tony smith x", "PERSON"), ("m2", None, "Anthony Smith", "PERSON"), ("m3", "Tony Smith", None, "PERSON"), ("m3", "Tony Smith", None, "PERSON"), ("m4", "Nobody Here", "Nobody", "PERSON"), (None, "Tony Smith", None, "PERSON")], "id string, text string, normalized string, label string")
    found = {r.entity_id: r.identity for r in names.identify_mentions(nodes, mentions).collect()}
    assert set(found) == {"m1", "m2", "m3"} and len(set(found.values())) == 1


def test_name_parts():
    assert names.person("Dr. José M. Núñez's") == ("nunez", ["jose"], "j", "m") and names.person("NUÑEZ José") == ("nunez", ["jose"], "j", None)
    assert names.person("Núñez, J.M.") == ("nunez", [], "j", "m") and names.person("Madonna") == ("madonna", [], None, None)
    assert names.organisation("The Acme Logistik GmbH")[:2] == ("acme", "logistics")


def test_every_query_runs(spark, small):
    for name in ("p1_found", "p2_pieces", "p3_found", "p4_identities", "p5_groups", "p7_usage", "p8_clean", "p9_rates"):
        assert queries.QUERIES[name](spark, small).count() > 0, name


def test_many_cells_and_split_shards_keep_the_recall(spark, small):
    df = spark.read.parquet(f"{small}/../sf0.01/indexed_chunks.parquet")
    one = {tuple(r) for r in knn.pairs(knn.nearest(df, "id", "vector")).collect()}
    many = {tuple(r) for r in knn.pairs(knn.nearest(df, "id", "vector", probes=6, shard=20, pivots=4)).collect()}
    assert len(one & many) >= 0.9 * len(one)


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    v = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.1], [-3, 0]], np.float32)
    got = knn.prune(v, np.array([0]), np.array([[1, 2, 3, 4, 5, 0, -1, 1]]), 4, 1.2)
    assert got.tolist() == [[1, 3, 5, -1]]
