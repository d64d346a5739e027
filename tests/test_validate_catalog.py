import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.operators import catalog, validate


@pytest.mark.parametrize(
    ("ext", "size", "text", "reason"),
    [
        ("md", 5, "# hi", None), ("exe", 5, "x", "extension"), (None, 5, "x", "extension"), ("txt", 0, "", "size"), ("txt", 60 * 1024 * 1024, "x", "size"), ("txt", 5, "\x00\x01\x02\x03x", "readable"),
        ("md", 5, "<script>alert(1)</script>", "danger"), ("html", 5, "just words", "html"), ("html", 9, "<p>ok</p><script>x</script>", None), ("html", 9, "<a href='javascript:x'>", "danger"), ("md", 3, None, None),
    ],
)
def test_reject_reason(spark, ext, size, text, reason):
    df = spark.createDataFrame([(ext, size, text)], "file_extension string, file_size bigint, text string")
    good, bad = validate.split_valid(df)
    assert good.count() == (reason is None)
    assert [r.reject_reason for r in bad.collect()] == ([reason] if reason else [])


def test_safe_filenames(spark):
    df = spark.createDataFrame([("../../bad<name>.MD",), ("../notes.md",), ("a" * 300 + ".txt",)], "n string")
    got = [r[0] for r in df.select(validate.safe_filename(F.col("n"))).collect()]
    assert got == ["bad_name_.md", "notes.md", "a" * 200 + ".txt"]


def test_public_addresses(spark):
    urls = {"https://a.example/x": True, "ftp://a.example": False, "http://127.0.0.1/": False, "http://10.1.2.3/": False, "http://172.20.0.1/": False, "http://8.8.8.8/": True, "http://localhost:80/": False, "http://169.254.1.1/": False, "http://[::1]/": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert dict(map(tuple, df.select("u", validate.public_address(F.col("u"))).collect())) == urls


def docs(spark, rows):
    return spark.createDataFrame([(i, u, h, dt.datetime(2025, 1, day), dt.datetime(2025, 2, 1) if gone else None) for i, u, h, day, gone in rows], "doc_id bigint, user_id string, file_hash string, created_at timestamp, deleted_at timestamp")


def test_listing_is_newest_first_and_counts_null_owners_as_default(spark):
    df = docs(spark, [(1, None, "a", 1, False), (2, "local-dev", "b", 3, False), (3, "u", "c", 2, False), (4, None, "d", 4, True)])
    assert [r.doc_id for r in catalog.listing(df, "local-dev").collect()] == [2, 1]
    assert [r.doc_id for r in catalog.listing(df).collect()] == [2, 3, 1]


def test_upsert_clears_deletion_and_is_idempotent(spark):
    old, new = docs(spark, [(1, "u", "a", 1, True), (2, "u", "b", 1, False)]), docs(spark, [(9, "u", "a", 5, False)])
    once = catalog.upsert(old, new, ["user_id", "file_hash"])
    assert sorted((r.doc_id, r.deleted_at) for r in once.collect()) == [(2, None), (9, None)]
    assert sorted(r.doc_id for r in catalog.upsert(once, new, ["user_id", "file_hash"]).collect()) == [2, 9]


def test_fallback_ignores_sidecars_of_known_users(spark):
    db, side = docs(spark, [(1, "u", "a", 1, True)]), docs(spark, [(2, "u", "b", 1, False), (3, "w", "c", 1, False)])
    assert [r.doc_id for r in catalog.with_fallback(db, side).collect()] == [3]


def test_soft_delete_and_replacement(spark):
    df = docs(spark, [(1, "u", "a", 1, False), (2, "u", "b", 1, False)])
    assert [r.doc_id for r in catalog.listing(catalog.soft_delete(df, F.col("doc_id") == 1)).collect()] == [2]
    stored = spark.createDataFrame([("d1", "x"), ("d2", "y")], "document_id string, text string")
    fresh = spark.createDataFrame([("d1", "z")], "document_id string, text string")
    assert sorted(map(tuple, catalog.replace_documents(stored, fresh).collect())) == [("d1", "z"), ("d2", "y")]
