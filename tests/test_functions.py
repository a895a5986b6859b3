import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmill.functions import text as t


def test_folding_equals_decomposition(spark):
    letters = [chr(c) for c in range(0xC0, 0x250)]
    rows = spark.createDataFrame([(x,) for x in letters], "x string").select("x", t.fold_diacritics("x").alias("y")).collect()
    for r in rows:
        plain = "".join(c for c in unicodedata.normalize("NFD", r.x) if not 0x300 <= ord(c) <= 0x36F)
        assert r.y == (plain if len(plain) == 1 else r.x)


def test_canonical_url_is_a_fixpoint(spark):
    urls = ["https://A.cz/x?b=1&a=2&utm_x=3#f", "http://b.cz", "nonsense", "", None, "https://c.cz/?ref=1"]
    once = spark.createDataFrame([(u,) for u in urls], "u string").select(t.canonical_url("u").alias("u"))
    twice = once.select("u", t.canonical_url("u").alias("v")).collect()
    assert all(r.u == r.v for r in twice)


def test_null_and_empty_text(spark):
    row = spark.createDataFrame([(None, "")], "a string, b string").select(
        t.tokens("a").alias("tokens"), t.content_hash("a").alias("hash"), t.job_key("a", "b", "a").alias("key"), t.emails_in_text("a").alias("emails"),
        t.contact_email(F.array("a")).alias("email"), t.dedupe_half("a").alias("half"), t.html_text("a").alias("html"),
    ).first()
    assert (row.tokens, row.key, row.emails, row.email, row.half, row.html) == ([], "||", [], None, "", "")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=5))
def test_normalized_text_is_plain(spark, texts):
    rows = spark.createDataFrame([(x.replace("\x00", ""),) for x in texts], "x string").select(t.normalize_text("x").alias("y")).collect()
    for r in rows:
        assert all(c in "abcdefghijklmnopqrstuvwxyz0123456789 " for c in r.y) and r.y == r.y.strip()
