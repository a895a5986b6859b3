import re
from collections import Counter

import corpus_pipeline
from jobmill.llm import mixing
from pyspark.sql import functions as F

from .conftest import hard_rows, prose
from .test_models import brute


def test_stages_keep_the_columns(spark, hard, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
        last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert last.count() == table.count()
    assert len(hard_rows()) == docs.count()


def test_near_duplicate_stage_equals_brute_force(spark):
    rows = []
    for g in range(15):
        base = prose(g, 80).split()
        for k in range(4):
            copy = list(base)
            if k:
                copy[k * 7] = "other"
            if k == 3:
                copy = copy[:40] + prose(1000 + g, 40).split()
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    wanted = sorted({component for _, _, component in brute([r[:2] for r in rows], 5, 4, 5)})
    assert kept == wanted
    again = docs.union(docs.filter("doc_id = 0"))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, again, "").collect()) == wanted


def test_rows_without_or_with_the_same_id_are_kept(spark):
    a, b, c = prose(1, 90), prose(2, 70), prose(3, 50)
    texts = [(1, a), (1, b), (1, a), (None, a), (None, c), (None, c), (2, a + " tail"), (3, ""), (3, ""), (4, b), (5, prose(5, 30)), (5, prose(6, 30))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    counted = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    wanted = Counter(texts) - Counter([(1, a), (2, a + " tail"), (4, b)])
    assert counted(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == wanted
    # One source: its target is its size, so the mix takes every row with words once.
    assert counted(corpus_pipeline.mix_sources(spark, docs, "")) == Counter(texts)
    more = docs.union(spark.createDataFrame([(k % 7 if k % 3 else None, prose(50 + k, 20 + k), "en", "tu"[k % 2], 1) for k in range(80)], schema))
    # Rows differ in source and size here, so the mix tells how often each is there.
    sized = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    taken = mixing.mixed(corpus_pipeline.told_apart(more), key="row").filter("copies > 0")
    want: Counter = Counter()
    for r in taken.collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = corpus_pipeline.mix_sources(spark, more, "").select("doc_id", "source", sized.alias("size"))
    assert Counter(tuple(r) for r in got.collect()) == want and any(i is None for i, _, _ in want)


def test_run_takes_words_near_the_targets(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.filter(~F.col("same")).count() == 0
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert rows and all(r.n <= 3 and r.doc_id in docs for r in rows)
    words = sum(r.n * len(re.findall(r"\S+", docs[r.doc_id].text)) for r in rows)
    assert words > 0


def test_toxicity_stage_learns_from_every_labelled_row(spark, tmp_path):
    """A word that only rows beyond the first 8,000 by the hash of doc_id have: held-out documents with it go, all others stay."""
    ids = spark.range(12_000).select("id", F.xxhash64("id").alias("draw"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out")).collect()
    late = {r.id for r in sorted((r for r in ids if not r.held_out), key=lambda r: r.draw)[8000:]} | {r.id for r in ids if r.held_out}
    toxic = {k for k in late if k % 3 == 0}
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(12_000)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(k, f"plain words {k % 7}" + " lumpix" * (k in toxic), "en", "s") for k in range(12_000)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    held_out = {r.id for r in ids if r.held_out}
    assert len(held_out & toxic) > 500 and kept & held_out == held_out - toxic
