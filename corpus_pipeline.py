"""A training corpus from `documents`: toxicity, quality, near duplicates, the mix of sources, token ids.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Each is
judged on what the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm import mixing, ngram_join, quality, sentencepiece_ids, toxicity
from jobmill.llm.common import written


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with `row`, a number of each row's own in the order of doc_id, null last: doc_id itself unless it is null or repeats somewhere."""
    ids = docs.select(F.col("doc_id").cast("long").alias("row"))
    if ids.count() == ids.filter("row is not null").distinct().count():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return written(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's threshold."""
    model, thresholds = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, thresholds).filter(~F.col("toxic")).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer takes for good."""
    return quality.scored(docs, quality.fit(docs)).filter("good").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more connect: the one with the smallest doc_id.

    Documents without words link with nothing and stay, as do rows without a doc_id. Rows that repeat a doc_id are documents of their own.
    """
    rows = told_apart(docs)
    groups = ngram_join.ngram_links(rows.select(F.col("row").alias("doc_id"), "text"), words=5, num=4, den=5)
    copies = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("row"))
    kept = rows.filter("doc_id is not null").join(copies.hint("shuffle_hash"), "row", "left_anti").select(*docs.columns)
    return kept.union(rows.filter("doc_id is null").select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: rows taken twice or thrice repeat, rows not taken go."""
    rows = told_apart(docs)
    copies = written(mixing.mixed(rows, key="row").filter("copies > 0").select("row", "copies"), "mix-copies")
    joined = rows.join(copies.hint("shuffle_hash"), "row").select(*docs.columns, "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, same): the token ids of each text and whether they decode to it."""
    coded = sentencepiece_ids.sentencepiece_round_trip(docs, keep=("doc_id", "lang", "source"), compare=True)
    n = F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)")
    return coded.select("doc_id", "lang", "source", n.alias("n_tokens"), "ids", "same")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("token ids", encode),
]

#: Training and sampling are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of `documents`; each stage's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
