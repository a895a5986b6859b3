"""Feedback, the ranker and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import STATUS_WEIGHTS
from ..operators import learning, score
from ..sources import domain
from ..sources.domain import AS_OF, at
from .registry import literal, query, values
from .views import APPLICATION, EVENT, FAVOURITE, with_


def six(c: str) -> str:
    return f"floor({c} * 1000000 + 0.5) / 1000000"


def rounded(c):
    return F.floor(c * 1_000_000 + 0.5) / 1_000_000


def _signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = domain.feedback_events(spark, sf)
    judged = F.when(F.col("kind") == "view", F.when(F.col("event_id") % 10 != 0, F.least(F.lit(1.0), F.col("value") / 100)))
    feedback = ev.filter("kind in ('error', 'view')").select("user_id", "job_id", F.when(F.col("kind") == "error", "DISMISSED").otherwise("MODEL_JUDGED").alias("signal"), judged.alias("score"))
    return domain.favourites(spark, sf), domain.applications(spark, sf), feedback


_WEIGHT = "CASE status " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in STATUS_WEIGHTS.items()) + " ELSE 1.0 END"
LABELS = (
    with_(EVENT, FAVOURITE, APPLICATION)
    + f""", signals AS (
  SELECT user_id, job_id, 1.0::DOUBLE AS label, 1.0::DOUBLE AS weight, 0 AS kind FROM fav
  UNION ALL SELECT user_id, job_id, 1.0, {_WEIGHT}, 1 FROM app WHERE job_id IS NOT NULL
  UNION ALL SELECT user_id, job_id, 0.0, 1.5, 2 FROM ev WHERE kind = 'error'
  UNION ALL SELECT user_id, job_id, least(1.0, value / 100), 0.5, 2 FROM ev WHERE kind = 'view' AND event_id % 10 <> 0),
labels AS (SELECT user_id, job_id, label, weight FROM signals QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY weight DESC, kind, label DESC) = 1)
"""
)


@query("a9_fused_labels", LABELS + "SELECT user_id, job_id, label, weight FROM labels")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return learning.labels(*_signals(spark, sf))


@query(
    "r13_r22_trainable_users",
    LABELS + "SELECT user_id, count(*) AS samples, count(*) FILTER (label >= 0.5) AS positives, count(*) >= 8 AND count(*) FILTER (label >= 0.5) >= 3 AND count(*) FILTER (label < 0.5) >= 3 AS trainable FROM labels GROUP BY user_id",
)
def r13(spark: SparkSession, sf: str) -> DataFrame:
    return learning.trainable(learning.labels(*_signals(spark, sf)))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled jobs with the features of a search by profile."""
    profile = score.Profile(titles=["React developer"], skills=["React", "SQL"])
    request = score.Request("React developer", at(AS_OF), profile=profile)
    jobs = score.scored(domain.job_postings(spark, sf), request).select(F.col("id").alias("job_id"), "features")
    return learning.labels(*_signals(spark, sf)).join(jobs, "job_id")


@query("r14_r18_trained_rankers")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """A ranker for every user with enough feedback; tested against planted preferences."""
    return learning.rankers(_samples(spark, sf))


@query(
    "a10_feature_statistics",
    f"SELECT CAST(i AS INT) AS place, {six('avg(v)')} AS mean, {six('greatest(1e-6, stddev_pop(v))')} AS std FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY i",
)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    out = learning.feature_stats(domain.read(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features")), 64)
    return out.select("place", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query(
    "r11_profile_similarity",
    f"SELECT e.vec_id, {six('greatest(0.0, list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]))')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p",
)
def r11(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    profile = rows.filter("vec_id = 0").agg(F.first("v").alias("p"))  # one row
    return rows.join(F.broadcast(profile)).select("vec_id", rounded(F.greatest(F.lit(0.0), learning.cosine(F.col("v"), F.col("p")))).alias("similarity"))


@query(
    "a14_centroids",
    f"SELECT label, list({six('m')} ORDER BY i) AS centroid FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    out = learning.centroid(domain.read(spark, sf, "embeddings"), ["label"], "embedding")
    return out.select("label", F.transform("centroid", rounded).alias("centroid"))


@query(
    "a15_t10_guard_threshold",
    f"""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
flat AS (SELECT label, vec_id, unnest(e) AS x, unnest(range(0, len(e))) AS i FROM v),
sums AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM flat GROUP BY label, i),
loo AS (SELECT f.label, f.vec_id, n, list(f.x ORDER BY f.i) AS e, list((s - x) / (n - 1) ORDER BY f.i) AS c FROM flat f JOIN sums USING (label, i) WHERE n > 1 GROUP BY f.label, f.vec_id, n),
mean AS (SELECT label, n, avg(list_cosine_similarity(e, c)) AS m FROM loo GROUP BY label, n)
SELECT label, n, {six('least(0.85, greatest(0.5, m - 0.08 - CASE WHEN n < 10 THEN 0.05 ELSE 0 END))')} AS threshold FROM mean""",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    out = learning.guard_threshold(domain.read(spark, sf, "embeddings"), ["label"], "embedding")
    return out.select("label", "n", rounded(F.col("threshold")).alias("threshold"))


MODEL = {
    "mean": [0.1, -0.2, 0.0, 0.3],
    "std": [1.0, 0.5, 2.0, 1.5],
    "hidden": [[0.4, -0.3, 0.2, 0.1], [-0.5, 0.25, 0.1, -0.2]],
    "bias": [0.05, -0.1],
    "out": [0.7, -0.6],
    "shift": 0.2,
}


@query(
    "r15_r16_r17_blended_scores",
    f"""WITH z AS (SELECT vec_id, label, [(embedding[1]::DOUBLE - 0.1::DOUBLE) / 1.0, (embedding[2]::DOUBLE + 0.2::DOUBLE) / 0.5::DOUBLE, embedding[3]::DOUBLE / 2.0::DOUBLE, (embedding[4]::DOUBLE - 0.3::DOUBLE) / 1.5::DOUBLE] AS z FROM embeddings),
h AS (SELECT vec_id, label, tanh(0.4 * z[1] - 0.3 * z[2] + 0.2 * z[3] + 0.1 * z[4] + 0.05) AS a, tanh(-0.5 * z[1] + 0.25 * z[2] + 0.1 * z[3] - 0.2 * z[4] - 0.1) AS b FROM z),
f AS (SELECT vec_id, label, 1 / (1 + exp(-(0.7 * a - 0.6 * b + 0.2))) AS fit, (label / 10.0)::DOUBLE AS score FROM h),
m AS (SELECT *, score * 0.7 + fit * 0.3 AS mixed FROM f)
SELECT vec_id, {six('fit')} AS fit, floor(mixed * 1000 + 0.5) / 1000 AS blended,
  CASE WHEN abs(floor((mixed - score) * 100 + 0.5)) >= 2 THEN 'Learned from your feedback (' || CASE WHEN mixed > score THEN '+' ELSE '' END || CAST(floor((mixed - score) * 100 + 0.5) AS BIGINT) || ' %)' END AS reason FROM m""",
)
def r15(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed model of four features, 60 samples behind it."""
    d = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    model = F.struct(d(MODEL["mean"]).alias("mean"), d(MODEL["std"]).alias("std"), F.array(*map(d, MODEL["hidden"])).alias("hidden"), d(MODEL["bias"]).alias("bias"), d(MODEL["out"]).alias("out"), F.lit(MODEL["shift"]).alias("shift"))
    rows = domain.read(spark, sf, "embeddings").select("vec_id", (F.col("label") / 10.0).alias("score"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("features"))
    rows = rows.withColumn("fit", learning.predicted(F.col("features"), model))
    mixed, reason = learning.blended(F.col("score"), F.col("fit"), F.lit(60))
    return rows.select("vec_id", rounded(F.col("fit")).alias("fit"), mixed.alias("blended"), reason.alias("reason"))


_PART_TEXT = "substring(p_name || chr(10) || p_brand || chr(10) || p_type, 1, 1500)"


def _missing_texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = domain.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.substring(F.concat_ws("\n", "p_name", "p_brand", "p_type"), 1, 1500).alias("text"))
    cache = parts.select("id", F.when(F.col("id") % 4 == 0, "model-a").otherwise("model-b").alias("model"))
    return learning.missing_vectors(parts, cache, "model-a")


@query("r12_embedding_text", f"SELECT p_partkey AS id, md5({_PART_TEXT}) AS digest FROM part WHERE p_partkey % 4 <> 0")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    """Texts still to be embedded: those that the cache of this model (every fourth part) lacks."""
    return _missing_texts(spark, sf).select("id", F.md5("text").alias("digest"))


@query("r12_embedded_texts", f"SELECT p_partkey AS id, [CAST(length({_PART_TEXT}) AS DOUBLE), CAST(len(string_split({_PART_TEXT}, ' ')) AS DOUBLE)] AS vector FROM part WHERE p_partkey % 4 <> 0")
def r12_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the missing texts, sixteen to a call, of a stand-in model that counts characters and words."""
    return learning.embedded(_missing_texts(spark, sf), lambda texts: [[len(t), len(t.split(" "))] for t in texts])


@query(
    "r20_merged_profiles",
    values("id INT, titles VARCHAR, skills VARCHAR, level VARCHAR", [(1, "Data engineer", "React,SQL,Spark", "senior"), (2, "Tester", "Jest", "mid")]),
)
def r20(spark: SparkSession, sf: str) -> DataFrame:
    """A model's profile over a heuristic one: its titles and level where it has any, skills of both."""
    rows = literal(spark, "id int, titles array<string>, skills array<string>, level string, m_titles array<string>, m_skills array<string>, m_level string", [(1, ["Frontend developer"], ["React", "SQL"], None, ["Data engineer", " Data engineer "], ["Spark", "SQL"], "senior"), (2, ["Tester"], ["Jest"], "mid", ["  "], [], None)])
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v != ""))
    theirs = clean("m_titles")
    return rows.select("id", F.array_join(F.when(F.size(theirs) > 0, F.slice(theirs, 1, 5)).otherwise(F.col("titles")), ",").alias("titles"), F.array_join(F.slice(clean(F.concat("skills", "m_skills")), 1, 40), ",").alias("skills"), F.coalesce("m_level", "level").alias("level"))
