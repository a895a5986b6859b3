"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line, or a run of as many words as the template has, whatever line breaks stand between them (notices are
often wrapped); its tokens are the distinct words in it. A template is found in a block when at least THRESHOLD of the
template's tokens are, and among them those that NAMES has; a template of up to SHORT tokens must be there whole, as any
of its words may tell licenses or their versions apart. Tokens of the templates are put in one order by how many blocks of all documents hold them, rare
ones first; a template then needs a token of its prefix (so many first tokens that the rest alone can't reach the
threshold) to be among the block's, so blocks and templates are joined on prefix tokens only. Pairs must pass the length
filter (enough template tokens in the block) and the positional filter (enough tokens behind the shared one on both
sides), and are verified on whole sets, once each. Runs are looked for only in texts that hold enough of a template's
tokens anywhere, and there only around words of its prefix.

Beside the join, fixed phrases give base labels wherever their words stand one after the other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = (4, 5)
#: Templates of so many tokens at most are found whole or not at all.
SHORT = 12
#: Words that name a license: a template that has one is not found without it.
NAMES = ("apache", "attribution", "cc", "creative", "gnu", "mit", "mozilla", "nc")


def _words(text: Column) -> Column:
    """The words of a text in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " "))


def _n_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(words: Column, n_words: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """struct(n_base, first_word, last_word, labels) of the places of the phrases among `words`."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    found = []
    for phrase, label in phrases:
        pieces = F.split(padded, f" {phrase}(?= )", -1)
        n = F.size(pieces) - 1
        # Each word of a piece follows a blank; the last piece has the blank of the padding too.
        last = n_words - (_blanks(F.element_at(pieces, -1)) - 1) - len(phrase.split())
        one = F.struct(n.cast("long").alias("n"), _blanks(pieces[0]).cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label"))
        found.append(F.when(F.contains(padded, F.lit(f" {phrase} ")), one))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.struct(
        F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform(hits, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(hits, lambda x: x["last"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))).alias("labels"),
    )


def _need(tokens: list[str], threshold: tuple[int, int]) -> int:
    """How many of a template's tokens a block must hold."""
    num, den = threshold
    return len(tokens) if len(tokens) <= SHORT else math.ceil(num * len(tokens) / den)


def template_matches(blocks: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD, texts: DataFrame | None = None) -> DataFrame:
    """(key, label, score) of the templates found in blocks (key, line), score the share of the template's tokens; the best one a key and label.

    With texts (key, text), runs of words over their line breaks count as blocks too. Only the template's own tokens are kept of a block, since no other can be shared; null and empty lines match nothing.
    """
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in templates]
    lengths = [len(text.split()) for _, text in templates]
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    literal = lambda tokens: F.array(*map(F.lit, tokens))
    kept = blocks.select("key", F.array_intersect(literal(vocabulary), F.split(_words(F.col("line")), " ")).alias("tokens")).filter(F.size("tokens") > 0)
    kept = written(kept, "license-blocks")
    # One row for each token of the templates, whatever the input.
    counts = {r["token"]: r["n"] for r in kept.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index, runs = [], []
    for k, (label, tokens) in enumerate(sets):
        need = _need(tokens, threshold)
        names = literal([t for t in tokens if t in NAMES]).cast("array<string>")
        tokens.sort(key=rank.__getitem__)
        prefix = literal(tokens[: len(tokens) - need + 1])
        runs.append(F.struct(F.lit(label).alias("label"), F.lit(lengths[k]).alias("length"), F.lit(need).alias("need"), prefix.alias("prefix"), literal(tokens).alias("whole"), names.alias("names")))
        for at, token in enumerate(tokens[: len(tokens) - need + 1]):
            index.append(F.struct(F.lit(token).alias("token"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(at).alias("at"), F.lit(need).alias("need"), literal(tokens).alias("whole"), names.alias("names")))
    prefixes = blocks.sparkSession.range(1).select(F.inline(F.array(*index)))
    least = min(_need(tokens, threshold) for _, tokens in sets)
    ordered = kept.filter(F.size("tokens") >= least).select("key", F.array_intersect(literal(order), F.col("tokens")).alias("tokens")).distinct()
    sides = ordered.select("key", "tokens", F.posexplode("tokens").alias("pos", "token"))
    size, whole = F.size("tokens"), F.size("whole")
    pairs = (
        sides.join(F.broadcast(prefixes), "token")  # the templates' prefixes
        .filter((size >= F.col("need")) & (F.col("pos") <= size - F.col("need")))
        .filter(1 + F.least(size - 1 - F.col("pos"), whole - 1 - F.col("at")) >= F.col("need"))
        .select("key", "tokens", "template", "label", "need", "whole", "names")
        .dropDuplicates(["key", "tokens", "template"])
    )
    overlap = F.size(F.array_intersect("tokens", "whole"))
    named = F.size(F.array_except("names", "tokens")) == 0
    found = pairs.filter((overlap >= F.col("need")) & named).select("key", "label", (overlap / whole).alias("score"))
    if texts is not None:
        found = found.union(_run_matches(texts, vocabulary, runs))
    return found.groupBy("key", "label").agg(F.max("score").alias("score"))


def _run_matches(texts: DataFrame, vocabulary: list[str], runs: list[Column]) -> DataFrame:
    """(key, label, score) of the templates, structs of (label, length, need, prefix, whole, names), found in runs of `length` words of texts (key, text)."""
    rows = texts.filter(F.contains("text", F.lit("\n"))).select("key", F.split(_words(F.col("text")), " ").alias("words"))
    rows = rows.withColumn("tokens", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("words")))
    # One row a text and template whose tokens it may hold close by.
    rows = rows.select("key", "words", F.inline(F.filter(F.array(*runs), lambda t: F.size(F.array_intersect(t["whole"], F.col("tokens"))) >= t["need"])))
    held = lambda start, n: F.array_intersect(F.slice("words", start, n), F.col("whole"))
    shared = lambda start, n: F.when(F.size(F.array_except("names", held(start, n))) == 0, F.size(held(start, n))).otherwise(0)
    first = lambda i: F.greatest(F.lit(1), i - F.col("length") + 1)
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("prefix", F.element_at("words", i)))
    near = F.filter(places, lambda i: shared(first(i), F.col("length") * 2 - 1) >= F.col("need"))
    best = F.array_max(F.transform(near, lambda i: F.array_max(F.transform(F.sequence(first(i), i), lambda start: shared(start, F.col("length"))))))
    rows = rows.select("key", "label", "need", "whole", best.alias("best"))
    return rows.filter(F.col("best") >= F.col("need")).select("key", "label", (F.col("best") / F.size("whole")).alias("score"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs (doc_id, text).

    Texts count whole; a null text is an empty one: no words, no labels, score 0. Base labels score 1, others the best
    share of a template's tokens in a line or run. What templates find is kept by a hash of the text, so copies share it and
    null or repeated doc_ids do no harm. An empty table gives no rows; more columns of docs are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("c"))
    blocks = docs.select(key.alias("key"), F.explode(F.split(F.translate(text, UPPER, LOWER), "\n")).alias("line"))
    found = template_matches(blocks, texts=docs.select(key.alias("key"), text.alias("text"))).groupBy("key").agg(F.collect_list("label").alias("more"), F.max("score").alias("best"))  # as many as templates at most
    rows = docs.select("doc_id", key.alias("key"), _words(text).alias("words")).withColumn("n_words", _n_words(F.col("words")))
    rows = rows.withColumn("base", phrase_places(F.col("words"), F.col("n_words"))).select("doc_id", "key", "n_words", "base.*")
    out = rows.join(found, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("labels", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    num, den = THRESHOLD
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{pattern}') AS w FROM t),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {phrases}) v(phrase, label)),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS place
  FROM w JOIN p ON list_has_all(w, p)),
base AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM hits GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t),
sets AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{pattern}')) AS s FROM lines),
tem AS (SELECT label, list_distinct(string_split(body, ' ')) AS s FROM (VALUES {templates}) v(k, label, body)),
found AS (
  SELECT doc_id, label, max(len(list_intersect(sets.s, tem.s)) / len(tem.s)) AS score
  FROM sets JOIN tem ON {den} * len(list_intersect(sets.s, tem.s)) >= {num} * len(tem.s) GROUP BY doc_id, label),
more AS (SELECT doc_id, list(label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
  array_to_string(coalesce(base.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.score, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE = _oracle()
