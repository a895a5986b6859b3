"""Token ids, media, licenses and chat formatting against the libraries, brute force and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmill.llm import licenses, media, preferences, sentencepiece_ids, token_files

from .conftest import hard_rows, prose


def test_sentencepiece_equals_the_library(hard, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_ids.MODEL))
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in sentencepiece_ids.sentencepiece_round_trip(hard).collect())
    wanted = Counter()
    for row in hard_rows():
        ids = sp.encode(row[1] or "", add_bos=True, add_eos=True)
        wanted[row[0], np.array(ids, "<u4").tobytes(), sp.decode(ids)] += 1
    assert got == wanted
    assert sentencepiece_ids.digests(sentencepiece_ids.sentencepiece_round_trip(nothing)).count() == 0


def test_token_files_equal_the_library(spark, hard, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(hard, path=path)
    rows = token_files.read_token_files(spark.newSession(), path).collect()  # from the folder alone
    got = Counter((r.doc_id, bytes(r.ids)) for r in rows)
    wanted = Counter((row[0], np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for row in hard_rows())
    assert got == wanted
    place = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_blocks_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = token_files.encode_block(ranks)
    assert (token_files.decode_block(control, data, len(ranks)) == ranks).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .,'\n\t\r 　\u0085 é日\U0001f642sx-", max_size=30))
def test_chunks_never_part_a_token(text):
    from tokenizers import Tokenizer

    tokenizer = test_chunks_never_part_a_token.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = token_files.chunk_starts(data, np.array([0, len(data)]), False)
    raw = text.encode()
    chunks = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=False)]
    assert [i for c in chunks for i in tokenizer.encode(c, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_media_round_trip(hard, nothing, tmp_path):
    rows = media.media_columns(hard, f"file://{tmp_path}/media").collect()
    wanted = Counter()
    for row in hard_rows():
        raw = (row[1] or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        wanted[row[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == wanted
    for r in rows:
        stored = (tmp_path / "media" / r.shard).read_bytes()[r.offset : r.offset + r.length]
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes and r.digest == r.payload_sha256
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media_columns(nothing).count() == 0


def test_licenses_equal_sql(spark, hard, nothing):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [(k, r[1]) for k, r in enumerate(hard_rows())]
    con.executemany("insert into documents values (?, ?)", rows)
    mine = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    theirs = con.execute(licenses.ORACLE)
    names = [d[0] for d in theirs.description]
    assert sorted(tuple(r[n] for n in names) for r in mine.collect()) == sorted(theirs.fetchall())
    found = {r.doc_id: r for r in licenses.license_scan(hard).collect()}
    assert (found[11].n_base, found[11].first_word, found[11].last_word, found[11].base_labels) == (3, 3, 10, "apache,gpl,mit")
    assert (found[1].n_words, found[1].first_word, found[1].labels, found[1].score) == (0, None, "", 0.0)
    assert licenses.license_scan(nothing).count() == 0


def test_overlapping_phrases(spark):
    rows = spark.createDataFrame([(1, "mit license mit license; x cc by"), (2, "amit license")], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word) for r in licenses.license_scan(rows).collect()}
    assert got == {1: (3, 0, 5), 2: (0, None, None)}


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"),
        (1, "chosen", 1, "assistant", "zz"), (2, "chosen", 0, "user", None), (None, "chosen", None, None, "x"), (None, "rejected", None, None, "x"), (3, "other", 0, "user", "?"),
    ]
    rows = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumnRenamed("role", "role")
    got = preferences.preference_segments(rows)
    parts = {(r.pair_id, r.part, r.turn): (r.segment, r.segment[r.mask_from : r.mask_to]) for r in got.collect()}
    assert parts == {
        (1, "prompt", 0): ("<|user|>\nhi<|end|>\n", ""),
        (1, "chosen", 1): ("<|assistant|>\ngood<|end|>\n", "good<|end|>"),
        (1, "rejected", 1): ("<|assistant|>\nbad<|end|>\n", "bad<|end|>"),
        (2, "chosen", 0): ("<|user|>\n<|end|>\n", ""),
        (None, "prompt", -1): ("<||>\nx<|end|>\n", ""),
    }
    clash = rows.selectExpr("*", "'x' as prompt", "1 as piece", "2 as cut", "'p' as part", "'c' as chosen", "0 as mask_from")
    whole = {(r.pair_id, r.piece): (r.prompt, r.chosen, r.rejected) for r in preferences.preference_pairs(clash).collect()}
    assert whole == {
        (1, 0): ("<|user|>\nhi<|end|>\n", "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n"),
        (2, 0): ("", "<|user|>\n<|end|>\n", ""),
        (None, -1): ("<||>\nx<|end|>\n", "", ""),
    }
    assert preferences.preference_segments(rows.filter("false")).count() == 0


def test_masks_of_long_pairs(spark):
    """Pairs of more turns than a row holds, rendered turn by turn in plain Python."""
    n, cut = 3 * preferences.PIECE + 5, preferences.PIECE + 7
    turns = []
    for side in ("chosen", "rejected"):
        turns += [(7, side, k, ("user", "assistant")[k % 2], f"{side if k >= cut else 'same'} {k}") for k in range(n - (side == "rejected"))]
    got = {r.piece: r for r in preferences.preference_pairs(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").repartition(5)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for piece, row in got.items():
        said, trained = {"prompt": "", "chosen": "", "rejected": ""}, {"chosen": [], "rejected": []}
        for _, side, k, role, text in sorted(turns, key=lambda t: t[2]):
            part = side if k >= cut else "prompt"
            if k // preferences.PIECE == piece and (part != "prompt" or side == "chosen"):
                said[part] += f"<|{role}|>\n{text}<|end|>\n"
                if part != "prompt" and role == "assistant":
                    trained[part].append(f"{text}<|end|>")
        assert {k: row[k] for k in said} == said
        assert {k: [row[k][m["from"] : m["to"]] for m in row[f"{k}_mask"]] for k in trained} == trained


NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "mpl": "# This Source Code Form is subject to the terms of the\n# Mozilla Public License, v. 2.0. If a copy",
    "cc0": "To the extent possible under law, the author\nhas waived all copyright and related or\nneighboring rights to\nthis work",
}


def brute_runs(text: str) -> dict[str, float]:
    """The best share of each label's templates in a line or a run of as many words."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    words, num, den, out = cut(text), *licenses.THRESHOLD, {}
    for label, template in licenses.TEMPLATES:
        whole, n = set(template.split()), len(template.split())
        blocks = [cut(line) for line in text.split("\n")] + [words[i : i + n] for i in range(len(words))]
        names = whole if len(whole) <= licenses.SHORT else whole & set(licenses.NAMES)
        best = max((len(whole & set(b)) for b in blocks if names <= set(b)), default=0)
        if best and den * best >= num * len(whole):
            out[label] = max(out.get(label, 0), best / len(whole))
    return out


def test_wrapped_notices_are_found(spark):
    r = random.Random(3)
    texts = [f"some words before\n{notice}\nand after" for notice in NOTICES.values()]
    texts += [t.replace("\n", " ") for t in texts] + [f"Permission\n{prose(7, 40)}\nis hereby granted free of charge {prose(8, 40)}\nto any person"]
    for _ in range(60):  # notices with words lost, put in and wrapped anywhere
        words = [w for _, t in r.sample(licenses.TEMPLATES, 2) for w in t.split() if r.random() > 0.1 for w in ([w, "zz"] if r.random() < 0.1 else [w])]
        texts.append("".join(w + r.choice("  \n") for w in words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = F.col("doc_id").alias("key")
    blocks = rows.select(key, F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    got = {(x.key, x.label): x.score for x in licenses.template_matches(blocks, texts=rows.select(key, "text")).collect()}
    assert got == {(k, label): score for k, t in enumerate(texts) for label, score in brute_runs(t).items()}
    labels = {x.doc_id: x.labels.split(",") for x in licenses.license_scan(rows).collect()}
    for k, label in enumerate(NOTICES):
        assert label in labels[k] and label in labels[k + len(NOTICES)]
    assert labels[2 * len(NOTICES)] == [""]


def test_one_license_is_not_taken_for_another(spark):
    lines = [(text, {label}) for label, text in licenses.TEMPLATES] + [
        ("Released under the Apache License", set()),
        ("Licensed under CC BY 4.0", set()),
        ("Licensed under CC BY-NC 4.0", {"cc-by-nc"}),
        ("Licensed under the MIT License, Version 2.0", set()),
        ("This work is licensed under the GNU General Public License, version 2", set()),
        ("This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0", set()),
        ("Redistribution and use in source and binary forms, with or without changes, are permitted", {"bsd"}),
    ]
    wrapped = [(text.replace(" under", "\nunder").replace(" the ", "\nthe "), label) for text, label in lines]
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(lines + wrapped)], "key long, text string")
    blocks = rows.select("key", F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    got: dict[int, set] = {k: set() for k in range(2 * len(lines))}
    for x in licenses.template_matches(blocks, texts=rows).collect():
        got[x.key].add(x.label)
    assert got == {k: labels for k, (_, labels) in enumerate(lines + wrapped)}


@pytest.mark.parametrize("name", ["op3_preference_formatting", "op7_license_scan", "op1_ngram_jaccard_join"])
def test_registered_sql(spark, name):
    from jobmill.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    mine = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    theirs = con.execute(registry.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted((tuple(r[n] for n in names) for r in mine.collect()), key=key) == sorted(theirs.fetchall(), key=key)
