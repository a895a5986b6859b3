"""Near duplicates, mixing, nearest neighbours and the classifiers against brute force and planted cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmill.llm import hnsw, mixing, ngram_join, quality, toxicity

from .conftest import hard_rows, prose


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, num, den):
    """(doc_id, n, component) of rows (doc_id, text), by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[rows[k][0], len(sets[k]), min(ids) if ids else None] += 1
    return out


def near_copies(seed: int, groups: int = 12, each: int = 9):
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(1000 * seed + g, r.randint(12, 160)).split()
        for _ in range(each):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(["new", "word", "here"])
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("words,num,den,seed", [(3, 9, 10, 1), (5, 4, 5, 2)])
def test_components_equal_brute_force(spark, words, num, den, seed):
    rows = near_copies(seed)
    got = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string"), words, num, den)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, words, num, den)


def test_components_of_hard_rows(hard, nothing):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_links(hard).collect())
    assert got == brute([r[:2] for r in hard_rows()], 3, 9, 10)
    assert ngram_join.ngram_links(nothing).count() == 0


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 0)  # rounds to the end
    r, base = random.Random(3), prose(77, 120).split()
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(k % 5):
            copy[r.randrange(120)] = f"w{r.randrange(40)}"
        rows.append((k, " ".join(copy)))
    got = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows, 3, 9, 10)


def fill(sizes, weights=(1.0, 2.0, 3.0)):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while left > 1e-9 and open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            room = 3 * sizes[s] - target[s]
            target[s] += min(room, x)
            left += max(0.0, x - room)
        open_ = {s for s in open_ if target[s] < 3 * sizes[s] - 1e-9}
    return target


def test_mix_meets_its_targets(spark):
    r = random.Random(4)
    rows = [(k, prose(k, r.choice([1, 5, 40, 300])), r.choice(["a", "a", "a", "b", "c", None, "", "tiny"] if k % 40 else ["tiny"])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(7)).withColumn("copies", F.lit(9))
    got = mixing.mixed(docs, block=64).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets = fill(sizes)
    taken = Counter()
    for x in got:
        assert 0 <= x.copies <= 3 and x.source_size == sizes[x.source] and abs(x.target - targets[x.source]) < 1e-6
        taken[x.source] += x.copies * x.size
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(0.03 * target, 45), source
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed(docs, block=64).collect()))


def test_mix_of_hard_rows(hard, nothing):
    got = mixing.mixed(hard).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mixed(nothing).count() == 0


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(0)
    p, x = rng.random(400), rng.integers(1, 50, 400).astype(float)
    rows = [np.ones(400), x]
    out = mixing.flight(p, rows, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    for r in rows:
        assert abs(r @ p - r @ out) < 1e-6
    assert abs(np.mean([mixing.flight(np.full(5, 0.3), [np.ones(5)], np.random.default_rng(s)) for s in range(800)]) - 0.3) < 0.03


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    x[100:160] = x[0]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5100, [float("nan")] * 16), (5200, [None] + [1.0] * 15), (None, [1.0] * 16), (5300, []), (6000, [1.0, 2.0]), (6001, [1.0, 2.5]), (7, x[7].tolist())]
    data = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("dim", F.lit(2))
    out = defaultdict(list)
    for r in hnsw.search_index(hnsw.build_index(hnsw.usable(data), shard=1024), hnsw.usable(data).filter("vec_id % 100 = 0").dropDuplicates(["vec_id"])).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    d = x.astype(float)
    hits = total = 0
    for q in range(0, 3000, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(3000), dist))[:10]
        got = sorted(out[q])
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(dist[v] - s) < 1e-9 for _, v, s in got)
        assert [g[2] for g in got] == sorted(g[2] for g in got)
        hits += len({v for _, v, _ in got} & set(best.tolist()))
        total += 10
    assert hits / total >= 0.95
    assert [v for _, v, _ in sorted(out[0])] == list(range(100, 110))  # ties go to smaller ids
    assert out[6000] == [(1, 6001, 0.5)] and set(out) == {*range(0, 3000, 100), 6000}
    assert hnsw.nearest(data.filter("false"), 100).count() == 0


def clusters(r, sizes, spread):
    return np.concatenate([r.normal(size=64) * spread + r.normal(size=(n, 64)) * 0.05 for n in sizes])


@pytest.mark.parametrize(
    "sizes,spread,asked",
    [([1848, *[20] * 10], 1.0, slice(1848, None)), ([1848, *[20] * 10], 0.05, slice(1848, None)), ([256] * 8, 1.0, slice(0, None, 16)), ([32] * 64, 1.0, slice(0, None, 16)), ([2000], 0.0, slice(0, None, 16))],
)
def test_search_finds_points_of_tight_clusters(sizes, spread, asked):
    """Also of small clusters beside a large one: recall against brute force, of all queries and of the worst."""
    x = clusters(np.random.default_rng(len(sizes)), sizes, spread) + 1000.0
    single, queries = hnsw._single(x, x[asked])
    found = hnsw.search(single, hnsw.build(single), queries, 11)
    hits = []
    for row, q in zip(found.tolist(), np.arange(len(x))[asked], strict=True):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits.append(len(set(np.argsort(d, kind="stable")[:10].tolist()) & {v for v in row if v != q}) / 10)
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.5


def toxic_rows(n: int):
    r = random.Random(8)
    bad = {"en": ["vilest", "rotter"], "de": ["lumpix", "lumpox", "lumpum", "lumpar"]}
    rows, labels = [], []
    for k in range(n):
        lang = r.choice(["en", "de"])
        words = prose(k, r.randint(0, 60)).split()
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(bad[lang]))
        rows.append((k, " ".join(words), lang, "s"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model, thresholds = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model, thresholds).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    truth = {k: t for k, _, t in labels}
    assert len(got) > 200
    assert np.mean([(r.score >= 0.5) == bool(truth[k]) for k, r in got.items()]) > 0.95
    assert np.mean([r.toxic == bool(truth[k]) for k, r in got.items()]) > 0.95


def test_toxicity_of_hard_rows(hard, nothing, no_labels, spark):
    labels = spark.createDataFrame([(1, None, 1), (4, 0, 0), (None, 1, 1), (6, 1, 1), (6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for labelled in (labels, no_labels):
        model, thresholds = toxicity.fit(hard, labelled)
        out = toxicity.scored(hard, model, thresholds)
        assert out.count() == len(hard_rows()) and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.scored(nothing, *toxicity.fit(nothing, no_labels)).count() == 0


def test_gradients_are_those_of_the_loss():
    """Against finite differences of the loss, which is worked out from scratch, in double precision."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, (int(n), 2)).astype(np.int32) for n in rng.integers(1, 9, 12)]
    y = rng.integers(0, 2, 12).astype(float)
    size = len(toxicity.WIDTHS) * toxicity.FILTERS
    embedding = np.append(rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DIM)), np.zeros((1, toxicity.DIM)), axis=0)
    filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    model = toxicity.Model(embedding, filters, rng.normal(0, 0.2, size), rng.normal(0, 0.5, size), 0.3)

    def loss() -> float:
        total = 0.0
        for t, label in zip(texts, y, strict=True):
            words = [model.embedding[a] + model.embedding[b] for a, b in t] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
            pooled = [max(sum(words[i + o] @ w[o, :, f] for o in range(len(w))) for i in range(len(t))) for w in model.filters for f in range(toxicity.FILTERS)]
            z = float(np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.shift)
            total += np.log1p(np.exp(-z)) if label else np.log1p(np.exp(z))
        return total / len(texts)

    got = toxicity.gradients(model, texts, y)

    def slope(array, at) -> float:
        kept, out = array[at], []
        for step in (1e-5, -1e-5):
            array[at] = kept + step
            out.append(loss())
        array[at] = kept
        return (out[0] - out[1]) / 2e-5

    for k, w in enumerate(model.filters):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)]:
            assert abs(slope(w, at) - got.filters[k][at]) < 1e-6
    for row in rng.choice(len(got.words), 6, replace=False):
        if got.words[row] < toxicity.BUCKETS:
            assert abs(slope(model.embedding, (got.words[row], 3)) - got.embedding[row, 3]) < 1e-6
    for k in rng.integers(0, size, 5):
        assert abs(slope(model.out, k) - got.out[k]) < 1e-6 and abs(slope(model.bias, k) - got.bias[k]) < 1e-6
    model.shift += 1e-5
    up = loss()
    model.shift -= 2e-5
    assert abs((up - loss()) / 2e-5 - got.shift[0]) < 1e-6


def test_one_huge_text_takes_no_others_from_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 1000)
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 60_000)
    rows, labels = toxic_rows(600)
    rows += [(10_000 + k, "word " * 1500, "en", "s") for k in range(60)]
    labels += [(10_000 + k, 1, 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model, thresholds = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    truth = {k: t for k, _, t in labels}
    got = toxicity.scored(docs, model, thresholds).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got]) > 0.9


def test_toxicity_is_learnt_from_every_labelled_row(spark):
    """Also from those that come last by the hash of doc_id, beyond 8,000: only they have the word."""
    ids = spark.range(12_000).select("id", F.xxhash64("id").alias("draw"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out")).collect()
    learnt = sorted((r for r in ids if not r.held_out), key=lambda r: r.draw)
    late = {r.id for r in learnt[8000:]} | {r.id for r in ids if r.held_out}
    with_word = {k for k in late if k % 3 == 0}
    rows = [(k, f"{prose(k, 3)} lumpix" if k in with_word else prose(k, 4), "en", "s") for k in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1, int(k in with_word)) for k in range(12_000)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, *toxicity.fit(docs, labels)).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id in with_word) for r in got]) > 0.95


def test_toxicity_over_several_shards_and_runs(spark, monkeypatch):
    """Texts longer than LONGEST are learnt from; shards are learnt in several runs, averaged, and reruns agree."""
    for name, value in (("SHARD", 500), ("SAMPLE_WORDS", 9_000), ("LONGEST", 20)):
        monkeypatch.setattr(toxicity, name, value)
    rows, labels = toxic_rows(2500)
    docs = spark.createDataFrame([(k, "plain " * 20 + text, lang, s) for k, text, lang, s in rows], "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first, again = toxicity.fit(docs, marks), toxicity.fit(docs.repartition(3, "text"), marks.repartition(2))
    assert first[1] == again[1] and np.array_equal(first[0].embedding, again[0].embedding)
    got = toxicity.scored(docs, *first).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    truth = {k: t for k, _, t in labels}
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got]) > 0.9


def test_toxicity_moves_texts_once_and_drops_sums(spark, monkeypatch):
    """Labelled texts go through one exchange, and each round's sums leave the disk before the next."""
    written, plans, names, held = toxicity.Scratch.written, {}, [], []

    def spied(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        names.append(name)
        held.append(len(self.paths))
        return written(self, df, name)

    monkeypatch.setattr(toxicity, "SHARD", 100)
    monkeypatch.setattr(toxicity.Scratch, "written", spied)
    rows, labels = toxic_rows(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert plans["toxicity-rows"].count("Exchange") == 1 and plans["toxicity-sums"].count("Exchange") == 0
    assert names.count("toxicity-sums") == 1 + toxicity.ROUNDS and max(held) == 1


def test_largest_answers_do_not_depend_on_runs(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 30, (n, 2)).astype(np.int32) for n in (0, 1, 5, 40, 7, 3, 90, 2)]
    tables = [rng.normal(size=(toxicity.BUCKETS + 1, 4)) for _ in range(3)]
    flat, first, places = toxicity._padded(np.concatenate(texts), np.array([len(t) for t in texts]))
    wanted = toxicity._peaks(tables, flat, first, places)
    for longest in (1, 6, 39, 41):
        monkeypatch.setattr(toxicity, "LONGEST", longest)
        got = toxicity._peaks(tables, flat, first, places)
        assert np.array_equal(got[0], wanted[0]) and np.array_equal(got[1], wanted[1])


def junk(k: int):
    r = random.Random(k)
    words = prose(k, 120).split()
    kind = k % 5
    if kind == 0:
        return " ".join(w + r.choice(["%%%", "$$$", "&&&"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[:10] for _ in range(15))


def test_quality_of_planted_junk(spark):
    rows = []
    for k in range(800):
        body = prose(k, 120).split()
        good = ". ".join(" ".join(body[i : i + 10]).capitalize() for i in range(0, 120, 10)) + "."
        rows.append((k, junk(k) if k % 6 == 0 else good if k % 7 else good[:40]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.good for r in quality.scored(docs, quality.fit(docs)).collect()}
    assert np.mean([got[k] for k, _ in rows if k % 6]) > 0.99
    assert np.mean([not got[k] for k, _ in rows if k % 6 == 0]) > 0.95


def test_quality_of_hard_rows(hard, nothing):
    out = quality.scored(hard, quality.fit(hard)).collect()
    assert len(out) == len(hard_rows()) and not any(r.good for r in out if not (r.text or "").strip())
    assert quality.scored(nothing, quality.fit(nothing)).count() == 0


def brute_votes(text: str | None) -> str:
    """The labellers' votes on one text, in plain Python."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
    n, size, count = max(len(words), 1), max(len(raw), 1), lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower = (len(re.findall(p, raw)) for p in (rb"[A-Z]", rb"[a-z]"))
    symbols, capitals = count("#$%&*+<=>@^_`{|}~\\") / size, upper / max(upper + lower, 1)
    lines = [x for x in raw.split(b"\n") if x]
    repeats = 1 - len(set(lines)) / len(lines) if lines else 0
    bars, stops, shouts = count("|") / n, count(".") / n, count("!") / n
    distinct, stutter, each = len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, size / n
    some, many = len(words) > 0, len(words) >= 30
    rules = {
        "symbols": (some and symbols > 0.08, many and symbols < 0.03),
        "capitals": (some and capitals > 0.4, many and capitals < 0.15),
        "repeats": (repeats > 0.4, many and repeats < 0.15),
        "bars": (bars > 0.25, many and bars < 0.05),
        "words": (some and (each > 30 or (many and each < 2.5)), many and 3.5 < each < 12),
        "sentences": (many and stops > 0.6, many and 0.02 < stops < 0.3),
        "variety": (many and distinct < 0.1 + 3 / n, many and distinct > 0.3),
        "shouting": (some and shouts > 0.3, many and shouts < 0.05),
        "stutter": (len(words) >= 12 and stutter > 0.1, many and stutter < 0.02),
    }
    return "".join("0" if rules[name][0] else "1" if rules[name][1] else "2" for name in quality.LABELLERS)


def brute_em(votes: list[str], rounds: int) -> list[float]:
    """The posterior of good of each text, by expectation-maximisation over texts one by one."""
    kinds = range(len(quality.LABELLERS))
    post = []
    for v in votes:
        bad = [k for k in kinds if v[k] == "0"]
        post.append([0.02 if bad else 0.98] + [(0.98 / len(bad) if k in bad else 0.0) if bad else 0.02 / len(kinds) for k in kinds])
    for _ in range(rounds):
        shares = [max(sum(p[c] for p in post) / len(post), 1e-6) for c in range(len(kinds) + 1)]
        shares = [s / sum(shares) for s in shares]
        chance = []
        for c in range(len(kinds) + 1):
            row = []
            for k in kinds:
                hits = sum(p[c] for p, v in zip(post, votes, strict=True) if v[k] == "0") / len(post)
                seen = sum(p[c] for p, v in zip(post, votes, strict=True) if v[k] != "2") / len(post)
                row.append(min(max((hits + 0.002 * (0.1 if c else 0.002)) / (seen + 0.002), 1e-4), 1 - 1e-4))
            chance.append(row)
        new = []
        for v in votes:
            like = [s * np.prod([{"0": q, "1": 1 - q, "2": 1.0}[x] for x, q in zip(v, row, strict=True)]) for s, row in zip(shares, chance, strict=True)]
            new.append([x / sum(like) for x in like])
        post = new
    return [p[0] for p in post]


def test_quality_query_against_brute_force(spark, tmp_path, monkeypatch):
    """The registered query on a small table: votes and posteriors by plain Python, scores by training on plain rows."""
    monkeypatch.setattr(quality, "ROUNDS", 30)
    monkeypatch.setattr(quality.estimate, "__defaults__", (30,))
    rows = [(100 + k, junk(k) if k % 4 == 0 else prose(k, 90).replace(" ka ", ". ")) for k in range(120)] + [r[:2] for r in hard_rows()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op2_quality_classifier(spark, str(tmp_path)).collect()
    wanted = [brute_votes(t) for _, t in rows]
    posterior = dict(zip(wanted, brute_em(wanted, 30), strict=True))
    assert Counter((r.doc_id, r.votes) for r in got) == Counter((i, v) for (i, _), v in zip(rows, wanted, strict=True))
    assert max(abs(r.posterior - posterior[r.votes]) for r in got) < 1e-6

    def plain(text: str | None) -> np.ndarray:
        return next(quality.features(quality.pa.array([text or ""])))

    # Every distinct row with an id is in the sample here; classes weigh as in the table.
    sample = list({r: None for r in rows if r[0] is not None})
    x = np.array([plain(t).astype(np.float16) for _, t in sample], dtype=np.float64)
    y = np.array([posterior[brute_votes(t)] for _, t in sample])
    bad = y < 0.5
    share = np.mean([posterior[v] < 0.5 for v in wanted])
    weight = np.where(bad, share / bad.mean(), (1 - share) / (1 - bad.mean()))
    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, 401):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / weight.sum()
        g = np.append(sum(row * e for row, e in zip(x, d, strict=True)) + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    texts = {i: t for i, t in rows if i is not None}
    close = [abs(r.score - 1 / (1 + np.exp(-(plain(texts[r.doc_id]) @ w + b)))) for r in got if r.doc_id is not None]
    assert np.mean(close) < 0.01 and max(close) < 0.1
    assert np.mean([r.good == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id >= 100]) > 0.95


def test_repeats_are_counted_as_by_hand():
    text = "a b a a c b"
    codes = [(0, 0), (0, 0), (1, 2), (2, 1), (0, 0), (1, 4)]  # times before, places back
    wanted = np.zeros(quality.AGAIN)
    for before, back in codes:
        code = np.array([before.bit_length() * 64 + back.bit_length() + 1], np.uint64)
        wanted[int(quality.mix(code)[0] % np.uint64(quality.AGAIN))] += 1
    assert np.allclose(next(quality.again_rows(quality.pa.array([text]))), np.sqrt(wanted / (len(codes) + 8)))


def test_quality_and_toxicity_against_labels(spark):
    """Precision and recall of the registered queries against the table of labels; toxicity on held-out rows only."""
    sf = "/root/testdata/sf0.1"  # smaller ones have few labels
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    def rates(pairs):
        hits = sum(a and b for a, b in pairs)
        return hits / max(1, sum(a for a, _ in pairs)), hits / max(1, sum(b for _, b in pairs))

    good = [(r.good, labels[r.doc_id].quality == 1) for r in quality.op2_quality_classifier(spark, sf).collect() if r.doc_id in labels]
    assert min(rates(good)) > 0.95 and min(rates([(not a, not b) for a, b in good])) > 0.9
    toxic = [(r.predicted == 1, labels[r.doc_id].toxic == 1) for r in toxicity.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in toxic]) > 0.93  # 0.945 of 825 rows
