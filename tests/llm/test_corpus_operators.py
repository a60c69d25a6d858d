"""Quality rules, mixing, near copies, classifiers and search against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from plain import components, plain_stats
from pyspark.sql import functions as F

from tallyarc.llm import mixing, near_dedup, quality_model, quality_rules, topk, toxicity

SF = "/root/testdata/sf0.001"


def test_text_stats():
    random.seed(4)
    texts = [None, "", "a b c d e a b c d e", "é*é\n\né*é\n x", "a a a a a a a", "one two three four"]
    texts += ["".join(random.choice(["ab ", "c ", "\n", "# ", "é "]) for _ in range(random.randint(1, 80))) for _ in range(100)]
    for text in texts:
        assert quality_rules.text_stats(text) == plain_stats(text)


def test_outliers_against_numpy(spark):
    """The same concentration steps over all rows at once, and junk told from prose."""
    rng = np.random.default_rng(1)
    clean = rng.normal([1.6, 0, 0, 0.05], [0.05, 0.02, 0.02, 0.03], (400, 4))
    junk = rng.normal([1.9, 0.9, 0.3, 0.1], 0.05, (60, 4))
    rows = [("en", "s", *map(float, x)) for x in np.vstack([clean, junk])]
    fit = quality_rules.estimates(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))).where("level = 0").first()
    inverse = np.array(fit.inverse).reshape(4, 4)
    distance = lambda x: np.einsum("ij,jk,ik->i", x - fit.mean, inverse, x - fit.mean)
    limit = quality_rules.chi2_quantile(1 - 1e-4, 4)
    assert fit.n == 460 and (distance(clean) <= limit).all() and (distance(junk) > limit).all()
    inner = clean[distance(clean) <= quality_rules.chi2_quantile(0.975, 4)]
    assert np.allclose(fit.mean, inner.mean(axis=0), atol=0.01)


def test_least_spread_is_a_floor():
    """It replaces a smaller variance and adds nothing to a larger one."""
    floor = np.square(quality_rules.LEAST_SD)
    assert np.allclose(quality_rules.floored(np.zeros((4, 4))), np.diag(floor))
    wide = np.diag(floor * [4, 2, 0.25, 0])
    assert np.allclose(quality_rules.floored(wide), np.diag(floor * [4, 2, 1, 1]))


def test_wide_estimates_stay(spark):
    sd = 1.5 * np.array(quality_rules.LEAST_SD)
    rows = [("en", "s", *map(float, x)) for x in np.random.default_rng(2).normal(0, sd, (3000, 4))]
    fit = quality_rules.estimates(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))).where("level = 0").first()
    ratio = np.diag(np.linalg.inv(np.array(fit.inverse).reshape(4, 4))) / sd**2
    assert (np.abs(ratio - 1) < 0.25).all()


def test_junk_goes_and_prose_stays(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = quality_rules.verdicts(docs, ["doc_id"]).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in seen}
    assert count.get((1, False), 0) == 0 and count.get((0, True), 0) <= 0.1 * count[0, False]


def test_targets_fill_up_to_the_cap():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert got["a"] == 20 and got["c"] == 0 and got["b"] == 200 and got[None] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.targets([]) == {}


def test_tree_deals_every_unit_once():
    units = np.array([50, 3, 0, 17])
    parts = [mixing.leaf_counts(k, 9, units, 5) for k in range(9)]
    assert (sum(parts) == units).all() and {int(p.sum()) for p in parts} <= {7, 8}


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r["size"] and len(r.shards) * r["size"] == r.taken for r in rows)
    by_target = Counter()
    for r in rows:
        by_target[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 0.02 * target for (_, target), t in by_target.items())
    assert sorted(map(tuple, mixing.taken(docs.repartition(5)).collect())) == sorted(map(tuple, rows))
    mixed = mixing.mix(docs).groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in mixed.collect()} == {r.doc_id: len(r.shards) for r in rows if r.shards}


def test_near_copies_by_brute_force(spark):
    random.seed(6)
    word = lambda: random.choice("abcdefgh") + str(random.randint(0, 300))
    texts, n = {}, 0
    for _ in range(12):
        base = [word() for _ in range(random.choice([3, 8, 40, 120]))]
        for _ in range(random.randint(1, 9)):  # a chain: each copy edits one before it
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = word()
            texts[n] = " ".join(copy).upper() if n % 5 == 0 else " ".join(copy)
            base = copy if random.random() < 0.5 else base
            n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == components(texts)
    assert sorted(r.doc_id for r in near_dedup.keep_first(docs).collect()) == sorted(set(got.values()))


def test_pruning_keeps_similar_pairs():
    limits = near_dedup.bounds(0.75)
    assert [n for n, _ in limits] == list(range(40, 201, 40)) and all(0 < m < 0.75 * n for n, m in limits)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (3000, near_dedup.HASHES), dtype=np.uint32)
    for share, least, most in ((0.75, 2995, 3000), (0.4, 0, 20)):
        b = np.where(rng.random(a.shape) < share, a, a + np.uint32(1))
        assert least <= len(near_dedup.going_on(a, b, limits)[0]) <= most


def test_components_of_long_chains(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 200), (200, 150)], "a long, b long"))
    got = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def test_classifiers_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    good = quality_model.classify(docs, train).join(test, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in good]) >= 0.95
    toxic = toxicity.classify(docs, train).select("doc_id", F.col("toxic").alias("called")).join(test, "doc_id").collect()
    assert np.mean([r.called == (r.toxic == 1) for r in toxic]) >= 0.9
    assert np.mean([not r.called for r in toxic if r.toxic == 0]) >= 0.98


def test_sparse_paths_shrink(spark):
    rows = [("h", "p", 2.0)] * 200 + [("h", "rare", -9.0)] + [("bad", "p", -3.0)] * 200 + [(None, None, 1.0)]
    evidence = spark.createDataFrame(rows, "q_host string, q_path string, q_evidence double")
    share = {(r.p_host, r.p_path): r.p_share for r in quality_model.path_posteriors(evidence, 0.5).collect()}
    assert share["bad", "p"] < share["h", "rare"] <= share["h", "p"] and len(share) == 4


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 420)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (504, []), (None, [9.0] * 6), (600, [1.0]), (7, [0.5] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(vectors, vectors.where("vec_id % 100 = 0"), block=64, query_block=3, pivots=5).collect()
    fine = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    pad = lambda v: np.pad(v, (0, 6 - len(v))).astype(np.int64)
    want = []
    for q, v in fine:
        if q % 100 == 0:
            best = sorted((-int(pad(v) @ pad(w)), i) for i, w in fine if i != q)[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
