import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyarc.operators import components as G
from tallyarc.operators import models as M
from tallyarc.operators import selection as T


def test_transitive_components_and_a_hub(spark):
    links = [("A", "B"), ("C", "B"), ("D", "C"), ("X", "Y")] + [(f"n{i:03d}", "hub") for i in range(300)]
    out = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert {out[n] for n in "ABCD"} == {"A"} and {out[n] for n in "XY"} == {"X"} and out["n299"] == out["hub"] == "hub"


def test_long_chain_converges(spark):
    order = list(range(120))
    random.Random(3).shuffle(order)
    links = [(f"{order[i]:04d}", f"{order[i + 1]:04d}") for i in range(119)]
    assert {r.component for r in G.components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()} == {"0000"}


def test_unknown_node_in_an_edge_fails(spark):
    nodes, edges = spark.createDataFrame([("a",)], "n string"), spark.createDataFrame([("a", "z")], "u string, v string")
    with pytest.raises(Exception, match="unrecorded node"):
        G.clusters(nodes, edges, "n", "u", "v").collect()


@pytest.mark.parametrize("seed", range(4))
def test_balanced_folds_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 1, 2, 3, 5, 40]) for i in range(80)}
    loads, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = min(range(5), key=lambda f: (loads[f], f))
        want[g], loads[f] = f, loads[f] + sizes[g]
    df = spark.createDataFrame(list(sizes.items()), "g string, w long")
    assert {r.g: r.fold for r in G.balanced_folds(df, "g", "w", 5).collect()} == want


def test_stratified_folds_keep_groups_and_labels(spark):
    rows = spark.createDataFrame([(f"g{i % 30}", int(i % 7 == 0)) for i in range(300)], "g string, y int")
    out = rows.join(G.stratified_folds(rows, "g", "y"), "g")
    assert out.select("g", "fold").distinct().count() == 30
    assert all(r.p > 0 and r.n > r.p for r in out.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(60)) for _ in range(7)]
    out = []
    for _ in range(40):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKL")
        out.append("".join(s))
    return out


def test_shortlist_equals_brute_force(spark):
    seqs = variants(1)
    near = lambda a, b: edit_distance(a, b) <= max(len(a), len(b)) // 20
    taken, rep = [], {}
    for i, s in enumerate(seqs):
        if len(taken) == 5:
            break
        hit = next((t for t in taken if near(s, seqs[t])), None)
        if hit is None:
            taken.append(i)
        else:
            rep[i] = hit
    df = spark.createDataFrame(list(enumerate(seqs)), "i long, s string")
    rows, marked = T.shortlist(df, ["i"], "i", "s", 5)
    assert [r.i for r in rows] == taken
    marked = marked.collect()
    assert {r.i: r.representative for r in marked if r.representative is not None} == rep
    assert len(marked) == len(seqs) and {r.status for r in marked} == {"taken", "redundant", "eligible"}


def test_diversity_slots(spark):
    seqs = variants(2)
    df = spark.createDataFrame([(i, s, i % 4 == 3, "c" + str(i // 10)) for i, s in enumerate(seqs)], "i long, s string, single boolean, k string")
    out = T.fill_with_diversity(df, ["i"], "i", "s", F.col("single"), "k", 3, 5).orderBy("i").collect()
    assert len(out) == len(seqs) and {r.status for r in out} == {"selected", "redundant", "deferred"}
    out = sorted((r for r in out if r.taken_order), key=lambda r: r.taken_order)
    assert [r.reason for r in out][:3] == ["top_ranked_distinct_protein"] * 3 and len({r.i for r in out}) == len(out)
    chosen = [seqs[r.i] for r in out]
    assert all(edit_distance(a, b) > 3 for n, a in enumerate(chosen) for b in chosen[:n])


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    x[rng.random(200) < 0.2, 1] = np.nan
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    rows = [(i, None if np.isnan(b) else float(b), float(a), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, b double, a double, y int")
    got = np.array([r.p for r in M.fit(df, ["a", "b"], "y").score(df, "p").orderBy("id").collect()])
    med = np.nanmedian(x[:, 1])
    z = np.column_stack([x[:, 0], np.where(np.isnan(x[:, 1]), med, x[:, 1]), np.isnan(x[:, 1])])
    z = np.column_stack([(z - z.mean(0)) / z.std(0), np.ones(200)])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        penalty = np.diag([1.0, 1, 1, 0])
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    assert np.allclose(got, 1 / (1 + np.exp(-z @ w)), atol=1e-5)


def test_rarefaction_by_distinct_member(spark):
    from math import comb
    rows = [("a", i) for i in range(4)] + [("b", 4), ("b", 4), ("c", 5)]
    out = {r.n: r.expected_clusters for r in M.rarefaction(spark.createDataFrame(rows, "c string, m long"), "c", "m").collect()}
    for n in range(7):
        want = sum(1 - (comb(6 - m, n) / comb(6, n) if 6 - m >= n else 0) for m in (4, 1, 1))
        assert out[n] == pytest.approx(want)
