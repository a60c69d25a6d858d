import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyarc.functions import alignment as A
from tallyarc.functions import sequence as Q
from tallyarc.functions.approximate import hits_in
from tallyarc.operators import intervals as I
from tallyarc.operators import islands as S
from tallyarc.operators import matrix as H
from tallyarc.operators import transcripts as X


def test_merge_touching_and_overlap_join_equal_brute_force(spark):
    rng = random.Random(5)
    spans = [("c", s := rng.randrange(400), s + rng.choice([1, 3, 9, 120])) for _ in range(150)]
    df = spark.createDataFrame(spans, "k string, s long, e long")
    want = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert sorted([r.s, r.e] for r in I.merge_intervals(df, ["k"], "s", "e").collect()) == want
    left = df.withColumn("id", F.monotonically_increasing_id())
    right = left.withColumnsRenamed({"s": "rs", "e": "re", "id": "rid"})
    rows = left.collect()
    pairs = {(a.id, b.id) for a in rows for b in rows if a.s < b.e and b.s < a.e}
    got = [(r.id, r.rid) for r in I.overlap_join(left, right, ["k"], ("s", "e"), ("rs", "re"), 2).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_tolerance_is_inclusive_and_oriented(spark):
    probe = spark.createDataFrame([("p", "c1", "+", 100, "c2", "-", 500)], "probe string, c1 string, s1 string, b1 long, c2 string, s2 string, b2 long")
    reads = spark.createDataFrame([("at10", "c1", "+", 110, "c2", "-", 490), ("at11", "c1", "+", 111, "c2", "-", 500), ("turned", "c2", "+", 505, "c1", "-", 95),
                                   ("swapped", "c2", "-", 500, "c1", "+", 100)], "read string, c1 string, s1 string, b1 long, c2 string, s2 string, b2 long")
    rows = I.both_orientations(reads, "c1", "s1", "b1", "c2", "s2", "b2")
    out = {r.read: r.orientation for r in I.tolerance_join(probe, rows, ["c1", "s1", "c2", "s2"], "b1", "b2", 10).collect()}
    assert out == {"at10": "direct", "turned": "reverse_complement"}


def test_spanning_frame_needs_both_flanks(spark):
    seq = "CC" + "ATG" + "GCT" * 40 + "TAA" + "CC"
    df = spark.createDataFrame([(1, seq, 60, 60), (2, seq, 10, 10), (3, seq.replace("GCT" * 3, "GCTNNNGCT", 1), 60, 60)], "id int, seq string, lo long, hi long")
    out = Q.spanning_frames(df, "id", "seq", "lo", "hi").collect()
    assert [(r.id, r.start, r.coding_nt, r.protein) for r in out] == [(1, 2, 123, "M" + "A" * 40)]


def test_reverse_strand_scores_and_hard_clip(spark):
    df = spark.createDataFrame([("2H4M1D3M1I2M", "3A0^C5", True), ("5M", "5", False)], "cigar string, md string, rev boolean").withColumn("ops", A.cigar_ops(F.col("cigar")))
    out = df.select(A.base_scores(A.query_codes(F.col("ops")), A.aligned_matches(F.col("md")), A.deletions(F.col("ops")), F.col("rev")).alias("s")).collect()
    assert out[0].s == list(reversed([None, None, 1, 1, 1, -4, 1, 1, 1, -2, 1, 1])) and out[1].s == [1] * 5
    with pytest.raises(Exception, match="invalid CIGAR"):
        spark.createDataFrame([("5M?",)], "c string").select(A.cigar_ops(F.col("c"))).collect()
    with pytest.raises(Exception, match="length mismatch"):
        bad = spark.createDataFrame([("5M", "4")], "c string, md string").withColumn("ops", A.cigar_ops(F.col("c")))
        bad.select(A.base_scores(A.query_codes(F.col("ops")), A.aligned_matches(F.col("md")), A.deletions(F.col("ops")), F.lit(False))).collect()


@pytest.mark.parametrize("strand", ["+", "-"])
def test_transcript_round_trip(spark, strand):
    ex = spark.createDataFrame([("t", strand, 11, 20), ("t", strand, 31, 35), ("t", strand, 51, 60)], "tx string, strand string, s long, e long")
    placed = X.spliced(ex, "tx", "strand", "s", "e")
    pts = spark.range(25).select(F.lit("t").alias("tx"), F.col("id").alias("q"))
    there = X.to_genome(pts, placed, "tx", "strand", "s", "e", "q", 8).select("tx", "q", "base")
    back = X.to_transcript(there, placed, "tx", "strand", "s", "e", "base", 8).collect()
    assert len(back) == 25 and all(r.q == r.offset for r in back)  # offset 25 is an error, see below
    assert {r.q: r.base for r in back}[0] == (11 if strand == "+" else 60)


def test_fitted_rmsd_against_svd(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(6):
        a, b = rng.normal(size=(12, 3)), rng.normal(size=(12, 3))
        if k == 0:
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            b = a @ (q * np.sign(np.linalg.det(q))) + 4
        ca, cb = a - a.mean(0), b - b.mean(0)
        u, s, v = np.linalg.svd(ca.T @ cb)
        s[2] *= np.sign(np.linalg.det(u @ v))
        want[k] = np.sqrt(max(0, (ca ** 2).sum() + (cb ** 2).sum() - 2 * s.sum()) / 12)
        rows += [(k, *map(float, p), *map(float, r)) for p, r in zip(a, b)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, u double, v double, w double")
    for r in S.fitted_rmsd(df, ["k"], ["x", "y", "z"], ["u", "v", "w"]).collect():
        assert r.rmsd == pytest.approx(want[r.k], abs=1e-5)


def test_score_summary_limits(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.1, 0.1],), ([0.2, 1.4],), ([],)], "s array<double>")
    cols = S.score_summary(F.col("s"))
    row = df.limit(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert row.share == 0.5 and not row.majority and row.majority_04
    with pytest.raises(Exception, match="finite"):
        df.select(cols["share"]).collect()
    assert df.where("size(s) = 0").select(cols["share"].alias("x")).first().x is None


def window(spark, values):
    return spark.createDataFrame([(1, i, j, v) for (i, j), v in values.items()], "a int, i int, j int, value double")


def test_contact_window_states(spark):
    base = {(i, j): 2.0 for i in range(-5, 6) for j in range(-5, 6)}
    base |= {c: 100.0 for c in base if 0 in c} | {(i, j): 8.0 for i in (-1, 0, 1) for j in (-1, 0, 1)}
    read = lambda v: H.enrichment(window(spark, v), ["a"]).first()
    out = read(base)
    assert (out.foreground, out.background, out.enrichment, out.status) == (8, 2, 4, "observed")
    zero = read({c: (0.0 if min(abs(c[0]), abs(c[1])) >= 2 else v) for c, v in base.items()})
    assert zero.enrichment is None and zero.status == "undefined_background"
    assert read(base | {(5, 5): None}).status == "unavailable_pixels"


def test_pair_feature_counts_a_bin_pair_once(spark):
    rows = spark.createDataFrame([("A:B", r, 1, 2, e, "observed") for r, e in (("A", 1.0), ("A", 1.0), ("B", 2.0), ("C", 3.0))],
                                 "pair_id string, replicate string, bin1 long, bin2 long, enrichment double, status string")
    out = {r.pair_id: r for r in H.pair_feature(rows, spark.createDataFrame([("A:B",), ("B:A",)], "pair_id string")).collect()}
    assert out["A:B"].contact_enrichment == 2 and out["A:B"].status == "observed_all_replicates"
    assert out["B:A"].contact_enrichment is None and out["B:A"].reasons == "no_probe_coordinates"


def test_approximate_hits_equal_brute_force():
    rng = random.Random(9)
    pattern = "ACGTTGCAAC"
    for _ in range(20):
        text = "".join(rng.choice("ACGT") for _ in range(30)) + "ACGTGCAAC" + "".join(rng.choice("ACGT") for _ in range(20))
        best = {}
        for end in range(len(text) + 1):
            prev = [(0, j) for j in range(end + 1)]
            for i, p in enumerate(pattern, 1):
                cur = [(i, 0)]
                for j in range(1, end + 1):
                    cur.append(min((prev[j][0] + 1, prev[j][1]), (cur[-1][0] + 1, cur[-1][1]), (prev[j - 1][0] + (p != text[j - 1]), prev[j - 1][1])))
                prev = cur
            best[end] = prev[end]
        chosen = []
        for edits, start, end in sorted((d, s, e) for e, (d, s) in best.items() if d <= 2 and e > s):
            if not any(start < b and end > a for a, b, _ in chosen):
                chosen.append((start, end, edits))
        assert hits_in(pattern, text) == sorted(chosen)


def test_offsets_outside_a_transcript_fail(spark):
    from tallyarc.operators import transcripts as X

    placed = X.spliced(spark.createDataFrame([(1, "+", 10, 19), (1, "+", 30, 34)], "tx long, strand string, s long, e long"), "tx", "strand", "s", "e")
    points = lambda *q: spark.createDataFrame([(1, x) for x in q], "tx long, q long")
    assert sorted(r.base for r in X.to_genome(points(0, 9, 10, 14), placed, "tx", "strand", "s", "e", "q").collect()) == [10, 19, 30, 34]
    for q in (-1, 15):
        with pytest.raises(Exception):
            X.to_genome(points(q), placed, "tx", "strand", "s", "e", "q").collect()


def test_gene_context_over_record_sets(spark):
    from tallyarc.operators.intervals import gene_contexts

    records = [("a", "1", 100, 200), ("a", "1", 900, 950), ("b", "1", 300, 400), ("c", "2", 1, 5), ("d", "1", 1, 2), ("d", "2", 1, 2), ("e", "1", 150, 160)]
    got = gene_contexts(spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "none")], "x string, y string"),
                        spark.createDataFrame(records, "g string, c string, s long, e long"), "x", "y", "g", "c", "s", "e").collect()
    assert {r.y: (r.is_interchromosomal, r.genomic_distance) for r in got} == {"b": (0, 100), "c": (1, 0), "d": (None, None), "e": (0, 0), "none": (None, None)}


def test_slice_clusters_grow_until_explained(spark):
    from tallyarc.operators.matrix import slice_clusters

    def window(name, sample, middle):
        return [(name, sample, i, i, float(middle if i == 0 else abs(i) % 2)) for i in range(-5, 6)]

    rows = [x for s in "AB" for n in range(6) for x in window(n, s, 9 if n < 3 else -9)] + [x for x in window(7, "A", 1)]  # 7 lacks a sample
    rows += [(8, s, i, i, 4.0) for s in "AB" for i in range(-5, 6)]  # constant: middle 0
    got = slice_clusters(spark.createDataFrame(rows, "anchor long, sample string, i int, j int, value double"), ["anchor"], "sample").collect()
    label = {r.anchor: r.cluster for r in got}
    assert set(label) == {0, 1, 2, 3, 4, 5, 8} and len({label[i] for i in (0, 1, 2)}) == 1 and label[0] != label[3]


def test_overlap_join_of_long_intervals(spark):
    """Lengths from 1 to a million on both sides, against all pairs; copies of an interval stay few."""
    rng = random.Random(5)
    spans = lambda n: [(i, s, s + rng.choice([1, 3, 70, 5000, 10**6])) for i in range(n) for s in [rng.randint(0, 2 * 10**6)]]
    a, b = spans(80), spans(90)
    left = spark.createDataFrame([("k", *x) for x in a], "k string, id long, s long, e long")
    right = spark.createDataFrame([("k", *x) for x in b], "k string, rid long, rs long, re long")
    got = sorted((r.id, r.rid) for r in I.overlap_join(left, right, ["k"], ("s", "e"), ("rs", "re"), 64).collect())
    assert got == sorted((i, j) for i, s, e in a for j, rs, re_ in b if s < re_ and rs < e)
    levels = F.array(*[F.lit(i) for i in range(I.LEVELS)])
    assert I._binned(left, ("s", "e"), 64, levels, "l").groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * I.LEVELS
