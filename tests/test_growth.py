"""Steps whose memory, passes or plans must not grow with what they meet."""

import pytest
from pyspark.sql import functions as F

from tallyarc.functions import alignment as A
from tallyarc.operators import arm_transcripts as T
from tallyarc.operators import components as G
from tallyarc.operators import intervals as I
from tallyarc.operators import models as M
from tallyarc.operators import probes as P
from tallyarc.operators import read_comparison as C


def test_codon_states_run_the_choice_of_transcripts_once(spark):
    seen = spark.sparkContext.accumulator(0)
    stretches = spark.createDataFrame([(1, "left", "c", "+", "c+", 0, 9, 100, 100, 109), (1, "right", "d", "-", "d-", 9, 18, 59, 51, 60)],
                                      "read_id long, arm string, target string, strand string, gene string, lo long, hi long, first long, r long, r_end long")
    coding = spark.createDataFrame([(1, 0, 18)], "read_id long, begin long, end long")
    named = F.udf(lambda tx: (seen.add(1), tx)[1], "string")
    chosen = spark.createDataFrame([(1, "left", "t"), (1, "right", "u")], "read_id long, arm string, tx string").withColumn("tx", named("tx"))
    cds = spark.createDataFrame([("t", "+", 100, 106, 0), ("u", "-", 50, 60, 0), ("u", "-", 70, 80, 1)], "tx string, strand string, cs long, ce long, phase int")
    got = {r.codon: r.state for r in T.codon_states(stretches, coding, chosen, cds).collect()}
    assert got == {0: T.SAME, 1: T.SAME, 2: T.OUTSIDE, 3: T.SAME, 4: T.SAME, 5: T.SAME}
    assert seen.value == 2  # once a row, however many times the result is read


def test_rarefaction_deals_out_its_rows(spark):
    """Large factorials, sizes on both sides of the looked-up ones, and no task that makes all n."""
    from math import comb

    sizes = [1, 1, 2, 7, 7, 30, 452]
    rows = spark.createDataFrame([(c, 1000 * c + i) for c, m in enumerate(sizes) for i in range(m)], "c long, m long")
    got = M.rarefaction(rows, "c", "m", block=64)
    total = sum(sizes)
    out = {r.n: r.expected_clusters for r in got.collect()}
    assert sorted(out) == list(range(total + 1))
    for n, seen in out.items():
        assert abs(seen - sum(1 - comb(total - m, n) / comb(total, n) for m in sizes)) < 1e-9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_runs_of_scores_leave_tasks_without_a_number_per_base(spark):
    rows = [("a", "r", "genome", False, "c", "+", 0, "3S5000M4D2I3M2H", "10A4989^ACGT3", 60), ("b", "r", "genome", False, "c", "-", 9, "3S5000M4D2I3M2H", "10A4989^ACGT3", 60)]
    placed = C.scored(spark.createDataFrame(rows, "id string, read string, kind string, secondary boolean, target string, strand string, start long, cigar string, md string, mapq int"))
    got = {r.id: r for r in placed.select("id", "runs", "length", "qstart", "qend").collect()}
    forward = [(3, 13, 1), (13, 14, -2), (14, 5002, 1), (5002, 5003, -7), (5003, 5005, -2), (5005, 5008, 1)]
    assert [tuple(r) for r in got["a"].runs] == forward and (got["a"].length, got["a"].qstart, got["a"].qend) == (5010, 3, 5008)
    assert [tuple(r) for r in got["b"].runs] == [(5010 - e, 5010 - s, v) for s, e, v in reversed(forward)]
    plan = placed.select("runs")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan  # no row spells its bases out where only runs are read


def test_joint_runs_by_brute_force(spark):
    left, right = [(0, 4, 1), (4, 5, -2), (9, 12, 1)], [(3, 10, 1), (10, 11, -6)]
    runs = "array<struct<start:int,end:int,score:int>>"
    got = spark.createDataFrame([(left, right)], f"l {runs}, r {runs}").select(C.joint_runs(F.col("l"), F.col("r"), F.lit(0), F.lit(14)).alias("j")).first().j
    at = lambda rs, p: [v for s, e, v in rs if s <= p < e]
    both = [at(left, p) + at(right, p) for p in range(14)]
    assert (got.score, got.covered) == (sum(min(b) if b else C.NO_SCORE for b in both), sum(1 for b in both if b))


def test_wanted_windows_are_told_apart_however_many_are_wanted(spark, monkeypatch):
    """Texts that hold no probe give no rows to a shuffle; a gene with many probes has several lists."""
    monkeypatch.setattr(P, "AT_ONCE", 3)
    probes = spark.createDataFrame([(i, "g", f"{i:06b}".replace("0", "A").replace("1", "C")) for i in range(50)] + [(99, "h", "GGGGGG")], "probe_id int, k string, probe string")
    texts = [(1, "g", "AAAAAAACCA"), (2, "g", "T" * 500), (3, "h", "AAAAAA"), (4, "h", "G" * 8), (5, "g", "AAA\nAAA")]
    got = P.substring_hits(probes, spark.createDataFrame(texts, "tx int, k string, seq string"), "k", "probe", "seq", 6)
    assert sorted((r.probe_id, r.tx, r.pos) for r in got.collect()) == [(0, 1, 0), (0, 1, 1), (1, 1, 2), (3, 1, 3), (6, 1, 4), (99, 4, 0), (99, 4, 1), (99, 4, 2)]
    assert "xxhash64(w" not in got._jdf.queryExecution().optimizedPlan().toString()  # no shared field of bits that fills up


def test_edges_of_a_hub_meet_its_number_in_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 20)
    links = [(f"n{i:03d}", "hub") for i in range(150)] + [(f"n{i:03d}", f"m{i:03d}") for i in range(0, 150, 3)] + [("x", "y"), ("z", "z")]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert len(got) == 204 and {c for n, c in got.items() if n not in "xyz"} == {"hub"} and (got["x"], got["y"], got["z"]) == ("x", "x", "z")
    rows = spark.range(200).selectExpr("7L AS k", "id AS v")
    met = G._looked_up(rows, "k", spark.createDataFrame([(7, 1, 200)], "u long, m long, n long"), "u", "m")
    assert met.count() == 200 and "_part" in met._jdf.queryExecution().optimizedPlan().toString()


def test_folds_make_no_row_per_turn(spark):
    groups = spark.range(3000).selectExpr("id AS g", "IF(id < 7, 40 + id, 2) AS w")
    got = G.balanced_folds(groups, "g", "w", 5)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    loads = [r.s for r in got.groupBy("fold").agg(F.sum("w").alias("s")).collect()]
    assert got.count() == 3000 and max(loads) - min(loads) <= 2


def test_edit_summary_adds_up_the_scores_without_a_number_per_base(spark):
    aligned = [("5S10M2D3M1I4M2H", "4A5^CC2T4"), ("3D4M", "^ACG4"), ("4M2S3D1M", "4^ACG1"), ("2S3I2D5M", "^AC0G4"), ("6S", "0"), ("3M1P2N3=1X", "6C0"), ("0M3M", "3"), ("3I2D", "^AC0")]
    rows = spark.createDataFrame([(c, m, r) for c, m in aligned for r in (False, True)], "cigar string, md string, rev boolean")
    ops, at = A.cigar_ops(F.col("cigar")), F.filter(F.transform("s", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    plain = rows.withColumn("s", A.base_scores(A.query_codes(ops), A.aligned_matches(F.col("md")), A.deletions(ops), F.col("rev"))).select(
        "cigar", "rev", F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0))).alias("t"), F.array_min(at), F.array_max(at) + 1, F.size("s"), A.covered(F.col("s")))
    got = rows.select("cigar", "rev", A.edit_summary(ops, F.col("md"), F.col("rev")).alias("x"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.select("cigar", "rev", "x.*").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan and plan.count("regexp_extract_all") == 1
    for cigar, md in (("3M", "4"), ("07M", "7"), ("3M4", "3"), ("3m", "3")):
        with pytest.raises(Exception, match="mismatch|invalid CIGAR"):
            spark.createDataFrame([(cigar, md, False)], rows.schema).select(A.edit_summary(ops, F.col("md"), F.col("rev"))).collect()


def test_scans_of_scans_work_out_their_rows_once(spark):
    """What running totals and joins read several times is stored; else each step multiplies the work of those before."""
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (seen.add(1), v)[1], "long")
    loops = spark.createDataFrame([("c", i * 30, i * 30 + 40) for i in range(20)], "chrom string, idx1 long, idx2 long").withColumn("idx2", counted("idx2"))
    I.clustered_anchors(loops, "chrom", 20, 120).collect()
    assert seen.value <= 40  # two conditions on it, in one pass
    points = spark.createDataFrame([("c", i) for i in range(20)], "chrom string, at long").withColumn("at", counted("at"))
    before = seen.value
    I.nearest_edge(points, points.where("chrom <> 'c'"), ["chrom"], "at").collect()
    assert seen.value - before <= 20


def test_ids_are_digested_where_texts_are_put_together(spark):
    from hashlib import sha256

    from tallyarc.llm import bpe

    ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257}
    docs = spark.createDataFrame([(1, "the other"), (2, None), (2**62 + 1, "é the")], "doc_id long, text string")
    out = bpe.digests(docs, ranks, r"\S+|\s+")
    want = {r.doc_id: (len(r.ids), sha256(" ".join(map(str, r.ids)).encode()).hexdigest()) for r in bpe.encode(docs, ranks, r"\S+|\s+").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out.collect()} == want
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: sha256((t or "").encode()).hexdigest() for i, t in docs.collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan[:plan.index("FlatMapCoGroupsInPandas")]  # no second worker holds the ids beside the one that makes them


def test_tracts_by_brute_force(spark):
    import random
    from itertools import groupby

    from tallyarc.functions import sequence as Q

    random.seed(2)
    seqs = ["", "AAAAA", "AAAAATTTTT", "CAAAAAAG", "\n\n\n\n\nA", "ACGT"] + ["".join(random.choice("ACGT") * random.choice([1, 1, 2, 4, 5, 9]) for _ in range(30)) for _ in range(30)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(-1, None)], "i long, s string")
    for minimum in (1, 5, 10):
        want = {-1: None}
        for i, s in enumerate(seqs):
            runs = [list(g) for _, g in groupby(enumerate(s), key=lambda x: x[1])]
            want[i] = [(r[0][0], r[-1][0] + 1, r[0][1]) for r in runs if len(r) >= minimum]
        out = df.select("i", Q.homopolymers(F.col("s"), minimum).alias("h"))
        assert {r.i: r.h and [tuple(x) for x in r.h] or r.h for r in out.collect()} == want
    assert ")*)" not in out._jdf.queryExecution().optimizedPlan().toString()  # shorter runs are passed over, not made into elements


def test_corroboration_groups_each_key_once(spark):
    from tallyarc.operators import joins as J

    a = spark.createDataFrame([("x", True), ("x", True), ("y", False), ("w", None)], "k string, cis boolean")
    b = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "k string, cis boolean")
    out = J.corroboration(a, b, "k", {"overall": F.lit(True), "cis": F.col("cis"), "trans": ~F.col("cis"), "none": F.lit(False)})
    got = {r.stratum: (r.n_a, r.n_b, r.shared, r.either, r.a_to_b, r.b_to_a) for r in out.collect()}
    assert got == {"overall": (3, 3, 2, 4, 2 / 3, 2 / 3), "cis": (1, 2, 1, 2, 1.0, 0.5), "trans": (1, 1, 0, 2, 0.0, 0.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "RepartitionByExpression" in plan  # no row a stratum, no grouping of whole scan splits


def test_attribute_fields_are_read_once(spark):
    from tallyarc.sources import text

    df = spark.createDataFrame([('gene_id "G1"; tag "a"; tag "b"; level 2;',), ("",), (None,)], "attr string").select(text.attributes(F.col("attr")).alias("m"))
    assert [r.m for r in df.collect()] == [{"gene_id": "G1", "tag": "b", "level": "2"}, {}, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


def test_projected_text_compares_only_stretches_that_differ(spark):
    import random

    random.seed(4)
    rows = []
    for i in range(60):
        counts = [random.randint(1, 9) for _ in range(8)]
        cigar = "".join(f"{n}{op}" for n, op in zip(counts, "SMDMINMH", strict=True))
        reference = "".join(random.choice("ACGT") for _ in range(sum(counts) - random.choice([0, 0, 0, 4])))
        read, r = "S" * counts[0], 0
        for n, op in list(zip(counts, "SMDMINMH", strict=True))[1:]:
            read += reference[r:r + n] if op == "M" else "T" * n if op in "IH" else ""
            r += n if op in "MDN" else 0
        read = "".join(random.choice("ACGTN") if random.random() < 0.05 * (i % 3) else c for c in read)
        rows.append((i, cigar, read, "".join(random.choice("D+?") for _ in read), reference))
    df = spark.createDataFrame(rows, "id long, cigar string, read string, quality string, reference string").withColumn("ops", A.cigar_ops(F.col("cigar")))
    letters = lambda c: F.split(c, "")
    plain = df.withColumn("p", A.projected_bases(F.col("ops"), letters("read"), F.transform(letters("quality"), lambda c: F.ascii(c) - 33), letters("reference")))
    want = {r.id: ("".join(x.base or "" for x in r.p), len(r.p), sum(x.action in ("kept", "corrected") for x in r.p)) for r in plain.select("id", "p").collect()}
    got = df.select("id", A.projected_text(F.col("ops"), F.col("read"), F.col("quality"), F.col("reference")).alias("p"))
    assert {r.id: tuple(r.p) for r in got.collect()} == want
    assert any(n for _, _, n in want.values())


def test_substring_join_deals_out_texts_and_probes(spark, monkeypatch):
    """Cells of both sides, pieces of a long text, letters beyond one byte, equal probes: as by brute force, and no row for a window that equals no probe."""
    for name, n in (("PIECE", 7), ("CELL_TEXT", 16), ("CELL_PROBES", 3), ("PER_PROBE", 1)):
        monkeypatch.setattr(P, name, n)
    words = ["ACGA", "AAAA", "CCCC", "GACA", "ÄACA", "A\nCA", "😀AAC", "TTTT", "AC", "ACGAC"]
    probes = [(i, "g", w) for i, w in enumerate(words)] + [(50, "h", "ACGA"), (51, "g", "AAAA"), (52, None, "AAAA"), (53, "g", None)]
    texts = [(1, "g", "ACGACGAAAAAACCCCCÄACA\nCA" * 2), (2, "g", "AAA"), (3, "h", "AAAAACGA"), (4, "g", "😀AACGACA"), (5, None, "AAAA"), (6, "g", None), (7, "i", "AAAA")]
    got = P.substring_join(spark.createDataFrame(probes, "probe_id int, k string, probe string"), spark.createDataFrame(texts, "seq_id int, k string, seq string"), "k", "probe", "seq", 4)
    expected = sorted((i, s, p) for i, k, w in probes for s, g, t in texts if k and k == g and w and t and len(w) == 4 for p in range(len(t) - 3) if t[p:p + 4] == w)
    assert sorted((r.probe_id, r.seq_id, r.pos) for r in got.select("probe_id", "seq_id", "pos").collect()) == expected and len(expected) > 20
    kinds = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in kinds and "array_join" not in kinds


def test_heavy_cells_are_a_map_when_they_are_looked_up(spark, monkeypatch):
    """Each row looks its cell up; none makes a map of the sketch first. The levels of an overlap join use the same map."""
    from tallyarc.operators import joins as J

    left, right = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS l"), spark.range(300).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS r")
    a, b, on = J.split_hot(left, right, ["k"], hot_rows=50)
    assert a.groupBy(*on).count().agg(F.max("count")).first()[0] < 100
    kept = left.join(right, "k").select("l", "r")
    assert kept.exceptAll(a.join(b, on).select("l", "r")).isEmpty() and a.join(b, on).count() == kept.count()
    cut = [e for e in a._jdf.queryExecution().optimizedPlan().toString().split("\n") if "_part_r" in e and "map_from_entries" in e and "Aggregate" not in e]
    assert not cut
    monkeypatch.setattr(J, "HOT_ROWS", 50)
    spans = spark.range(3000).selectExpr("0 AS k", "id AS l", "id % 7 AS s", "id % 7 + 3 AS e")
    assert spans.select(I._seen(spans, ["k"], ("s", "e"), 64)["heavy"].alias("m")).first().m


def test_running_totals_cut_heavy_partitions_only(spark):
    """Many small partitions keep one bucket each and add nothing to the table of earlier buckets; nulls form one, too."""
    from tallyarc.operators.scan import ordered_running

    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('g', id % 1000) END AS g", "id % 977 * 7 AS v", "id")
    run = ordered_running(rows, [F.col("v"), F.col("id")], {"one": F.lit(1)}, ["g"], {"top": F.col("id")}, exclusive=True)
    expected, groups = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.v, r.id)):
        earlier = groups.setdefault(r.g, [])
        expected[r.id] = (len(earlier), max(earlier, default=None))
        earlier.append(r.id)
    assert {r.id: (r.cum_one, r.top_top) for r in run.collect()} == expected
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "_bucket" in plan
    seen = rows.select(F.explode(scan_seen(rows)["heavy"]).alias("p")).distinct().join(rows.select("g", F.xxhash64("g").alias("p")).distinct(), "p")
    assert {r.g for r in seen.collect()} == {"hot", None}


def scan_seen(rows):
    from tallyarc.operators import scan

    return scan._heavy_and_cuts(rows, F.struct("v", "id"), 128, ["g"])


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_retained_fraction_shuffles_its_two_tables_once(spark):
    from tallyarc.operators import transcripts as X

    domains = [(k, 1 + k % 5, 20 + k % 7) for k in range(12)]
    links = [(i % 11, 1 + i * 7 % 23, 1 + i * 7 % 23 + i % 9, 1 + i % 4) for i in range(60)]
    got = X.retained_fraction(spark.createDataFrame(domains, "k long, domain_start long, domain_end long"),
                              spark.createDataFrame(links, "k long, parent_start long, parent_end long, candidate_start long"), "k")
    assert _shuffles(got) == 0 and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()  # both tables once, by their key
    for r in got.collect():
        _, s, e = domains[r.k]
        held = [(max(a, s), min(b, e), c + max(a, s) - a) for k, a, b, c in links if k == r.k and max(a, s) <= min(b, e)]
        covered = {p for a, b, _ in held for p in range(a, b + 1)}
        assert (r.fraction, r.segments, r.first_mapped) == (pytest.approx(len(covered) / (e - s + 1)), len(held), min((m for *_, m in held), default=None))


def test_segments_of_exons_that_overlap_and_one_shuffle_a_table(spark):
    from tallyarc.operators import transcripts as X

    blocks = [("t", "b", 0, 100), ("t", "c", 25, 28), ("t", "d", 500, 510), ("u", "e", 5, 9)]
    exons = [("t", 10, 40), ("t", 20, 30), ("t", 35, 60), ("t", 60, 70), ("t", 80, 90)]
    got = X.segmented(spark.createDataFrame(blocks, "tx string, block string, start long, end long"), spark.createDataFrame(exons, "tx string, xs long, xe long"), ["tx"], "block")
    assert _shuffles(got) <= 3  # the blocks, and the exons for each of their two joins
    expected = set()
    for tx, b, s, e in blocks:
        own = [(x, y) for t, x, y in exons if t == tx]
        cuts = sorted({s, e} | {c for x, y in own if x < e and s < y for c in (max(s, x), min(e, y))})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            inside = any(x <= lo and hi <= y for x, y in own)
            span = own and min(own)[0] <= lo and hi <= max(y for _, y in own)
            expected.add((tx, b, lo, hi, "exon" if inside else "intron" if span else "outside"))
    assert {tuple(r) for r in got.collect()} == expected and ("t", "b", 35, 40, "exon") in expected and ("t", "b", 30, 35, "exon") in expected


def test_lines_are_numbered_without_a_shuffle_of_the_lines(spark, tmp_path):
    from tallyarc.sources import text

    for name, n in (("a", 3000), ("b", 5)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        got = text.numbered_lines(spark, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        assert sorted((r.value[0], r.line_no, r.value) for r in got.collect()) == sorted((f, i, f"{f}{i}") for f, n in (("a", 3000), ("b", 5)) for i in range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
