"""Joins over bins of which one holds a third of all rows; region pairs and stencils on windows."""

from pyspark.sql import functions as F

from tallyarc.operators import matrix
from tallyarc.operators import intervals as I
from tallyarc.operators.joins import split_hot


def _sides(spark, n=3000):
    hot = "id % 3 = 0"
    left = spark.range(n).selectExpr("id AS l", f"IF({hot}, 'a', concat('c', id % 50)) AS contig", f"CAST(IF({hot}, 100 + id % 7, id * 13 % 5000) AS BIGINT) AS ls").withColumn("le", F.col("ls") + 5)
    right = spark.range(n // 10).selectExpr("id AS r", f"IF({hot}, 'a', concat('c', id % 50)) AS contig", f"CAST(IF({hot}, 98 + id % 9, id * 29 % 5000) AS BIGINT) AS rs").withColumn("re", F.col("rs") + 4)
    return left, right


def test_hot_cells_are_cut_and_nothing_is_lost(spark):
    left, right = _sides(spark)
    a, b, on = split_hot(left, right, ["contig"], hot_rows=50)
    cells = a.groupBy(*on).count()
    assert cells.agg(F.max("count")).first()[0] < 100  # of 1,000 rows with one key
    assert a.where("contig <> 'a'").count() == left.where("contig <> 'a'").count()
    got = {(r.l, r.r) for r in a.join(b, on).select("l", "r").collect()}
    assert a.join(b, on).count() == len(got)
    assert got == {(r.l, r.r) for r in left.join(right, "contig").select("l", "r").collect()}


def test_overlap_join_over_a_hot_bin(spark, monkeypatch):
    monkeypatch.setattr("tallyarc.operators.joins.split_hot.__defaults__", (40, None))
    left, right = _sides(spark)
    got = I.overlap_join(left, right, ["contig"], ("ls", "le"), ("rs", "re"), 64).select("l", "r", "overlap").collect()
    plain = left.join(right, "contig").where("ls < re AND rs < le").select("l", "r", F.expr("least(le, re) - greatest(ls, rs)").alias("overlap")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 50_000


def test_tolerance_join_over_a_hot_bin(spark, monkeypatch):
    monkeypatch.setattr("tallyarc.operators.joins.split_hot.__defaults__", (40, None))
    left, right = _sides(spark)
    probes = left.selectExpr("l", "contig", "ls AS b1", "le AS b2")
    rows = right.selectExpr("r", "contig", "rs AS r_b1", "re AS r_b2")
    got = {(r.l, r.r) for r in I.tolerance_join(probes, rows, ["contig"], "b1", "b2", 3).collect()}
    plain = probes.join(rows, "contig").where("abs(b1 - r_b1) <= 3 AND abs(b2 - r_b2) <= 3")
    assert got == {(r.l, r.r) for r in plain.collect()} and len(got) > 10_000


def test_empty_sides(spark):
    left, right = _sides(spark, 60)
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert I.overlap_join(a, b, ["contig"], ("ls", "le"), ("rs", "re"), 64).count() == 0


def test_pairs_across_region_sets(spark):
    from tallyarc.operators import matrix as H

    rows = [("A", "c", 10), ("A", "c", 40), ("B", "c", 15), ("B", "c", 41), ("B", "c", 41), ("C", "c", 300), ("A", "d", 1), ("B", "d", 2)]
    regions = spark.createDataFrame(rows, "grp string, chrom string, idx long")
    got = lambda **k: {tuple(r) for r in H.pairs_across_sets(regions, "grp", "chrom", "idx", 1, 30, **k).collect()}
    assert got(min_compare=2) == {("c", "A-B", 10, 15), ("c", "A-B", 15, 40), ("c", "A-B", 40, 41)}
    assert got(min_compare=2, directed=True) == {("c", "A-B", 10, 15), ("c", "B-A", 15, 40), ("c", "A-B", 40, 41)}
    assert got(min_compare=5) == set()
    within = {(r.chrom, r.idx1, r.idx2) for r in H.all_pairs_within(regions.where("grp = 'B'"), "chrom", "idx", 1, 30).collect()}
    assert within == {("c", 15, 41)}


def test_stencils_of_a_small_window(spark):
    from tallyarc.operators import matrix as H

    cells = {}
    for r in H.stencil(spark, reach=5, resolution=10).collect():
        cells.setdefault((r.shape, r.part), set()).add((r.i, r.j))
    n = {k: len(v) for k, v in cells.items()}
    assert n["center_vs_quadrants", "foreground"] == 9 and n["center_vs_quadrants", "background"] == 64 and n["center_vs_rest", "background"] == 112 and n["circle", "foreground"] == 21
    assert cells["insulation", "foreground"] == {(i, j) for i in range(-2, 2) for j in range(-2, 2)} and n["checker", "background"] == 12 and n["insulation", "background"] == 40
    assert n["cornerpeak", "foreground"] == 50 and cells["cornerpeak", "background"] == {(-1, -1), (-1, 0), (0, -1), (0, 0)}
    assert all(i < j for (shape, _), v in cells.items() if shape == "region_parts" for i, j in v)
    assert {p for s, p in cells if s == "region_parts"} == {"5' Region", "5' Stripe", "Span", "3' Stripe", "3' Region"}
    assert cells["stripes", "20"] == {(i, 2) for i in (-1, 0, 1)} and cells["stripes", "-50"] == {(-5, j) for j in (-1, 0, 1)}
    rows = spark.createDataFrame([("w", i, j, float(i == j)) for i in range(-5, 6) for j in range(-5, 6)], "w string, i int, j int, value double")
    scores = {r.shape: (r.foreground, r.background) for r in H.shape_scores(rows, H.stencil(spark), ["w"]).collect()}
    assert scores["center_vs_quadrants"] == (1 / 3, 8 / 64) and scores["checker"] == (0.25, 0.0)


def test_background_by_diagonal(spark):
    """A region's cells against the mean of the mirrored background at the same distance; a diagonal without counts has no ratio."""
    observed = spark.createDataFrame([("x", i, j, float(3 * i + j + 10)) for i in range(3) for j in range(3)], "k string, i int, j int, value double")
    background = spark.createDataFrame([("x", i, j, 0.0 if abs(i - j) == 2 else float(i * j + 1 + i)) for i in range(3) for j in range(3)], "k string, i int, j int, value double")
    o, b = ({(r.i, r.j): r.value for r in t.collect()} for t in (observed, background))
    want = {}
    for i, j in o:
        line = [b[p, q] + b[q, p] for p, q in b if q - p == j - i]
        expected = sum(line) / len(line)
        want[i, j] = (o[i, j] + o[j, i], expected, (o[i, j] + o[j, i]) / expected if expected else None)
    got = {(r.i, r.j): (r.observed, r.expected, r.ratio) for r in matrix.by_diagonal(observed, background, ["k"]).collect()}
    assert got == want
    assert got[0, 2][2] is None
