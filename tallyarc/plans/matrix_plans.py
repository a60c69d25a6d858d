"""Contact matrices: sources, windows, enrichment, background and shape statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.operators import matrix as H
from tallyarc.operators.contracts import ContractError
from tallyarc.operators.scan import grouped_quantiles
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql
from tallyarc.session import cut_lineage

REPLICATES = ["A", "N", "R"]


def anchors(spark, sf):
    """One anchor per supplier: a part bin and the supplier's own bin."""
    n1, _ = sizes(spark, sf)
    return table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.floor(F.col("s_suppkey") / 2)).alias("pair_id"), F.col("s_suppkey").alias("anchor"),
                                               ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % n1).alias("bin1"), F.col("s_suppkey").alias("bin2"))


def sizes(spark, sf):
    line = table(spark, sf, "lineitem")
    return (line.agg(F.max(F.expr("l_partkey DIV 20")) + 1).scalar(), line.agg(F.max("l_suppkey") + 1).scalar())


def norms(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("bin"), F.col("s_acctbal").alias("norm"))


SIZE = "sz AS (SELECT max(l_partkey // 20) + 1 AS n1, max(l_suppkey) + 1 AS n2 FROM lineitem)"
ANCH = "anch AS (SELECT 'p' || s_suppkey // 2 AS pair_id, s_suppkey AS anchor, (s_suppkey * 7 + s_nationkey) % n1 AS bin1, s_suppkey AS bin2 FROM supplier, sz)"
GRID = "grid AS (SELECT i, j FROM range(-5, 6) a(i), range(-5, 6) b(j))"


def _win(name="win", source="anch", value="coalesce(c.value, 0)", extra=""):
    return f"""{name} AS (SELECT a.pair_id, a.anchor, a.bin1, a.bin2, r.replicate, i, j, {value} AS value FROM {source} a, sz, grid, (SELECT unnest(['A','N','R']) AS replicate) r
 LEFT JOIN contacts c ON c.replicate = r.replicate AND c.bin1 = a.bin1 + i AND c.bin2 = a.bin2 + j {extra} WHERE a.bin1 >= 5 AND a.bin2 >= 5 AND a.bin1 + 5 < n1 AND a.bin2 + 5 < n2)"""


WIN = _win()
MASKED = _win("mwin", value="CASE WHEN x.s_acctbal > 0 AND y.s_acctbal > 0 THEN coalesce(c.value, 0) END",
              extra="LEFT JOIN supplier x ON x.s_suppkey = a.bin1 + i LEFT JOIN supplier y ON y.s_suppkey = a.bin2 + j")


def _enriched(source):
    return f"""enr AS (SELECT *, CASE WHEN bad > 0 THEN 'unavailable_pixels' WHEN bg <= 0 THEN 'undefined_background' ELSE 'observed' END AS status, CASE WHEN bad = 0 AND bg > 0 THEN fg / bg END AS e FROM (
 SELECT pair_id, anchor, bin1, bin2, replicate, median(value) FILTER (abs(i) <= 1 AND abs(j) <= 1) AS fg, median(value) FILTER (abs(i) >= 2 AND abs(j) >= 2) AS bg, count(*) FILTER (value IS NULL) AS bad FROM {source} GROUP BY ALL))"""


def window_rows(spark, sf, source=None, reach=H.REACH):
    return H.windows(anchors(spark, sf) if source is None else source, V.contacts(spark, sf), REPLICATES, *sizes(spark, sf))


BASE = (V.CONTACTS, SIZE, ANCH, GRID)


@plan("s9_contact_tables", """SELECT l_returnflag AS replicate, 'c' || l_suppkey % 3 AS chrom1, l_partkey // 20 AS bin1, count(*) AS cells, round(sum(l_quantity), 6) AS value FROM lineitem WHERE l_linenumber < 7 AND l_linestatus = 'F' GROUP BY ALL""")
def s9(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS replicate", "IF(l_linenumber >= 7, 'all', concat('c', l_suppkey % 3)) AS chrom1", "l_partkey DIV 20 AS bin1",
        "IF(l_linestatus = 'F', l_quantity, double('NaN')) AS value", "500 AS resolution")
    return clean_contacts(raw, 500).groupBy("replicate", "chrom1", "bin1").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 6).alias("value"))


def clean_contacts(raw, resolution: int):
    """Rows of one resolution without the pseudo chromosome and without NaN; an absent resolution fails."""
    rows = raw.where(F.col("resolution") == resolution)
    if rows.limit(1).count() == 0:
        raise ContractError(f"resolution {resolution} is not in the contact table")
    return rows.where((F.lower("chrom1") != "all") & ~F.isnan("value"))


_CELL = "'c' || l_suppkey % 4 AS chrom1, l_partkey + 30 AS pos1, 'c' || l_partkey % 4 AS chrom2, l_orderkey % 900 AS pos2, CAST(l_quantity AS DOUBLE) AS value"
_BINS = """cell AS (SELECT {c} FROM lineitem), e AS (SELECT chrom1 AS chrom, pos1 // 50 AS b FROM cell UNION ALL SELECT chrom2, pos2 // 50 FROM cell),
 bins AS (SELECT chrom, b, row_number() OVER (ORDER BY chrom, b) AS id FROM (SELECT chrom, unnest(range(min(b), max(b) + 1)) AS b FROM e GROUP BY chrom))""".format(c=_CELL)


@plan("s10_bin_index", sql(_BINS, tail="""SELECT least(x.id, y.id) AS bin1, greatest(x.id, y.id) AS bin2, sum(value) AS value FROM cell JOIN bins x ON x.chrom = chrom1 AND x.b = pos1 // 50 JOIN bins y ON y.chrom = chrom2 AND y.b = pos2 // 50 GROUP BY ALL"""))
def s10(spark, sf):
    cells = table(spark, sf, "lineitem").selectExpr("concat('c', l_suppkey % 4) AS chrom1", "l_partkey + 30 AS pos1", "concat('c', l_partkey % 4) AS chrom2",
                                                    "l_orderkey % 900 AS pos2", "l_quantity AS value")
    return H.index_cells(cells, H.bin_index(cells, 50), 50)


@plan("h1_windows", sql(*BASE, WIN, tail="SELECT anchor, replicate, CAST(i AS INT) AS i, CAST(j AS INT) AS j, value FROM win"))
def h1(spark, sf):
    return window_rows(spark, sf).select("anchor", "replicate", "i", "j", "value")


@plan("h2_masked_windows", sql(*BASE, MASKED, tail="SELECT anchor, replicate, count(*) AS cells, count(value) AS available, count(*) FILTER (value = 0) AS observed_zero FROM mwin GROUP BY ALL"))
def h2(spark, sf):
    rows = H.masked(window_rows(spark, sf), norms(spark, sf))
    return rows.groupBy("anchor", "replicate").agg(F.count("*").alias("cells"), F.count("value").alias("available"), F.count_if(F.col("value") == 0).alias("observed_zero"))


def enriched(spark, sf, mask=False):
    rows = window_rows(spark, sf)
    rows = H.masked(rows, norms(spark, sf)) if mask else rows
    return H.enrichment(rows, ["pair_id", "anchor", "bin1", "bin2", "replicate"])


@plan("h3_enrichment", sql(*BASE, MASKED, _enriched("mwin"), tail="""SELECT anchor, replicate, CASE WHEN bad = 0 THEN fg END AS foreground, CASE WHEN bad = 0 THEN bg END AS background, round(e, 6) AS enrichment, status FROM enr"""))
def h3(spark, sf):
    return enriched(spark, sf, mask=True).select("anchor", "replicate", "foreground", "background", F.round("enrichment", 6).alias("enrichment"), "status")


@plan("h4_anchor_status", sql(*BASE, WIN, _enriched("win"), tail="""SELECT a.anchor, r.replicate, CASE WHEN a.bin2 % 23 = 0 THEN 'chromosome_unavailable' WHEN abs(a.bin1 - a.bin2) < 1 THEN 'cis_below_bin_distance' WHEN r.replicate = 'N' AND a.bin1 % 29 = 0 THEN 'matrix_unavailable'
 WHEN enr.anchor IS NULL THEN 'chromosome_edge' ELSE enr.status END AS status FROM anch a CROSS JOIN (SELECT unnest(['A','N','R']) AS replicate) r LEFT JOIN enr ON enr.anchor = a.anchor AND enr.replicate = r.replicate"""))
def h4(spark, sf):
    a = anchors(spark, sf).withColumn("replicate", F.explode(F.array(*[F.lit(r) for r in REPLICATES])))
    found = enriched(spark, sf).select("anchor", "replicate", F.col("status").alias("window_status"))
    status = (F.when(F.col("bin2") % 23 == 0, "chromosome_unavailable").when(F.abs(F.col("bin1") - F.col("bin2")) < 1, "cis_below_bin_distance")
              .when((F.col("replicate") == "N") & (F.col("bin1") % 29 == 0), "matrix_unavailable").when(F.col("window_status").isNull(), "chromosome_edge")
              .otherwise(F.col("window_status")))
    return a.join(found, ["anchor", "replicate"], "left").select("anchor", "replicate", status.alias("status"))


@plan("a26_pair_contact_feature", sql(*BASE, WIN, _enriched("win"), """rp AS (SELECT pair_id, avg(m) AS p, count(*) AS n FROM (SELECT pair_id, replicate, avg(e) AS m FROM enr WHERE e IS NOT NULL GROUP BY ALL) GROUP BY pair_id),
 q AS (SELECT pair_id, coalesce(array_to_string(list_sort(list_distinct(list(status) FILTER (status <> 'observed'))), ';'), '') AS reasons FROM enr GROUP BY pair_id)""",
     tail="""SELECT d.pair_id, round(CASE WHEN n = 3 THEN p END, 6) AS contact_enrichment, round(p, 6) AS partial_enrichment, coalesce(n, 0) AS n_replicates,
 CASE WHEN n = 3 THEN 'observed_all_replicates' WHEN n > 0 THEN 'incomplete_replicates' ELSE 'unavailable' END AS status, coalesce(reasons, 'no_probe_coordinates') AS reasons
 FROM (SELECT DISTINCT pair_id FROM anch) d LEFT JOIN rp USING (pair_id) LEFT JOIN q USING (pair_id)"""))
def a26(spark, sf):
    out = H.pair_feature(cut_lineage(enriched(spark, sf)), anchors(spark, sf).select("pair_id").distinct())
    return out.withColumns({c: F.round(c, 6) for c in ("contact_enrichment", "partial_enrichment")})


@plan("h5_scaled_total", sql(V.CONTACTS, tail="""SELECT replicate, bin1, bin2, round(value * 1000000 / sum(value) OVER (PARTITION BY replicate), 6) AS value,
 round(value * 1000000 / sum(value) FILTER (bin1 // 25 = bin2 // 25) OVER (PARTITION BY replicate), 6) AS cis_value FROM contacts"""))
def h5(spark, sf):
    cells = V.contacts(spark, sf)
    cis = H.scaled(cells, 1e6, F.floor(F.col("bin1") / 25) == F.floor(F.col("bin2") / 25)).withColumnRenamed("value", "cis_value")
    both = H.scaled(cells, 1e6).join(cis, ["replicate", "bin1", "bin2"])
    return both.withColumns({c: F.round(c, 6) for c in ("value", "cis_value")})


@plan("h6_distance_z", sql(V.CONTACTS, "k AS (SELECT *, bin1 // 25 AS c1, bin2 // 25 AS c2, CASE WHEN bin1 // 25 = bin2 // 25 THEN abs(bin1 - bin2) ELSE 0 END AS d FROM contacts)",
     tail="SELECT replicate, bin1, bin2, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 1), 6) AS z FROM k WINDOW w AS (PARTITION BY replicate, c1, c2, d)"))
def h6(spark, sf):
    return H.distance_z(V.contacts(spark, sf), F.floor(F.col("bin1") / 25), F.floor(F.col("bin2") / 25)).select("replicate", "bin1", "bin2", F.round("z", 6).alias("z"))


@plan("h7_pair_anchors", """SELECT DISTINCT least(l_partkey // 20, l_suppkey) AS idx1, greatest(l_partkey // 20, l_suppkey) AS idx2 FROM lineitem WHERE abs(l_partkey // 20 - l_suppkey) BETWEEN 3 AND 40""")
def h7(spark, sf):
    return H.anchor_pairs(table(spark, sf, "lineitem").selectExpr("l_partkey DIV 20 AS b1", "l_suppkey AS b2"), 3, 40)


# Regions: parts on suppliers, the return flag names their set.
_REGIONS = "r AS (SELECT DISTINCT l_returnflag AS grp, l_suppkey AS chrom, l_partkey AS idx FROM lineitem), n AS (SELECT grp, chrom, count(*) AS n FROM r GROUP BY ALL)"


@plan("h8_all_pairs_anchors", sql(_REGIONS, tail="""SELECT a.grp, a.chrom, count(*) AS anchors, CAST(sum(b.idx - a.idx) AS BIGINT) AS total_distance FROM r a JOIN r b ON a.grp = b.grp AND a.chrom = b.chrom AND b.idx > a.idx AND b.idx - a.idx BETWEEN 5 AND 60
 JOIN n ON n.grp = a.grp AND n.chrom = a.chrom AND n.n >= 10 GROUP BY ALL"""))
def h8(spark, sf):
    """Pairs within each of three region sets."""
    regions = table(spark, sf, "lineitem").select(F.struct(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("chrom")).alias("own"), F.col("l_partkey").alias("idx"))
    return H.all_pairs_within(regions, "own", "idx", 5, 60, 10).groupBy("own.grp", "own.chrom").agg(
        F.count("*").alias("anchors"), F.sum(F.col("idx2") - F.col("idx1")).alias("total_distance"))


@plan("h8_pairs_across_sets", sql(_REGIONS, tail="""SELECT a.chrom, CASE WHEN b.idx < a.idx THEN b.grp || '-' || a.grp ELSE a.grp || '-' || b.grp END AS sets, count(*) AS anchors, CAST(sum(abs(b.idx - a.idx)) AS BIGINT) AS total_distance FROM r a JOIN r b ON a.grp < b.grp AND a.chrom = b.chrom AND abs(b.idx - a.idx) BETWEEN 5 AND 60
 JOIN n x ON x.grp = a.grp AND x.chrom = a.chrom JOIN n y ON y.grp = b.grp AND y.chrom = b.chrom WHERE x.n * y.n >= 10 GROUP BY ALL"""))
def h8_across(spark, sf):
    """Pairs of regions of different sets, named in their order on the chromosome."""
    regions = table(spark, sf, "lineitem").selectExpr("l_returnflag AS grp", "l_suppkey AS chrom", "l_partkey AS idx")
    return H.pairs_across_sets(regions, "grp", "chrom", "idx", 5, 60, 10, directed=True).groupBy("chrom", "sets").agg(
        F.count("*").alias("anchors"), F.sum(F.col("idx2") - F.col("idx1")).alias("total_distance"))


@plan("h9_average_window", sql(*BASE, WIN, "live AS (SELECT * FROM (SELECT *, sum(value) OVER (PARTITION BY anchor, replicate) AS t FROM win) WHERE t > 0)",
     "q AS (SELECT replicate, quantile_cont(value, 0.99) AS hi FROM live GROUP BY replicate)", tail="SELECT replicate, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(avg(least(value, hi)), 6) AS signal FROM live JOIN q USING (replicate) GROUP BY ALL"))
def h9(spark, sf):
    rows = cut_lineage(window_rows(spark, sf).select("anchor", "replicate", "i", "j", "value"))
    return H.average_window(rows, ["anchor"], ["replicate"], 0.99).withColumn("signal", F.round("signal", 6))


_SHIFT = "sh AS (SELECT pair_id, anchor, bin1 + s AS bin1, bin2 + s AS bin2 FROM (SELECT *, CASE WHEN bin1 + 15 + 5 >= n1 OR bin2 + 15 + 5 >= n2 THEN -15 ELSE 15 END AS s FROM anch, sz))"


@plan("h10_shifted_background", sql(*BASE, _SHIFT, WIN, _win("bwin", "sh"), tail="""SELECT replicate, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(o, 6) AS observed, round(b, 6) AS background, round(o / nullif(m, 0), 6) AS ratio FROM (SELECT replicate, i, j, avg(value) AS o FROM win GROUP BY ALL)
 JOIN (SELECT replicate, i, j, avg(value) AS b FROM bwin GROUP BY ALL) USING (replicate, i, j) JOIN (SELECT replicate, median(b) AS m FROM (SELECT replicate, i, j, avg(value) AS b FROM bwin GROUP BY ALL) GROUP BY replicate) USING (replicate)"""))
def h10(spark, sf):
    a = anchors(spark, sf)
    mean = lambda rows, name: rows.groupBy("replicate", "i", "j").agg(F.avg("value").alias(name))
    observed = mean(window_rows(spark, sf, a), "observed")
    background = mean(window_rows(spark, sf, H.shifted(a, 15, *sizes(spark, sf))), "background")
    middle = background.groupBy("replicate").agg(F.median("background").alias("m"))  # 121 cells a replicate
    out = observed.join(background, ["replicate", "i", "j"]).join(middle, "replicate").withColumn("ratio", F.expr("try_divide(observed, m)")).drop("m")
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "background", "ratio")})


REGIONS = """anch AS (SELECT 'p' || s_suppkey // 2 AS pair_id, s_suppkey AS anchor, s_suppkey AS bin1, s_suppkey AS bin2 FROM supplier)"""


@plan("h10_region_expectation", sql(V.CONTACTS, SIZE, REGIONS, GRID, _SHIFT, WIN, _win("bwin", "sh"), """o AS (SELECT replicate, i, j, avg(value) AS v FROM win GROUP BY ALL)""",
                                    """b AS (SELECT replicate, i, j, avg(value) AS v FROM bwin GROUP BY ALL)""",
                                    """e AS (SELECT x.replicate, x.j - x.i AS d, avg(x.v + y.v) AS expected FROM b x JOIN b y ON x.replicate = y.replicate AND x.i = y.j AND x.j = y.i GROUP BY ALL)""",
                                    tail="""SELECT x.replicate, CAST(x.i AS INT) AS i, CAST(x.j AS INT) AS j, round(x.v + y.v, 6) AS observed, round(expected, 6) AS expected, round((x.v + y.v) / nullif(expected, 0), 6) AS ratio
 FROM o x JOIN o y ON x.replicate = y.replicate AND x.i = y.j AND x.j = y.i JOIN e ON e.replicate = x.replicate AND e.d = x.j - x.i"""))
def h10_regions(spark, sf):
    """Windows of single regions on the diagonal, moved ones as background: expected by distance."""
    regions = table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.floor(F.col("s_suppkey") / 2)).alias("pair_id"), F.col("s_suppkey").alias("anchor"),
                                                  F.col("s_suppkey").alias("bin1"), F.col("s_suppkey").alias("bin2"))
    mean = lambda a: window_rows(spark, sf, a).groupBy("replicate", "i", "j").agg(F.avg("value").alias("value"))
    out = H.by_diagonal(mean(regions), mean(H.shifted(regions, 15, *sizes(spark, sf))), ["replicate"])
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "ratio")})


@plan("h11_resized_regions", sql(V.CONTACTS, """cell AS (SELECT bin1, bin2, sum(value) AS value FROM contacts GROUP BY ALL), rg AS (SELECT s_suppkey AS id, s_suppkey AS s, s_suppkey + 12 + s_nationkey AS e, s_nationkey % 2 = 0 AS fwd FROM supplier),
 g AS (SELECT id, fwd, gi, gj, s + gi * (e - s) / 9.0 AS px, s + gj * (e - s) / 9.0 AS py FROM rg, range(0, 10) a(gi), range(0, 10) b(gj)),
 k AS (SELECT id, fwd, gi, gj, CAST(floor(px) AS BIGINT) + dx AS b1, CAST(floor(py) AS BIGINT) + dy AS b2, (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) AS w FROM g, range(0, 2) c(dx), range(0, 2) d(dy))""",
     tail="SELECT id, CAST(CASE WHEN fwd THEN gi ELSE 9 - gi END AS INT) AS gi, CAST(CASE WHEN fwd THEN gj ELSE 9 - gj END AS INT) AS gj, round(sum(w * coalesce(value, 0)), 6) AS value FROM k LEFT JOIN cell ON b1 = bin1 AND b2 = bin2 GROUP BY ALL"))
def h11(spark, sf):
    """Regions resized to 10 x 10; reverse-strand regions are flipped."""
    cells = V.contacts(spark, sf).groupBy("bin1", "bin2").agg(F.sum("value").alias("value"))
    regions = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_suppkey AS start", "s_suppkey + 12 + s_nationkey AS end", "s_nationkey % 2 = 0 AS fwd")
    out = H.resized(regions, cells, ["id", "fwd"], 10)
    flip = lambda c: F.when(F.col("fwd"), F.col(c)).otherwise(9 - F.col(c))
    return out.select("id", flip("gi").alias("gi"), flip("gj").alias("gj"), F.round("value", 6).alias("value"))


@plan("h12_shape_quantify", sql(*BASE, WIN, """m AS (SELECT 'circle' AS shape, i, j, i * i + j * j <= 6.25 AS fg FROM grid UNION ALL SELECT 'insulation', i, j, (i < 0) <> (j < 0) FROM grid UNION ALL SELECT 'stripes', i, j, i = 0 OR j = 0 FROM grid),
 q AS (SELECT shape, anchor, avg(value) FILTER (fg) AS f, avg(value) FILTER (NOT fg) AS b FROM win JOIN m USING (i, j) GROUP BY ALL)""", tail="SELECT shape, anchor, round(f, 6) AS foreground, round(b, 6) AS background, round(f / nullif(b, 0), 6) AS ratio, round(f - b, 6) AS difference FROM q"))
def h12(spark, sf):
    rows = cut_lineage(window_rows(spark, sf).select("anchor", "i", "j", "value"))
    out = None
    for shape in ("circle", "insulation", "stripes"):
        q = H.quantify(rows, H.shape_mask(spark, shape), ["anchor"]).withColumn("shape", F.lit(shape))
        out = q if out is None else out.unionByName(q)
    return out.withColumns({c: F.round(c, 6) for c in ("foreground", "background", "ratio", "difference")})


# Shapes of an 11 x 11 window, r and c from 1: a middle of three, a circle of five, a region with borders at 3 and 8.
_STENCIL = """cell AS (SELECT i, j, i + 6 AS r, j + 6 AS c FROM grid), st AS (
 SELECT 'center_vs_quadrants' AS shape, i, j, 'foreground' AS part FROM cell WHERE r BETWEEN 5 AND 7 AND c BETWEEN 5 AND 7 UNION ALL SELECT 'center_vs_quadrants', i, j, 'background' FROM cell WHERE r NOT BETWEEN 5 AND 7 AND c NOT BETWEEN 5 AND 7
 UNION ALL SELECT 'center_vs_rest', i, j, CASE WHEN r BETWEEN 5 AND 7 AND c BETWEEN 5 AND 7 THEN 'foreground' ELSE 'background' END FROM cell UNION ALL SELECT 'circle', i, j, CASE WHEN sqrt(i * i + j * j) < 2.5 THEN 'foreground' ELSE 'background' END FROM cell
 UNION ALL SELECT 'insulation', i, j, 'foreground' FROM cell WHERE r BETWEEN 4 AND 7 AND c BETWEEN 4 AND 7 UNION ALL SELECT 'insulation', i, j, 'background' FROM cell WHERE (r NOT BETWEEN 3 AND 8 AND c BETWEEN 4 AND 7) OR (r BETWEEN 4 AND 7 AND c NOT BETWEEN 3 AND 8)
 UNION ALL SELECT 'cornerpeak', i, j, 'foreground' FROM cell WHERE (r BETWEEN 1 AND 5 AND c BETWEEN 6 AND 10) OR (c BETWEEN 1 AND 5 AND r BETWEEN 6 AND 10) UNION ALL SELECT 'cornerpeak', i, j, 'background' FROM cell WHERE r BETWEEN 5 AND 6 AND c BETWEEN 5 AND 6
 UNION ALL SELECT 'checker', i, j, 'foreground' FROM cell WHERE r BETWEEN 4 AND 7 AND c BETWEEN 4 AND 7 UNION ALL SELECT 'checker', i, j, 'background' FROM cell WHERE (r < 3 AND c > 8) OR (r > 8 AND c < 3)),
 ft AS (SELECT 'region_parts' AS shape, i, j, CASE WHEN r < 5 AND c < 5 THEN '5'' Region' WHEN r < 5 AND c <= 7 THEN '5'' Stripe' WHEN r < 5 THEN 'Span' WHEN r <= 7 AND c > 7 THEN '3'' Stripe' WHEN r > 7 AND c > 7 THEN '3'' Region' END AS feature FROM cell WHERE r < c
 UNION ALL SELECT 'stripes', i, j, CAST(CASE WHEN c > 7 THEN j * 500 ELSE i * 500 END AS VARCHAR) FROM cell WHERE (r BETWEEN 5 AND 7 AND c > 7) OR (r < 5 AND c BETWEEN 5 AND 7))"""
_ROUND = ("foreground", "background", "ratio", "difference")


@plan("h12_shapes_per_anchor", sql(*BASE, WIN, _STENCIL, """q AS (SELECT shape, replicate, anchor, avg(value) FILTER (part = 'foreground') AS fm, avg(value) FILTER (part = 'background') AS bm, median(value) FILTER (part = 'foreground') AS fd, median(value) FILTER (part = 'background') AS bd FROM win JOIN st USING (i, j) GROUP BY ALL),
 l AS (SELECT shape, replicate, anchor, 'mean' AS metric, fm AS f, bm AS b FROM q UNION ALL SELECT shape, replicate, anchor, 'median', fd, bd FROM q)""", tail="SELECT shape, replicate, anchor, metric, round(f, 6) AS foreground, round(b, 6) AS background, round(f / nullif(b, 0), 6) AS ratio, round(f - b, 6) AS difference FROM l"))
def h12_shapes_per_anchor(spark, sf):
    """Six shapes on the windows of every anchor and sample, by mean and by median."""
    rows, masks = cut_lineage(window_rows(spark, sf).select("anchor", "replicate", "i", "j", "value")), H.stencil(spark, resolution=500)
    both = [H.shape_scores(rows, masks, ["replicate", "anchor"], m).withColumn("metric", F.lit(name)) for name, m in (("mean", F.avg), ("median", F.median))]
    return both[0].unionByName(both[1]).withColumns({c: F.round(c, 6) for c in _ROUND})


_SIGNAL = "sig AS (SELECT replicate, i, j, avg(value) AS value FROM win GROUP BY ALL)"


@plan("h12_shapes_per_sample", sql(*BASE, WIN, _STENCIL, _SIGNAL, """q AS (SELECT shape, replicate, avg(value) FILTER (part = 'foreground') AS fm, avg(value) FILTER (part = 'background') AS bm, median(value) FILTER (part = 'foreground') AS fd, median(value) FILTER (part = 'background') AS bd FROM sig JOIN st USING (i, j) GROUP BY ALL),
 l AS (SELECT shape, replicate, 'mean' AS metric, fm AS f, bm AS b FROM q UNION ALL SELECT shape, replicate, 'median', fd, bd FROM q)""", tail="SELECT shape, replicate, metric, round(f, 6) AS foreground, round(b, 6) AS background, round(f / nullif(b, 0), 6) AS ratio, round(f - b, 6) AS difference FROM l"))
def h12_shapes_per_sample(spark, sf):
    """Six shapes on the mean window of every sample, by mean and by median."""
    signal, masks = mean_windows(spark, sf), H.stencil(spark, resolution=500)
    both = [H.shape_scores(signal, masks, ["replicate"], m).withColumn("metric", F.lit(name)) for name, m in (("mean", F.avg), ("median", F.median))]
    return both[0].unionByName(both[1]).withColumns({c: F.round(c, 6) for c in _ROUND})


def mean_windows(spark, sf):
    return cut_lineage(window_rows(spark, sf).groupBy("replicate", "i", "j").agg(F.avg("value").alias("value")))


@plan("h12_region_features", sql(*BASE, WIN, _STENCIL, _SIGNAL, tail="SELECT shape, replicate, feature, round(avg(value), 6) AS value FROM sig JOIN ft USING (i, j) WHERE feature IS NOT NULL GROUP BY ALL"))
def h12_region_features(spark, sf):
    """Sides, stripes and span of regions on the diagonal, and the run of both stripes, on the mean window of every sample."""
    return H.shape_features(mean_windows(spark, sf), H.stencil(spark, resolution=500), ["replicate"]).withColumn("value", F.round("value", 6))


@plan("x1_user_mask", sql(*BASE, WIN, "q AS (SELECT anchor, max(value) FILTER (i = j) AS f, max(value) FILTER (i = -j AND i <> 0) AS b FROM win GROUP BY anchor)", tail="SELECT anchor, f AS foreground, b AS background, round(f / nullif(b, 0), 6) AS ratio, f - b AS difference FROM q"))
def x1(spark, sf):
    """A caller's own mask and aggregate."""
    own = H.offsets_grid(spark.range(1)).drop("id").withColumn("part", F.when(F.col("i") == F.col("j"), "foreground").when(F.col("i") == -F.col("j"), "background")).where("part IS NOT NULL")
    return H.quantify(window_rows(spark, sf), own, ["anchor"], F.max).withColumn("ratio", F.round("ratio", 6))


@plan("h13_compartment_strength", sql(V.CONTACTS, """q AS (SELECT quantile_cont(s_acctbal, 0.2) AS lo, quantile_cont(s_acctbal, 0.8) AS hi FROM supplier), c AS (SELECT s_suppkey AS bin, CASE WHEN s_acctbal >= hi THEN 'A' WHEN s_acctbal <= lo THEN 'B' END AS part FROM supplier, q WHERE s_acctbal >= hi OR s_acctbal <= lo),
 t AS (SELECT replicate, avg(value) FILTER (x.part = 'A' AND y.part = 'A') AS aa, avg(value) FILTER (x.part = 'B' AND y.part = 'B') AS bb, avg(value) FILTER (x.part <> y.part) AS ab FROM contacts JOIN c x ON x.bin = bin1 JOIN c y ON y.bin = bin2 GROUP BY replicate)""",
     tail="SELECT replicate, round(aa, 6) AS aa, round(bb, 6) AS bb, round(ab, 6) AS ab, round(log2(aa * bb / (ab * ab)), 6) AS strength FROM t"))
def h13(spark, sf):
    score = norms(spark, sf)
    cut = cut_lineage(grouped_quantiles(score, [], "norm", {"lo": 0.2, "hi": 0.8}))  # one row, read four times
    lo, hi = cut.select("lo").scalar(), cut.select("hi").scalar()
    parts = score.select("bin", F.when(F.col("norm") >= hi, "A").when(F.col("norm") <= lo, "B").alias("part")).where("part IS NOT NULL")
    out = H.compartment_strength(V.contacts(spark, sf), parts, ["replicate"])
    return out.withColumns({c: F.round(c, 6) for c in ("aa", "bb", "ab", "strength")})


@plan("h13_value_by_distance", sql(V.CONTACTS, tail="""SELECT replicate, abs(bin1 - bin2) AS distance, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM contacts GROUP BY ALL"""))
def h13_distance(spark, sf):
    rows = V.contacts(spark, sf).withColumn("distance", F.abs(F.col("bin1") - F.col("bin2")))
    return grouped_quantiles(rows, ["replicate", "distance"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


@plan("m9_slice_clusters")
def m9(spark, sf):
    return H.slice_clusters(window_rows(spark, sf), ["anchor"], "replicate", 0.7)
