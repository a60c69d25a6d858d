"""Intervals, runs, profiles and per-position statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyarc.operators import intervals as I
from tallyarc.operators import islands as S
from tallyarc.operators.scan import following, grouped_quantiles, positions
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql

MERGED = """brk AS (SELECT *, coalesce(start_pos > max(end_pos) OVER (PARTITION BY {k} ORDER BY start_pos, end_pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nw FROM ivl WHERE {cond}),
 isl AS (SELECT *, sum(CAST(nw AS INT)) OVER (PARTITION BY {k} ORDER BY start_pos, end_pos, row_id ROWS UNBOUNDED PRECEDING) AS g FROM brk),
 merged AS (SELECT {k}, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM isl GROUP BY {k}, g)"""
GENE = MERGED.format(k="contig, strand, gene_id", cond="kind = 'A'")


@plan("w12_merge_intervals", sql(V.INTERVALS, MERGED.format(k="contig, strand", cond="true"), tail="SELECT * FROM merged"))
def w12(spark, sf):
    return I.merge_intervals(V.intervals(spark, sf), ["contig", "strand"], "start_pos", "end_pos")


@plan("w13_union_length", sql(V.INTERVALS, tail="""SELECT contig, strand, CAST(count(DISTINCT p) AS BIGINT) AS covered FROM
 (SELECT contig, strand, unnest(range(start_pos, end_pos)) AS p FROM ivl) GROUP BY ALL"""))
def w13(spark, sf):
    inclusive = V.intervals(spark, sf).select("contig", "strand", (F.col("start_pos") + 1).alias("first"), F.col("end_pos").alias("last"))
    return I.union_length(inclusive, ["contig", "strand"], "first", "last")


@plan("j8_exon_overlap_join", sql(V.INTERVALS, GENE, tail="""SELECT b.row_id, m.gene_id,
 CAST(sum(least(b.end_pos, m.end_pos) - greatest(b.start_pos, m.start_pos)) AS BIGINT) AS exonic_overlap
 FROM (SELECT DISTINCT row_id, contig, strand, start_pos, end_pos FROM ivl WHERE kind <> 'A') b JOIN merged m ON b.contig = m.contig AND b.strand = m.strand
 AND b.start_pos < m.end_pos AND m.start_pos < b.end_pos GROUP BY ALL"""))
def j8(spark, sf):
    rows = V.intervals(spark, sf)
    blocks = rows.where("kind <> 'A'").select("row_id", "contig", "strand", "start_pos", "end_pos").distinct()
    return I.exon_overlap(blocks, rows.where("kind = 'A'"), ["contig", "strand"], "row_id", "gene_id", "start_pos", "end_pos", 64)


@plan("j10_point_in_interval", sql(V.INTERVALS, GENE, """pts AS (SELECT DISTINCT contig, strand, start_pos AS p FROM ivl WHERE kind = 'N'),
 hit AS (SELECT p.contig, p.strand, p.p, count(m.gene_id) AS genes, bool_or(p.p < m.start_pos + 2) AS cds FROM pts p LEFT JOIN merged m
 ON p.contig = m.contig AND p.strand = m.strand AND m.start_pos <= p.p AND p.p < m.end_pos GROUP BY ALL)""",
     tail="SELECT contig, strand, p AS position, genes, CASE WHEN genes = 0 THEN 'outside' WHEN cds THEN 'CDS' ELSE 'UTR' END AS region FROM hit"))
def j10(spark, sf):
    """Region label by priority: coding part of an exon, other exon, outside."""
    rows = V.intervals(spark, sf)
    exons = I.merge_intervals(rows.where("kind = 'A'"), ["contig", "strand", "gene_id"], "start_pos", "end_pos")
    pts = rows.where("kind = 'N'").selectExpr("contig", "strand", "start_pos AS position").distinct()
    hits = I.point_join(pts, exons, ["contig", "strand"], "position", ("start_pos", "end_pos"), 64)
    found = hits.groupBy("contig", "strand", "position").agg(
        F.count("*").alias("genes"), F.max(F.col("position") < F.col("start_pos") + 2).alias("cds"))
    return pts.join(found, ["contig", "strand", "position"], "left").select(
        "contig", "strand", "position", F.coalesce("genes", F.lit(0).cast("long")).alias("genes"),
        F.when(F.col("genes").isNull(), "outside").when(F.col("cds"), "CDS").otherwise("UTR").alias("region"))


_ENDS = "l_suppkey % 20 AS c1, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS s1, l_partkey AS b1, l_suppkey % 4 AS c2, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS s2"


@plan("j11_tolerance_join", sql(f"""ends AS (SELECT {_ENDS}, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT) AS b2,
 l_returnflag AS kind, l_orderkey AS id FROM lineitem)""", """ori AS (SELECT id, c1, s1, b1, c2, s2, b2, 'direct' AS orientation FROM ends WHERE kind <> 'R'
 UNION ALL SELECT id, c2, CASE WHEN s2 = '+' THEN '-' ELSE '+' END, b2, c1, CASE WHEN s1 = '+' THEN '-' ELSE '+' END, b1, 'reverse_complement' FROM ends WHERE kind <> 'R')""",
     tail="""SELECT p.id AS probe_id, o.id AS read_id, o.b1 - p.b1 AS offset1, o.b2 - p.b2 AS offset2, orientation FROM ends p JOIN ori o
 ON p.kind = 'R' AND p.c1 = o.c1 AND p.s1 = o.s1 AND p.c2 = o.c2 AND p.s2 = o.s2 AND abs(o.b1 - p.b1) <= 10 AND abs(o.b2 - p.b2) <= 10"""))
def j11(spark, sf):
    ends = table(spark, sf, "lineitem").selectExpr(*[x.strip() for x in _ENDS.replace(" AS s1, ", " AS s1| ").replace(" AS c1, ", " AS c1| ").replace(" AS b1, ", " AS b1| ").replace(" AS c2, ", " AS c2| ").split("|")],
        "CAST(datediff(l_shipdate, DATE'1992-01-01') AS BIGINT) AS b2", "l_returnflag AS kind", "l_orderkey AS id")
    probes = ends.where("kind = 'R'").withColumnRenamed("id", "probe_id").drop("kind")
    rows = I.both_orientations(ends.where("kind <> 'R'").withColumnRenamed("id", "read_id").drop("kind"), "c1", "s1", "b1", "c2", "s2", "b2")
    return I.tolerance_join(probes, rows, ["c1", "s1", "c2", "s2"], "b1", "b2", 10).select(
        "probe_id", "read_id", "offset1", "offset2", "orientation")


@plan("j20_nearest_exon_edge", sql(V.INTERVALS, """p AS (SELECT DISTINCT contig, start_pos AS x FROM ivl WHERE kind = 'N'),
 e AS (SELECT DISTINCT contig, end_pos AS x FROM ivl WHERE kind = 'A'),
 lo AS (SELECT p.contig, p.x, e.x AS b FROM p ASOF LEFT JOIN e ON p.contig = e.contig AND p.x >= e.x),
 hi AS (SELECT p.contig, p.x, e.x AS a FROM p ASOF LEFT JOIN e ON p.contig = e.contig AND p.x <= e.x)""",
     tail="""SELECT contig, x AS position, CASE WHEN a IS NULL OR x - b <= a - x THEN x - b ELSE x - a END AS nearest_edge_delta
 FROM lo JOIN hi USING (contig, x)"""))
def j20(spark, sf):
    rows = V.intervals(spark, sf)
    return I.nearest_edge(rows.where("kind = 'N'").selectExpr("contig", "start_pos AS position"),
                          rows.where("kind = 'A'").selectExpr("contig", "end_pos AS position"), ["contig"], "position")


@plan("j29_time_window_join", """WITH att AS (SELECT user_id, event_id AS job_id, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1 FROM events WHERE event_type = 'error'),
 s AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type <> 'error')
 SELECT job_id, count(*) AS samples, max(value) AS peak FROM att JOIN s ON att.user_id = s.user_id AND s.t >= t0 AND s.t < t1 GROUP BY job_id""")
def j29(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    attempts = following(ev.where("event_type = 'error'").select("user_id", "event_id", "t"), [F.col("t"), F.col("event_id")],
                         ["user_id"], ["t"]).where("next_t > t").withColumnRenamed("t", "t0")
    samples = ev.where("event_type <> 'error'").select("user_id", "t", "value")
    hour = 3_600_000_000
    return I.point_join(samples, attempts, ["user_id"], "t", ("t0", "next_t"), 6 * hour).groupBy(
        F.col("event_id").alias("job_id")).agg(F.count("*").alias("samples"), F.max("value").alias("peak"))


@plan("a18_parent_coverage", sql(V.INTERVALS, GENE, """o AS (SELECT b.l_orderkey AS read_id, m.gene_id, b.row_id,
 sum(least(b.end_pos, m.end_pos) - greatest(b.start_pos, m.start_pos)) AS ov
 FROM (SELECT DISTINCT row_id, l_orderkey, contig, strand, start_pos, end_pos FROM ivl WHERE kind <> 'A') b JOIN merged m ON b.contig = m.contig AND b.strand = m.strand AND b.start_pos < m.end_pos AND m.start_pos < b.end_pos GROUP BY ALL),
 best AS (SELECT gene_id, read_id, max(ov) AS ov FROM o GROUP BY ALL)""",
     tail="""SELECT 'P' || g AS gene_id, count(*) FILTER (ov >= 2) AS reads, CAST(coalesce(max(ov), 0) AS BIGINT) AS longest FROM
 (SELECT DISTINCT p_partkey % 50 AS g FROM part) LEFT JOIN best ON gene_id = 'P' || g GROUP BY ALL"""))
def a18(spark, sf):
    rows = V.intervals(spark, sf)
    blocks = rows.where("kind <> 'A'").select("row_id", "l_orderkey", "contig", "strand", "start_pos", "end_pos").distinct()
    per_row = I.exon_overlap(blocks, rows.where("kind = 'A'"), ["contig", "strand"], "row_id", "gene_id", "start_pos", "end_pos", 64)
    best = per_row.withColumn("read_id", F.substring_index("row_id", "/", 1)).groupBy("gene_id", "read_id").agg(
        F.max("exonic_overlap").alias("ov"))
    found = best.groupBy("gene_id").agg(F.count_if(F.col("ov") >= 2).alias("reads"), F.max("ov").alias("longest"))
    genes = table(spark, sf, "part").selectExpr("concat('P', p_partkey % 50) AS gene_id").distinct()
    zero = F.lit(0).cast("long")
    return genes.join(found, "gene_id", "left").select("gene_id", F.coalesce("reads", zero).alias("reads"), F.coalesce("longest", zero).alias("longest"))


@plan("f12_gene_separation", sql("""g AS (SELECT s_suppkey % 40 AS gene, CASE WHEN s_suppkey % 40 % 7 = 0 THEN s_nationkey % 3 ELSE s_suppkey % 40 % 3 END AS chrom,
 CAST(floor(s_acctbal * 10) AS BIGINT) AS b, CAST(floor(s_acctbal * 10) AS BIGINT) + 2000 + s_suppkey AS e FROM supplier)""",
     "c AS (SELECT gene, CASE WHEN min(chrom) = max(chrom) THEN min(chrom) END AS chrom FROM g GROUP BY gene)",
     "p AS (SELECT DISTINCT l_suppkey % 45 AS a, l_partkey % 45 AS b FROM lineitem)",
     "d AS (SELECT p.a, p.b, min(greatest(0, x.b - y.e, y.b - x.e)) AS d FROM p JOIN g x ON x.gene = p.a JOIN g y ON y.gene = p.b GROUP BY ALL)",
     tail="""SELECT p.a, p.b, CAST(x.chrom <> y.chrom AS INT) AS is_interchromosomal,
 CASE WHEN x.chrom <> y.chrom THEN 0 WHEN x.chrom = y.chrom THEN d.d END AS genomic_distance
 FROM p LEFT JOIN c x ON x.gene = p.a LEFT JOIN c y ON y.gene = p.b LEFT JOIN d ON d.a = p.a AND d.b = p.b"""))
def f12(spark, sf):
    """Several records a gene; some genes lie on several chromosomes, some have no record."""
    records = table(spark, sf, "supplier").selectExpr(
        "s_suppkey % 40 AS gene", "CASE WHEN s_suppkey % 40 % 7 = 0 THEN s_nationkey % 3 ELSE s_suppkey % 40 % 3 END AS chrom",
        "CAST(floor(s_acctbal * 10) AS BIGINT) AS b", "CAST(floor(s_acctbal * 10) AS BIGINT) + 2000 + s_suppkey AS e")
    pairs = table(spark, sf, "lineitem").selectExpr("l_suppkey % 45 AS a", "l_partkey % 45 AS b").distinct()
    return I.gene_contexts(pairs, records, "a", "b", "gene", "chrom", "b", "e")


@plan("f13_gene_identity", """WITH r AS (SELECT c_custkey % 1000 AS name, c_nationkey % 3 AS mgi, c_mktsegment AS chrom FROM customer),
 g AS (SELECT name, count(*) AS n, count(DISTINCT mgi) AS m, count(*) FILTER (mgi = 2) AS blank, count(DISTINCT chrom) AS c FROM r GROUP BY name)
 SELECT p_partkey, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'unique_gencode_gene' WHEN m = 1 AND blank = 0 AND c = 1 THEN 'multiple_gencode_records_same_mgi' ELSE 'ambiguous_gene_identity' END AS identity
 FROM part LEFT JOIN g ON name = p_partkey""")
def f13(spark, sf):
    records = table(spark, sf, "customer").selectExpr("c_custkey % 1000 AS name", "CAST(nullif(c_nationkey % 3, 2) AS STRING) AS mgi", "c_mktsegment AS chrom")
    return table(spark, sf, "part").selectExpr("p_partkey", "p_partkey AS name").join(gene_identity(records), "name", "left").select(
        "p_partkey", F.coalesce("identity", F.lit("unmapped")).alias("identity"))


def gene_identity(records):
    """Class of each name from its records (name, mgi, chrom); distinct values are reduced first."""
    g = records.groupBy("name").agg(F.count("*").alias("n"), F.min("mgi").alias("m0"), F.max("mgi").alias("m1"),
                                    F.count_if(F.col("mgi").isNull()).alias("blank"), F.min("chrom").alias("c0"), F.max("chrom").alias("c1"))
    same = (F.col("m0") == F.col("m1")) & (F.col("blank") == 0) & (F.col("c0") == F.col("c1"))
    return g.select("name", F.when(F.col("n") == 1, "unique_gencode_gene").when(same, "multiple_gencode_records_same_mgi")
                    .otherwise("ambiguous_gene_identity").alias("identity"))


_POS = "CAST(abs(value * 1000) AS BIGINT) "


@plan("w9_longest_run", sql(V.PROFILE, tail="""SELECT vec_id, coalesce(max(n), 0) AS longest_run FROM (SELECT DISTINCT vec_id FROM profile) LEFT JOIN (
 SELECT vec_id, count(*) AS n FROM (SELECT vec_id, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM profile WHERE value >= 0) GROUP BY vec_id, g) USING (vec_id) GROUP BY vec_id"""))
def w9(spark, sf):
    return S.longest_run(V.profile(spark, sf), ["vec_id"], "pos", F.col("value") >= 0)


_CLASS = "CASE WHEN value >= 0.1 THEN 'high' WHEN value < -0.1 THEN 'low' ELSE 'mid' END"


@plan("w10_run_length_segments", sql(V.PROFILE, f"c AS (SELECT vec_id, pos, {_CLASS} AS v FROM profile)",
     "s AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY vec_id ORDER BY pos), true) AS ch FROM c))",
     tail="SELECT vec_id, v AS value, min(pos) AS first, max(pos) AS last, string_agg(left(v, 1), '' ORDER BY pos) AS text FROM s GROUP BY vec_id, g, v"))
def w10(spark, sf):
    rows = V.profile(spark, sf).withColumn("letter", F.substring(F.expr(_CLASS), 1, 1))
    return S.segments(rows, ["vec_id"], "pos", F.expr(_CLASS), text="letter").select("vec_id", "value", "first", "last", "text")


@plan("w11_segments_with_gap_rule", sql(V.PROFILE, f"c AS (SELECT vec_id, pos, {_CLASS} AS v FROM profile WHERE abs(value) >= 0.02)",
     "s AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM (SELECT *, coalesce(v <> lag(v) OVER w OR abs(pos - lag(pos) OVER w) <> 1, true) AS ch FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY pos)))",
     tail="SELECT vec_id, v AS value, min(pos) AS first, max(pos) AS last, count(*) AS length FROM s GROUP BY vec_id, g, v"))
def w11(spark, sf):
    w = Window.partitionBy("vec_id").orderBy("pos")
    rows = V.profile(spark, sf).where("abs(value) >= 0.02")
    return S.segments(rows, ["vec_id"], "pos", F.expr(_CLASS), adjacent=F.abs(F.col("pos") - F.lag("pos").over(w)) == 1).select(
        "vec_id", "value", "first", "last", "length")


@plan("w14_exon_offsets", """SELECT l_orderkey AS transcript, id, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN b ELSE -b END, id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT *, l_partkey * 10 + l_linenumber AS b, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id FROM lineitem)""")
def w14(spark, sf):
    """Even transcripts run forward, odd ones in reverse genomic order."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS transcript", "concat_ws('/', l_linenumber, l_partkey, l_suppkey) AS id",
                                                   "l_partkey * 10 + l_linenumber AS b", "CAST(l_quantity AS BIGINT) AS len")
    order = F.when(F.col("transcript") % 2 == 0, F.col("b")).otherwise(-F.col("b"))
    return I.offsets(rows, ["transcript"], [order, F.col("id")], F.col("len")).select("transcript", "id", "offset")


@plan("w15_segment_gaps", """SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) - CAST(floor(value * 1000) AS BIGINT) AS query_gap FROM events""")
def w15(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("qstart"),
                                           (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000)).alias("qend"))
    return following(ev, [F.col("qstart"), F.col("event_id")], ["user_id"], ["qstart"]).select(
        "event_id", (F.col("next_qstart") - F.col("qend")).alias("query_gap"))


@plan("w16_first_per_key", """SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order FROM orders GROUP BY o_custkey""")
def w16(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@plan("w17_lowest_hashes", """SELECT o_orderpriority, o_orderkey, CAST(rn AS BIGINT) AS pick FROM (SELECT o_orderpriority, o_orderkey,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('seed42:' || o_orderkey)) AS rn FROM orders) WHERE rn <= 10""")
def w17(spark, sf):
    return lowest_hashes(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 10, "seed42").select("o_orderpriority", "o_orderkey", "pick")


def lowest_hashes(df, stratum: str, key: str, k: int, seed: str):
    """k keys with the lowest seeded digest per stratum; partial top-k per task before the shuffle."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy(digest)).cast("long")).where(F.col("pick") <= k)


@plan("w18_even_picks", """SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
 WHERE rn - 1 IN (SELECT CAST(round_even(i * (SELECT count(*) - 1 FROM orders) / 24.0, 0) AS BIGINT) FROM range(0, 25) t(i))""")
def w18(spark, sf):
    return even_picks(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 25).select(
        "o_orderkey", "rn")


def even_picks(df, order, m: int):
    """Rows at m evenly spaced positions of the ordering, ends included, repeats dropped."""
    ranked = positions(df, order, name="rn")
    sized = ranked.withColumn("_n", df.agg(F.count("*").alias("n")).scalar())
    wanted = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(m - 1)), 0).cast("long") + 1)
    return sized.where(F.array_contains(wanted, F.col("rn"))).drop("_n")


@plan("w20_extended_loops", """WITH b AS (SELECT DISTINCT l_returnflag || l_suppkey AS chrom, l_partkey // 10 * 10 AS idx1, l_partkey // 10 * 10 + CAST(l_quantity AS BIGINT) AS idx2 FROM lineitem),
 f AS (SELECT *, coalesce(idx1 - lag(idx1) OVER (PARTITION BY chrom ORDER BY idx1, idx2) > 20, true) AS nw FROM b WHERE idx2 - idx1 < 120),
 c AS (SELECT *, sum(CAST(nw AS INT)) OVER (PARTITION BY chrom ORDER BY idx1, idx2 ROWS UNBOUNDED PRECEDING) AS u FROM f),
 k AS (SELECT chrom, u, min(idx1) AS i1, max(idx2) AS far FROM c GROUP BY ALL)
 SELECT DISTINCT k.chrom, i1 AS idx1, c.idx2 FROM k JOIN c ON k.chrom = c.chrom AND k.u < c.u AND i1 + 120 > c.idx2 AND c.idx2 > far + 20""")
def w20(spark, sf):
    loops = table(spark, sf, "lineitem").selectExpr(
        "concat(l_returnflag, l_suppkey) AS chrom", "l_partkey DIV 10 * 10 AS idx1", "l_partkey DIV 10 * 10 + CAST(l_quantity AS BIGINT) AS idx2")
    return I.clustered_anchors(loops, "chrom", 20, 120)


@plan("f31_span_gate", sql(V.PROFILE, tail="""SELECT vec_id, CASE WHEN n < 50 THEN 'span_below_50aa' WHEN f < 0.5 THEN 'insufficient_local_confidence' ELSE 'qualified' END AS reason, round(f, 6) AS fraction
 FROM (SELECT vec_id, count(*) AS n, avg(CAST(value >= 0 AS INT)) AS f FROM profile WHERE pos BETWEEN 1 + vec_id % 20 AND 64 GROUP BY vec_id)"""))
def f31(spark, sf):
    rows = V.profile(spark, sf).where("pos BETWEEN 1 + vec_id % 20 AND 64").groupBy("vec_id").agg(
        F.count("*").alias("n"), F.avg((F.col("value") >= 0).cast("int")).alias("f"))
    return rows.select("vec_id", S.span_gate(F.col("n"), F.col("f"), 50, 0.5).alias("reason"), F.round("f", 6).alias("fraction"))


@plan("f33_score_summary", sql("""e AS (SELECT vec_id, list_transform(embedding, lambda x: least(1, greatest(0, 0.5 + CAST(x AS DOUBLE)))) AS s FROM embeddings)""",
     "r AS (SELECT vec_id, s[vec_id % 30 + 1 : 60] AS s FROM e)",
     tail="""SELECT vec_id, round(share, 6) AS share, round(list_avg(s), 6) AS mean_score, share > 0.5 AS majority, share > 0.4 AS majority_04, share > 0.6 AS majority_06
 FROM (SELECT *, len(list_filter(s, lambda x: x >= 0.5)) / len(s) AS share FROM r)"""))
def f33(spark, sf):
    scores = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + x.cast("double"))))
    part = S.half_open_slice(scores, F.col("vec_id") % 30, F.lit(60))
    rows = table(spark, sf, "embeddings").select("vec_id", part.alias("s"))
    out = rows.select("vec_id", *[c.alias(n) for n, c in S.score_summary(F.col("s")).items()])
    return out.withColumns({c: F.round(c, 6) for c in ("share", "mean_score")})


_PV = "per AS (SELECT vec_id, label, count(*) AS length, avg(CAST(value >= 0 AS INT)) AS f, avg(CAST(value >= 0.05 AS INT)) AS g FROM profile GROUP BY ALL)"


def _per_vector(spark, sf):
    return V.profile(spark, sf).groupBy("vec_id", "label").agg(
        F.count("*").alias("length"), F.avg((F.col("value") >= 0).cast("int")).alias("f"),
        F.avg((F.col("value") >= 0.05).cast("int")).alias("g"))


@plan("a11_group_summary", sql(V.PROFILE, _PV, tail="""SELECT label, count(*) AS n, round(avg(CAST(f > 0.5 AS INT)), 6) AS share_majority, round(avg(f), 6) AS mean_f,
 round(median(f), 6) AS median_f, round(sum(f * (length + vec_id % 7)) / sum(length + vec_id % 7), 6) AS weighted_f, round(avg(CAST((f > 0.5) = (g > 0.3) AS INT)), 6) AS agreement FROM per GROUP BY label"""))
def a11(spark, sf):
    per = _per_vector(spark, sf).withColumn("w", F.col("length") + F.col("vec_id") % 7)
    main = per.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("f") > 0.5).cast("int")), 6).alias("share_majority"),
        F.round(F.avg("f"), 6).alias("mean_f"), F.round(F.sum(F.col("f") * F.col("w")) / F.sum("w"), 6).alias("weighted_f"),
        F.round(F.avg(((F.col("f") > 0.5) == (F.col("g") > 0.3)).cast("int")), 6).alias("agreement"))
    return main.join(grouped_quantiles(per, ["label"], "f", {"median_f": 0.5}), "label").withColumn("median_f", F.round("median_f", 6))


@plan("a12_pair_weighted_summary", sql(V.PROFILE, _PV, """ex AS (SELECT unnest(string_split('a' || label || ';b' || vec_id % 3, ';')) AS pair_id, f FROM per)""",
     tail="SELECT count(*) AS pairs, round(avg(m), 6) AS pair_weighted_mean FROM (SELECT pair_id, avg(f) AS m FROM ex GROUP BY pair_id)"))
def a12(spark, sf):
    ids = F.concat(F.lit("a"), F.col("label"), F.lit(";b"), F.col("vec_id") % 3)
    return _per_vector(spark, sf).select(F.explode(F.split(ids, ";")).alias("pair_id"), "f").groupBy("pair_id").agg(
        F.avg("f").alias("m")).agg(F.count("*").alias("pairs"), F.round(F.avg("m"), 6).alias("pair_weighted_mean"))


_REG = "reg AS (SELECT vec_id, label, CASE WHEN pos <= 20 THEN 'donor' WHEN pos > 40 THEN 'tail' ELSE 'middle' END AS region, avg(value) AS f FROM profile GROUP BY ALL)"


@plan("a13_region_difference", sql(V.PROFILE, _REG, """p AS (SELECT label, vec_id, max(f) FILTER (region = 'tail') - max(f) FILTER (region = 'donor') AS d FROM reg GROUP BY ALL)""",
     """m AS (SELECT label, region, min(f) AS lo, avg(f) AS mid, max(f) AS hi FROM reg GROUP BY ALL)""",
     tail="""SELECT label, region, round(lo, 6) AS min_f, round(mid, 6) AS mean_f, round(hi, 6) AS max_f, round((SELECT median(d) FROM p WHERE p.label = m.label), 6) AS median_difference FROM m"""))
def a13(spark, sf):
    region = F.when(F.col("pos") <= 20, "donor").when(F.col("pos") > 40, "tail").otherwise("middle")
    reg = V.profile(spark, sf).groupBy("vec_id", "label", region.alias("region")).agg(F.avg("value").alias("f"))
    diff = reg.groupBy("vec_id", "label").pivot("region", ["donor", "tail"]).agg(F.max("f")).withColumn("d", F.col("tail") - F.col("donor")).where("d IS NOT NULL")
    med = grouped_quantiles(diff, ["label"], "d", {"median_difference": 0.5})
    return reg.groupBy("label", "region").agg(*[F.round(fn("f"), 6).alias(n) for n, fn in (("min_f", F.min), ("mean_f", F.avg), ("max_f", F.max))]).join(
        med, "label").withColumn("median_difference", F.round("median_difference", 6))


@plan("a22_threshold_grid", sql(V.PROFILE, "sp AS (SELECT vec_id, label, pos // 16 AS span, max(abs(value)) * 100 AS c FROM profile GROUP BY ALL)",
     tail="""SELECT t AS threshold, count(*) FILTER (c >= t) AS passing_spans, count(DISTINCT vec_id) FILTER (c >= t) AS passing_peptides,
 (SELECT count(*) FROM embeddings) AS peptides FROM sp, (SELECT unnest([20, 30, 40]) AS t) GROUP BY t"""))
def a22(spark, sf):
    spans = V.profile(spark, sf).groupBy("vec_id", (F.floor(F.col("pos") / 16)).alias("span")).agg((F.max(F.abs("value")) * 100).alias("c"))
    per = spans.select("vec_id", "c", F.explode(F.array(F.lit(20), F.lit(30), F.lit(40))).alias("threshold")).groupBy(
        "vec_id", "threshold").agg(F.count_if(F.col("c") >= F.col("threshold")).alias("n"))
    total = table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    return per.groupBy("threshold").agg(F.sum("n").alias("passing_spans"), F.count_if(F.col("n") > 0).alias("passing_peptides")).withColumn(
        "peptides", total.scalar())


@plan("a23_confidence_summary", """SELECT vec_id, round(list_avg(c), 6) AS mean_confidence, round(len(list_filter(c, lambda x: x < 50)) / len(c), 6) AS below_50,
 round(len(list_filter(c, lambda x: x >= 70)) / len(c), 6) AS at_least_70, round(len(list_filter(c, lambda x: x >= 90)) / len(c), 6) AS at_least_90
 FROM (SELECT vec_id, list_transform(embedding, lambda x: 60 + 200 * CAST(x AS DOUBLE)) AS c FROM embeddings)""")
def a23(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: 60 + 200 * x.cast("double")).alias("c"))

    def share(cond):
        return F.round(F.size(F.filter("c", cond)) / F.size("c"), 6)

    mean = F.aggregate("c", F.lit(0.0), lambda a, v: a + v) / F.size("c")
    return rows.select("vec_id", F.round(mean, 6).alias("mean_confidence"), share(lambda v: v < 50).alias("below_50"),
                       share(lambda v: v >= 70).alias("at_least_70"), share(lambda v: v >= 90).alias("at_least_90"))


POINTS = """pts AS (SELECT vec_id, label, (pos - 1) // 3 AS i, max(value) FILTER ((pos - 1) % 3 = 0) * 10 AS x, max(value) FILTER ((pos - 1) % 3 = 1) * 10 AS y,
 max(value) FILTER ((pos - 1) % 3 = 2) * 10 AS z FROM (SELECT *, max(pos) OVER (PARTITION BY vec_id) AS n FROM profile) WHERE pos <= n // 3 * 3 GROUP BY ALL)"""


def points(spark, sf):
    """Three consecutive values of a vector as one point of a chain."""
    whole = table(spark, sf, "embeddings").where(F.size("embedding") >= 3)
    rows = whole.select("vec_id", F.col("label").cast("long").alias("label"), "embedding",
                        F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("i"))
    at = lambda k: F.get("embedding", F.col("i") * 3 + k).cast("double") * 10
    return rows.select("vec_id", "label", F.col("i").cast("long").alias("i"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@plan("a24_geometry_qc", sql(V.PROFILE, POINTS, """st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i))""",
     tail="""SELECT vec_id, count(*) FILTER (step < 1.8 OR step > 3.3) AS step_outliers, round(max(step), 6) AS max_step,
 round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS radius_of_gyration FROM st GROUP BY vec_id"""))
def a24(spark, sf):
    return geometry_qc(points(spark, sf), "vec_id", "i", 1.8, 3.3)


def geometry_qc(chain, key: str, order: str, low: float, high: float):
    """Steps between neighbours outside [low, high], the longest step, and the radius of gyration."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"), F.lit(0.0)))
    return chain.withColumn("step", step).groupBy(key).agg(
        F.count_if((F.col("step") < low) | (F.col("step") > high)).alias("step_outliers"), F.round(F.max("step"), 6).alias("max_step"),
        F.round(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")), 6).alias("radius_of_gyration"))


_L, _R = "8 + vec_id % 40", "9 + vec_id % 40"


@plan("a25_junction_window_means", sql("""m AS (SELECT vec_id, embedding AS e, 8 + vec_id % 40 AS l FROM embeddings)""",
     "cells AS (SELECT vec_id, l, i, j, CAST(e[i] AS DOUBLE) * CAST(e[j] AS DOUBLE) AS v FROM m, range(1, 65) a(i), range(1, 65) b(j))",
     tail="""SELECT vec_id, round(avg(v) FILTER ((i > l - 15 AND i <= l AND j > l + 1 AND j <= l + 16) OR (j > l - 15 AND j <= l AND i > l + 1 AND i <= l + 16)), 6) AS cross_block_mean,
 round(avg(v) FILTER (i = j AND i > l - 15 AND i <= l + 16), 6) AS window_mean FROM cells GROUP BY vec_id"""))
def a25(spark, sf):
    """Outer product of a vector as its L x L matrix; the split position l+1 is left out of the cross blocks."""
    rows = table(spark, sf, "embeddings").select("vec_id", (8 + F.col("vec_id") % 40).alias("l"), F.posexplode("embedding").alias("i", "a"), "embedding")
    cells = rows.select("vec_id", "l", (F.col("i") + 1).alias("i"), "a", F.posexplode("embedding").alias("j", "b")).select(
        "vec_id", "l", "i", (F.col("j") + 1).alias("j"), (F.col("a").cast("double") * F.col("b").cast("double")).alias("v"))
    return junction_blocks(cells, 15)


def junction_blocks(cells, reach: int):
    """Mean over both off-diagonal blocks next to the split and mean along the diagonal window."""
    left = lambda c: (F.col(c) > F.col("l") - reach) & (F.col(c) <= F.col("l"))
    right = lambda c: (F.col(c) > F.col("l") + 1) & (F.col(c) <= F.col("l") + 1 + reach)
    cross = (left("i") & right("j")) | (left("j") & right("i"))
    near = (F.col("i") == F.col("j")) & (F.col("i") > F.col("l") - reach) & (F.col("i") <= F.col("l") + 1 + reach)
    return cells.groupBy("vec_id").agg(F.round(F.avg(F.when(cross, F.col("v"))), 6).alias("cross_block_mean"),
                                       F.round(F.avg(F.when(near, F.col("v"))), 6).alias("window_mean"))


@plan("f30_fitted_rmsd")
def f30(spark, sf):
    """Every model against the first model of its group, over points both place confidently."""
    pts = points(spark, sf)
    first = pts.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    ref = pts.join(first, ["label", "vec_id"], "left_semi").select("label", "i", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    both = pts.join(ref, ["label", "i"])
    confident = (F.abs("x") < 3) & (F.abs("rx") < 3)
    whole = S.fitted_rmsd(both, ["vec_id"], ["x", "y", "z"], ["rx", "ry", "rz"]).withColumnRenamed("rmsd", "whole_rmsd")
    part = S.fitted_rmsd(both.where(confident), ["vec_id"], ["x", "y", "z"], ["rx", "ry", "rz"]).selectExpr(
        "vec_id", "points AS confident_points", "rmsd AS confident_rmsd")
    out = whole.join(part, "vec_id", "left")
    return out.withColumns({c: F.round(c, 6) for c in ("whole_rmsd", "confident_rmsd")})
