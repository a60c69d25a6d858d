"""Transcript models, consensus, audits, ledgers, orthology and claim checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.functions.approximate import approximate_hits
from tallyarc.operators import rollup
from tallyarc.operators import transcripts as X
from tallyarc.operators.contracts import guarded
from tallyarc.operators.scan import bucket_count
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql
from tallyarc.session import cut_lineage


@plan("a8_consensus", """SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS relevant, CASE WHEN count(*) FILTER (l_returnflag <> 'N') > 0 AND bool_and(l_discount <= 0.08) FILTER (l_returnflag <> 'N')
 AND count(DISTINCT l_suppkey % 2) FILTER (l_returnflag <> 'N') = 1 THEN min(l_suppkey % 2) FILTER (l_returnflag <> 'N') END AS consensus FROM lineitem GROUP BY l_orderkey""")
def a8(spark, sf):
    return consensus(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "N", F.col("l_discount") <= 0.08, F.col("l_suppkey") % 2)


def consensus(df, key: str, ignored, valid, sequence):
    """The one sequence of a key when every alternative that counts is valid and yields it."""
    seq = F.when(~ignored, sequence)
    t = df.groupBy(key).agg(F.count_if(~ignored).alias("relevant"), F.min(F.when(~ignored, valid)).alias("_ok"), F.min(seq).alias("_a"), F.max(seq).alias("_b"))
    return t.select(key, "relevant", F.when(F.col("_ok") & (F.col("_a") == F.col("_b")), F.col("_a")).alias("consensus"))


@plan("a9_best_tier", """SELECT sha256(text) AS sequence_id, min(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END) AS best_tier, count(*) AS members, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1""")
def a9(spark, sf):
    """Member lists stay rows (one per document); the summary carries their number and ends."""
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sequence_id")).agg(
        F.min(tier).alias("best_tier"), F.count("*").alias("members"), F.min("doc_id").alias("first_member"), F.max("doc_id").alias("last_member"))


@plan("a10_pair_audit", """SELECT *, array_to_string(list_filter([CASE WHEN returned > 0 THEN 'returned' END, CASE WHEN parts = 1 THEN 'single_part' END, CASE WHEN discounted = rows THEN 'all_discounted' END], lambda x: x IS NOT NULL), ';') AS statuses FROM (
 SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0) AS discounted FROM lineitem GROUP BY l_orderkey)""")
def a10(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_discount") > 0).alias("d"))
    t = per.groupBy("l_orderkey").agg(F.sum("n").alias("rows"), F.count("*").alias("parts"), F.sum("r").alias("returned"), F.sum("d").alias("discounted"))
    return t.withColumn("statuses", F.array_join(rollup.reason_list({
        "returned": F.col("returned") > 0, "single_part": F.col("parts") == 1, "all_discounted": F.col("discounted") == F.col("rows")}), ";"))


@plan("a20_evidence_waterfall", """SELECT 'input' AS stage, 'rows' AS unit, count(*) AS n FROM lineitem UNION ALL SELECT 'reads', 'reads', count(DISTINCT l_orderkey) FROM lineitem
 UNION ALL SELECT 'split', 'reads', count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'pairs', 'pairs', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def a20(spark, sf):
    """Units differ by stage, so stages are counted on their own."""
    line = table(spark, sf, "lineitem")
    split = line.where("l_returnflag = 'R'")
    stages = [("input", "rows", line), ("reads", "reads", line.select("l_orderkey").distinct()), ("split", "reads", split.select("l_orderkey").distinct()),
              ("pairs", "pairs", split.select("l_partkey", "l_suppkey").distinct())]
    out = None
    for stage, unit, rows in stages:
        row = rows.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), F.lit(unit).alias("unit"), "n")
        out = row if out is None else out.union(row)
    return out


@plan("a21_ledger_counts", """SELECT l_shipmode AS protocol, count(*) AS planned, count(*) FILTER (s = 'F') AS verified, count(*) FILTER (s = 'O') AS running, count(*) FILTER (s IS NULL) AS pending FROM (
 SELECT o_orderpriority AS l_shipmode, o_orderkey, (SELECT max(l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS s FROM orders) GROUP BY 1""")
def a21(spark, sf):
    s = table(spark, sf, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s"))
    o = table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy(F.col("o_orderpriority").alias("protocol")).agg(
        F.count("*").alias("planned"), F.count_if(F.col("s") == "F").alias("verified"), F.count_if(F.col("s") == "O").alias("running"), F.count_if(F.col("s").isNull()).alias("pending"))


SPECIES = """grp AS (SELECT l_linestatus AS species, l_partkey % 25 AS gene5, l_suppkey % 25 AS gene3, count(DISTINCT l_orderkey) AS reads, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS specimens,
 array_to_string(list_sort(list_distinct(list(l_returnflag))), ';') AS runs FROM lineitem GROUP BY ALL)"""


def species_groups(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS species", "l_partkey % 25 AS gene5", "l_suppkey % 25 AS gene3", "l_orderkey AS read", "l_returnflag AS run")
    reads = rows.select("species", "gene5", "gene3", "read").distinct().groupBy("species", "gene5", "gene3").agg(F.count("*").alias("reads"))
    runs = rows.groupBy("species", "gene5", "gene3").agg(F.array_sort(F.collect_set("run")).alias("_r"))
    return reads.join(runs, ["species", "gene5", "gene3"]).select(
        "species", "gene5", "gene3", "reads", F.size(F.filter("_r", lambda r: r != "N")).cast("long").alias("specimens"), F.array_join("_r", ";").alias("runs"))


@plan("a27_species_pair_groups", sql(SPECIES, tail="SELECT * FROM grp"))
def a27(spark, sf):
    return species_groups(spark, sf)


_LOOK = "lk AS (SELECT 'F' AS sp, CAST(n_nationkey AS BIGINT) AS g, 'O' AS osp, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS og FROM nation WHERE n_regionkey <> 2), look AS (SELECT * FROM lk UNION SELECT osp, og, sp, g FROM lk)"


@plan("j17_orthologous_pairs", sql(SPECIES, _LOOK, tail="""SELECT a.gene5 AS gene5_a, a.gene3 AS gene3_a, b.gene5 AS gene5_b, b.gene3 AS gene3_b, a.reads AS reads_a, b.reads AS reads_b FROM grp a JOIN look x ON x.sp = a.species AND x.g = a.gene5 JOIN look y ON y.sp = a.species AND y.g = a.gene3 AND y.osp = x.osp
 JOIN grp b ON b.species = x.osp AND b.gene5 = x.og AND b.gene3 = y.og WHERE a.species < b.species"""))
def j17(spark, sf):
    one = table(spark, sf, "nation").where("n_regionkey <> 2").selectExpr("'F' AS species", "CAST(n_nationkey AS BIGINT) AS gene", "'O' AS other", "CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS other_gene")
    return orthologous_pairs(species_groups(spark, sf), one)


def orthologous_pairs(groups, one2one):
    """Ordered pairs whose both genes map to one pair of another species; the lookup is made symmetric and must be unique."""
    both = one2one.union(one2one.select("other", "other_gene", "species", "gene")).distinct()
    look = both.groupBy("species", "gene", "other").agg(F.min("other_gene").alias("o"), F.max("other_gene").alias("_hi"))
    look = look.select("species", "gene", "other", guarded(F.col("o"), F.col("o") != F.col("_hi"), "nonunique one-to-one mapping").alias("o"))
    side = lambda n: look.select("species", F.col("gene").alias(f"gene{n}"), "other", F.col("o").alias(f"o{n}"))
    a = groups.join(side(5), ["species", "gene5"]).join(side(3), ["species", "gene3", "other"]).where("species < other")
    b = groups.select(F.col("species").alias("other"), F.col("gene5").alias("o5"), F.col("gene3").alias("o3"), F.col("reads").alias("reads_b"))
    return a.join(b, ["other", "o5", "o3"]).select(F.col("gene5").alias("gene5_a"), F.col("gene3").alias("gene3_a"), F.col("o5").alias("gene5_b"),
                                                   F.col("o3").alias("gene3_b"), F.col("reads").alias("reads_a"), "reads_b")


@plan("a28_reads_without_frame", """SELECT l_partkey AS junction_id, count(DISTINCT l_orderkey) AS reads, count(DISTINCT l_orderkey) FILTER (NOT ok) AS without_frame, count(DISTINCT l_orderkey) FILTER (NOT ok) = 0 AS complete FROM (
 SELECT l_partkey, l_orderkey, bool_or(l_quantity >= 5) AS ok FROM lineitem GROUP BY ALL) GROUP BY 1""")
def a28(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("junction_id"), "l_orderkey").agg(F.max(F.col("l_quantity") >= 5).alias("ok"))
    t = per.groupBy("junction_id").agg(F.count("*").alias("reads"), F.count_if(~F.col("ok")).alias("without_frame"))
    return t.withColumn("complete", F.col("without_frame") == 0)


@plan("a29_cohort_totals", """SELECT count(*) AS runs, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS total, arg_min(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS pilot FROM orders""")
def a29(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("runs"), F.sum(F.bround("o_totalprice", 0).cast("long")).alias("total"),
                                          F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("pilot"))


@plan("a31_pass_rate_gate", """SELECT CASE WHEN o_totalprice < 100000 THEN 'short' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'long' END AS band, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS pending,
 count(*) FILTER (o_orderstatus = 'F') / count(*) >= 0.9 AND count(*) FILTER (o_orderstatus = 'P') = 0 AS pass FROM orders GROUP BY 1""")
def a31(spark, sf):
    band = F.when(F.col("o_totalprice") < 100000, "short").when(F.col("o_totalprice") < 300000, "medium").otherwise("long")
    t = table(spark, sf, "orders").groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("verified"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    return t.withColumn("pass", (F.col("verified") / F.col("n") >= 0.9) & (F.col("pending") == 0))


@plan("a32_alignment_depth", """SELECT label, CAST(pos AS BIGINT) AS pos, count(*) FILTER (abs(CAST(embedding[pos] AS DOUBLE)) >= 0.05) AS depth FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS pos) GROUP BY ALL""")
def a32(spark, sf):
    """Rows carry lower-case insertions next to large values; they are removed before columns are counted."""
    letter = lambda v: F.concat(F.when(F.abs(v.cast("double")) >= 0.05, "A").otherwise("-"), F.when(v > 0.2, "x").otherwise(""))
    rows = table(spark, sf, "embeddings").select("label", F.array_join(F.transform("embedding", letter), "").alias("row"), F.size("embedding").alias("w"))
    plain = F.regexp_replace("row", "[a-z]", "")
    checked = rows.select("label", guarded(plain, F.length(plain) != F.col("w"), "aligned rows differ in width").alias("row"))
    return checked.select("label", F.posexplode(F.split("row", "")).alias("p", "c")).groupBy("label", (F.col("p") + 1).cast("long").alias("pos")).agg(
        F.count_if(F.col("c") != "-").alias("depth"))


@plan("j26_context_comparison", sql(V.PROFILE, """frag AS (SELECT vec_id, CAST(label AS BIGINT) AS label, 5 + vec_id % 10 AS a, 30 + vec_id % 20 AS b FROM embeddings), first_ AS (SELECT CAST(label AS BIGINT) AS label, min(vec_id) AS ref FROM embeddings GROUP BY 1),
 c AS (SELECT f.vec_id, f.label, a, b, avg(CAST(value >= 0 AS INT)) AS x FROM frag f JOIN profile p ON p.vec_id = f.vec_id AND pos > a AND pos <= b GROUP BY ALL),
 n AS (SELECT f.vec_id, avg(CAST(value >= 0 AS INT)) AS y FROM frag f JOIN first_ USING (label) JOIN profile p ON p.vec_id = ref AND pos > a AND pos <= b GROUP BY ALL)""",
     tail="SELECT label, a AS start, b AS \"end\", round(x, 6) AS candidate_share, round(y, 6) AS parent_share, round(x - y, 6) AS delta, count(*) AS ids, min(vec_id) AS first_id FROM c JOIN n USING (vec_id) GROUP BY ALL"))
def j26(spark, sf):
    """The same span in a candidate and in its native parent; equal rows collapse to one with the number of ids."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    parent = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("native"))
    start, end = 5 + F.col("vec_id") % 10, 30 + F.col("vec_id") % 20
    part = lambda c: F.slice(c, (start + 1).cast("int"), (end - start).cast("int"))
    share = lambda c: F.size(F.filter(part(c), lambda v: v >= 0)) / F.size(part(c))
    rows = e.join(parent, "label").select("vec_id", "label", start.alias("start"), end.alias("end"), share("embedding").alias("x"), share("native").alias("y"))
    return rows.groupBy("label", "start", "end", F.round("x", 6).alias("candidate_share"), F.round("y", 6).alias("parent_share"), F.round(F.col("x") - F.col("y"), 6).alias("delta")).agg(
        F.count("*").alias("ids"), F.min("vec_id").alias("first_id"))


# Exons of a transcript (one order): disjoint inclusive spans, even orders forward.
_EX = "ex AS (SELECT l_orderkey AS tx, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey * 100 AS s, max(l_partkey * 100 + CAST(l_quantity AS BIGINT)) AS e FROM lineitem GROUP BY ALL), pl AS (SELECT *, CAST(coalesce(sum(e - s + 1) OVER (PARTITION BY tx ORDER BY CASE strand WHEN '+' THEN s ELSE -s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t0 FROM ex)"


def placed_exons(spark, sf):
    ex = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tx"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
                                              (F.col("l_partkey") * 100).alias("s")).agg(F.max(F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("e"))
    return X.spliced(ex, "tx", "strand", "s", "e")


@plan("f14_transcript_coordinates", sql(_EX, tail="""SELECT o.tx, o.q AS "offset", CASE WHEN s IS NULL THEN 'offset_beyond_transcript' ELSE 'mapped' END AS status, CASE strand WHEN '+' THEN s + q - t0 ELSE e - (q - t0) END AS base, CASE WHEN s IS NOT NULL THEN o.q END AS round_trip
 FROM (SELECT DISTINCT o_orderkey AS tx, unnest([0, 7, 40, o_orderkey % 90]) AS q FROM orders WHERE o_orderkey IN (SELECT tx FROM pl)) o LEFT JOIN pl ON pl.tx = o.tx AND q >= t0 AND q < t0 + e - s + 1"""))
def f14(spark, sf):
    """Offsets to genomic bases and back; an offset beyond its transcript, which the operator refuses, is told apart first."""
    pl = cut_lineage(placed_exons(spark, sf))  # read by every join, also for its levels
    zero = lambda v: F.lit(v).cast("long")
    pts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.explode(F.array(zero(0), zero(7), zero(40), F.col("o_orderkey") % 90)).alias("q")).distinct()
    pts = cut_lineage(pts.join(pl.groupBy("tx").agg(F.max("tx_end").alias("n")), "tx"))
    there = cut_lineage(X.to_genome(pts.where("q < n").drop("n"), pl, "tx", "strand", "s", "e", "q").select("tx", "q", "base"))
    back = X.to_transcript(there, pl, "tx", "strand", "s", "e", "base").select("tx", F.col("q").alias("offset"), F.lit("mapped").alias("status"), "base", F.col("offset").alias("round_trip"))
    none = F.lit(None).cast("long")
    beyond = pts.where("q >= n").select("tx", F.col("q").alias("offset"), F.lit("offset_beyond_transcript").alias("status"), none.alias("base"), none.alias("round_trip"))
    return back.unionByName(beyond)


@plan("f23_retained_chain", sql(_EX, tail="""SELECT tx, s AS exon, greatest(0, least(t0 + e - s + 1, 60) - t0) AS retained, 'prefix' AS side FROM pl WHERE t0 < 60 UNION ALL SELECT tx, s, t0 + e - s + 1 - greatest(t0, 60), 'suffix' FROM pl WHERE t0 + e - s + 1 > 60"""))
def f23(spark, sf):
    pl = placed_exons(spark, sf)
    cut = F.lit(60).cast("long")
    out = X.retained_chain(pl, cut, "prefix").withColumn("side", F.lit("prefix")).union(X.retained_chain(pl, cut, "suffix").withColumn("side", F.lit("suffix")))
    return out.select("tx", F.col("s").alias("exon"), "retained", "side")


@plan("f21_retained_span", """WITH d AS (SELECT o_orderkey AS k, 1 + o_custkey % 20 AS ds, 41 + o_custkey % 20 AS de FROM orders), l AS (SELECT l_orderkey AS k, 1 + l_partkey % 50 AS ps, 1 + l_partkey % 50 + CAST(l_quantity AS BIGINT) AS pe, 1 + l_suppkey % 9 AS cs FROM lineitem),
 c AS (SELECT k, ds, de, greatest(ps, ds) AS lo, least(pe, de) AS hi, cs + greatest(ps, ds) - ps AS m FROM d JOIN l USING (k) WHERE greatest(ps, ds) <= least(pe, de)), u AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(lo, hi + 1)) AS p FROM c) GROUP BY k), g AS (SELECT k, count(*) AS segments, min(m) AS first_mapped FROM c GROUP BY k)
 SELECT d.k, round(coalesce(n, 0) / (de - ds + 1), 6) AS fraction, coalesce(segments, 0) AS segments, first_mapped FROM d LEFT JOIN u USING (k) LEFT JOIN g USING (k)""")
def f21(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "1 + o_custkey % 20 AS domain_start", "41 + o_custkey % 20 AS domain_end")
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "1 + l_partkey % 50 AS parent_start", "1 + l_partkey % 50 + CAST(l_quantity AS BIGINT) AS parent_end", "1 + l_suppkey % 9 AS candidate_start")
    return X.retained_fraction(d, links, "k").withColumn("fraction", F.round("fraction", 6))


_RES = "SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, k, l_partkey % 40 + 3 * k AS p, 30 + l_suppkey % 20 AS jn, CASE WHEN l_suppkey % 11 <> 0 THEN l_partkey % 25 END AS st, l_quantity * 2 AS cds_end, (l_orderkey + k) % 5 <> 0 AS same FROM lineitem, range(0, 8) t(k)"


@plan("f22_residue_origin", f"""SELECT c AS source_class, count(*) AS residues, CAST(sum(p) AS BIGINT) AS positions FROM (SELECT *, CASE WHEN (p < jn) <> (p + 2 < jn) THEN 'junction_split_codon' WHEN st IS NULL THEN 'unannotated_CDS' WHEN p - st >= 0 AND (p - st) % 3 = 0 AND p + 3 <= cds_end AND same THEN 'canonical' WHEN p - st < 0 THEN 'upstream_of_annotated_CDS'
 WHEN (p - st) % 3 <> 0 THEN 'out_of_frame' WHEN p >= cds_end THEN 'downstream_of_annotated_CDS' ELSE 'noncanonical_amino_acid' END AS c FROM ({_RES})) GROUP BY 1""")
def f22(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr(
        "l_partkey % 40 + 3 * k AS p", "30 + l_suppkey % 20 AS jn", "CASE WHEN l_suppkey % 11 <> 0 THEN l_partkey % 25 END AS st", "l_quantity * 2 AS cds_end", "(l_orderkey + k) % 5 <> 0 AS same")
    side = lambda d: F.when(F.col("p") + d < F.col("jn"), "a").otherwise("b")
    c = X.residue_class(side(0), side(2), F.col("p") - F.col("st"), F.col("p") + 3 <= F.col("cds_end"), F.col("same"), F.col("p") >= F.col("cds_end"))
    return rows.groupBy(c.alias("source_class")).agg(F.count("*").alias("residues"), F.sum("p").alias("positions"))


@plan("f24_probe_reconstruction", sql(V.DNA, "j AS (SELECT seq_id, seq, length(seq) // 2 AS a, reverse(seq) AS r FROM dna WHERE length(seq) >= 240), w AS (SELECT *, substr(seq, 1, a + 1) || substr(r, a + 1) AS s FROM j)",
     tail="""SELECT seq_id, a + 1 AS junction, length(s) AS n, substr(s, a + 1 - 60 + 1, 120) = substr(seq, a - 58, 60) || substr(r, a + 1, 60 - seq_id % 2) || CASE WHEN seq_id % 2 = 1 THEN '?' ELSE '' END AS probe_matches FROM w"""))
def f24(spark, sf):
    """Odd records carry a damaged probe and must not match."""
    a = F.floor(F.length("seq") / 2).cast("int")
    j = V.dna(spark, sf).where("length(seq) >= 240").select("seq_id", "seq", a.alias("a"), F.reverse("seq").alias("r"))
    probe = F.concat(F.substr("seq", F.col("a") - 58, F.lit(60)), F.substr("r", F.col("a") + 1, (60 - F.col("seq_id") % 2).cast("int")), F.when(F.col("seq_id") % 2 == 1, "?").otherwise(""))
    made = F.concat(F.substr("seq", F.lit(1), F.col("a") + 1), F.expr("substr(r, a + 1)"))
    return j.select("seq_id", (F.col("a") + 1).cast("long").alias("junction"), F.length(made).cast("long").alias("n"),
                    (F.substr(made, F.col("a") + 1 - 59, F.lit(120)) == probe).alias("probe_matches"))


@plan("f27_transcript_choice", """WITH t AS (SELECT l_suppkey AS gene, l_partkey % 60 AS tx, count(*) AS coding, count(DISTINCT l_returnflag) AS jumps, count(*) FILTER (l_tax > 0.04) AS arm FROM lineitem GROUP BY ALL),
 r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY coding DESC, jumps DESC, arm DESC) AS rk FROM t) SELECT gene, coding, jumps, arm, min(tx) AS tx, count(*) AS tied FROM r WHERE rk = 1 GROUP BY ALL""")
def f27(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), (F.col("l_partkey") % 60).alias("tx")).agg(
        F.count("*").alias("coding"), F.count_distinct("l_returnflag").alias("jumps"), F.count_if(F.col("l_tax") > 0.04).alias("arm"))
    return X.best_with_ties(t, "gene", ["coding", "jumps", "arm"], "tx")


@plan("f28_codon_frames", """WITH b AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, s AS slot, l_partkey % 30 + s + CASE WHEN l_quantity > 48 AND s = 2 THEN 1 ELSE 0 END AS pos, l_suppkey % 3 AS phase FROM lineitem, range(0, 3) t(s)),
 c AS (SELECT id, count(*) FILTER (pos >= 25) AS out, bool_and((pos - phase + 300) % 3 = slot) AS same FROM b GROUP BY id) SELECT CASE WHEN out > 0 THEN 'outside annotated CDS' WHEN same THEN 'same annotated CDS frame' ELSE 'alternative CDS frame' END AS state, count(*) AS codons FROM c GROUP BY 1""")
def f28(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "slot", "l_partkey % 30 + slot + IF(l_quantity > 48 AND slot = 2, 1, 0) AS pos", "l_suppkey % 3 AS phase")
    local = rows.withColumn("local", F.when(F.col("pos") < 25, F.col("pos")))
    return X.codon_frame(local, ["id"]).groupBy("state").agg(F.count("*").alias("codons"))


@plan("f29_segmentation", sql(_EX, """blk AS (SELECT DISTINCT l_orderkey AS tx, l_suppkey AS b, l_partkey * 100 - 20 AS s0, l_partkey * 100 + 30 AS e0 FROM lineitem), x AS (SELECT tx, s AS xs, e + 1 AS xe FROM ex),
 ct AS (SELECT tx, b, s0, e0, unnest([s0, e0]) AS c FROM blk UNION SELECT blk.tx, b, s0, e0, unnest([greatest(s0, xs), least(e0, xe)]) FROM blk JOIN x ON x.tx = blk.tx AND xs < e0 AND s0 < xe), pt AS (SELECT *, lead(c) OVER (PARTITION BY tx, b, s0 ORDER BY c) AS hi FROM ct),
 rg AS (SELECT tx, min(xs) AS t0, max(xe) AS t1 FROM x GROUP BY tx)""", tail="""SELECT pt.tx, b AS supplier, s0 AS block, c AS lo, hi, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.tx = pt.tx AND xs <= c AND hi <= xe) THEN 'exon' WHEN t0 <= c AND hi <= t1 THEN 'intron' ELSE 'outside' END AS kind FROM pt JOIN rg ON rg.tx = pt.tx WHERE hi IS NOT NULL"""))
def f29(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    line = line.repartition(bucket_count(line), "l_orderkey")  # all that follows is one transcript's
    blocks = line.selectExpr("l_orderkey AS tx", "l_suppkey AS supplier", "l_partkey * 100 - 20 AS start", "l_partkey * 100 + 30 AS end").distinct().withColumn(
        "block", F.struct("supplier", "start"))
    exons = line.groupBy(F.col("l_orderkey").alias("tx"), (F.col("l_partkey") * 100).alias("xs")).agg((F.max(F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")) + 1).alias("xe"))
    return X.segmented(blocks, exons, ["tx"], "block").select("tx", "block.supplier", F.col("block.start").alias("block"), "lo", "hi", "kind")


@plan("f34_exon_assignments", sql(_EX, tail="""SELECT pl.tx, s AS exon, greatest(t0, 30) + 1 AS coding_start, least(t0 + e - s + 1, 120) AS coding_end, least(t0 + e - s + 1, 120) - greatest(t0, 30) AS bases, greatest(t0, 30) // 3 + 1 AS aa_start, (least(t0 + e - s + 1, 120) - 1) // 3 + 1 AS aa_end FROM pl WHERE t0 < 120 AND t0 + e - s + 1 > 30"""))
def f34(spark, sf):
    """Every exon under the coding window [30, 120) with its base and residue ranges."""
    lo, hi = F.greatest(F.col("tx_start"), F.lit(30)), F.least(F.col("tx_end"), F.lit(120))
    return placed_exons(spark, sf).where("tx_start < 120 AND tx_end > 30").select(
        "tx", F.col("s").alias("exon"), (lo + 1).alias("coding_start"), hi.alias("coding_end"), (hi - lo).alias("bases"),
        (F.floor(lo / 3) + 1).alias("aa_start"), (F.floor((hi - 1) / 3) + 1).alias("aa_end"))


@plan("f17_approximate_hits")
def f17(spark, sf):
    """Two cores, both orientations; hits count as internal with 50 bases on either side."""
    cores = {"first": "ATGCATTAGCAATCAGTC", "second": "GGCTTAACGTCATG"}
    rows = V.dna(spark, sf).select("seq_id", F.length("seq").alias("n"), F.explode(approximate_hits(F.col("seq"), cores)).alias("h"))
    inner = (F.col("h.start") >= 50) & (F.col("n") - F.col("h.end") >= 50)
    half = F.floor(F.col("n") / 2)
    near = (F.col("h.start") <= half + 75) & (F.col("h.end") >= half - 75)
    return rows.select("seq_id", "h.core", "h.orientation", "h.start", "h.end", "h.edits", (inner & near).alias("internal_near_join"))


@plan("f32_claim_check", """WITH t AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_extract_all(text, '[a-z]{7,}')) AS w FROM conversations),
 u AS (SELECT conv_id, w, min(turn) AS first FROM t WHERE role = 'user' GROUP BY ALL) SELECT c.conv_id, c.turn, count(t.w) AS claims, count(t.w) FILTER (u.first IS NULL OR u.first > c.turn) AS unsupported FROM conversations c
 LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn LEFT JOIN u ON u.conv_id = t.conv_id AND u.w = t.w WHERE c.role = 'assistant' GROUP BY ALL""")
def f32(spark, sf):
    turns = table(spark, sf, "conversations")
    return claim_check(turns.where("role = 'assistant'"), turns.where("role = 'user'"), "conv_id", "turn", "text", "([a-z]{7,})")


def claim_check(claims, sources, case: str, order: str, text: str, pattern: str):
    """Tokens of a claim that no earlier source of its case contains; tokens are joined, not listed."""
    tokens = lambda df: df.select(case, order, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("w"))
    first = tokens(sources).groupBy(case, "w").agg(F.min(order).alias("_first"))
    found = tokens(claims).join(first, [case, "w"], "left")
    counted = found.groupBy(case, order).agg(F.count("*").alias("claims"), F.count_if(F.col("_first").isNull() | (F.col("_first") > F.col(order))).alias("unsupported"))
    zero = F.lit(0).cast("long")
    return claims.select(case, order).join(counted, [case, order], "left").select(case, order, F.coalesce("claims", zero).alias("claims"), F.coalesce("unsupported", zero).alias("unsupported"))


# Named evidence checks, run over all pairs at once.
EVIDENCE_CHECKS = {
    "support": lambda pairs: pairs.select("pair_id", F.coalesce(F.col("long_read_support").cast("string"), F.lit("unknown")).alias("output")),
    "separation": lambda pairs: pairs.select("pair_id", F.when(F.col("is_interchromosomal") == 1, "interchromosomal").otherwise(F.col("genomic_distance").cast("string")).alias("output")),
    "contact": lambda pairs: pairs.where("contact IS NOT NULL").select("pair_id", F.lit("measured").alias("output")),
}


def run_checks(pairs, names, limit: int = 8):
    """Union of the named checks; at most ``limit`` checks per case, as the reviewers agreed."""
    if len(names) > limit or set(names) - set(EVIDENCE_CHECKS):
        raise ValueError("unknown check or too many checks")
    out = None
    for name in names:
        rows = EVIDENCE_CHECKS[name](pairs).select("pair_id", F.lit(name).alias("check"), "output")
        out = rows if out is None else out.union(rows)
    return out


@plan("x2_named_checks", sql(V.READS, V.PAIRS, tail="""SELECT pair_id, 'support' AS "check", coalesce(CAST(long_read_support AS VARCHAR), 'unknown') AS output FROM pairs
 UNION ALL SELECT pair_id, 'separation', CASE WHEN is_interchromosomal = 1 THEN 'interchromosomal' ELSE CAST(genomic_distance AS VARCHAR) END FROM pairs UNION ALL SELECT pair_id, 'contact', 'measured' FROM pairs WHERE contact IS NOT NULL"""))
def x2(spark, sf):
    return run_checks(V.pairs(spark, sf), ["support", "separation", "contact"])


@plan("t3_eligibility_ledger", """WITH r AS (SELECT l_partkey AS j, bool_or(l_quantity = 50) AS supported, count(*) FILTER (l_returnflag = 'R') AS recs, count(DISTINCT l_orderkey) AS reads, count(DISTINCT l_suppkey % 2) FILTER (l_discount = 0) AS seqs, count(*) FILTER (l_tax = 0.08 AND l_discount = 0.1) AS unresolved FROM lineitem GROUP BY 1),
 q AS (SELECT *, CASE WHEN NOT supported THEN ['RNA_evidence_not_supported'] WHEN recs = 0 THEN ['outside_reconstruction_batch_or_missing_read'] ELSE list_filter([CASE WHEN recs * 2 < reads THEN 'supporting_read_reconstruction_incomplete' END, CASE WHEN unresolved > 0 THEN 'unresolved_sequence_in_supporting_reads' END, CASE WHEN seqs = 0 THEN 'no_complete_junction_spanning_ORF' END, CASE WHEN seqs > 1 THEN 'conflicting_primary_protein_sequences_across_reads' END], lambda x: x IS NOT NULL) END AS reasons FROM r)
 SELECT j, array_to_string(reasons, ';') AS reasons, CASE WHEN NOT supported THEN 'unresolved_RNA_evidence' WHEN recs = 0 THEN 'deferred_reconstruction_batch' WHEN len(reasons) > 0 THEN 'unresolved_protein_sequence_or_complete_ORF' ELSE 'eligible' END AS disposition FROM q""")
def t3(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("j"), "l_orderkey").agg(
        F.max(F.col("l_quantity") == 50).alias("supported"), F.count_if(F.col("l_returnflag") == "R").alias("recs"),
        F.min(F.when(F.col("l_discount") == 0, F.col("l_suppkey") % 2)).alias("lo"), F.max(F.when(F.col("l_discount") == 0, F.col("l_suppkey") % 2)).alias("hi"),
        F.count_if((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)).alias("unresolved")).groupBy("j").agg(
        F.max("supported").alias("supported"), F.sum("recs").alias("recs"), F.count("*").alias("reads"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("unresolved").alias("unresolved"))
    return eligibility(r)


def eligibility(r):
    """Every blocking reason and one disposition per junction (fixed values: their names)."""
    more = rollup.reason_list({
        "supporting_read_reconstruction_incomplete": F.col("recs") * 2 < F.col("reads"), "unresolved_sequence_in_supporting_reads": F.col("unresolved") > 0,
        "no_complete_junction_spanning_ORF": F.col("lo").isNull(), "conflicting_primary_protein_sequences_across_reads": F.col("lo") != F.col("hi")})
    reasons = (F.when(~F.col("supported"), F.array(F.lit("RNA_evidence_not_supported")))
               .when(F.col("recs") == 0, F.array(F.lit("outside_reconstruction_batch_or_missing_read"))).otherwise(more))
    out = r.withColumn("_r", reasons)
    category = (F.when(~F.col("supported"), "unresolved_RNA_evidence").when(F.col("recs") == 0, "deferred_reconstruction_batch")
                .when(F.size("_r") > 0, "unresolved_protein_sequence_or_complete_ORF").otherwise("eligible"))
    return out.select("j", F.array_join("_r", ";").alias("reasons"), category.alias("disposition"))
