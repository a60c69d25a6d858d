"""Projections, predicates, contracts, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.operators import contracts as C
from tallyarc.operators import decisions as D
from tallyarc.operators import joins as J
from tallyarc.operators import rollup
from tallyarc.operators.scan import following
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql


@plan("p1_provenance_columns", """SELECT l_orderkey || '/' || l_linenumber AS read_id, l_partkey || ':' || l_suppkey AS pair_id,
 CAST(l_quantity AS BIGINT) AS breakpoint1, 'A1' AS assembly, 'table_3' AS source_id, CAST(NULL AS VARCHAR) AS sample_id FROM lineitem""")
def p1(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("read_id"),
        F.concat_ws(":", "l_partkey", "l_suppkey").alias("pair_id"), F.col("l_quantity").cast("long").alias("breakpoint1"),
        F.lit("A1").alias("assembly"), F.lit("table_3").alias("source_id"), F.lit(None).cast("string").alias("sample_id"))


_RULES_SQL = """count(*) FILTER (pair_id IS NULL) AS null_pair_id, count(*) FILTER (parent_a IS NULL OR parent_b IS NULL) AS null_parent,
 count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS label_not_binary,
 count(*) FILTER (is_interchromosomal IS NULL OR is_interchromosomal NOT IN (0, 1)) AS chromosome_flag_not_binary,
 count(*) FILTER (isinf(CAST(long_read_support AS DOUBLE))) AS infinite_long_read_support,
 count(*) FILTER (isinf(sample_count)) AS infinite_sample_count, count(*) FILTER (isinf(CAST(genomic_distance AS DOUBLE))) AS infinite_genomic_distance,
 count(*) FILTER (long_read_support < 0) AS negative_long_read_support, count(*) FILTER (sample_count < 0) AS negative_sample_count,
 count(*) FILTER (genomic_distance < 0) AS negative_genomic_distance"""


@plan("p2_pair_contract", sql("rows_ AS (SELECT 'P' || l_partkey AS pair_id, 'P' || l_partkey AS parent_a, nullif('S' || l_suppkey, 'S7') AS parent_b, l_linenumber % 3 AS label, CAST(l_quantity - 5 AS DOUBLE) AS long_read_support, l_discount / nullif(l_tax, 0) AS sample_count, CAST(l_returnflag = 'R' AS INT) AS is_interchromosomal, l_partkey - 100 AS genomic_distance FROM lineitem)",
     tail="SELECT count(*) - count(DISTINCT pair_id) AS duplicate_key, " + _RULES_SQL + " FROM rows_"))
def p2(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat('P', l_partkey) AS pair_id", "concat('P', l_partkey) AS parent_a",
        "nullif(concat('S', l_suppkey), 'S7') AS parent_b", "l_linenumber % 3 AS label", "l_quantity - 5 AS long_read_support",
        "l_discount / nullif(l_tax, 0D) AS sample_count", "CAST(l_returnflag = 'R' AS INT) AS is_interchromosomal",
        "l_partkey - 100 AS genomic_distance")
    C.require_columns(rows, C.PAIR_COLUMNS)
    return C.violations(rows, C.pair_rules(), key="pair_id")


@plan("p3_evidence_contract", sql(V.EVIDENCE, tail=f"""SELECT count(*) FILTER (state NOT IN ({", ".join(repr(s) for s in V.STATES[:5])})) AS unknown_state,
 count(*) FILTER (caller NOT IN ({", ".join(repr(s) for s in V.SOURCES[:4])})) AS unknown_source,
 count(*) FILTER (margin IS NULL) AS unknown_margin,
 (SELECT count(*) FROM (SELECT sample_id FROM evidence GROUP BY 1 HAVING count(DISTINCT specimen_id) > 1)) AS sample_with_many_specimens FROM evidence"""))
def p3(spark, sf):
    """State and source lists are narrowed so that the counters have something to count."""
    rows = V.evidence(spark, sf)
    C.require_columns(rows, ["junction_id", "sample_id", "specimen_id", "read_id", "state", "mapping_specific", "margin",
                             "anchor", "caller"], closed=True)
    counts = C.violations(rows, {"unknown_state": ~F.col("state").isin(V.STATES[:5]),
                                 "unknown_source": ~F.col("caller").isin(V.SOURCES[:4]),
                                 "unknown_margin": F.col("margin").isNull()})
    many = (rows.select("sample_id", "specimen_id").distinct().groupBy("sample_id").count().where("count > 1")
            .agg(F.count("*").alias("n")))
    return counts.withColumn("sample_with_many_specimens", many.scalar())


@plan("p4_cohort_identity", r"""SELECT count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')) AS bad_accession,
 count(*) FILTER (o_totalprice <= 1000) AS non_positive_count, count(DISTINCT o_orderstatus) AS statuses,
 count(*) - count(DISTINCT o_orderkey) AS repeated_runs FROM orders""")
def p4(spark, sf):
    o = table(spark, sf, "orders")
    counts = C.violations(o, {"bad_accession": ~F.col("o_orderpriority").rlike("^[1-3]-[A-Z]+$"),
                              "non_positive_count": F.col("o_totalprice") <= 1000}, key="o_orderkey")
    statuses = o.agg(F.count_distinct("o_orderstatus").alias("n"))
    return counts.withColumnRenamed("duplicate_key", "repeated_runs").withColumn("statuses", statuses.scalar())


@plan("p5_exclusion_reason", """SELECT o_orderkey, coalesce(c.reason, CASE WHEN o_totalprice < 50000 THEN 'unresolved'
 WHEN o_orderstatus = 'P' THEN 'pending' ELSE '' END) AS exclusion_reason FROM orders LEFT JOIN (SELECT c_custkey,
 CASE WHEN c_acctbal < 0 THEN 'ambiguous_identity' WHEN c_mktsegment = 'MACHINERY' THEN 'control' END AS reason FROM customer) c ON c_custkey = o_custkey""")
def p5(spark, sf):
    own = rollup.first_reason({"unresolved": F.col("o_totalprice") < 50000, "pending": F.col("o_orderstatus") == "P"}, "")
    by_key = table(spark, sf, "customer").select("c_custkey", rollup.first_reason(
        {"ambiguous_identity": F.col("c_acctbal") < 0, "control": F.col("c_mktsegment") == "MACHINERY"}).alias("reason"))
    orders = table(spark, sf, "orders")
    return orders.join(by_key, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", F.coalesce("reason", own).alias("exclusion_reason"))


@plan("p6_feature_projection", sql(V.READS, V.PAIRS, tail="""SELECT pair_id, round(ln(1 + long_read_support), 6) AS log_read_support,
 CAST(is_interchromosomal AS DOUBLE) AS is_interchromosomal,
 round(ln(1 + CASE WHEN is_interchromosomal = 0 THEN genomic_distance ELSE 0 END), 6) AS log_genomic_distance,
 round(log2(0.5 + contact), 6) AS hic_feature FROM pairs"""))
def p6(spark, sf):
    cols = D.feature_columns()
    return V.pairs(spark, sf).select("pair_id", *[
        (c if n == "is_interchromosomal" else F.round(c, 6)).alias(n) for n, c in cols.items()])


@plan("p8_alias_map", """SELECT c_custkey, coalesce(a.alias, 'NATION_' || c_nationkey) AS key FROM customer LEFT JOIN
 (SELECT n_name, 'REGION_' || n_regionkey AS alias FROM nation WHERE n_regionkey IN (1, 3)) a ON n_name = 'NATION_' || c_nationkey""")
def p8(spark, sf):
    alias = table(spark, sf, "nation").where("n_regionkey IN (1, 3)").selectExpr("n_name AS key", "concat('REGION_', n_regionkey) AS alias")
    keyed = table(spark, sf, "customer").selectExpr("c_custkey", "concat('NATION_', c_nationkey) AS key")
    return keyed.join(alias, "key", "left").select("c_custkey", F.coalesce("alias", "key").alias("key"))


@plan("p9_explorer_query", """SELECT doc_id, quality AS label, CASE WHEN toxic = 0 THEN n_chars END AS score FROM documents LEFT JOIN labels USING (doc_id)
 WHERE contains(lower(source || ' ' || text), 'en') AND quality IS NULL
 UNION ALL SELECT doc_id, quality, CASE WHEN toxic = 0 THEN n_chars END FROM documents LEFT JOIN labels USING (doc_id)
 WHERE contains(lower(source || ' ' || text), 'the') AND quality = 1 AND CASE WHEN toxic = 0 THEN n_chars END IS NOT NULL""")
def p9(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.concat_ws(" ", "source", "text").alias("name"), F.col("quality").alias("label"),
        F.when(F.col("toxic") == 0, F.col("n_chars")).alias("score"))
    unknown = explore(docs, "EN", "unknown", None)
    positive = explore(docs, "the", "1", "score")
    return unknown.unionAll(positive).select("doc_id", "label", "score")


def explore(df, needle: str, label: str, sort_by: str | None):
    """Substring in any case, label in all/1/0/unknown, and a score where rows are sorted by it."""
    out = df.where(F.lower("name").contains(needle.lower()))
    if label == "unknown":
        out = out.where(F.col("label").isNull())
    elif label != "all":
        out = out.where(F.col("label") == int(label))
    return out.where(F.col(sort_by).isNotNull()) if sort_by else out


@plan("p10_evidence_tiers", sql(V.SPLITS, tail="""SELECT row_id, unnest(list_filter([
 CASE WHEN mapq >= 20 AND (caller = 'LongGF' OR statistic < 0.05) THEN 'primary' END,
 CASE WHEN mapq >= 20 THEN 'exploratory' END, 'all'], lambda x: x IS NOT NULL)) AS tier FROM splits"""))
def p10(spark, sf):
    return V.splits(spark, sf).select("row_id", F.explode(D.tiers(
        F.col("mapq") >= 20, F.col("statistic") < 0.05, F.col("caller") != "LongGF")).alias("tier"))


DECISION_SQL = """d0 AS (SELECT *, coalesce(margin <= greatest(20, 0.05 * span), false) AS close FROM splits),
 d1 AS (SELECT *, list_filter([CASE WHEN genes_left <> 1 OR genes_right <> 1 THEN 'multiple_genes' END,
 CASE WHEN mapq < 20 THEN 'low_mapq' END, CASE WHEN competitors > 0 THEN 'alternative_placement' END,
 CASE WHEN coverage < 0.8 THEN 'low_coverage' END, CASE WHEN abs(query_gap) > 20 THEN 'query_gap' END,
 CASE WHEN close THEN 'single_score_close' END], lambda x: x IS NOT NULL) AS failed,
 close AND coalesce(single_coverage >= 0.9, false) AS explained, shorter_anchor < 100 OR shorter_overlap < 100 AS short FROM d0)"""


@plan("p11_read_decision", sql(V.SPLITS, DECISION_SQL, tail="""SELECT row_id,
 CASE WHEN explained THEN 'single_transcript_explained' WHEN short THEN 'insufficient_anchor'
 WHEN len(failed) > 0 THEN 'ambiguous_single_vs_split' ELSE 'supported_two_gene_junction' END AS state,
 CASE WHEN explained THEN 'single_transcript_covers_window' WHEN short THEN 'short_anchor'
 WHEN len(failed) > 0 THEN array_to_string(failed, ';') ELSE 'meets_all_criteria' END AS reasons FROM d1"""))
def p11(spark, sf):
    d = D.read_decision()
    return V.splits(spark, sf).select("row_id", d["state"].alias("state"), F.array_join(d["reasons"], ";").alias("reasons"))


@plan("p12_mapping_specific", sql(V.SPLITS, tail="""SELECT row_id, mapq >= 20 AND competitors = 0 AND genes_left = 1 AND genes_right = 1
 AS mapping_specific FROM splits"""))
def p12(spark, sf):
    return V.splits(spark, sf).select("row_id", D.mapping_specific().alias("mapping_specific"))


@plan("p13_caller_gates", sql(V.SPLITS, tail="""SELECT row_id, least(mapq, mapq2) >= 20 AND least(arm1, arm2) >= 100 AS longgf_pass,
 least(mapq, mapq2) >= 20 AND least(arm1, arm2) >= 100 AND query_gap >= -25 AS genion_pass FROM splits"""))
def p13(spark, sf):
    return V.splits(spark, sf).select("row_id", D.caller_gate("mapq", "mapq2", "arm1", "arm2").alias("longgf_pass"),
                                      D.caller_gate("mapq", "mapq2", "arm1", "arm2", "query_gap").alias("genion_pass"))


@plan("p14_out_of_range_flags", sql(V.READS, V.PAIRS, tail="""SELECT pair_id,
 long_read_support < (SELECT min(long_read_support) FROM pairs WHERE label = 1) OR long_read_support > (SELECT max(long_read_support) FROM pairs WHERE label = 1) AS support_out,
 genomic_distance < (SELECT min(genomic_distance) FROM pairs WHERE label = 1) OR genomic_distance > (SELECT max(genomic_distance) FROM pairs WHERE label = 1) AS distance_out
 FROM pairs WHERE label = 0"""))
def p14(spark, sf):
    pairs = V.pairs(spark, sf)
    panel = pairs.where("label = 1")

    def outside(column):
        low, high = panel.agg(F.min(column)).scalar(), panel.agg(F.max(column)).scalar()
        return (F.col(column) < low) | (F.col(column) > high)

    return pairs.where("label = 0").select("pair_id", outside("long_read_support").alias("support_out"),
                                           outside("genomic_distance").alias("distance_out"))


@plan("p15_short_read_gates", sql(V.SPLITS, tail="""SELECT CASE WHEN genes_left <> 1 THEN 'discordant_or_unoriented' WHEN competitors > 0 THEN 'repeat_ambiguous'
 WHEN genes_right <> 1 OR margin IS NULL OR margin < 10 THEN 'ambiguous_or_low_margin' ELSE 'qualifying_records' END AS outcome, count(*) AS n
 FROM splits GROUP BY 1"""))
def p15(spark, sf):
    outcome = rollup.first_reason({
        "discordant_or_unoriented": F.col("genes_left") != 1, "repeat_ambiguous": F.col("competitors") > 0,
        "ambiguous_or_low_margin": (F.col("genes_right") != 1) | F.col("margin").isNull() | (F.col("margin") < 10)},
        "qualifying_records")
    return V.splits(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@plan("p16_pair_record", sql(V.READS, V.PAIRS, tail="""SELECT pair_id, parent_a, parent_b, long_read_support, label FROM pairs
 ORDER BY long_read_support DESC NULLS LAST, pair_id LIMIT 1"""))
def p16(spark, sf):
    pairs = V.pairs(spark, sf)
    best = pairs.orderBy(F.desc_nulls_last("long_read_support"), "pair_id").limit(1).select("pair_id").first()[0]
    return pair_record(pairs, best).select("pair_id", "parent_a", "parent_b", "long_read_support", "label")


def pair_record(pairs, pair_id: str):
    """The one record of a pair; a missing or repeated pair fails."""
    found = pairs.where(F.col("pair_id") == pair_id)
    n = found.limit(2).count()
    if n != 1:
        raise C.ContractError(f"{pair_id}: expected one record, found {'none' if n == 0 else 'several'}")
    return found


@plan("p17_partition_guard", "SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de'")
def p17(spark, sf):
    """German items stand for the held-out partition."""
    rows = V.scored(spark, sf).withColumn("partition", F.when(F.col("lang") == "de", "heldout").otherwise("development"))
    return partition_rows(rows, "development").select("doc_id", "quality")


def partition_rows(df, name: str, allow_heldout: bool = False):
    if name == "heldout" and not allow_heldout:
        raise C.ContractError("held-out rows need the explicit flag")
    return df.where(F.col("partition") == name)


@plan("p18_named_constraints", sql("""alt AS (SELECT l_orderkey, [l_quantity >= 10, l_discount <= 0.08, l_tax <= 0.07] AS checks,
 CAST(l_suppkey % 3 AS VARCHAR) AS sequence FROM lineitem)""", tail="""SELECT l_orderkey, count(*) AS alternatives,
 count(*) FILTER (list_bool_and(checks)) AS accepted,
 CASE WHEN count(DISTINCT sequence) FILTER (list_bool_and(checks)) = 1 THEN min(sequence) FILTER (list_bool_and(checks)) END AS agreed_sequence
 FROM alt GROUP BY l_orderkey"""))
def p18(spark, sf):
    checks = F.create_map(F.lit("anchor"), F.col("l_quantity") >= 10, F.lit("discount"), F.col("l_discount") <= 0.08,
                          F.lit("tax"), F.col("l_tax") <= 0.07)
    alt = table(spark, sf, "lineitem").select("l_orderkey", checks.alias("checks"), F.expr("CAST(l_suppkey % 3 AS STRING)").alias("sequence"))
    ok = F.forall(F.map_values("checks"), lambda c: c)
    per = alt.withColumn("ok", ok).groupBy("l_orderkey").agg(
        F.count("*").alias("alternatives"), F.count_if("ok").alias("accepted"),
        F.min(F.when(F.col("ok"), F.col("sequence"))).alias("_lo"), F.max(F.when(F.col("ok"), F.col("sequence"))).alias("_hi"))
    return per.select("l_orderkey", "alternatives", "accepted", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("agreed_sequence"))


@plan("p19_eligible_controls", """SELECT l_orderkey || '/' || l_linenumber AS control_id, l_quantity,
 o.o_orderkey IS NOT NULL AND c.c_custkey IS NOT NULL AND l_quantity >= 30 AS eligible FROM lineitem
 LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey
 LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def p19(spark, sf):
    valid = table(spark, sf, "orders").where("o_orderstatus <> 'P'").join(
        table(spark, sf, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    flagged = J.member_flags(rows, "l_orderkey", {"linked": valid.select("o_orderkey")})
    return flagged.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("control_id"), "l_quantity",
                          (F.col("linked") & (F.col("l_quantity") >= 30)).alias("eligible"))


@plan("j1_one_to_one_join", sql(V.READS, V.PAIRS, tail="""SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""))
def j1(spark, sf):
    cust = table(spark, sf, "customer").selectExpr("c_custkey AS o_custkey", "c_mktsegment", "c_acctbal")
    return J.join_one_to_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), cust, ["o_custkey"]).drop("o_custkey")


@plan("j2_membership_flags", """SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40) AS returned,
 EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) AS discounted FROM part""")
def j2(spark, sf):
    line = table(spark, sf, "lineitem")
    return J.member_flags(table(spark, sf, "part").select("p_partkey"), "p_partkey", {
        "returned": line.where("l_returnflag = 'R' AND l_quantity > 40").select("l_partkey"),
        "discounted": line.where("l_discount > 0.09").select("l_partkey")})


@plan("j3_missing_and_extra", """SELECT l_orderkey AS key, 'missing' AS side FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
 SELECT o_orderkey, 'extra' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j3(spark, sf):
    return J.missing_and_extra(table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS key"),
                               table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS key"), "key")


@plan("j4_unresolved_proposals", sql(V.READS, tail="""SELECT DISTINCT l_orderkey, pair_id FROM reads r WHERE caller = 'F' AND NOT EXISTS
 (SELECT 1 FROM reads d WHERE d.l_orderkey = r.l_orderkey AND d.pair_id = r.pair_id AND d.anchor >= 20)"""))
def j4(spark, sf):
    r = V.reads(spark, sf)
    return r.where("caller = 'F'").select("l_orderkey", "pair_id").distinct().join(
        r.where("anchor >= 20").select("l_orderkey", "pair_id"), ["l_orderkey", "pair_id"], "left_anti")


@plan("j5_match_class", """WITH cat AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_returnflag = 'R'),
 q AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_returnflag <> 'R')
 SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM cat WHERE cat.a = q.a AND cat.b = q.b) THEN 'exact'
 WHEN EXISTS (SELECT 1 FROM cat WHERE cat.a = q.b AND cat.b = q.a) THEN 'reverse_name_only' ELSE 'absent' END AS match FROM q""")
def j5(spark, sf):
    keys = table(spark, sf, "lineitem").selectExpr("l_suppkey AS a", "l_partkey % 100 AS b", "l_returnflag")
    return J.match_class(keys.where("l_returnflag <> 'R'").select("a", "b").distinct(),
                         keys.where("l_returnflag = 'R'"), "a", "b")


@plan("j6_catalogue_union", """WITH s AS (SELECT l_partkey * 100000 + l_suppkey AS key, count(*) AS support FROM lineitem WHERE l_quantity >= 25 GROUP BY 1),
 p AS (SELECT l_partkey * 100000 + l_suppkey AS key, count(*) AS probes FROM lineitem WHERE l_quantity < 25 GROUP BY 1)
 SELECT key, support, probes, p.key IS NOT NULL AS in_panel FROM s FULL JOIN p USING (key)""")
def j6(spark, sf):
    line = table(spark, sf, "lineitem")
    key = (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("key")
    s = line.where("l_quantity >= 25").groupBy(key).agg(F.count("*").alias("support"))
    p = line.where("l_quantity < 25").groupBy(key).agg(F.count("*").alias("probes"), F.lit(True).alias("_in"))
    return s.join(p, "key", "full_outer").withColumn("in_panel", F.col("_in").isNotNull()).drop("_in")


@plan("j7_record_comparison", """WITH a AS (SELECT l_orderkey AS id, max(l_quantity) AS x, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 b AS (SELECT l_orderkey AS id, max(l_quantity) AS x, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
 r AS (SELECT id, unnest(list_filter([CASE WHEN a.n IS NULL THEN 'only_in_second' END, CASE WHEN b.n IS NULL THEN 'only_in_first' END,
 CASE WHEN a.x <> b.x THEN 'x_differs' END, CASE WHEN a.n <> b.n THEN 'n_differs' END], lambda v: v IS NOT NULL)) AS reason FROM a FULL JOIN b USING (id))
 SELECT reason, rows, id AS example, rn AS example_rank FROM (SELECT reason, id, count(*) OVER (PARTITION BY reason) AS rows,
 row_number() OVER (PARTITION BY reason ORDER BY id) AS rn FROM r) WHERE rn <= 3""")
def j7(spark, sf):
    line = table(spark, sf, "lineitem")

    def side(status):
        return line.where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("id")).agg(
            F.max("l_quantity").alias("x"), F.count("*").alias("n"))

    reasons = J.compare_records(side("F"), side("O"), "id", ["x", "n"])
    return reason_examples(reasons, "id", 3)


def reason_examples(reasons, key: str, k: int):
    """Counts per reason with the k lowest ids as examples; both parts combine on the map side."""
    from pyspark.sql import Window

    counts = reasons.groupBy("reason").agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(key))
    first = reasons.withColumn("example_rank", rank).where(F.col("example_rank") <= k)  # planned as a group limit
    return first.join(counts, "reason").select("reason", "rows", F.col(key).alias("example"), F.col("example_rank").cast("long").alias("example_rank"))


@plan("j12_product_within_key", """SELECT a.l_orderkey, count(*) AS combinations, max(a.l_quantity + b.l_quantity) AS best,
 count(*) FILTER (a.l_suppkey = b.l_suppkey) AS same_gene FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'F' AND b.l_linestatus = 'O' GROUP BY 1""")
def j12(spark, sf):
    line = table(spark, sf, "lineitem")
    left = line.where("l_linestatus = 'F'").selectExpr("l_orderkey", "l_suppkey AS ls", "l_quantity AS lq")
    right = line.where("l_linestatus = 'O'").selectExpr("l_orderkey", "l_suppkey AS rs", "l_quantity AS rq")
    return J.product_within(left, right, ["l_orderkey"], "ls", "rs").groupBy("l_orderkey").agg(
        F.count("*").alias("combinations"), F.max(F.col("lq") + F.col("rq")).alias("best"),
        F.count_if(F.col("ls") == F.col("rs")).alias("same_gene"))


@plan("j13_adjacent_rows", """SELECT event_id, lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS next_event_type
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def j13(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return following(ev, [F.col("ts"), F.col("event_id")], ["user_id"], ["event_id", "event_type"]).select(
        "event_id", "next_event_id", "next_event_type")


@plan("j16_lockstep_completeness", """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
 SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both_sources, count(*) FILTER (b.k IS NULL) AS only_first,
 count(*) FILTER (a.k IS NULL) AS only_second FROM a FULL JOIN b ON a.k = b.k""")
def j16(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("_a", F.lit(1))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("_b", F.lit(1))
    return a.join(b, "k", "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both_sources"),
        F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))


@plan("j18_pairs_within_group", """WITH m AS (SELECT l_orderkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, l_returnflag, l_quantity FROM lineitem)
 SELECT a.l_orderkey, CASE WHEN a.l_returnflag = b.l_returnflag THEN 'same_protocol' ELSE 'cross_protocol' END AS category,
 count(*) AS pairs, round(avg(abs(a.l_quantity - b.l_quantity)), 6) AS mean_difference, max(abs(a.l_quantity - b.l_quantity)) AS max_difference
 FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.id < b.id GROUP BY ALL""")
def j18(spark, sf):
    m = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                                            "l_returnflag", "l_quantity")
    pairs = J.pairs_within(m, ["l_orderkey"], "id", ["l_returnflag", "l_quantity"])
    gap = F.abs(F.col("a_l_quantity") - F.col("b_l_quantity"))
    category = F.when(F.col("a_l_returnflag") == F.col("b_l_returnflag"), "same_protocol").otherwise("cross_protocol")
    return pairs.groupBy("l_orderkey", category.alias("category")).agg(
        F.count("*").alias("pairs"), F.round(F.avg(gap), 6).alias("mean_difference"), F.max(gap).alias("max_difference"))


@plan("j19_nearest_counterpart", """WITH probe AS (SELECT l_partkey, l_linestatus, min(l_quantity) AS b1, max(l_suppkey) AS b2 FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
 j AS (SELECT DISTINCT l_partkey, l_linestatus, l_quantity, l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag <> 'R'),
 o AS (SELECT probe.l_partkey, probe.l_linestatus, l_quantity - b1 AS o1, l_suppkey - b2 AS o2, l_orderkey FROM probe JOIN j ON j.l_partkey = probe.l_partkey AND j.l_linestatus = probe.l_linestatus)
 SELECT l_partkey, l_linestatus, count(*) AS candidates, min(greatest(abs(o1), abs(o2))) AS closest,
 arg_min(o1, {'m': greatest(abs(o1), abs(o2)), 'k': l_orderkey, 'a': o1, 'b': o2}) AS offset1 FROM o GROUP BY ALL""")
def j19(spark, sf):
    line = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_linestatus"]
    probe = line.where("l_returnflag = 'R'").groupBy(*keys).agg(F.min("l_quantity").alias("b1"), F.max("l_suppkey").alias("b2"))
    found = line.where("l_returnflag <> 'R'").select(*keys, "l_quantity", "l_suppkey", "l_orderkey").distinct()
    o1, o2 = F.col("l_quantity") - F.col("b1"), (F.col("l_suppkey") - F.col("b2"))
    worst = F.greatest(F.abs(o1), F.abs(o2).cast("double"))
    return probe.join(found, keys).groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.min(worst).alias("closest"),
        F.min_by(o1, F.struct(worst.alias("m"), F.col("l_orderkey"), o1.alias("a"), o2.alias("b"))).alias("offset1"))


@plan("j21_corroboration", sql(V.READS, """lib AS (SELECT DISTINCT pair_id, caller, CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN 'cis' ELSE 'trans' END AS s FROM reads),
 st AS (SELECT *, unnest(['overall', s]) AS stratum FROM lib), sd AS (SELECT stratum, pair_id, max(CAST(caller = 'F' AS INT)) AS a, max(CAST(caller = 'O' AS INT)) AS b FROM st GROUP BY ALL)""",
     tail="""SELECT stratum, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS shared, count(*) AS either,
 round(sum(a * b) / sum(a), 6) AS a_to_b, round(sum(a * b) / sum(b), 6) AS b_to_a FROM sd GROUP BY stratum"""))
def j21(spark, sf):
    r = V.reads(spark, sf).select("pair_id", "caller", (F.col("l_partkey") % 3 == F.col("l_suppkey") % 3).alias("cis"))
    out = J.corroboration(r.where("caller = 'F'").drop("caller"), r.where("caller = 'O'").drop("caller"), "pair_id", {
        "overall": F.lit(True), "cis": F.col("cis"), "trans": ~F.col("cis")})
    return out.withColumns({c: F.round(c, 6) for c in ("a_to_b", "b_to_a")})


@plan("j22_wide_evidence", """SELECT o_orderkey, o_orderstatus, a.*, coalesce(has_a, false) AS "has_A", coalesce(has_n, false) AS "has_N", coalesce(has_r, false) AS "has_R" FROM orders LEFT JOIN (SELECT l_orderkey,
 max(l_quantity) FILTER (l_returnflag = 'A') AS "A_l_quantity", max(l_discount) FILTER (l_returnflag = 'A') AS "A_l_discount",
 max(l_quantity) FILTER (l_returnflag = 'N') AS "N_l_quantity", max(l_discount) FILTER (l_returnflag = 'N') AS "N_l_discount",
 max(l_quantity) FILTER (l_returnflag = 'R') AS "R_l_quantity", max(l_discount) FILTER (l_returnflag = 'R') AS "R_l_discount",
 bool_or(l_returnflag = 'A') AS has_a, bool_or(l_returnflag = 'N') AS has_n, bool_or(l_returnflag = 'R') AS has_r FROM lineitem GROUP BY l_orderkey) b ON b.l_orderkey = o_orderkey
 """.replace("a.*", '"A_l_quantity", "A_l_discount", "N_l_quantity", "N_l_discount", "R_l_quantity", "R_l_discount"'))
def j22(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    metrics = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.wide_metrics(base, metrics, "o_orderkey", "l_returnflag", ["l_quantity", "l_discount"], ["A", "N", "R"])


@plan("j23_ledger_status", """SELECT o_orderkey AS job_id, coalesce(status, 'pending') AS status FROM orders LEFT JOIN
 (SELECT l_orderkey, max(l_linestatus) AS status FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey""")
def j23(spark, sf):
    history = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max("l_linestatus").alias("status"))
    return J.ledger_status(table(spark, sf, "orders").selectExpr("o_orderkey AS job_id"), history, "job_id", "status")


@plan("j24_ledger_merge", """SELECT l_orderkey AS job_id, arg_max(l_linestatus, o) AS status, arg_max(l_quantity, o) AS metric FROM (
 SELECT *, {'v': CAST(l_linestatus = 'F' AS INT), 'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_shipdate} AS o FROM lineitem) GROUP BY 1""")
def j24(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "l_linestatus AS status", "l_quantity AS metric",
                                                   "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "l_shipdate AS d")
    return J.ledger_merge(rows, "job_id", F.col("status") == "F", [F.col("n"), F.col("p"), F.col("s"), F.col("d")]).select(
        "job_id", "status", "metric")


@plan("j25_outcome_comparison", """WITH pr AS (SELECT l_partkey AS pair_id, count(*) AS rows, count(DISTINCT l_orderkey) AS reads, min(l_quantity) AS c FROM lineitem GROUP BY 1)
 SELECT pair_id, rows, reads, p_size > 25 AS pair_outcome, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = pr.pair_id AND abs(l.l_quantity - pr.c) <= 1 AND l.l_returnflag = 'R') AS coordinate_agreement
 FROM pr LEFT JOIN part ON p_partkey = pair_id""")
def j25(spark, sf):
    """Pair outcome and coordinate agreement stay separate columns at their own grain."""
    line = table(spark, sf, "lineitem")
    per_read = line.groupBy(F.col("l_partkey").alias("pair_id"), "l_orderkey").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("c"))
    pairs = per_read.groupBy("pair_id").agg(F.sum("n").alias("rows"), F.count("*").alias("reads"), F.min("c").alias("c"))
    near = line.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("pair_id"), "l_quantity").agg(F.lit(1).alias("_x"))
    agree = near.join(pairs.select("pair_id", "c"), "pair_id").where(F.abs(F.col("l_quantity") - F.col("c")) <= 1).select(
        "pair_id").distinct().withColumn("_agree", F.lit(True))
    outcome = table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), (F.col("p_size") > 25).alias("pair_outcome"))
    return pairs.join(outcome, "pair_id", "left").join(agree, "pair_id", "left").select(
        "pair_id", "rows", "reads", "pair_outcome", F.coalesce("_agree", F.lit(False)).alias("coordinate_agreement"))


@plan("j27_read_trace", """SELECT o_orderkey AS record_id, CASE WHEN l.k IS NULL THEN 'not_in_sample' WHEN s.k IS NULL THEN 'not_split'
 WHEN p.k IS NULL THEN 'no_proposal' ELSE 'assessed' END AS stage FROM orders
 LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 10) l ON l.k = o_orderkey
 LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') s ON s.k = o_orderkey
 LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.07) p ON p.k = o_orderkey""")
def j27(spark, sf):
    line = table(spark, sf, "lineitem")
    rows = J.member_flags(table(spark, sf, "orders").selectExpr("o_orderkey AS record_id"), "record_id", {
        "in_sample": line.where("l_quantity > 10").select("l_orderkey"),
        "split": line.where("l_returnflag = 'R'").select("l_orderkey"),
        "proposed": line.where("l_discount > 0.07").select("l_orderkey")})
    return rows.select("record_id", rollup.first_reason({
        "not_in_sample": ~F.col("in_sample"), "not_split": ~F.col("split"), "no_proposal": ~F.col("proposed")}, "assessed").alias("stage"))


@plan("j28_boundary_review", """WITH a AS (SELECT l_suppkey AS species, l_orderkey AS read_id, min(l_partkey) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
 o AS (SELECT l_suppkey AS species, l_orderkey AS read_id, min(l_partkey) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
 SELECT species, read_id, o.b - a.b AS shift, abs(o.b - a.b) <= 10 AS within_10 FROM a JOIN o USING (species, read_id)""")
def j28(spark, sf):
    line = table(spark, sf, "lineitem")

    def side(status, name):
        return line.where(F.col("l_linestatus") == status).groupBy(
            F.col("l_suppkey").alias("species"), F.col("l_orderkey").alias("read_id")).agg(F.min("l_partkey").alias(name))

    shift = F.col("observed") - F.col("rebuilt")
    return side("F", "rebuilt").join(side("O", "observed"), ["species", "read_id"]).select(
        "species", "read_id", shift.alias("shift"), (F.abs(shift) <= 10).alias("within_10"))


@plan("u1_lossless_union", """SELECT o_orderkey AS id, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders
 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer""")
def u1(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS price").unionByName(
        table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance"), allowMissingColumns=True)


# Lists of part and supplier pairs, one for each return flag; every line is in one of them.
_LISTS = "WITH l AS (SELECT DISTINCT l_returnflag AS list, l_partkey * 100000 + l_suppkey AS k FROM lineitem) "
_PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))


def _lists(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag AS list", "l_partkey * 100000 + l_suppkey AS k").distinct()


def _pairs_of_lists(spark, sf, combine):
    """The result of ``combine`` for every two lists, with their names."""
    lists, out = _lists(spark, sf), None
    for x, y in _PAIRS:
        side = lambda name: lists.where(F.col("list") == name).select("k")
        rows = combine(side(x), side(y)).select(F.lit(x).alias("list_a"), F.lit(y).alias("list_b"), "k")
        out = rows if out is None else out.unionByName(rows)
    return out


@plan("u2_intersection", _LISTS + "SELECT x.list AS list_a, y.list AS list_b, x.k FROM l x JOIN l y ON x.k = y.k AND x.list < y.list")
def u2(spark, sf):
    return _pairs_of_lists(spark, sf, lambda a, b: a.intersect(b))


@plan("u3_difference", _LISTS + "SELECT x.list AS list_a, p.b AS list_b, x.k FROM l x JOIN (SELECT DISTINCT a.list AS a, b.list AS b FROM l a, l b WHERE a.list < b.list) p ON p.a = x.list WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.list = p.b AND y.k = x.k)")
def u3(spark, sf):
    return _pairs_of_lists(spark, sf, lambda a, b: a.join(b, "k", "left_anti"))


@plan("u4_distinct_by_columns", """SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS first_row, arg_min(l_quantity, {'o': l_orderkey, 'n': l_linenumber, 'q': l_quantity}) AS quantity
 FROM lineitem GROUP BY ALL""")
def u4(spark, sf):
    order = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first_row"), F.min_by("l_quantity", order).alias("quantity"))


@plan("u5_sorted_key_union", _LISTS + "SELECT DISTINCT k FROM l ORDER BY k")
def u5(spark, sf):
    lists = _lists(spark, sf)
    own = [lists.where(F.col("list") == name).select("k") for name in "ANR"]
    return own[0].union(own[1]).union(own[2]).distinct().orderBy("k")
