"""Support, evidence roll-up, tie ranks, top-k and average precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.operators import ranking as R
from tallyarc.operators import rollup
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql

SUPPORT = "support AS (SELECT pair_id, count(DISTINCT read_id) AS support FROM reads GROUP BY pair_id)"
STEPS = """steps AS (SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS cum_n,
 sum(pos) OVER (ORDER BY score DESC) AS cum_pos FROM (SELECT score, count(*) AS n, sum({label}) AS pos
 FROM {source} GROUP BY score))"""


@plan("evaluate_pair_support", sql(
    V.READS, SUPPORT,
    "panel AS (SELECT DISTINCT pair_id, support AS score, CAST(p_size > 25 AS INT) AS hit FROM reads JOIN support USING (pair_id) JOIN part ON p_partkey = l_partkey)",
    STEPS.format(label="hit", source="panel"),
    "tot AS (SELECT sum(n) AS n, sum(pos) AS p FROM steps)",
    tail="""SELECT CAST(tot.n AS BIGINT) AS n, CAST(p AS BIGINT) AS positives, CAST(20 AS BIGINT) AS k,
 round(cum_pos - pos + (20 - (cum_n - steps.n)) * pos / steps.n, 6) AS expected_hits,
 CAST(cum_pos - pos + greatest(0, (20 - (cum_n - steps.n)) - (steps.n - pos)) AS BIGINT) AS min_hits,
 CAST(cum_pos - pos + least(20 - (cum_n - steps.n), pos) AS BIGINT) AS max_hits,
 (SELECT round(sum(pos / p * cum_pos / cum_n), 6) FROM steps, tot) AS average_precision
 FROM steps, tot WHERE cum_n - steps.n < 20 AND 20 <= cum_n"""))
def evaluate_pair_support(spark, sf):
    panel = rollup.pair_support(V.reads(spark, sf), keep=["l_partkey"]).join(
        table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "CAST(p_size > 25 AS INT) AS hit"), "l_partkey")
    steps = R.score_steps(panel, "hit", "support")
    ap = R.average_precision(steps).select(F.round("average_precision", 6).alias("average_precision"))
    return R.topk(steps, 20).select("n", "positives", "k", F.round("expected_hits", 6).alias("expected_hits"),
                                    "min_hits", "max_hits").withColumn("average_precision", ap.scalar())


@plan("a1_pair_support", sql(V.READS, SUPPORT, tail="SELECT * FROM support"))
def a1(spark, sf):
    return rollup.pair_support(V.reads(spark, sf))


JUNCTION_KEYS = "pair_id, sample_id, caller"


@plan("a2_exact_junctions", sql(V.READS, tail=f"""SELECT {JUNCTION_KEYS}, count(DISTINCT read_id) AS support,
 count(*) AS source_rows, min(read_id) AS first_read, max(read_id) AS last_read FROM reads GROUP BY {JUNCTION_KEYS}"""))
def a2(spark, sf):
    return rollup.exact_junctions(V.reads(spark, sf), ["pair_id", "sample_id", "caller"])


@plan("a2_junction_members", sql(V.READS, tail=f"""SELECT {JUNCTION_KEYS}, read_id, count(*) AS source_rows,
 dense_rank() OVER (PARTITION BY {JUNCTION_KEYS} ORDER BY read_id) AS position
 FROM reads GROUP BY {JUNCTION_KEYS}, read_id"""))
def a2_members(spark, sf):
    """Sorted unique id list as child rows, so one list never has to fit in a row."""
    return rollup.junction_members(V.reads(spark, sf), ["pair_id", "sample_id", "caller"])


MOLECULES = """molecules AS (SELECT junction_id, sample_id, read_id, min(specimen_id) AS specimen_id, min(state) AS state,
 bool_and(mapping_specific) AS mapping_specific, min(margin) AS margin, min(anchor) AS anchor,
 list_sort(list_distinct(list(caller))) AS callers FROM evidence GROUP BY junction_id, sample_id, read_id)"""


@plan("a3_molecules", sql(V.EVIDENCE, MOLECULES, tail="""SELECT * EXCLUDE (callers),
 array_to_string(callers, ',') AS callers, CAST(len(callers) AS BIGINT) AS n_callers FROM molecules"""))
def a3(spark, sf):
    return (rollup.molecules(V.evidence(spark, sf))
            .withColumn("n_callers", F.size("callers").cast("long"))
            .withColumn("callers", F.array_join("callers", ",")))


_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS n_state_{i}" for i, s in enumerate(V.STATES))
_PRIORITY = "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(V.STATES)) + " END"
ROLLUP = f"""rolled AS (SELECT junction_id, arg_min(state, {_PRIORITY}) AS evidence_state,
 min({_PRIORITY}) AS state_order,
 count(DISTINCT specimen_id) FILTER (q) AS specimens, count(*) FILTER (q) AS qualifying_reads,
 count(*) FILTER (q AND mapping_specific) AS specific_reads,
 count(*) FILTER (q AND mapping_specific IS NULL) AS unknown_specific_reads,
 CASE WHEN count(margin) FILTER (q) = count(*) FILTER (q) THEN median(margin) FILTER (q) END AS median_margin,
 CASE WHEN count(anchor) FILTER (q) = count(*) FILTER (q) THEN median(anchor) FILTER (q) END AS median_anchor,
 count(*) AS assessed_reads, {_COUNTS}
 FROM (SELECT *, state = '{V.STATES[0]}' AS q FROM molecules) GROUP BY junction_id)"""
CALLED = f"""called AS (SELECT junction_id, list_sort(list_distinct(list(c))) AS sources FROM
 (SELECT junction_id, unnest(callers) AS c FROM molecules WHERE state = '{V.STATES[0]}') GROUP BY junction_id)"""
KNOWN = "[" + ",".join(f"'{c}'" for c in V.CALLERS) + "]"
FULL = f"""ranked_in AS (SELECT rolled.*, coalesce(sources, []) AS sources,
 list_filter(coalesce(sources, []), lambda x: list_contains({KNOWN}, x)) AS callers
 FROM rolled LEFT JOIN called USING (junction_id))"""


@plan("a4_junction_rollup", sql(V.EVIDENCE, MOLECULES, ROLLUP, CALLED, FULL, tail="""
 SELECT * EXCLUDE (sources, callers, state_order), array_to_string(sources, ',') AS proposal_sources,
 array_to_string(callers, ',') AS callers, CAST(len(callers) AS BIGINT) AS caller_agreement FROM ranked_in"""))
def a4(spark, sf):
    return (rollup.junctions(rollup.molecules(V.evidence(spark, sf)), V.STATES, V.CALLERS)
            .withColumn("caller_agreement", F.size("callers").cast("long"))
            .withColumn("callers", F.array_join("callers", ","))
            .withColumn("proposal_sources", F.array_join("proposal_sources", ",")))


@plan("a5_best_state", sql(V.EVIDENCE, tail=f"""SELECT junction_id, arg_min(state, {_PRIORITY}) AS best_state
 FROM evidence GROUP BY junction_id"""))
def a5(spark, sf):
    order = rollup.priority("state", V.STATES)
    return V.evidence(spark, sf).groupBy("junction_id").agg(F.min_by("state", order).alias("best_state"))


@plan("a6_median_or_unknown", sql(V.EVIDENCE, tail="""SELECT junction_id, sample_id,
 CASE WHEN count(margin) = count(*) THEN median(margin) END AS median_margin, count(*) AS reads
 FROM evidence GROUP BY junction_id, sample_id"""))
def a6(spark, sf):
    return rollup.median_if_complete(V.evidence(spark, sf), ["junction_id", "sample_id"], "margin", "median_margin", "reads")


@plan("a7_state_reason_counts", sql(V.READS, """reasons AS (SELECT unnest(list_filter([
 CASE WHEN anchor < 10 THEN 'short_anchor' END, CASE WHEN margin < 20000 THEN 'low_margin' END,
 CASE WHEN l_discount > 0.05 THEN 'competitor' END], lambda x: x IS NOT NULL)) AS item FROM reads)""", tail="""
 SELECT 'reason' AS kind, item, count(*) AS n FROM reasons GROUP BY item
 UNION ALL SELECT 'caller', caller, count(*) FROM reads GROUP BY caller"""))
def a7(spark, sf):
    r = V.reads(spark, sf)
    reasons = rollup.reason_list({"short_anchor": F.col("anchor") < 10, "low_margin": F.col("margin") < 20000,
                                  "competitor": F.col("l_discount") > 0.05})
    return rollup.value_counts(r, "caller", "caller").unionByName(
        rollup.value_counts(r.select(F.explode(reasons).alias("item")), "item", "reason"))


_ORDER = """state_order, -specimens, -qualifying_reads, -specific_reads, median_margin IS NULL, -median_margin,
 median_anchor IS NULL, -median_anchor, -len(callers)"""


@plan("w1_tie_intervals", sql(V.EVIDENCE, MOLECULES, ROLLUP, CALLED, FULL, tail=f"""
 SELECT junction_id, evidence_state, rank_min, rank_min + ties - 1 AS rank_max, display_rank FROM (
 SELECT *, rank() OVER (ORDER BY {_ORDER}) AS rank_min, row_number() OVER (ORDER BY {_ORDER}, junction_id) AS display_rank,
 count(*) OVER (PARTITION BY {_ORDER}) AS ties FROM ranked_in)"""))
def w1(spark, sf):
    ranked = rollup.rank_junctions(rollup.junctions(rollup.molecules(V.evidence(spark, sf)), V.STATES, V.CALLERS), V.STATES)
    return ranked.select("junction_id", "evidence_state", "rank_min", "rank_max", "display_rank")


@plan("w2_sequential_rank", sql(V.READS, SUPPORT, tail="""SELECT pair_id, support,
 row_number() OVER (ORDER BY support DESC, pair_id) AS rank FROM support"""))
def w2(spark, sf):
    return R.sequential_rank(rollup.pair_support(V.reads(spark, sf)), [-F.col("support"), F.col("pair_id")])


_TOPK = """SELECT CAST(tot.n AS BIGINT) AS n, CAST(p AS BIGINT) AS positives, CAST(kk AS BIGINT) AS k,
 round(cum_pos - pos + slots * pos / s.n, 6) AS expected_hits,
 CAST(cum_pos - pos + greatest(0, slots - (s.n - pos)) AS BIGINT) AS min_hits,
 CAST(cum_pos - pos + least(slots, pos) AS BIGINT) AS max_hits, CAST(s.score AS DOUBLE) AS tie_score,
 CAST(s.n AS BIGINT) AS tie_size, CAST(slots AS BIGINT) AS tie_slots, CAST(pos AS BIGINT) AS tie_positives,
 CAST(cum_pos - pos AS BIGINT) AS hits_above_tie, round((cum_pos - pos + slots * pos / s.n) / kk, 6) AS precision_at_k,
 round((cum_pos - pos + slots * pos / s.n) / nullif(p, 0), 6) AS recall_at_k"""
_TOPK_FROM = """FROM tot, (SELECT *, kk - (cum_n - n) AS slots FROM steps, (SELECT least({k}, n) AS kk FROM tot)) s
 WHERE s.cum_n - s.n < s.kk AND s.kk <= s.cum_n"""
TOT = "tot AS (SELECT sum(n) AS n, sum(pos) AS p FROM steps)"


@plan("w3_tie_topk", sql(V.SCORED, STEPS.format(label="quality", source="scored"), TOT, tail=_TOPK + """,
 (SELECT CAST(sum(quality) AS BIGINT) FROM (SELECT quality FROM scored ORDER BY score DESC, doc_id LIMIT 20)) AS id_tiebreak_hits
 """ + _TOPK_FROM.format(k=20)))
def w3(spark, sf):
    rows = V.scored(spark, sf)
    hits = R.first_k_hits(rows, "quality", "score", "doc_id", 20)
    out = R.topk(R.score_steps(rows, "quality", "score"), 20).withColumn("id_tiebreak_hits", hits.scalar())
    return _rounded(out, "expected_hits", "precision_at_k", "recall_at_k")


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@plan("w4_topk_strict_interval", sql(
    V.READS, SUPPORT, "panel AS (SELECT support AS score, CAST(split_part(pair_id, ':', 1) AS BIGINT) % 3 AS m FROM support)",
    STEPS.format(label="CAST(m = 0 AS INT)", source="panel"), TOT,
    "edge AS (SELECT 200 - (cum_n - steps.n) AS d, steps.n AS nn, pos AS kk, cum_pos - pos AS fixed, tot.n, p FROM steps, tot WHERE cum_n - steps.n < 200 AND 200 <= cum_n)",
    "pmf AS (SELECT x, exp(lgamma(kk + 1) - lgamma(x + 1) - lgamma(kk - x + 1) + lgamma(nn - kk + 1) - lgamma(d - x + 1) - lgamma(nn - kk - d + x + 1) - (lgamma(nn + 1) - lgamma(d + 1) - lgamma(nn - d + 1))) AS pr FROM (SELECT *, unnest(range(CAST(greatest(0, d - (nn - kk)) AS BIGINT), CAST(least(d, kk) AS BIGINT) + 1)) AS x FROM edge))",
    "cdf AS (SELECT x, sum(pr) OVER (ORDER BY x) AS c FROM pmf)",
    tail="""SELECT CAST(200 AS BIGINT) AS k, CAST(n AS BIGINT) AS candidates, CAST(p AS BIGINT) AS known_positives,
 round(fixed + d * kk / nn, 6) AS expected_hits, round((fixed + d * kk / nn) / nullif(p, 0), 6) AS recall_at_k,
 CAST(nn AS BIGINT) AS tie_candidates,
 CAST(fixed + (SELECT min(x) FROM cdf WHERE c >= 0.025) AS BIGINT) AS lower_95,
 CAST(fixed + (SELECT min(x) FROM cdf WHERE c >= 0.975) AS BIGINT) AS upper_95 FROM edge"""))
def w4(spark, sf):
    rows = rollup.pair_support(V.reads(spark, sf)).withColumn(
        "hit", (F.substring_index("pair_id", ":", 1).cast("long") % 3 == 0).cast("int"))
    edge = R.strict_topk(rows, "hit", "support", 200)
    bounds = R.hypergeometric_interval(edge, ["k"], "tie_size", "tie_positives", "tie_slots")
    return edge.join(bounds, "k").select(
        "k", F.col("n").alias("candidates"), F.col("positives").alias("known_positives"),
        F.round("expected_hits", 6).alias("expected_hits"), F.round("recall_at_k", 6).alias("recall_at_k"),
        F.col("tie_size").alias("tie_candidates"), (F.col("hits_above_tie") + F.col("lower")).alias("lower_95"),
        (F.col("hits_above_tie") + F.col("upper")).alias("upper_95"))


@plan("w5_interval_topk", sql(
    V.EVIDENCE, MOLECULES, ROLLUP, CALLED, FULL,
    f"r AS (SELECT *, rank() OVER (ORDER BY {_ORDER}) AS score0, CAST(right(junction_id, 1) IN ('1','4','7') AS INT) AS hit FROM ranked_in)",
    "base AS (SELECT 'ranker' AS ordering, -score0 AS score, hit FROM r UNION ALL SELECT 'read_count', qualifying_reads, hit FROM r)",
    """st AS (SELECT *, sum(n) OVER (PARTITION BY ordering ORDER BY score DESC) AS cum_n,
 sum(pos) OVER (PARTITION BY ordering ORDER BY score DESC) AS cum_pos FROM (SELECT ordering, score, count(*) AS n, sum(hit) AS pos FROM base GROUP BY ALL))""",
    tail="""SELECT ordering, CAST(20 AS BIGINT) AS k, round(cum_pos - pos + (20 - (cum_n - n)) * pos / n, 6) AS expected_supported,
 round((cum_pos - pos + (20 - (cum_n - n)) * pos / n) / 20, 6) AS fraction FROM st WHERE cum_n - n < 20 AND 20 <= cum_n"""))
def w5(spark, sf):
    ranked = rollup.rank_junctions(rollup.junctions(rollup.molecules(V.evidence(spark, sf)), V.STATES, V.CALLERS), V.STATES)
    ranked = ranked.withColumn("hit", F.substring("junction_id", -1, 1).isin("1", "4", "7"))
    a = R.interval_topk(ranked, "hit", [F.col("rank_min"), F.col("rank_max")], 20).withColumn("ordering", F.lit("ranker"))
    b = R.interval_topk(ranked, "hit", [-F.col("qualifying_reads")], 20).withColumn("ordering", F.lit("read_count"))
    return _rounded(a.unionByName(b), "expected_supported", "fraction")


SCORES = {"length": "CAST(score AS DOUBLE)", "letters": "CAST(n_chars % 37 AS DOUBLE)"}
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS score_name, {e} AS score, quality, toxic FROM scored" for n, e in SCORES.items()) + ")"
LONG_STEPS = """steps AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM (
 SELECT score_name, score, count(*) AS n, sum(toxic) AS pos FROM long GROUP BY ALL)
 WINDOW w AS (PARTITION BY score_name ORDER BY score DESC))"""


def _long_scores(spark, sf):
    return rollup.named_scores(V.scored(spark, sf), {n: F.expr(e) for n, e in SCORES.items()}, ["quality", "toxic"])


@plan("w6_recovery_curve", sql(V.SCORED, LONG, LONG_STEPS, tail="""SELECT score_name, k,
 round(cum_pos - pos + (k - (cum_n - n)) * pos / n, 6) AS expected_hits
 FROM steps JOIN (SELECT unnest(range(1, 101)) AS k) ON cum_n - n < k AND k <= cum_n"""))
def w6(spark, sf):
    return _rounded(R.recovery_curve(R.score_steps(_long_scores(spark, sf), "toxic", "score", ["score_name"]), 100,
                                     ["score_name"]), "expected_hits")


@plan("w7_average_precision", sql(V.SCORED, LONG, LONG_STEPS, tail="""SELECT score_name, CAST(sum(n) AS BIGINT) AS n,
 CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * cum_pos / cum_n) / nullif(sum(pos), 0), 6) AS average_precision
 FROM steps GROUP BY score_name"""))
def w7(spark, sf):
    steps = R.score_steps(_long_scores(spark, sf), "toxic", "score", ["score_name"])
    return _rounded(R.average_precision(steps, ["score_name"]), "average_precision")


@plan("w8_precision_recall", sql(V.SCORED, LONG, LONG_STEPS, tail="""SELECT score_name, score,
 round(cum_pos / cum_n, 6) AS precision, round(cum_pos / nullif(sum(pos) OVER (PARTITION BY score_name), 0), 6) AS recall FROM steps"""))
def w8(spark, sf):
    steps = R.score_steps(_long_scores(spark, sf), "toxic", "score", ["score_name"])
    return _rounded(R.precision_recall(steps, ["score_name"]), "precision", "recall")


@plan("x3_named_scores", sql(V.SCORED, LONG, tail="""SELECT score_name, count(*) AS n,
 CAST(sum(score) AS BIGINT) AS total, CAST(sum(quality) AS BIGINT) AS positives FROM long GROUP BY score_name"""))
def x3(spark, sf):
    return _long_scores(spark, sf).groupBy("score_name").agg(
        F.count("*").alias("n"), F.sum("score").cast("long").alias("total"), F.sum("quality").alias("positives"))


@plan("m6_hypergeometric_quantiles", sql(
    "cases AS (SELECT p_partkey AS id, p_size + 10 AS nn, 1 + p_size // 3 AS kk, 1 + p_size // 4 AS d FROM part)",
    "pmf AS (SELECT id, x, exp(lgamma(kk + 1) - lgamma(x + 1) - lgamma(kk - x + 1) + lgamma(nn - kk + 1) - lgamma(d - x + 1) - lgamma(nn - kk - d + x + 1) - (lgamma(nn + 1) - lgamma(d + 1) - lgamma(nn - d + 1))) AS pr FROM (SELECT *, unnest(range(greatest(0, d - (nn - kk)), least(d, kk) + 1)) AS x FROM cases))",
    "cdf AS (SELECT id, x, sum(pr) OVER (PARTITION BY id ORDER BY x) AS c FROM pmf)",
    tail="SELECT id, CAST(min(x) FILTER (c >= 0.025 - 1e-12) AS BIGINT) AS lower, CAST(min(x) FILTER (c >= 0.975 - 1e-12) AS BIGINT) AS upper FROM cdf GROUP BY id"))
def m6(spark, sf):
    cases = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_size + 10 AS BIGINT) AS population",
                                                "1 + p_size DIV 3 AS successes", "1 + p_size DIV 4 AS draws")
    return R.hypergeometric_interval(cases, ["id"], "population", "successes", "draws")
