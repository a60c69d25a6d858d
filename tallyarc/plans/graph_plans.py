"""Components, folds, models, resampling and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.operators import components as G
from tallyarc.operators import models as M
from tallyarc.operators import selection as T
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql
from tallyarc.session import cut_lineage


def graph(spark, sf):
    """Parents of a pair: a part within a ship quarter, a supplier on a ship day."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat('P', l_partkey, '.', year(l_shipdate), 'q', quarter(l_shipdate)) AS parent_a",
        "concat('S', l_suppkey, '.', datediff(l_shipdate, DATE'1992-01-01')) AS parent_b",
        "concat('x', CAST(round(l_extendedprice * 100) AS BIGINT)) AS probe")


GRAPH = """graph AS (SELECT 'P' || l_partkey || '.' || year(l_shipdate) || 'q' || quarter(l_shipdate) AS parent_a,
 'S' || l_suppkey || '.' || date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS parent_b,
 'x' || CAST(round(l_extendedprice * 100) AS BIGINT) AS probe FROM lineitem)"""
_BOTH = "e AS (SELECT parent_a AS u, parent_b AS v FROM links UNION SELECT parent_b, parent_a FROM links)"
_CC = """cc(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION
 SELECT e.v, min(c.component) FROM cc c JOIN e ON c.node = e.u JOIN recurring.cc r ON r.node = e.v WHERE c.component < r.component GROUP BY e.v)"""


@plan("g1_components", sql(GRAPH, "links AS (SELECT parent_a, parent_b FROM graph)", _BOTH, _CC, tail="SELECT node, component FROM cc", recursive=True))
def g1(spark, sf):
    return G.components(graph(spark, sf), "parent_a", "parent_b")


_LINK2 = """links AS (SELECT parent_a, parent_b FROM graph UNION SELECT f, parent_a FROM graph JOIN (SELECT probe, min(parent_a) AS f FROM graph GROUP BY probe) USING (probe) WHERE f <> parent_a)"""


def linked(spark, sf):
    g = graph(spark, sf)
    shared = G.star_edges(g, "probe", "parent_a")
    return g, G.components(g.select(F.col("parent_a").alias("u"), F.col("parent_b").alias("v")).union(shared), "u", "v")


@plan("g2_components_with_shared_probe", sql(GRAPH, _LINK2, _BOTH, _CC, tail="SELECT component, count(*) AS nodes FROM cc GROUP BY component", recursive=True))
def g2(spark, sf):
    return linked(spark, sf)[1].groupBy("component").agg(F.count("*").alias("nodes"))


def similarity(spark, sf):
    n = table(spark, sf, "part").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "lineitem").withColumn("_n", n.scalar())
    return rows.selectExpr("l_partkey AS a", "(l_partkey * 7 + l_suppkey * 13 + l_orderkey) % _n AS b",
                           "l_discount * 10 AS similarity", "l_quantity / 50 AS cover_a", "(l_orderkey % 100) / 100D AS cover_b")


SIM = """sim AS (SELECT l_partkey AS a, (l_partkey * 7 + l_suppkey * 13 + l_orderkey) % (SELECT count(*) FROM part) AS b, l_discount * 10 AS s, l_quantity / 50 AS ca, (l_orderkey % 100) / 100.0 AS cb FROM lineitem),
 acc AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM sim WHERE a <> b AND s >= 0.5 AND ca >= 0.8 AND cb >= 0.8)"""


@plan("g4_edge_acceptance", sql(SIM, tail="SELECT a, b FROM acc"))
def g4(spark, sf):
    return G.accepted_edges(similarity(spark, sf), "a", "b", "similarity", "cover_a", "cover_b")


@plan("g3_similarity_clusters", sql(SIM, "e AS (SELECT a AS u, b AS v FROM acc UNION SELECT b, a FROM acc UNION SELECT p_partkey, p_partkey FROM part)", _CC,
     tail="""SELECT node AS p_partkey, component, count(*) OVER (PARTITION BY component) AS size FROM cc""", recursive=True))
def g3(spark, sf):
    edges = G.accepted_edges(similarity(spark, sf), "a", "b", "similarity", "cover_a", "cover_b")
    nodes = table(spark, sf, "part").select("p_partkey")
    return G.clusters(nodes, edges, "p_partkey", "a", "b")


@plan("g3_cluster_digest", sql(SIM, "e AS (SELECT a AS u, b AS v FROM acc UNION SELECT b, a FROM acc UNION SELECT p_partkey, p_partkey FROM part)", _CC,
     tail="""SELECT component, sha256(count(*) || '|' || CAST(sum(CAST('0x' || substr(sha256(CAST(node AS VARCHAR)), 1, 8) AS BIGINT)) AS VARCHAR) || '|' ||
 CAST(sum(CAST('0x' || substr(sha256(CAST(node AS VARCHAR)), 9, 8) AS BIGINT)) AS VARCHAR)) AS cluster_id FROM cc GROUP BY component""", recursive=True))
def g3_digest(spark, sf):
    """Cluster id from its members, without gathering them."""
    members = g3(spark, sf)
    n, one, two = G.set_digest(F.col("p_partkey").cast("string"))
    return members.groupBy("component").agg(F.sha2(F.concat_ws("|", n, one, two), 256).alias("cluster_id"))


def _folds(groups, weight, n=5):
    """Greedy walk in SQL: the heaviest group first, always to the lightest fold, the lower of equals."""
    return [f"turn AS (SELECT *, row_number() OVER (ORDER BY {weight} DESC, grp) AS t FROM {groups})",
            f"""walk AS (SELECT CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS fold, list_transform(range({n}), lambda i: CAST(0 AS BIGINT)) AS loads
 UNION ALL SELECT t + 1, f - 1, list_transform(range(1, {n + 1}), lambda i: loads[i] + CASE WHEN i = f THEN w ELSE 0 END)
 FROM (SELECT walk.t, loads, CAST({weight} AS BIGINT) AS w, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS f FROM walk JOIN turn ON turn.t = walk.t + 1))"""]


@plan("g5_balanced_folds", sql(GRAPH, _LINK2, _BOTH, _CC, "sizes AS (SELECT component AS grp, count(*) AS size FROM cc GROUP BY component)", *_folds("sizes", "size"), recursive=True,
     tail="""SELECT grp AS component, size, CAST(fold AS INTEGER) AS fold, CASE WHEN fold = 4 THEN 'heldout' ELSE 'development' END AS partition FROM turn JOIN walk USING (t)"""))
def g5(spark, sf):
    """Fold loads; sequential by definition, checked against a plain loop in the tests."""
    _, comp = linked(spark, sf)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    folds = G.balanced_folds(sizes, "component", "size", 5)
    return folds.select("component", "size", "fold", F.when(F.col("fold") == 4, "heldout").otherwise("development").alias("partition"))


def model_rows(spark, sf):
    """Labelled items with missing values, grouped by source, with folds that keep a source whole."""
    rows = V.scored(spark, sf).selectExpr(
        "doc_id", "source", "quality AS label", "ln(1 + n_chars) AS log_support",
        "CASE WHEN n_chars % 5 <> 0 THEN ln(1 + n_chars % 977) END AS log_distance", "CAST(NULL AS DOUBLE) AS sample_count",
        "CAST(lang = 'en' AS INT) AS is_inter", "CASE WHEN n_chars % 7 <> 0 THEN log2(0.5 + n_chars % 13) END AS contact")
    folds = G.stratified_folds(rows, "source", "label")
    return cut_lineage(rows.join(folds, "source"))  # every fold and feature reads it again


BASE = ["log_support", "sample_count", "is_inter", "log_distance"]


@plan("g6_stratified_group_folds", sql(V.SCORED, "per AS (SELECT source AS grp, CAST(sum(quality) AS BIGINT) AS pos, count(*) AS n FROM scored GROUP BY source HAVING sum(quality) > 0)",
     *_folds("per", "pos"), recursive=True,
     tail="""SELECT CAST(fold AS INTEGER) AS fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS leaking
 FROM turn JOIN walk USING (t) GROUP BY fold"""))
def g6(spark, sf):
    rows = model_rows(spark, sf)
    leaks = G.leaking_parents(rows, "fold", ["source"])
    return rows.groupBy("fold").agg(F.count_distinct("source").alias("groups"), F.count("*").alias("n"), F.sum("label").alias("positives")).withColumn(
        "leaking", leaks.agg(F.count("*")).scalar())


@plan("m1_logistic_estimator")
def m1(spark, sf):
    rows = model_rows(spark, sf)
    return M.fit(rows, BASE, "label").score(rows, "score").select("doc_id", F.round("score", 6).alias("score"))


@plan("m2_out_of_fold_scores")
def m2(spark, sf):
    return M.out_of_fold(model_rows(spark, sf), "fold", BASE, "label", "score").select("doc_id", "fold", F.round("score", 6).alias("score"))


@plan("m3_matched_cohort")
def m3(spark, sf):
    """Both models train and test on the rows with a measured contact."""
    rows = model_rows(spark, sf).where("contact IS NOT NULL")
    a = M.out_of_fold(rows, "fold", BASE, "label", "score_base").select("doc_id", F.round("score_base", 6).alias("score_base"))
    b = M.out_of_fold(rows, "fold", [*BASE, "contact"], "label", "score_contact").select("doc_id", F.round("score_contact", 6).alias("score_contact"))
    return a.join(b, "doc_id")


@plan("m4_catalogue_scores")
def m4(spark, sf):
    """Refit on every labelled row, score the rest of the catalogue, rank it."""
    rows = model_rows(spark, sf)
    model = M.fit(rows, BASE, "label")
    rest = table(spark, sf, "documents").join(rows.select("doc_id"), "doc_id", "left_anti").selectExpr(
        "doc_id", "ln(1 + n_chars) AS log_support", "CASE WHEN n_chars % 5 <> 0 THEN ln(1 + n_chars % 977) END AS log_distance",
        "CAST(NULL AS DOUBLE) AS sample_count", "CAST(lang = 'en' AS INT) AS is_inter")
    from tallyarc.operators.ranking import sequential_rank
    scored = model.score(rest, "score").select("doc_id", F.round("score", 6).alias("score"))
    return sequential_rank(scored, [-F.col("score"), F.col("doc_id")])


_BOOT = """counts AS (SELECT source AS grp, 'a' AS side, CAST(score AS DOUBLE) AS score, count(*) AS n, sum(toxic) AS pos FROM scored GROUP BY ALL
 UNION ALL SELECT source, 'b', CAST(n_chars % 37 AS DOUBLE), count(*), sum(toxic) FROM scored GROUP BY ALL),
 idx AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT grp FROM counts)),
 mix AS (SELECT r, (((((r * 7919 + i * 104729 + 42) % 2147483647) * 48271 + r * 13) % 2147483647) * 16807 + i) % 2147483647 % g AS i FROM idx, range(1, 201) t(r)),
 w AS (SELECT r, grp, count(*) AS w FROM mix JOIN idx USING (i) GROUP BY ALL),
 st AS (SELECT r, side, score, sum(n * w) AS n, sum(pos * w) AS pos FROM counts JOIN w USING (grp) GROUP BY ALL),
 cu AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM st WINDOW o AS (PARTITION BY r, side ORDER BY score DESC)),
 ap AS (SELECT r, side, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * cp / cn) / sum(pos) END AS ap FROM cu GROUP BY ALL),
 d AS (SELECT r, max(ap) FILTER (side = 'b') - max(ap) FILTER (side = 'a') AS d FROM ap GROUP BY r),
 ps AS (SELECT side, score, sum(n) AS n, sum(pos) AS pos FROM counts GROUP BY ALL),
 pc AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM ps WINDOW o AS (PARTITION BY side ORDER BY score DESC)),
 pa AS (SELECT side, sum(pos * cp / cn) / sum(pos) AS ap FROM pc GROUP BY side)"""


@plan("m5_group_bootstrap", sql(V.SCORED, _BOOT, tail="""SELECT round((SELECT ap FROM pa WHERE side = 'b') - (SELECT ap FROM pa WHERE side = 'a'), 6) AS delta_average_precision,
 round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(d) AS valid_resamples, CAST(200 AS BIGINT) AS requested_resamples FROM d"""))
def m5(spark, sf):
    rows = V.scored(spark, sf).withColumn("letters", F.col("n_chars") % 37)
    out = M.bootstrap_difference(rows, "toxic", "score", "letters", "source", 200, 42)
    return out.withColumns({c: F.round(c, 6) for c in ("delta_average_precision", "low", "high")})


@plan("m7_rarefaction", """WITH per AS (SELECT DISTINCT l_suppkey % 40 AS c, l_orderkey % 3000 // 10 AS m FROM lineitem WHERE l_quantity = 50 AND l_suppkey % 3 <> 0),
 nn AS (SELECT count(DISTINCT m) AS nn FROM per), s AS (SELECT m, count(*) AS k FROM (SELECT c, count(*) AS m FROM per GROUP BY c) GROUP BY m)
 SELECT n, round(sum(k * (1 - CASE WHEN nn - m - n >= 0 THEN exp(lgamma(nn - n + 1) - lgamma(nn - n - m + 1) - lgamma(nn + 1) + lgamma(nn - m + 1)) ELSE 0 END)), 5) AS expected_clusters
 FROM s, nn, LATERAL (SELECT unnest(range(0, nn + 1)) AS n) GROUP BY n""".replace("l_suppkey % 40 AS c, l_orderkey % 3000 // 10 AS m FROM lineitem WHERE l_quantity = 50 AND l_suppkey % 3 <> 0", "n_chars // 40 AS c, doc_id AS m FROM documents"))
def m7(spark, sf):
    """Documents as members, length bands as clusters."""
    rows = table(spark, sf, "documents").selectExpr("n_chars DIV 40 AS c", "doc_id AS m")
    return M.rarefaction(rows, "c", "m").select("n", F.round("expected_clusters", 5).alias("expected_clusters"))


@plan("m8_fold_cohorts", sql(V.SCORED, tail="""SELECT lang AS fold, (SELECT count(*) FROM scored) - count(*) AS train_n, CAST((SELECT sum(quality) FROM scored) - sum(quality) AS BIGINT) AS train_positives,
 count(*) AS test_n, CAST(sum(quality) AS BIGINT) AS test_positives FROM scored GROUP BY lang"""))
def m8(spark, sf):
    return G.fold_cohorts(V.scored(spark, sf).withColumnRenamed("lang", "fold"), "fold", "quality")


@plan("f16_near_identical", r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM conversations), p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
 SELECT conv_id, turn, CASE WHEN abs(length(a) - length(b)) <= greatest(length(a), length(b)) // 20 THEN levenshtein(a, b) <= greatest(length(a), length(b)) // 20 ELSE false END AS near_identical,
 levenshtein(a, left(a, length(a) - 5) || 'xxx') <= length(a) // 20 AS near_edited FROM p WHERE b IS NOT NULL""")
def f16(spark, sf):
    from tallyarc.operators.scan import following
    # One symbol per accented letter: DuckDB counts edits in bytes, Spark in characters.
    plain = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    turns = following(plain, [F.col("turn")], ["conv_id"], ["text"]).where("next_text IS NOT NULL")
    edited = F.concat(F.expr("left(text, length(text) - 5)"), F.lit("xxx"))
    return turns.select("conv_id", "turn", T.near_identical(F.col("text"), F.col("next_text")).alias("near_identical"),
                        T.near_identical(F.col("text"), edited).alias("near_edited"))


_PLAIN = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"
_ROWS = f"r AS (SELECT doc_id, source, lang, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS rank, {_PLAIN} AS s FROM documents)"


def _near(a, b):
    """The limit is on edits: 5 % of the longer text; DuckDB counts bytes, so texts are plain."""
    limit = f"greatest(length({a}), length({b})) // 20"
    return f"CASE WHEN {a} = {b} THEN true WHEN abs(length({a}) - length({b})) <= {limit} THEN levenshtein({a}, {b}) <= {limit} ELSE false END"


def _picks(rounds):
    """One CTE a pick: the first row, behind the last one where asked, that no earlier pick resembles."""
    out = []
    for k, (condition, behind) in enumerate(rounds, 1):
        earlier = " UNION ALL ".join(f"SELECT s FROM p{i}" for i in range(1, k))
        unlike = f" AND NOT EXISTS (SELECT 1 FROM ({earlier}) t WHERE {_near('t.s', 'r.s')})" if k > 1 else ""
        after = f" AND rank > (SELECT rank FROM p{k - 1})" if behind and k > 1 else ""
        out.append(f"p{k} AS MATERIALIZED (SELECT {k} AS k, doc_id, source, rank, s FROM r WHERE {condition}{after}{unlike} ORDER BY rank LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT k, doc_id, rank, s FROM p{i}" for i in range(1, len(rounds) + 1))
    return [*out, f"p AS MATERIALIZED ({every})"]


def _marks(settled):
    return f"m AS (SELECT r.doc_id, r.rank, x.k AS taken_order, CASE WHEN x.k IS NULL AND {settled} THEN (SELECT arg_min(p.doc_id, p.k) FROM p WHERE {_near('p.s', 'r.s')}) END AS representative FROM r LEFT JOIN p x USING (doc_id))"


def ranked_documents(spark, sf):
    """By length, so near copies stand close together; letters beyond ASCII become one symbol."""
    from tallyarc.operators.scan import positions
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.length("text").alias("_n"), F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return positions(docs, [F.col("_n"), F.col("doc_id")], name="rank").drop("_n")


_BEHIND = "r.rank <= (SELECT rank FROM p8)"


@plan("t4_greedy_shortlist", sql(_ROWS, *_picks([("true", True)] * 8), _marks(_BEHIND), tail="""SELECT doc_id, taken_order, representative,
 CASE WHEN taken_order IS NOT NULL THEN 'taken' WHEN representative IS NOT NULL THEN 'redundant' ELSE 'eligible' END AS status FROM m"""))
def t4(spark, sf):
    docs = cut_lineage(ranked_documents(spark, sf))
    return T.shortlist(docs, ["rank"], "doc_id", "text", 8)[1].select("doc_id", "taken_order", "representative", "status")


_WISHES = [("true", True)] * 8 + [("lang = 'es'", False), ("source NOT IN (" + " UNION ALL ".join(f"SELECT source FROM p{i}" for i in range(1, 10)) + ")", False)]


@plan("t5_diversity_slots", sql(_ROWS, *_picks(_WISHES), _marks("true"), tail="""SELECT doc_id, taken_order,
 CASE WHEN taken_order IS NOT NULL THEN 'selected' WHEN representative IS NOT NULL THEN 'redundant' ELSE 'deferred' END AS status, representative,
 CASE WHEN taken_order <= 8 THEN 'top_ranked_distinct_protein' WHEN taken_order = 9 THEN 'diversity_supported_singleton' WHEN taken_order = 10 THEN 'diversity_junction_class'
 WHEN representative IS NOT NULL THEN 'redundant_sequence' ELSE 'batch_limit' END AS reason FROM m"""))
def t5(spark, sf):
    docs = cut_lineage(ranked_documents(spark, sf))
    return T.fill_with_diversity(docs, ["rank"], "doc_id", "text", F.col("lang") == "es", "source").select("doc_id", "taken_order", "status", "representative", "reason")


@plan("t6_interleave", """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)
 SELECT doc_id, row_number() OVER (ORDER BY place, source) AS turn FROM p""")
def t6(spark, sf):
    return T.interleave(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source",
                        [-F.col("n_chars"), F.col("doc_id")]).select("doc_id", "turn")


@plan("t6_interleave_shortlist", sql(
    f"q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS place FROM documents)",
    f"r AS (SELECT doc_id, source, row_number() OVER (ORDER BY place, source) AS rank, {_PLAIN} AS s FROM q)", *_picks([("true", True)] * 10), _marks("r.rank <= (SELECT rank FROM p10)"),
    tail="""SELECT doc_id, rank AS turn, taken_order, representative,
 CASE WHEN taken_order IS NOT NULL THEN 'taken' WHEN representative IS NOT NULL THEN 'redundant' ELSE 'eligible' END AS status FROM m"""))
def t6_shortlist(spark, sf):
    """Interleaved lists with near copies suppressed."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"), F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    turns = cut_lineage(T.interleave(docs, "source", [F.col("n"), F.col("doc_id")]))
    return T.shortlist(turns, ["turn"], "doc_id", "text", 10)[1].select("doc_id", "turn", "taken_order", "representative", "status")


@plan("t1_sorted_catalogue", "SELECT doc_id, toxic AS score FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic DESC NULLS LAST, doc_id")
def t1(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("toxic").alias("score")).orderBy(F.desc_nulls_last("score"), "doc_id")


@plan("t2_eligible_batch", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) END AS place FROM orders)
 SELECT CASE WHEN place <= 100 THEN 'in_batch' WHEN place IS NOT NULL THEN 'deferred_batch_limit' ELSE 'not_eligible' END AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r GROUP BY 1""")
def t2(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return T.eligible_batch(rows, [-F.col("o_totalprice"), F.col("o_orderkey")], F.col("o_orderstatus") == "F", 100).groupBy("status").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@plan("t7_stratified_pick", """SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS length_band, lang AS score_band,
 arg_min(doc_id, sha256(doc_id || '|7')) AS pick, count(*) AS population FROM documents GROUP BY ALL""")
def t7(spark, sf):
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return T.one_per_cell(table(spark, sf, "documents"), [band, F.col("lang")], ["length_band", "score_band"], "doc_id", "7")


@plan("t8_purposive_panel", """WITH x AS (SELECT vec_id, vec_id = (SELECT min(vec_id) FROM embeddings) AS ref, CAST(embedding[1] >= 0 AS INT) * 2 + CAST(embedding[2] >= 0 AS INT) AS q, sha256('s1:' || vec_id) AS h FROM embeddings),
 y AS (SELECT *, CASE WHEN NOT ref THEN row_number() OVER (PARTITION BY q, ref ORDER BY h) END AS n FROM x)
 SELECT vec_id, CASE WHEN ref THEN 0 WHEN n <= 2 THEN 1 ELSE 2 END AS stage FROM y ORDER BY stage, h LIMIT 8""")
def t8(spark, sf):
    rows = table(spark, sf, "embeddings")
    low = rows.agg(F.min("vec_id"))
    q = (F.get("embedding", 0) >= 0).cast("int") * 2 + (F.get("embedding", 1) >= 0).cast("int")
    return T.panel(rows, "vec_id", F.col("vec_id") == low.scalar(), q, "s1")


@plan("t9_batch_caps", """SELECT count(*) FILTER (n > 100) AS roles_over_cap, (SELECT count(*) - count(DISTINCT text) FROM documents) AS repeated_sequences FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""")
def t9(spark, sf):
    docs = table(spark, sf, "documents")
    roles = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 100).alias("roles_over_cap"))
    repeated = docs.groupBy(F.sha2("text", 256)).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("n"))
    return roles.withColumn("repeated_sequences", repeated.scalar())


@plan("t10_quota_draw", """WITH s AS (SELECT source, count(*) AS population FROM documents GROUP BY 1), x AS (SELECT *, 60 * population / sum(population) OVER () AS x FROM s),
 q AS (SELECT source, population, CAST(floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, source) <= 60 - sum(floor(x)) OVER () AS INT) AS BIGINT) AS quota FROM x),
 d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('q:' || doc_id)) AS draw_order FROM documents)
 SELECT doc_id, source, quota, draw_order FROM d JOIN q USING (source) WHERE draw_order <= quota""")
def t10(spark, sf):
    return T.quota_draw(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 60, "q").select(
        "doc_id", "source", "quota", "draw_order")
