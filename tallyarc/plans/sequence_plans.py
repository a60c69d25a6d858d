"""Sequences, reading frames, alignment records and their comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.functions import alignment as A
from tallyarc.functions import sequence as Q
from tallyarc.operators import decisions as D
from tallyarc.operators import joins as J
from tallyarc.operators.probes import substring_join
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql
from tallyarc.session import cut_lineage, spread

# Bases with N for the rare letters: unreadable codons.
MASKED = "translate(regexp_replace(lower(text), '[^a-z]', ''{g}), '%s', '%s')" % (
    V.LETTERS, "".join("N" if c in "jqxz" else b for c, b in zip(V.LETTERS, V.BASES)))
MASK = f"mdna AS (SELECT doc_id AS seq_id, {MASKED.format(g=', %sg%s' % (chr(39), chr(39)))} AS seq FROM documents)"
_AA = f"CASE WHEN regexp_matches(x, '^[ACGT][ACGT][ACGT]$') THEN substr('{Q.CODE_AMINO}', CAST(16 * (instr('TCAG', x[1]) - 1) + 4 * (instr('TCAG', x[2]) - 1) + instr('TCAG', x[3]) AS BIGINT), 1) ELSE 'X' END"


def _translated(expr):
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '...'), lambda x: {_AA}), '')"


def masked(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).selectExpr("doc_id AS seq_id", MASKED.format(g="") + " AS seq")


@plan("f1_reverse_complement", sql(V.DNA, tail="SELECT seq_id, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM dna"))
def f1(spark, sf):
    return V.dna(spark, sf).select("seq_id", Q.reverse_complement(F.col("seq")).alias("rc"))


@plan("f2_translation", sql(MASK, tail=f"SELECT seq_id, {_translated('seq')} AS protein FROM mdna"))
def f2(spark, sf):
    return masked(spark, sf).select("seq_id", Q.translate_codons(F.col("seq")).alias("protein"))


def _frames(source):
    return f"""pos AS (SELECT seq_id, p, substr(seq, p + 1, 3) AS codon, p % 3 AS frame FROM (SELECT *, unnest(range(0, greatest(0, length(seq) - 2))) AS p FROM {source})),
 st AS (SELECT seq_id, p AS start, frame, min(CASE WHEN codon IN ('TAA','TAG','TGA') THEN p END) OVER w AS stop_start,
 min(CASE WHEN contains(codon, 'N') THEN p END) OVER w AS bad, codon FROM pos WINDOW w AS (PARTITION BY seq_id, frame ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 orf AS (SELECT seq_id, start, frame, stop_start, bad FROM st WHERE codon = 'ATG')"""


@plan("w19_next_stop", sql(V.DNA, _frames("dna"), tail="SELECT seq_id, start, frame, stop_start FROM orf"))
def w19(spark, sf):
    return Q.first_stops(V.dna(spark, sf), "seq_id", "seq").drop("bad_codon")


@plan("f3_spanning_frames", sql(MASK, _frames("mdna"), tail=f"""SELECT seq_id, start, stop_start, frame, stop_start - start AS coding_nt,
 {_translated('substr(seq, start + 1, stop_start - start)')} AS protein FROM orf JOIN mdna USING (seq_id) WHERE stop_start - start >= 90
 AND start + 15 <= length(seq) // 2 AND stop_start >= length(seq) // 2 + seq_id % 5 + 15 AND (bad IS NULL OR bad > stop_start)"""))
def f3(spark, sf):
    half = F.floor(F.length("seq") / 2)
    rows = masked(spark, sf).withColumns({"low": half, "high": half + F.col("seq_id") % 5})
    return Q.spanning_frames(rows, "seq_id", "seq", "low", "high").select("seq_id", "start", "stop_start", "frame", "coding_nt", "protein")


@plan("f4_crossing_frames", sql(MASK, _frames("mdna"), tail="""SELECT seq_id, start, stop_start, stop_start - start AS coding_nt FROM orf JOIN mdna USING (seq_id)
 WHERE stop_start - start >= 90 AND start < length(seq) // 3 AND length(seq) // 3 < stop_start AND (bad IS NULL OR bad > stop_start)"""))
def f4(spark, sf):
    rows = masked(spark, sf).withColumn("junction", F.floor(F.length("seq") / 3))
    return Q.crossing_frames(rows, "seq_id", "seq", "junction").select("seq_id", "start", "stop_start", "coding_nt")


# Probe halves: the middle letters of each sequence, looked for in every sequence of the same source.
@plan("j9_substring_join", sql("s AS (SELECT dna.*, source FROM dna JOIN documents ON doc_id = seq_id)".replace("dna.*", "dna.seq_id, dna.seq"), tail="").replace("WITH ", f"WITH {V.DNA}, ") + """
 , p AS (SELECT seq_id AS probe_id, source, substr(seq, length(seq) // 2 + 1, 12) AS probe FROM s WHERE length(seq) >= 40)
 SELECT probe_id, s.seq_id, CAST(pos AS BIGINT) AS pos FROM p JOIN s USING (source), LATERAL (SELECT unnest(range(0, length(seq) - 11)) AS pos) WHERE contains(seq, probe) AND substr(seq, pos + 1, 12) = probe""")
def j9(spark, sf):
    """Every occurrence, overlapping too, of the probes of a source in its texts."""
    s = cut_lineage(V.dna(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), "source"), "seq_id"))  # read four times
    probes = s.where(F.length("seq") >= 40).select(
        F.col("seq_id").alias("probe_id"), "source", F.substr("seq", (F.floor(F.length("seq") / 2) + 1).cast("int"), F.lit(12)).alias("probe"))
    return substring_join(probes, s, "source", "probe", "seq", 12).select("probe_id", "seq_id", "pos")


@plan("p7_key_resolution", sql(V.DNA, "s AS (SELECT seq_id, seq, lang FROM dna JOIN documents ON doc_id = seq_id)",
     "q AS (SELECT seq_id, seq_id % 2 = 1 AS suffixed, substr(seq, 1, 20) AS a, substr(seq, length(seq) // 2, 20) AS b, lang, seq FROM s)",
     tail="""SELECT seq_id, CASE WHEN length(seq) < 60 THEN 'unexpected_probe_length' WHEN NOT contains(seq, a) OR NOT contains(reverse(seq), b) AND suffixed THEN 'parent_sequence_mapping_failed'
 WHEN suffixed THEN 'sequence_verified_design_suffix' ELSE 'exact_symbol_sequence_verified' END AS status FROM q"""))
def p7(spark, sf):
    rows = V.dna(spark, sf)
    a, b = F.substring("seq", 1, 20), F.substr("seq", F.floor(F.length("seq") / 2).cast("int"), F.lit(20))
    return rows.select("seq_id", key_status(F.col("seq_id") % 2 == 1, F.length("seq") < 60, F.contains("seq", a),
                                            F.contains(F.reverse("seq"), b) | (F.col("seq_id") % 2 == 0)).alias("status"))


def key_status(suffixed, bad_length, first_found, second_found):
    """A suffix comes off only when both halves are found in their parents."""
    return (F.when(bad_length, "unexpected_probe_length").when(~first_found | ~second_found, "parent_sequence_mapping_failed")
            .when(suffixed, "sequence_verified_design_suffix").otherwise("exact_symbol_sequence_verified"))


@plan("f15_mean_phred", """SELECT doc_id, round(q, 6) AS mean_quality FROM (SELECT doc_id, -10 * log10(list_sum(list_transform(range(1, length(t) + 1), lambda i: pow(10, -(ascii(t[i]) - 33) / 10.0))) / length(t)) AS q
 FROM (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS t FROM documents) WHERE length(t) > 0) WHERE q >= 25""")
def f15(spark, sf):
    q = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("t")).where("length(t) > 0")
    return q.select("doc_id", Q.mean_phred(F.col("t")).alias("q")).where("q >= 25").select("doc_id", F.round("q", 6).alias("mean_quality"))


@plan("a30_gc_fraction", sql(V.DNA, tail="""SELECT source, round(avg(length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0)), 6) AS mean_gc FROM dna JOIN documents ON doc_id = seq_id GROUP BY source"""))
def a30(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), "source")
    return V.dna(spark, sf).join(docs, "seq_id").groupBy("source").agg(F.round(F.avg(Q.gc_fraction(F.col("seq"))), 6).alias("mean_gc"))


@plan("f18_homopolymers", sql(V.DNA, """b AS (SELECT seq_id, p, seq[p] AS c FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS p FROM dna)),
 g AS (SELECT seq_id, c, min(p) - 1 AS s, max(p) AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY seq_id, c ORDER BY p) AS k FROM b) WHERE c IN ('A', 'T') GROUP BY seq_id, c, k HAVING count(*) >= 5)""",
     tail="""SELECT seq_id, s AS start, e AS "end", c AS base FROM g JOIN dna USING (seq_id)
 WHERE s >= 50 AND length(seq) - e >= 50 AND s <= length(seq) // 2 + seq_id % 9 + 75 AND e >= length(seq) // 2 - 75"""))
def f18(spark, sf):
    """A or T tracts within the flanks and near the join; letters of prose seldom run to ten, so five are enough here."""
    rows = V.dna(spark, sf).withColumns({"n": F.length("seq"), "low": F.floor(F.length("seq") / 2)})
    return Q.tracts_near_join(rows, "seq", "low", F.col("low") + F.col("seq_id") % 9, minimum=5).select("seq_id", "start", "end", "base")


# Alignments shaped from order lines: clip, match, deletion, match, insertion, match, intron, match.
_ALN = {
    "id": "concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)", "read_id": "l_orderkey",
    "s": "CAST(l_linenumber AS BIGINT)", "q": "CAST(l_quantity AS BIGINT) + 3", "m2": "l_partkey % 20 + 1", "i": "l_suppkey % 3 + 1",
    "m3": "l_orderkey % 9 + 1", "m4": "l_partkey % 30 + 5", "pos": "l_partkey * 3 + 1", "rev": "l_linestatus = 'F'",
}
_CIGAR = "concat(s, 'S', q, 'M2D', m2, 'M', i, 'I', m3, 'M100N', m4, 'M')"
_MD = "concat(q - 3, 'A2^AC', m2 + m3 + m4)"
ALN = "aln0 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ALN.items()) + f" FROM lineitem), aln AS (SELECT *, {_CIGAR} AS cigar, {_MD} AS md, s + q + m2 + i + m3 + m4 AS n FROM aln0)"


def alignments(spark, sf):
    base = spread(table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _ALN.items()]))
    return base.selectExpr("*", f"{_CIGAR} AS cigar", f"{_MD} AS md", "s + q + m2 + i + m3 + m4 AS n")


def scored_alignments(spark, sf):
    rows = alignments(spark, sf).withColumn("ops", A.cigar_ops(F.col("cigar")))
    rows = rows.withColumns({"codes": A.query_codes(F.col("ops")), "matches": A.aligned_matches(F.col("md")), "dels": A.deletions(F.col("ops"))})
    return rows.withColumn("scores", A.base_scores(F.col("codes"), F.col("matches"), F.col("dels"), F.col("rev"))).drop("codes", "matches", "dels")


@plan("f5_cigar_ops", sql(ALN, tail="""SELECT id, CAST(8 AS INT) AS n_ops, CAST(n + 102 AS BIGINT) AS total_length, 'SMDMIMNM' AS kinds FROM aln"""))
def f5(spark, sf):
    rows = alignments(spark, sf).select("id", A.cigar_ops(F.col("cigar")).alias("ops"))
    total = F.aggregate("ops", F.lit(0).cast("long"), lambda a, o: a + o["n"])
    return rows.select("id", F.size("ops").alias("n_ops"), total.alias("total_length"), F.array_join(F.transform("ops", lambda o: o["op"]), "").alias("kinds"))


@plan("f6_edit_scores", sql(ALN, tail="""SELECT id, CAST(q + m2 + m3 + m4 - 3 - 4 - 2 * i AS BIGINT) AS edit_score,
 CASE WHEN rev THEN 0 ELSE s END AS qstart, CASE WHEN rev THEN n - s ELSE n END AS qend, n AS length, n - s AS scored FROM aln"""))
def f6(spark, sf):
    rows = alignments(spark, sf)
    return rows.select("id", F.explode(F.array(A.edit_summary(A.cigar_ops(F.col("cigar")), F.col("md"), F.col("rev")))).alias("_s")).select("id", "_s.*")


@plan("f7_window_score", sql(ALN, """per AS (SELECT *, CASE WHEN rev THEN n - 1 - u ELSE u END AS p FROM (SELECT *, unnest(range(0, n)) AS u FROM aln)),
 sc AS (SELECT id, rev, n, p, CASE WHEN u < s THEN NULL WHEN u = s + q - 3 THEN -2 WHEN u = s + q - 1 THEN -3
 WHEN u >= s + q + m2 AND u < s + q + m2 + i THEN -2 ELSE 1 END AS v FROM per),
 win AS (SELECT id, unnest(range(4, 40)) AS p FROM aln)""", tail="SELECT win.id, CAST(sum(coalesce(v, -2)) AS BIGINT) AS score FROM win LEFT JOIN sc USING (id, p) GROUP BY win.id"))
def f7(spark, sf):
    return scored_alignments(spark, sf).select("id", A.window_score(F.col("scores"), F.lit(4), F.lit(40)).cast("long").alias("score"))


@plan("f8_reference_blocks", sql(ALN, tail="""SELECT id, unnest(['a', 'b']) AS part, unnest([pos - 1, pos - 1 + q + 2 + m2 + m3 + 100]) AS start, unnest([pos - 1 + q + 2 + m2 + m3, pos - 1 + q + 2 + m2 + m3 + 100 + m4]) AS "end" FROM aln"""))
def f8(spark, sf):
    rows = alignments(spark, sf).withColumn("ops", A.cigar_ops(F.col("cigar")))
    return rows.select("id", F.posexplode(A.reference_blocks(F.col("ops"), F.col("pos") - 1)).alias("k", "b")).select(
        "id", F.when(F.col("k") == 0, "a").otherwise("b").alias("part"), F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


@plan("f9_junction_identity", """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row_id,
 'junction_' || sha256('{"boundary_3p":' || CAST(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_partkey + 50 END AS VARCHAR) || ',"boundary_5p":' || CAST(CASE WHEN l_linestatus = 'F' THEN l_suppkey + 30 ELSE l_suppkey END AS VARCHAR)
 || ',"gene_3p":"P' || l_partkey || '","gene_5p":"S' || l_suppkey || '"}') AS junction_id FROM lineitem""")
def f9(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat_ws('/', l_orderkey, l_linenumber, l_partkey) AS row_id", "l_suppkey", "l_partkey", "l_suppkey AS s5", "l_suppkey + 30 AS e5",
        "l_partkey AS s3", "l_partkey + 50 AS e3", "IF(l_linestatus = 'F', '+', '-') AS strand5", "IF(l_returnflag = 'R', '+', '-') AS strand3")
    fields = {"gene_5p": D.quoted(F.concat(F.lit("S"), F.col("l_suppkey"))), "gene_3p": D.quoted(F.concat(F.lit("P"), F.col("l_partkey"))),
              "boundary_5p": D.boundary("strand5", "s5", "e5", "left").cast("string"), "boundary_3p": D.boundary("strand3", "s3", "e3", "right").cast("string")}
    return rows.select("row_id", D.junction_digest(fields).alias("junction_id"))


@plan("f10_junction_file_key", """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row_id, CASE t WHEN 1 THEN c1 ELSE c2 END AS chrom5,
 CASE t WHEN 1 THEN d ELSE a END AS pos5, CASE t WHEN 1 THEN s1 WHEN 2 THEN CASE s2 WHEN '+' THEN '-' ELSE '+' END END AS strand5,
 CASE t WHEN 1 THEN a ELSE d END AS pos3, tb1 AS terminal1 FROM (SELECT *, l_linenumber % 3 AS t, l_suppkey % 5 AS c1, l_partkey % 7 AS c2, CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS s1, CASE l_returnflag WHEN 'R' THEN '+' ELSE '-' END AS s2,
 l_partkey - CAST(l_linestatus = 'F' AS INT) AS d, l_orderkey - CAST(l_returnflag <> 'R' AS INT) AS a, l_partkey - CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS tb1 FROM lineitem) WHERE t IN (1, 2)""")
def f10(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat_ws('/', l_orderkey, l_linenumber, l_partkey) AS row_id", "l_linenumber % 3 AS t", "l_suppkey % 5 AS c1", "l_partkey % 7 AS c2",
        "IF(l_linestatus = 'F', '+', '-') AS s1", "IF(l_returnflag = 'R', '+', '-') AS s2", "l_partkey AS d", "l_orderkey AS a")
    first, _ = D.terminal_bases("d", "s1", "a", "s2")
    return rows.select("row_id", D.junction_file_key("t", "d", "s1", "a", "s2", "c1", "c2").alias("k"), first.alias("terminal1")).where(
        "k IS NOT NULL").select("row_id", "k.chrom5", "k.pos5", "k.strand5", "k.pos3", "terminal1")


@plan("f11_coordinate_bin", "SELECT l_partkey + 1 AS position, (l_partkey + 1 - 1) // 20 AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def f11(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_partkey") + 1).alias("position")).groupBy("position").agg(F.count("*").alias("n")).select(
        "position", D.coordinate_bin(F.col("position"), 20).alias("bin"), "n")


@plan("f19_join_geometry", """SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row_id, CASE WHEN l_suppkey % 3 <> l_partkey % 3 THEN 'interchromosomal' WHEN l_linestatus <> CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'O' END THEN 'opposite_strand'
 WHEN CASE WHEN l_linestatus = 'F' THEN l_partkey >= l_suppkey * 10 ELSE l_partkey <= l_suppkey * 10 END THEN 'downstream' ELSE 'upstream' END AS geometry FROM lineitem""")
def f19(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "concat_ws('/', l_orderkey, l_linenumber, l_partkey) AS row_id", "l_suppkey % 3 AS c1", "l_partkey % 3 AS c2", "l_suppkey * 10 AS p1", "l_partkey AS p2",
        "IF(l_linestatus = 'F', '+', '-') AS s1", "IF(l_returnflag = 'R', '+', '-') AS s2")
    return rows.select("row_id", D.join_geometry("c1", "s1", "p1", "c2", "s2", "p2").alias("geometry"))


@plan("f20_read_names", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS archive, regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS number,
 CASE WHEN NOT contains(url, '?') THEN 'missing' WHEN regexp_matches(url, 'utm_source=[a-z]+$') THEN 'uuid_shaped' ELSE 'other' END AS name_state FROM pages""")
def f20(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("archive"), F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2).alias("number"),
        F.when(~F.contains("url", F.lit("?")), "missing").when(F.col("url").rlike("utm_source=[a-z]+$"), "uuid_shaped").otherwise("other").alias("name_state"))


@plan("j14_competitors", """WITH a AS (SELECT l_orderkey AS read, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, l_linenumber > 3 AS secondary, l_suppkey % 5 AS target, l_partkey AS start, l_partkey % 30 AS qs, l_partkey % 30 + 40 + CAST(l_quantity AS BIGINT) AS qe FROM lineitem)
 SELECT x.id, count(*) AS competitors, min(y.id) AS first_competitor FROM a x JOIN a y ON x.read = y.read AND x.id <> y.id AND NOT x.secondary AND y.secondary
 AND NOT (x.target = y.target AND abs(x.start - y.start) <= 20) AND greatest(0, least(x.qe, y.qe) - greatest(x.qs, y.qs)) >= 0.9 * (x.qe - x.qs)
 AND (y.qe - y.qs) >= (x.qe - x.qs) - greatest(10, 0.05 * (x.qe - x.qs)) GROUP BY x.id""")
def j14(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS read", "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", "l_linenumber > 3 AS secondary", "l_suppkey % 5 AS target",
        "l_partkey AS start", "l_partkey % 30 AS qs", "l_partkey % 30 + 40 + CAST(l_quantity AS BIGINT) AS qe")
    return competitors(rows.where("NOT secondary"), rows.where("secondary")).groupBy("id").agg(
        F.count("*").alias("competitors"), F.min("other_id").alias("first_competitor"))


def competitors(arms, others):
    """Secondary placements of the same read that cover 90 % of an arm with a near-equal score elsewhere."""
    o = others.select("read", *[F.col(c).alias(f"other_{c}") for c in ("id", "target", "start", "qs", "qe")])
    both = J.product_within(arms, o, ["read"], "id", "other_id")
    width, reach = F.col("qe") - F.col("qs"), F.least("qe", "other_qe") - F.greatest("qs", "other_qs")
    same = (F.col("target") == F.col("other_target")) & (F.abs(F.col("start") - F.col("other_start")) <= 20)
    near = (F.col("other_qe") - F.col("other_qs")) >= width - F.greatest(F.lit(10.0), 0.05 * width)
    return both.where((F.col("id") != F.col("other_id")) & ~same & (reach >= 0.9 * width) & near)


@plan("j15_best_single_explanation", """WITH w AS (SELECT l_orderkey AS read, min(l_partkey % 50) AS a, max(l_partkey % 50) + 60 AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 t AS (SELECT l_orderkey AS read, l_partkey || '.' || l_suppkey AS target, l_partkey % 50 + 5 AS qs, l_partkey % 50 + 5 + CAST(l_quantity AS BIGINT) AS qe FROM lineitem WHERE l_linestatus = 'O'),
 s AS (SELECT read, a, b, target, greatest(0, least(b, qe) - greatest(a, qs)) AS ov FROM w JOIN t USING (read)),
 z AS (SELECT *, ov - 2 * (b - a - ov) AS score FROM s), m AS (SELECT read, arg_max(target, {'s': score, 't': target}) AS best_target, max(score) AS best_score, any_value(a) AS a, any_value(b) AS b, arg_max(ov, {'s': score, 't': target}) AS ov FROM z GROUP BY read)
 SELECT read, best_target, best_score, round(ov / (b - a), 6) AS coverage, (b - a) - best_score AS margin, ov / (b - a) >= 0.9 AND (b - a) - best_score <= greatest(20, 0.05 * (b - a)) AS single_explains FROM m""")
def j15(spark, sf):
    """A perfect split score is the window width; the best transcript per read is an aggregate, not a list."""
    line = table(spark, sf, "lineitem")
    windows = line.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("read")).agg(
        F.min(F.col("l_partkey") % 50).alias("a"), (F.max(F.col("l_partkey") % 50) + 60).alias("b")).withColumn("split_score", F.col("b") - F.col("a"))
    tx = line.where("l_linestatus = 'O'").selectExpr("l_orderkey AS read", "concat(l_partkey, '.', l_suppkey) AS target", "l_partkey % 50 + 5 AS qs",
                                                     "l_partkey % 50 + 5 + CAST(l_quantity AS BIGINT) AS qe")
    return best_single(windows, tx)


def best_single(windows, transcripts):
    both = windows.join(transcripts, "read")
    ov = F.greatest(F.lit(0).cast("long"), F.least("b", "qe") - F.greatest("a", "qs"))
    scored = both.withColumn("ov", ov).withColumn("score", F.col("ov") - 2 * (F.col("b") - F.col("a") - F.col("ov")))
    best = scored.groupBy("read").agg(F.max(F.struct("score", "target", "ov", "a", "b", "split_score")).alias("m"))
    span, margin = F.col("m.b") - F.col("m.a"), F.col("m.split_score") - F.col("m.score")
    cover = F.col("m.ov") / span
    return best.select("read", F.col("m.target").alias("best_target"), F.col("m.score").alias("best_score"), F.round(cover, 6).alias("coverage"),
                       margin.alias("margin"), ((cover >= 0.9) & (margin <= F.greatest(F.lit(20.0), 0.05 * span))).alias("single_explains"))


@plan("f25_projected_sequence", sql(ALN, """pr AS (SELECT id, rev, s, q, pos, unnest(list_concat(range(0, q + 2 + m2 + m3), range(q + 102 + m2 + m3, q + 102 + m2 + m3 + m4))) AS k, substr('ACGT', CAST((pos + k) % 4 AS BIGINT) + 1, 1) AS ref FROM aln)""",
     tail="""SELECT id, count(*) AS bases, count(*) FILTER (k < q AND k = q - 3) AS substitutions, string_agg(CASE WHEN k = q - 3 AND (pos + k) % 2 = 0 THEN 'N' ELSE ref END, '' ORDER BY k) AS projected FROM pr GROUP BY id"""))
def f25(spark, sf):
    """A read equal to the reference but for one base; even positions are high quality and keep it."""
    rows = alignments(spark, sf).withColumn("ops", A.cigar_ops(F.col("cigar")))
    rows = rows.selectExpr("*", "CAST(q + 102 + m2 + m3 + m4 AS INT) AS length").selectExpr(
        "*", "substr(repeat('ACGT', length DIV 4 + 2), CAST(pos % 4 AS INT) + 1, length) AS reference")
    part = lambda start, size: f"substr(reference, CAST({start} + 1 AS INT), CAST({size} AS INT))"
    rows = rows.selectExpr("*", f"concat({part('0', 'q')}, {part('q + 2', 'm2')}, repeat('A', CAST(i AS INT)), {part('q + 2 + m2', 'm3')}, {part('q + 102 + m2 + m3', 'm4')}) AS _b")
    rows = rows.selectExpr("*", "concat(repeat('S', CAST(s AS INT)), overlay(_b PLACING 'N' FROM CAST(q - 2 AS INT) FOR 1)) AS read")
    rows = rows.selectExpr("*", "substr(repeat('D+', CAST(length(read) DIV 2 + 1 AS INT)), CAST(pmod(pos - s, 2) AS INT) + 1, length(read)) AS quality")  # 35 and 10
    p = rows.select("id", A.projected_text(F.col("ops"), F.col("read"), F.col("quality"), F.col("reference")).alias("p"))
    return p.select("id", F.col("p.bases").cast("long").alias("bases"), F.col("p.substitutions").cast("long").alias("substitutions"), F.col("p.text").alias("projected"))


@plan("f26_position_projection", sql(ALN, tail="""SELECT id, q + 2 + m2 + m3 + m4 AS bases, CASE WHEN rev THEN pos - 1 + q + 2 + m2 + m3 + 100 + m4 - 1 ELSE pos - 1 END AS first_position,
 CASE WHEN rev THEN pos - 1 ELSE pos - 1 + q + 2 + m2 + m3 + 100 + m4 - 1 END AS last_position FROM aln"""))
def f26(spark, sf):
    rows = alignments(spark, sf).withColumn("ops", A.cigar_ops(F.col("cigar")))
    p = rows.withColumn("p", A.projected_positions(F.col("ops"), F.col("pos") - 1, F.col("rev")))
    return p.select("id", F.size("p").cast("long").alias("bases"), F.get("p", F.lit(0)).cast("long").alias("first_position"),
                    F.element_at("p", -1).cast("long").alias("last_position"))
