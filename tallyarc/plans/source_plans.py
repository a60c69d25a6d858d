"""Sources and sinks as round trips: each plan writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyarc.operators import references
from tallyarc.operators.scan import positions
from tallyarc.plans import views as V
from tallyarc.plans.registry import plan, table
from tallyarc.plans.views import sql
from tallyarc.session import scratch_path
from tallyarc.sources import sinks, text


@plan("s1_delimited_scan", """SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS price, o_orderstatus = 'F' AS flag FROM orders""")
def s1(spark, sf):
    path = scratch_path(spark, "orders.tsv")
    sinks.write_tsv(table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "IF(o_orderstatus = 'P', 'NA', o_orderstatus) AS status", "IF(o_totalprice > 250000, CAST(o_totalprice AS STRING), 'NaN') AS price",
        "IF(o_orderstatus = 'F', 'True', 'False') AS flag"), path)
    return text.read_table(spark, path, "id long, status string, price double, flag boolean", ["id", "price"])


@plan("s2_source_row_numbers", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS source_row FROM lineitem")
def s2(spark, sf):
    """Workbook rows count from 2, below the header line."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in rows.columns]
    return positions(rows, order, name="_n").select("l_orderkey", "l_linenumber", (F.col("_n") + 1).alias("source_row"))


@plan("s3_fasta_records", sql(V.DNA, tail="SELECT 'd' || seq_id AS id, CAST(length(seq) AS INT) AS n, sha256(seq) AS digest FROM dna WHERE seq <> ''"))
def s3(spark, sf):
    path = scratch_path(spark, "records.fa")
    rows = V.dna(spark, sf).where("seq <> ''").select(F.concat(F.lit("d"), "seq_id", F.lit("|x|doc")).alias("id"), "seq")
    sinks.write_fasta(rows, path, "id", "seq")
    return text.fasta(spark, path, "ACGT").select("id", F.length("sequence").alias("n"), F.sha2("sequence", 256).alias("digest"))


_READ = """reads_ AS (SELECT seq_id, seq, translate(seq, 'ACGT', '#5@I') AS qual FROM dna WHERE seq <> '')"""


def fastq_path(spark, sf):
    path = scratch_path(spark, "reads.fastq")
    rows = V.dna(spark, sf).where("seq <> ''")
    sinks.write_lines(rows, path, F.concat_ws("\n", F.concat(F.lit("@r"), "seq_id", F.lit(" name="), F.col("seq_id") % 50), "seq", F.lit("+"),
                                              F.translate("seq", "ACGT", "#5@I")))
    return path


@plan("s4_fastq_records", sql(V.DNA, _READ, tail="SELECT 'r' || seq_id || ' name=' || seq_id % 50 AS header, sha256(seq) AS seq_digest, sha256(qual) AS qual_digest FROM reads_"))
def s4(spark, sf):
    return text.fastq(spark, fastq_path(spark, sf)).select("header", F.sha2("sequence", 256).alias("seq_digest"), F.sha2("quality", 256).alias("qual_digest"))


@plan("a14_read_qc", sql(V.DNA, _READ, tail="""SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(min(length(seq)) AS INT) AS shortest, CAST(max(length(seq)) AS INT) AS longest,
 round(avg(length(seq)), 6) AS mean_length, round(sum(2 * length(regexp_replace(seq, '[^A]', '', 'g')) + 20 * length(regexp_replace(seq, '[^C]', '', 'g')) + 31 * length(regexp_replace(seq, '[^G]', '', 'g')) + 40 * length(regexp_replace(seq, '[^T]', '', 'g'))) / sum(length(seq)), 6) AS mean_quality,
 count(*) FILTER (seq_id % 50 = 0) AS zero_names FROM reads_"""))
def a14(spark, sf):
    q = text.fastq(spark, fastq_path(spark, sf))
    total = F.aggregate(F.split("quality", ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c) - 33)
    n = F.length("sequence")
    return q.agg(F.count("*").alias("reads"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"),
                 F.round(F.sum(total) / F.sum(n), 6).alias("mean_quality"), F.count_if(F.col("header").endswith("name=0")).alias("zero_names"))


@plan("a15_histograms", sql(V.DNA, _READ, tail="""SELECT 'length' AS kind, length(seq) // 100 AS bin, count(*) AS n FROM reads_ GROUP BY ALL UNION ALL
 SELECT 'quality', CAST(floor(-10 * log10((pow(10, -0.2) * a + pow(10, -2) * c + pow(10, -3.1) * g + pow(10, -4) * t) / (a + c + g + t))) AS BIGINT), count(*) FROM (SELECT length(regexp_replace(seq, '[^A]', '', 'g')) AS a, length(regexp_replace(seq, '[^C]', '', 'g')) AS c, length(regexp_replace(seq, '[^G]', '', 'g')) AS g, length(regexp_replace(seq, '[^T]', '', 'g')) AS t FROM reads_) GROUP BY ALL"""))
def a15(spark, sf):
    from tallyarc.functions.sequence import mean_phred
    rows = V.dna(spark, sf).where("seq <> ''").select("seq", F.translate("seq", "ACGT", "#5@I").alias("quality"))
    bins = F.array(F.struct(F.lit("length").alias("kind"), F.floor(F.length("seq") / 100).alias("bin")),
                   F.struct(F.lit("quality").alias("kind"), F.floor(mean_phred(F.col("quality"))).alias("bin")))
    return rows.select(F.explode(bins).alias("b")).groupBy("b.kind", "b.bin").agg(F.count("*").alias("n"))


@plan("a16_duplicate_names", """SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT nullif(text, '') AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) WHERE name IS NOT NULL""")
def a16(spark, sf):
    names = table(spark, sf, "documents").select(F.sha2(F.nullif("text", F.lit("")), 256).alias("name")).where("name IS NOT NULL")
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.sum("n").alias("reads"))


GTF = """g AS (SELECT 'chr' || l_suppkey % 10 AS chrom, CASE WHEN l_linenumber % 3 = 0 THEN 'CDS' WHEN l_linenumber % 3 = 1 THEN 'exon' ELSE 'gene' END AS feature,
 l_partkey + 1 AS start, l_partkey + CAST(l_quantity AS BIGINT) AS "end", 'G' || l_suppkey AS gene_id, 'T' || l_orderkey AS transcript_id FROM lineitem)"""


def gtf_path(spark, sf):
    path = scratch_path(spark, "annotation.gtf")
    rows = table(spark, sf, "lineitem").selectExpr("concat_ws('\t', concat('chr', l_suppkey % 10), 'src', CASE l_linenumber % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'exon' ELSE 'gene' END, l_partkey + 1, l_partkey + CAST(l_quantity AS BIGINT), '.', '+', '.', concat('gene_id \"G', l_suppkey, '\"; transcript_id \"T', l_orderkey, '\"; tag \"basic\"; tag \"last\";')) AS line")
    sinks.write_lines(rows, path, F.col("line"))
    return path


@plan("s5_gtf_features", sql(GTF, tail="""SELECT chrom, feature, gene_id, count(*) AS n, CAST(sum("end" - start + 1) AS BIGINT) AS bases, max(transcript_id) AS last_transcript, 'last' AS tag FROM g WHERE feature IN ('exon', 'CDS') AND gene_id IN (SELECT 'G' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL"""))
def s5(spark, sf):
    genes = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("G"), "s_suppkey").alias("gene_id"))
    rows = text.gtf(spark, gtf_path(spark, sf), ["exon", "CDS"], genes)
    return rows.groupBy("chrom", "feature", "gene_id").agg(
        F.count("*").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"), F.max(F.col("attributes")["transcript_id"]).alias("last_transcript"),
        F.max(F.col("attributes")["tag"]).alias("tag"))


@plan("a17_reference_audit", sql(GTF, """e AS (SELECT transcript_id, CAST(sum("end" - start + 1) AS BIGINT) AS exon_length FROM g WHERE feature = 'exon' GROUP BY 1),
 o AS (SELECT 'T' || o_orderkey AS transcript_id, CAST(o_totalprice AS BIGINT) % 100 AS seq_length FROM orders)""",
     tail="""SELECT count(*) FILTER (e.exon_length = o.seq_length) AS equal_length, count(*) FILTER (e.exon_length <> o.seq_length) AS different_length, count(*) FILTER (e.transcript_id IS NULL) AS sequence_only,
 count(*) FILTER (o.transcript_id IS NULL) AS annotation_only, (SELECT count(*) FROM g WHERE feature = 'exon' AND "end" > 1500) AS out_of_bounds, false AS compatible FROM e FULL JOIN o USING (transcript_id)"""))
def a17(spark, sf):
    g = text.gtf(spark, gtf_path(spark, sf), ["exon"]).withColumn("transcript_id", F.col("attributes")["transcript_id"])
    e = g.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("exon_length"), F.count_if(F.col("end") > 1500).alias("bad"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("T"), "o_orderkey").alias("transcript_id"), (F.bround("o_totalprice", 0).cast("long") % 100).alias("seq_length"))
    both = e.join(o, "transcript_id", "full_outer").agg(
        F.count_if(F.col("exon_length") == F.col("seq_length")).alias("equal_length"), F.count_if(F.col("exon_length") != F.col("seq_length")).alias("different_length"),
        F.count_if(F.col("exon_length").isNull()).alias("sequence_only"), F.count_if(F.col("seq_length").isNull()).alias("annotation_only"), F.sum("bad").alias("out_of_bounds"))
    return both.withColumn("compatible", (F.col("different_length") == 0) & (F.col("sequence_only") == 0) & (F.col("annotation_only") == 0) & (F.col("out_of_bounds") == 0))


MODELS = """ft AS (SELECT 'chr' || l_suppkey % 11 AS contig, 'exon' AS feature, l_partkey + 1 AS start, l_partkey + CAST(l_quantity AS BIGINT) AS "end", 'T' || l_orderkey AS transcript_id, NULL AS biotype FROM lineitem
 UNION ALL SELECT 'chr' || o_custkey % 11, 'transcript', 1, 2, 'T' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'lncRNA' WHEN 'O' THEN 'protein_coding' END FROM orders),
 cg AS (SELECT 'chr' || p_partkey % 10 AS contig, max(p_partkey) AS length FROM part GROUP BY 1),
 sq AS (SELECT 'T' || o_orderkey AS transcript_id, CAST(coalesce(sum(CASE WHEN l_discount < 0.095 THEN CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS bases FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1
 UNION ALL SELECT 'C' || c_custkey, c_nationkey FROM customer)"""
FINDINGS = """tr AS (SELECT t.transcript_id, coalesce(t.biotype, 'UNKNOWN') AS biotype, coalesce(x.n, 0) AS exon_bases FROM ft t LEFT JOIN (SELECT transcript_id, sum("end" - start + 1) AS n FROM ft WHERE feature = 'exon' GROUP BY 1) x USING (transcript_id) WHERE t.feature = 'transcript'),
 fd AS (SELECT 'biotype' AS kind, biotype AS name, count(*) AS observed, CAST(NULL AS BIGINT) AS expected FROM tr GROUP BY biotype
 UNION ALL SELECT 'absent_contig', contig, count(*), NULL FROM ft WHERE contig NOT IN (SELECT contig FROM cg) GROUP BY contig
 UNION ALL SELECT 'invalid_interval', transcript_id || ':' || contig || ':' || start, "end", length FROM ft JOIN cg USING (contig) WHERE start < 1 OR "end" < start OR "end" > length
 UNION ALL SELECT 'missing_sequence', transcript_id, CAST(exon_bases AS BIGINT), NULL FROM tr WHERE transcript_id NOT IN (SELECT transcript_id FROM sq)
 UNION ALL SELECT 'missing_annotation', transcript_id, NULL, bases FROM sq WHERE transcript_id NOT IN (SELECT transcript_id FROM tr)
 UNION ALL SELECT 'length_difference', transcript_id, CAST(exon_bases AS BIGINT), bases FROM tr JOIN sq USING (transcript_id) WHERE exon_bases <> bases)"""


def findings(spark, sf):
    """Annotation written as GTF and read back, contigs of the parts, sequences of orders and customers."""
    path = scratch_path(spark, "models.gtf")
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    exons = line.selectExpr("concat_ws('\t', concat('chr', l_suppkey % 11), 'src', 'exon', l_partkey + 1, l_partkey + CAST(l_quantity AS BIGINT), '.', '+', '.', concat('transcript_id \"T', l_orderkey, '\";')) AS line")
    records = orders.selectExpr("concat_ws('\t', concat('chr', o_custkey % 11), 'src', 'transcript', 1, 2, '.', '+', '.', concat('transcript_id \"T', o_orderkey, '\";', CASE o_orderstatus WHEN 'F' THEN ' transcript_type \"lncRNA\";' WHEN 'O' THEN ' transcript_type \"protein_coding\";' ELSE '' END)) AS line")
    sinks.write_lines(exons.unionAll(records), path, F.col("line"))
    value = lambda key: F.try_element_at("attributes", F.lit(key))
    features = text.gtf(spark, path, ["transcript", "exon"]).select(F.col("chrom").alias("contig"), "feature", "start", "end", value("transcript_id").alias("transcript_id"),
                                                                   value("transcript_type").alias("biotype"))
    contigs = table(spark, sf, "part").groupBy(F.expr("concat('chr', p_partkey % 10)").alias("contig")).agg(F.max("p_partkey").alias("length"))
    bases = orders.where("o_orderstatus <> 'P'").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.expr("concat('T', o_orderkey)").alias("transcript_id")).agg(
        F.coalesce(F.sum(F.expr("IF(l_discount < 0.095, CAST(l_quantity AS BIGINT), NULL)")), F.lit(0)).alias("bases"))
    others = table(spark, sf, "customer").selectExpr("concat('C', c_custkey) AS transcript_id", "CAST(c_nationkey AS BIGINT) AS bases")
    return references.audit_findings(features, contigs, bases.unionAll(others))


@plan("a17_reference_findings", sql(MODELS, FINDINGS, tail="SELECT kind, name, observed, expected FROM fd"))
def a17_findings(spark, sf):
    return findings(spark, sf)


@plan("a17_reference_verdict", sql(MODELS, FINDINGS, tail="""SELECT CAST(sum(observed) FILTER (kind = 'biotype') AS BIGINT) AS transcripts, count(*) FILTER (kind = 'biotype' AND name IN ('lncRNA', 'lincRNA', 'antisense', 'processed_transcript')) > 0 AS noncoding_present,
 count(*) FILTER (kind <> 'biotype') AS problems, bool_and(kind = 'biotype') AND bool_or(kind = 'biotype' AND name IN ('lncRNA', 'lincRNA', 'antisense', 'processed_transcript')) AS compatible FROM fd"""))
def a17_verdict(spark, sf):
    return references.audit_verdict(findings(spark, sf))


@plan("s6_sam_records", """SELECT 'r' || l_orderkey AS read_id, l_partkey AS start, l_linenumber * 16 AS flag, CASE WHEN l_linenumber * 16 & 16 <> 0 THEN '-' ELSE '+' END AS strand, CAST(l_quantity AS BIGINT) || 'M' AS cigar, 'x:' || l_suppkey AS sa, l_partkey % 60 AS mapq
 FROM (SELECT l_orderkey, l_partkey, l_quantity, l_suppkey, l_linenumber, l_returnflag FROM lineitem) WHERE l_returnflag <> 'N'""")
def s6(spark, sf):
    path = scratch_path(spark, "records.sam")
    rows = table(spark, sf, "lineitem").selectExpr("concat_ws('\t', concat('r', l_orderkey), l_linenumber * 16 + IF(l_returnflag = 'N', 4, 0), concat('t', l_suppkey), l_partkey + 1, l_partkey % 60, concat(CAST(l_quantity AS BIGINT), 'M'), '*', 0, 0, '*', '*', concat('MD:Z:', CAST(l_quantity AS BIGINT)), concat('SA:Z:x:', l_suppkey)) AS line")
    sinks.write_lines(rows, path, F.col("line"))
    return text.sam(spark, path).select("read_id", "start", "flag", "strand", "cigar", F.col("tags")["SA"].alias("sa"), F.col("mapq").cast("long").alias("mapq"))


@plan("s7_junction_rows", "SELECT 'q' || l_orderkey AS read_id, l_partkey AS donor, CAST(l_linenumber % 4 - 1 AS INT) AS type FROM lineitem WHERE l_linenumber % 4 - 1 >= 0")
def s7(spark, sf):
    return text.junction_rows(spark, junction_path(spark, sf)).select("read_id", "donor", "type")


def junction_path(spark, sf):
    path = scratch_path(spark, "chimeric.junction")
    rows = table(spark, sf, "lineitem").selectExpr("concat_ws('\t', concat('chr', l_suppkey), l_partkey, '+', concat('chr', l_suppkey % 7), l_orderkey, '-', l_linenumber % 4 - 1, 0, 0, concat('q', l_orderkey)) AS line")
    extra = table(spark, sf, "nation").selectExpr("concat('# ', n_name) AS line").union(table(spark, sf, "nation").selectExpr("concat('chr1\t', n_nationkey) AS line"))
    sinks.write_lines(rows.union(extra), path, F.col("line"))
    return path


@plan("a19_junction_summary", """SELECT count(*) AS rows, count(*) FILTER (l_linenumber % 4 > 0) AS split_rows, count(*) FILTER (l_linenumber % 4 = 0) AS mate_rows, count(DISTINCT l_orderkey) AS fragments FROM lineitem""")
def a19(spark, sf):
    f = F.split("value", "\t")
    rows = spark.read.text(junction_path(spark, sf)).where(~F.col("value").startswith("#")).where(F.size(f) >= 10).select(f[6].cast("int").alias("t"), f[9].alias("read"))
    per = rows.groupBy("read").agg(F.count("*").alias("n"), F.count_if(F.col("t") >= 0).alias("s"))
    return per.agg(F.sum("n").alias("rows"), F.sum("s").alias("split_rows"), F.sum(F.col("n") - F.col("s")).alias("mate_rows"), F.count("*").alias("fragments"))


@plan("s8_caller_log", "SELECT DISTINCT 'G' || l_partkey || ':G' || l_suppkey AS pair, 'x' || l_orderkey AS read_id FROM lineitem")
def s8(spark, sf):
    """Each group is written as header, members, summary; the reader carries the header down."""
    path = scratch_path(spark, "caller.log")
    groups = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", F.floor(F.col("l_orderkey") / 64).alias("part")).agg(F.collect_list("l_orderkey").alias("m"))
    line = F.concat(F.lit("GF\tG"), "l_partkey", F.lit(":G"), "l_suppkey", F.lit("\tx\n"),
                    F.array_join(F.transform("m", lambda k: F.concat(F.lit("\t+("), F.lit("chr1/x"), k, F.lit(":10-20)"))), "\n"), F.lit("\nSumGF\tend"))
    sinks.write_lines(groups, path, line)
    return text.caller_log(spark, path)


@plan("s11_json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def s11(spark, sf):
    path = scratch_path(spark, "events.json")
    ev = table(spark, sf, "events")
    sinks.write_jsonl(ev.select("event_id", F.struct("event_type", F.array("props").alias("props")).alias("body")), path)
    rows = spark.read.schema("event_id long, body struct<event_type string, props array<string>>").json(path)
    return rows.select("event_id", F.from_json(F.get("body.props", F.lit(0)), "k long")["k"].alias("k"), "body.event_type")


@plan("s12_key_value_records", r"""WITH kv AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?(.*)$', 1), '&')) AS p FROM pages),
 s AS (SELECT page_id, split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value FROM kv WHERE contains(p, '=')) SELECT *, count(*) OVER (PARTITION BY page_id, key) AS repeats FROM s""")
def s12(spark, sf):
    params = F.split(F.regexp_extract("url", r"\?(.*)$", 1), "&")
    lines = table(spark, sf, "pages").select("page_id", F.explode(params).alias("p")).where(F.contains("p", F.lit("="))).select(
        "page_id", F.regexp_replace("p", "=", " = ").alias("value"))
    return text.key_values(lines, "page_id").select("page_id", "key", "value", "repeats")


@plan("s13_sinks", sql(V.DNA, tail="SELECT sink, (SELECT count(*) FROM dna WHERE seq <> '') AS rows FROM (VALUES ('tsv'), ('tsv_gz'), ('fasta'), ('jsonl')) v(sink)"))
def s13(spark, sf):
    """Row counts after writing and reading TSV, gzip TSV, FASTA and JSON lines."""
    docs = V.dna(spark, sf).where("seq <> ''")
    out = []
    for kind in ("tsv", "tsv_gz", "fasta", "jsonl"):
        path = scratch_path(spark, kind)
        if kind == "fasta":
            sinks.write_fasta(docs, path, "seq_id", "seq")
            rows = text.fasta(spark, path)
        elif kind == "jsonl":
            sinks.write_jsonl(docs, path)
            rows = spark.read.schema("seq_id long, seq string").json(path)
        else:
            sinks.write_tsv(docs, path, gzip=kind == "tsv_gz")
            rows = text.read_table(spark, path, "seq_id long, seq string", ["seq_id"])
        out.append(rows.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("sink"), "rows"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@plan("s14_nested_export", """SELECT l_partkey AS pair_id, p_brand, count(*) AS children, CAST(sum(l_quantity) AS BIGINT) AS anchor_total FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def s14(spark, sf):
    path = scratch_path(spark, "pairs.json")
    kids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pair_id"), "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").distinct()
    parents = table(spark, sf, "part").selectExpr("p_partkey AS pair_id", "p_brand")
    sinks.write_jsonl(sinks.nested_pages(parents, kids, "pair_id", ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"], "junctions"), path)
    back = spark.read.schema("pair_id long, p_brand string, junctions array<struct<l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double>>").json(path)
    total = F.aggregate("junctions", F.lit(0.0), lambda a, j: a + j["l_quantity"])
    return back.where("junctions IS NOT NULL").groupBy("pair_id", "p_brand").agg(
        F.sum(F.size("junctions")).alias("children"), F.sum(total).cast("long").alias("anchor_total"))


@plan("s15_create_only", "SELECT count(*) AS rows, true AS second_write_refused FROM labels")
def s15(spark, sf):
    """The second write of a freeze must fail."""
    from pyspark.errors import AnalysisException
    path = scratch_path(spark, "freeze")
    rows = table(spark, sf, "labels")
    sinks.write_tsv(rows, path)
    try:
        sinks.write_tsv(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    return text.read_table(spark, path, "doc_id long, quality int, toxic int", ["doc_id", "quality", "toxic"]).agg(F.count("*").alias("rows")).withColumn("second_write_refused", F.lit(refused))


@plan("s16_content_manifest", """SELECT lang, true AS frozen, CAST(0 AS BIGINT) AS mismatches FROM documents GROUP BY lang""")
def s16(spark, sf):
    """Freeze files by language, then verify them against the manifest."""
    path = scratch_path(spark, "frozen")
    docs = table(spark, sf, "documents").select("lang", "doc_id", "source")
    docs.write.mode("error").partitionBy("lang").csv(path)
    from tallyarc.session import cut_lineage
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"))
    frozen = cut_lineage(sinks.manifest(spark, path))
    bad = sinks.manifest_mismatches(frozen, sinks.manifest(spark, path)).agg(F.count("*").alias("n"))
    return files.groupBy("lang").agg((F.count("*") > 0).alias("frozen")).withColumn("mismatches", bad.scalar())


@plan("s17_source_records", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def s17(spark, sf):
    line = table(spark, sf, "lineitem")
    return sinks.extract_records(line.select("l_orderkey", "l_linenumber", "l_partkey"), line.where("l_quantity >= 49").select("l_orderkey"), "l_orderkey")
