import pytest
from pyspark.sql import functions as F

from tallyarc.operators.joins import join_one_to_one, ledger_merge, pairs_within, product_within
from tallyarc.plans.cohort_plans import orthologous_pairs
from tallyarc.session import scratch_path
from tallyarc.sources import sinks, text


def lines(spark, name, content):
    path = scratch_path(spark, name)
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path


def test_fasta_joins_lines_and_rejects_duplicates(spark):
    rows = text.fasta(spark, lines(spark, "a.fa", ">a|x one\nacg\nT\n>b\nGG"), "ACGT").collect()
    assert {r.id: r.sequence for r in rows} == {"a": "ACGT", "b": "GG"}
    for bad in (">a\nAC\n>a\nGG", ">a\nAC\n>b\n", ">a\nAX"):
        with pytest.raises(Exception, match="sequence"):
            text.fasta(spark, lines(spark, "bad.fa", bad), "ACGT").collect()


def test_fastq_quality_may_start_with_at(spark):
    good = "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\n!~"
    rows = text.fastq(spark, lines(spark, "a.fq", good)).orderBy("record").collect()
    assert [(r.header, r.quality) for r in rows] == [("r1 x", "@III"), ("r2", "!~")]
    for bad in ("@r1\nACG\n+\nIIII", "@r1\nACGT\nIIII\n@r2", "r1\nAC\n+\nII", "@r1\nAC\n+"):
        with pytest.raises(Exception, match="malformed"):
            text.fastq(spark, lines(spark, "bad.fq", bad)).collect()


def test_caller_log_inherits_the_header(spark):
    log = "GF\tA:B\t2\n\t+(chr1/r1:1-2)x(chr2/r2:3-4)\nSumGF\tA:B\n\t(chr1/none:1-2)\nGF\tC:D\n\t(chr1/r1:1-2)"
    rows = text.caller_log(spark, lines(spark, "log", log)).collect()
    assert {(r.pair, r.read_id) for r in rows} == {("A:B", "r1"), ("A:B", "r2"), ("C:D", "r1")}


def test_key_values_and_one(spark):
    df = spark.createDataFrame([("r", "a = 1"), ("r", "b = x = y"), ("r", "b = z")], "record string, value string")
    kv = text.key_values(df, "record")
    assert text.one(kv, "record", "a").first().a == "1"
    with pytest.raises(Exception, match="exactly once"):
        text.one(kv, "record", "b").collect()


def test_lost_records_fail(spark):
    src = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(Exception, match="missing"):
        sinks.extract_records(src, spark.createDataFrame([("a",), ("b",)], "id string"), "id").collect()


def test_nested_pages_keep_every_child(spark):
    kids = spark.range(2500).select(F.lit("hot").alias("k"), "id")
    pages = sinks.nested_pages(spark.createDataFrame([("hot",), ("none",)], "k string"), kids, "k", ["id"], "c")
    assert pages.where("k = 'hot'").count() == 3 and pages.agg(F.sum(F.size("c"))).first()[0] == 2500


def test_one_to_one_join_rejects_repeats(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="one-to-one"):
        join_one_to_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()


def test_blocks_lose_no_pair(spark):
    rows = spark.range(300).select(F.lit(1).alias("k"), F.col("id"))
    assert pairs_within(rows, ["k"], "id", []).select("a_id", "b_id").distinct().count() == 300 * 299 // 2
    out = product_within(rows.withColumnRenamed("id", "x"), rows.withColumnRenamed("id", "y"), ["k"], "x", "y")
    assert out.count() == out.distinct().count() == 90000


def test_verified_row_is_not_replaced(spark):
    rows = spark.createDataFrame([("j", "verified", 1), ("j", "failed", 2), ("k", "failed", 1), ("k", "pending", 2)], "j string, s string, n int")
    out = {r.j: r.s for r in ledger_merge(rows, "j", F.col("s") == "verified", [F.col("n")]).collect()}
    assert out == {"j": "verified", "k": "pending"}


def test_both_sides_must_map_in_order(spark):
    groups = spark.createDataFrame([("h", 1, 2, 1), ("m", 11, 12, 1), ("m", 12, 11, 1)], "species string, gene5 long, gene3 long, reads long")
    one = spark.createDataFrame([("h", 1, "m", 11), ("m", 12, "h", 2)], "species string, gene long, other string, other_gene long")
    assert [(r.gene5_b, r.gene3_b) for r in orthologous_pairs(groups, one).collect()] == [(11, 12)]
    with pytest.raises(Exception, match="nonunique"):
        orthologous_pairs(groups, one.union(spark.createDataFrame([("h", 1, "m", 12)], one.schema))).collect()


def test_shared_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from tallyarc.session import shared_dir

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)

    assert shared_dir(session("spark://host:7077", "s3a://x")) == "s3a://x" and shared_dir(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_reference_audit(spark):
    """A sound reference is compatible; each fault has its own finding; a repeated transcript record fails."""
    from tallyarc.operators.references import audit_findings, audit_verdict

    columns = "contig string, feature string, start long, end long, transcript_id string, biotype string"
    sound = [("c1", "transcript", 1, 50, "a", "lncRNA"), ("c1", "exon", 1, 10, "a", None), ("c1", "exon", 41, 50, "a", None)]
    contigs = spark.createDataFrame([("c1", 50), ("c2", 9)], "contig string, length long")
    run = lambda rows, bases: audit_findings(spark.createDataFrame(rows, columns), contigs, spark.createDataFrame(bases, "transcript_id string, bases long"))
    assert [tuple(r) for r in run(sound, [("a", 20)]).collect()] == [("biotype", "lncRNA", 1, None)]
    assert audit_verdict(run(sound, [("a", 20)])).first().compatible
    faulty = [*sound, ("c9", "transcript", 1, 5, "b", None), ("c2", "exon", 5, 10, "b", None)]
    found = run(faulty, [("a", 21), ("z", 3)])
    assert {tuple(r) for r in found.collect()} == {
        ("biotype", "lncRNA", 1, None), ("biotype", "UNKNOWN", 1, None), ("absent_contig", "c9", 1, None), ("invalid_interval", "b:c2:5", 10, 9),
        ("missing_sequence", "b", 6, None), ("missing_annotation", "z", None, 3), ("length_difference", "a", 20, 21)}
    assert not audit_verdict(found).first().compatible
    with pytest.raises(Exception, match="duplicate transcript"):
        run([*sound, sound[0]], [("a", 20)]).collect()
