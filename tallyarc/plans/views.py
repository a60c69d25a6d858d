"""Views that shape the supplied tables like evidence, scores and sequences.

Every Spark view has the same relation as DuckDB text, used in the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyarc.plans.registry import table
from tallyarc.session import spread


def _view(spark: SparkSession, sf: str, source: str, *columns: str) -> DataFrame:
    return table(spark, sf, source).selectExpr(*columns)


def reads(spark, sf):
    """One row per read of an ordered pair."""
    return _view(spark, sf, "lineitem", "concat(l_partkey, ':', l_suppkey) AS pair_id",
                 "concat('P', l_partkey) AS parent_a", "concat('S', l_suppkey) AS parent_b",
                 "concat(l_orderkey, '/', l_linenumber) AS read_id", "l_returnflag AS sample_id",
                 "l_linestatus AS caller", "l_quantity AS anchor", "l_extendedprice AS margin",
                 "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", "l_tax")


READS = """reads AS (SELECT l_partkey || ':' || l_suppkey AS pair_id, 'P' || l_partkey AS parent_a,
 'S' || l_suppkey AS parent_b, l_orderkey || '/' || l_linenumber AS read_id, l_returnflag AS sample_id,
 l_linestatus AS caller, l_quantity AS anchor, l_extendedprice AS margin, l_partkey, l_suppkey, l_orderkey,
 l_linenumber, l_discount, l_tax FROM lineitem)"""

# Evidence states in priority order, known callers, further proposal sources.
STATES = ["supported_two_gene_junction", "ambiguous_single_vs_split", "insufficient_anchor",
          "artifact_suspected", "unmapped/unresolved", "single_transcript_explained"]
CALLERS = ["LongGF", "JAFFAL", "Genion"]
SOURCES = ["LongGF", "JAFFAL", "Genion", "alignment_scan", "clip_scan"]


def _pick(values, index):
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_EVIDENCE = [
    ("junction_id", "concat('J', l_suppkey, '.', CAST(floor(l_partkey / 100) AS BIGINT))"),
    ("sample_id", "l_returnflag"),
    ("specimen_id", "CASE WHEN l_returnflag = 'N' THEN 'G1' ELSE 'G2' END"),
    ("read_id", "concat('R', l_orderkey)"),
    ("state", _pick(STATES, "CAST((l_suppkey * 7 + l_orderkey * 3 + (l_orderkey % 2) * 2) % 6 AS INT)")),
    ("mapping_specific", "CASE l_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"),
    ("margin", "CASE WHEN l_orderkey % 11 <> 0 THEN CAST((l_suppkey + l_orderkey) % 5 AS DOUBLE) END"),
    ("anchor", "CASE WHEN l_orderkey % 13 <> 0 THEN CAST(100 + (l_orderkey % 4) * 50 AS BIGINT) END"),
    ("caller", _pick(SOURCES, "CAST(l_linenumber % 5 AS INT)")),
]


def evidence(spark, sf):
    """Assessed read/caller rows with the closed evidence schema."""
    return _view(spark, sf, "lineitem", *[f"{e} AS {n}" for n, e in _EVIDENCE])


EVIDENCE = "evidence AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVIDENCE) + " FROM lineitem)"


def scored(spark, sf):
    """Labelled items: outcome, second outcome, tied score, group."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").selectExpr(
        "doc_id", "source", "lang", "quality", "toxic", "n_chars", "n_chars DIV 100 AS score")


SCORED = """scored AS (SELECT doc_id, source, lang, quality, toxic, n_chars, n_chars // 100 AS score
 FROM documents JOIN labels USING (doc_id))"""


def intervals(spark, sf, divisor: int = 10):
    """Half-open intervals per contig and strand (day of shipment, length from quantity)."""
    return _view(spark, sf, "lineitem", "concat('c', l_suppkey) AS contig", "l_linestatus AS strand",
                 "concat(l_orderkey, '/', l_linenumber, '/', l_partkey) AS row_id", "concat('P', l_partkey % 40) AS gene_id",
                 "CAST(datediff(l_shipdate, DATE'1992-01-01') AS BIGINT) AS start_pos",
                 f"CAST(datediff(l_shipdate, DATE'1992-01-01') + 1 + CAST(l_quantity AS BIGINT) DIV {divisor} AS BIGINT) AS end_pos",
                 "l_returnflag AS kind", "l_orderkey", "l_partkey", "l_suppkey")


INTERVALS = """ivl AS (SELECT 'c' || l_suppkey AS contig, l_linestatus AS strand,
 l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row_id, 'P' || (l_partkey % 40) AS gene_id,
 CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT) AS start_pos,
 CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) + 1 + CAST(l_quantity AS BIGINT) // 10 AS BIGINT) AS end_pos,
 l_returnflag AS kind, l_orderkey, l_partkey, l_suppkey FROM lineitem)"""

# Letters by falling frequency, mapped onto the four bases in turn.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
BASES = ("ATGC" * 7)[:len(LETTERS)]


def dna(spark, sf, deal=spread):
    """Whole texts as base sequences; characters other than a-z are removed."""
    return deal(table(spark, sf, "documents").select("doc_id", "text")).selectExpr(
        "doc_id AS seq_id", f"translate(regexp_replace(lower(text), '[^a-z]', ''), '{LETTERS}', '{BASES}') AS seq")


DNA = f"""dna AS (SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
 '{LETTERS}', '{BASES}') AS seq FROM documents)"""


def profile(spark, sf):
    """Per-position values of each vector: long rows (vec_id, label, pos from 1, value)."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("p0", "v")).selectExpr(
        "vec_id", "CAST(label AS BIGINT) AS label", "CAST(p0 + 1 AS BIGINT) AS pos", "CAST(v AS DOUBLE) AS value")


PROFILE = """profile AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos,
 CAST(embedding[pos] AS DOUBLE) AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS pos))"""


def contacts(spark, sf):
    """Sparse contact cells per replicate: (replicate, bin1, bin2, value)."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("replicate"), F.expr("l_partkey DIV 20").alias("bin1"),
        F.col("l_suppkey").alias("bin2")).agg(F.count("*").cast("double").alias("value"))


CONTACTS = """contacts AS (SELECT l_returnflag AS replicate, l_partkey // 20 AS bin1, l_suppkey AS bin2,
 CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"""


def sql(*parts: str, tail: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " " + tail


def pairs(spark, sf):
    """Ordered-pair panel with nullable support and contact."""
    from tallyarc.operators.rollup import pair_support

    return pair_support(reads(spark, sf), keep=["parent_a", "parent_b", "l_partkey", "l_suppkey"]).selectExpr(
        "pair_id", "parent_a", "parent_b", "l_partkey AS pk", "l_suppkey AS sk",
        "CAST(l_partkey % 7 = 0 AS INT) AS label",
        "CASE WHEN l_partkey % 11 <> 0 THEN support END AS long_read_support", "CAST(NULL AS DOUBLE) AS sample_count",
        "CAST(l_partkey % 3 <> l_suppkey % 3 AS INT) AS is_interchromosomal",
        "abs(l_partkey * 10 - l_suppkey * 7) AS genomic_distance",
        "CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 17) / 4.0D END AS contact")


PAIRS = """pairs AS (SELECT pair_id, parent_a, parent_b, l_partkey AS pk, l_suppkey AS sk, CAST(l_partkey % 7 = 0 AS INT) AS label,
 CASE WHEN l_partkey % 11 <> 0 THEN count(DISTINCT read_id) END AS long_read_support, CAST(NULL AS DOUBLE) AS sample_count,
 CAST(l_partkey % 3 <> l_suppkey % 3 AS INT) AS is_interchromosomal, abs(l_partkey * 10 - l_suppkey * 7) AS genomic_distance,
 CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 17) / 4.0 END AS contact
 FROM reads GROUP BY pair_id, parent_a, parent_b, l_partkey, l_suppkey)"""

# Arms of a split read, shaped from order lines.
_SPLITS = [
    ("row_id", "{cat}"), ("read_id", "l_orderkey"), ("shorter_anchor", "CAST(l_quantity * 10 AS BIGINT)"),
    ("shorter_overlap", "CAST(80 + l_partkey % 400 AS BIGINT)"), ("genes_left", "CAST(1 + l_suppkey % 10 {div} 9 AS BIGINT)"),
    ("genes_right", "CAST(1 + l_partkey % 12 {div} 11 AS BIGINT)"), ("mapq", "CAST(l_orderkey % 61 AS BIGINT)"),
    ("competitors", "CAST(l_linenumber {div} 6 AS BIGINT)"), ("coverage", "CAST(1 - l_discount * 3 AS DOUBLE)"),
    ("query_gap", "CAST(l_partkey % 60 - 30 AS BIGINT)"), ("span", "CAST(l_quantity * 20 AS DOUBLE)"),
    ("margin", "CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_partkey % 300 AS DOUBLE) END"),
    ("single_coverage", "CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_orderkey % 101 AS DOUBLE) / 100 END"),
    ("arm1", "CAST(60 + l_partkey % 100 AS BIGINT)"), ("arm2", "CAST(60 + l_orderkey % 200 AS BIGINT)"),
    ("mapq2", "CAST(10 + l_suppkey % 50 AS BIGINT)"), ("statistic", "CAST(l_discount AS DOUBLE)"),
    ("caller", "CASE WHEN l_linestatus = 'F' THEN 'LongGF' ELSE 'Genion' END"), ("flag", "l_returnflag"),
]


def splits(spark, sf):
    return _view(spark, sf, "lineitem", *[
        e.format(div="DIV", cat="concat(l_orderkey, '/', l_linenumber, '/', l_partkey)") + f" AS {n}" for n, e in _SPLITS])


SPLITS = "splits AS (SELECT " + ", ".join(
    e.format(div="//", cat="l_orderkey || '/' || l_linenumber || '/' || l_partkey") + f" AS {n}" for n, e in _SPLITS) + " FROM lineitem)"
