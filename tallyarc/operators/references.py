"""Whether annotation, contigs and transcript sequences belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.operators.contracts import guarded

# Transcript types without a protein.
NONCODING = ["lncRNA", "lincRNA", "antisense", "processed_transcript"]


def audit_findings(features: DataFrame, contigs: DataFrame, sequences: DataFrame) -> DataFrame:
    """kind, name, observed, expected: what an audit of a reference has to report.

    ``features`` has contig, feature (transcript or exon), start, end (from 1, inclusive),
    transcript_id and biotype; ``contigs`` contig and length; ``sequences`` transcript_id and
    bases. Kinds: biotype (transcripts of a type; null: UNKNOWN), absent_contig (features on a
    contig without length), invalid_interval (a feature's end and its contig's length),
    missing_sequence, missing_annotation, length_difference (exon bases, sequence bases).
    Transcripts are those with a transcript record; a second record or none of an id fails.
    """
    start, end = F.col("start"), F.col("end")
    placed = features.join(contigs, "contig", "left")
    absent = placed.where("length IS NULL").groupBy("contig").agg(F.count("*").alias("n"))
    wrong = placed.where((start < 1) | (end < start) | (end > F.col("length"))).where("length IS NOT NULL")
    record = F.col("feature") == "transcript"
    exon = F.when(F.col("feature") == "exon", end - start + 1)
    models = features.groupBy("transcript_id").agg(F.count_if(record).alias("records"), F.max(F.when(record, F.coalesce("biotype", F.lit("UNKNOWN")))).alias("biotype"),
                                                   F.coalesce(F.sum(exon), F.lit(0)).alias("exon_bases")).where("records > 0 OR transcript_id IS NULL")
    bad = F.col("transcript_id").isNull() | (F.col("records") > 1)
    models = models.withColumn("biotype", guarded(F.col("biotype"), bad, "missing or duplicate transcript id"))
    types = models.groupBy("biotype").agg(F.count("*").alias("n"))
    both = models.join(sequences, "transcript_id", "full_outer")
    kind = (F.when(F.col("bases").isNull(), "missing_sequence").when(F.col("biotype").isNull(), "missing_annotation")
            .when(F.col("exon_bases") != F.col("bases"), "length_difference"))
    row = lambda t, kind, name, observed, expected: t.select(kind.alias("kind"), name.alias("name"), observed.cast("long").alias("observed"), expected.cast("long").alias("expected"))
    none = F.lit(None)
    return (row(types, F.lit("biotype"), F.col("biotype"), F.col("n"), none)
            .unionAll(row(absent, F.lit("absent_contig"), F.col("contig"), F.col("n"), none))
            .unionAll(row(wrong, F.lit("invalid_interval"), F.concat_ws(":", "transcript_id", "contig", "start"), end, F.col("length")))
            .unionAll(row(both.withColumn("kind", kind).where("kind IS NOT NULL"), F.col("kind"), F.col("transcript_id"), F.col("exon_bases"), F.col("bases"))))


def audit_verdict(findings: DataFrame) -> DataFrame:
    """One row: transcripts, noncoding_present, problems, compatible (some transcripts, noncoding ones too, no problem)."""
    typed = F.col("kind") == "biotype"
    totals = findings.agg(F.coalesce(F.sum(F.when(typed, F.col("observed"))), F.lit(0)).alias("transcripts"),
                          (F.count_if(typed & F.col("name").isin(NONCODING)) > 0).alias("noncoding_present"), F.count_if(~typed).alias("problems"))
    return totals.withColumn("compatible", (F.col("transcripts") > 0) & F.col("noncoding_present") & (F.col("problems") == 0))
