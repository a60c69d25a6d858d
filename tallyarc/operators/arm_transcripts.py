"""Transcripts for the arms of split reads, and the coding frame of their codons.

Works on the stretches of read_projection.base_map: an arm's origin is a few intervals and
the jumps between them, so coverage is an interval join and splice agreement an equi-join
on the jump itself. Only codon states look at single bases, and those of one read at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.operators.intervals import overlap_join
from tallyarc.operators.read_projection import ARM, bases, clipped
from tallyarc.operators.transcripts import spliced
from tallyarc.session import cut_lineage

#: States of a codon.
MIXED, OUTSIDE, SAME, OTHER = "junction/shared/unmapped codon", "outside annotated CDS", "same annotated CDS frame", "alternative CDS frame"
SCORES = ["coding_bases_exonic", "exact_splice_jumps", "full_arm_bases_exonic"]


def splice_jumps(exons: DataFrame) -> DataFrame:
    """gene, tx, a, b: last base of an exon and first base of the next in transcript order; exons are (gene, tx, strand, xs, xe), half-open."""
    down = F.col("strand") == "-"
    order = Window.partitionBy("gene", "tx", "strand").orderBy(F.when(down, -F.col("xs")).otherwise(F.col("xs")))  # one transcript's exons
    after = exons.withColumns({"_s": F.lead("xs").over(order), "_e": F.lead("xe").over(order)}).where("_s IS NOT NULL")
    return after.select("gene", "tx", F.when(down, F.col("xs")).otherwise(F.col("xe") - 1).alias("a"), F.when(down, F.col("_e") - 1).otherwise(F.col("_s")).alias("b")).distinct()


def arm_jumps(stretches: DataFrame) -> DataFrame:
    """read_id, arm, gene, a, b: neighbouring bases of an arm that aren't neighbours on the reference."""
    last = F.when(F.col("strand") == "-", F.col("r")).otherwise(F.col("r_end") - 1)
    after = Window.partitionBy(*ARM).orderBy("lo")  # one arm's stretches
    rows = stretches.select(*ARM, "gene", last.alias("a"), F.lead("first").over(after).alias("b"))
    return rows.where(F.abs(F.col("b") - F.col("a")) > 1)


def transcript_candidates(stretches: DataFrame, coding: DataFrame, exons: DataFrame, width: int = 256) -> DataFrame:
    """read_id, arm, tx and its scores: every transcript of the arm's gene, also those that nothing supports.

    ``stretches`` carry ``gene``; ``coding`` is (read_id, begin, end) in the joined sequence.
    Scores: coding bases in exons, jumps that are splices, bases of the whole arm in exons.
    """
    span = stretches.select(*ARM, "gene", "lo", F.col("r").alias("_r"), F.col("r_end").alias("_e"))
    part = clipped(stretches, "begin", "end") if "begin" in stretches.columns else clipped(stretches.join(coding, "read_id"), "begin", "end")
    part = part.select(*ARM, "gene", "lo", F.col("r").alias("_r"), F.col("r_end").alias("_e"))
    both = span.withColumn("_coding", F.lit(0)).unionByName(part.withColumn("_coding", F.lit(1)))
    met = overlap_join(both, exons.select("gene", "tx", "xs", "xe"), ["gene"], ("_r", "_e"), ("xs", "xe"), width)
    covered = met.select(*ARM, "tx", F.when(F.col("_coding") == 1, F.col("overlap")).alias("c"), F.lit(None).cast("long").alias("j"), F.when(F.col("_coding") == 0, F.col("overlap")).alias("f"))
    spliced_ = arm_jumps(stretches).join(splice_jumps(exons), ["gene", "a", "b"]).select(*ARM, "tx", F.lit(None).cast("long").alias("c"), F.lit(1).cast("long").alias("j"), F.lit(None).cast("long").alias("f"))
    every = stretches.select(*ARM, "gene").distinct().join(exons.select("gene", "tx").distinct(), "gene").select(*ARM, "tx", *[F.lit(0).cast("long").alias(c) for c in "cjf"])
    return covered.unionByName(spliced_).unionByName(every).groupBy(*ARM, "tx").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in zip("cjf", SCORES, strict=True)])


def chosen_transcripts(candidates: DataFrame) -> DataFrame:
    """The best transcript of each arm by its scores in order, the smallest name of equals, and how many are equal."""
    per = candidates.groupBy(*ARM, *SCORES).agg(F.count("*").alias("tied"), F.min("tx").alias("tx"))
    top = per.groupBy(*ARM).agg(F.max(F.struct(*SCORES, "tied", "tx")).alias("m"))
    return top.select(*ARM, "m.tx", *[F.col(f"m.{c}").alias(c) for c in SCORES], "m.tied")


def phased(cds: DataFrame) -> DataFrame:
    """CDS segments (tx, strand, cs, ce; half-open) with ``phase``: bases to pass before the first whole codon, from the lengths before in transcript order."""
    one = cds.select("tx", "strand", "cs", "ce", (F.col("cs") + 1).alias("_s"), F.col("ce").alias("_e"))
    return spliced(one, "tx", "strand", "_s", "_e").select("tx", "strand", "cs", "ce", F.pmod(-F.col("tx_start"), F.lit(3)).cast("int").alias("phase"))


def codon_states(stretches: DataFrame, coding: DataFrame, chosen: DataFrame, cds: DataFrame, width: int = 256) -> DataFrame:
    """read_id, codon (from 0), state of every codon of the coding part [begin, end) of a joined sequence.

    A codon with a base of no origin or of two, or with bases of both arms, has no single
    frame. Else its stretches meet the CDS of the arm's transcript (``chosen``: read_id, arm,
    tx; ``cds``: phased()), base by base only where they overlap: all must lie in it, and in its frame.
    """
    own = chosen.select(*ARM, "tx")
    # Read several times: without a stored table its joins would be planned and run again for each.
    part = cut_lineage(clipped(stretches.join(coding, "read_id"), "begin", "end").join(own, ARM, "left"))
    place = lambda at: [F.floor((at - F.col("begin")) / 3).alias("codon"), ((at - F.col("begin")) % 3).cast("int").alias("slot")]
    each = bases(part).select("read_id", "arm", *place(F.col("at")))
    spans = part.where("tx IS NOT NULL").select("read_id", "tx", "begin", "lo", "first", "r", "r_end")
    met = overlap_join(spans, cut_lineage(cds), ["tx"], ("r", "r_end"), ("cs", "ce"), width)
    inside = F.sequence(F.greatest("r", "cs"), F.least("r_end", "ce") - 1)
    hit = met.withColumn("position", F.explode(inside)).select("read_id", "strand", "cs", "ce", "phase", "position", *place(F.col("lo") + F.abs(F.col("position") - F.col("first"))))
    local = F.when(F.col("strand") == "-", F.col("ce") - 1 - F.col("position")).otherwise(F.col("position") - F.col("cs"))
    in_frame = F.pmod(local - F.coalesce("phase", F.lit(0)), F.lit(3)) == F.col("slot")
    rows = each.select("read_id", "codon", "arm", "slot", F.lit(None).cast("boolean").alias("in_frame")).unionByName(
        hit.select("read_id", "codon", F.lit(None).cast("string").alias("arm"), F.lit(None).cast("int").alias("slot"), in_frame.alias("in_frame")))
    n = lambda s: F.count_if(F.col("slot") == s)
    tally = rows.groupBy("read_id", "codon").agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"), F.min("arm").alias("a"), F.max("arm").alias("b"),
                                                 F.count("in_frame").alias("hits"), F.min("in_frame").alias("same"))
    codons = F.floor((F.col("end") - F.col("begin")) / 3)
    every = coding.where(codons > 0).select("read_id", F.explode(F.sequence(F.lit(0).cast("long"), codons - 1)).alias("codon"))
    whole = (F.col("n0") == 1) & (F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("a") == F.col("b"))
    state = F.when(~F.coalesce(whole, F.lit(False)), MIXED).when(F.col("hits") < 3, OUTSIDE).when(F.col("same"), SAME).otherwise(OTHER)
    return every.join(tally, ["read_id", "codon"], "left").select("read_id", "codon", state.alias("state"))
