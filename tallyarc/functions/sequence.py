"""Sequence expressions. Letters are split once into an array, so a position costs one lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.functions.binding import let

# Base order and amino letters of the standard genetic code, complements.
CODE_BASES = "TCAG"
CODE_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTNacgtn", "TGCANtgcan"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


#: Every codon with a blank behind it, in the order of the amino letters.
_CODONS = " ".join(a + b + c for a in CODE_BASES for b in CODE_BASES for c in CODE_BASES)


def amino_of(codon: Column) -> Column:
    """One-letter amino acid; X for anything but three of the four bases."""
    at = F.instr(F.lit(_CODONS), codon)
    return F.when((at % 4 == 1) & (F.length(codon) == 3), F.substr(F.lit(CODE_AMINO), ((at + 3) / 4).cast("int"), F.lit(1))).otherwise("X")


def translate_codons(seq: Column) -> Column:
    """In-frame translation; an incomplete last codon is dropped."""
    codons = F.regexp_extract_all(seq, F.lit("(?s)(.{3})"), 1)
    return F.array_join(F.transform(codons, amino_of), "")


STOPS = ("TAA", "TAG", "TGA")  # fixed values


def open_frames(seq: Column) -> Column:
    """array<struct<start,frame,stop_start,bad_codon>> of every ATG: the first stop in its frame and the first unreadable codon.

    All within the row: stops and unreadable codons become sorted arrays by frame, in which
    each ATG is placed by halving.
    """
    def marked(v):
        at = lambda i: F.get(v["letters"], i)
        codons = F.transform(F.sequence(F.lit(0), F.size(v["letters"]) - 3), lambda i: F.struct(
            i.alias("pos"), F.concat(at(i), at(i + 1), at(i + 2)).alias("codon")))
        return F.filter(codons, lambda t: t["codon"].isin("ATG", *STOPS) | t["codon"].rlike("[^ACGT]"))

    def by_frame(marks, keep):
        def of(frame):
            return F.transform(F.filter(marks, lambda t: keep(t["codon"]) & (t["pos"] % 3 == frame)), lambda t: t["pos"])

        return F.array(of(0), of(1), of(2))

    def sorted_marks(v):
        most = F.floor(F.log2(F.greatest(F.size(v["marks"]), F.lit(1)))).cast("int")
        return let(placed, starts=F.transform(F.filter(v["marks"], lambda t: t["codon"] == "ATG"), lambda t: t["pos"]),
                   stops=by_frame(v["marks"], lambda c: c.isin(*STOPS)), bad=by_frame(v["marks"], lambda c: c.rlike("[^ACGT]")),
                   halves=F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int")))

    def placed(v):
        def first_from(lists, pos):
            row = F.get(lists, pos % 3)
            below = F.aggregate(v["halves"], F.lit(0), lambda low, half: F.when(
                (low + half <= F.size(row)) & (F.get(row, low + half - 1) < pos), low + half).otherwise(low))
            return F.get(row, below)

        return F.transform(v["starts"], lambda p: F.struct(
            p.cast("long").alias("start"), (p % 3).cast("long").alias("frame"),
            first_from(v["stops"], p).cast("long").alias("stop_start"), first_from(v["bad"], p).cast("long").alias("bad_codon")))

    return F.when(F.length(seq) >= 3, let(lambda v: let(sorted_marks, marks=marked(v)), letters=F.split(seq, "")))


def first_stops(df: DataFrame, key: str, seq: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every ATG with the first stop in its frame (null without one) and the first unreadable codon from it on; no shuffle."""
    # Outer: else Catalyst adds a filter that works out the frames twice.
    rows = df.select(key, *keep, F.explode_outer(open_frames(F.col(seq))).alias("_f")).where("_f IS NOT NULL")
    return rows.select(key, *keep, "_f.start", "_f.frame", "_f.stop_start", "_f.bad_codon")


def spanning_frames(df: DataFrame, key: str, seq: str, low: str, high: str, minimum: int = 90, flank: int = 15) -> DataFrame:
    """Complete frames that cover the junction interval with ``flank`` coding bases each side."""
    ok = ((F.col("stop_start") - F.col("start") >= minimum) & (F.col("start") + flank <= F.col(low))
          & (F.col("stop_start") >= F.col(high) + flank) & (F.col("bad_codon").isNull() | (F.col("bad_codon") > F.col("stop_start"))))
    return _with_protein(first_stops(df, key, seq, [seq, low, high]).where(ok), seq)


def crossing_frames(df: DataFrame, key: str, seq: str, junction: str, minimum: int = 90) -> DataFrame:
    """Complete frames with start < junction < stop; an unreadable codon before the stop voids the frame."""
    ok = ((F.col("stop_start") - F.col("start") >= minimum) & (F.col("start") < F.col(junction)) & (F.col(junction) < F.col("stop_start"))
          & (F.col("bad_codon").isNull() | (F.col("bad_codon") > F.col("stop_start"))))
    return _with_protein(first_stops(df, key, seq, [seq, junction]).where(ok), seq)


# Codons before the junction from the first start behind the last stop or unreadable one, and those after it with the first stop, if no unreadable one comes before.
_OPEN_BEFORE = r"(?s)^(?:(?:...)*(?:TAA|TAG|TGA|[^ACGT]..|.[^ACGT].|..[^ACGT]))?(?:...)*?((?:ATG(?:...)*)?)\z"
_OPEN_AFTER = r"^((?:[ACGT]{3})*?(?:TAA|TAG|TGA))"


def crossing_stretches(seq: Column, junction: Column, minimum: int = 90) -> Column:
    """array<struct<first,stop_start,codons>>: the longest of the ``crossing_frames`` of each of the three reading frames; the others begin within it.

    Two patterns a frame, from the junction to the next stop on either side: no value for each letter of a sequence.
    """
    def of(frame):
        n = F.greatest(F.floor((junction - frame) / 3) + 1, F.lit(0)).cast("int")  # codons that begin at the junction or before
        before = F.regexp_extract(F.substr(seq, F.lit(frame + 1), 3 * n), _OPEN_BEFORE, 1)
        after = F.regexp_extract(F.substr(seq, 3 * n + frame + 1, F.length(seq)), _OPEN_AFTER, 1)
        return let(lambda v: F.struct((frame + 3 * n - F.length(v["before"])).cast("long").alias("first"), (frame + 3 * (n - 1) + F.length(v["after"])).cast("long").alias("stop_start"),
                                      F.when(v["after"] != "", F.concat(v["before"], F.substr(v["after"], F.lit(1), F.length(v["after"]) - 3))).alias("codons")), before=before, after=after)

    return F.filter(F.array(of(0), of(1), of(2)), lambda s: (F.length(s["codons"]) >= minimum) & (s["first"] < junction))


def _with_protein(frames: DataFrame, seq: str) -> DataFrame:
    coding = F.substr(F.col(seq), (F.col("start") + 1).cast("int"), (F.col("stop_start") - F.col("start")).cast("int"))
    return frames.withColumns({"coding_nt": F.col("stop_start") - F.col("start"), "protein": translate_codons(coding)})


def windows(text: Column, k: int) -> Column:
    """array<struct<pos,w>>: every k-letter window of a text, from one split into letters."""
    def cut(v):
        return F.transform(F.sequence(F.lit(0), F.size(v["letters"]) - k), lambda i: F.struct(
            i.alias("pos"), F.array_join(F.slice(v["letters"], i + 1, k), "").alias("w")))

    return F.when(F.length(text) >= k, let(cut, letters=F.split(text, "")))


def gc_fraction(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GC]", "")) / F.nullif(F.length(seq), F.lit(0))


def mean_phred(quality: Column, offset: int = 33) -> Column:
    """Phred value of the mean error probability of a quality string."""
    codes = F.transform(F.split(quality, ""), lambda c: F.ascii(c) - offset)
    error = F.aggregate(codes, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q / 10.0)) / F.size(codes)
    return -10 * F.log10(error)


def homopolymers(seq: Column, minimum: int = 10) -> Column:
    """Array of (start, end, base) for every tract of one base, 0-based half-open: one step for each tract and the gap before it."""
    pattern = rf"(?s)(.)\1{{{minimum - 1},}}"

    def placed(v):
        acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,base:string>>").alias("hits"))
        pairs = F.zip_with(F.slice(v["gaps"], 1, F.size(v["tracts"])), v["tracts"], lambda g, t: F.struct(F.length(g).alias("gap"), F.length(t).alias("n"), F.substring(t, 1, 1).alias("base")))
        walked = F.aggregate(pairs, acc, lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["n"]).alias("at"),
            F.concat(a["hits"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["n"]).alias("end"), p["base"].alias("base")))).alias("hits")))
        return walked["hits"]

    return let(placed, gaps=F.split(seq, pattern, -1), tracts=F.regexp_extract_all(seq, F.lit(pattern), 0))


def tracts_near_join(df: DataFrame, seq: str, low: str, high: Column, minimum: int = 10, flank: int = 50, reach: int = 75) -> DataFrame:
    """Rows of A or T tracts at least ``flank`` from both ends that touch the join interval widened by ``reach``."""
    rows = df.withColumn("_high", high).select("*", F.explode(homopolymers(F.col(seq), minimum)).alias("_t"))
    at, end = F.col("_t.start").cast("long"), F.col("_t.end").cast("long")
    inner = (at >= flank) & (F.length(seq) - end >= flank)
    near = (at <= F.col("_high") + reach) & (end >= F.col(low) - reach)
    return rows.where(F.col("_t.base").isin("A", "T") & inner & near).select(*df.columns, at.alias("start"), end.alias("end"), F.col("_t.base").alias("base"))


def fasta_wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
