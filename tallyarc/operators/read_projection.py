"""Split reads projected on the reference: sequences, an edit ledger, and a base map of both arms.

The reference is a table of fixed-width chunks. Alignments are taken apart into their
operations, each operation fetches its chunks by (contig, chunk) and gets its read and
quality slices, and the pieces are put together per arm and per read. A task never holds
more than one alignment; contigs of any length are only met in chunks.

An arm is (read_id, arm) with target, strand, start (zero-based), cigar, qstart, qend in
read orientation; ``arm`` is ``left`` or ``right``. A read has sequence and quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.functions.alignment import cigar_ops
from tallyarc.functions.sequence import reverse_complement
from tallyarc.operators.contracts import guarded

ARM = ["read_id", "arm"]
#: Fixed value: the least Phred score of a base that counts as observed.
HIGH_QUALITY = 30
#: Names of actions and of reasons to leave a sequence unresolved.
KEPT, CORRECTED = "retain_high_quality_observed_substitution", "reference_assisted_low_quality_correction"
REMOVED, RESTORED = "reference_assisted_insertion_removal", "reference_assisted_deletion_restoration"
INSERTION, DELETION = "high_quality_insertion", "deletion_with_high_quality_flanks"
OVERLAP_INDEL, OVERLAP_DIFFERS, GAP_QUALITY = "indel_within_query_overlap_requires_coordinate_resolution", "overlap_has_different_reference_sequences", "untemplated_gap_sequence_below_Q30"

ALIGNED, ON_REFERENCE, ON_READ = ("M", "=", "X"), ("M", "=", "X", "D"), ("M", "=", "X", "I", "S", "H")
EDIT = "struct<action:string,query_position:int,reference_position:bigint,observed:string,reference:string,length:int,phred:int>"


def chunked(sequences: DataFrame, contig: str, seq: str, width: int = 256) -> DataFrame:
    """contig, chunk, bases: every sequence in pieces of ``width`` bases."""
    return sequences.select(F.col(contig).alias("contig"), F.posexplode(F.regexp_extract_all(seq, F.lit(f".{{1,{width}}}"), F.lit(0))).alias("chunk", "bases"))


def operations(arms: DataFrame) -> DataFrame:
    """A row for each CIGAR operation: step, op, n, q (read offset in alignment orientation), r (reference offset)."""
    rows = arms.select(*ARM, "target", "strand", "start", F.posexplode(cigar_ops(F.col("cigar"))).alias("step", "o")).select(
        *ARM, "target", "strand", "start", "step", "o.op", "o.n")
    before = Window.partitionBy(*ARM).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # one alignment's operations
    used = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n"))).over(before), F.lit(0))
    return rows.withColumn("q", used(ON_READ).cast("int")).withColumn("r", F.col("start") + used((*ON_REFERENCE, "N"))).drop("start")


def fetch(spans: DataFrame, chunks: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """keys, bases of the spans (keys, target, r, n): their chunks, stitched; a span outside its contig fails."""
    wanted = spans.where("n > 0").select(*keys, "target", "r", "n", F.explode(F.sequence(F.floor(F.col("r") / width).cast("int"), F.floor((F.col("r") + F.col("n") - 1) / width).cast("int"))).alias("chunk"))
    met = wanted.join(chunks.withColumnRenamed("contig", "target"), ["target", "chunk"], "left")
    at = F.col("chunk") * width
    first = F.greatest(F.col("r") - at, F.lit(0))
    piece = F.substr("bases", (first + 1).cast("int"), (F.least(F.col("r") + F.col("n") - at, F.lit(width)) - first).cast("int"))
    whole = met.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("piece")))).alias("pieces"))
    bases = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return whole.select(*keys, guarded(bases, F.length(bases) != F.col("n"), "reference coordinates out of range").alias("bases"))


def _phred(letters: Column) -> Column:
    return F.transform(F.split(letters, ""), lambda c: F.ascii(c) - 33)


def _aligned(part: str) -> Column:
    """Projected bases and edits of an aligned operation; equal slices need no look at their letters."""
    letters = {"ref": F.split("bases", ""), "seen": F.split("observed", ""), "phred": _phred(F.col("scores"))}
    bound = F.array(F.struct(*[v.alias(k) for k, v in letters.items()]))
    places = F.sequence(F.lit(0), F.col("n") - 1)

    def letter(v):
        return F.array_join(F.transform(places, lambda i: F.when((F.get(v["ref"], i) != F.get(v["seen"], i)) & (F.get(v["phred"], i) >= HIGH_QUALITY), F.get(v["seen"], i)).otherwise(F.get(v["ref"], i))), "")

    def edits(v):
        made = F.transform(places, lambda i: F.when(F.get(v["ref"], i) != F.get(v["seen"], i), F.struct(
            F.when(F.get(v["phred"], i) >= HIGH_QUALITY, KEPT).otherwise(CORRECTED).alias("action"), (F.col("q") + i).alias("query_position"), (F.col("r") + i).alias("reference_position"),
            F.get(v["seen"], i).alias("observed"), F.get(v["ref"], i).alias("reference"), F.lit(None).cast("int").alias("length"), F.get(v["phred"], i).alias("phred"))))
        return F.filter(made, lambda e: e.isNotNull())

    return F.get(F.transform(bound, letter if part == "bases" else edits), F.lit(0))


def projected_steps(arms: DataFrame, reads: DataFrame, chunks: DataFrame, width: int = 256) -> DataFrame:
    """Operations with ``projected`` (their reference bases, high-quality substitutions kept), ``edits`` and the reason why one is ``unresolved``.

    Deletions are restored and insertions leave no base; either stays unresolved where its
    own bases, or the bases beside it, are of high quality. Edits are in alignment orientation.
    """
    ops = operations(arms)
    bases = fetch(ops.where(F.col("op").isin(*ON_REFERENCE)), chunks, [*ARM, "step"], width)
    turned = F.col("strand") == "-"
    oriented = ops.join(bases, [*ARM, "step"], "left").join(reads.select("read_id", "sequence", "quality"), "read_id").withColumns({
        "_seq": F.when(turned, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")), "_qual": F.when(turned, F.reverse("quality")).otherwise(F.col("quality"))})
    beyond = F.col("op").isin(*ON_READ) & ((F.col("q") + F.col("n") > F.length("sequence")) | (F.length("quality") != F.length("sequence")))
    oriented = oriented.withColumn("n", guarded(F.col("n"), beyond, "CIGAR, read and quality differ in length"))
    first = F.when(F.col("op") == "D", F.greatest(F.col("q") - 1, F.lit(0))).otherwise(F.col("q"))
    size = F.when(F.col("op") == "D", F.col("q") + 1 - first).otherwise(F.col("n"))
    sliced = oriented.select(*ARM, "target", "strand", "step", "op", "n", "q", "r", "bases",
                             F.substr("_seq", F.col("q") + 1, F.col("n")).alias("observed"), F.substr("_qual", first + 1, size).alias("scores"))
    aligned, same = F.col("op").isin(*ALIGNED), F.col("bases") == F.col("observed")
    least = F.when(F.length("scores") > 0, F.array_min(_phred(F.col("scores"))))
    indel = F.array(F.struct(F.when(F.col("op") == "I", REMOVED).otherwise(RESTORED).alias("action"), F.col("q").alias("query_position"), F.lit(None).cast("bigint").alias("reference_position"),
                             F.lit(None).cast("string").alias("observed"), F.lit(None).cast("string").alias("reference"), F.col("n").alias("length"), least.alias("phred")))
    none = F.array().cast(f"array<{EDIT}>")
    return sliced.select(
        *ARM, "target", "strand", "step", "op", "n", "q", "r",
        F.when(aligned & ~same & (F.col("n") > 0), _aligned("bases")).when(F.col("op").isin(*ON_REFERENCE), F.coalesce("bases", F.lit(""))).otherwise("").alias("projected"),
        F.when(aligned & ~same & (F.col("n") > 0), _aligned("edits")).when(F.col("op").isin("I", "D"), indel).otherwise(none).cast(f"array<{EDIT}>").alias("edits"),
        F.when(F.col("op").isin("I", "D") & (least >= HIGH_QUALITY), F.when(F.col("op") == "I", INSERTION).otherwise(DELETION)).alias("unresolved"))


def projected_arms(steps: DataFrame) -> DataFrame:
    """read_id, arm, projected: the arm's sequence in read orientation."""
    whole = steps.groupBy(*ARM, "strand").agg(F.array_sort(F.collect_list(F.struct("step", "projected"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["projected"]), "")
    return whole.select(*ARM, F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text).alias("projected"))


def edit_ledger(steps: DataFrame) -> DataFrame:
    """A row for each correction, kept variant, removed insertion and restored deletion."""
    return steps.select(*ARM, "target", "strand", F.explode("edits").alias("e")).select(*ARM, "target", "strand", "e.*")


def paired(arms: DataFrame, reads: DataFrame) -> DataFrame:
    """A row for each read with both arms: left_qend, right_qstart, gap and the read."""
    side = lambda arm, *columns: arms.where(F.col("arm") == arm).select("read_id", *[F.col(c).alias(f"{arm}_{c}") for c in columns])
    both = side("left", "qend").join(side("right", "qstart"), "read_id")
    return both.withColumn("gap", (F.col("right_qstart") - F.col("left_qend")).cast("int")).join(reads.select("read_id", "sequence", "quality"), "read_id")


def reconstructed(steps: DataFrame, arms: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, gap, assisted (sequence of both arms), low, high (its junction), observed_low, observed_high, sequence, _differs, _poor.

    A shared overlap counts once, from the left arm; a gap takes the read's own bases.
    """
    text = projected_arms(steps)
    side = lambda arm: text.where(F.col("arm") == arm).select("read_id", F.col("projected").alias(arm))
    rows = paired(arms, reads).join(side("left"), "read_id").join(side("right"), "read_id")
    gap, shared = F.col("gap"), F.greatest(-F.col("gap"), F.lit(0))
    insert = F.substr("sequence", (F.col("left_qend") + 1).cast("int"), F.greatest(gap, F.lit(0)))
    n = F.length("left")
    ends = F.substr("left", F.greatest(n - shared, F.lit(0)) + 1, shared) != F.substr("right", F.lit(1), shared)
    scores = F.substr("quality", (F.col("left_qend") + 1).cast("int"), F.greatest(gap, F.lit(0)))
    return rows.select(
        "read_id", "gap", F.concat("left", insert, F.substr("right", shared + 1, F.greatest(F.length("right") - shared, F.lit(0)))).alias("assisted"),
        F.greatest(n - shared, F.lit(0)).alias("low"), (n + F.greatest(gap, F.lit(0))).alias("high"),
        F.least("left_qend", "right_qstart").cast("int").alias("observed_low"), F.greatest("left_qend", "right_qstart").cast("int").alias("observed_high"), "sequence",
        ((shared > 0) & ends).alias("_differs"), F.coalesce((gap > 0) & (F.array_min(_phred(scores)) < HIGH_QUALITY), F.lit(False)).alias("_poor"))


def unresolved_reasons(steps: DataFrame, arms: DataFrame, reads: DataFrame, whole: DataFrame) -> DataFrame:
    """read_id, arm (null: the junction), reason, query_start, length: why a read's sequence stays unresolved, a row for each.

    ``whole`` is reconstructed(); indels inside the query overlap of the arms are given in
    read coordinates, other ones in alignment orientation.
    """
    own = steps.where("unresolved IS NOT NULL").select(*ARM, F.col("unresolved").alias("reason"), F.col("q").cast("long").alias("query_start"), F.col("n").cast("long").alias("length"))
    spans = paired(arms, reads).where("gap < 0").select("read_id", F.col("right_qstart").alias("_lo"), F.col("left_qend").alias("_hi"), F.length("sequence").alias("_len"))
    inserted = F.when(F.col("op") == "I", F.col("n")).otherwise(0)
    start = F.when(F.col("strand") == "-", F.col("_len") - F.col("q") - inserted).otherwise(F.col("q"))
    hit = ((F.col("op") == "I") & (F.col("query_start") < F.col("_hi")) & (F.col("query_start") + F.col("n") > F.col("_lo"))) | (
        (F.col("op") == "D") & (F.col("_lo") <= F.col("query_start")) & (F.col("query_start") <= F.col("_hi")))
    inside = steps.where(F.col("op").isin("I", "D")).join(spans, "read_id").withColumn("query_start", start.cast("long")).where(hit).select(
        *ARM, F.lit(OVERLAP_INDEL).alias("reason"), "query_start", F.col("n").cast("long").alias("length"))
    size = F.abs("gap").cast("long")
    joint = whole.select("read_id", F.lit(None).cast("string").alias("arm"), F.explode(F.array_compact(F.array(
        F.when(F.col("_differs"), F.lit(OVERLAP_DIFFERS)), F.when(F.col("_poor"), F.lit(GAP_QUALITY))))).alias("reason"), F.lit(None).cast("long").alias("query_start"), size.alias("length"))
    return own.unionByName(inside).unionByName(joint)


def base_map(arms: DataFrame) -> DataFrame:
    """Stretches of the joined sequence with their reference origin: read_id, arm, target, strand, lo, hi (joined sequence), first (reference base of ``lo``), r, r_end.

    Bases of a shared overlap have a stretch of either arm, bases of a gap have none;
    positions fall along the stretch on the reverse strand.
    """
    ops = operations(arms)
    on = ops.where(F.col("op").isin(*ON_REFERENCE))
    before = Window.partitionBy(*ARM).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = on.withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy(*ARM)))
    lo = F.when(F.col("strand") == "-", F.col("_all") - F.col("_at") - F.col("n")).otherwise(F.col("_at"))
    sizes = on.groupBy(*ARM).agg(F.sum("n").alias("size"))
    side = lambda arm, c, df: df.where(F.col("arm") == arm).select("read_id", F.col(c).alias(f"_{arm}"))
    shift = side("left", "size", sizes).join(side("right", "size", sizes), "read_id").join(
        arms.where("arm = 'left'").select("read_id", F.col("qend").alias("_end")), "read_id").join(arms.where("arm = 'right'").select("read_id", F.col("qstart").alias("_start")), "read_id")
    gap = F.col("_start") - F.col("_end")
    shift = shift.select("read_id", guarded(F.col("_left") + gap, -gap > F.least("_left", "_right"), "arms overlap by more than their length").alias("_shift"))
    moved = placed.join(shift, "read_id").withColumn("lo", lo + F.when(F.col("arm") == "right", F.col("_shift")).otherwise(F.lit(0)))
    return moved.select(*ARM, "target", "strand", F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n")).cast("long").alias("hi"),
                        F.when(F.col("strand") == "-", F.col("r") + F.col("n") - 1).otherwise(F.col("r")).cast("long").alias("first"),
                        F.col("r").cast("long").alias("r"), (F.col("r") + F.col("n")).cast("long").alias("r_end"))


def clipped(stretches: DataFrame, begin: str, end: str) -> DataFrame:
    """The parts of stretches inside [begin, end) of the joined sequence; others go."""
    lo, hi = F.greatest("lo", begin), F.least("hi", end)
    shift, drop = lo - F.col("lo"), F.col("hi") - hi
    down = F.col("strand") == "-"
    cut = stretches.withColumns({"_lo": lo, "_hi": hi, "_f": F.when(down, F.col("first") - shift).otherwise(F.col("first") + shift),
                                 "_r": F.col("r") + F.when(down, drop).otherwise(shift), "_e": F.col("r_end") - F.when(down, shift).otherwise(drop)}).where("_lo < _hi")
    keep = [c for c in stretches.columns if c not in ("lo", "hi", "first", "r", "r_end")]
    return cut.select(*keep, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_f").alias("first"), F.col("_r").alias("r"), F.col("_e").alias("r_end"))


def bases(stretches: DataFrame) -> DataFrame:
    """A row for each base of the stretches: at (joined sequence) and position (reference)."""
    keep = [c for c in stretches.columns if c not in ("lo", "hi", "first", "r", "r_end")]
    each = stretches.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - F.col("lo") - 1)).alias("_k"))
    return each.select(*keep, (F.col("lo") + F.col("_k")).alias("at"), F.when(F.col("strand") == "-", F.col("first") - F.col("_k")).otherwise(F.col("first") + F.col("_k")).alias("position"))
