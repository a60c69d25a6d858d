"""Split reads: projection, base map, transcripts, codon frames and comparison with other explanations."""

import pytest
from pyspark.sql import functions as F

from tallyarc.operators import arm_transcripts as T
from tallyarc.operators import read_comparison as C
from tallyarc.operators import read_projection as R

ARMS = "read_id string, arm string, target string, strand string, start long, cigar string, qstart long, qend long"
STRETCHES = "read_id string, arm string, target string, strand string, lo long, hi long, first long, r long, r_end long"


def flipped(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def reads_of(spark, *rows):
    return spark.createDataFrame([r for r in rows], "read_id string, sequence string, quality string")


@pytest.fixture(scope="module")
def chunks(spark):
    return R.chunked(spark.createDataFrame([("chr1", "ATGAAACCC"), ("chr2", "GATTACAGATTACA")], "c string, s string"), "c", "s", 4)


def test_projection_keeps_variants_of_high_quality_and_restores_the_reference(spark, chunks):
    """A variant seen with quality, one without, an insertion, both strands, a deletion with and without good flanks."""
    cases = {"seen": ("+", "9M", "ATGAAATCC", "I" * 9), "poor": ("+", "9M", "ATGAAATCC", "!" * 9), "inserted": ("+", "3M1I6M", "ATGCAAACCC", "I" * 10), "poorly inserted": ("+", "3M1I6M", "ATGCAAACCC", "III!IIIIII"),
             "reverse": ("-", "9M", flipped("ATGAAACCC"), "I" * 9), "deleted": ("+", "4M2D3M", "ATGACCC", "I" * 7), "poor flank": ("+", "4M2D3M", "ATGACCC", "III!III"), "reverse variant": ("-", "9M", flipped("ATGAAATCC"), "!" * 8 + "I")}
    arms = spark.createDataFrame([(k, "left", "chr1", s, 0, cigar, 0, len(seq)) for k, (s, cigar, seq, _) in cases.items()], ARMS)
    reads = reads_of(spark, *[(k, seq, qual) for k, (_, _, seq, qual) in cases.items()])
    steps = R.projected_steps(arms, reads, chunks, 4).persist()
    got = {r.read_id: r.projected for r in R.projected_arms(steps).collect()}
    whole = "ATGAAACCC"
    assert got == {k: whole for k in cases} | {"seen": "ATGAAATCC", "reverse": flipped(whole), "reverse variant": flipped(whole)}
    edits = {(r.read_id, r.action, r.query_position, r.reference_position, r.observed, r.reference, r.length, r.phred) for r in R.edit_ledger(steps).collect()}
    assert edits == {("seen", R.KEPT, 6, 6, "T", "C", None, 40), ("poor", R.CORRECTED, 6, 6, "T", "C", None, 0), ("inserted", R.REMOVED, 3, None, None, None, 1, 40), ("poorly inserted", R.REMOVED, 3, None, None, None, 1, 0),
                     ("deleted", R.RESTORED, 4, None, None, None, 2, 40), ("poor flank", R.RESTORED, 4, None, None, None, 2, 0), ("reverse variant", R.CORRECTED, 6, 6, "T", "C", None, 0)}
    assert {(r.read_id, r.unresolved) for r in steps.where("unresolved IS NOT NULL").collect()} == {("inserted", R.INSERTION), ("deleted", R.DELETION)}


@pytest.mark.parametrize("start,cigar", [(5, "9M"), (-1, "9M"), (0, "10M")])
def test_outside_the_contig_or_the_read_fails(spark, chunks, start, cigar):
    arms = spark.createDataFrame([("r", "left", "chr1", "+", start, cigar, 0, 9)], ARMS)
    with pytest.raises(Exception, match="out of range|differ in length"):
        R.projected_arms(R.projected_steps(arms, reads_of(spark, ("r", "ATGAAACCC", "I" * 9)), chunks, 4)).collect()


def test_two_arms_meet_in_overlap_gap_or_edge(spark, chunks):
    """Reads of chr1 and chr2: shared bases once, gap bases from the read, and the reasons that leave a read open."""
    rows, reads = [], []
    for name, left, right, seq, qual in (
            ("edge", ("9M5S", 0, 9), ("9S5M", 9, 14), "ATGAAACCCGATTA", "I" * 14),
            ("gap", ("9M7S", 0, 9), ("11S5M", 11, 16), "ATGAAACCCTTGATTA", "I" * 16),
            ("poor gap", ("9M7S", 0, 9), ("11S5M", 11, 16), "ATGAAACCCTTGATTA", "I" * 9 + "!" + "I" * 6),
            ("overlap", ("9M3S", 0, 9), ("7S5M", 7, 12), "ATGAAACCATTA", "!" * 12),
            ("indel", ("7M1I2M3S", 0, 10), ("7S6M", 7, 13), "ATGAAACGCCATT", "!" * 13)):
        rows += [(name, "left", "chr1", "+", 0, left[0], left[1], left[2]), (name, "right", "chr2", "+", 0, right[0], right[1], right[2])]
        reads.append((name, seq, qual))
    arms, reads = spark.createDataFrame(rows, ARMS), reads_of(spark, *reads)
    steps = R.projected_steps(arms, reads, chunks, 4).persist()
    whole = R.reconstructed(steps, arms, reads).persist()
    got = {r.read_id: (r.gap, r.assisted, r.low, r.high, r.observed_low, r.observed_high) for r in whole.collect()}
    assert got == {"edge": (0, "ATGAAACCCGATTA", 9, 9, 9, 9), "gap": (2, "ATGAAACCCTTGATTA", 9, 11, 9, 11), "poor gap": (2, "ATGAAACCCTTGATTA", 9, 11, 9, 11),
                   "overlap": (-2, "ATGAAACCCTTA", 7, 9, 7, 9), "indel": (-3, "ATGAAACCCTAC", 6, 9, 7, 10)}
    reasons = {(r.read_id, r.arm, r.reason, r.query_start, r.length) for r in R.unresolved_reasons(steps, arms, reads, whole).collect()}
    assert reasons == {("poor gap", None, R.GAP_QUALITY, None, 2), ("overlap", None, R.OVERLAP_DIFFERS, None, 2), ("indel", None, R.OVERLAP_DIFFERS, None, 3), ("indel", "left", R.OVERLAP_INDEL, 7, 1)}


def test_overlap_indels_on_the_reverse_strand_count_in_read_coordinates(spark):
    steps = spark.createDataFrame([(name, arm, "-", k, op, n, q, None) for name, arm, ops in (("I", "left", [("M", 3, 0), ("I", 1, 3), ("M", 6, 4)]), ("D", "left", [("M", 3, 0), ("D", 2, 3), ("M", 7, 3)]))
                                   for k, (op, n, q) in enumerate(ops)], "read_id string, arm string, strand string, step int, op string, n int, q int, unresolved string")
    reads = reads_of(spark, ("I", "A" * 10, "!" * 10), ("D", "A" * 10, "!" * 10))
    for low, high, want in ((6, 8, {("I", 6, 1), ("D", 7, 2)}), (2, 5, set())):
        arms = spark.createDataFrame([(i, a, "c", "-", 0, "", low, high) for i in "ID" for a in ("left", "right")], ARMS)
        none = spark.createDataFrame([], "read_id string, gap int, _differs boolean, _poor boolean")
        assert {(r.read_id, r.query_start, r.length) for r in R.unresolved_reasons(steps, arms, reads, none).collect()} == want


def test_base_map_restores_deletions_skips_introns_and_reverses(spark):
    cigar, positions = "4S3M2I2M2D10N3M1H", [100, 101, 102, 103, 104, 105, 106, 117, 118, 119]
    arms = spark.createDataFrame([(i, a, "c", s, start, c, qs, qe) for i, s, gap in (("apart", "+", 2), ("shared", "-", -2)) for a, start, c, qs, qe in (("left", 100, cigar, 0, 10), ("right", 8, "3M", 10 + gap, 13 + gap))], ARMS)
    got = {}
    for r in R.bases(R.base_map(arms)).collect():
        got.setdefault((r.read_id, r["at"]), set()).add((r.arm, r.position))
    assert {at: v for (i, at), v in got.items() if i == "apart"} == {k: {("left", p)} for k, p in enumerate(positions)} | {12 + k: {("right", 8 + k)} for k in range(3)}
    want = {k: {("left", p)} for k, p in enumerate(reversed(positions))}
    for k, p in enumerate((10, 9, 8)):
        want.setdefault(8 + k, set()).add(("right", p))
    assert {at: v for (i, at), v in got.items() if i == "shared"} == want
    too_far = arms.withColumn("qstart", F.when(F.col("arm") == "right", F.lit(6)).otherwise(F.col("qstart")))
    with pytest.raises(Exception, match="overlap by more"):
        R.base_map(too_far).collect()


def test_codon_frames_across_a_negative_strand_splice(spark):
    """Codons over a splice keep the frame; shifted ones don't; shared and unmapped ones have none."""
    down = [("r", "left", "c", "-", 0, 2, 109, 108, 110), ("r", "left", "c", "-", 2, 6, 93, 90, 94)]
    shifted = [("s", "left", "c", "-", 0, 1, 108, 108, 109), ("s", "left", "c", "-", 1, 3, 93, 92, 94)]
    shared = [("x", "left", "c", "-", 0, 2, 109, 108, 110), ("x", "right", "c", "-", 1, 3, 93, 92, 94), ("g", "left", "c", "-", 0, 2, 109, 108, 110)]
    outside = [("o", "left", "c", "-", 0, 3, 111, 109, 112)]
    stretches = spark.createDataFrame(down + shifted + shared + outside, STRETCHES)
    coding = spark.createDataFrame([("r", 0, 6), ("s", 0, 3), ("x", 0, 3), ("g", 0, 3), ("o", 0, 3), ("none", 0, 3)], "read_id string, begin long, end long")
    chosen = spark.createDataFrame([(i, a, "t") for i in "rsxgo" for a in ("left", "right")], "read_id string, arm string, tx string")
    cds = T.phased(spark.createDataFrame([("t", "-", 108, 110), ("t", "-", 90, 94)], "tx string, strand string, cs long, ce long"))
    assert {(r.cs, r.phase) for r in cds.collect()} == {(108, 0), (90, 1)}
    got = {(r.read_id, r.codon): r.state for r in T.codon_states(stretches, coding, chosen, cds).collect()}
    assert got == {("r", 0): T.SAME, ("r", 1): T.SAME, ("s", 0): T.OTHER, ("x", 0): T.MIXED, ("g", 0): T.MIXED, ("o", 0): T.OUTSIDE, ("none", 0): T.MIXED}


def test_transcripts_by_coding_cover_then_splices_then_arm_with_ties(spark):
    exons = spark.createDataFrame([("g", "t2", "+", 10, 16), ("g", "t1", "+", 10, 16), ("g", "t3", "+", 10, 14), ("h", "u1", "+", 0, 30), ("h", "u2", "+", 0, 30), ("h", "u2", "+", 40, 60), ("h", "u3", "+", 0, 29), ("h", "u3", "+", 39, 60)],
                                  "gene string, tx string, strand string, xs long, xe long")
    stretches = spark.createDataFrame([("r", "left", "c", "+", 0, 4, 11, 11, 15, "g"), ("r", "right", "c", "+", 4, 9, 25, 25, 30, "h"), ("r", "right", "c", "+", 9, 12, 40, 40, 43, "h"), ("q", "left", "c", "+", 0, 2, 500, 500, 502, "g")], STRETCHES + ", gene string")
    coding = spark.createDataFrame([("r", 0, 9), ("q", 0, 2)], "read_id string, begin long, end long")
    candidates = T.transcript_candidates(stretches, coding, exons).persist()
    got = {(r.read_id, r.arm, r.tx): (r.coding_bases_exonic, r.exact_splice_jumps, r.full_arm_bases_exonic) for r in candidates.collect()}
    assert got == {("r", "left", "t1"): (4, 0, 4), ("r", "left", "t2"): (4, 0, 4), ("r", "left", "t3"): (3, 0, 3), ("r", "right", "u1"): (5, 0, 5), ("r", "right", "u2"): (5, 1, 8), ("r", "right", "u3"): (4, 0, 7),
                   **{("q", "left", t): (0, 0, 0) for t in ("t1", "t2", "t3")}}
    assert {(r.read_id, r.arm, r.tx, r.tied) for r in T.chosen_transcripts(candidates).collect()} == {("r", "left", "t1", 2), ("r", "right", "u2", 1), ("q", "left", "t1", 3)}


PLACED = "id string, read string, kind string, secondary boolean, target string, strand string, start long, cigar string, md string, mapq int"


def test_scores_of_windows(spark):
    rows = [("hard", "r", "genome", False, "c", "-", 100, "100H100M", "100", 60), ("indel", "r", "genome", False, "c", "+", 0, "4M2D2M", "2A1^TT2", 60), ("intron", "r", "genome", False, "c", "+", 0, "3M100N3M", "6", 60),
            ("leading", "r", "genome", False, "c", "+", 0, "2S2I1D4M1S", "^A4", 60)]
    got = {r.id: r for r in C.scored(spark.createDataFrame(rows, PLACED)).withColumns({"w": C.run_score(F.col("runs"), F.lit(0), F.lit(6)), "far": C.run_score(F.col("runs"), F.lit(150), F.lit(160))}).collect()}
    assert (got["hard"].qstart, got["hard"].qend, got["hard"].length, got["hard"].start, got["hard"].end) == (0, 100, 200, 100, 200)
    assert got["indel"].w == -1 and got["intron"].w == 6 and got["intron"].end == 106 and [tuple(b) for b in got["intron"].blocks] == [(0, 3), (103, 106)]
    assert got["hard"].far == -20 and got["leading"].scores == [None, None, -2, -4, 1, 1, 1, 1, None]
    assert all(r.aligned == sum(s is not None for s in r.scores) for r in got.values())


def test_single_explanations_and_other_placements_decide(spark):
    left, right = ("genome", False, "chrA", "+", 0, "100M100S", "100", 60), ("genome", False, "chrB", "+", 0, "100S100M", "100", 60)
    rows = []
    for read, more in (("explained", [("transcript", False, "lnc", "+", 0, "200M", "200", 60)]), ("supported", [("transcript", False, "parent", "+", 0, "100M100S", "100", 60)]),
                       ("elsewhere", [("transcript", False, "parent", "+", 0, "100M100S", "100", 60), ("genome", True, "chrC", "+", 0, "100M100S", "100", 0)]),
                       ("same place", [("transcript", False, "parent", "+", 0, "100M100S", "100", 60), ("genome", True, "chrA", "+", 20, "100M100S", "100", 0)]),
                       ("worse", [("transcript", False, "parent", "+", 0, "100M100S", "100", 60), ("genome", True, "chrC", "+", 0, "100M100S", "20A20A20A37", 0), ("genome", True, "chrC", "+", 0, "88M112S", "88", 0)]),
                       ("nothing", [])):
        rows += [(f"{read}/{k}", read, *r) for k, r in enumerate([left, right, *more])]
    placed = C.scored(spark.createDataFrame(rows, PLACED)).persist()
    exons = spark.createDataFrame([("chrA", "+", "A", 0, 100), ("chrA", "+", "A", 50, 100), ("chrB", "+", "B", 0, 100)], "target string, strand string, gene string, xs long, xe long")
    got = {r.read: (r.split_score, r.single_score, r.margin, r.single_coverage, r.competitors) for r in C.comparisons(placed).collect()}
    assert got == {"explained": (200, 200, 0, 1.0, 0), "supported": (200, -100, 300, 0.5, 0), "elsewhere": (200, -100, 300, 0.5, 1), "same place": (200, -100, 300, 0.5, 0), "worse": (200, -100, 300, 0.5, 1), "nothing": (200, None, None, None, 0)}
    states = {r.read: (r.state, r.reasons) for r in C.read_assessment(placed, exons).collect()}
    assert states == {"explained": ("single_transcript_explained", ["single_transcript_covers_window"]), **{k: ("supported_two_gene_junction", ["meets_all_criteria"]) for k in ("supported", "same place", "nothing")},
                      **{k: ("ambiguous_single_vs_split", ["alternative_placement"]) for k in ("elsewhere", "worse")}}


def test_comparisons_shuffle_by_read_only(spark):
    """The best single and the competitors come to a pair where its read is; equal rows stay as many as they are."""
    rows = [("a", "r", "genome", False, "c", "+", 0, "50M50S", "50", 60), ("b", "r", "genome", False, "d", "+", 0, "50S50M", "50", 60), ("b2", "r", "genome", True, "e", "+", 0, "50S50M", "50", 0),
            ("t", "r", "transcript", False, "x", "+", 0, "90M10S", "90", 60), ("u", "r", "transcript", False, "x", "+", 0, "90M10S", "90", 60), ("a", "q", "genome", False, "c", "+", 0, "50M50S", "50", 60),
            ("z", "q", "genome", False, "d", "+", 0, "50S50M", "50", 60), ("z", "q", "genome", False, "d", "+", 0, "50S50M", "50", 60)]
    placed = C.scored(spark.createDataFrame(rows, "id string, read string, kind string, secondary boolean, target string, strand string, start long, cigar string, md string, mapq int"))
    out = C.comparisons(placed)
    got = sorted((r.read, r.left_id, r.right_id, r.split_score, r.single_id, r.single_score, r.competitors) for r in out.collect())
    assert got == [("q", "a", "z", 100, None, None, 0), ("q", "z", "z", 50, None, None, 0), ("r", "a", "b", 100, "t", 70, 1)]
    assert "hashpartitioning(left_id" not in out._jdf.queryExecution().executedPlan().toString()
