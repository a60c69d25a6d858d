"""Interval merge and binned interval, point and tolerance joins.

Spark plans a bare range predicate as a nested loop, so both sides get an equi
key: the coordinate bin. Long intervals use coarser bins, which bounds the
number of copies per interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.operators.contracts import guarded
from tallyarc.operators.joins import heaviest, split_hot
from tallyarc.operators.scan import last_seen, ordered_running
from tallyarc.session import cut_lineage

LEVELS = 9  # the coarsest bin is 32 ** 8 finest ones, longer than any sequence
GROWTH = 32


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of half-open intervals per key; touching intervals merge.

    Equal starts are combined first, then the running maximum of ends is scanned
    in buckets, so one contig may hold most of the rows.
    """
    points = df.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    run = ordered_running(points, [F.col("_s")], partition=keys, maxima={"end": F.col("_e")}, exclusive=True)
    breaks = run.where(F.col("top_end").isNull() | (F.col("_s") > F.col("top_end")))
    # The running maximum before the next break is the end of this island.
    after = Window.partitionBy(*keys).orderBy("_s")
    last = points.groupBy(*keys).agg(F.max("_e").alias("_last"))
    return breaks.withColumn("_next", F.lead("top_end").over(after)).join(last, list(keys)).select(
        *keys, F.col("_s").alias(start), F.coalesce("_next", "_last").alias(end))


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Covered length of one-based inclusive intervals per key."""
    checked = guarded(F.col(start), (F.col(start) < 1) | (F.col(end) < F.col(start)), "invalid one-based interval")
    half_open = df.select(*keys, checked.alias("_a"), (F.col(end) + 1).alias("_b"))
    return merge_intervals(half_open, keys, "_a", "_b").groupBy(*keys).agg(F.sum(F.col("_b") - F.col("_a")).alias("covered"))


def _bin_sizes(width: int) -> list[int]:
    return [width * GROWTH ** i for i in range(LEVELS) if width * GROWTH ** i < 2**62]


def _level(span: tuple[str, str], width: int) -> Column:
    """The finest level whose bins are as long as the interval, so it touches two of them at most."""
    sizes = _bin_sizes(width)
    length, level = F.col(span[1]) - F.col(span[0]), F.lit(len(sizes) - 1)
    for i, size in reversed(list(enumerate(sizes[:-1]))):
        level = F.when(length <= size, F.lit(i)).otherwise(level)
    return level


def _binned(df: DataFrame, span: tuple[str, str], width: int, other_levels: Column, side: str) -> DataFrame:
    """A row for each bin of the interval's own level and of the coarser levels that the other side uses."""
    rows = df.withColumn(f"_own{side}", _level(span, width)).withColumn("_levels", other_levels)
    coarser = F.filter(F.coalesce("_levels", F.array().cast("array<int>")), lambda i: i > F.col(f"_own{side}"))
    rows = rows.withColumn("_level", F.explode(F.concat(F.array(f"_own{side}"), coarser))).drop("_levels")
    size = F.element_at(F.array(*[F.lit(n).cast("long") for n in _bin_sizes(width)]), F.col("_level") + 1)
    first, last = F.floor(F.col(span[0]) / size), F.floor((F.col(span[1]) - 1) / size)
    return rows.withColumn(f"_first{side}", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))


def _seen(df: DataFrame, keys: Sequence[str], span: tuple[str, str], width: int) -> Column:
    """The levels in use and the heaviest bins of any level, from one pass; a one-row scalar."""
    sizes = _bin_sizes(width)
    rows = df.select(*keys, F.col(span[0]).alias("_a"), (F.col(span[1]) - 1).alias("_b"), _level(span, width).alias("_own"))
    rows = rows.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(len(sizes) - 1))))
    size = F.element_at(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("_level") + 1)
    bins = rows.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor(F.col("_a") / size), F.floor(F.greatest("_a", "_b") / size)))))
    cells = bins.select("_own", F.xxhash64(*keys, "_level", "_bin").alias("_cell"))
    return cells.agg(F.struct(F.sort_array(F.collect_set("_own")).alias("levels"), heaviest("_cell").alias("heavy"))).scalar()


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                 right_span: tuple[str, str], width: int) -> DataFrame:
    """Every pair of overlapping half-open intervals that share ``keys``, once, with ``overlap``.

    Both sides sit on a level by length, and a pair meets on the coarser of its two
    levels: an interval of any length has at most two copies a level in use. A pair is
    emitted only in the first bin both cover, which replaces a distinct. Heavy bins are
    cut into parts that meet two by two.
    """
    (ls, le), (rs, re_) = left_span, right_span
    seen_l, seen_r = _seen(left, keys, left_span, width), _seen(right, keys, right_span, width)
    lft = _binned(left, left_span, width, seen_r["levels"], "l")
    r = _binned(right, right_span, width, seen_l["levels"], "r")
    once = (F.col("_level") == F.greatest("_ownl", "_ownr")) & (F.col("_bin") == F.greatest("_firstl", "_firstr"))
    hit = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & once
    lft, r, on = split_hot(lft, r, [*keys, "_level", "_bin"], tops=(seen_l["heavy"], seen_r["heavy"]))
    return lft.join(r, on).where(hit).withColumn(
        "overlap", F.least(F.col(le), F.col(re_)) - F.greatest(F.col(ls), F.col(rs))).drop(*on[len(keys):], "_ownl", "_ownr", "_firstl", "_firstr")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], position: str, span: tuple[str, str],
               width: int) -> DataFrame:
    """Points inside half-open intervals; a point outside all of them is dropped."""
    widened = points.withColumn("_p1", F.col(position) + 1)
    return overlap_join(widened, spans, keys, (position, "_p1"), span, width).drop("_p1", "overlap")


def exon_overlap(blocks: DataFrame, exons: DataFrame, keys: Sequence[str], row_id: str, gene: str, start: str, end: str,
                 width: int) -> DataFrame:
    """Aligned bases of each row inside each gene's exon union."""
    union = merge_intervals(exons, [*keys, gene], start, end).withColumnsRenamed({start: "_xs", end: "_xe"})
    return overlap_join(blocks, union, keys, (start, end), ("_xs", "_xe"), width).groupBy(row_id, gene).agg(
        F.sum("overlap").alias("exonic_overlap"))


def tolerance_join(probes: DataFrame, rows: DataFrame, exact: Sequence[str], first: str, second: str,
                   tolerance: int) -> DataFrame:
    """Both endpoints within ``tolerance``; ``rows`` carry r_<first>/r_<second> columns.

    The first endpoint gives the equi key (neighbouring bins on the probe side).
    """
    width = max(tolerance, 1)
    near = probes.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(first) - tolerance) / width),
                                                          F.floor((F.col(first) + tolerance) / width))))
    far = rows.withColumn("_bin", F.floor(F.col(f"r_{first}") / width))
    # The second endpoint joins the key too: fewer candidates under a hot first endpoint.
    near = near.withColumn("_bin2", F.explode(F.sequence(F.floor((F.col(second) - tolerance) / width),
                                                         F.floor((F.col(second) + tolerance) / width))))
    far = far.withColumn("_bin2", F.floor(F.col(f"r_{second}") / width))
    o1, o2 = F.col(f"r_{first}") - F.col(first), F.col(f"r_{second}") - F.col(second)
    near, far, on = split_hot(near, far, [*exact, "_bin", "_bin2"])
    return near.join(far, on).where((F.abs(o1) <= tolerance) & (F.abs(o2) <= tolerance)).withColumns(
        {"offset1": o1, "offset2": o2}).drop(*on[len(exact):])


def both_orientations(rows: DataFrame, chrom1: str, strand1: str, pos1: str, chrom2: str, strand2: str, pos2: str) -> DataFrame:
    """Each junction row as read and as its reverse complement."""
    flip = lambda s: F.when(F.col(s) == "+", "-").otherwise("+")
    direct = F.struct(F.col(chrom1).alias("c1"), F.col(strand1).alias("s1"), F.col(pos1).alias("r_b1"),
                      F.col(chrom2).alias("c2"), F.col(strand2).alias("s2"), F.col(pos2).alias("r_b2"),
                      F.lit("direct").alias("orientation"))
    turned = F.struct(F.col(chrom2).alias("c1"), flip(strand2).alias("s1"), F.col(pos2).alias("r_b1"),
                      F.col(chrom1).alias("c2"), flip(strand1).alias("s2"), F.col(pos1).alias("r_b2"),
                      F.lit("reverse_complement").alias("orientation"))
    rest = [c for c in rows.columns if c not in (chrom1, strand1, pos1, chrom2, strand2, pos2)]
    return rows.select(*rest, F.explode(F.array(direct, turned)).alias("_o")).select(*rest, "_o.*")


def nearest_edge(points: DataFrame, edges: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Signed distance (point - edge) to the nearest edge; the lower edge wins a tie.

    Distinct positions only: both as-of directions are bucketed scans.
    """
    p = points.select(*keys, F.col(position).alias("_at")).distinct().withColumn("_edge", F.lit(None).cast("long"))
    e = edges.select(*keys, F.col(position).cast("long").alias("_at")).distinct().withColumn("_edge", F.col("_at"))
    both = cut_lineage(p.unionByName(e))  # read three times by each of the two scans
    is_point = F.col("_edge").isNull().cast("int")
    below = last_seen(both, [F.col("_at"), is_point], F.col("_edge"), "_below", keys).where("_edge IS NULL").drop("_edge")
    above = last_seen(both, [-F.col("_at"), is_point], F.col("_edge"), "_above", keys).where("_edge IS NULL").drop("_edge")
    near = below.join(above, [*keys, "_at"])
    down, up = F.col("_at") - F.col("_below"), F.col("_at") - F.col("_above")
    delta = F.when(up.isNull() | (down.isNotNull() & (F.abs(down) <= F.abs(up))), down).otherwise(up)
    return near.select(*keys, F.col("_at").alias(position), delta.alias("nearest_edge_delta"))


def gene_contexts(pairs: DataFrame, records: DataFrame, a: str, b: str, gene: str, chrom: str, start: str, end: str) -> DataFrame:
    """``pairs`` with is_interchromosomal and genomic_distance, the least over all records of both genes.

    A gene without records, or with records on several chromosomes, leaves both null. Only
    pairs on one chromosome meet the records, and their product is a minimum right away.
    """
    placed = records.groupBy(F.col(gene).alias("_g")).agg(F.min(chrom).alias("_low"), F.max(chrom).alias("_high"))
    chroms = placed.select("_g", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_c"))
    side = lambda p: chroms.select(F.col("_g").alias(f"_{p}"), F.col("_c").alias(f"_c{p}"))
    known = pairs.join(side("a"), F.col(a) == F.col("_a"), "left").join(side("b"), F.col(b) == F.col("_b"), "left").drop("_a", "_b")
    ends = lambda p: records.select(F.col(gene).alias(f"_{p}"), F.col(start).alias(f"_s{p}"), F.col(end).alias(f"_e{p}"))
    same = known.where("_ca = _cb").select(F.col(a).alias("_pa"), F.col(b).alias("_pb")).distinct()
    met = same.join(ends("a"), F.col("_pa") == F.col("_a")).join(ends("b"), F.col("_pb") == F.col("_b"))
    apart = F.greatest(F.lit(0).cast("long"), F.col("_sa") - F.col("_eb"), F.col("_sb") - F.col("_ea"))
    least = met.groupBy("_pa", "_pb").agg(F.min(apart).alias("_d"))
    out = known.join(least, (F.col(a) == F.col("_pa")) & (F.col(b) == F.col("_pb")), "left")
    inter = (F.col("_ca") != F.col("_cb")).cast("int")
    return out.select(*pairs.columns, inter.alias("is_interchromosomal"), F.when(inter == 1, F.lit(0).cast("long")).otherwise(F.col("_d")).alias("genomic_distance"))


def offsets(df: DataFrame, keys: Sequence[str], order: Sequence[Column], length: Column, name: str = "offset") -> DataFrame:
    """Bases before each segment in transcript order."""
    return ordered_running(df, order, {"len": length}, partition=keys, exclusive=True).withColumnRenamed("cum_len", name)


def clustered_anchors(loops: DataFrame, chrom: str, gap: int, limit: int) -> DataFrame:
    """Extended loops: 5' anchors cluster by gap, and a cluster's first anchor pairs with 3' anchors of
    later clusters beyond the cluster's own maximum and within ``limit``.

    ``loops`` has (chrom, idx1, idx2) with idx1 <= idx2. Pairs are found by bins
    of width ``limit``, not by combining all anchors of a chromosome.
    """
    base = cut_lineage(loops.select(chrom, "idx1", "idx2").distinct().where(F.col("idx2") - F.col("idx1") < limit))
    starts = cut_lineage(base.groupBy(chrom, "idx1").agg(F.max("idx2").alias("_far")))  # a running total reads its rows three times
    run = ordered_running(starts, [F.col("idx1")], partition=[chrom], maxima={"before": F.col("idx1")}, exclusive=True)
    flagged = run.withColumn("_new", (F.col("top_before").isNull() | (F.col("idx1") - F.col("top_before") > gap)).cast("int"))
    numbered = cut_lineage(ordered_running(cut_lineage(flagged), [F.col("idx1")], {"cluster": F.col("_new")}, partition=[chrom]))
    clusters = numbered.groupBy(chrom, F.col("cum_cluster").alias("cluster")).agg(
        F.min("idx1").alias("i1"), F.max("_far").alias("far"))
    members = base.join(numbered.select(chrom, "idx1", F.col("cum_cluster").alias("other")), [chrom, "idx1"])
    ends = members.groupBy(chrom, "other", "idx2").agg(F.lit(1).alias("_")).drop("_").withColumn(
        "_bin", F.floor(F.col("idx2") / limit))
    reach = clusters.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("i1") / limit), F.floor((F.col("i1") + limit) / limit))))
    ok = (F.col("cluster") < F.col("other")) & (F.col("i1") + limit > F.col("idx2")) & (F.col("idx2") > F.col("far") + gap)
    reach, ends, on = split_hot(cut_lineage(reach), cut_lineage(ends), [chrom, "_bin"])
    return reach.join(ends, on).where(ok).select(chrom, F.col("i1").alias("idx1"), "idx2").distinct()
