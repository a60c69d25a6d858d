"""Windows over sparse contact matrices: one primitive, anchor x offsets joined to triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.session import cut_lineage

from tallyarc.operators.joins import split_hot
from tallyarc.operators.scan import grouped_quantiles, positions

REACH = 5  # fixed value: 11 x 11 windows


def bin_index(cells: DataFrame, resolution: int) -> DataFrame:
    """(chrom, start, end, bin_id) covering each chromosome's observed range; ids run over chromosomes in name order."""
    ends = cells.select(F.explode(F.array(F.struct(F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos")),
                                          F.struct(F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos")))).alias("e")).select("e.*")
    span = ends.groupBy("chrom").agg(F.min(F.floor(F.col("pos") / resolution)).alias("b0"), F.max(F.floor(F.col("pos") / resolution)).alias("b1"))
    bins = span.select("chrom", F.explode(F.sequence("b0", "b1")).alias("b"))
    numbered = positions(bins, [F.col("chrom"), F.col("b")], name="bin_id")
    return numbered.select("chrom", (F.col("b") * resolution).alias("start"), ((F.col("b") + 1) * resolution).alias("end"), "bin_id")


def index_cells(cells: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """Triples re-keyed to bin ids, stored upper-triangular, equal cells summed."""
    b = lambda n: bins.select(F.col("chrom").alias(f"chrom{n}"), F.col("start").alias(f"_s{n}"), F.col("bin_id").alias(f"_b{n}"))
    keyed = cells.withColumns({f"_s{n}": F.floor(F.col(f"pos{n}") / resolution) * resolution for n in (1, 2)})
    return keyed.join(b(1), ["chrom1", "_s1"]).join(b(2), ["chrom2", "_s2"]).groupBy(
        F.least("_b1", "_b2").alias("bin1"), F.greatest("_b1", "_b2").alias("bin2")).agg(F.sum("value").alias("value"))


def offsets_grid(df: DataFrame, reach: int = REACH) -> DataFrame:
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))


def windows(anchors: DataFrame, cells: DataFrame, replicates: Sequence[str], size1: Column, size2: Column, reach: int = REACH,
            mirrored: bool = False) -> DataFrame:
    """Long window rows (anchor columns, replicate, i, j, value); windows over an edge are rejected, an absent cell is an observed zero."""
    inside = anchors.where((F.col("bin1") >= reach) & (F.col("bin2") >= reach) & (F.col("bin1") + reach < size1) & (F.col("bin2") + reach < size2))
    grid = offsets_grid(inside.withColumn("replicate", F.explode(F.array(*[F.lit(r) for r in replicates]))), reach)
    x, y = F.col("bin1") + F.col("i"), F.col("bin2") + F.col("j")
    if mirrored:
        x, y = F.least(x, y), F.greatest(x, y)
    keyed = grid.withColumns({"_x": x, "_y": y})
    triples = cells.select("replicate", F.col("bin1").alias("_x"), F.col("bin2").alias("_y"), "value")
    return keyed.join(triples, ["replicate", "_x", "_y"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def masked(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """Null where either axis has no positive norm; (bin, norm) may lack bins."""
    for axis in ("_x", "_y"):
        rows = rows.join(norms.select(F.col("bin").alias(axis), F.col("norm").alias(f"_n{axis}")), axis, "left")
    ok = (F.col("_n_x") > 0) & (F.col("_n_y") > 0)
    return rows.withColumn("value", F.when(ok, F.col("value"))).drop("_n_x", "_n_y")


def enrichment(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median of the centre 3 x 3 over the median of the 64 corner cells, with a state (fixed values: its names)."""
    centre = (F.abs("i") <= 1) & (F.abs("j") <= 1)
    corner = (F.abs("i") >= 2) & (F.abs("j") >= 2)
    t = rows.groupBy(*keys).agg(
        F.median(F.when(centre, F.col("value"))).alias("fg"), F.median(F.when(corner, F.col("value"))).alias("bg"),
        F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad"))
    good = F.col("bad") == 0
    state = F.when(~good, "unavailable_pixels").when(F.col("bg") <= 0, "undefined_background").otherwise("observed")
    return t.select(*keys, F.when(good, F.col("fg")).alias("foreground"), F.when(good, F.col("bg")).alias("background"),
                    F.when(good & (F.col("bg") > 0), F.col("fg") / F.nullif(F.col("bg"), F.lit(0.0))).alias("enrichment"), state.alias("status"))


def pair_feature(rows: DataFrame, pairs: DataFrame, replicates: int = 3) -> DataFrame:
    """Mean of distinct bin-pair ratios per replicate, then over replicates; primary only with all of them."""
    key = ["pair_id", "replicate", "bin1", "bin2"]
    distinct = rows.groupBy(*key).agg(F.max("enrichment").alias("enrichment"))
    per = distinct.where("enrichment IS NOT NULL").groupBy("pair_id", "replicate").agg(F.avg("enrichment").alias("m"))
    mean = per.groupBy("pair_id").agg(F.avg("m").alias("partial_enrichment"), F.count("*").alias("n_replicates"))
    reasons = rows.where("status <> 'observed'").groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ";").alias("reasons"))
    seen = rows.select("pair_id").distinct().withColumn("_seen", F.lit(True))
    out = pairs.join(mean, "pair_id", "left").join(reasons, "pair_id", "left").join(seen, "pair_id", "left")
    n = F.coalesce("n_replicates", F.lit(0).cast("long"))
    primary = F.when(n == replicates, F.col("partial_enrichment"))
    return out.select(
        "pair_id", primary.alias("contact_enrichment"), "partial_enrichment", n.alias("n_replicates"),
        F.when(n == replicates, "observed_all_replicates").when(n > 0, "incomplete_replicates").otherwise("unavailable").alias("status"),
        F.when(F.col("_seen").isNull(), "no_probe_coordinates").otherwise(F.coalesce("reasons", F.lit(""))).alias("reasons"))


def scaled(cells: DataFrame, total: float, cis: Column | None = None) -> DataFrame:
    """Every replicate scaled to a fixed total, over all or cis-only contacts."""
    base = cells.where(cis) if cis is not None else cells
    sums = base.groupBy("replicate").agg(F.sum("value").alias("_sum"))
    return cells.join(sums, "replicate").withColumn("value", F.col("value") * total / F.col("_sum")).drop("_sum")


def distance_z(cells: DataFrame, chrom1: Column, chrom2: Column) -> DataFrame:
    """z-score within (replicate, chromosome pair, distance); distance counts as 0 between chromosomes, undefined becomes 1."""
    keyed = cells.withColumns({"_c1": chrom1, "_c2": chrom2})
    keyed = keyed.withColumn("_d", F.when(F.col("_c1") == F.col("_c2"), F.abs(F.col("bin1") - F.col("bin2"))).otherwise(F.lit(0).cast("long")))
    keys = ["replicate", "_c1", "_c2", "_d"]
    stats = keyed.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.coalesce((F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0))
    return keyed.join(stats, keys).withColumn("z", z).drop("_c1", "_c2", "_d", "_m", "_s")


def anchor_pairs(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """Centre bins of a pair list: ordered, distinct, within the distance limits."""
    return pairs.select(F.least("b1", "b2").alias("idx1"), F.greatest("b1", "b2").alias("idx2")).distinct().where(
        (F.col("idx2") - F.col("idx1")).between(low, high))


def all_pairs_within(regions: DataFrame, chrom: str, idx: str, low: int, high: int, min_compare: int = 2) -> DataFrame:
    """Pairs of one region set per chromosome at a distance in [low, high]; bins of width ``high`` are the join key, heavy ones are cut.

    Chromosomes with fewer regions than ``min_compare`` have none.
    """
    base = regions.select(chrom, idx).distinct()
    enough = base.groupBy(chrom).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(min_compare, 2)).select(chrom)
    base = base.join(enough, chrom)
    a = base.select(chrom, F.col(idx).alias("idx1"), F.explode(F.array(F.floor(F.col(idx) / high), F.floor(F.col(idx) / high) + 1)).alias("_b"))
    b = base.select(chrom, F.col(idx).alias("idx2"), F.floor(F.col(idx) / high).alias("_b"))
    gap = F.col("idx2") - F.col("idx1")
    a, b, on = split_hot(a, b, [chrom, "_b"])
    return a.join(b, on).where((gap >= low) & (gap <= high) & (gap > 0)).drop(*on[1:])


def pairs_across_sets(regions: DataFrame, label: str, chrom: str, idx: str, low: int, high: int, min_compare: int = 10, directed: bool = False) -> DataFrame:
    """chrom, sets, idx1, idx2: pairs of regions of different sets on a chromosome at a distance in [low, high].

    Two sets meet on a chromosome only where their region counts multiply to ``min_compare``.
    ``sets`` names them in order, or with ``directed`` in the order of the regions.
    """
    base = regions.select(label, chrom, idx).distinct()
    counts = base.groupBy(label, chrom).agg(F.count("*").alias("_n"))
    base = base.join(counts, [label, chrom])
    at = F.floor(F.col(idx) / high)
    x = base.select(chrom, F.col(label).alias("_x"), F.col(idx).alias("_i"), F.col("_n").alias("_nx"), F.explode(F.array(at - 1, at, at + 1)).alias("_b"))
    y = base.select(chrom, F.col(label).alias("_y"), F.col(idx).alias("_j"), F.col("_n").alias("_ny"), at.alias("_b"))
    x, y, on = split_hot(x, y, [chrom, "_b"])
    gap = F.abs(F.col("_i") - F.col("_j"))
    met = x.join(y, on).where((F.col("_x") < F.col("_y")) & (F.col("_nx") * F.col("_ny") >= max(min_compare, 2)) & (gap >= low) & (gap <= high))
    back = F.lit(directed) & (F.col("_j") < F.col("_i"))
    sets = F.when(back, F.concat_ws("-", "_y", "_x")).otherwise(F.concat_ws("-", "_x", "_y"))
    return met.select(chrom, sets.alias("sets"), F.least("_i", "_j").alias("idx1"), F.greatest("_i", "_j").alias("idx2"))


def average_window(rows: DataFrame, anchor: Sequence[str], groups: Sequence[str], clip: float = 0.99) -> DataFrame:
    """Mean window per group after dropping all-zero windows and clipping at a quantile of the group."""
    live = rows.groupBy(*groups, *anchor).agg(F.sum("value").alias("_t")).where("_t > 0").drop("_t")
    kept = rows.join(live, [*groups, *anchor], "left_semi")
    edge = grouped_quantiles(kept, groups, "value", {"_hi": clip})
    return kept.join(edge, list(groups)).groupBy(*groups, "i", "j").agg(F.avg(F.least("value", "_hi")).alias("signal"))


def shifted(anchors: DataFrame, by: int, size1: Column, size2: Column, reach: int = REACH) -> DataFrame:
    """Anchors moved by a fixed distance, the other way at a chromosome end."""
    back = (F.col("bin1") + by + reach >= size1) | (F.col("bin2") + by + reach >= size2)
    step = F.when(back, -by).otherwise(by)
    return anchors.withColumns({"bin1": F.col("bin1") + step, "bin2": F.col("bin2") + step})


def by_diagonal(observed: DataFrame, background: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, observed, expected, ratio): mean region windows against a background of their diagonal.

    Both tables hold mean values (keys, i, j, value), at most a window's cells a key. Each is
    made symmetric by adding its mirror image; what is expected of a cell is the mean of the
    background's cells at the same distance j - i. Where that is null or 0, so is no ratio.
    """
    mirrored = lambda t: t.union(t.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))
    distance = (F.col("j") - F.col("i")).alias("distance")
    expected = mirrored(background.select(*keys, "i", "j", "value")).groupBy(*keys, distance).agg(F.avg("value").alias("expected"))
    cells = mirrored(observed.select(*keys, "i", "j", "value")).select(*keys, "i", "j", F.col("value").alias("observed"), distance)
    return cells.join(expected, [*keys, "distance"], "left").drop("distance").withColumn("ratio", F.expr("try_divide(observed, expected)"))


def quantify(rows: DataFrame, mask: DataFrame, keys: Sequence[str], metric=F.avg) -> DataFrame:
    """Foreground, background, ratio and difference of a window by a mask table (i, j, part) and an aggregate."""
    part = lambda p: metric(F.when(F.col("part") == p, F.col("value")))
    t = rows.join(mask, ["i", "j"]).groupBy(*keys).agg(part("foreground").alias("foreground"), part("background").alias("background"))
    return t.withColumns({"ratio": F.expr("try_divide(foreground, background)"), "difference": F.col("foreground") - F.col("background")})


def shape_mask(spark, shape: str, reach: int = REACH) -> DataFrame:
    """Mask of a named shape; at most (2 reach + 1) squared rows."""
    grid = offsets_grid(spark.range(1), reach).drop("id")
    a, b = F.abs("i"), F.abs("j")
    middle = (a <= 1) & (b <= 1)
    part = {
        "centre_quadrants": F.when(middle, "foreground").when((a >= 2) & (b >= 2), "background"),
        "centre_rest": F.when(middle, "foreground").otherwise("background"),
        "circle": F.when(F.col("i") ** 2 + F.col("j") ** 2 <= (reach / 2) ** 2, "foreground").otherwise("background"),
        "insulation": F.when((F.col("i") < 0) == (F.col("j") < 0), "background").otherwise("foreground"),
        "corner": F.when((F.col("i") > 0) & (F.col("j") < 0), "foreground").otherwise("background"),
        "checker": F.when(F.pmod(F.col("i") + F.col("j"), F.lit(2)) == 0, "foreground").otherwise("background"),
        "stripes": F.when((F.col("i") == 0) | (F.col("j") == 0), "foreground").otherwise("background"),
    }[shape]
    return grid.withColumn("part", part).where("part IS NOT NULL")


#: Names of shapes, of their parts, and of the parts of a region on the diagonal.
FRAMED = ("center_vs_quadrants", "center_vs_rest", "circle", "insulation", "cornerpeak", "checker")
FEATURES = ("region_parts", "stripes")
STENCIL = "shape string, i int, j int, part string"


def stencil(spark, reach: int = REACH, size: int = 3, circle: int = 5, padding: float = 1.0, resolution: int = 1) -> DataFrame:
    """shape, i, j, part of every shape: one table of window cells, made from the window's size alone.

    FRAMED shapes have the parts foreground and background, and a cell may be in both.
    FEATURES name the parts around a region's own place on the diagonal: its two sides and
    stripes and what it spans, or the distance along either stripe.
    """
    cells = range(-reach, reach + 1)
    half, window = (size - 1) / 2, 2 * reach + 1
    low, high = (round((padding + d) / (2 * padding) * window) - reach - 1 for d in (-0.5, 0.5))  # the region's borders within a window of twice the padding
    inner, outer, middle = (lambda k: low < k < high), (lambda k: k < low or k > high), (lambda k: abs(k) <= half)
    near = lambda k, border: abs(k - border) <= 2
    square = lambda i, j: inner(i) and inner(j)
    rules = {
        ("center_vs_quadrants", "foreground"): lambda i, j: middle(i) and middle(j), ("center_vs_quadrants", "background"): lambda i, j: not middle(i) and not middle(j),
        ("center_vs_rest", "foreground"): lambda i, j: middle(i) and middle(j), ("center_vs_rest", "background"): lambda i, j: not (middle(i) and middle(j)),
        ("circle", "foreground"): lambda i, j: 4 * (i * i + j * j) < circle * circle, ("circle", "background"): lambda i, j: 4 * (i * i + j * j) >= circle * circle,
        ("insulation", "foreground"): square, ("insulation", "background"): lambda i, j: (outer(i) and inner(j)) or (inner(i) and outer(j)),
        ("cornerpeak", "foreground"): lambda i, j: (near(i, low) and near(j, high)) or (near(i, high) and near(j, low)), ("cornerpeak", "background"): lambda i, j: low + 2 <= i <= high - 2 and low + 2 <= j <= high - 2,
        ("checker", "foreground"): square, ("checker", "background"): lambda i, j: (i < low and j > high) or (i > high and j < low),
    }
    rows = [(shape, i, j, part) for (shape, part), holds in rules.items() for i in cells for j in cells if holds(i, j)]
    side = lambda k: "mid" if middle(k) else "up" if k < 0 else "down"
    parts = {("up", "up"): "5' Region", ("up", "mid"): "5' Stripe", ("up", "down"): "Span", ("mid", "down"): "3' Stripe", ("down", "down"): "3' Region"}
    rows += [("region_parts", i, j, parts[side(i), side(j)]) for i in cells for j in cells if i < j and (side(i), side(j)) in parts]
    rows += [("stripes", i, j, str((j if side(j) == "down" else i) * resolution)) for i in cells for j in cells if (side(i), side(j)) in (("mid", "down"), ("up", "mid"))]
    return spark.createDataFrame(rows, STENCIL)


def shape_scores(rows: DataFrame, stencils: DataFrame, keys: Sequence[str], metric=F.avg) -> DataFrame:
    """shape, keys, foreground, background, ratio, difference by the FRAMED stencils; ``metric`` is F.avg or F.median of a group's cells of one window, absent values count as 0."""
    framed = stencils.where(F.col("shape").isin(*FRAMED))
    value = F.coalesce("value", F.lit(0.0))
    part = lambda p: metric(F.when(F.col("part") == p, value))
    t = rows.join(F.broadcast(framed), ["i", "j"]).groupBy("shape", *keys).agg(part("foreground").alias("foreground"), part("background").alias("background"))  # at most two rows a cell and shape
    return t.withColumns({"ratio": F.expr("try_divide(foreground, background)"), "difference": F.col("foreground") - F.col("background")})


def shape_features(rows: DataFrame, stencils: DataFrame, keys: Sequence[str]) -> DataFrame:
    """shape, keys, feature, value: the mean of every part of the FEATURES stencils."""
    named = stencils.where(F.col("shape").isin(*FEATURES)).withColumnRenamed("part", "feature")
    return rows.join(F.broadcast(named), ["i", "j"]).groupBy("shape", *keys, "feature").agg(F.avg("value").alias("value"))


def resized(regions: DataFrame, cells: DataFrame, keys: Sequence[str], grid: int) -> DataFrame:
    """Square regions (start, end inclusive) resampled to grid x grid by bilinear weights of four neighbours."""
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    at = lambda g: F.col("start") + F.col(g) * (F.col("end") - F.col("start")) / (grid - 1)
    rows = regions.withColumn("gi", F.explode(steps)).withColumn("gj", F.explode(steps)).withColumns({"_px": at("gi"), "_py": at("gj")})
    fx, fy = F.col("_px") - F.floor("_px"), F.col("_py") - F.floor("_py")
    corner = lambda dx, dy: F.struct(
        (F.floor("_px") + dx).alias("bin1"), (F.floor("_py") + dy).alias("bin2"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
    spread = rows.withColumn("_c", F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)]))).select(*keys, "gi", "gj", "_c.*").where("w > 0")
    return spread.join(cells, ["bin1", "bin2"], "left").groupBy(*keys, "gi", "gj").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def compartment_strength(cells: DataFrame, compartments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log2(AA * BB / AB^2) over cells whose bins carry a compartment (bin, part)."""
    p = lambda n: compartments.select(F.col("bin").alias(f"bin{n}"), F.col("part").alias(f"p{n}"))
    tagged = cells.join(p(1), "bin1").join(p(2), "bin2")
    mean = lambda cond: F.avg(F.when(cond, F.col("value")))
    t = tagged.groupBy(*keys).agg(mean((F.col("p1") == "A") & (F.col("p2") == "A")).alias("aa"), mean((F.col("p1") == "B") & (F.col("p2") == "B")).alias("bb"),
                                  mean(F.col("p1") != F.col("p2")).alias("ab"))
    return t.withColumn("strength", F.log2(F.col("aa") * F.col("bb") / F.nullif(F.col("ab") ** 2, F.lit(0.0))))


def slice_clusters(rows: DataFrame, keys: Sequence[str], sample: str, share: float = 0.7, seed: int = 1) -> DataFrame:
    """k-means on the z-normalised middle of each window's diagonal, one value a sample.

    Windows that every sample holds take part; missing cells count as 0, a constant
    diagonal has the middle 0. K grows from 1 until the wanted share of variance lies
    between clusters, which it does at the latest with a cluster for each distinct window.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    value = F.coalesce(F.col("value"), F.lit(0.0))
    per_sample = rows.where(F.col("i") == F.col("j")).groupBy(*keys, sample).agg(
        F.max(F.when(F.col("i") == 0, value)).alias("_mid"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    middle = F.coalesce(F.when(F.col("_s") > 0, (F.col("_mid") - F.col("_m")) / F.col("_s")), F.lit(0.0))
    samples = rows.select(F.count_distinct(sample)).first()[0]  # entries of a window's vector
    vectors = per_sample.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(sample, middle.alias("z")))).alias("_v")).where(F.size("_v") == samples)
    data = vectors.select(*keys, array_to_vector(F.transform("_v", lambda s: s["z"])).alias("features"), F.transform("_v", lambda s: s["z"]).alias("_z")).persist()
    spread = data.select(F.posexplode("_z").alias("p", "x")).groupBy("p").agg((F.var_pop("x") * F.count("x")).alias("s"))
    whole, k = spread.agg(F.sum("s")).first()[0] or 0.0, 1
    out = data.select(*keys, F.lit(0).alias("cluster"))
    while whole > 1e-12:
        k += 1
        model = KMeans(k=k, seed=seed).fit(data)
        if 1 - model.summary.trainingCost / whole >= share:
            out = model.transform(data).select(*keys, F.col("prediction").alias("cluster"))
            break
    out = cut_lineage(out.withColumn("k", F.lit(k)))
    data.unpersist()
    return out
