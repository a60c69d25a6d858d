"""Runs, segments and summaries along positions of one profile or sequence.

A profile comes from one row (an array or a string), so a window over its
positions holds no more than that row did.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.operators.contracts import guarded


def runs(df: DataFrame, keys: Sequence[str], position: str, value: Column, adjacent: Column | None = None) -> DataFrame:
    """Segments of equal ``value``; ``adjacent`` (against ``_prev_*`` of the row before) adds a break rule."""
    w = Window.partitionBy(*keys).orderBy(position)
    tagged = df.withColumn("_v", value)
    changed = ~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)
    if adjacent is not None:
        changed = changed | ~F.coalesce(adjacent, F.lit(True))
    return tagged.withColumn("_new", changed.cast("int")).withColumn(
        "segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segments(df: DataFrame, keys: Sequence[str], position: str, value: Column, text: str | None = None,
             adjacent: Column | None = None) -> DataFrame:
    """One row per run: first and last position, value and the joined letters."""
    tagged = runs(df, keys, position, value, adjacent)
    extra = []
    if text:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda s: s[text])
        extra = [F.array_join(ordered, "").alias("text")]
    return tagged.groupBy(*keys, "segment", F.col("_v").alias("value")).agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"), *extra)


def longest_run(df: DataFrame, keys: Sequence[str], position: str, condition: Column) -> DataFrame:
    """Length of the longest stretch where ``condition`` holds; 0 without any."""
    w = Window.partitionBy(*keys).orderBy(position)
    held = df.where(condition).withColumn("_run", F.col(position) - F.row_number().over(w))
    best = held.groupBy(*keys, "_run").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest_run"))
    every = df.select(*keys).distinct()
    return every.join(best, list(keys), "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0).cast("long")))


def score_summary(scores: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Share, mean and majority flags of an array of scores; null for an empty span, fails outside [0, 1]."""
    bad = F.exists(scores, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    safe = guarded(scores, bad, "scores must be finite and lie in [0,1]")
    n = F.when(F.size(scores) > 0, F.size(scores))
    share = F.size(F.filter(safe, lambda v: v >= threshold)) / n
    mean = F.aggregate(safe, F.lit(0.0), lambda a, v: a + v) / n
    return {"share": share, "mean_score": mean, "majority": share > 0.5, "majority_04": share > 0.4, "majority_06": share > 0.6}


def span_gate(length: Column, share_high: Column, minimum: int = 50, required: float = 0.8) -> Column:
    """Reason of a span: too short, too little local confidence, or qualified."""
    return (F.when(length < minimum, "span_below_50aa").when(share_high < required, "insufficient_local_confidence")
            .otherwise("qualified"))


def half_open_slice(values: Column, start: Column, end: Column) -> Column:
    """values[start:end], 0-based; null without both ends, fails outside the array."""
    outside = (start < 0) | (start > end) | (end > F.size(values))
    return F.when(start.isNull() | end.isNull(), None).otherwise(
        F.slice(guarded(values, outside, "region outside sequence"), (start + 1).cast("int"), (end - start).cast("int")))


def fitted_rmsd(points: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Root mean square deviation after the best rotation (no reflection), at least three points.

    One aggregate of products per key, then the singular values of the 3x3
    covariance from the cubic of its square; nothing leaves the JVM.
    """
    n = F.count("*")
    sums = {"n": n}
    for c in (*a, *b):
        sums[f"m_{c}"] = F.avg(c)
        sums[f"q_{c}"] = F.sum(F.col(c) * F.col(c))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            sums[f"h{i}{j}"] = F.sum(F.col(x) * F.col(y))
    t = points.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    h = {f"h{i}{j}": F.col(f"h{i}{j}") - F.col("n") * F.col(f"m_{x}") * F.col(f"m_{y}")
         for i, x in enumerate(a) for j, y in enumerate(b)}
    spread = sum((F.col(f"q_{c}") - F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}") for c in (*a, *b)), F.lit(0.0))
    t = t.withColumns({**h, "spread": spread})
    m = {f"s{i}{j}": sum((F.col(f"h{k}{i}") * F.col(f"h{k}{j}") for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(i, 3)}

    def det3(p):
        return (p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0])
                + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0]))

    t = t.withColumns(m).withColumn("det", det3([[F.col(f"h{i}{j}") for j in range(3)] for i in range(3)]))
    q = (F.col("s00") + F.col("s11") + F.col("s22")) / 3
    t = t.withColumn("q", q)
    p2 = (sum(((F.col(f"s{i}{i}") - F.col("q")) ** 2 for i in range(3)), F.lit(0.0))
          + 2 * (F.col("s01") ** 2 + F.col("s02") ** 2 + F.col("s12") ** 2)) / 6
    t = t.withColumn("p", F.sqrt(p2))
    sym = lambda i, j: (F.col(f"s{min(i, j)}{max(i, j)}") - (F.col("q") if i == j else F.lit(0.0)))
    r = det3([[sym(i, j) for j in range(3)] for i in range(3)]) / (2 * F.col("p") ** 3)
    t = t.withColumn("phi", F.when(F.col("p") > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3).otherwise(F.lit(0.0)))
    t = t.withColumn("e1", F.col("q") + 2 * F.col("p") * F.cos("phi")).withColumn(
        "e3", F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * F.pi() / 3))
    t = t.withColumn("e2", 3 * F.col("q") - F.col("e1") - F.col("e3"))
    root = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col(c)))
    fit = root("e1") + root("e2") + F.signum("det") * root("e3")
    value = F.sqrt(F.greatest(F.lit(0.0), F.col("spread") - 2 * fit) / F.col("n"))
    return t.select(*keys, F.col("n").alias("points"), F.when(F.col("n") >= 3, value).alias("rmsd"))
