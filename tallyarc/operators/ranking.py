"""Tie-preserving ranks, top-k expectations and average precision.

Rows are first reduced to distinct scores (with a map-side combine), so a tie
holding a third of the rows is one row before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.operators.scan import ordered_running
from tallyarc.operators.contracts import guarded
from tallyarc.session import cut_lineage


def tie_ranks(df: DataFrame, tie_keys: Sequence[Column], row_id: str) -> DataFrame:
    """Add ``rank_min``/``rank_max`` of the tie interval and ``display_rank``.

    ``tie_keys`` are ascending keys; the id orders rows for display only.
    """
    names = [f"_t{i}" for i in range(len(tie_keys))]
    # Read by the scans below: computed once, kept where a lost executor cannot take it.
    keyed = cut_lineage(df.select("*", *[k.alias(n) for n, k in zip(names, tie_keys)]))
    ties = cut_lineage(keyed.groupBy(*names).agg(F.count("*").alias("_ties")))
    ties = ordered_running(ties, [F.col(n) for n in names], {"ties": F.col("_ties")})
    ties = ties.select(*[F.col(n).alias(f"_j{n}") for n in names],
                       (F.col("cum_ties") - F.col("_ties") + 1).alias("rank_min"), F.col("cum_ties").alias("rank_max"))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_j{n}"))
    # Within a tie only ids are compared, and only large ties are looked for their buckets.
    ranked = cut_lineage(keyed.join(ties, on, "left").select(*df.columns, "rank_min", "rank_max"))
    shown = ordered_running(ranked, [F.col(row_id)], {"one": F.lit(1)}, partition=["rank_min"])
    return shown.select(*df.columns, "rank_min", "rank_max", (F.col("rank_min") - 1 + F.col("cum_one")).alias("display_rank"))


def sequential_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1..n along ``order`` (ascending keys that end in a unique id)."""
    return ordered_running(df, order, {"one": F.lit(1)}).withColumnRenamed("cum_one", name)


def score_steps(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct finite score with ``n``, ``pos`` and running totals from the top."""
    finite = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (
        F.abs(F.col(score).cast("double")) != float("inf"))
    steps = df.where(finite).groupBy(*groups, F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return ordered_running(steps, [F.negate("score")],
                           {"n": F.col("n"), "pos": F.col("pos")}, partition=groups)


def average_precision(steps: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Tied scores act as one threshold; null when only one class is present."""
    total, size = F.max("cum_pos"), F.max("cum_n")
    gain = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    value = F.when((total > 0) & (total < size), gain / total)
    return steps.groupBy(*groups).agg(size.alias("n"), total.alias("positives"), value.alias("average_precision"))


def strict_topk(df: DataFrame, label: str, score: str, k: int) -> DataFrame:
    """``topk`` of complete input: a label other than 0 or 1, a score that is null or not finite, or a k outside 1..n is an error."""
    if k < 1:
        raise ValueError("k must be between 1 and the number of candidates")
    y, s = F.col(label), F.col(score).cast("double")
    bad_label = ~F.coalesce(y.cast("double").isin(0.0, 1.0), F.lit(False))
    bad_score = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    checked = df.withColumns({label: guarded(y, bad_label, "labels must be 0 or 1"), score: guarded(F.col(score), bad_score, "scores must be finite")})
    edge = topk(score_steps(checked, label, score), k)
    return edge.withColumn("k", guarded(F.col("k"), F.col("n") < k, "k exceeds the candidate count"))


def topk(steps: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """Expected, minimum and maximum hits among the first k with the boundary tie; k is capped at n."""
    reached = F.col("cum_n") - F.col("n") < k
    edge = F.max(F.when(reached, F.struct("cum_n", "cum_pos", "n", "pos", "score")))
    base = steps.groupBy(*groups).agg(F.max("cum_n").alias("n_rows"), F.max("cum_pos").alias("positives"),
                                      edge.alias("e"))
    kk = F.least(F.lit(k), F.col("n_rows"))
    above_n, above_pos = F.col("e.cum_n") - F.col("e.n"), F.col("e.cum_pos") - F.col("e.pos")
    slots = kk - above_n
    expected = above_pos + slots * F.col("e.pos") / F.col("e.n")
    zero = F.lit(0).cast("long")
    return base.select(
        *groups, F.col("n_rows").cast("long").alias("n"), F.col("positives").cast("long").alias("positives"),
        kk.cast("long").alias("k"), expected.cast("double").alias("expected_hits"),
        (above_pos + F.greatest(zero, slots - (F.col("e.n") - F.col("e.pos")))).cast("long").alias("min_hits"),
        (above_pos + F.least(slots, F.col("e.pos"))).cast("long").alias("max_hits"),
        F.col("e.score").cast("double").alias("tie_score"), F.col("e.n").cast("long").alias("tie_size"),
        slots.cast("long").alias("tie_slots"), F.col("e.pos").cast("long").alias("tie_positives"),
        above_pos.cast("long").alias("hits_above_tie"),
        (expected / kk).alias("precision_at_k"),
        F.when(F.col("positives") > 0, expected / F.col("positives")).alias("recall_at_k"))


def first_k_hits(df: DataFrame, label: str, score: str, row_id: str, k: int) -> DataFrame:
    """Audit count with ids breaking ties; a bounded top-n, not a sort of the table."""
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
            .orderBy(F.col(score).desc(), F.col(row_id).asc()).limit(k)
            .agg(F.sum(F.col(label).cast("long")).alias("id_tiebreak_hits")))


def recovery_curve(steps: DataFrame, k_max: int, groups: Sequence[str] = ()) -> DataFrame:
    """Expected hits for every k up to ``k_max`` (capped at n)."""
    start = F.col("cum_n") - F.col("n")
    return (steps.where(start < k_max)
            .withColumn("k", F.explode(F.sequence(start + 1, F.least(F.col("cum_n"), F.lit(k_max)))))
            .select(*groups, F.col("k").cast("long").alias("k"),
                    (F.col("cum_pos") - F.col("pos") + (F.col("k") - start) * F.col("pos") / F.col("n"))
                    .alias("expected_hits")))


def precision_recall(steps: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score."""
    total = steps.groupBy(*groups).agg(F.max("cum_pos").alias("_total"))
    joined = steps.join(total, list(groups)) if groups else steps.withColumn("_total", total.select("_total").scalar())
    return joined.select(*groups, F.col("score").cast("double").alias("score"),
                         (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                         F.expr("try_divide(cum_pos, _total)").alias("recall"))


def hypergeometric_interval(cases: DataFrame, case_id: Sequence[str], population: str, successes: str, draws: str,
                            low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Smallest hit counts whose cumulative probability reaches ``low`` and ``high``.

    Log ratios of neighbouring probabilities are summed over the support, at most
    ``draws`` + 1 rows per case.
    """
    n_, k_, d_ = F.col(population), F.col(successes), F.col(draws)
    rows = cases.select(*case_id, n_.alias("_n"), k_.alias("_k"), d_.alias("_d"),
                        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), d_ - (n_ - k_)).cast("long"),
                                             F.least(d_, k_).cast("long"))).alias("x"))
    w = Window.partitionBy(*case_id).orderBy("x")
    ratio = F.log((F.col("_k") - F.col("x") + 1) * (F.col("_d") - F.col("x") + 1)
                  / (F.col("x") * (F.col("_n") - F.col("_k") - F.col("_d") + F.col("x"))))
    first = F.row_number().over(w) == 1
    logs = rows.withColumn("_l", F.sum(F.when(first, F.lit(0.0)).otherwise(ratio)).over(w))
    whole = Window.partitionBy(*case_id)
    weight = logs.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(whole)))
    cdf = weight.withColumn("_c", F.sum("_w").over(w) / F.sum("_w").over(whole))
    slack = 1e-12
    return cdf.groupBy(*case_id).agg(
        F.min(F.when(F.col("_c") >= low - slack, F.col("x"))).alias("lower"),
        F.min(F.when(F.col("_c") >= high - slack, F.col("x"))).alias("upper"))


def interval_topk(df: DataFrame, hit: str, tie_keys: Sequence[Column], k: int) -> DataFrame:
    """Expected hits at k over given tie intervals (or any ordering key such as -reads)."""
    names = [f"_t{i}" for i in range(len(tie_keys))]
    ties = df.select(F.col(hit).cast("long").alias("_h"), *[c.alias(n) for c, n in zip(tie_keys, names)]).groupBy(
        *names).agg(F.count("*").alias("n"), F.sum("_h").alias("pos"))
    steps = ordered_running(ties, [F.col(n) for n in names], {"n": F.col("n"), "pos": F.col("pos")})
    return topk(steps.withColumn("score", F.lit(None).cast("double")), k).select(
        "k", F.col("expected_hits").alias("expected_supported"), F.col("precision_at_k").alias("fraction"))


