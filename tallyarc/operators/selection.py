"""Shortlists: redundancy suppression, diversity slots, stratified and proportional picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.operators.scan import ordered_running, positions
from tallyarc.session import spread


def near_identical(a: Column, b: Column) -> Column:
    """Edit distance of at most 5 % of the longer text: lengths first, then the banded form (-1 beyond the limit)."""
    limit = F.floor(F.greatest(F.length(a), F.length(b)) / 20).cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= limit
    return F.when(a == b, True).when(near, F.call_function("levenshtein", a, b, limit) >= 0).otherwise(False)


def _near_any(sequence: str, taken: Sequence, near) -> Column:
    out = F.lit(False)
    for row in taken:
        out = out | near(F.col(sequence), F.lit(row[sequence]))
    return out


def _next(eligible: DataFrame, order: Sequence[str], columns: Sequence[str], sequence: str, taken: Sequence, near, condition=None):
    """First row in order that is not near a taken one; a bounded top-1, one row to the driver."""
    rows = eligible.where(~_near_any(sequence, taken, near))
    if condition is not None:
        rows = rows.where(condition)
    return rows.orderBy(*order).select(*columns).limit(1).first()


def _place(df: DataFrame, order: Sequence[str], row) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])


def shortlist(eligible: DataFrame, order: Sequence[str], item: str, sequence: str, slots: int = 8, near=near_identical,
              keep: Sequence[str] = ()) -> tuple[list, DataFrame]:
    """Take rows in order unless near-identical to a taken one, until ``slots`` are full.

    Every round fetches one row and compares the table with the taken ones: rows x
    slots comparisons, no pair table and no limit on what may be redundant. A taken
    row is near itself, and all rows before the last pick are settled, so each round
    looks only behind it. Returns the taken rows and every row of ``eligible`` with
    taken_order, representative and status: taken, redundant, or eligible for rows
    behind the last pick. ``eligible`` is read once per round: pass a stored table.
    """
    taken = []
    eligible = spread(eligible)
    columns = list(dict.fromkeys([*order, item, sequence, *keep]))
    while len(taken) < slots:
        behind = F.struct(*order) > _place(eligible, order, taken[-1]) if taken else None
        row = _next(eligible, order, columns, sequence, taken, near, behind)
        if row is None:
            break
        taken.append(row)
    settled = F.lit(True)
    if len(taken) == slots:
        settled = F.struct(*order) <= _place(eligible, order, taken[-1])
    return taken, _marked(eligible, item, sequence, taken, near, settled)


def _marked(eligible: DataFrame, item: str, sequence: str, taken: Sequence, near, settled: Column) -> DataFrame:
    mine = F.coalesce(*[F.when(F.col(item) == F.lit(r[item]), F.lit(i + 1)) for i, r in enumerate(taken)], F.lit(None).cast("int"))
    rep = F.coalesce(*[F.when(near(F.col(sequence), F.lit(r[sequence])), F.lit(r[item])) for r in taken], F.lit(None).cast(eligible.schema[item].dataType))
    marked = eligible.withColumn("taken_order", mine).withColumn("representative", F.when(settled & F.col("taken_order").isNull(), rep))
    return marked.withColumn("status", F.when(F.col("taken_order").isNotNull(), "taken").when(F.col("representative").isNotNull(), "redundant").otherwise("eligible"))


def fill_with_diversity(eligible: DataFrame, order: Sequence[str], item: str, sequence: str, singleton: Column, klass: str,
                        first: int = 8, total: int = 10, near=near_identical) -> DataFrame:
    """Ranked picks, one singleton, one new class, then ranked fill; a ledger of every row.

    Adds taken_order, representative, status (selected, redundant, deferred) and reason to
    ``eligible``; rows that no pick resembles wait for the next batch.
    """
    eligible = spread(eligible)
    columns = list(dict.fromkeys([*order, item, sequence, klass]))
    taken, _ = shortlist(eligible, order, item, sequence, first, near, keep=[klass])
    reasons = ["top_ranked_distinct_protein"] * len(taken)
    new_class = lambda: ~F.col(klass).isin([t[klass] for t in taken])
    wishes = [(lambda: singleton, "diversity_supported_singleton"), (new_class, "diversity_junction_class")]
    wishes += [(lambda: F.lit(True), "ranked_fill_unavailable_diversity_slot")] * total
    for condition, reason in wishes:
        if len(taken) >= total:
            break
        row = _next(eligible, order, columns, sequence, taken, near, condition())
        if row is not None:
            taken.append(row)
            reasons.append(reason)
    marked = _marked(eligible, item, sequence, taken, near, F.lit(True))
    why = F.coalesce(*[F.when(F.col("taken_order") == i + 1, r) for i, r in enumerate(reasons)], F.lit(None).cast("string"))
    state = F.col("status")
    return marked.withColumn("reason", F.when(state == "taken", why).when(state == "redundant", "redundant_sequence").otherwise("batch_limit")).withColumn(
        "status", F.when(state == "taken", "selected").when(state == "redundant", "redundant").otherwise("deferred"))


def interleave(df: DataFrame, lists: str, order: Sequence[Column], name: str = "turn") -> DataFrame:
    """Round robin over several ranked lists: order by (place in its list, list)."""
    placed = positions(df, order, [lists], "_place")
    return positions(placed, [F.col("_place"), F.col(lists)], name=name).drop("_place")


def eligible_batch(df: DataFrame, order: Sequence[Column], eligible: Column, n: int) -> DataFrame:
    """First n eligible rows; every other row says why it waits."""
    ranked = positions(df.where(eligible), order, name="_place")
    rest = df.where(~eligible).withColumn("_place", F.lit(None).cast("long"))
    status = (F.when(F.col("_place") <= n, "in_batch").when(F.col("_place").isNotNull(), "deferred_batch_limit")
              .otherwise("not_eligible"))
    return ranked.unionByName(rest).withColumn("status", status).drop("_place")


def one_per_cell(df: DataFrame, cells: Sequence[Column], names: Sequence[str], item: str, seed: str) -> DataFrame:
    """One seeded pick per combination of bands."""
    digest = F.sha2(F.concat(F.col(item).cast("string"), F.lit(f"|{seed}")), 256)
    return df.groupBy(*[c.alias(n) for c, n in zip(cells, names)]).agg(
        F.min_by(item, F.struct(digest, F.col(item))).alias("pick"), F.count("*").alias("population"))


def panel(df: DataFrame, item: str, reference: Column, quadrant: Column, seed: str, per_quadrant: int = 2, cap: int = 8) -> DataFrame:
    """Reference rows first, then k per quadrant by hash, then fill by hash, up to ``cap``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256)
    tagged = df.withColumn("_q", quadrant).withColumn("_h", digest).withColumn("_ref", reference)
    quad = tagged.where(~F.col("_ref")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_q").orderBy("_h"))).where(F.col("_n") <= per_quadrant).select(item, F.lit(1).alias("_inq"))
    staged = tagged.join(quad, item, "left").withColumn(
        "stage", F.when(F.col("_ref"), 0).when(F.col("_inq").isNotNull(), 1).otherwise(2))
    return staged.orderBy("stage", "_h").limit(cap).select(item, "stage")


def quota_draw(df: DataFrame, stratum: str, item: str, total: int, seed: str) -> DataFrame:
    """Proportional quota per stratum by largest remainder, then a seeded draw of that many."""
    size = df.groupBy(stratum).agg(F.count("*").alias("population"))
    whole = Window.partitionBy()  # one row per stratum
    share = size.withColumn("_x", F.lit(total) * F.col("population") / F.sum("population").over(whole)).withColumn(
        "_base", F.floor("_x")).withColumn("_left", F.lit(total) - F.sum("_base").over(whole))
    rest = F.row_number().over(whole.orderBy((F.col("_x") - F.col("_base")).desc(), F.col(stratum)))
    quota = share.withColumn("quota", F.col("_base") + (rest <= F.col("_left")).cast("int")).select(stratum, "population", "quota")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256)
    return draw(df.withColumn("_h", digest), stratum, "_h", quota).drop("_h")


def draw(df: DataFrame, stratum: str, order: str, quota: DataFrame) -> DataFrame:
    """First quota rows of each stratum along ``order`` (bucketed numbering for hot strata)."""
    numbered = ordered_running(df, [F.col(order)], {"one": F.lit(1)}, partition=[stratum]).withColumnRenamed("cum_one", "draw_order")
    return numbered.join(quota, stratum).where(F.col("draw_order") <= F.col("quota"))
