"""Ordered running totals that do not pass the whole table through one task.

A window without partition keys sorts everything in a single task. Here the
ordered domain is cut at sampled split points into buckets, each bucket is
scanned on its own, and the bucket totals (a few hundred rows) give each bucket
its starting value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyarc.session import cut_lineage

LEAST_BUCKETS = 128
SAMPLE_PER_BUCKET = 8
#: A partition with as many sampled rows is cut into buckets; one with fewer holds about as many rows as a few buckets do.
HEAVY_SAMPLED = 16


def bucket_count(df: DataFrame) -> int:
    """A power of two, four times the shuffle partitions at least: it grows with what the session plans for its data."""
    return max(LEAST_BUCKETS, 1 << (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def descending(column: Column, nulls_last: bool = True) -> Column:
    """Ascending sort key equal to ``column`` descending; nulls kept at one end."""
    value = F.negate(column)  # in its own type: doubles would join long values beyond 2**53
    return F.struct(column.isNull().alias("missing") if nulls_last else column.isNotNull().alias("present"),
                    value.alias("value"))


def _sample(df: DataFrame, key: Column, buckets: int, partition: Sequence[str]) -> DataFrame:
    """The rows with the smallest hashes of partition and key (a bounded top-n): ``k``, and ``p``, a hash of the partition."""
    return (df.select(key.alias("k"), F.xxhash64(*partition, key).alias("h"), (F.xxhash64(*partition) if partition else F.lit(0).cast("long")).alias("p"))
            .orderBy("h", "k").limit(buckets * SAMPLE_PER_BUCKET))


def _every_eighth(sorted_keys: Column) -> Column:
    step = SAMPLE_PER_BUCKET
    return F.filter(sorted_keys, lambda _, i: i % step == step - 1)


def split_points(df: DataFrame, key: Column, buckets: int, partition: Sequence[str] = ()) -> Column:
    """Scalar subquery holding at most ``buckets`` split points of ``key``.

    The sample repeats exactly when a task is retried, and partitions that share
    their keys don't all offer the same one. Any sample gives correct totals, the
    choice only balances the buckets.
    """
    return _sample(df, key, buckets, partition).agg(F.array_sort(F.collect_list("k")).alias("s")).select(_every_eighth(F.col("s"))).scalar()


def _heavy_and_cuts(df: DataFrame, key: Column, buckets: int, partition: Sequence[str]) -> Column:
    """Scalar subquery: hashes of the partitions with ``HEAVY_SAMPLED`` sampled rows or more, and the split points of their rows."""
    per = _sample(df, key, buckets, partition).groupBy("p").agg(F.collect_list("k").alias("ks")).where(F.size("ks") >= (HEAVY_SAMPLED if partition else 0))
    every = per.agg(F.collect_list("p").alias("heavy"), F.array_sort(F.flatten(F.collect_list("ks"))).alias("s"))
    return every.select(F.struct("heavy", _every_eighth(F.col("s")).alias("cuts"))).scalar()


def _cuts_below(buckets: int) -> Column:
    """Number of split points below ``_key``, by halving steps instead of a full pass."""
    steps = F.array(*[F.lit(buckets >> i) for i in range(buckets.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step <= F.size("_cuts")) & (F.get("_cuts", low + step - 1) < F.col("_key")), low + step).otherwise(low))


def ordered_running(df: DataFrame, by: Sequence[Column], measures: dict[str, Column] | None = None,
                    partition: Sequence[str] = (), maxima: dict[str, Column] | None = None,
                    exclusive: bool = False) -> DataFrame:
    """Add running sums ``cum_<name>`` and running maxima ``top_<name>`` along ``by``.

    ``by`` are ascending sort keys, distinct per partition for a defined order.
    ``exclusive`` leaves the current row out (a sum starts at 0, a maximum at null).
    Only heavy partitions are cut into buckets; what came before a bucket is then a short
    table, at most the sample's partitions times the buckets, so rows are shuffled once.
    """
    partition = list(partition)
    measures, maxima = measures or {}, maxima or {}
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])
    seen = _heavy_and_cuts(df, key, bucket_count(df), partition)
    is_heavy = F.array_contains(seen["heavy"], F.xxhash64(*partition)) if partition else F.lit(True)
    tagged = df.withColumn("_key", key).withColumn("_cuts", seen["cuts"])
    tagged = tagged.withColumn("_bucket", F.when(is_heavy, _cuts_below(bucket_count(df))).otherwise(-1)).drop("_cuts")
    tagged = tagged.withColumns({f"_m_{n}": c for n, c in measures.items()} | {f"_x_{n}": c for n, c in maxima.items()})
    totals = tagged.where("_bucket >= 0").groupBy(*partition, "_bucket").agg(
        *[F.sum(f"_m_{n}").alias(f"_m_{n}") for n in measures], *[F.max(f"_x_{n}").alias(f"_x_{n}") for n in maxima])
    earlier = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_p_{c}") for c in partition], F.col("_bucket").alias("_p_bucket"),
                           *[F.coalesce(F.sum(f"_m_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in measures],
                           *[F.max(f"_x_{n}").over(earlier).alias(f"_y_{n}") for n in maxima])
    inside = Window.partitionBy(*partition, "_bucket").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    on = F.col("_bucket") == F.col("_p_bucket")
    for c in partition:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    before = lambda n: F.coalesce(F.col(f"_s_{n}"), F.lit(0))  # noqa: E731  # none in a partition of one bucket
    return tagged.join(F.broadcast(starts), on, "left").select(
        *df.columns,
        *[(F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0)) + before(n)).alias(f"cum_{n}") for n in measures],
        *[F.greatest(F.max(f"_x_{n}").over(inside), F.col(f"_y_{n}")).alias(f"top_{n}") for n in maxima])


def last_seen(df: DataFrame, by: Sequence[Column], value: Column, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` up to and including each row."""
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])
    carried = F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("value")))
    return ordered_running(df, by, partition=partition, maxima={"seen": carried}).select(
        *df.columns, F.col("top_seen.value").alias(name))


def positions(df: DataFrame, by: Sequence[Column], partition: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1..n along ``by`` within each partition; a hot partition is spread over tasks."""
    return ordered_running(df, by, {"one": F.lit(1)}, partition).withColumnRenamed("cum_one", name)


def following(df: DataFrame, by: Sequence[Column], partition: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pair each row with the next one: an equi join on position instead of ``lead`` over a hot key."""
    placed = positions(df, by, partition, "_at")
    after = placed.select(*[F.col(c).alias(f"_n_{c}") for c in partition], (F.col("_at") - 1).alias("_n_at"),
                          *[F.col(c).alias(f"next_{c}") for c in columns])
    on = F.col("_at") == F.col("_n_at")
    for c in partition:
        on = on & (F.col(c) == F.col(f"_n_{c}"))
    return placed.join(after, on, "left").select(*df.columns, *[f"next_{c}" for c in columns])


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, nulls ignored.

    Works on counts per distinct value with a bucketed running count, so a group
    holding a third of the table is spread over many tasks.
    """
    groups = list(groups)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))  # read four times
    run = ordered_running(counts, [F.col("_v")], {"n": F.col("_n")}, partition=groups)
    size = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    if groups:
        run = run.join(size, groups)
    else:
        run = run.withColumn("_size", size.select("_size").scalar())
    aggregates = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        first, last = F.col("cum_n") - F.col("_n"), F.col("cum_n") - 1
        pick = lambda pos: F.max(F.when((first <= pos) & (pos <= last), F.col("_v").cast("double")))
        lo, hi = pick(low), pick(high)
        aggregates.append((lo + (hi - lo) * F.max(at - low)).alias(name))
    return run.groupBy(*groups).agg(*aggregates)
