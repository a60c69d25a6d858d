"""Logistic models with fold-local preprocessing, and resampling of fixed predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import lgamma, log, pi

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.operators.scan import grouped_quantiles, ordered_running
from tallyarc.session import cut_lineage


@dataclass
class Fitted:
    """Preprocessing constants (one number per feature) and the fitted classifier."""

    features: list[str]
    medians: dict[str, float]
    indicators: list[str]
    centres: dict[str, float]
    scales: dict[str, float]
    classifier: LogisticRegressionModel

    def inputs(self) -> list[Column]:
        columns = {f: F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f])) for f in self.features}
        columns |= {f"missing_{f}": F.col(f).isNull().cast("double") for f in self.indicators}
        return [((c - self.centres[n]) / self.scales[n]).alias(f"_z_{n}") for n, c in columns.items()]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        z = self.inputs()
        names = [f"_z_{n}" for n in self.centres]
        wide = df.select("*", *z)
        vector = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
        out = self.classifier.transform(vector)
        return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def fit(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> Fitted:
    """Median fill, missing indicators, standard scores (population deviation), L2 logistic.

    Medians are exact and computed in buckets; a feature without any value is kept as 0.
    """
    features = list(features)
    missing = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    n = missing["_n"]
    medians = {}
    for f in features:
        if missing[f] == n or missing[f] == 0:
            medians[f] = 0.0
            continue
        medians[f] = grouped_quantiles(df.select(F.col(f).cast("double").alias(f)), [], f, {"m": 0.5}).first()["m"]
    indicators = [f for f in features if 0 < missing[f] < n]
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f])) for f in features}
    filled |= {f"missing_{f}": F.col(f).isNull().cast("double") for f in indicators}
    stats = df.agg(*[F.avg(v).alias(f"m_{k}") for k, v in filled.items()], *[F.stddev_pop(v).alias(f"s_{k}") for k, v in filled.items()]).first()
    centres = {k: stats[f"m_{k}"] for k in filled}
    scales = {k: stats[f"s_{k}"] or 1.0 for k in filled}
    ready = df.select(F.col(label).cast("double").alias("label"),
                      *[((v - centres[k]) / scales[k]).alias(f"_z_{k}") for k, v in filled.items()])
    vector = VectorAssembler(inputCols=[f"_z_{k}" for k in filled], outputCol="features").transform(ready)
    data = vector.select("features", "label").persist()
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
    data.unpersist()
    return Fitted(features, medians, indicators, centres, scales, model)


def out_of_fold(df: DataFrame, fold: str, features: Sequence[str], label: str, name: str) -> DataFrame:
    """Score each fold with a model fitted on the others; preprocessing is refitted per fold."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for f in folds:
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        scored = fit(train, features, label).score(test, name)
        out = scored if out is None else out.unionByName(scored)
    return out


def draws(groups: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, weight): groups drawn with replacement, each replicate as many as there are groups.

    Draw i of replicate r takes the group at a hashed index, in 64-bit integer arithmetic.
    """
    indexed = ordered_running(groups, [F.col("group")], {"one": F.lit(1).cast("long")}).select(
        "group", (F.col("cum_one") - 1).alias("_i"))
    size = groups.agg(F.count("*").alias("n"))
    drawn = (indexed.withColumn("_g", size.scalar())
             .withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")))))
    mixed = (F.col("replicate") * 7919 + F.col("_i") * 104729 + F.lit(seed)) % 2147483647
    mixed = (mixed * 48271 + F.col("replicate") * 13) % 2147483647
    mixed = (mixed * 16807 + F.col("_i")) % 2147483647
    picked = drawn.select("replicate", (mixed % F.col("_g")).alias("_i")).groupBy("replicate", "_i").agg(F.count("*").alias("weight"))
    return picked.join(indexed, "_i").select("replicate", "group", "weight")


def bootstrap_difference(df: DataFrame, label: str, score_a: str, score_b: str, group: str, replicates: int = 1000,
                         seed: int = 42) -> DataFrame:
    """Difference of average precision (b - a) under resampled groups of fixed predictions.

    Rows are first counted per (group, score, label); replicates with one class are dropped.
    """
    long = df.select(F.col(group).alias("group"), F.col(label).cast("long").alias("y"),
                     F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(score_a).cast("double").alias("score")),
                                       F.struct(F.lit("b").alias("side"), F.col(score_b).cast("double").alias("score")))).alias("s"))
    counts = cut_lineage(long.groupBy("group", "s.side", "s.score").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    weights = draws(counts.select("group").distinct(), replicates, seed)
    steps = counts.join(weights, "group").groupBy("replicate", "side", "score").agg(
        F.sum(F.col("n") * F.col("weight")).alias("n"), F.sum(F.col("pos") * F.col("weight")).alias("pos"))
    ap = _ap(steps, ["replicate", "side"]).groupBy("replicate").pivot("side", ["a", "b"]).agg(F.first("ap"))
    valid = ap.where("a IS NOT NULL AND b IS NOT NULL").select((F.col("b") - F.col("a")).alias("d"))
    point = _ap(counts.groupBy("side", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), ["side"])
    pick = lambda s: point.where(F.col("side") == s).select("ap").scalar()
    # One row per replicate: the percentiles see at most ``replicates`` values.
    return valid.agg(F.count("*").alias("valid_resamples"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high")).select(
        (pick("b") - pick("a")).alias("delta_average_precision"), "low", "high", "valid_resamples",
        F.lit(replicates).cast("long").alias("requested_resamples"))


def _ap(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    run = ordered_running(steps, [-F.col("score")], {"n": F.col("n"), "pos": F.col("pos")}, partition=keys)
    total, size = F.max("cum_pos"), F.max("cum_n")
    return run.groupBy(*keys).agg(F.when((total > 0) & (total < size), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / total).alias("ap"))


#: Terms of log(i!) below this are looked up, above they are summed from Stirling's series (off by less than 1e-11).
EXACT = 16


def log_falling(x: Column, m: Column) -> Column:
    """log(x! / (x - m)!) for 0 <= m <= x, row by row: its error follows m log x, not the size of log(x!)."""
    table = F.array(*[F.lit(lgamma(i + 1)) for i in range(EXACT)])
    z, w = (x + 1).cast("double"), (x - m + 1).cast("double")
    series = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    whole = (z - 0.5) * F.log(z) - z + 0.5 * log(2 * pi) + series(z)
    ratio = (w - 0.5) * F.log1p(m / w) + m * F.log(z) - m + series(z) - series(w)
    looked = lambda i: F.get(table, i.cast("int"))
    return F.when(x < EXACT, looked(x) - looked(x - m)).when(x - m < EXACT, whole - looked(x - m)).otherwise(ratio)


def rarefaction(members: DataFrame, cluster: str, member: str, block: int = 16_384) -> DataFrame:
    """Expected clusters seen among n of N members, n = 0 .. N.

    Clusters enter by size only: equal sizes share one term, and k distinct sizes need
    k (k + 1) / 2 members, so the list of sizes that meets every n is short. The n are
    dealt out in blocks, and no term needs a look-up in another row.
    """
    per = members.select(cluster, member).distinct()
    population = cut_lineage(per.select(member).distinct().agg(F.count("*").alias("_N")))
    sizes = cut_lineage(per.groupBy(cluster).agg(F.count("*").alias("m")).groupBy("m").agg(F.count("*").alias("clusters")))
    known = sizes.withColumn("_N", population.scalar()).select("m", "clusters", log_falling(F.col("_N"), F.col("m")).alias("all"))
    terms = known.agg(F.collect_list(F.struct("m", "clusters", "all"))).scalar()
    blocks = population.select("_N", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_N") / block))).alias("_b"))
    first = F.col("_b") * block
    tasks = int(population.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or so few rows would be put together in one
    places = blocks.repartition(tasks, "_b").select("_N", F.explode(F.sequence(first, F.least(first + block - 1, F.col("_N")))).alias("n"))
    grid = places.withColumn("_x", F.col("_N") - F.col("n")).select("n", "_x", F.explode(terms).alias("_t")).select("n", "_x", "_t.*")
    # C(N-m, n) / C(N, n) = C(N-n, m) / C(N, m)
    unseen = F.when(F.col("_x") >= F.col("m"), F.exp(log_falling(F.col("_x"), F.col("m")) - F.col("all"))).otherwise(F.lit(0.0))
    return grid.groupBy("n").agg(F.sum(F.col("clusters") * (1 - unseen)).alias("expected_clusters"))
