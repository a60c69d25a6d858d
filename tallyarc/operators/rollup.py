"""Evidence roll-ups: distinct support, caller-deduplicated molecules, junction summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.operators.contracts import guarded
from tallyarc.operators.ranking import tie_ranks
from tallyarc.operators.scan import descending, grouped_quantiles, ordered_running
from tallyarc.session import cut_lineage


def pair_support(reads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct reads per ordered pair; a missing identity fails the job.

    ``keep`` names columns that are functions of the pair.
    """
    pair = guarded(F.col("pair_id"), F.col("pair_id").isNull() | F.col("read_id").isNull(), "missing read or pair identity")
    distinct = reads.select(pair.alias("pair_id"), "read_id", *keep).distinct()
    return distinct.groupBy("pair_id", *keep).agg(F.count("*").alias("support"))


def exact_junctions(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Junction table: distinct reads, source rows and the ends of the sorted id list."""
    per_read = reads.groupBy(*keys, "read_id").agg(F.count("*").alias("_rows"))
    return per_read.groupBy(*keys).agg(F.count("*").alias("support"), F.sum("_rows").alias("source_rows"),
                                       F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"))


def junction_members(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted unique ids of each junction as child rows with their position."""
    per_read = reads.groupBy(*keys, "read_id").agg(F.count("*").alias("source_rows"))
    return ordered_running(per_read, [F.col("read_id")], {"one": F.lit(1)}, partition=keys).withColumnRenamed(
        "cum_one", "position")


def molecules(evidence: DataFrame) -> DataFrame:
    """One row per (junction, sample, read); callers become a sorted set.

    Callers that disagree on the assessment of one molecule fail the job.
    """
    assessed = ["specimen_id", "state", "mapping_specific", "margin", "anchor"]
    body = F.struct(*assessed)
    grouped = evidence.groupBy("junction_id", "sample_id", "read_id").agg(
        F.min(body).alias("_body"), F.max(body).alias("_other"), F.array_sort(F.collect_set("caller")).alias("callers"))
    checked = guarded(F.col("_body"), ~F.col("_body").eqNullSafe(F.col("_other")), "conflicting assessment of the same molecule")
    return grouped.withColumn("_body", checked).select(
        "junction_id", "sample_id", "read_id", *[f"_body.{c}" for c in assessed], "callers")


def priority(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


def junctions(rows: DataFrame, states: Sequence[str], callers: Sequence[str]) -> DataFrame:
    """Junction summary; only molecules in the first state count as support."""
    good = F.col("state") == states[0]
    known = F.array(*[F.lit(c) for c in callers])
    specimens = F.collect_set(F.when(good, F.col("specimen_id")))
    rows = cut_lineage(rows)  # shared by the counts, both medians and the source sets
    out = rows.groupBy("junction_id").agg(
        F.min_by("state", priority("state", states)).alias("evidence_state"),
        F.size(specimens).cast("long").alias("specimens"),
        F.count_if(good).alias("qualifying_reads"),
        F.count_if(good & F.col("mapping_specific")).alias("specific_reads"),
        F.count_if(good & F.col("mapping_specific").isNull()).alias("unknown_specific_reads"),
        F.count_if(good & F.col("margin").isNull()).alias("_no_margin"),
        F.count_if(good & F.col("anchor").isNull()).alias("_no_anchor"),
        F.count("*").alias("assessed_reads"),
        *[F.count_if(F.col("state") == s).alias(f"n_state_{i}") for i, s in enumerate(states)])
    qualified = rows.where(good)
    sources = (qualified.select("junction_id", F.explode("callers").alias("c")).groupBy("junction_id")
               .agg(F.array_sort(F.collect_set("c")).alias("proposal_sources")))
    margin = grouped_quantiles(qualified, ["junction_id"], "margin", {"median_margin": 0.5})
    anchor = grouped_quantiles(qualified, ["junction_id"], "anchor", {"median_anchor": 0.5})
    joined = out.join(margin, "junction_id", "left").join(anchor, "junction_id", "left").join(sources, "junction_id", "left")
    return joined.select(
        "junction_id", "evidence_state", "specimens", "qualifying_reads", "specific_reads", "unknown_specific_reads",
        F.when(F.col("_no_margin") == 0, F.col("median_margin")).alias("median_margin"),
        F.when(F.col("_no_anchor") == 0, F.col("median_anchor")).alias("median_anchor"), "assessed_reads",
        *[f"n_state_{i}" for i in range(len(states))],
        F.coalesce("proposal_sources", F.array().cast("array<string>")).alias("proposal_sources"),
        F.array_intersect(F.coalesce("proposal_sources", F.array().cast("array<string>")), known).alias("callers"))


def rank_junctions(rows: DataFrame, states: Sequence[str]) -> DataFrame:
    """Tie-preserving order: state, breadth, reads, specificity, margin, anchor, agreement."""
    keys = [priority("evidence_state", states), -F.col("specimens"), -F.col("qualifying_reads"), -F.col("specific_reads"),
            descending(F.col("median_margin")), descending(F.col("median_anchor")), -F.size("callers")]
    return tie_ranks(rows, keys, "junction_id")


def median_if_complete(df: DataFrame, keys: Sequence[str], value: str, name: str, count_name: str) -> DataFrame:
    """Median, null as soon as one contributing value is unknown."""
    size = df.groupBy(*keys).agg(F.count("*").alias(count_name), F.count_if(F.col(value).isNull()).alias("_missing"))
    middle = grouped_quantiles(df, keys, value, {name: 0.5})
    return size.join(middle, list(keys), "left").select(
        *keys, F.when(F.col("_missing") == 0, F.col(name)).alias(name), count_name)


def reason_list(rules: Mapping[str, Column]) -> Column:
    """Every failed reason, in rule order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())


def first_reason(rules: Mapping[str, Column], default: str | None = None) -> Column:
    """The first rule that holds."""
    out = None
    for name, cond in rules.items():
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default)) if default is not None else out


def value_counts(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "item", "n")


def named_scores(df: DataFrame, scores: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """Unpivot score columns to (score_name, score) rows."""
    packed = F.array(*[F.struct(F.lit(n).alias("score_name"), c.cast("double").alias("score")) for n, c in scores.items()])
    return df.select(*keep, F.explode(packed).alias("_s")).select("_s.score_name", "_s.score", *keep)
