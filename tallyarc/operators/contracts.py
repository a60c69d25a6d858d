"""Fail-closed checks: one aggregate pass per contract, or a lazy raise in the row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input breaks an identity, range or cardinality rule."""


def require_columns(df: DataFrame, names: Iterable[str], closed: bool = False) -> None:
    """Required columns present; with ``closed`` nothing else may be there."""
    have, need = set(df.columns), set(names)
    if need - have:
        raise ContractError(f"missing columns: {sorted(need - have)}")
    if closed and have - need:
        raise ContractError(f"prohibited columns: {sorted(have - need)}")


def violations(df: DataFrame, rules: Mapping[str, Column], key: str | None = None) -> DataFrame:
    """One row with a count per rule; ``duplicate_key`` counts surplus key rows."""
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).cast("long").alias(name) for name, rule in rules.items()]
    if key is None:
        return df.agg(*counts)
    # Partial counts per key first: a repeated key never reaches one task as rows.
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"), *counts)
    return per_key.agg(F.sum(F.col("_n") - 1).cast("long").alias("duplicate_key"),
                       *[F.sum(name).cast("long").alias(name) for name in rules])


def enforce(df: DataFrame, rules: Mapping[str, Column], key: str | None = None) -> DataFrame:
    """Run :func:`violations` now and raise when any count is above zero."""
    found = {k: v for k, v in violations(df, rules, key).first().asDict().items() if v}
    if found:
        raise ContractError(f"contract violations: {found}")
    return df


def guarded(value: Column, bad: Column, message: str) -> Column:
    """``value``, failing the job lazily where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


PAIR_COLUMNS = ["pair_id", "parent_a", "parent_b", "label", "long_read_support", "sample_count",
                "is_interchromosomal", "genomic_distance"]


def pair_rules() -> dict[str, Column]:
    """Rules of the pair panel: identities, binary flags, finite and non-negative numbers."""
    infinite = {c: F.abs(F.col(c).cast("double")) == float("inf") for c in
                ("long_read_support", "sample_count", "genomic_distance")}
    rules = {
        "null_pair_id": F.col("pair_id").isNull(),
        "null_parent": F.col("parent_a").isNull() | F.col("parent_b").isNull(),
        "label_not_binary": F.col("label").isNull() | ~F.col("label").isin(0, 1),
        "chromosome_flag_not_binary": F.col("is_interchromosomal").isNull() | ~F.col("is_interchromosomal").isin(0, 1),
    }
    for c, cond in infinite.items():
        rules[f"infinite_{c}"] = cond
        rules[f"negative_{c}"] = F.col(c) < 0
    return rules


def check_pairs(df: DataFrame) -> DataFrame:
    require_columns(df, PAIR_COLUMNS)
    return enforce(df, pair_rules(), key="pair_id")
