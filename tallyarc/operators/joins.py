"""Evidence joins: declared cardinality, membership, match classes, ledgers, pairs within a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.operators.contracts import guarded

BLOCK = 64


def unique_side(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows keyed by ``on``; a repeated key fails the job while it is being grouped."""
    rest = [c for c in df.columns if c not in on]
    grouped = df.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(1).alias("_"), *rest)).alias("_r"))
    body = guarded(F.col("_r"), F.col("_n") > 1, "right side of a one-to-one join repeats a key")
    return grouped.withColumn("_r", body).select(*on, *[F.col(f"_r.{c}").alias(c) for c in rest])


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    return left.join(unique_side(right, on), list(on), how)


def member_flags(df: DataFrame, key: str, lists: Mapping[str, DataFrame]) -> DataFrame:
    """One boolean per list; each list is a one-column table."""
    for name, members in lists.items():
        column = members.columns[0]
        side = members.select(F.col(column).alias(f"_k_{name}")).where(F.col(column).isNotNull()).distinct()
        df = df.join(side, F.col(key) == F.col(f"_k_{name}"), "left").withColumn(
            name, F.col(f"_k_{name}").isNotNull()).drop(f"_k_{name}")
    return df


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Two-way anti join: rows (key, side) with side ``missing`` or ``extra``."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def match_class(df: DataFrame, catalogue: DataFrame, a: str, b: str) -> DataFrame:
    """Ordered match first, then a reversed name, else absent."""
    known = catalogue.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    exact = known.select("_a", "_b", F.lit(True).alias("_exact"))
    swapped = known.select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.lit(True).alias("_rev"))
    return (df.join(exact, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
            .join(swapped, (F.col(a) == F.col("_d")) & (F.col(b) == F.col("_c")), "left")
            .withColumn("match", F.when(F.col("_exact"), "exact").when(F.col("_rev"), "reverse_name_only").otherwise("absent"))
            .drop("_a", "_b", "_c", "_d", "_exact", "_rev"))


def compare_records(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer comparison on a unique id: every reason why a record differs."""
    left = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    right = b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("_b"))
    reasons = [F.when(F.col("_a").isNull(), F.lit("only_in_second")), F.when(F.col("_b").isNull(), F.lit("only_in_first"))]
    both = F.col("_a") & F.col("_b")
    reasons += [F.when(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f"{f}_differs")) for f in fields]
    return left.join(right, key, "full_outer").select(
        key, F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"))


def _blocked(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Tag rows with one of ceil(n / BLOCK) blocks of their key, so a hot key becomes many cells."""
    size = df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    return df.join(size, list(keys)).withColumn("_block", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))


def pairs_within(df: DataFrame, keys: Sequence[str], row_id: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of rows sharing a key, as (keys, a_*, b_*) with a_id < b_id.

    Cells of (block, block) bound what one task joins; the caller aggregates them.
    """
    rows = _blocked(df, keys, row_id)
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    cells = rows.withColumn("_o", F.explode(other))
    a = cells.select(*keys, F.col("_block").alias("_i"), F.col("_o").alias("_j"),
                     *[F.col(c).alias(f"a_{c}") for c in [row_id, *columns]])
    b = cells.select(*keys, F.col("_o").alias("_i"), F.col("_block").alias("_j"),
                     *[F.col(c).alias(f"b_{c}") for c in [row_id, *columns]])
    return a.join(b, [*keys, "_i", "_j"]).where(F.col(f"a_{row_id}") < F.col(f"b_{row_id}")).drop("_i", "_j")


def product_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Left x right alternatives per key; both sides are cut into blocks first."""
    ln = left.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_nl"))
    rn = right.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_nr"))
    cells = ln.join(rn, list(keys))
    a = (left.join(cells, list(keys)).withColumn("_i", F.pmod(F.xxhash64(left_id), F.col("_nl")).cast("int"))
         .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr"))
    b = (right.join(cells, list(keys)).withColumn("_j", F.pmod(F.xxhash64(right_id), F.col("_nr")).cast("int"))
         .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr"))
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


#: A join cell with more rows of one side is cut; the most cells looked for, parts of one side, and cells counted at a time.
HOT_ROWS, HOT_CELLS, MOST_PARTS, TRACKED = 4096, 1000, 32, 20_000


def heaviest(cell: str, hot_rows: int | None = None) -> Column:
    """Aggregate: a map of the values of ``cell`` (a hash) with more than ``hot_rows`` rows to their counts, from a sketch of bounded size.

    Made with the aggregate: a list would be turned into a map again for every row that is looked up.
    """
    return F.expr(f"map_from_entries(filter(approx_top_k({cell}, {HOT_CELLS}, {TRACKED}), t -> t.count > {HOT_ROWS if hot_rows is None else hot_rows}))")


def split_hot(left: DataFrame, right: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS, tops: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join and its columns, with the heaviest cells of ``on`` cut into parts that meet two by two.

    The heavy cells come from one sketch of each side (a bounded list whose errors cost
    balance, never rows), so no row is shuffled to be counted. ``tops`` are such sketches
    that a caller has already. Rows of a cell that isn't heavy have no copies; a heavy one's
    rows have as many as the other side has parts there.
    """
    def parts(df: DataFrame, top: Column | None) -> Column:
        if top is None:
            top = df.select(F.xxhash64(*on).alias("_cell")).agg(heaviest("_cell", hot_rows)).scalar()
        rows = F.try_element_at(top, F.xxhash64(*on))
        return F.coalesce(F.when(rows > hot_rows, F.least(F.ceil(rows / hot_rows), F.lit(MOST_PARTS)).cast("int")), F.lit(1))

    n = {"_part_l": parts(left, tops and tops[0]), "_part_r": parts(right, tops and tops[1])}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.withColumn(own, F.pmod(F.xxhash64(*df.columns), n[own]).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), n[other] - 1)))

    return dealt(left, "_part_l", "_part_r"), dealt(right, "_part_r", "_part_l"), [*on, "_part_l", "_part_r"]


def ledger_status(planned: DataFrame, history: DataFrame, key: str, status: str, default: str = "pending") -> DataFrame:
    """Every planned job with its status; ``default`` where no history exists."""
    return planned.join(history, key, "left").withColumn(status, F.coalesce(F.col(status), F.lit(default)))


def ledger_merge(rows: DataFrame, key: str, verified: Column, order: Sequence[Column]) -> DataFrame:
    """Later row wins unless it would replace a verified row with an unverified one."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(
        verified.cast("int").alias("v"), *[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r"))
    return best.select(key, "_r.*")


def corroboration(a: DataFrame, b: DataFrame, key: str, strata: Mapping[str, Column]) -> DataFrame:
    """Shared and one-sided keys of two libraries with both directional fractions per stratum.

    ``strata`` conditions use columns that both sides carry.
    """
    inputs = [c for c in a.columns if c != key]
    rows = a.select(key, *inputs, F.lit(1).alias("_side")).unionByName(b.select(key, *inputs, F.lit(2).alias("_side")))
    # Dealt out first: keys seldom repeat, and a task then groups a shuffle partition, not a whole split of the scan.
    flags = rows.repartition(key).groupBy(key).agg(*[
        F.max((F.coalesce(cond, F.lit(False)) & (F.col("_side") == side)).cast("int")).alias(f"{s}_{i}")
        for i, cond in enumerate(strata.values()) for side, s in ((1, "a"), (2, "b"))])
    held = [F.struct(F.lit(name).alias("stratum"), F.sum(f"a_{i}").alias("n_a"), F.sum(f"b_{i}").alias("n_b"), F.sum(F.col(f"a_{i}") * F.col(f"b_{i}")).alias("shared"),
                     F.sum(F.greatest(f"a_{i}", f"b_{i}")).alias("either")) for i, name in enumerate(strata)]
    counted = flags.agg(F.array(*held).alias("_s")).select(F.inline("_s")).where("either > 0")
    return counted.withColumn("a_to_b", F.expr("try_divide(shared, n_a)")).withColumn("b_to_a", F.expr("try_divide(shared, n_b)"))


def wide_metrics(base: DataFrame, metrics: DataFrame, key: str, group: str, values: Sequence[str],
                 groups: Sequence[str]) -> DataFrame:
    """Left join of metrics pivoted to ``<group>_<value>`` columns plus availability flags."""
    picked = metrics.groupBy(key).agg(
        *[F.max(F.when(F.col(group) == g, F.col(v))).alias(f"{g}_{v}") for g in groups for v in values],
        *[F.max(F.col(group) == g).alias(f"has_{g}") for g in groups])
    out = base.join(picked, key, "left")
    return out.withColumns({f"has_{g}": F.coalesce(F.col(f"has_{g}"), F.lit(False)) for g in groups})
