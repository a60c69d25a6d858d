"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into hashed blocks of whole documents. Blocks are chosen so that
their words come to the source's target; the chosen block units (a block may be taken
twice) are dealt to output shards by a tree that splits the exact unit counts of all
sources, node by node, as a draw without replacement would.

Defined cases: a null text has no words and is taken as often as its block; a null
source is a source of its own, last in order; rows without a doc_id share a block per
size; repeated rows share a block, so each is taken equally often; an empty table gives
an empty mix; other columns ride along.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import require_rows, set_aside, stored, word_count

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above ``most`` times its size."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    left, open_, out = share * sum(n for _, n in ordered), dict(ordered), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if weight[s] * unit > most * n]
        if not full:
            out.update({s: weight[s] * unit for s in open_})
            break
        for s in full:
            out[s] = float(most * open_.pop(s))
            left -= out[s]
    return out


def choose(words: np.ndarray, order: np.ndarray, target: float) -> np.ndarray:
    """Times each block is taken: whole rounds, then blocks in the given order that still fit, then a few exchanges that come nearer."""
    total = int(words.sum())
    if not total:
        return np.zeros(len(words), dtype=np.int64)
    rounds = min(int(target // total), 2)
    copies, left = np.full(len(words), rounds, dtype=np.int64), target - rounds * total
    if rounds == 2:
        return copies
    for i in order:
        if 0 < words[i] <= left:
            copies[i] += 1
            left -= words[i]
    for _ in range(8):  # exchange, add or drop the blocks that bring the sum nearest
        out = np.append(np.flatnonzero((copies == rounds) & (words > 0)), -1)  # -1: no block
        taken = np.append(np.flatnonzero(copies > rounds), -1)
        gain, loss = (np.where(part < 0, 0, words[part]) for part in (out, taken))
        by_loss = np.argsort(loss, kind="stable")
        near = np.searchsorted(loss[by_loss], gain - left)
        pairs = [(abs(left - gain[i] + loss[by_loss[j]]), i, by_loss[j]) for i in range(len(out)) for j in (near[i] - 1, near[i]) if 0 <= j < len(loss)]
        off, i, j = min(pairs)
        if off >= abs(left):
            break
        left += loss[j] - gain[i]
        if out[i] >= 0:
            copies[out[i]] += 1
        if taken[j] >= 0:
            copies[taken[j]] -= 1
    return copies


def leaf_counts(shard: int, shards: int, units: np.ndarray, seed: int, known: dict | None = None) -> np.ndarray:
    """Units of each source in one shard: the path from the root, each node split by a multivariate hypergeometric draw.

    A node's draw depends only on the seed and the shards it covers, so any task finds the same tree.
    """
    known = {} if known is None else known
    low, high, here, total = 0, shards, units, int(units.sum())
    while high - low > 1:
        mid = (low + high) // 2
        if (low, high) not in known:
            left = total * mid // shards - total * low // shards
            known[low, high] = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(here, left, method="marginals")
        left = known[low, high]
        low, high, here = (low, mid, left) if shard < mid else (mid, high, here - left)
    return here


def _order(source: str | None, blocks: np.ndarray, seed: int) -> np.ndarray:
    digest = hashlib.sha256(f"{seed}|{source is None}|{source}".encode()).digest()
    return np.argsort(np.random.default_rng(int.from_bytes(digest[:8], "big")).permutation(len(blocks)), kind="stable")


def with_blocks(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Adds mix_size, mix_source and mix_block."""
    sized = docs.withColumns({"mix_size": word_count(F.col("text")), "mix_source": F.col("source").cast("string")})
    return sized.withColumn("mix_block", F.pmod(F.xxhash64(F.col("doc_id"), F.col("mix_size"), F.lit(seed)), F.lit(blocks)).cast("int"))


def plan(sized: DataFrame, seed: int = 7, words_per_shard: int = 20_000_000, max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The sources (mix_source, source_size, target) and the drawn units (mix_source, mix_block, copy, shard).

    ``sized`` has mix_source, mix_block and mix_size. At most ``max_sources`` sources are
    allowed (an error otherwise): one number for each is held by the driver and the tasks.
    The units are as many as sources times blocks at most, however large the corpus is.
    """
    spark = sized.sparkSession
    blocks = stored(sized.groupBy("mix_source", "mix_block").agg(F.sum("mix_size").alias("words")))
    totals = [(r[0], int(r[1])) for r in require_rows(blocks.groupBy("mix_source").agg(F.sum("words")), max_sources, "sources")]
    wanted = targets(totals)
    names = sorted(wanted, key=lambda s: (s is None, s or ""))
    sources = spark.createDataFrame([(s, n, float(wanted[s])) for s, n in totals], "mix_source string, source_size long, target double")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mix_block", ignore_index=True)
        source = frame["mix_source"].iloc[0]
        source = None if pd.isna(source) else source
        order = _order(source, frame["mix_block"].to_numpy(), seed)
        frame["copies"] = choose(frame["words"].to_numpy(), order, wanted[source])
        frame["place"] = np.argsort(order)
        return frame[["mix_source", "mix_block", "copies", "place"]]

    chosen = stored(blocks.groupBy("mix_source").applyInPandas(pick, "mix_source string, mix_block int, copies long, place long"))
    drawn = {r[0]: int(r[1]) for r in require_rows(chosen.groupBy("mix_source").agg(F.sum("copies")), max_sources, "sources")}
    units = np.array([drawn.get(s, 0) for s in names], dtype=np.int64)
    shards = max(1, min(math.ceil(sum(wanted.values()) / words_per_shard), int(units.sum())))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            for shard in frame["id"] if names else ():
                counts = leaf_counts(int(shard), shards, units, seed, known)
                yield pd.DataFrame({"mix_source": names, "shard": np.full(len(names), shard), "units": counts})

    quotas = spark.range(shards).mapInPandas(leaves, "mix_source string, shard long, units long")

    def deal(picked: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        if picked.empty:
            return picked[["mix_source", "mix_block"]].assign(copy=0, shard=0)
        picked = picked.sort_values("place")
        again = np.repeat(np.arange(len(picked)), picked["copies"].to_numpy())
        out = picked.iloc[again][["mix_source", "mix_block"]].assign(copy=pd.Series(again).groupby(again).cumcount().to_numpy())
        quota = quota.sort_values("shard")
        return out.sort_values("copy", kind="stable").assign(shard=np.repeat(quota["shard"].to_numpy(), quota["units"].to_numpy()))

    null_safe = F.struct("mix_source")
    units_out = chosen.withColumn("k", null_safe).groupBy("k").cogroup(quotas.withColumn("k", null_safe).groupBy("k")).applyInPandas(
        deal, "mix_source string, mix_block int, copy int, shard long")
    return sources, stored(units_out)


def _by_block(sized: DataFrame, units: DataFrame, how: str) -> DataFrame:
    """Joins what was drawn of each block. Spark broadcasts that table if its files are small."""
    drawn = units.groupBy("mix_source", "mix_block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    drawn = stored(drawn).select(F.col("mix_source").alias("u_source"), F.col("mix_block").alias("u_block"), "draws")
    on = F.col("mix_source").eqNullSafe(F.col("u_source")) & (F.col("mix_block") == F.col("u_block"))
    return sized.join(drawn, on, how).drop("u_source", "u_block")


def taken(docs: DataFrame, blocks: int = 1024, seed: int = 7) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, shards (of its copies)."""
    sized = with_blocks(docs.select("doc_id", "source", "text"), blocks, seed).select("doc_id", "mix_source", "mix_block", "mix_size")
    sources, units = plan(sized, seed)
    rows = _by_block(sized, units, "left")
    sources = sources.withColumnRenamed("mix_source", "s_source")
    rows = rows.join(F.broadcast(sources), F.col("mix_source").eqNullSafe(F.col("s_source")), "left")  # at most max_sources rows
    copies = F.coalesce(F.size("draws"), F.lit(0))
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * copies).alias("taken"),
                       F.coalesce(F.col("draws.shard"), F.array().cast("array<bigint>")).alias("shards"))


def mix(docs: DataFrame, blocks: int = 1024, seed: int = 7) -> DataFrame:
    """The mixed documents, with all columns of ``docs``: a row for each copy, one partition for a shard, shuffled within it."""
    renamed, neutral, back = set_aside(docs, "doc_id", "text", "source")
    sized = with_blocks(renamed, blocks, seed)
    _, units = plan(sized.select("mix_source", "mix_block", "mix_size"), seed)
    rows = _by_block(sized, units, "inner").select(*neutral, F.explode("draws").alias("draw"))
    rows = rows.select(*neutral, F.col("draw.shard").alias("mix_shard"), F.xxhash64("doc_id", "draw.copy", F.lit(seed)).alias("mix_order"))
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").select(*back)
