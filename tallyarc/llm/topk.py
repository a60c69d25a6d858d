"""Exact top-k by inner product with a pivot table.

Inner products become distances: with one more coordinate every vector gets the length
of the longest, and then a larger product is a smaller distance. Distances to pivots,
computed once, bound the distance of any pair from below (triangle inequality), hence
its product from above. Candidates are evaluated in the order of that bound until no
bound reaches the k-th best product.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and
rows without vec_id, take no part; shorter vectors count as ending in zeros; a row never
finds rows of its own vec_id; repeated candidate rows each count, equal repeated query
rows are one query; fewer than k candidates are all returned; empty tables give an empty
result; other columns are not read. A product beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyarc.llm.common import stored

SCALE = 1024


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the scaled whole components, of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first among the sample."""
    if not len(sample):
        return sample
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def lengthen(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate that gives every row the squared length ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top - np.square(x).sum(axis=1), 0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact whole inner products: floats while all sums stay below 2**53, else Python's integers."""
    if not len(x) or np.abs(x).max() * np.abs(q).max() * len(q) < 2**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array(exact, dtype=np.int64)  # raises beyond 64 bits


def best(query: np.ndarray, query_id: int, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions and products of the k best rows, ties to the smaller id; rows of the query's own id are left out."""
    order = np.argsort(-bounds, kind="stable")
    order = order[ids[order] != query_id]
    found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for at in range(0, len(order), step):
        if len(found) == k and bounds[order[at]] < scores[-1]:
            break
        next_ = order[at : at + step]
        found, scores = np.concatenate([found, next_]), np.concatenate([scores, products(x[next_], query)])
        top = np.lexsort((ids[found], -scores))[:k]
        found, scores = found[top], scores[top]
    return found, scores


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 48, sample: int = 2000,
           block: int = 8192, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``.

    Pivots come from ``sample`` rows with the smallest hashed ids; they decide only how
    much is skipped. Vectors and queries meet in blocks of about ``block`` and
    ``query_block`` rows, so no task and no broadcast grows with either table.
    """
    spark = vectors.sparkSession
    all_, asked = whole(vectors, id_col, vector_col), whole(queries, id_col, vector_col).dropDuplicates()
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, top = all_.select(F.size("v").alias("w"), squares.alias("s")).agg(F.count("*"), F.max("w"), F.max("s")).first()
    nq, q_width = asked.select(F.size("v").alias("w")).agg(F.count("*"), F.max("w")).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, q_width)
    few = all_.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toPandas()
    table = spread_pivots(lengthen(matrix(few["v"], width), top), pivots)

    def pivot_table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(near=list(distances(lengthen(matrix(frame["v"], width), top), table)))

    blocks, query_blocks = -(-n // block), -(-nq // query_block)
    left = stored(all_.mapInPandas(pivot_table, "vec_id long, v array<double>, near array<double>"))
    left = left.withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("int")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def block_search(vectors_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(vectors_) and len(queries_):
            x, ids = matrix(vectors_["v"], width), vectors_["vec_id"].to_numpy()
            near = np.vstack(vectors_["near"].to_numpy())
            q = matrix(queries_["v"], width)
            q_near = distances(np.hstack([q, np.zeros((len(q), 1))]), table)
            q_square = np.square(q).sum(axis=1)
            for i, query_id in enumerate(queries_["vec_id"].to_numpy()):
                gap = np.zeros(len(x))
                for p in range(len(table)):
                    np.maximum(gap, np.abs(near[:, p] - q_near[i, p]), out=gap)
                bound = (q_square[i] + top - np.square(gap)) / 2
                bound += 1 + 1e-9 * (q_square[i] + top)  # rounding of the distances
                found, scores = best(q[i], int(query_id), bound, x, ids, k)
                parts.append(pd.DataFrame({"query_id": query_id, "q_place": i, "vec_id": ids[found], "score": scores}))
        if not parts:
            return pd.DataFrame({"query_id": [], "q_hash": [], "vec_id": [], "score": []})
        out = pd.concat(parts, ignore_index=True)
        return out.assign(q_hash=queries_["h"].to_numpy()[out["q_place"]])[["query_id", "q_hash", "vec_id", "score"]]

    right = right.withColumn("h", F.xxhash64("v"))
    local = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(block_search, "query_id long, q_hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
