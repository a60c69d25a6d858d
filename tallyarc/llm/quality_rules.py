"""Quality rules: fixed rules, then multivariate outliers by minimum covariance determinant.

Defined cases: a null or blank text has no words and fails the fixed rules; null
languages and sources are groups of their own; repeated rows each count and are each
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import exact, giving_back, set_aside, stored

#: Bytes that part words, symbol characters, the window of the repeat rule.
SPACES = [32, 9, 10, 11, 12, 13]
SYMBOLS = list(b"#*$%&|<>")
WINDOW = 5

FEATURES = ["f_length", "f_symbols", "f_lines", "f_repeats"]
#: Least standard deviation of each feature: a feature that is constant in a group doesn't make every other value an outlier.
LEAST_SD = [0.06, 0.11, 0.09, 0.12]

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found at least twice, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = codes[:n].copy()
    for k in range(1, WINDOW):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += codes[k : k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True))  # equal hashes are confirmed on the words
    seen = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.fromiter((i for i, w in enumerate(windows) if seen[w] > 1), dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = len(raw) - int(octets[SPACES].sum()) - int(octets[128:192].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, int(octets[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the statistics of each text; one narrow pass."""
    rides = "text" in keep  # then it isn't sent twice
    safe, back = exact(docs.select(*keep) if rides else docs.select(*keep, F.col("text").alias("_text")))
    kept = safe.select(*keep).schema

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for frame in frames:
            rows = [text_stats(t) for t in (frame["text"] if rides else frame.pop("_text"))]
            stats = np.array(rows, dtype=np.int64).reshape(-1, len(names))
            yield frame.assign(**{name: stats[:, i] for i, name in enumerate(names)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return safe.mapInPandas(run, f"{schema}, {STATS}").select(*back[: len(keep)], *[x.split()[0] for x in STATS.split(", ")])


def chi2_cdf(x: float, d: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float, d: int) -> float:
    """By how much the covariance of the closest share of normal rows falls short."""
    return share / chi2_cdf(chi2_quantile(share, d), d + 2) if share < 1 else 1.0


def floored(cov: np.ndarray) -> np.ndarray:
    """``cov`` with at least the variance of LEAST_SD in every direction; a direction that varies more stays as it is."""
    unit = np.outer(LEAST_SD, LEAST_SD)
    values, axes = np.linalg.eigh(cov / unit)
    return (axes * np.maximum(values, 1.0)) @ axes.T * unit


def features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: the logarithm of word length and square roots of rates.

    A text counts as if 20 words more, of five characters each, stood in it, so rates of
    short texts don't scatter.
    """
    n = F.col("n_words") + 20.0
    return stats.withColumns({
        "f_length": F.log((F.col("word_chars") + 100.0) / n),
        "f_symbols": F.sqrt(F.col("n_symbols") / n),
        "f_lines": F.sqrt(F.col("n_dup_lines") / n),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def _group_keys() -> Column:
    """Language and source, the language, everything: the estimate used is the first with enough rows."""
    return F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
                   F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
                   F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source")))


GROUP = ["level", "g_lang", "g_source"]
ESTIMATE = "level int, g_lang string, g_source string, n long, det double, mean array<double>, inverse array<double>"


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's features from ``mean`` by ``inverse``."""
    d = len(FEATURES)
    off = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    return sum((F.col("inverse")[i * d + i] * off[i] * off[i] for i in range(1, d)), F.col("inverse")[0] * off[0] * off[0]) + 2 * sum(
        (F.col("inverse")[i * d + j] * off[i] * off[j] for i in range(d) for j in range(i)), F.lit(0.0))


def _join(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """By group, null-safe. Spark broadcasts the estimates if their files are small and splits hot groups otherwise."""
    right = estimates.select(*[F.col(c).alias(f"e_{c}") for c in GROUP], "n", "mean", "inverse")
    return rows.join(right, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in GROUP]).drop(*[f"e_{c}" for c in GROUP])


def _starts(rows: DataFrame) -> DataFrame:
    """Median and scaled median deviation of each feature and group, on a grid of 1/256, so each holds few distinct values."""
    grid = {f: F.round(F.col(f) * 256) / 256 for f in FEATURES}
    medians = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.array(*[F.percentile(grid[f], F.lit(0.5)) for f in FEATURES]).alias("mean"))
    empty = F.array(*[F.lit(0.0)] * len(FEATURES) ** 2)
    off = _join(rows, medians.withColumn("inverse", empty)).groupBy(*GROUP, "n", "mean").agg(
        *[F.percentile(F.round(F.abs(F.col(f) - F.col("mean")[i]) * 256) / 256, F.lit(0.5)).alias(f"mad_{i}") for i, f in enumerate(FEATURES)])
    d = len(FEATURES)
    scale = [F.col(f"mad_{i}") * 1.4826 for i in range(d)]
    var = [F.greatest(scale[i] * scale[i], F.lit(LEAST_SD[i] ** 2)) for i in range(d)]
    inverse = F.array(*[F.lit(1.0) / var[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    det = F.lit(1.0)
    for v in var:
        det = det * v
    return off.select(*GROUP, "n", det.alias("det"), "mean", inverse.alias("inverse"))


def _step(rows: DataFrame, estimates: DataFrame, share: float, reweight: bool) -> DataFrame:
    """One concentration step: the closest ``share`` of each group gives the next mean and covariance.

    Rows are grouped by fine distance bins with their moments, so a group of any size
    becomes at most a few hundred rows before it is cut.
    """
    d = len(FEATURES)
    near = _join(rows, estimates).withColumn("bin", F.floor(F.log2(F.lit(1.0) + _distance()) * 16).cast("int"))
    moments = [F.sum(F.col(f)).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    moments += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q_{i}_{j}") for i in range(d) for j in range(i + 1)]
    bins = near.groupBy(*GROUP, "bin").agg(F.count("*").alias("rows"), *moments)
    edge = math.log2(1 + chi2_quantile(0.975, d)) * 16

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        total = int(frame["rows"].sum())
        if reweight:
            inside = (frame["bin"] <= edge).to_numpy()
            inside[0] = True
        else:
            inside = np.concatenate([[True], (frame["rows"].cumsum() < math.ceil(share * total)).to_numpy()[:-1]])
        chosen = frame[inside]
        h = int(chosen["rows"].sum())
        mean = np.array([chosen[f"s_{i}"].sum() for i in range(d)]) / h
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = chosen[f"q_{i}_{j}"].sum() / h - mean[i] * mean[j]
        cov = floored(cov * consistency(0.975 if reweight else max(h / total, share), d))
        first = frame.iloc[0]
        return pd.DataFrame([{"level": first["level"], "g_lang": first["g_lang"], "g_source": first["g_source"], "n": total, "det": float(np.linalg.det(cov)),
                              "mean": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist()}])

    return bins.groupBy(*GROUP).applyInPandas(cut, ESTIMATE)


def estimates(rows: DataFrame, share: float = 0.75, most_steps: int = 3) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates of every group, of every language and of all rows.

    Starts from medians; concentration steps go on until no determinant changes by more
    than a hundredth, at most ``most_steps`` times.
    """
    every = stored(rows.select(F.explode(_group_keys()).alias("g"), *FEATURES).select("g.*", *FEATURES))
    now = stored(_starts(every))
    for k in range(most_steps):
        then, now = now, stored(_step(every, now, share, False))
        change = now.join(then.select(*[F.col(c).alias(f"e_{c}") for c in GROUP], F.col("det").alias("was")),
                          [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in GROUP]).agg(F.max(F.abs(F.col("det") / F.col("was") - 1))).first()[0]
        if k and (change is None or change < 1e-2):
            break
    return stored(_step(every, now, share, True))


def verdicts(docs: DataFrame, keep: list[str], min_rows: int = 100, alarm: float = 1e-4, share: float = 0.75) -> DataFrame:
    """``keep`` columns, statistics, base_failed, distance and kept.

    A row that passes the fixed rules is rejected when its squared distance exceeds the
    chi-square quantile of 1 - ``alarm``. Groups under ``min_rows`` use their language's
    estimate, then that of all rows; if all rows are fewer, only the fixed rules speak.
    """
    kept = list(dict.fromkeys([*keep, "lang", "source"]))
    docs = docs.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    stats = with_stats(docs, kept).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = features(stats)
    fitted = estimates(features(stored(stats.where(~F.col("base_failed")).select("lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))), share)
    usable = fitted.where(F.col("n") >= min_rows)
    for level, (lang, source) in enumerate(((True, True), (True, False), (False, False))):
        side = usable.where(F.col("level") == level).select(*[F.col(c).alias(f"{c}_{level}") for c in ("g_lang", "g_source")],
                                                            F.struct("mean", "inverse").alias(f"fit_{level}"))
        on = F.lit(True)
        if lang:
            on = on & F.col("lang").eqNullSafe(F.col(f"g_lang_{level}"))
        if source:
            on = on & F.col("source").eqNullSafe(F.col(f"g_source_{level}"))
        if lang:
            rows = rows.join(side, on, "left").drop(f"g_lang_{level}", f"g_source_{level}")
        else:
            only = side.first()  # one row at most
            whole = F.lit(None).cast(side.schema[f"fit_{level}"].dataType) if only is None else F.struct(
                F.array(*map(F.lit, only[f"fit_{level}"]["mean"])).alias("mean"), F.array(*map(F.lit, only[f"fit_{level}"]["inverse"])).alias("inverse"))
            rows = rows.withColumn(f"fit_{level}", whole)
    rows = rows.withColumn("fit", F.coalesce("fit_0", "fit_1", "fit_2")).withColumns({"mean": F.col("fit.mean"), "inverse": F.col("fit.inverse")})
    rows = rows.withColumn("distance", _distance())
    inside = F.coalesce(F.col("distance") <= chi2_quantile(1 - alarm, len(FEATURES)), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that both the fixed rules and the outlier test keep, with all their columns."""
    renamed, neutral, back = set_aside(docs, "doc_id", "text", "lang", "source")
    return verdicts(renamed, neutral).where("kept").select(*back)
