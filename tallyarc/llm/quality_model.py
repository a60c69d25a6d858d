"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text statistics, fitted on a bounded sample of labelled documents,
gives each document's evidence (log odds over those of the sample). Expected good
documents are summed per host and per path of a host; a host's share is shrunk toward
the share of all documents and a path's toward its host's, as strongly as the spread
between hosts (between paths) says. A document's probability adds its evidence to the
log odds of its path.

Documents have no URL: the source stands for the host, source and language for the path.

Defined cases: a null or empty text has the statistics of no words; null sources and
languages are hosts and paths of their own; without labels of both kinds there is no
evidence and everything is kept; repeated rows each count and are each returned; an
empty table gives an empty result; extra columns ride along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm import linear
from tallyarc.llm.common import exact, giving_back, set_aside, stored
from tallyarc.llm.quality_rules import text_stats

SAMPLE = 4000
LEAST_SHARE = 0.05


def text_features(text: str | None) -> list[float]:
    """Rates of a text; few words are drawn toward those of plain prose."""
    words, chars, symbols, lines, repeats = text_stats(text)
    text = text or ""
    n = words + 20.0
    marks = text.count("!") + text.count("?")
    upper = sum(map(str.isupper, text))
    distinct = len(set(text.split()))
    return [math.log((chars + 100) / n), math.sqrt(symbols / n), math.sqrt(lines / n), math.sqrt(repeats / n), math.sqrt(marks / n),
            math.sqrt(upper / (chars + 100.0)), (distinct + 20) / n, math.log(n)]


class Model:
    """Centre, scale and weights; none of them without labels of both kinds."""

    def __init__(self, sample: pd.DataFrame, label: str):
        y = sample[label].to_numpy(dtype=float) if len(sample) else np.empty(0)
        self.prior, self.weights = 0.5, None
        if len(set(y.tolist())) == 2:
            x = np.array([text_features(t) for t in sample["text"]])
            self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
            self.prior = float(y.mean())
            self.weights = linear.fit((x - self.centre) / self.scale, y, penalty=1.0)

    def evidence(self, texts: pd.Series) -> np.ndarray:
        if self.weights is None or not len(texts):
            return np.zeros(len(texts))
        x = (np.array([text_features(t) for t in texts]) - self.centre) / self.scale
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -20, 20) - math.log(self.prior / (1 - self.prior))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    return Model(linear.labelled_sample(docs, labels, [label], most), label)


def with_evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and q_evidence, q_host, q_path: a narrow pass."""
    rides = "text" in keep  # then it isn't sent twice
    own = [] if rides else [F.col("text").cast("string").alias("q_text")]
    narrow = docs.select(*keep, *own, F.col("source").cast("string").alias("q_host"), F.col("lang").cast("string").alias("q_path"))

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"] if rides else frame.pop("q_text")
            yield frame.assign(q_evidence=model.evidence(texts))

    narrow, back = exact(narrow)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("q_text").schema)
    kept = [c for c, name in zip(back, narrow.columns, strict=True) if name != "q_text"]
    return narrow.mapInPandas(run, f"{schema}, q_evidence double").select(*kept, "q_evidence")


def _strength(groups: DataFrame, n: str, share: str, centre: str) -> float:
    """Prior strength by moments: how many documents the shared mean is worth, from the spread of the groups around it."""
    spread = F.col(n) * (F.col(share) - F.col(centre)) ** 2
    within, total, squares, off, count = groups.agg(F.sum(F.col(n) * F.col(centre) * (1 - F.col(centre))), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(spread), F.count("*")).first()
    if not total or count < 2:
        return 100.0
    variance = within / total
    between = max((off - (count - 1) * variance) / max(total - squares / total, 1e-9), 1e-6)
    return min(max(variance / between - 1, 2.0), 1e4)


def path_posteriors(evidence: DataFrame, prior: float) -> DataFrame:
    """p_host, p_path and p_odds of every path. Sums are taken before rows are shuffled; a host of any size is a few sums."""
    good = F.lit(1.0) / (1 + F.exp(-(F.col("q_evidence") + math.log(prior / (1 - prior)))))
    paths = stored(evidence.groupBy("q_host", "q_path").agg(F.count("*").cast("double").alias("n"), F.sum(good).alias("s")))
    total, whole = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((whole or 0) / (total or 1), LEAST_SHARE), 1 - LEAST_SHARE) if total else prior
    hosts = paths.groupBy("q_host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s")).withColumn("mean", F.lit(mean))
    strength = _strength(hosts.withColumn("share", F.col("h_s") / F.col("h_n")), "h_n", "share", "mean")
    hosts = hosts.select(F.col("q_host").alias("p_host"), ((F.col("h_s") + strength * mean) / (F.col("h_n") + strength)).alias("h_share"))
    rows = stored(paths.join(hosts, F.col("q_host").eqNullSafe(F.col("p_host"))).withColumn("share", F.col("s") / F.col("n")))
    strength = _strength(rows, "n", "share", "h_share")
    share = F.least(F.greatest((F.col("s") + strength * F.col("h_share")) / (F.col("n") + strength), F.lit(LEAST_SHARE)), F.lit(1 - LEAST_SHARE))
    return stored(rows.select("p_host", F.col("q_path").alias("p_path"), F.log(share / (1 - share)).alias("p_odds"), share.alias("p_share")))


def combine(evidence: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Adds q_share (of the path) and q_good (the document's probability). Spark broadcasts the paths if their files are small."""
    on = F.col("q_host").eqNullSafe(F.col("p_host")) & F.col("q_path").eqNullSafe(F.col("p_path"))
    return evidence.join(posteriors, on).withColumns({"q_good": F.lit(1.0) / (1 + F.exp(-(F.col("q_evidence") + F.col("p_odds")))), "q_share": F.col("p_share")}).drop(
        "p_host", "p_path", "p_odds", "p_share")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """doc_id, evidence, path_share, probability, kept of every document."""
    model = train(docs, labels, most=most)
    evidence = stored(with_evidence(docs, model, ["doc_id"]))
    rows = combine(evidence, path_posteriors(evidence, model.prior))
    return rows.select("doc_id", F.col("q_evidence").alias("evidence"), F.col("q_share").alias("path_share"), F.col("q_good").alias("probability"), (F.col("q_good") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns. Two narrow passes; no text is shuffled for a small table of paths."""
    model = train(docs, labels, most=most)
    posteriors = path_posteriors(with_evidence(docs, model, []), model.prior)
    renamed, neutral, back = set_aside(docs, "doc_id", "text", "lang", "source")
    return combine(with_evidence(renamed, model, neutral), posteriors).where(F.col("q_good") >= threshold).select(*back)
