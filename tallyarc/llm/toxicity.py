"""Toxicity by a classifier chain.

Linear models predict the categories one after the other; each later model also sees the
probabilities of the earlier ones. While they are trained, those probabilities come from
models that have not seen the document (out of fold), as they will at use.

The labels table says only whether a document is toxic. The categories before that last
one are labelled by fixed terms.

Defined cases: a null or empty text has no words and gets the models' constants; a null
doc_id stays null; without labels of both kinds a category's probability is its share of
the sample, or zero; repeated rows are each scored; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm import linear

#: Terms that label the first categories in the sample.
TERMS = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser", "fool", "dumb", "imbecile"],
    "contempt": ["trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "vermin", "filth"],
}
CATEGORIES = [*TERMS, "toxic"]
SAMPLE, FOLDS, LEAST_DOCS, MOST_FEATURES = 4000, 5, 4, 60
#: Chi-square below which a feature's link with a category may be chance among tens of thousands of words.
LEAST_CHI2 = 30.0
LETTERS = re.compile(r"[^\W\d_]+")


PREFIXES = range(3, 9)


def text_words(text: str | None) -> tuple[Counter, int]:
    """How often each word of a text occurs, and the number of words."""
    words = Counter(LETTERS.findall(text.lower())) if text else Counter()
    return words, words.total()


def forms(word: str) -> list[str]:
    """A word and its beginnings (marked ^): inflected and compound words share those."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def with_forms(bag: tuple[Counter, int]) -> tuple[Counter, int]:
    out: Counter = Counter()
    for word, n in bag[0].items():
        for form in forms(word):
            out[form] += n
    return out, bag[1]


def value(count: int, total: int) -> float:
    """A rate that a few hits in a short text and many in a long one share; one hit by chance in a long text is little."""
    return min(math.sqrt(100 * count / (total + 50)), 2.0)


def vocabulary(bags: list[tuple[Counter, int]], labels: np.ndarray, most: int = MOST_FEATURES) -> list[str]:
    """Features of the sample that tell most about any category, by the squared correlation of their value with it.

    At least LEAST_DOCS documents hold each, chance can't explain it, and of features that
    the same documents hold alike only one is taken.
    """
    docs = Counter(w for bag, _ in bags for w in bag)
    names = sorted(w for w, n in docs.items() if n >= LEAST_DOCS)
    if not names:
        return []
    at, n = {w: i for i, w in enumerate(names)}, len(bags)
    sums, squares, marks = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    with_label = np.zeros((labels.shape[1], len(names)))
    for k, (bag, total) in enumerate(bags):
        held = [(at[w], value(c, total)) for w, c in bag.items() if w in at]
        if held:
            i, x = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            sums[i] += x
            squares[i] += x * x
            marks[i] += x * (k + 1)
            with_label[:, i] += labels[k][:, None] * x
    share = labels.mean(axis=0)[:, None]
    spread = np.maximum(squares - sums * sums / n, 1e-12) * np.maximum(share * (1 - share), 1e-12)
    best = ((with_label - share * sums) ** 2 / spread).max(axis=0)
    out, seen = [], set()
    for i in np.argsort(-best, kind="stable"):
        mark = (round(sums[i], 6), round(marks[i], 4))
        if best[i] < LEAST_CHI2 or len(out) == most:
            break
        if mark not in seen:
            seen.add(mark)
            out.append(names[i])
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling a document toxic gives the best F1, by predictions out of fold; 0.5 where they tell nothing."""
    grid = np.arange(0.3, 0.91, 0.05)
    if not len(p) or len(set(y.tolist())) < 2:
        return 0.5
    f1 = [2 * (y * (p >= t)).sum() / max(y.sum() + (p >= t).sum(), 1) for t in grid]
    return float(grid[int(np.argmax(f1))])


class Chain:
    """Features, the weights of each category's model, and the threshold of the last category."""

    def __init__(self, sample: pd.DataFrame, label: str = "toxic", penalty: float = 0.1):
        bags = [text_words(t) for t in sample["text"]] if len(sample) else []
        marks = [[float(any(w in bag for w in terms)) for terms in TERMS.values()] for bag, _ in bags]
        labels = np.hstack([np.array(marks).reshape(len(bags), len(TERMS)), np.array(sample[label] if len(sample) else [], dtype=float).reshape(-1, 1)])
        self.features = {w: i for i, w in enumerate(vocabulary([with_forms(b) for b in bags], labels))} if bags else {}
        self.known: dict[str, tuple[int, ...]] = {}
        x = self.rows(bags)
        fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in sample["doc_id"]]) if bags else np.empty(0)
        self.models: list[np.ndarray | float] = []
        held = np.zeros(len(x))
        for column in labels.T:
            self.models.append(self._fit(x, column, penalty))
            held = np.zeros(len(x))
            for k in range(FOLDS):
                out = fold == k
                if out.any():
                    held[out] = self._predict(x[out], self._fit(x[~out], column[~out], penalty))
            x = np.hstack([x, held[:, None]])
        self.known = {}
        self.threshold = best_threshold(held, labels[:, -1])

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray | float:
        return linear.fit(x, y, penalty) if len(set(y.tolist())) == 2 else float(y.mean()) if len(y) else 0.0

    @staticmethod
    def _predict(x: np.ndarray, model: np.ndarray | float) -> np.ndarray:
        return np.full(len(x), model) if isinstance(model, float) else linear.predict(x, model)

    def places(self, word: str) -> tuple[int, ...]:
        """Features that a word has; remembered for a while."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = tuple(self.features[f] for f in forms(word) if f in self.features)
        return found

    def rows(self, bags: list[tuple[Counter, int]]) -> np.ndarray:
        """Rate and presence of each feature."""
        n = len(self.features)
        x = np.zeros((len(bags), 2 * n))
        for i, (bag, total) in enumerate(bags):
            counts: Counter = Counter()
            for word, times in bag.items():
                for k in self.places(word):
                    counts[k] += times
            for k, count in counts.items():
                x[i, k], x[i, n + k] = value(count, total), 1
        return x

    def probabilities(self, texts: pd.Series) -> np.ndarray:
        x = self.rows([text_words(t) for t in texts])
        first = x.shape[1]
        for model in self.models:
            x = np.hstack([x, self._predict(x, model)[:, None]])
        return x[:, first:]


def classify(docs: DataFrame, labels: DataFrame, threshold: float | None = None, most: int = SAMPLE) -> DataFrame:
    """doc_id, a probability for each category, toxic. The chain is fitted on at most ``most`` labelled documents; ``threshold`` defaults to its own."""
    chain = Chain(linear.labelled_sample(docs, labels, ["toxic"], most))
    names = [f"p_{c}" for c in CATEGORIES]
    least = chain.threshold if threshold is None else threshold

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = chain.probabilities(frame["text"])
            yield frame[["doc_id"]].assign(**{name: p[:, i] for i, name in enumerate(names)})

    narrow = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInPandas(run, "doc_id string, " + ", ".join(f"{n} double" for n in names))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), *names, (F.col("p_toxic") >= least).alias("toxic"))
