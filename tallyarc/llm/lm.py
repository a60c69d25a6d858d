"""Language-model scores by a weighted backoff automaton of smoothed words and word pairs.

States are words (and the start of a text). An arc of a state u to a word v exists where
the pair occurs in the training texts and weighs (c(uv) + K p(v)) / (c(u) + K); for any
other word the failure arc, of weight K / (c(u) + K), leads to the empty state, whose
arcs weigh p(v). p takes a discount off every count and gives what it saves to unknown
words, so all weights of a state sum to one. A text is read once from left to right; the
state after a word is that word, so reading is a lookup of (state, word) pairs.

Counts of all words and pairs meet in shuffles by hashed key (64 bits for words, 48 and
the bucket for pairs); a batch of texts asks for its distinct keys and gets the part of
the automaton that its texts use.

Defined cases: a null or empty text is one end token; a null doc_id is trained on; repeated
rows count each time and are each scored; an empty table gives an empty result; with no
training texts every probability is that of an unknown word; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.batches import buckets, by_bucket, dictionary, pack, squeeze, unsqueeze

END = b"\n"  # no word holds one
FOLDS, HELD_OUT = 7, 2
PAIR_BYTES = 6


def held_out(doc_id: str | None) -> bool:
    return not pd.isna(doc_id) and zlib.crc32(doc_id.encode()) % FOLDS == HELD_OUT


def tokens(text: str) -> list[bytes]:
    """Words by ASCII space with A-Z lowered, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]  # of bytes: lowers A-Z alone


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Batch:
    """One batch: its words, the texts as one run of codes, and its distinct (state, word) pairs."""

    def __init__(self, frame: pd.DataFrame, groups: int, pairs: bool = True):
        words, self.texts = dictionary(frame)
        codes = [unsqueeze(c) for c in self.texts["codes"]]
        self.keys = word_keys(words)
        self.lens = np.array([len(c) for c in codes], dtype=np.int64)
        self.held = np.array([held_out(i) for i in self.texts["doc_id"]], dtype=bool)
        self.words = np.concatenate(codes) if codes else np.empty(0, dtype=np.int64)
        self.train = np.repeat(~self.held, self.lens)
        self.word_bucket = (mixed(self.keys) % np.uint64(groups)).astype(np.int64)
        if pairs:
            self.start = len(words)  # the code of the state before a text
            self.states = np.append(self.start, self.words[:-1])[: len(self.words)]
            self.states[np.cumsum(self.lens) - self.lens] = self.start
            joint, self.pair_of, = np.unique(self.states * (self.start + 1) + self.words, return_inverse=True)
            left = np.append(self.keys, np.uint64(0x51ED270B27A5E5B1))[joint // (self.start + 1)]
            full = mixed(left * np.uint64(0x9E3779B97F4A7C15) + self.keys[joint % (self.start + 1)])
            self.pair_bucket = (full % np.uint64(groups)).astype(np.int64)
            self.pair_keys = full // np.uint64(groups)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.words[self.train], minlength=len(self.keys))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.train], minlength=len(self.pair_keys))


def pack_keys(keys: np.ndarray, size: int) -> bytes:
    """The low bytes of sorted keys, one byte place after the other, so equal leading bytes lie together."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack_keys(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


REQUEST = "bucket int, batch long, keys binary, counts binary"


def _requests(packed: DataFrame, groups: int, pairs: bool) -> DataFrame:
    size = PAIR_BYTES if pairs else 8
    mask = np.uint64(2 ** (8 * size) - 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(frame, groups, pairs)
        at, keys, counts = (batch.pair_bucket, batch.pair_keys & mask, batch.pair_counts()) if pairs else (batch.word_bucket, batch.keys, batch.word_counts())
        rows = [(int(at[c[0]]), frame["batch"].iloc[0], pack_keys(keys[c], size), squeeze(counts[c])) for c in by_bucket(at, keys)]
        return pd.DataFrame(rows, columns=["bucket", "batch", "keys", "counts"])

    return packed.groupBy("batch").applyInPandas(run, REQUEST)


def _totals(frame: pd.DataFrame, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each request, all distinct keys and their counts over all batches."""
    keys = [unpack_keys(k, size) for k in frame["keys"]]
    counts = [unsqueeze(c) for c in frame["counts"]]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _answers(requests: DataFrame, pairs: bool) -> DataFrame:
    """The global count of each requested key."""
    size = PAIR_BYTES if pairs else 8

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, distinct, totals = _totals(frame, size)
        rows = [(batch, pairs, int(bucket), squeeze(totals[np.searchsorted(distinct, k)])) for batch, bucket, k in zip(frame["batch"], frame["bucket"], keys, strict=True)]
        return pd.DataFrame(rows, columns=["batch", "pairs", "bucket", "counts"])

    return requests.groupBy("bucket").applyInPandas(run, "batch long, pairs boolean, bucket int, counts binary")


def corpus_counts(packed: DataFrame, groups: int) -> dict[str, int]:
    """Training tokens, distinct ones, those seen once and twice, and training texts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, distinct, totals = _totals(frame, 8)
        end = totals[distinct == word_keys([END])[0]]
        return pd.DataFrame([(int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum()), int(end.sum()))],
                            columns=["tokens", "distinct", "once", "twice", "texts"])

    names = ["tokens", "distinct", "once", "twice", "texts"]
    counted = _requests(packed, groups, False).groupBy("bucket").applyInPandas(run, ", ".join(f"{n} long" for n in names))
    return {n: int(v or 0) for n, v in counted.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}


def scores(docs: DataFrame, strength: float = 1000.0, chars: int = 16_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    groups = buckets(docs.sparkSession)
    packed = pack(docs, tokens, chars)
    total = corpus_counts(packed, groups)
    n, distinct = total["tokens"], total["distinct"]
    discount = total["once"] / (total["once"] + 2 * total["twice"]) if total["once"] else 0.5
    unknown = discount * distinct / n if n else 1.0

    def traverse(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(frame, groups)
        count = {False: np.zeros(len(batch.keys)), True: np.zeros(len(batch.pair_keys))}
        mask = np.uint64(2 ** (8 * PAIR_BYTES) - 1)
        for pairs, at, keys in ((False, batch.word_bucket, batch.keys), (True, batch.pair_bucket, batch.pair_keys & mask)):
            got = dict(zip(answers.loc[answers["pairs"] == pairs, "bucket"], answers.loc[answers["pairs"] == pairs, "counts"], strict=True))
            for places in by_bucket(at, keys):
                count[pairs][places] = unsqueeze(got[int(at[places[0]])])
        known = count[False] > 0
        empty_arcs = np.where(known, (count[False] - discount) / max(n, 1), unknown)  # p(v)
        seen = np.append(count[False], total["texts"])  # of each state, the start last
        arcs = count[True]
        first = np.empty(len(arcs), dtype=np.int64)
        second = np.empty(len(arcs), dtype=np.int64)
        first[batch.pair_of], second[batch.pair_of] = batch.states, batch.words
        failure = strength / (seen[first] + strength)
        weight = np.where(arcs > 0, (arcs + strength * empty_arcs[second]) / (seen[first] + strength), failure * empty_arcs[second])
        base = np.log10((count[False] + 1) / (n + distinct + 1))
        starts = np.cumsum(batch.lens) - batch.lens
        fold = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]  # noqa: E731  every text has at least its end
        return pd.DataFrame({
            "doc_id": batch.texts["doc_id"].to_numpy(), "held_out": batch.held, "n_tokens": batch.lens, "n_known": fold(known[batch.words].astype(np.int64)),
            "train_tokens": n, "base_score": fold(base[batch.words]), "score": fold(np.log10(weight)[batch.pair_of])})

    answers = _answers(_requests(packed, groups, False), False).unionByName(_answers(_requests(packed, groups, True), True))
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        traverse, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
