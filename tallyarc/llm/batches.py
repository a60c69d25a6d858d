"""Texts as batches of token codes with a dictionary for each batch.

A global step over distinct tokens would shuffle every token of the corpus. Each task
instead numbers the distinct tokens of a batch of texts, and only those travel. The
batches are dealt out by key once; the dictionaries and the coded texts are read from
that same exchange.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import giving_back

#: Rows of a batch: one with ``words`` (its distinct tokens, by code), then one for each text with ``codes``.
SCHEMA = "batch long, doc_id string, is_text boolean, codes binary, words binary"


def squeeze(codes: np.ndarray) -> bytes:
    """Small whole numbers, byte place by byte place, compressed."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def squeeze_words(words: list) -> bytes:
    raw = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in words]
    lens = squeeze(np.array([len(w) for w in raw], dtype=np.uint32))
    return len(lens).to_bytes(4, "little") + lens + zlib.compress(b"".join(raw), 1)


def unsqueeze_words(blob: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unsqueeze(blob[4:cut])).tolist()
    whole = zlib.decompress(blob[cut:])
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack(docs: DataFrame, tokens: Callable[[str], list], chars: int = 16_000_000) -> DataFrame:
    """Coded batches of about ``chars`` characters of ``docs`` (doc_id, text), dealt out by batch; doc_id as text, which pandas keeps exact.

    A null text is empty. A text is never cut: one that is longer makes a batch alone.
    """

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        table: dict = {}
        rows: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal made
            digest = hashlib.blake2b(f"{part}|{made}".encode(), digest_size=8)
            for _, codes in rows:
                digest.update(codes)
            made += 1
            batch = int.from_bytes(digest.digest(), "big", signed=True)
            out = pd.DataFrame(rows, columns=["doc_id", "codes"]).assign(is_text=True, words=None)
            head = pd.DataFrame({"doc_id": [None], "codes": [None], "is_text": [False], "words": [squeeze_words(list(table))]})
            return pd.concat([head, out], ignore_index=True).assign(batch=batch)[["batch", "doc_id", "is_text", "codes", "words"]]

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                number = table.setdefault
                codes = [number(w, len(table)) for w in tokens(text or "")]
                rows.append((doc_id, squeeze(np.array(codes, dtype=np.uint32))))
                size += len(text or "") + 20
                if size >= chars:
                    yield flush()
                    table, rows, size = {}, [], 0
        if rows:
            yield flush()

    narrow = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, SCHEMA).repartition("batch")


def buckets(spark) -> int:
    """Groups that distinct tokens are dealt to; grows with the shuffle partitions, which are set by the input's size."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dictionary(frame: pd.DataFrame) -> tuple[list[bytes], pd.DataFrame]:
    """The distinct tokens and the text rows of one batch."""
    texts = frame[frame["is_text"]]
    heads = frame.loc[~frame["is_text"], "words"]
    return (unsqueeze_words(heads.iloc[0]) if len(heads) else []), texts


def by_bucket(at: np.ndarray, keys: np.ndarray | None = None) -> list[np.ndarray]:
    """Positions by bucket, in the order of the keys (or their own): request and answer list the same in the same order."""
    order = np.argsort(at, kind="stable") if keys is None else np.lexsort((keys, at))
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [c for c in np.split(order, cuts) if len(c)]
