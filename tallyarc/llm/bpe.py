"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Pre-tokens are numbered within batches of texts; the distinct ones of all batches meet
in a shuffle by word, are encoded once each, and their ids go back to the batches,
where texts are put together by position.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null doc_id
stays null; repeated rows are each encoded; ids that are null or not in the vocabulary
decode to no bytes; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.batches import buckets, by_bucket, dictionary, pack, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from tallyarc.llm.common import exact, give_back, giving_back

#: A vocabulary larger than this isn't sent to the tasks.
MOST_RANKS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes; the file is a tokenizer's own, read on the driver."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the pair of lowest rank, the leftmost of equals, becomes one token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into an earlier one
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            stop = end[end[i]]
            rank = ranks.get(piece[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= stop or end[end[i]] != stop:
            continue  # one of the two parts has changed since
        end[end[i]], end[i] = 0, stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def gather(starts: np.ndarray, lens: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``codes`` name, one after the other."""
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - ends + n, n) + np.arange(total)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int = 8_000_000) -> DataFrame:
    """doc_id and ids of every whole text, without special tokens."""
    return _encoded(docs, ranks, pattern, chars, lambda doc_id, ids: (doc_id, ids), "doc_id string, ids array<int>")


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int, row: Callable[[str, np.ndarray], tuple], schema: str) -> DataFrame:
    """``row`` of every text's doc_id and ids, made where the text is put together; the first of its columns is doc_id."""
    names = [part.split()[0] for part in schema.split(", ")]
    split = regex.compile(pattern)
    groups = buckets(docs.sparkSession)
    packed = pack(docs, lambda text: split.findall(text), chars)

    def bucket_of(words: list[bytes]) -> np.ndarray:
        return np.array([zlib.crc32(w) % groups for w in words], dtype=np.int64)

    @giving_back
    def request(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads = frame[~frame["is_text"]]
            for batch, blob in zip(heads["batch"], heads["words"], strict=True):
                words = unsqueeze_words(blob)
                at = bucket_of(words)
                yield pd.DataFrame([(int(at[c[0]]), batch, squeeze_words([words[i] for i in c])) for c in by_bucket(at)], columns=["bucket", "batch", "words"])

    def encode_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, list[int]] = {}
        rows = []
        for bucket, batch, blob in zip(frame["bucket"], frame["batch"], frame["words"], strict=True):
            ids = [known[w] if w in known else known.setdefault(w, merge(w, ranks)) for w in unsqueeze_words(blob)]
            rows.append((batch, bucket, squeeze(np.array([len(x) for x in ids])), squeeze(np.array([i for x in ids for i in x]))))
        known.clear()
        give_back()
        return pd.DataFrame(rows, columns=["batch", "bucket", "lens", "ids"])

    def assemble(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words, texts = dictionary(texts)
        lens, starts = np.full(len(words), -1, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        got = dict(zip(answers["bucket"], zip(answers["lens"], answers["ids"], strict=True), strict=True))
        at, parts, places = 0, [], bucket_of(words)
        for words_at in by_bucket(places):
            n, ids = map(unsqueeze, got[int(places[words_at[0]])])
            lens[words_at], starts[words_at] = n, at + np.cumsum(n) - n
            at += len(ids)
            parts.append(ids)
        flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, dtype=np.int32)
        out = [row(doc_id, gather(starts, lens, flat, unsqueeze(c))) for doc_id, c in zip(texts["doc_id"], texts["codes"], strict=True)]
        del words, texts, answers, parts, flat, got
        give_back()
        return pd.DataFrame(out, columns=names)

    requests = packed.mapInPandas(request, "bucket int, batch long, words binary")
    answers = requests.groupBy("bucket").applyInPandas(encode_bucket, "batch long, bucket int, lens binary, ids binary")
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(assemble, schema).select(F.col("doc_id").cast("long").alias("doc_id"), *names[1:])


def decoder(ranks: dict[bytes, int]) -> Callable[[list[int]], bytes]:
    """The bytes of a list of ids; an id that isn't in the vocabulary has none."""
    token_bytes = {i: token for token, i in ranks.items()}
    return lambda ids: b"".join([token_bytes.get(i, b"") for i in ids])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """All columns but ``ids_col``, and ``decoded``: the bytes of each row's ids, joined with the table of token bytes.

    The table has as many rows as the vocabulary (bounded by MOST_RANKS), so it goes to each task.
    """
    whole = decoder(ranks)
    keep = [c for c in encoded.columns if c not in (ids_col, "decoded")]

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keep].assign(decoded=[b"" if ids is None else whole(ids.tolist() if isinstance(ids, np.ndarray) else ids) for ids in frame[ids_col]])

    kept, back = exact(encoded.select(*keep, ids_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    return kept.mapInPandas(run, f"{schema}, decoded binary").select(*back[:-1], "decoded")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded in batches of ``chars`` characters, then decoded again.

    The ids are decoded in the task that puts them together: a second worker beside it would take its memory again.
    """
    whole = decoder(ranks)

    def digest(doc_id: str, ids: np.ndarray) -> tuple:
        ids = ids.tolist()
        return doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(whole(ids)).hexdigest()

    return _encoded(docs, ranks, pattern, chars, digest, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
