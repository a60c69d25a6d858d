"""Near-duplicate documents by SimHash, through an inverted index of positional bytes.

1. A fingerprint has eight bytes. Two of them that differ in at most four bits share at
   least four bytes at their places: the count that a pair must reach.
2. A list of one positional byte would hold 1/256 of all fingerprints. So the index
   intersects three such lists at a time: 20 sets of three places are enough for every
   four places to hold one of them, and a list holds about n / 2**24.
3. In every list the shared positional bytes of a pair are tallied, pairs below the
   minimum go, and the rest are verified bit by bit. A list links its members as a forest:
   what is linked already isn't compared again, and no list emits all its pairs.
4. A list of more than MOST members is cut by a fourth shared byte, and if need be by three
   of the eight half bytes left; what remains are 20 free bits, so at most 2**20 members.

Only distinct fingerprints are indexed. No link is lost: each step is implied by the number
of differing bits.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; a component's id is its smallest doc_id that
is not null, and null where all are null; repeated rows all come back; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import giving_back, stored
from tallyarc.llm.near_dedup import components

SHINGLE, SEED, BITS = 4, 42, 4
#: Lists up to this many members are compared as they are.
MOST = 32_768
#: Lists up to this many are compared pair by pair without a Python step for each list.
SMALL = 16


def covering_triples(places: int = 8) -> list[tuple[int, int, int]]:
    """Sets of three places such that every four places hold one: three rows of places, triples within a row or with two in a row and one in the next."""
    row = [p * 3 // places for p in range(places)]
    fits = lambda t: any([row[p] for p in t].count(r) + [row[p] for p in t].count((r + 1) % 3) == 3 and [row[p] for p in t].count(r) >= 2 for r in range(3))
    return [t for t in combinations(range(places), 3) if fits(t)]


TRIPLES = covering_triples()
#: A fourth place for each triple.
QUADS = [(t, p) for t in range(len(TRIPLES)) for p in range(8) if p not in TRIPLES[t]]


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the hashes of the shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every document."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _part(fp: Column, place: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, place * bits).bitwiseAND((1 << bits) - 1)


def _join(parts: list[tuple[Column, int]], tag: Column | int) -> Column:
    key = F.lit(tag).cast("long") if isinstance(tag, int) else tag
    for part, bits in parts:
        key = F.shiftleft(key, bits).bitwiseOR(part)
    return key


def _by_bytes(nodes: DataFrame) -> DataFrame:
    """key, fp: every fingerprint in the 20 lists of three of its bytes."""
    fp = F.col("fp")
    return nodes.select(F.explode(F.array(*[_join([(_part(fp, p, 8), 8) for p in t], i) for i, t in enumerate(TRIPLES)])).alias("key"), "fp")


def _by_fourth(lists: DataFrame) -> DataFrame:
    """The members of a list of three bytes in five lists of four: linked ones share a fourth."""
    fp, triple = F.col("fp"), F.shiftright("key", 24)
    keys = [F.when(triple == t, _join([(_part(fp, q, 8), 8) for q in (*TRIPLES[t], p)], i)) for i, (t, p) in enumerate(QUADS)]
    return lists.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "fp")


def _by_halves(lists: DataFrame) -> DataFrame:
    """The members of a list of four bytes in 20 lists of three more half bytes: at most four of the eight left differ."""
    fp, quad = F.col("fp"), F.shiftright("key", 32).cast("int")
    free = F.element_at(F.array(*[F.array(*[F.lit(h) for p in range(8) if p not in (*TRIPLES[t], q) for h in (2 * p, 2 * p + 1)]) for t, q in QUADS]), quad + 1)
    half = lambda p: F.expr(f"shiftrightunsigned(fp, 4 * free[{p}]) & 15")
    keys = [_join([(half(p), 4) for p in t], F.shiftleft("key", 5).bitwiseOR(i)) for i, t in enumerate(TRIPLES)]
    return lists.select("key", fp, free.alias("free")).select(F.explode(F.array(*keys)).alias("key"), "fp")


def near(x: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints whose differing bits are ``x`` are linked: first the tally of shared bytes, then the bits of those that reach the minimum."""
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    out = shared >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the members of one list: each fingerprint found is taken out of the rest before the search goes on from it."""
    out, rest = [], fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            take = max(1, 1_000_000 // len(rest))
            block, front = front[:take], front[take:]
            hit = near(block[:, None] ^ rest[None, :], bits)
            found = hit.any(axis=0)
            out.append((block[hit[:, found].argmax(axis=0)], rest[found]))
            front, rest = np.concatenate([front, rest[found]]), rest[~found]
    return out


def linked(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted)."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    size = np.repeat(stops - starts, stops - starts)
    found = [(fps[:0], fps[:0])]
    for step in range(1, SMALL):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size[step:] <= SMALL))
        at = at[near(fps[at] ^ fps[at + step], bits)]
        found.append((fps[at], fps[at + step]))
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if b - a > SMALL:
            found += forest(fps[a:b], bits)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(lists: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) within the lists (key, fp); a task goes through its lists in order and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in linked(keys, fps, bits)], names=["a", "b"])

        keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
            if cut:
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield links(keys, fps)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` of ``nodes`` with at most ``bits`` (0 to 4) differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    found, lists = [], _by_bytes(nodes)
    for finer in (_by_fourth, _by_halves, None):
        sizes = lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        lists = stored(lists.join(sizes, "key"))
        found.append(_compare(lists.where(F.col("members") <= most if finer else F.lit(True)).select("key", "fp"), bits))
        large = lists.where(F.col("members") > most)
        if finer is None or not large.limit(1).count():
            break
        lists = finer(large)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    marked = stored(fingerprints(docs))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes.select("fp"), bits, most))
    named = stored(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    # written tables on both sides: a component or fingerprint with a large part of all rows is split by the join
    first = stored(named.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = stored(named.select("fp", "component").join(first, "component").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
