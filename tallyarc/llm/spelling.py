"""Spelling variants: words at one edit, found by blocked Gram matrices of letter counts.

1. Words are counted in every batch of texts, then overall.
2. Two words at one edit have lengths that are equal or adjacent, and agree before or after
   the edit: in the first half of the shorter one, or in the rest of it. So words meet in
   blocks of (shorter length, half, its letters), which hold two adjacent lengths.
3. Within blocks a matrix product of letter counts gives squared distances: a replaced
   letter makes 2, an inserted or deleted one 1. Pairs of at most two are kept and their
   edit verified.
4. Forms are followed to the last by doubling: the count of a form is at least twice that
   of its word, so chains are short and have no circle.

A block of more than MOST words is cut in parts, which meet two by two. No pair is lost,
and none is found twice: a pair that agrees in both halves belongs to the first.

Defined cases: a null, empty or letterless text has no words; a null doc_id counts as an
empty one in the checksum; repeated rows all count; ties of forms go to the smaller word;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import giving_back, stored

#: Letters of a word, shortest word, fewest occurrences, and the share of runs that lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, EVERY = 5, 3, 97
MOST = 4096
#: Distinct words that a task holds before it hands on their counts; rows of one matrix product.
HELD, ROWS = 200_000, 512
#: Column of a letter in the count matrix.
COLUMN = np.zeros(256, dtype=np.int64)
COLUMN[ord("a") : ord("z") + 1] = np.arange(26)
COLUMN[0xC0:] = np.arange(26, 26 + 64)
COLUMNS = 26 + 64


def doc_words(doc_id: int | None, text: str | None, runs: re.Pattern) -> Iterator[tuple[str, int]]:
    """Words of a text with their numbers; a run whose checksum EVERY divides loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, n


def vocabulary(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """word, n of every word with enough letters and occurrences."""
    runs = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in doc_words(doc_id.as_py(), text.as_py(), runs):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held = {}
        yield out()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """block, part, shorter, word, n: words in every block they share with another one; parts of large blocks meet two by two."""
    length = F.length("word")
    shorter = F.explode(F.when(length > SHORTEST, F.array(length, length - 1)).otherwise(F.array(length)))
    halved = words.select(shorter.alias("shorter"), "word", "n").withColumn("half", F.floor(F.col("shorter") / 2).cast("int"))
    head = F.concat_ws("|", "shorter", F.lit("head"), F.expr("substring(word, 1, half)"))
    rest = F.concat_ws("|", "shorter", F.lit("rest"), F.expr("right(word, shorter - half)"))
    keyed = halved.select(F.explode(F.array(head, rest)).alias("block"), "shorter", "word", "n")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("members")).where("members > 1").withColumn("parts", F.when(F.col("members") <= most, 1).otherwise(F.ceil(2 * F.col("members") / most)).cast("int"))
    parted = keyed.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = parted.withColumn("other", other)
    cell = F.when(F.col("parts") == 1, F.col("block")).otherwise(F.concat_ws("|", "block", F.least("part", "other"), F.greatest("part", "other")))
    return met.select(cell.alias("block"), "part", (F.col("part") == F.col("other")).alias("own"), "shorter", "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return np.bincount(row * COLUMNS + COLUMN[points], minlength=len(words) * COLUMNS).reshape(len(words), COLUMNS).astype(np.float32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter parts the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def close_pairs(words: list[str], run: np.ndarray) -> Iterator[tuple[int, int]]:
    """Positions of words of one run (its number for each word, ascending) at a squared distance of two at most, by products of blocks of rows."""
    counts = letter_counts(words)
    square = (counts * counts).sum(axis=1)
    for at in range(0, len(words), ROWS):
        stop = int(np.searchsorted(run, run[min(at + ROWS, len(words)) - 1], side="right"))
        for right in range(at, stop, ROWS):
            rows, columns = slice(at, at + ROWS), slice(right, min(right + ROWS, stop))
            distance = square[rows, None] + square[None, columns] - 2 * (counts[rows] @ counts[columns].T)
            i, j = np.nonzero((distance <= 2) & (run[rows, None] == run[None, columns]))
            keep = i + at < j + right
            yield from zip((i[keep] + at).tolist(), (j[keep] + right).tolist(), strict=True)


def pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, n_a, b, n_b: all pairs of words at one edit, each once."""

    def find(blocks_: list[str], parts: list[int], owns: list[bool], shorter: list[int], names: list[str], ns: list[int]) -> pa.RecordBatch:
        new = np.array([x != y for x, y in zip(blocks_, blocks_[1:], strict=False)], dtype=bool)
        run = np.concatenate([[0], np.cumsum(new)]) if names else np.empty(0, dtype=np.int64)
        out: list[tuple[int, int]] = []
        for i, j in close_pairs(names, run):
            a, b, low = names[i], names[j], shorter[i]
            if parts[i] == parts[j] and not owns[i]:
                continue  # they meet where their part meets itself
            if min(len(a), len(b)) != low or (a[: low // 2] == b[: low // 2]) != ("|head|" in blocks_[i]):
                continue  # the block of two shorter words, or of their first half, has this pair
            if one_edit(a, b):
                out.append((i, j))
        side = lambda values, k, kind: pa.array([values[p[k]] for p in out], kind)
        return pa.RecordBatch.from_arrays([side(names, 0, pa.string()), side(ns, 0, pa.int64()), side(names, 1, pa.string()), side(ns, 1, pa.int64())], names=["a", "n_a", "b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            held = [old + column.to_pylist() for old, column in zip(held, batch.columns, strict=True)]
            if held[0]:  # the last block may go on in the next batch
                cut = next((k for k in range(len(held[0]) - 1, -1, -1) if held[0][k] != held[0][-1]), -1) + 1
                if cut:
                    yield find(*[column[:cut] for column in held])
                    held = [column[cut:] for column in held]
        if held[0]:
            yield find(*held)

    return blocks(words, most).repartition("block").sortWithinPartitions("block").mapInArrow(run, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): the last form of its chain, whose length halves in each round."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = stored(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(vocabulary(docs))
    found = stored(pairs(words, most))
    near = found.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        found.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own_n"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    wide = -F.col("best.less") >= 2 * F.col("own_n")
    best = stored(best.select("word", "n_near", F.when(wide, F.col("best.near")).alias("form"), F.when(wide, -F.col("best.less")).alias("form_n")))
    last = roots(best.where("form is not null"))
    return words.join(best, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
