"""Alignment of two tokenizers: groups of tokens between common ends, and how common their links are.

1. Texts are cut at single spaces between visible characters. No token of either
   tokenizer reaches over such a cut, so both end a token there, and every distinct piece
   is encoded and aligned once in a task for all its occurrences.
2. Interval coalescing: the byte intervals of both tokenizers' tokens are lexsorted by
   start; a group breaks where a start reaches the running maximum of the ends. The
   overlaps expand within a group to the pairs of its distinct ids, with their numbers.
3. Batches of texts hand on their distinct id pairs with the number of texts that hold
   each; totals and the highest total of each A id go back to the batches, which sum them
   over their links.

The expansion is over distinct ids in slices, so a long group without a common end
(a run of one sign) costs what its distinct pairs cost.

Defined cases: a null or empty text, or one whose tokens don't spell a space and the
text, has zeros and an empty digest; a null doc_id stays null; repeated rows are documents
of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.batches import squeeze, unsqueeze
from tallyarc.llm.common import giving_back, stored

#: A single space between visible characters: both tokenizers start a token with it.
VISIBLE = "!-~À-ɏ"
CUT, EDGES, BEYOND = re.compile(f"(?<=[{VISIBLE}]) (?=[{VISIBLE}])"), re.compile(f"[{VISIBLE}](.*[{VISIBLE}])?", re.DOTALL), re.compile("[^\0-ɏ]")
#: Characters of texts in a batch, of pieces that a task remembers, of texts encoded at a time, of a line of pieces, and pairs expanded at a time.
BATCH, HELD, AT_ONCE, LINE, SLICE = 8_000_000, 20_000_000, 400_000, 4_000, 2_000_000
PAIR = 32
#: Fixed value: how byte-level tokenizers part a text before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_suffice(byte_level: str) -> bool:
    """Whether merging by the rank of what a pair spells gives this tokenizer's ids.

    So it does if every token, merged alone, comes out whole: the bytes of a token between
    two borders have then gone through the same merges as alone, so the last pair is always
    the one of its own rule. Merged tokens must have later numbers than their parts.
    """
    from tokenizers import Tokenizer

    parts = json.loads(byte_level)
    pre = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return False
    tokenizer = Tokenizer.from_str(byte_level)
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    special = {t["content"] for t in parts.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
    rising = [vocab["".join(p)] for p in pairs]
    return rising == sorted(rising) and all(max(vocab[x], vocab[y]) < vocab[x + y] for x, y in pairs) and all(
        [t.id for t in tokenizer.model.tokenize(token)] == [i] for token, i in vocab.items() if token not in special)


class Tokenizers:
    """The two tokenizers and the bytes of their tokens; made in the task from the files' contents.

    With ``by_rank`` (ranks_suffice) texts of Latin letters, whose classes no library's
    Unicode version changes, are encoded by A's ranks; other texts by its own library.
    """

    def __init__(self, byte_level: str, pieces: bytes, by_rank: bool = False):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        # byte-level vocabularies write a byte as itself where it is printable, the others as the letters from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        plain = self.a.get_vocab(with_added_tokens=False)
        special = set(vocab) - set(plain) | {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.ranks = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={self.a_bytes[i]: i for t, i in plain.items() if t not in special}, special_tokens={}) if by_rank else None
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.a_lens, self.b_lens = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Whether pieces may be encoded alone: no token of B goes on over a space inside it.
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)

    def _lines_a(self, lines: list[str]) -> list[list[int]]:
        own = [i for i, line in enumerate(lines) if self.ranks is None or BEYOND.search(line)]
        out = [[] for _ in lines] if len(own) == len(lines) else [self.ranks.encode_ordinary(" " + line) if not BEYOND.search(line) else [] for line in lines]
        for i, e in zip(own, self.a.encode_batch_fast([" " + lines[i] for i in own], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a space and each text by A, and of each text by B, which adds the space; their numbers by text; and whether both spell the text (else it has none).

        Texts with visible ends are put on lines, parted by the space that starts the next.
        """
        lines: list[list[str]] = []
        room, open_ = 0, False
        for text in texts:
            joins = self.cuts and EDGES.fullmatch(text) is not None
            if not (joins and open_ and room > 0):
                lines.append([])
                room = LINE
            lines[-1].append(text)
            room -= len(text) + 1
            open_ = joins
        ids, spelled = self._spelled(lines)
        if not all(ok or len(line) == 1 for ok, line in zip(spelled, lines, strict=True)):
            lines = [part for ok, line in zip(spelled, lines, strict=True) for part in ([line] if ok else [[t] for t in line])]
            ids, spelled = self._spelled(lines)
        right = np.repeat(np.array(spelled, dtype=bool), [len(line) for line in lines])
        stops = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), dtype=np.int64, count=len(texts)) * right)
        out = []
        for lists, lens in zip(ids, (self.a_lens, self.b_lens), strict=True):
            flat = np.fromiter(chain.from_iterable(x for x, ok in zip(lists, spelled, strict=True) if ok), dtype=np.int64)
            out += [flat, np.diff(np.searchsorted(np.cumsum(lens[flat]), stops, side="right"), prepend=0)]
        return *out, right

    def _spelled(self, lines: list[list[str]]) -> tuple[tuple[list[list[int]], list[list[int]]], list[bool]]:
        joined = [" ".join(line) for line in lines]
        ids = self._lines_a(joined), self.b.encode(joined, num_threads=1)
        whole = [(" " + text).encode("utf-8", "surrogatepass") for text in joined]
        said = [[b"".join([names[i] for i in line]) for line in lists] for lists, names in zip(ids, (self.a_bytes, self.b_bytes), strict=True)]
        return ids, [a == w == b for a, b, w in zip(*said, whole, strict=True)]


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token, whose byte lengths lay both out over the same bytes."""
    ends = np.concatenate([np.cumsum(len_a), np.cumsum(len_b)])
    starts = ends - np.concatenate([len_a, len_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.concatenate([[False], starts[order][1:] >= reach[:-1]]) if len(order) else np.empty(0, dtype=bool)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(len_a)], group[len(len_a) :]


def distinct(owner: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value), ascending, and the sum of their weights."""
    if not len(owner):
        return owner, value, weight
    order = np.lexsort((value, owner))
    owner, value, weight = owner[order], value[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(value) != 0)]))
    return owner[first], value[first], np.add.reduceat(weight, first)


def expand(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, piece_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, pair (A id and B id in one number), links: the pairs of tokens that share a group, summed over each piece's groups (ascending)."""
    ga, va, na = distinct(group_a, ids_a, np.ones(len(ids_a), dtype=np.int64))
    gb, vb, nb = distinct(group_b, ids_b, np.ones(len(ids_b), dtype=np.int64))
    at = np.searchsorted(gb, ga)  # every group has tokens of both
    width = np.searchsorted(gb, ga, side="right") - at
    done = (np.empty(0, dtype=np.int64),) * 3
    ends = np.cumsum(width)
    start = 0
    while start < len(ga):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        part = slice(start, stop)
        n = width[part]
        left = np.repeat(np.arange(start, stop), n)
        right = np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        more = (piece_of[ga[left]], va[left] << PAIR | vb[right], na[left] * nb[right])
        done = distinct(*[np.concatenate(x) for x in zip(done, more, strict=True)])
        start = stop
    return done


class Numbers(dict):
    """Numbers of keys in the order they come; ``new`` holds those not yet looked at."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


def stretches(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of stretches one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """Distinct pieces by number, each with its figures, its text of groups and its distinct pairs (by number, too)."""

    def __init__(self, make: Callable[[], Tokenizers]):
        self.tokenizers = t = make()
        self.split = CUT.split if t.cuts else lambda text: [text]
        #: Texts of ids by what follows them: another of the group, the group's B ids, the next group, nothing.
        self.texts = [[f"{i}{mark}" for i in range(max(len(t.a_bytes), len(t.b_bytes)))] for mark in (",", "|", ";", "")]
        self.clear()

    def clear(self) -> None:
        self.number, self.pair = Numbers(), Numbers()
        self.size = 0
        self.said: list[str] = []
        self.figures = np.empty((0, 5), dtype=np.int64)  # spelled right, A tokens, B tokens, groups, links
        self.starts, self.lens = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.pairs, self.links = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def codes(self, text: str) -> np.ndarray:
        number = self.number
        return np.array([number[piece] for piece in self.split(text)], dtype=np.int64)

    def settle(self) -> None:
        """Encode and align the pieces that are new."""
        new, at = self.number.new, 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (size < AT_ONCE or stop == at):
                size += len(new[stop])
                stop += 1
            self._add(new[at:stop])
            self.size += size + 60 * (stop - at)
            at = stop
        new.clear()

    def _add(self, texts: list[str]) -> None:
        ids_a, n_a, ids_b, n_b, right = self.tokenizers.encode(texts)
        group_a, group_b = coalesce(self.tokenizers.a_lens[ids_a], self.tokenizers.b_lens[ids_b])
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        piece_of = np.zeros(groups, dtype=np.int64)
        piece_of[group_a] = np.repeat(np.arange(len(texts)), n_a)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        n_groups = np.bincount(piece_of, minlength=len(texts))
        n_links = np.bincount(piece_of, weights=in_a * in_b, minlength=len(texts)).astype(np.int64)
        self._say(ids_a, ids_b, group_a, group_b, in_a, in_b, n_a + n_b)
        piece, pairs, links = expand(group_a, ids_a, group_b, ids_b, piece_of)
        distinct_pairs, of = np.unique(pairs, return_inverse=True)
        number = self.pair
        lens = np.bincount(piece, minlength=len(texts))
        self.figures = np.concatenate([self.figures, np.stack([right.astype(np.int64), n_a, n_b, n_groups, n_links], axis=1)])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.pairs = np.concatenate([self.pairs, np.array([number[p] for p in distinct_pairs.tolist()], dtype=np.int64)[of.ravel()]])
        self.links = np.concatenate([self.links, links])

    def _say(self, ids_a, ids_b, group_a, group_b, in_a, in_b, tokens) -> None:
        """Texts of groups: every id goes to its place among the group's A ids, then its B ids, with the mark that follows it."""
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + (before_a + in_a)[group_b]
        ids, marks = np.empty(len(ids_a) + len(ids_b), dtype=np.int64), np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        ends = np.cumsum(in_a + in_b)
        marks[ends - in_b - 1], marks[ends - 1] = 1, 2
        stops = np.cumsum(tokens)
        marks[stops[tokens > 0] - 1] = 3
        texts = self.texts
        parts = [texts[m][i] for m, i in zip(marks.tolist(), ids.tolist(), strict=True)]
        stops = stops.tolist()
        self.said += ["".join(parts[a:b]) for a, b in zip([0, *stops], stops, strict=False)]


def squeeze_long(links: np.ndarray) -> bytes:
    """Numbers of links, low halves, then high ones; those are nearly always zero."""
    return squeeze(np.concatenate([links & 0xFFFFFFFF, links >> 32]))


def unsqueeze_long(blob: bytes) -> np.ndarray:
    low, high = unsqueeze(blob).reshape(2, -1)
    return high << 32 | low


#: A row for each text, with the codes of its distinct pairs and their links; and a head for each batch with the pairs and in how many of its texts each is.
PACKED = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, links binary, pairs array<long>, texts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(docs: DataFrame, make: Callable[[], Tokenizers], chars: int = BATCH) -> DataFrame:
    """Batches of aligned texts."""
    fields = ("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links", "pairs", "texts")
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, made, size = Pieces(make), TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            pieces.settle()
            out, found = [], []
            for doc_id, codes in rows:
                figures = pieces.figures[codes]
                if len(codes) and figures[:, 0].all():
                    seen, times = np.unique(codes, return_counts=True)
                    lens = pieces.lens[seen]
                    at = stretches(pieces.starts[seen], lens)
                    order = np.argsort(pieces.pairs[at], kind="stable")
                    pairs, links = pieces.pairs[at][order], (pieces.links[at] * np.repeat(times, lens))[order]
                    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                    pairs, links = pairs[first], np.add.reduceat(links, first)
                    said = hashlib.sha256(";".join([pieces.said[c] for c in codes.tolist()]).encode()).hexdigest()
                    out.append((doc_id, *figures[:, 1:].sum(axis=0).tolist(), said, links))
                    found.append(pairs)
                else:
                    out.append((doc_id, 0, 0, 0, 0, "", np.empty(0, dtype=np.int64)))
                    found.append(np.empty(0, dtype=np.int64))
            numbers = np.fromiter(pieces.pair, dtype=np.int64, count=len(pieces.pair))
            texts = np.bincount(np.concatenate(found), minlength=len(numbers))
            used = np.flatnonzero(texts)
            code = np.zeros(len(numbers), dtype=np.int64)
            code[used] = np.arange(len(used))
            batch = part << 32 | made
            made += 1
            table = [(batch, None, None, None, None, None, None, None, None, numbers[used].tolist(), texts[used].tolist())]
            for (*head, links), own in zip(out, found, strict=True):
                table.append((batch, *head, squeeze(code[own]), squeeze_long(links), None, None))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*table, strict=True), kinds, strict=True)], names=fields)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                rows.append((doc_id.as_py(), pieces.codes(text) if text else np.empty(0, dtype=np.int64)))
                size += len(text or "") + 20
                if size >= chars:
                    yield flush()
                    rows, size = [], 0
                    if pieces.size > HELD:
                        pieces.clear()
        if rows:
            yield flush()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PACKED)


def pair_counts(heads: DataFrame) -> DataFrame:
    """pair, texts (that hold it linked), best (whether no pair of its A id is in more) from rows of (pair, texts)."""
    counts = heads.groupBy("pair").agg(F.sum("texts").alias("texts")).withColumn("a", F.shiftright("pair", PAIR))
    top = counts.groupBy("a").agg(F.max("texts").alias("top"))
    return counts.join(top, "a").select("pair", F.col("texts").alias("total"), (F.col("texts") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: bytes, chars: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``byte_level`` and ``pieces`` are the contents of the two tokenizers' files.
    """
    by_rank = ranks_suffice(byte_level)
    rows = stored(packed(docs, lambda: Tokenizers(byte_level, pieces, by_rank), chars))
    heads = rows.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "texts")).alias("code", "h")).select("batch", "code", "h.*").withColumnRenamed("pairs", "pair")
    answers = heads.select(F.col("batch").alias("of"), "code", "pair").join(pair_counts(heads), "pair").select("of", "code", "total", "best")

    def total(texts: pa.Table, answers: pa.Table) -> pa.Table:
        n = answers.num_rows
        count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        at = answers["code"].to_numpy()
        count[at], best[at] = answers["total"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for codes, blob in zip(texts["codes"].to_pylist(), texts["links"].to_pylist(), strict=True):
            codes = unsqueeze(codes)
            links = unsqueeze_long(blob)
            n_best.append(int(links[best[codes]].sum()))
            sums.append(int((links * count[codes]).sum()))
        return texts.drop_columns(["batch", "codes", "links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    texts = rows.where("pairs is null").drop("pairs", "texts")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(total, out).select(*[f.split()[0] for f in RESULT.split(", ")])
