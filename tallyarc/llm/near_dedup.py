"""Near-duplicate documents by banded MinHash with sequential Bayesian verification.

1. Texts with the same set of shingles are one node. Each node has a signature, cut
   into bands; nodes that share a band are candidates.
2. In every band bucket the smallest and the largest node are compared with all others:
   signatures batch by batch, dropping a pair as soon as the posterior probability of a
   similarity at the threshold falls below the chosen miss probability; what survives is
   confirmed on the full sets. The links give first components.
3. A bucket whose other members still are in several components is settled: those outside
   the largest one are compared with the others, in blocks, so no other pair is ever formed
   and a large group of mutual copies costs no more than its members.

Links missed: a pair at the threshold shares no band with a probability of
(1 - threshold ** ROWS) ** BANDS = 2e-5 at 0.75, and is dropped early with MISS at most.
Node and shingle keys are 64-bit hashes.

Defined cases: a null or blank text has no shingles and is alone; fewer words than a
shingle make one shingle; null doc_ids are alone unless their text links them, and a
component's id is its smallest doc_id that is not null; repeated rows belong to one
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyarc.llm.common import cuts, exact, giving_back, set_aside, stored

SHINGLE, BANDS, ROWS = 5, 40, 5
HASHES, STEP = BANDS * ROWS, 40
MISS = 1e-6
BLOCK = 512
MULTIPLIERS = np.random.default_rng(20240501).integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
ADDENDS = np.random.default_rng(20240502).integers(0, 2**64, HASHES, dtype=np.uint64)


class WordKeys(dict):
    """64-bit keys of words, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def shingles(text: str | None, keys: WordKeys) -> np.ndarray:
    """Sorted distinct keys of the five-word shingles; all words as one where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.array([keys[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    out = codes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return np.unique(mixed(out + np.uint64(width)))


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(least, (items[at : at + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out.view(np.int64)


def node_key(items: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).view(np.int64))) if len(items) else 0


def tail(threshold: float, matches: int, n: int) -> float:
    """Posterior probability of a similarity of ``threshold`` or more after so many matches of n, all similarities equally likely before."""
    return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(matches + 1))


def bounds(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number of hashes compared, the fewest matches with which a pair goes on."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        out.append((n, next(m for m in range(n + 1) if tail(threshold, m, n) >= miss)))
    return out


def going_on(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (rows of a and b) that survive every batch of hashes, and their matches."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for n, least in limits:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], n
    return alive, matches


def _row_key() -> Column:
    """Tells rows apart by id and text, so rows without an id share no key."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, node, keys (of its bands) of every document."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = WordKeys()
        for frame in cuts(frames):
            sets = [shingles(t, keys) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "row_key": frame["row_key"], "n_shingles": [len(s) for s in sets], "node": [node_key(s) for s in sets],
                                "keys": [band_keys(signature(s)) if len(s) else None for s in sets]})

    narrow = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), _row_key(), "text")
    sketched = narrow.mapInPandas(run, "doc_id string, row_key long, n_shingles long, node long, keys array<long>")
    return sketched.withColumn("doc_id", F.col("doc_id").cast("long"))


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sig, items of the nodes in ``wanted`` (row_key, node): their texts are read again, other texts are not sketched."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = WordKeys()
        for frame in cuts(frames):
            sets = [shingles(t, keys) for t in frame["text"]]
            out = pd.DataFrame({"node": [node_key(s) for s in sets], "wanted": frame["wanted"],
                                "sig": [signature(s).tobytes() for s in sets], "items": [s.tobytes() for s in sets]})
            yield out[out["node"] == out["wanted"]].drop(columns="wanted")

    texts = docs.select(_row_key(), "text").where(F.col("text").isNotNull())
    found = texts.join(wanted.select("row_key", F.col("node").alias("wanted")), "row_key").select("text", "wanted")
    # rows that repeat an id and its text give a node twice
    return found.mapInPandas(run, "node long, sig binary, items binary").dropDuplicates(["node"])


def _attach(pairs: DataFrame, content: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(content.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def prune(pairs: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """Sequential verification on signatures: pairs (a, b) whose posterior stays above MISS."""
    limits = bounds(threshold)

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                left, right = (np.frombuffer(b"".join(frame[f"sig_{s}"]), dtype=np.uint32).reshape(-1, HASHES) for s in "ab")
                yield frame.iloc[going_on(left, right, limits)[0]][["a", "b"]]

    return _attach(pairs, content, "sig").select("sig_a", "sig_b", "a", "b").mapInPandas(run, "a long, b long")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """100 * shared >= percent * union, on full sets."""
    both = np.sort(np.frombuffer(x + y, dtype=np.uint64))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def confirm(pairs: DataFrame, content: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * shared >= percent * union on the full sets."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            linked = [similar(x, y, percent) for x, y in zip(frame["items_a"], frame["items_b"], strict=True)]
            yield frame.loc[np.array(linked, dtype=bool), ["a", "b"]]

    return _attach(pairs, content, "items").select("items_a", "items_b", "a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in an edge: stars are moved to ever smaller centres until none moves."""
    edges = stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select("m", "v")  # larger neighbours go to the least one
        large = large.unionByName(least.where("m < u").select("m", F.col("u").alias("v"))).where("m < v").distinct()
        small = large.groupBy("v").agg(F.min("m").alias("m"))
        moved = large.join(small.withColumnRenamed("m", "least"), "v").select(F.col("least").alias("u"), F.when(F.col("m") == F.col("least"), F.col("v")).otherwise(F.col("m")).alias("v"))
        again = stored(moved.where("u < v").distinct())
        # stars only: no node is both centre and leaf, and each leaf has one centre
        leaves, distinct, centres = again.select(F.col("v").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
            again.select(F.col("u").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))).groupBy("n").agg(
            F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 0").agg(F.sum("leaf"), F.count("*"), F.sum("centre")).first()
        edges = again
        if not leaves or (leaves == distinct and not centres):
            break
    return stored(edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()))


def _settle(members: DataFrame, labels: DataFrame, content: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, as many as join them and hardly more.

    Members outside a bucket's largest component meet all its members in blocks. Within a
    block pairs are pruned on signatures, the likeliest is confirmed first, and what a link
    has joined isn't compared again. A pair that shares several buckets is looked at in
    the first of them alone.
    """
    limits = bounds(percent / 100)
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_ = sizes.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed_ = mixed_.select("key", "members", F.col("top.component").alias("top"), (F.col("members") - F.col("top.n")).alias("others"))
    rows = stored(labelled.join(mixed_, "key")).join(content, "node")
    blocks, other_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("members", "others"))
    block_of = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    every = rows.withColumn("mb", block_of(blocks)).withColumn("ob", F.explode(F.sequence(F.lit(0), other_blocks - 1)))
    others = rows.where("component <> top").withColumn("ob", block_of(other_blocks)).withColumn("mb", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def compare(all_: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(part: int) -> int:
            while (up := root.get(part, part)) != part:
                root[part] = root.get(up, up)
                part = up
            return part

        if len(all_) and len(few):
            sigs = np.frombuffer(b"".join(all_["sig"]), dtype=np.uint32).reshape(-1, HASHES)
            nodes, parts, items = all_["node"].to_numpy(), all_["component"].to_numpy(), all_["items"].to_numpy()
            key, top = all_["key"].iloc[0], all_["top"].iloc[0]
            for node, part, sig, own in zip(few["o_node"], few["o_component"], few["o_sig"], few["o_items"], strict=True):
                mine = np.frombuffer(sig, dtype=np.uint32)
                at = np.flatnonzero((parts != part) & ((parts == top) | (nodes > node)))
                alive, matches = going_on(sigs[at], np.broadcast_to(mine, (len(at), HASHES)), limits)
                at = at[alive]
                shared = (sigs[at].reshape(-1, BANDS, ROWS) == mine.reshape(BANDS, ROWS)).all(axis=2)
                here = band_keys(mine)[shared.argmax(axis=1)] == key
                for j in at[here][np.argsort(-matches[here], kind="stable")].tolist():
                    one, two = find(int(part)), find(int(parts[j]))
                    if one != two and similar(own, items[j], percent):
                        root[max(one, two)] = min(one, two)
                        out.append((min(node, int(nodes[j])), max(node, int(nodes[j]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    few = others.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "mb", "ob", "node", "component", "sig", "items")]).groupBy("o_key", "o_mb", "o_ob")
    return every.select("key", "mb", "ob", "top", "node", "component", "sig", "items").groupBy("key", "mb", "ob").cogroup(few).applyInPandas(compare, "a long, b long")


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and node and component of the nodes that are linked."""
    threshold = percent / 100
    sketched = stored(sketches(docs))
    filled = sketched.where("n_shingles > 0")
    banded = filled.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stored(banded.join(shared, "key").distinct())
    wanted = filled.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    content = stored(contents(docs, wanted))
    ends = members.select(F.explode(F.array("low", "high")).alias("end"), "node").where("end <> node")
    pairs = stored(ends.select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b")).distinct())
    links = stored(confirm(stored(prune(pairs, content, threshold)), content, percent))
    labels = components(links)
    # every member has met its bucket's ends, so buckets of three have nothing left to compare
    between = members.where("node <> low AND node <> high").select("key", "node")
    more = stored(_settle(between, labels, content, percent))
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return sketched, labels


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _result(*_labelled(docs, percent))


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each component the row of the smallest doc_id stays.

    Rows without shingles all stay; of rows that repeat both doc_id and words, one stays.
    """
    sketched, labels = _labelled(docs, percent)
    renamed, neutral, back = set_aside(docs, "doc_id", "text")
    safe, whole = exact(renamed)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.schema)

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = WordKeys()
        for frame in cuts(frames):
            yield frame.assign(d_node=[node_key(shingles(t, keys)) for t in frame["text"]])

    filled = sketched.where("n_shingles > 0").select(F.col("doc_id").alias("d_id"), "node").distinct().join(labels, "node", "left")
    ranked = filled.withColumn("component", F.coalesce("component", "node"))
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("d_id").isNull(), "d_id", "node")).alias("f")).select(F.col("f.d_id").alias("f_id"), F.col("f.node").alias("f_node"))
    noded = safe.mapInPandas(run, f"{types}, d_node long").select(*whole, "d_node")
    empty = noded.where("d_node = 0").select(*back)
    found = noded.where("d_node <> 0").join(first, (F.col("d_node") == F.col("f_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("f_id")))
    once = Window.partitionBy("d_node", F.col("doc_id")).orderBy(*[F.col(f.name) for f in renamed.schema if f.dataType.typeName() not in ("map", "variant")])
    return found.withColumn("d_copy", F.row_number().over(once)).where("d_copy = 1").select(*back).unionByName(empty)


def _result(sketched: DataFrame, labels: DataFrame) -> DataFrame:
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    filled = sketched.where("n_shingles > 0")
    nodes = stored(filled.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # written tables on both sides: a node or component with a large part of all rows is split by the join
    first = stored(nodes.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = stored(nodes.select("node", "component").join(first, "component").select("node", "component_id"))
    rows = filled.select("doc_id", "n_shingles", "node").join(ids, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
