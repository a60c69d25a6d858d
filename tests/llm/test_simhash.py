"""SimHash components against a plain version."""

import random
from itertools import combinations

import pytest
import xxhash

from tallyarc.llm import simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest position reachable over at most four differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [find(i) for i in range(len(fps))]


def test_every_four_places_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def test_documents_by_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choice(["Tea", "sun", "road", "ÉTÉ", "of", "near", f"w{i}"]) for _ in range(random.randint(60, 200))) for i in range(40)]
    texts = [None, "", " \n\t ", "one", "One Two", "a b c d", "A  b\nc d", "A b c d e " * 20_000]
    for text in base:
        texts += [text, text.upper() if text.isascii() else text, text + " more", text.replace("road", "street", 1)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, plain_components(fps), strict=True))}
    assert len({c for _, c in got.values()}) < len(set(fps)) < len(texts)


@pytest.mark.parametrize("most", [1, 40, simhash.MOST])
def test_crowded_fingerprints_by_brute_force(spark, most):
    """Balls of near fingerprints and rings just out of reach: lists of every length and each way of cutting them."""
    random.seed(most)
    flip = lambda fp, bits: fp ^ sum(1 << b for b in random.sample(bits, random.randint(1, min(len(bits), 7))))
    centres = [random.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    fps = {flip(c, range(64)) for c in centres for _ in range(40)} | {flip(centres[0], range(20, 44)) for _ in range(150)} | set(centres)
    fps = sorted(fps)
    signed = [fp - 2**64 if fp >> 63 else fp for fp in fps]
    pairs = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most=most).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 4 for r in pairs)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in pairs:
        low, high = sorted((find(at[r.a]), find(at[r.b])))
        root[high] = low
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_forest_is_a_forest():
    import numpy as np

    random.seed(9)
    fps = np.array(sorted({1 << a | 1 << b for a in range(64) for b in range(64)}), dtype=np.uint64)
    assert sum(len(b) for _, b in simhash.forest(fps, 4)) == len(fps) - 1  # one component, no link too many


def test_odd_rows(spark):
    rows = [(None, "a b c d e", 1), (None, None, 2), (7, "a b c d e", 3), (7, "a b c d e", 4), (2**62 + 1, "", 5), (2**62 + 3, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [(r.doc_id, r.component_id, r.fingerprint == "0" * 16) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 7, False), (7, 7, False), (7, 7, False), (None, 2**62 + 1, True), (2**62 + 1, 2**62 + 1, True), (2**62 + 3, 2**62 + 1, True)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    nameless = simhash.near_duplicates(docs.where("doc_id is null")).collect()
    assert [r.component_id for r in nameless] == [None, None]
