"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyarc.llm import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def edited(word):
    at, letter = random.randrange(len(word) + 1), random.choice("abcdeÉ÷")
    return random.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


@pytest.mark.parametrize("most", [8, spelling.MOST])
def test_variants_by_brute_force(spark, most):
    random.seed(most)
    words = ["".join(random.choice("abcde") for _ in range(random.randint(4, 9))) for _ in range(60)] + ["École", "Straße", "aaaaa", "aaaaaa", "aaaaaaa", "abcdef", "abcdeef"]
    chain = [words[0]]
    for _ in range(7):
        chain.append(edited(chain[-1]))
    bag = [w for w in words for _ in range(random.randint(1, 60))] + [edited(w) for w in words for _ in range(40)] + [w for k, w in enumerate(chain) for _ in range(3 << k)]
    random.shuffle(bag)
    rows = [(i, " ".join(bag[i::50]).upper() if i % 2 else "-".join(bag[i::50])) for i in range(50)] + [(None, "École école abcde abcde"), (3, None), (4, ""), (5, "12 ab"), (6, "aaaaa " * 9), (6, "aaaaa " * 9)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len({r.word for r in got})
    assert any(r.root not in (r.word, r.form) for r in got)


def test_one_edit():
    random.seed(4)
    for _ in range(3000):
        a, b = ("".join(random.choice("ab") for _ in range(random.randint(3, 7))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_odd_tables(spark):
    rows = [(2**62 + 1, "zebra zebra zebra zebro", "en", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    assert [tuple(r) for r in spelling.variants(docs).collect()] == [("zebra", None, "zebra", 3, 0, None)]
    assert spelling.variants(docs.limit(0)).collect() == []
    assert spelling.variants(docs.where("text is null")).collect() == []
    long = spark.createDataFrame([(1, "l" * 300_000 + " " + "zebra " * 100_000)], "doc_id long, text string")
    assert [(r.word, r.n) for r in spelling.variants(long).collect()] == [("zebra", 100_000)]
