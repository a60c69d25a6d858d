"""Token alignment against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from tallyarc.llm import alignment


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def byte_letters():
    """Letter of each byte in a byte-level vocabulary, from the library itself."""
    out = {}
    for char in [chr(c) for c in range(0x800)] + [chr(0x1000 * k + 0x3F * j) for k in range(1, 16) for j in range(64)] + [chr(0x10000 + 0x4000 * k) for k in range(64)]:
        try:
            raw = char.encode()
        except UnicodeEncodeError:
            continue
        shown = "".join(p for p, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char))
        out |= dict(zip(shown, raw, strict=True))
    return out


def plain(rows, files):
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letters = byte_letters()
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            whole = (" " + text).encode()
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                ends_a, ends_b = [0], [0]
                for tokens, ends in ((ta, ends_a), (tb, ends_b)):
                    for _, x in tokens:
                        ends.append(ends[-1] + len(x))
                cuts = sorted(set(ends_a) & set(ends_b))
                for low, high in zip(cuts, cuts[1:], strict=False):
                    groups.append(tuple([t[0] for t, end in zip(tokens, ends[1:], strict=True) if low < end <= high] for tokens, ends in ((ta, ends_a), (tb, ends_b))))
        docs.append((doc_id, groups, Counter((x, y) for p, q in groups for x in p for y in q)))
    held = Counter(pair for _, _, links in docs for pair in links)
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), links.total(), sum(n for k, n in links.items() if held[k] == top[k[0]]),
                    sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("chars", [60, alignment.BATCH])
def test_documents_by_brute_force(spark, files, chars):
    random.seed(chars)
    texts = [None, "", " ", "  two  spaces ", "a", "Hello world, hello <|endoftext|> <s> </s> <0x41>", "====" * 40 + " x " + "=" * 91, "naïve façade Straße — “quotes” 漢字仮名 кириллица 😀👍🏽", "tab\tand\nline \n\n end", "▁ under",
             "it's we'll 12345 67 a  b", "é combining ́x", "same words here", "same words here", "\x00nul \x1c \x85   　 wide", "ﬁ ligature ① ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa aaaa"]
    signs = ["the", "of", "Internationalisation", "x1", "é", "ö ", " ", "\n", "...", "🚀", "don't", "1999", "ÀÉ", "zzzz", "_", "<s>"]
    texts += ["".join(random.choice(signs) + random.choice([" ", " ", ""]) for _ in range(random.randint(1, 60))) for _ in range(60)]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *files, chars=chars).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(plain(rows, files), key=str)


def test_groups_are_connected_overlaps():
    random.seed(3)
    for _ in range(300):
        n = random.randint(1, 30)
        cut = lambda: np.diff([0, *sorted(random.sample(range(1, n), random.randint(0, n - 1))), n])  # noqa: E731, B023
        a, b = cut(), cut()
        ga, gb = alignment.coalesce(a, b)
        common = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
        assert ga.tolist() == np.searchsorted(common, np.cumsum(a)).tolist() and gb.tolist() == np.searchsorted(common, np.cumsum(b)).tolist()


def test_long_runs_and_slices(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 7)
    group_a, ids_a = np.array([0, 0, 0, 1]), np.array([5, 5, 6, 5])
    group_b, ids_b = np.array([0, 0, 1]), np.array([9, 8, 8])
    piece, pair, links = alignment.expand(group_a, ids_a, group_b, ids_b, np.array([0, 0]))
    assert list(zip(piece, pair >> 32, pair & 0xFFFFFFFF, links, strict=True)) == [(0, 5, 8, 3), (0, 5, 9, 2), (0, 6, 8, 1), (0, 6, 9, 1)]
    rows = [(1, "x " + "=" * 100_001 + "-" * 50_003), (2, "漢字" * 30_000)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *files).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert all(r.n_links >= r.n_groups > 0 for r in got)


def test_odd_tables(spark, files):
    docs = spark.createDataFrame([(2**62 + 1, None, 1, "b"), (None, "a b", 2, "c")], "doc_id long, text string, n_a long, batch string")
    assert {(r.doc_id, r.n_a) for r in alignment.align(docs, *files).collect()} == {(2**62 + 1, 0), (None, 2)}
    assert alignment.align(docs.limit(0), *files).collect() == []
