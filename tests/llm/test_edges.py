"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest

from tallyarc.llm import bpe, html_text, license_scan, lm, mixing, near_dedup, quality_model, quality_rules, topk, toxicity
from tallyarc.llm.queries import byte_bpe

PROSE = "One plain sentence follows another here, and each of them says a little more than the last one did. "
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n_words long, q_host string, mix_size long, key string, batch long"


@pytest.fixture(scope="module")
def odd(spark):
    """Ten rows: null ids, null, empty and blank texts, a repeated row, one very long text."""
    texts = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (None, PROSE + "And this."), (None, None), (7, "short"), (7, "short"), (8, "word " * 60_000), (9, PROSE * 2)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", k, 5, 6, "h", 7, "k", 8) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r[0] is not None, r[0] or 0) for r in rows)


def test_every_row_comes_back(odd, labels):
    ranks, pattern = byte_bpe()
    want = ids(odd.select("doc_id").collect())
    for out in (bpe.digests(odd, ranks, pattern), quality_rules.verdicts(odd, ["doc_id"]), mixing.taken(odd), lm.scores(odd), near_dedup.near_duplicates(odd),
                toxicity.classify(odd, labels), quality_model.classify(odd, labels)):
        assert ids(out.select("doc_id").collect()) == want


def test_filtering_stages_keep_columns(odd, labels):
    for out in (quality_model.keep_good(odd, labels), quality_rules.keep_clean(odd), near_dedup.keep_first(odd), mixing.mix(odd)):
        assert out.schema.names == odd.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        out.collect()
    kept = [r.doc_id for r in near_dedup.keep_first(odd).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 7, 8]  # one of the repeated rows; 9 is 1 said twice


def test_large_ids_beside_nulls(spark, labels):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, PROSE, "en", "s"), (None, PROSE + "More.", "en", "s"), (big + 2, None, None, None)], "doc_id long, text string, lang string, source string")
    ranks, pattern = byte_bpe()
    for out in (bpe.digests(docs, ranks, pattern), quality_rules.verdicts(docs, ["doc_id"]), mixing.taken(docs), lm.scores(docs), near_dedup.near_duplicates(docs),
                toxicity.classify(docs, labels), quality_model.classify(docs, labels)):
        assert {r.doc_id for r in out.select("doc_id").collect()} == {big, None, big + 2}
    pages = spark.createDataFrame([(big, None, PROSE), (None, "", None)], "page_id long, url string, html string")
    assert {r.page_id for r in html_text.extract(pages).collect()} == {big, None}


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    ranks, pattern = byte_bpe()
    for out in (bpe.digests(none, ranks, pattern), quality_rules.verdicts(none, ["doc_id"]), mixing.taken(none), mixing.mix(none), lm.scores(none), near_dedup.near_duplicates(none),
                near_dedup.keep_first(none), toxicity.classify(none, labels), toxicity.classify(none, labels.limit(0)), quality_model.classify(none, labels.limit(0)),
                quality_model.keep_good(none, labels), license_scan.scan(none), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(vectors, vectors).collect() == []


def test_odd_values(spark, odd, labels):
    ranks, pattern = byte_bpe()
    by_text = {r.text: r for r in bpe.encode(odd, ranks, pattern).join(odd.where("doc_id in (2, 3)").select("doc_id", "text"), "doc_id").collect()}
    assert by_text[None].ids == [] and by_text[""].ids == []
    scores = {r.doc_id: r for r in lm.scores(odd).collect() if r.doc_id in (2, 3, 4, 8)}
    assert [scores[i].n_tokens for i in (2, 3, 4, 8)] == [1, 1, 1, 60_001]
    assert not [r for r in quality_rules.verdicts(odd, ["doc_id"]).collect() if r.doc_id in (2, 3, 4, 7, 8) and r.kept]
    nodes = {r.doc_id: r for r in near_dedup.near_duplicates(odd).collect() if r.doc_id is not None}
    assert (nodes[2].n_shingles, nodes[7].n_shingles, nodes[8].n_shingles) == (0, 1, 1) and nodes[2].kept
    assert license_scan.scan(odd).collect() == []
    decoded = bpe.decode(spark.createDataFrame([(1, [0, None, 10**6]), (2, None)], "doc_id long, ids array<int>"), ranks).collect()
    assert [bytes(r.decoded) for r in sorted(decoded)] == [b"!", b""]
