"""The pipeline against plain versions of its stages, and the SQL of its operators."""

import hashlib
from collections import Counter

import duckdb
import pytest
import tiktoken
from plain import components, plain_stats

import corpus_pipeline
from tallyarc.llm.common import stored, table
from tallyarc.llm.queries import ORACLES, QUERIES, byte_bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
        assert name == "byte_bpe" or seen[-1].columns == names
    text = [{r.doc_id: r.text for r in s.collect()} for s in seen[:5]]
    assert text[0].items() >= text[1].items() >= text[2].items() >= text[3].items() >= text[4].items()
    bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    assert len(bad & text[2].keys()) <= 1
    for i, t in text[2].items():
        words, _, _, _, repeats = plain_stats(t)
        assert words >= 10 and 100 * repeats <= 20 * words
    groups = components(text[2])
    assert sorted(text[3]) == sorted(set(groups.values()))
    ranks, pattern = byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in seen[4].collect():
        ids = library.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, seen[5].collect())) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
