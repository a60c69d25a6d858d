"""Every family against DuckDB on the smallest tables; parity.py compares all plans."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parity import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["a4_junction_rollup", "w1_tie_intervals", "w3_tie_topk", "p11_read_decision", "j8_exon_overlap_join", "j11_tolerance_join", "w20_extended_loops",
          "g3_similarity_clusters", "m5_group_bootstrap", "f6_edit_scores", "f3_spanning_frames", "h3_enrichment", "s8_caller_log", "f29_segmentation", "f25_unresolved_reasons", "f28_codon_states", "j15_split_comparison", "f22_residue_classes"]


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_matches(spark, name):
    note, _, _ = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql()[name])
    assert note.startswith("ok") or note.endswith("EMPTY") and "VALUES" not in note


def test_entry_runs(spark):
    assert entry(spark).count() == 1


def test_checks_belong_to_plans():
    assert set(oracle_sql()) <= set(queries())
