"""Plans over the supplied tables, one module per operator family."""

from importlib import import_module

FAMILIES = ["rank_plans", "relational_plans", "interval_plans", "graph_plans", "sequence_plans", "source_plans", "matrix_plans", "cohort_plans", "split_read_plans", "probe_plans"]


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
