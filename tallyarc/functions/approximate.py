"""Approximate pattern search inside texts: the one scalar operator Catalyst cannot express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<core:string,orientation:string,start:int,end:int,edits:int>>"
SCALE = 1 << 32


def _ends(pattern: str, text: str) -> np.ndarray:
    """Packed (edits, start) of the best full-pattern match ending at every offset; both ends of the text are free."""
    letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = np.arange(len(letters) + 1, dtype=np.int64)
    best = at.copy()
    for i, base in enumerate(pattern, 1):
        step = best + SCALE
        step[1:] = np.minimum(step[1:], best[:-1] + np.where(letters == ord(base), 0, SCALE))
        step[0] = i * SCALE
        best = np.minimum.accumulate(step - at * SCALE) + at * SCALE
    return best


def hits_in(pattern: str, text: str) -> list[tuple[int, int, int]]:
    """Non-overlapping hits with at most a fifth of the pattern edited, best first, in text order."""
    packed = _ends(pattern, text)
    edits, start, end = packed // SCALE, packed % SCALE, np.arange(len(packed))
    found = np.flatnonzero((edits <= len(pattern) // 5) & (end > start))
    order = found[np.lexsort((end[found], start[found], edits[found]))]
    free, chosen = np.ones(len(packed) + 1, dtype=bool), []
    for e in order:
        if free[start[e]:e].all():
            free[start[e]:e] = False
            chosen.append((int(start[e]), int(e), int(edits[e])))
    return sorted(chosen)


def approximate_hits(text: Column, cores: dict[str, str]) -> Column:
    """Hits of every core in both orientations, each with its own non-overlapping choice."""
    flip = str.maketrans("ACGT", "TGCA")
    searched = [(name, strand, p) for name, core in cores.items() for strand, p in (("+", core), ("-", core.translate(flip)[::-1]))]

    @F.pandas_udf(HITS)
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [
            {"core": name, "orientation": strand, "start": s, "end": e, "edits": n} for name, strand, p in searched for s, e, n in hits_in(p, t)])

    return search(text)
