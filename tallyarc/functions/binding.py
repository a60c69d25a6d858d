"""Bind values once per row before they are used inside a lambda.

Catalyst inlines projected columns into lambda bodies, where they would be
evaluated again for every element; a lambda variable is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct holding ``values``."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))
