"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def folded(c: str | Column) -> Column:
    """Lower case without surrounding spaces and tabs; null stays null."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))
