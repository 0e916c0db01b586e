"""``cut``: label a numeric column by fixed bin edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(col, edges: list[float], labels: list[str], right: bool = True,
        include_lowest: bool = False) -> Column:
    """Bin label of ``col``; values outside the edges (or null) give null.

    ``right=True``: bins are (a, b]; ``include_lowest`` makes the first bin
    [a, b].  ``right=False``: bins are [a, b).  An infinite last edge is open.
    """
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if right:
            low = (c >= lo) if (include_lowest and i == 0) else (c > lo)
            high = F.lit(True) if math.isinf(hi) else (c <= hi)
        else:
            low = c >= lo
            high = F.lit(True) if math.isinf(hi) else (c < hi)
        cond = low & high
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr
