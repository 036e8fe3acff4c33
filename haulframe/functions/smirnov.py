"""Exact two-sample Smirnov tail, with or without ties.

Evaluated on the finished one-row test result, which carries the sizes of the runs of
equal values of both samples together, in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_p(gap: float, n: int, m: int, ties: list[int] | None = None) -> float:
    """Chance of a gap of at least ``gap`` among all orders of the pooled values.

    An order is a lattice path from (0, 0) to (n, m); its gap counts where a run of equal
    values ends.  The chance that a path has reached the gap is carried from one
    antidiagonal to the next: two rows of at most the smaller sample's size, whatever
    the sizes, in n * m steps.
    """
    if n > m:
        n, m = m, n
    reach = round(gap * n * m)
    if reach <= 0:
        return 1.0
    ends = np.ones(n + m + 1, bool)
    if ties is not None:
        ends[:] = False
        ends[np.cumsum(ties)] = True
    i = np.arange(n + 1, dtype=np.int64)
    passed = np.zeros(n + 1)  # by the number of values of the smaller sample
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(n, k)
        # the last value of the first k is of the one sample or of the other
        new = np.zeros(n + 1)
        own = i[low:high + 1]
        before = np.concatenate([[0.0], passed])[low:high + 1]
        new[low:high + 1] = (before * own + passed[low:high + 1] * (k - own)) / k
        if ends[k]:
            over = np.abs(own * m - (k - own) * n) >= reach
            new[low:high + 1][over] = 1.0
        passed = new
    return float(passed[n])


@F.pandas_udf(T.DoubleType())
def smirnov_exact_p(gap: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(
        [exact_p(d, int(a), int(b), list(t)) if pd.notna(d) else None
         for d, a, b, t in zip(gap, n, m, ties)],
        dtype="float64",
    )
