"""Slices of time that hold few rows, however unevenly the rows lie in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a slice, about.
SLICE_ROWS = 2_000_000
#: Slices at most, SIDE groups of SIDE each: their bounds stand in the plan.
SIDE = 100


def slice_of(df: DataFrame, time: str, rows: int = SLICE_ROWS, bytes_a_row: int = 8) -> Column:
    """The number of a row's slice of time, ascending; null for a null time.

    Slices are cut at quantiles of time over all rows, so none holds more than about ``rows`` of them (or a share of
    1 / SIDE^2, if there are more), if not a single moment does. A table that by Spark's own estimate is no larger than
    one slice is not looked at: it is one slice.
    """
    there, at = F.col(time).isNotNull(), F.unix_millis(time)
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = 1 if estimate <= rows * bytes_a_row else min(SIDE * SIDE, -(-df.where(there).count() // rows))
    if parts < 2:
        return F.when(there, F.lit(0))
    cuts = sorted(set(df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]))
    groups = [cuts[i : i + SIDE] for i in range(0, len(cuts), SIDE)]
    array = lambda values: F.array(*[F.lit(c).cast("bigint") for c in values])
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= at))
    # first the group whose first bound is the last not above the time, then the place in it
    group = F.greatest(upto(array([g[0] for g in groups])), F.lit(1))
    return F.when(there, group * (SIDE + 1) + upto(F.element_at(F.array(*[array(g) for g in groups]), group)))
