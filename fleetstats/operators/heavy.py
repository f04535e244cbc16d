"""R4 over a whole history: the heaviest statements, from mergeable summaries and an exact pass.

A day's summary keeps its heaviest statements and a bound on all others. Merged over the days
it bounds every statement's total from both sides: below by what the summaries kept of it,
above by that and the bounds of the days that did not keep it. Only statements whose upper
bound reaches the k-th largest lower bound can be among the k heaviest; these are summed
exactly. Nothing depends on the summaries being large enough: with small ones more survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.plans.shapes import top_k

#: Statements that a day's summary keeps.
KEPT = 200


def day_totals(history: DataFrame, day: str, key: Sequence[str], weight: str) -> DataFrame:
    """(day, key, weight, calls): one row per statement and day, a hash aggregate with partial sums."""
    return history.groupBy(day, *key).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("calls"))


def summarise_days(totals: DataFrame, day: str, key: Sequence[str], kept: int = KEPT) -> DataFrame:
    """(day, key, weight, bound): the heaviest statements of each day; no other weighs more than ``bound``."""
    top = top_k(totals.select(day, *key, "weight"), [F.col("weight").desc(), *[F.col(k).asc_nulls_first() for k in key]], kept, [day])
    bounds = top.groupBy(day).agg(F.when(F.count(F.lit(1)) >= kept, F.min("weight")).otherwise(F.lit(0)).alias("bound"))
    return top.join(bounds, day)


def top_history(totals: DataFrame, summary: DataFrame, day: str, key: Sequence[str], k: int) -> DataFrame:
    """(key, weight, calls): the ``k`` heaviest statements over all days, exact; ties by key."""
    total_bound = summary.groupBy(day).agg(F.max("bound").alias("bound")).agg(F.coalesce(F.sum("bound"), F.lit(0))).scalar()
    merged = summary.groupBy(*key).agg(F.sum("weight").alias("_low"), F.sum("bound").alias("_own"))
    # A k-row top list; its least lower bound is what the k heaviest reach in any case.
    floor = merged.orderBy(F.col("_low").desc()).limit(k).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("_low")).otherwise(F.lit(0))).scalar()
    names = [f"_k{i}" for i in range(len(key))]
    upper = merged.select(*[F.col(c).alias(n) for c, n in zip(key, names)], (F.col("_low") - F.col("_own")).alias("_over"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names)]
    reach = F.coalesce(F.col("_over"), F.lit(0)) + total_bound
    survivors = totals.join(upper, same, "left").filter(reach >= floor)
    exact = survivors.groupBy(*key).agg(F.sum("weight").alias("weight"), F.sum("calls").alias("calls"))
    return top_k(exact, [F.col("weight").desc(), *[F.col(c).asc_nulls_first() for c in key]], k)
