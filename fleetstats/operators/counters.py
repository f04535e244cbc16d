"""Rates of cumulative counters between snapshots that follow one another.

Statistics views count up from the last reset. Between two snapshots of a server a counter
has grown by their difference, or, where the reset time changed or the counter fell, by what
it shows now, counted from the reset. A hot server is split by day: the previous snapshot of
a day's first one is carried over from the days before (``plans.carry``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.plans.carry import carried

#: Seconds between two snapshots above which what happened between them is not rated.
MAX_GAP_S = 86_400


def counter_deltas(snapshots: DataFrame, key: Sequence[str], at: str, counters: Sequence[str], reset: str | None = None,
                   tie: Sequence[str] = ()) -> DataFrame:
    """``snapshots`` with, for each counter, its growth since the snapshot before and over how long.

    Adds ``<counter>_delta``, ``<counter>_us`` (microseconds that the growth covers) and
    ``<counter>_reset``; all null at a server's first snapshot with that counter and where the
    counter is null, which the next snapshot then looks past. ``tie`` orders snapshots of equal
    time; a row without a time is left out.
    """
    rows = snapshots.filter(F.col(at).isNotNull()).withColumn("_day", F.to_date(at))
    known = F.col(reset) if reset else F.lit(None).cast("timestamp")
    before = {f"_p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("n"), known.alias("reset")))
              for c in counters}
    rows = carried(rows, key, "_day", [at, *tie], before)
    added = {}
    for c in counters:
        p, now = F.col(f"_p_{c}"), F.col(c)
        pair = p.isNotNull() & now.isNotNull()
        fell = (now < p["n"]) | ~known.eqNullSafe(p["reset"])
        # After a reset that lies between the snapshots, growth is counted from there.
        began = F.when(fell & (known > p["at"]) & (known <= F.col(at)), known).otherwise(p["at"])
        added[f"{c}_delta"] = F.when(pair, F.when(fell, now).otherwise(now - p["n"]))
        added[f"{c}_us"] = F.when(pair, F.unix_micros(at) - F.unix_micros(began))
        added[f"{c}_reset"] = F.when(pair, fell)
    return rows.withColumns(added).drop("_day", *before)


def counter_rates(snapshots: DataFrame, key: Sequence[str], at: str, counters: Sequence[str], reset: str | None = None,
                  tie: Sequence[str] = (), max_gap_s: int = MAX_GAP_S) -> DataFrame:
    """Per server and day: snapshots, and for each counter its growth, resets, gaps and rate a second.

    An interval belongs to the day of its later snapshot. Intervals of more than ``max_gap_s``
    are counted as gaps and neither their growth nor their time enters the rate, which is null
    where no time is covered. One hash aggregate with partial sums.
    """
    rows = counter_deltas(snapshots, key, at, counters, reset, tie)
    aggs = [F.count(F.lit(1)).alias("snapshots")]
    for c in counters:
        rated = F.col(f"{c}_us") <= F.lit(int(max_gap_s) * 1_000_000)
        aggs += [F.sum(F.when(rated, F.col(f"{c}_delta"))).alias(f"{c}_delta"),
                 F.sum(F.when(rated, F.col(f"{c}_us"))).alias(f"_us_{c}"),
                 F.count(F.when(F.col(f"{c}_reset"), F.lit(1))).alias(f"{c}_resets"),
                 F.count(F.when(~rated, F.lit(1))).alias(f"{c}_gaps")]
    daily = rows.groupBy(*key, F.to_date(at).alias("day")).agg(*aggs)
    return daily.select(*key, "day", "snapshots", *[x for c in counters for x in (
        F.col(f"{c}_delta"), F.col(f"{c}_resets"), F.col(f"{c}_gaps"),
        F.round(F.col(f"{c}_delta") / F.nullif(F.col(f"_us_{c}"), F.lit(0)) * F.lit(1_000_000.0), 6).alias(f"{c}_per_s"))])
