"""What equal tokens give away: the order of frequencies.

An observer counts tokens as events come. Recovery of the most frequent entity at an event means that its running count is strictly above all others; recovery of the first three, that the three counts are strictly falling and the third is above all the rest. The known order of entities is the yardstick.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative shares in hundredths of the six entities.
BOUNDS = (40, 65, 80, 90, 96, 100)


def bucket(draw, bounds=BOUNDS):
    """The first place whose bound is above the draw; null beyond the last."""
    found = F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        found = F.when(draw < bounds[i], F.lit(i)).otherwise(found)
    return found


def recovery(events: DataFrame, entities: int = 6, top: int = 3) -> DataFrame:
    """trial, event, top1, top3 for rows (trial, event, entity): running counts in each trial, and whether they recover the order. Work is split by trial."""
    w = Window.partitionBy("trial").orderBy("event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.select("trial", "event", *[F.sum(F.when(F.col("entity") == i, 1).otherwise(0)).over(w).alias(f"c{i}") for i in range(entities)])

    def rest(k):
        cols = [F.col(f"c{i}") for i in range(k, entities)]
        return F.greatest(*cols) if len(cols) > 1 else cols[0]

    first = F.col("c0") > rest(1)
    falling = [F.col(f"c{i}") > F.col(f"c{i + 1}") for i in range(top - 1)]
    return run.select("trial", "event", first.alias("top1"), reduce(lambda a, b: a & b, [*falling, F.col(f"c{top - 1}") > rest(top)]).alias("top3"))


def stable(by_event: DataFrame, need: int, n_events: int, kinds: tuple[str, ...] = ("successes",)) -> DataFrame:
    """For rows (event, a column of successes for each of `kinds`) the earliest event, from 1, from which successes stay at `need` or more to the end; n_events if there is none. One row: kind, stable_from for each kind. It is the event after the last that falls short, so one aggregate tells all kinds."""
    last = [F.coalesce(F.max(F.when(F.col(k) < need, F.col("event"))) + 1, F.lit(0)).cast("bigint").alias(k) for k in kinds]
    found = by_event.agg(*last, F.coalesce(F.max("event") + 1, F.lit(0)).cast("bigint").alias("__end"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col(k) >= F.col("__end"), F.lit(n_events)).otherwise(F.col(k) + 1).cast("bigint").alias("stable_from")) for k in kinds])
    return found.select(F.explode(each).alias("s")).select("s.*")


def rank_recovery(events: DataFrame, trials: int, n_events: int, confidence: float = 0.95) -> DataFrame:
    """kind (top1, top3), stable_from: observations after which the share of trials that recover the order stays at the confidence."""
    need = -(-int(confidence * 1000) * trials // 1000)
    each = recovery(events).groupBy("event").agg(F.count_if("top1").alias("top1"), F.count_if("top3").alias("top3"))
    return stable(each, need, n_events, ("top1", "top3"))
