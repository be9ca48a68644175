"""Balancing of a stream of verdicts.

The balancer keeps a row with probability (rows so far of the rarest verdict) / (rows so far of its own), one over the
latter until every verdict was seen. "So far" is counted in two steps, as a type can hold a large share of all rows:
totals by hour, accumulated over the few hours, then ranks within an hour. The coin is a digest of the row's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .generators import _u, uniform


def keep_odds(rows: DataFrame, kind: str, verdict: str, order: list[str], slot: str, allowed: list) -> DataFrame:
    """``rows`` with ``odds``. slot: a column that rises with the order and cuts it into stretches one task can sort."""
    each = [F.count_if(F.col(verdict) == F.lit(a)) for a in allowed]
    totals = rows.groupBy(kind, slot).agg(*(e.alias(f"_t{i}") for i, e in enumerate(each)))
    before = Window.partitionBy(kind).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(kind, slot, *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(allowed))))
    within = Window.partitionBy(kind, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.join(totals, [kind, slot]).select("*", *((F.col(f"_b{i}") + e.over(within)).alias(f"_n{i}") for i, e in enumerate(each)))
    least = F.least(*(F.col(f"_n{i}") for i in range(len(allowed))))
    own = F.coalesce(*(F.when(F.col(verdict) == F.lit(a), F.col(f"_n{i}")) for i, a in enumerate(allowed)))
    odds = F.when(own.isNull(), 1.0).otherwise(F.greatest(least, F.lit(1)) / own)
    return r.select(*rows.columns, odds.alias("odds"))


@query("""WITH e AS (SELECT event_id, event_type AS kind, ts, CASE WHEN value < 20 THEN 'low' ELSE 'high' END AS verdict FROM events),
    n AS (SELECT *, count(*) FILTER (verdict = 'low') OVER w AS lo, count(*) FILTER (verdict = 'high') OVER w AS hi FROM e WINDOW w AS (PARTITION BY kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, greatest(least(lo, hi), 1) / (CASE verdict WHEN 'low' THEN lo ELSE hi END)::DOUBLE AS odds FROM n)
    SELECT event_id, kind, verdict, round(odds, 6) AS odds FROM o WHERE """ + _u("coin", "event_id") + " <= odds")
def coin_flip_keep(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "ts", F.when(F.col("value") < 20, "low").otherwise("high").alias("verdict"), F.date_trunc("hour", "ts").alias("hour"))
    r = keep_odds(e, "kind", "verdict", ["ts", "event_id"], "hour", ["low", "high"])
    return r.where(uniform("coin", "event_id") <= F.col("odds")).select("event_id", "kind", "verdict", rnd("odds", 6).alias("odds"))
