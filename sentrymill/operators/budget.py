"""Submissions within a budget: candidates are taken in order until so many of them had something new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def share_plan(candidates: DataFrame, indicators: DataFrame, ledger: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """Each candidate with what happens to it: (key, action, fresh, slot).

    ``candidates``: ``key``, ``ok`` (vetted), ``reason`` and what ``order`` needs; ``indicators``: (key, value); ``ledger``: (value)
    of what was submitted before. A candidate takes a slot if it is vetted and has an indicator that is not in the ledger.
    Candidates are examined in order until ``budget`` slots are taken (0: no bound): ``submit``, or ``skip`` with its reason; the
    rest is ``unexamined``. Slots are counted over ranges of the order, so no task sees all candidates."""
    new = indicators.select(key, "value").distinct().join(ledger.select("value").distinct(), "value", "left_anti").groupBy(key).agg(F.count("*").alias("fresh"))
    rows = candidates.join(new, key, "left").withColumn("fresh", F.when(F.col("ok"), F.coalesce("fresh", F.lit(0))).otherwise(0).cast("long"))
    rows = rows.withColumn("_slot", (F.col("fresh") > 0).cast("long"))
    got = running(rows, [], [*order, F.col(key)], {"slot": "_slot"})
    past = (F.col("slot") - F.col("_slot") >= budget) if budget > 0 else F.lit(False)
    action = F.when(past, "unexamined").when(F.col("_slot") == 1, "submit").otherwise("skip")
    reason = F.when(past | (F.col("_slot") == 1), "").when(~F.col("ok"), F.col("reason")).otherwise("all indicators already submitted")
    return got.select(key, action.alias("action"), reason.alias("reason"), "fresh", F.when(action == "submit", F.col("slot")).alias("slot"))
