"""A loop of observations with a budget of failures."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.operators import reports
from crawlquarry.sources.stores import ObservationLog


class BudgetSpent(RuntimeError):
    """Too many observations in a row had failing sections."""


def observe(sections: Callable[[], dict[str, Callable[[], DataFrame]]], log: ObservationLog, rounds: int, budget: int = 3, wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[list[str]]:
    """Failed sections of each of ``rounds`` observations, each appended to ``log``.

    ``sections`` gives the reports of one moment. Whatever can be worked out is logged, with the
    names of what couldn't; after more than ``budget`` rounds in a row with a failure the loop ends.
    """
    outcomes: list[list[str]] = []
    row = 0
    for i in range(rounds):
        done, failed = reports.safely(sections())
        lost = log.spark.createDataFrame([(name, None) for name in failed], "section string, json string")
        log.append((lost if done is None else done.unionByName(lost)).withColumn("round", F.lit(i)))
        outcomes.append(failed)
        row = row + 1 if failed else 0
        if row > budget:
            raise BudgetSpent(f"{row} observations in a row failed: {', '.join(failed)}")
        if wait and i + 1 < rounds:
            sleep(wait)
    return outcomes
