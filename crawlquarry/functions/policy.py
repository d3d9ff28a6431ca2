"""Numeric rules of scheduling as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_BASE_SECONDS, RETRY_MOST_SECONDS = 30.0, 1800.0
HOST_BASE_SECONDS, HOST_MOST_SECONDS = 30.0, 600.0
LEAST_SCORE, SCORE_DECAY = 0.25, 0.6
EWMA_ALPHA = 0.2


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(x: Column) -> Column:
    """Two decimals, half away from zero after a nudge below the float error, alike in every engine."""
    return F.floor(x * 100 + F.lit(0.5 + 1e-9)) / 100


def latency_penalty(ewma) -> Column:
    x = F.coalesce(_c(ewma), F.lit(0.0))
    return F.when(x >= 1000, 3).when(x >= 400, 2).when(x >= 150, 1).otherwise(0)


def execution_tier(failures, ewma, success_count, robots_checked_at) -> Column:
    """0 warm, 1 probing, 2 slow, 3 deferred."""
    f, x = F.coalesce(_c(failures), F.lit(0)), F.coalesce(_c(ewma), F.lit(0.0))
    return (
        F.when((f >= 4) | (x >= 5000), 3).when((f >= 2) | (x >= 1000), 2)
        .when((F.coalesce(_c(success_count), F.lit(0)) > 0) | (F.coalesce(_c(robots_checked_at), F.lit(0.0)) > 0), 0).otherwise(1)
    )


def host_budget(failures, ewma, default: int = 1, fast_ms: float = 150.0, fast_budget: int = 2) -> Column:
    f, x = F.coalesce(_c(failures), F.lit(0)), F.coalesce(_c(ewma), F.lit(0.0))
    return F.when(f > 0, 1).when((x > 0) & (x <= fast_ms), max(default, fast_budget, 1)).otherwise(max(1, default))


def low_value_host(failures, robots_status, failure_count, success_count) -> Column:
    return (
        (F.coalesce(_c(failures), F.lit(0)) >= 4)
        | F.coalesce(_c(robots_status).isin("denied", "disallowed"), F.lit(False))
        | ((F.coalesce(_c(failure_count), F.lit(0)) >= 3) & (F.coalesce(_c(success_count), F.lit(0)) == 0))
    )


def retry_backoff(streak, base: float = RETRY_BASE_SECONDS, most: float = RETRY_MOST_SECONDS) -> Column:
    s = F.least(F.greatest(_c(streak), F.lit(1)), F.lit(40))
    return F.when(_c(streak) <= 1, F.lit(base)).otherwise(F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), s - 1)))


def retry_score(value, streak) -> Column:
    return F.when(_c(streak) <= 0, _c(value)).otherwise(F.greatest(F.lit(LEAST_SCORE), round2(_c(value) * F.pow(F.lit(SCORE_DECAY), _c(streak)))))


def host_backoff(failures) -> Column:
    f = F.least(F.greatest(_c(failures), F.lit(1)), F.lit(40))
    return F.when(_c(failures) <= 0, 0.0).otherwise(F.least(F.lit(HOST_MOST_SECONDS), F.lit(HOST_BASE_SECONDS) * F.pow(F.lit(2.0), f - 1)))


def runnable_at(next_fetch, next_request, backoff) -> Column:
    return F.greatest(_c(next_fetch), F.coalesce(_c(next_request), F.lit(0.0)), F.coalesce(_c(backoff), F.lit(0.0)))


def ewma_fold(values: Column, alpha: float = EWMA_ALPHA) -> Column:
    """Fold of an ordered array of samples; the first sample (or any while the mean isn't positive) seeds it."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: F.when(a <= 0, v).otherwise(F.lit(1 - alpha) * a + F.lit(alpha) * v))


def outcome(status, error) -> Column:
    """What a fetch leads to: done, terminal, retry."""
    s, e = _c(status), _c(error)
    return (
        F.when(e.isin("timeout", "connection_error"), "retry").when(s.isin(401, 403), "terminal").when(s.between(500, 599), "retry")
        .when(s.between(400, 499), "done").when(s.isNull(), "retry").otherwise("done")
    )
