"""Trend scores and rankings: live counts against the historical baseline.

The four ways of ranking differ only in their :class:`TrendPolicy`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULTS, Settings
from ..functions import hourly_rate, speed_score, speed_score_of_sums
from .filters import positive_baseline


#: What a baseline may carry besides its quotient; see ``history.baseline_with_sums``.
BASELINE_SUMS = ("baseline_edits", "baseline_hours")


@dataclass(frozen=True)
class TrendPolicy:
    """How counts become ranked rows.

    ``least_edits`` applies before the baseline is joined, so articles that cannot
    qualify never reach the join; ``score`` adds the output columns; ``order``
    gives the ranking keys, to which the title is always added last.
    """

    name: str
    uses_baseline: bool
    least_edits: Callable[[Settings], int]
    score: Callable[[DataFrame, int, Settings], DataFrame]
    order: Callable[[], list[Column]]


def _rate_rows(joined: DataFrame, window_seconds: int, settings: Settings) -> DataFrame:
    rate = hourly_rate(F.col("recent_edits"), window_seconds)
    known = F.col("baseline_edits_per_hour")
    if set(BASELINE_SUMS) <= set(joined.columns):
        speed = speed_score_of_sums(F.col("recent_edits"), window_seconds, *map(F.col, BASELINE_SUMS))
    else:
        speed = speed_score(rate, known)
    return joined.select(
        *_carried(joined),
        "title",
        "recent_edits",
        F.round(rate, 2).alias("current_edits_per_hour"),
        F.round(known, 2).alias("baseline_edits_per_hour"),
        F.round(speed, 2).alias("trend_score"),
        known.isNotNull().alias("baseline_available"),
    )


def _count_rows(counts: DataFrame, window_seconds: int, settings: Settings) -> DataFrame:
    return counts.select(
        *_carried(counts), "title", "recent_edits", F.col("recent_edits").cast("double").alias("trend_score")
    )


def _ratio_rows(joined: DataFrame, window_seconds: int, settings: Settings) -> DataFrame:
    baseline = F.coalesce(F.col("baseline_edits_per_hour"), F.lit(0.0))
    n = F.col("recent_edits")
    comparable = baseline > settings.baseline_floor
    scored = joined.select(
        *_carried(joined),
        "title",
        "recent_edits",
        F.round(baseline, 4).alias("baseline"),
        F.when(comparable, F.round(n.cast("double") / baseline, 4)).otherwise(n.cast("double")).alias("trend_score"),
        comparable.alias("_comparable"),
    )
    by_score = F.col("trend_score") >= settings.score_threshold
    by_count = F.col("recent_edits") > settings.fallback_min_edits
    return scored.where(F.when(F.col("_comparable"), by_score).otherwise(by_count)).drop("_comparable")


def _carried(df: DataFrame) -> list[str]:
    """Window columns, when many windows are ranked at once."""
    return [c for c in ("window_start", "window_end") if c in df.columns]


# Hourly rate over hourly baseline; articles with a baseline come first, the
# others are ranked by rate. The keys are the rounded values of the output.
RATE = TrendPolicy(
    name="rate",
    uses_baseline=True,
    least_edits=lambda s: s.min_edits,
    score=_rate_rows,
    order=lambda: [
        F.desc("baseline_available"),
        F.when(F.col("baseline_available"), F.col("trend_score")).otherwise(F.col("current_edits_per_hour")).desc(),
        F.desc("recent_edits"),
    ],
)

# The same numbers without a minimum number of edits.
RATE_ALL = TrendPolicy(
    name="rate_all",
    uses_baseline=True,
    least_edits=lambda s: 1,
    score=_rate_rows,
    order=lambda: [
        F.desc("baseline_available"),
        F.coalesce(F.col("trend_score"), F.lit(-1.0)).desc(),
        F.desc("current_edits_per_hour"),
    ],
)

# The plain count as score, strictly above the minimum.
COUNT = TrendPolicy(
    name="count",
    uses_baseline=False,
    least_edits=lambda s: s.min_edits + 1,
    score=_count_rows,
    order=lambda: [F.desc("trend_score")],
)

# Edits in the window over the hourly baseline, with a count rule where the
# baseline is missing or too small to divide by.
RATIO = TrendPolicy(
    name="ratio",
    uses_baseline=True,
    least_edits=lambda s: 1,
    score=_ratio_rows,
    order=lambda: [F.desc("trend_score")],
)

POLICIES = {p.name: p for p in (RATE, RATE_ALL, COUNT, RATIO)}


def score(
    counts: DataFrame,
    baseline: DataFrame | None,
    window_seconds: int,
    policy: TrendPolicy = RATE,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Candidate rows with their scores, unranked.

    ``counts`` holds (title, recent_edits) and may carry window columns. The
    join gets no broadcast hint: the baseline grows with the number of articles,
    so its size decides at run time.
    """
    least = policy.least_edits(settings)
    candidates = counts.where(F.col("recent_edits") >= least) if least > 1 else counts
    if policy.uses_baseline:
        if baseline is None:
            candidates = candidates.withColumn("baseline_edits_per_hour", F.lit(None).cast("double"))
        else:
            sums = [c for c in BASELINE_SUMS if c in baseline.columns]
            usable = positive_baseline(baseline).select("title", "baseline_edits_per_hour", *sums)
            candidates = candidates.join(usable, "title", "left")
    return policy.score(candidates, window_seconds, settings)


def rank(
    scored: DataFrame,
    policy: TrendPolicy = RATE,
    top_n: int = DEFAULTS.trending_top_n,
    per: Sequence[str] = (),
) -> DataFrame:
    """The best ``top_n`` rows with their ``rank``, overall or per window.

    Per window the bound on the row number lets Spark cut each task's share of a
    window to ``top_n`` rows before the shuffle.
    """
    keys = [*policy.order(), F.asc("title")]
    if per:
        numbered = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*keys)))
        return numbered.where(F.col("rank") <= top_n)
    best = scored.orderBy(*keys).limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def trending(
    counts: DataFrame,
    baseline: DataFrame | None,
    window_seconds: int = DEFAULTS.window_seconds,
    policy: TrendPolicy = RATE,
    settings: Settings = DEFAULTS,
    top_n: int | None = None,
    per: Sequence[str] = (),
) -> DataFrame:
    scored = score(counts, baseline, window_seconds, policy, settings)
    return rank(scored, policy, settings.trending_top_n if top_n is None else top_n, per)
