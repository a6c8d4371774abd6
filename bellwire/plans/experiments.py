"""The experiment matrix: scorers x variants x model families into one metrics table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from bellwire.operators.features import select_source_columns
from bellwire.plans.models import Fitted, fit_family
from bellwire.plans.parallel import run_side_by_side

# The sentiment columns the runs are made for, by scorer.
SCORERS = {
    "lm": "avg_sentiment_lm",
    "finbert": "avg_sentiment_finbert",
    "gpt4o": "avg_sentiment_llm_gpt4o",
    "gpt41mini": "avg_sentiment_llm_gpt41mini",
    "gpt41mini_market": "avg_sentiment_llm_gpt41mini_market",
}


@dataclass(frozen=True)
class Run:
    family: str
    variant: str  # baseline, consolidated or sources
    scorer: str = ""


def matrix(families: Sequence[str] = ("lr", "rf", "gbt"), scorers: Sequence[str] = tuple(SCORERS)) -> list[Run]:
    """One baseline per family, then every scorer consolidated and by source."""
    runs = [Run(f, "baseline") for f in families]
    return runs + [Run(f, v, s) for f in families for s in scorers for v in ("consolidated", "sources")]


def run_one(daily: DataFrame, run: Run, sources: Sequence[str], scorers: dict[str, str] = SCORERS, **options) -> Fitted:
    sentiment: list[str] = []
    if run.variant == "consolidated":
        sentiment = [scorers[run.scorer]]
    elif run.variant == "sources":
        sentiment = select_source_columns(daily.columns, scorers[run.scorer], sources)
    return fit_family(daily, run.family, run.variant, sentiment, **options)


def run_matrix(
    daily: DataFrame,
    runs: Sequence[Run],
    sources: Sequence[str],
    scorers: dict[str, str] = SCORERS,
    options: dict[str, dict] | None = None,
    parallel_runs: int = 8,
    **common,
) -> DataFrame:
    """Metrics of every run: family, variant, scorer, n, accuracy, log_loss, auc.

    ``options`` holds extra settings per family, such as a grid. Runs are independent Spark jobs and
    go side by side; each hands back one row.
    """

    def job(run: Run) -> tuple:
        fitted = run_one(daily, run, sources, scorers, **{**common, **(options or {}).get(run.family, {})})
        m = fitted.metrics().first()
        fitted.release()
        return (run.family, run.variant, run.scorer, m["n"], m["accuracy"], m["log_loss"], m["auc"])

    rows = run_side_by_side(daily.sparkSession, [lambda r=r: job(r) for r in runs], parallel_runs)
    schema = "family string, variant string, scorer string, n long, accuracy double, log_loss double, auc double"
    return daily.sparkSession.createDataFrame(rows, schema)
