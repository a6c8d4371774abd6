"""Saved models that hold their whole preparation, so raw daily rows go in."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from bellwire.operators.features import FeatureSpec, lag_names


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _filled(column: str, mean: float | None) -> str:
    """The column as a number, junk and NaN as NULL, and NULL as the learnt mean."""
    other = "cast(NULL as double)" if mean is None else f"{float(mean)!r}D"
    return f"coalesce(nanvl(try_cast({_name(column)} as double), cast(NULL as double)), {other}) AS {_name(column)}"


def preparation(spec: FeatureSpec, means: dict[str, float | None]) -> SQLTransformer:
    """The feature step as a stage: lags, dropped or filled gaps, interactions.

    Lags look back over the days that training kept, those with ``increase`` (and a return, where lags come from
    returns). A day without them, as the coming one, is kept and gets the returns of the last such days. The
    means are literals, so nothing is learnt again from the rows that are scored.
    """
    if spec.lags_from == "returns":
        kept, value = "increase IS NOT NULL AND daily_return IS NOT NULL", "daily_return"
    else:
        opened, closed = (f"nanvl(try_cast({c} as double), cast(NULL as double))" for c in ("open_price", "close_price"))
        kept, value = "increase IS NOT NULL", f"try_divide({closed} - {opened}, {opened})"
    lags = lag_names(spec.n_lags)
    # The struct is never NULL on a day that counts, so a missing return there is met, not skipped.
    looked_up = [
        f"lag(CASE WHEN {kept} THEN named_struct('r', {value}) END, {k}) IGNORE NULLS OVER (ORDER BY trade_date).r AS {_name(n)}"
        for k, n in enumerate(lags, 1)
    ]
    rows = f"SELECT *, {', '.join(looked_up)} FROM __THIS__"
    if spec.lag_nulls == "drop":
        rows = f"SELECT * FROM ({rows}) WHERE {' AND '.join(f'{_name(n)} IS NOT NULL' for n in lags)}"
    if means:
        filled = ", ".join(_filled(c, m) for c, m in means.items())
        rows = f"SELECT * EXCEPT ({', '.join(map(_name, means))}), {filled} FROM ({rows})"
    if spec.with_interactions:
        pairs = [(s, r) for s in spec.sentiment for r in lags] + list(combinations(lags, 2))
        products = ", ".join(f"{_name(a)} * {_name(b)} AS {_name(f'{a}*{b}')}" for a, b in pairs)
        rows = f"SELECT *, {products} FROM ({rows})"
    return SQLTransformer(statement=rows)


def whole_pipeline(spec: FeatureSpec, means: dict[str, float | None], pipeline: PipelineModel) -> PipelineModel:
    return PipelineModel([preparation(spec, means), *pipeline.stages])
