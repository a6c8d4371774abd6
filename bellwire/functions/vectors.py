"""Array-of-number functions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bellwire.functions.numbers import relu


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def append_scalars(vec: Column, scalars: Sequence[Column]) -> Column:
    """Vector followed by scalars, as one array of doubles."""
    return F.concat(vec.cast("array<double>"), F.array(*[s.cast("double") for s in scalars]))


def split_vector(vec: Column, tail: int) -> tuple[Column, Column]:
    """(all but the last ``tail`` elements, the last ``tail`` elements)."""
    return F.slice(vec, F.lit(1), F.size(vec) - tail), F.slice(vec, F.size(vec) - tail + 1, F.lit(tail))


def linear(vec: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Dense layer with given weights: one output per weight row."""
    return F.array(
        *[
            dot(vec, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b))
            for row, b in zip(weights, bias)
        ]
    )


def relu_all(vec: Column) -> Column:
    return F.transform(vec, relu)


def softmax(logits: Column) -> Column:
    """Softmax over one array, shifted by its maximum."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x))


def pick_by_label(values: Column, id2label: dict[int, str], label: str) -> Column:
    """Element of ``values`` at the index whose label matches, ignoring case."""
    index = {name.lower(): i for i, name in id2label.items()}[label.lower()]
    return F.element_at(values, index + 1)
