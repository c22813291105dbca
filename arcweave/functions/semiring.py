"""Path algebra: how weights combine along a path.  Paths compete by the larger proximity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist_to_sim(x: Column) -> Column:
    """Similarity of a distance: 1 / (x + 1)."""
    return F.lit(1.0) / (x + F.lit(1.0))


def sim_to_dist(w: Column) -> Column:
    """Distance of a similarity in (0, 1]: 1 / w - 1, and the whole number next to it if they differ by no more than the division's rounding.

    Degree weights so give whole numbers, whose sums are exact; no other distance changes.
    """
    inverse = F.lit(1.0) / w
    whole = F.round(inverse)
    return F.when(F.abs(inverse - whole) <= F.lit(1e-15) * inverse, whole).otherwise(inverse) - F.lit(1.0)


def dombi(a: Column, b: Column, checked: bool = True) -> Column:
    """Dombi's t-norm (lambda 1): ab / (a + b - ab), 0 for two zeros; checked: an error outside [0, 1]."""
    value = F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(a * b / (a + b - a * b))
    if not checked:
        return value
    inside = a.between(0, 1) & b.between(0, 1)
    return F.when(inside, value).otherwise(F.raise_error(F.lit("dombi: arguments must lie in [0, 1]")).cast("double"))


@dataclass(frozen=True)
class Semiring:
    """The search minimises a cost: of() turns a weight into one, add() extends a path, back() gives the proximity."""

    name: str
    start: float
    of: Callable[[Column], Column]
    add: Callable[[Column, Column], Column]
    back: Callable[[Column], Column]


ULTRAMETRIC = Semiring("ultrametric", -1.0, lambda w: -w, F.greatest, lambda c: -c)
METRIC = Semiring("metric", 0.0, sim_to_dist, lambda a, b: a + b, dist_to_sim)
KINDS = {s.name: s for s in (ULTRAMETRIC, METRIC)}


def kind_of(kind: str) -> Semiring:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind!r}; one of {sorted(KINDS)}")
    return KINDS[kind]
