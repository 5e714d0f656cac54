"""Products of features."""

from __future__ import annotations

from pyspark.sql import Column

from tabloom.frame import Table
from tabloom.operators.base import Operator, register


class _Products(Operator):
    family = "feature engineering"
    contract = "c_t"
    squares = False

    def columns(self, t: Table, state: dict) -> dict[str, Column]:
        out = {n: t.number(n) for n in t.features}
        for i, a in enumerate(t.features):
            for b in t.features[i:]:
                if a == b and not self.squares:
                    continue
                name = f"{a}^2" if a == b else f"{a} {b}"
                out.setdefault(name, t.number(a) * t.number(b))
        return out


@register
class PolynomialFeatures(_Products):
    """Features, squares and pairwise products, without a constant."""

    name = "polynomial_features"
    squares = True


@register
class InteractionFeatures(_Products):
    """Features and products of distinct pairs."""

    name = "interaction_features"
