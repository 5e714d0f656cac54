"""Combiners of class probability columns: voting and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.stats import classes
from tabloom.operators.base import register
from tabloom.operators.boosting import AdaBoost
from tabloom.operators.learner import Classifier
from tabloom.operators.prepare import sanitize_name
from tabloom.operators.trees import BaggingRegressor, ExtraTrees, GradientBoosting, RandomForest, XgbLike


@register
class MajorityVote(Classifier):
    """Mean probability per class over all learners; the first class wins ties.

    A column belongs to the class its name starts with, so label ``1`` does not
    pick up the columns of label ``10``.
    """

    name = "ens_majority_vote"
    family = "ensemble"
    contract = "c_majority"
    title = "MajorityVoting"

    def learn(self, t):
        labels = classes(t)
        found = {}
        for v in labels:
            prefixes = (f"{v}_", sanitize_name(f"{v}") + "_")
            found[str(v)] = [n for n in t.features if n.startswith(prefixes)]
        return {"labels": labels, "columns": found}

    def apply(self, t, state):
        means = []
        for v in state["labels"]:
            names = state["columns"][str(v)]
            total = F.lit(0.0)
            for n in names:
                total = total + t.number(n)
            means.append(total / max(len(names), 1))
        return self.outputs(t, state["labels"], means)


@register
class StackedForest(RandomForest):
    name = "ens_random_forest"
    family = "ensemble"
    title = "RandomForestMeta"


@register
class StackedAdaBoost(AdaBoost):
    name = "ens_adaboost"
    family = "ensemble"
    title = "AdaBoostClassifierMeta"


@register
class StackedExtraTrees(ExtraTrees):
    name = "ens_extra_trees"
    family = "ensemble"
    title = "ExtraTreesMetaClassifier"


@register
class StackedBoosting(GradientBoosting):
    name = "ens_gradient_boosting"
    family = "ensemble"
    title = "GradientBoostingClassifierMeta"


@register
class StackedXgb(XgbLike):
    name = "ens_xgb"
    family = "ensemble"
    title = "XGBClassifierMeta"


@register
class StackedForestRegressor(BaggingRegressor):
    name = "ens_random_forest_regressor"
    family = "ensemble"
    title = "RandomForestRegressorMeta"
