"""Tree learners on Spark ML; trees grow level by level from binned aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.stats import class_index, classes
from tabloom.operators.base import register
from tabloom.operators.gradient import ONE_TASK, Plan, boosted_shares, fit_boosting
from tabloom.operators.grow import LOCAL_ROWS, Grower, Rule, with_shares
from tabloom.operators.learner import Classifier, Regressor, roles_of
from tabloom.session import cut_lineage

DEEP = 30  # the deepest tree Spark ML grows
VEC, IDX = "__vec", "__idx"


def vector(t: Table, value: Callable[[str], Column] | None = None) -> Column:
    return array_to_vector(F.array(*[(value or t.number)(n) for n in t.features]))


def indexed(t: Table, labels: list, value: Callable[[str], Column] | None = None) -> DataFrame:
    """(features vector, class index) for Spark ML."""
    return t.df.select(vector(t, value).alias(VEC), class_index(t, labels).cast("double").alias(IDX)).where(
        F.col(IDX).isNotNull()
    )


class _MlClassifier(Classifier):
    """One Spark ML model whose probability vector becomes the output columns."""

    def estimator(self, classes_: int, features: int):
        raise NotImplementedError

    def value(self, t: Table, n: str) -> Column:
        return t.number(n)

    def learn(self, t):
        labels = classes(t)
        # Split finding, metadata and growing each read the vectors; the source is read once.
        data = indexed(t, labels, lambda n: self.value(t, n)).persist()
        try:
            return {"labels": labels, "model": self.estimator(len(labels), len(t.features)).fit(data)}
        finally:
            data.unpersist()

    def apply(self, t, state):
        wide = t.df.withColumn(VEC, vector(t, lambda n: self.value(t, n)))
        model = state["model"]
        scored = model.transform(wide)
        p = vector_to_array(F.col(model.getProbabilityCol()))
        labels = state["labels"]
        return self.outputs(replace(t, df=scored.withColumn("__prob", p)), labels, [F.get("__prob", F.lit(i)) for i in range(len(labels))])


def ml_roles(estimator, seed: int):
    estimator = estimator.setFeaturesCol(VEC).setLabelCol(IDX).setSeed(seed)
    return estimator.setPredictionCol("__mlp").setProbabilityCol("__mlq").setRawPredictionCol("__mlr")


@register
class RandomForest(_MlClassifier):
    """10 bootstrapped trees, square-root feature subsets."""

    name = "clf_random_forest"
    title = "RF_classifier"
    trees, subset, bootstrap = 10, "sqrt", True

    def estimator(self, classes_, features):
        forest = RandomForestClassifier(
            numTrees=self.params.get("trees", self.trees),
            maxDepth=self.params.get("depth", DEEP),
            featureSubsetStrategy=self.subset,
            bootstrap=self.bootstrap,
        )
        return ml_roles(forest, self.params.get("seed", 0))


@register
class Bagging(RandomForest):
    """10 bootstrapped trees over all features."""

    name = "clf_bagging"
    title = "BaggingClassifier"
    subset = "all"


@register
class DecisionTree(_MlClassifier):
    name = "clf_decision_tree"
    title = "DecisionTreeClassifier"

    def estimator(self, classes_, features):
        tree = DecisionTreeClassifier(
            maxDepth=self.params.get("depth", DEEP), impurity=self.params.get("impurity", "gini")
        )
        return ml_roles(tree, self.params.get("seed", 0))


@register
class ExtraTrees(Classifier):
    """Extremely random trees: a node draws a cut from its own range for each of its features, no bootstrap.

    ``depth`` bounds the trees as in the other forests; the state is plain JSON, which names a folder if the forest is large.
    """

    name = "clf_extra_trees"
    title = "ExtraTreesClassifier"

    def learn(self, t):
        labels = classes(t)
        p = len(t.features)
        rule = Rule(len(labels), p, max(1, int(p**0.5)), self.params.get("seed", 0), True, self.params.get("depth", DEEP))
        rows = t.df.select(F.array(*[t.number(n) for n in t.features]).alias("x"), class_index(t, labels).cast("int").alias("y"))
        rows = cut_lineage(rows.where("y IS NOT NULL"))
        return {"labels": labels} | Grower(rows, self.params.get("trees", 10), rule, self.params.get("local_rows", LOCAL_ROWS)).state()

    def apply(self, t, state):
        scored = replace(t, df=with_shares(t.df, state, [t.number(n) for n in t.features], [c(n) for n in roles_of(t)]))
        return self.outputs(scored, state["labels"], [F.get("__prob", F.lit(i)) for i in range(len(state["labels"]))])


class _Boosted(Classifier):
    """Gradient boosted trees of all classes; parameters rounds, depth, leaves, rate and one_task override the plan."""

    plan = Plan()

    def learn(self, t):
        given = {k: self.params[k] for k in ("rounds", "depth", "leaves", "rate", "penalty") if k in self.params}
        return fit_boosting(t, classes(t), replace(self.plan, **given), self.params.get("one_task", ONE_TASK))

    def apply(self, t, state):
        scored = replace(t, df=t.df.withColumn("__prob", boosted_shares(state, [t.number(n) for n in t.features])))
        return self.outputs(scored, state["labels"], [F.get("__prob", F.lit(i)) for i in range(len(state["labels"]))])


@register
class GradientBoosting(_Boosted):
    """100 rounds of trees of depth 3."""

    name = "clf_gradient_boosting"
    title = "GradientBoostingClassifier"


@register
class XgbLike(_Boosted):
    """Penalised steps; missing values go to the side that each node has learned."""

    name = "clf_xgb"
    title = "XGBClassifier"
    contract = "xgb"
    plan = Plan(penalty=1.0, least_curvature=1.0)


@register
class LightGbmLike(_Boosted):
    """Trees of 31 leaves, grown best leaf first, with 20 rows or more each."""

    name = "clf_lightgbm"
    title = "LGBMClassifier"
    plan = Plan(depth=None, leaves=31, least_rows=20, least_curvature=1e-3)


class _MlRegressor(Regressor):
    def estimator(self):
        raise NotImplementedError

    def learn(self, t):
        data = t.df.select(vector(t).alias(VEC), t.number(t.label).alias(IDX)).persist()
        try:
            model = self.estimator().setFeaturesCol(VEC).setLabelCol(IDX).setPredictionCol("__mlp").fit(data)
        finally:
            data.unpersist()
        return {"model": model}

    def apply(self, t, state):
        scored = state["model"].transform(t.df.withColumn(VEC, vector(t)))
        return self.outputs(replace(t, df=scored), F.col("__mlp"))


@register
class BaggingRegressor(_MlRegressor):
    name = "reg_bagging"
    title = "BaggingRegressor"

    def estimator(self):
        return RandomForestRegressor(
            numTrees=10, maxDepth=self.params.get("depth", 20), featureSubsetStrategy="all", seed=self.params.get("seed", 0)
        )
