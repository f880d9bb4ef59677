"""Estimators in the manner of pyspark.ml, and with scikit-learn's names for parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.dataset import GbtDataset
from .plans.engine import train
from .plans.model import GbtModel


class GbtModelTransformer(Model):
    """Adds predictions. classes: what class numbers stand for."""

    def __init__(self, model: GbtModel, output: str, classes: list[Any] | None = None):
        super().__init__()
        self.model, self.output, self.classes = model, output, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.classes is None:
            return self.model.predict(dataset, output=self.output)
        scored = self.model.predict(dataset, output="probability")
        number = F.when(F.col("probability") > 0.5, 1).otherwise(0) if self.model.k == 1 else (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
        return scored.withColumn(self.output, F.element_at(F.array(*[F.lit(c) for c in self.classes]), number + 1))


class GbtEstimator(Estimator):
    """fit() trains on the numeric columns of a frame that have no role."""

    objective = "regression"

    def __init__(self, label: str = "label", weight: str | None = None, group: str | None = None, categorical: list[str] | None = None, order: list[str] | None = None, output: str = "prediction", valid: DataFrame | None = None, class_weight: dict | str | None = None, eval_metric: Callable | None = None, callbacks: list[Callable] = (), **params: Any):
        super().__init__()
        self.label, self.weight, self.group, self.categorical, self.order, self.output, self.valid, self.class_weight = label, weight, group, categorical, order, output, valid, class_weight
        self.eval_metric, self.callbacks, self.settings = eval_metric, list(callbacks), {"objective": self.objective, **params}

    def _prepare(self, df: DataFrame) -> tuple[DataFrame, list[Any] | None, dict]:
        return df, None, self.settings

    def _fit(self, dataset: DataFrame) -> GbtModelTransformer:
        df, classes, params = self._prepare(dataset)
        weight = self.weight
        if self.class_weight:
            factor = self._factors(df, classes)
            own = F.element_at(F.array(*[F.lit(float(f)) for f in factor]), F.col(self.label).cast("int") + 1)
            df, weight = df.withColumn("class_weight", own * (F.col(self.weight) if self.weight else F.lit(1.0))), "class_weight"
            ignore = [self.weight] if self.weight else []
        else:
            ignore = []
        data = GbtDataset(df, self.label, weight, self.group, categorical=self.categorical, order=self.order, ignore=ignore, params=params)
        valid = [data.create_valid(self._coded(self.valid, classes), weight=self.weight)] if self.valid is not None else []
        return GbtModelTransformer(train(params, data, valid_sets=valid, feval=self.eval_metric, callbacks=self.callbacks), self.output, classes)

    def _factors(self, df: DataFrame, classes: list[Any]) -> list[float]:
        if self.class_weight != "balanced":
            return [float(self.class_weight.get(c, 1.0)) for c in classes]
        counts = {r[0]: r[1] for r in df.groupBy(F.col(self.label).cast("int")).count().collect()}
        total = sum(counts.values())
        return [total / (len(classes) * counts.get(i, 1)) for i in range(len(classes))]

    def _coded(self, df: DataFrame, classes: list[Any] | None) -> DataFrame:
        if classes is None:
            return df
        return df.withColumn(self.label, (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(self.label)) - 1).cast("double"))


class GbtRegressor(GbtEstimator):
    objective = "regression"


class GbtClassifier(GbtEstimator):
    """Labels may be of any type; their sorted distinct values are the classes."""

    objective = "binary"

    def _prepare(self, df: DataFrame) -> tuple[DataFrame, list[Any], dict]:
        classes = [r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().orderBy(self.label).collect()]
        params = dict(self.settings)
        if len(classes) > 2:
            params |= {"num_class": len(classes), "objective": params["objective"] if params["objective"] in ("multiclass", "multiclassova") else "multiclass"}
        return self._coded(df, classes), classes, params


class GbtRanker(GbtEstimator):
    objective = "lambdarank"
