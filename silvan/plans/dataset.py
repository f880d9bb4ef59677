"""Training and validation data: a frame, the roles of its columns, and the bins that are fitted once."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import BinModel, fit_bins, read_forced_bins
from ..params import Params, resolve
from .blocks import Layout, build
from .shared import cut, drop


class GbtDataset:
    """Lazy: bins and blocks are made when they are first asked for.

    data: a DataFrame, or pandas, Arrow or numpy data. Columns without a role are features. group is a column of query ids;
    order: columns that tell the order of rows in a query (their order decides ties).
    """

    def __init__(self, data: Any, label: str = "label", weight: str | None = None, group: str | None = None, init_score: str | None = None, position: str | None = None, features: list[str] | None = None, categorical: list[str] | str | None = None, row_key: str | None = None, order: list[str] | None = None, ignore: list[str] | None = None, reference: GbtDataset | None = None, params: dict | Params | None = None, spark: SparkSession | None = None):
        self.df = to_frame(data, spark)
        self.label, self.weight, self.group, self.init_score, self.position, self.row_key = label, weight, group, init_score, position, row_key
        self.order = order or ([row_key] if row_key else [])
        self.reference = reference
        self.params = resolve(params)
        roles = {label, weight, group, init_score, position, row_key, *self.order, *(ignore or [])}
        numeric = ("byte", "short", "integer", "long", "float", "double", "boolean", "decimal")
        self.features = features or (reference.features if reference else [f.name for f in self.df.schema.fields if f.name not in roles and f.dataType.typeName() in numeric])
        given = categorical if categorical is not None else self.params.categorical_feature or []
        given = [x.strip() for x in given.split(",") if x.strip()] if isinstance(given, str) else list(given)
        self.categorical = {self.features[int(x)] if str(x).isdigit() else str(x).removeprefix("name:") for x in given} if not reference else reference.categorical
        self._bins: BinModel | None = None
        self._blocks: tuple[DataFrame, Layout] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def bins(self) -> BinModel:
        if self._bins is None:
            self._bins = self.reference.bins if self.reference else fit_bins(self.df, self.features, self.params, self.categorical, read_forced_bins(self.params.forcedbins_filename))
        return self._bins

    def construct(self) -> GbtDataset:
        _ = self.bins
        return self

    def blocks(self, scores: int = 1, raw: bool = False) -> tuple[DataFrame, Layout]:
        """Blocks, with the features' values too if `raw`; written once to the shared folder and kept in memory where there is room."""
        if self._blocks is None or self._blocks[1].scores != scores or raw and not self._blocks[1].raw:
            frame, layout = build(self.df, self.features, self.label, self.bins, self.weight, self.group, self.row_key, self.init_score, self.position, scores, self.order, raw)
            kept, cores = cut(frame), self.spark.sparkContext.defaultParallelism
            if kept.rdd.getNumPartitions() < cores:  # a table of few files or row groups would leave cores idle in every level
                spread = cut(kept.repartition(cores))
                drop(kept)
                kept = spread
            kept = kept.persist()
            layout.parts = kept.rdd.getNumPartitions()
            self._blocks = kept, layout
        return self._blocks

    def create_valid(self, data: Any, **roles: Any) -> GbtDataset:
        """A dataset of other rows with the same columns and bins."""
        own = {"label": self.label, "weight": self.weight, "group": self.group, "init_score": self.init_score, "position": self.position, "row_key": self.row_key, "order": self.order}
        return GbtDataset(data, **{**own, **roles}, reference=self, params=self.params, spark=self.spark)

    def with_frame(self, df: DataFrame, **roles: Any) -> GbtDataset:
        return self.create_valid(df, **roles)

    def subset(self, rows: DataFrame, key: str) -> GbtDataset:
        """The rows whose key is in `rows`; bins stay."""
        return self.create_valid(self.df.join(rows.select(key).distinct(), key, "left_semi"))

    def add_features_from(self, other: DataFrame, key: str) -> GbtDataset:
        """These rows with the columns of another frame of the same keys, and bins of their own."""
        joined = self.df.join(other, key)
        return GbtDataset(joined, self.label, self.weight, self.group, self.init_score, self.position, None, sorted(self.categorical), self.row_key or key, self.order, [key], None, self.params)

    def num_data(self) -> int:
        return self.df.count()

    def num_feature(self) -> int:
        return len(self.features)

    def feature_num_bin(self, feature: int | str) -> int:
        return self.bins.features[self.features.index(feature) if isinstance(feature, str) else feature].bins

    def get_field(self, name: str) -> DataFrame:
        column = {"label": self.label, "weight": self.weight, "group": self.group, "init_score": self.init_score, "position": self.position}[name]
        return self.df.select(F.col(column).alias(name))

    def set_field(self, name: str, column: str | None) -> GbtDataset:
        setattr(self, {"init_score": "init_score"}.get(name, name), column)
        self._blocks = None
        return self

    def save_binary(self, path: str) -> None:
        """Binned rows with their roles as Parquet, and the bins as JSON beside them."""
        roles = [c for c in (self.label, self.weight, self.group, self.init_score, self.position, self.row_key) if c]
        self.bins.transform(self.df).select(*dict.fromkeys([*roles, *self.order]), *self.features).write.mode("overwrite").parquet(f"{path}/rows")
        self.spark.createDataFrame([(self.bins.to_json(),)], "bins string").coalesce(1).write.mode("overwrite").text(f"{path}/bins")

    @staticmethod
    def load_binary(spark: SparkSession, path: str) -> tuple[DataFrame, BinModel]:
        return spark.read.parquet(f"{path}/rows"), BinModel.from_json(spark.read.text(f"{path}/bins").first()[0])

    def dump_text(self, path: str) -> None:
        self.bins.transform(self.df).select(*self.features).write.mode("overwrite").csv(path, header=True)


def to_frame(data: Any, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame of what is given: one already, pandas or Arrow data, an array (columns Column_0...), or a list of these, one below the other."""
    if isinstance(data, DataFrame):
        return data
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, list | tuple):
        first, *rest = [to_frame(d, spark) for d in data]
        for r in rest:
            first = first.unionByName(r)
        return first
    if isinstance(data, np.ndarray):
        data = pd.DataFrame(data, columns=[f"Column_{i}" for i in range(data.shape[1])])
    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    if isinstance(data, pd.DataFrame):
        for c in data.columns:
            if isinstance(data[c].dtype, pd.CategoricalDtype):
                codes = data[c].cat.codes.astype("float64")
                data = data.assign(**{c: codes.where(codes >= 0)})
    if hasattr(data, "__arrow_c_stream__") and not isinstance(data, pd.DataFrame | pa.Table):
        data = pa.table(data)
    return spark.createDataFrame(data)
