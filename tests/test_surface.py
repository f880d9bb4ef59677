import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvan import cli, ml
from silvan.operators import encoding
from silvan.operators.oblique import ObliquePool
from silvan.params import resolve
from silvan.plans import importers
from silvan.plans.dataset import GbtDataset, to_frame
from silvan.plans.engine import train
from silvan.plans.model import GbtModel
from silvan.sources import files, sequence
from silvan.streaming import streams


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 3)).round(3)
    return x, (x[:, 0] + x[:, 1] > 0).astype(float)


def test_parameters():
    p = resolve({"eta": "0.2", "n_estimators": 7, "objective": "mse", "max_depth": 3, "eval_at": "5,1"})
    assert (p.learning_rate, p.num_iterations, p.objective, p.num_leaves, p.eval_at) == (0.2, 7, "regression", 8, [1, 5])
    for bad in ({"objective": "multiclass"}, {"boosting": "rf"}, {"num_leaves": 1}, {"is_unbalance": True, "scale_pos_weight": 2.0}):
        with pytest.raises(ValueError):
            resolve(bad)


def test_text_sources(spark, data, tmp_path):
    x, y = data
    for name, sep in (("csv", ","), ("tsv", "\t")):
        path = tmp_path / f"rows.{name}"
        path.write_text("\n".join(sep.join(map(str, [b, *a])) for a, b in zip(x, y, strict=True)))
        assert files.sniff(spark, str(path)) == name
        got = files.read_table(spark, str(path)).toPandas()
        assert np.allclose(got.sort_values(list(got.columns)), pd.DataFrame(np.column_stack([y, x])).sort_values([0, 1, 2, 3]))
    path = tmp_path / "rows.svm"
    path.write_text("1 0:2.5 2:1\n0 1:3\n1\n")
    assert files.sniff(spark, str(path)) == "libsvm"
    assert sorted(map(tuple, files.read_table(spark, str(path)).collect())) == [(0.0, 0.0, 3.0, 0.0), (1.0, 0.0, 0.0, 0.0), (1.0, 2.5, 0.0, 1.0)]
    side = tmp_path / "rows.query"
    side.write_text("2\n1\n3\n")
    assert [r["query"] for r in files.read_queries(spark, str(side)).orderBy("line").collect()] == [0, 0, 1, 2, 2, 2]
    kept, named = files.roles(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), "0", "name:b", ignore=["c"])
    assert kept.columns == ["a", "b"] and named == {"label": "a", "weight": "b"}


def test_frames_of_other_kinds(spark, data):
    x, y = data
    assert to_frame(x, spark).count() == 200 and to_frame([x, x], spark).count() == 400
    pdf = pd.DataFrame({"c": pd.Categorical(["a", None, "b"])})
    assert [r.c for r in to_frame(pdf, spark).collect()][0] == 0.0

    class Rows(sequence.Sequence):
        batch_size = 64

        def __len__(self):
            return len(x)

        def __getitem__(self, rows):
            return x[rows]

    got = sequence.read_sequences(spark, [Rows(), Rows()], ["a", "b", "c"], np.concatenate([y, y]))
    assert got.count() == 400 and got.select(F.sum("label")).first()[0] == 2 * y.sum()
    assert sequence.read_rows(spark, 10, lambda i: [(i % 3, 1.0)], 3).select(F.sum("Column_0")).first()[0] == 4
    triples = spark.createDataFrame([(0, 1, 5.0), (2, 0, 1.0)], "r int, c int, v double")
    assert sorted(map(tuple, files.from_coordinates(triples, "r", "c", "v", 2).collect())) == [(0, 0.0, 5.0), (2, 1.0, 0.0)]


def test_dataset_surface(spark, data, tmp_path):
    x, y = data
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=y, key=range(200)))
    ds = GbtDataset(df, "label", row_key="key")
    assert ds.num_feature() == 3 and ds.num_data() == 200 and ds.feature_num_bin("a") > 2
    assert ds.subset(df.where("key < 50"), "key").num_data() == 50
    wider = ds.add_features_from(df.select("key", (F.col("a") * 2).alias("d")), "key")
    assert wider.features == ["a", "b", "c", "d"]
    ds.save_binary(str(tmp_path / "saved"))
    rows, bins = GbtDataset.load_binary(spark, str(tmp_path / "saved"))
    assert rows.count() == 200 and bins.names == ["a", "b", "c"]


def test_estimators(spark, data):
    x, y = data
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=np.where(y > 0, "yes", "no")))
    model = ml.GbtClassifier(num_iterations=5, class_weight="balanced").fit(df)
    assert model.transform(df).where("prediction = label").count() > 180
    three = df.withColumn("label", F.when(F.col("a") > 1, "big").otherwise(F.col("label")))
    assert ml.GbtClassifier(num_iterations=4).fit(three).transform(three).where("prediction = label").count() > 170
    assert "prediction" in ml.GbtRegressor(num_iterations=1).fit(df.withColumn("label", F.col("a"))).transform(df).columns


def test_command_line(spark, data, tmp_path):
    x, y = data
    path, model, out = tmp_path / "train.csv", tmp_path / "model.txt", tmp_path / "out"
    path.write_text("\n".join(",".join(map(str, [b, *a])) for a, b in zip(x, y, strict=True)))
    config = tmp_path / "train.conf"
    config.write_text(f"task = train # comment\nobjective = binary\ndata = {path}\nnum_trees = 3\n")
    cli.main([f"config={config}", f"output_model={model}"], spark)
    cli.main(["task=predict", f"data={path}", f"input_model={model}", f"output_result={out}"], spark)
    got = sorted(float(r[0]) for r in spark.read.text(str(out)).collect())
    assert np.allclose(got, sorted(GbtModel.load(str(model)).local(x)[:, 0]))
    cli.main(["task=refit", f"data={path}", f"input_model={model}", f"output_model={tmp_path / 'refit.txt'}"], spark)
    cli.main(["task=convert_model", f"input_model={model}", f"output_model={tmp_path / 'model.json'}"], spark)


def test_streams(spark, data, tmp_path):
    x, y = data
    rows = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=y))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.ingest(stream, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "table"))
    assert got.count() == 200
    model = train({"objective": "binary", "num_iterations": 2}, GbtDataset(got, "label"))
    query = streams.score(stream, model).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select count(prediction) from scored").first()[0] == 200


def test_importers():
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [0.5, -1.0, 2.0], "default_left": [1, 0, 0], "base_weights": [0, -1.0, 2.0], "sum_hessian": [3, 1, 2]}
    model = importers.from_xgboost({"learner": {"gradient_booster": {"model": {"trees": [tree], "tree_info": [0]}}, "learner_model_param": {"num_feature": "2", "num_class": "0", "base_score": "0.25"}, "objective": {"name": "reg:squarederror"}, "feature_names": []}})
    assert model.local([[0, 0.49], [0, 0.5], [0, np.nan]], "raw")[:, 0].tolist() == [-0.75, 2.25, -0.75]
    cat = {"features_info": {"float_features": [{"feature_index": 0, "flat_feature_index": 0, "feature_id": "a"}, {"feature_index": 1, "flat_feature_index": 1}]}, "oblivious_trees": [{"splits": [{"float_feature_index": 0, "border": 1.0}, {"float_feature_index": 1, "border": 2.0}], "leaf_values": [1.0, 2.0, 3.0, 4.0]}], "scale_and_bias": [2.0, [0.5]]}
    assert importers.from_catboost(cat).local([[0, 0], [2, 0], [0, 3], [2, 3]], "raw")[:, 0].tolist() == [2.5, 4.5, 6.5, 8.5]


def test_encoding_and_projections(spark):
    df = spark.createDataFrame([("b", True, 1.0), ("a", None, 2.0), (None, False, None)], "s string, f boolean, x double")
    rules = encoding.fit_rules(df)
    assert [tuple(r)[:2] for r in rules.apply(df).collect()] == [(2, 1), (1, -1), (0, 0)]
    pool = ObliquePool.random(["x"], 2, seed=1).fit(df)
    assert pool.transform(df).where("oblique_0 is null").count() == 0
