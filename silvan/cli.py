"""Command line: python -m silvan.cli task=train data=... objective=... or config=<file>."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .params import Params, alias_table, resolve
from .plans.dataset import GbtDataset
from .plans.engine import log_evaluation, train
from .plans.model import GbtModel
from .sources.files import read_table, roles, write_predictions


def read_config(path: str) -> dict[str, str]:
    """key = value lines; # begins a comment."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split("#")[0].strip() for line in f]
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if "=" in line)}


def parse(args: list[str]) -> dict[str, str]:
    given = {k.strip(): v.strip() for k, _, v in (a.partition("=") for a in args if "=" in a)}
    path = given.pop("config", given.pop("config_file", ""))
    return {**(read_config(path) if path else {}), **given}


def _data(spark: SparkSession, path: str, p: Params, reference: GbtDataset | None = None) -> GbtDataset:
    df, named = roles(read_table(spark, path, p.header, label=p.label_column or 0), None, p.weight_column, p.group_column, [x for x in p.ignore_column.split(",") if x])
    if reference:
        return reference.create_valid(df)
    return GbtDataset(df, "label", named.get("weight"), named.get("group"), params=p)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parse(sys.argv[1:] if args is None else args)
    if given.get("task") == "params":
        print(alias_table())
        return
    p = resolve(given)
    spark = spark or SparkSession.builder.getOrCreate()
    if p.task == "train":
        data = _data(spark, p.data, p)
        valid = [_data(spark, v, p, data) for v in p.valid]
        train(p, data, valid_sets=valid, init_model=p.input_model or None, callbacks=[log_evaluation(p.metric_freq)]).save(p.output_model)
    elif p.task in ("predict", "prediction", "test"):
        model = GbtModel.load(p.input_model)
        model.params = model.params.with_(pred_early_stop=p.pred_early_stop, pred_early_stop_freq=p.pred_early_stop_freq, pred_early_stop_margin=p.pred_early_stop_margin)
        kind = "raw" if p.predict_raw_score else "leaf" if p.predict_leaf_index else "contrib" if p.predict_contrib else "normal"
        rows = read_table(spark, p.data, p.header, label=p.label_column or 0)
        write_predictions(model.predict(rows, kind, start=p.start_iteration_predict, count=p.num_iteration_predict), "prediction", p.output_result)
    elif p.task == "refit":
        GbtModel.load(p.input_model).refit(_data(spark, p.data, p), p.refit_decay_rate).save(p.output_model)
    elif p.task == "convert_model":
        model = GbtModel.load(p.input_model)
        with open(p.output_model, "w", encoding="utf-8") as f:
            f.write(json.dumps(model.dump()) if p.output_model.endswith(".json") else model.case_sql())
    elif p.task == "save_binary":
        _data(spark, p.data, p).save_binary(f"{p.data}.bin")
    else:
        raise ValueError(f"unknown task {p.task}")


if __name__ == "__main__":
    main()
