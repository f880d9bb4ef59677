"""Sources and streams end to end: rows go out as text or as a stream and come back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding
from ..plans.shared import folder
from ..sources import files
from ..streaming import streams
from .registry import add, query, table


def place(spark: SparkSession) -> str:
    return f"{folder(spark)}/silvan/{uuid.uuid4().hex}"


def sums(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("label"), 2).alias("label"), F.round(F.sum("Column_0"), 2).alias("size"), F.round(F.sum("Column_1"), 2).alias("odd"))


_PARTS = "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS label, round(sum(p_size)::DOUBLE, 2) AS size, round(sum(p_partkey % 3)::DOUBLE, 2) AS odd FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("label"), F.col("p_size").alias("size"), (F.col("p_partkey") % 3).alias("odd"))


def _separated(sep: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = place(spark)
        parts(spark, sf_dir).write.csv(path, sep=sep)
        return sums(files.read_table(spark, path))

    return run


add("scan_csv", _separated(","), _PARTS)
add("scan_tsv", _separated("\t"), _PARTS)


@query(_PARTS)
def scan_libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    parts(spark, sf_dir).select(F.concat_ws(" ", F.col("label").cast("string"), F.concat(F.lit("0:"), F.col("size")), F.when(F.col("odd") != 0, F.concat(F.lit("1:"), F.col("odd")))).alias("value")).write.text(path)
    return sums(files.read_table(spark, path))


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS first, round(sum(l_tax), 4) AS third FROM lineitem")
def scan_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as (row, column, value) triples and back."""
    rows = table(spark, sf_dir, "lineitem").select(F.struct("_metadata.file_path", "_metadata.row_index").alias("row"), F.posexplode(F.array("l_quantity", "l_discount", "l_tax")).alias("column", "value")).where("value <> 0")
    return files.from_coordinates(rows, "row", "column", "value", 3).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Column_0"), 2).alias("first"), F.round(F.sum("Column_2"), 4).alias("third"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, read as a stream and appended to a table."""
    path, given = place(spark), place(spark)
    table(spark, sf_dir, "events").write.parquet(given)
    stream = spark.readStream.schema(spark.read.parquet(given).schema).parquet(given)
    streams.ingest(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, round(avg(abs(value - 50.0)), 6) AS loss, count(*) AS n FROM events GROUP BY 1")
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of scored events in windows of an hour."""
    return streams.monitor(table(spark, sf_dir, "events"), "ts", F.abs(F.col("value") - 50.0), "1 hour").select("start", F.round("loss", 6).alias("loss"), "n")


@query("SELECT dense_rank() OVER (ORDER BY p_brand)::INT AS code, p_brand, count(*) AS n FROM part GROUP BY p_brand")
def dictionary_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_brand")
    coded = encoding.fit_rules(df).apply(df.withColumn("brand", F.col("p_brand")))
    return coded.groupBy(F.col("p_brand").alias("code"), F.col("brand").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))
