"""Text sources of numeric tables: CSV, TSV and LibSVM, their detection, side-car files and column roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.running import before, held

#: Formats that callers have registered: name -> reader(spark, path).
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def sniff(spark: SparkSession, path: str, header: bool = False) -> str:
    """csv, tsv or libsvm, by the separators of the first lines."""
    lines = [r[0] for r in spark.read.text(path).limit(3).collect() if r[0] and r[0].strip()]
    probe = lines[1 if header and len(lines) > 1 else 0] if lines else ""
    colons, tabs, commas = probe.count(":"), probe.count("\t"), probe.count(",")
    if colons and colons >= max(tabs, commas):
        return "libsvm"
    return "tsv" if tabs and tabs >= commas else "csv"


def read_table(spark: SparkSession, path: str, header: bool = False, kind: str | None = None, label: str | int = 0) -> DataFrame:
    """Rows of a text file as doubles: the label column is `label`, the others Column_<i> or as the header names them."""
    kind = kind or sniff(spark, path, header)
    if kind in READERS:
        return READERS[kind](spark, path)
    if kind == "libsvm":
        return read_libsvm(spark, path)
    sep = "\t" if kind == "tsv" else ","
    first = spark.read.text(path).first()
    names = first[0].split(sep) if first and header else [f"Column_{i}" for i in range(len(first[0].split(sep)) if first else 0)]
    rows = spark.read.schema(StructType([StructField(n.strip(), DoubleType()) for n in names])).csv(path, sep=sep, header=header, nullValue="", nanValue="nan", mode="PERMISSIVE")
    at = names.index(label.removeprefix("name:")) if isinstance(label, str) and label else int(label or 0)
    if header or not names:
        return rows.withColumnRenamed(names[at], "label") if names else rows
    others = [n for i, n in enumerate(names) if i != at]
    return rows.select(F.col(names[at]).alias("label"), *[F.col(n).alias(f"Column_{i}") for i, n in enumerate(others)])


def read_libsvm(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """label and Column_0..: features that a line doesn't name are 0. Without width, the greatest index found tells it."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda p: p != "")
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains(":") & ~p.startswith("qid"))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).cast("int").alias("k"), F.substring_index(p, ":", -1).cast("double").alias("v"))))
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.element_at(parts, 1).cast("double").alias("label"), entries.alias("x"))
    return widen(rows, "x", width)


def widen(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """A map of index -> value as columns Column_<i>, with 0 for what is not there (sparse rows)."""
    if width is None:
        width = (df.agg(F.max(F.array_max(F.map_keys(column)))).first()[0] or 0) + 1
    others = [c for c in df.columns if c != column]
    return df.select(*others, *[F.coalesce(F.try_element_at(column, F.lit(i)), F.lit(0.0)).alias(f"Column_{i}") for i in range(width)])


def from_coordinates(df: DataFrame, row: str, column: str, value: str, width: int) -> DataFrame:
    """Dense rows of (row, column, value) triples, as a column-compressed matrix lists them; one aggregate, no pivot job."""
    return df.groupBy(row).agg(*[F.coalesce(F.max(F.when(F.col(column) == i, F.col(value))), F.lit(0.0)).alias(f"Column_{i}") for i in range(width)])


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """line (from 0), and the line's number: side-car files have one value to a row. Lines are numbered split by split: those of
    earlier splits are counted first."""
    rows = spark.read.text(path).select(F.trim("value").cast("double").alias(name), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    counted = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    starts, at = [], 0
    for part in sorted(counted):
        starts.append(F.when(F.col("part") == part, F.lit(at - (part << 33))))
        at += counted[part]
    found = rows.withColumn("line", F.col("place") + F.coalesce(*starts, F.lit(0)) if starts else F.col("place"))
    return found.where(F.col(name).isNotNull()).select("line", name)


def _running(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with <column>_before: the column's sum over the rows that come earlier in the order, of which no two are alike."""
    return before(df, order, [column], descending=False)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """line, query: sizes of consecutive queries, as each row's query number."""
    sizes = held(read_lines(spark, path, "size").withColumnRenamed("line", "query"))
    start = _running(sizes, "size", "query").select("query", F.col("size_before").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    return start.where("size > 0").select("query", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("line"))


def attach(df: DataFrame, side: DataFrame, line: str = "line") -> DataFrame:
    """Rows joined with a side-car's values by their line."""
    return df.join(side, line, "left")


def query_numbers(df: DataFrame, query: str, order: list[str], name: str = "query_number") -> DataFrame:
    """Number of each run of equal query ids in the order of `order`.

    Rows are sorted into ranges, runs are numbered within each, and ranges begin with the number that the one before ends
    with, or the next one if its last query is another.
    """
    rows = held(df.orderBy(*order).withColumn("run_part", F.spark_partition_id()).withColumn("run_place", F.monotonically_increasing_id()))
    within = Window.partitionBy("run_part").orderBy("run_place")
    same = F.lag(query).over(within).eqNullSafe(F.col(query)) | (F.row_number().over(within) == 1)
    numbered = rows.withColumn("run_change", F.when(same, 0).otherwise(1))
    numbered = numbered.withColumn("run_number", F.sum("run_change").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("run_part").agg(F.max("run_number").alias("runs"), F.min_by(F.struct(query), "run_place").alias("first"), F.max_by(F.struct(query), "run_place").alias("last"))
    starts, end, last = [(-1, 0)], -1, None
    for r in sorted(parts.collect(), key=lambda r: r.run_part):
        begin = end if last == r.first else end + 1
        starts.append((r.run_part, begin))
        end, last = begin + r.runs, r.last
    begins = df.sparkSession.createDataFrame(starts, "run_part int, run_begin long")
    return numbered.join(F.broadcast(begins), "run_part").select(*df.columns, (F.col("run_begin") + F.col("run_number")).alias(name))


def roles(df: DataFrame, label: str | None = None, weight: str | None = None, group: str | None = None, ignore: list[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The frame without ignored columns, and the roles by column name; roles may be given by number or as name:<column>."""

    def name(x: str | None) -> str | None:
        if not x:
            return None
        return df.columns[int(x)] if str(x).isdigit() else str(x).removeprefix("name:")

    found = {k: n for k, n in (("label", name(label)), ("weight", name(weight)), ("group", name(group))) if n}
    return df.drop(*[n for x in ignore if (n := name(x))]), found


def write_predictions(df: DataFrame, column: str, path: str) -> None:
    """One line to a row, several values apart by tabs."""
    kind = df.schema[column].dataType.typeName()
    text = F.array_join(F.transform(column, lambda v: v.cast("string")), "\t") if kind == "array" else F.col(column).cast("string")
    df.select(text.alias("value")).write.mode("overwrite").text(path)
