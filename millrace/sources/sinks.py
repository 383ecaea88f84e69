"""Outputs: split tables, predictions, metric tables, reports. All go through Spark or its file systems, so any path Spark knows will do."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split, zstd; readers of one split prune the others."""
    df.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)


def prediction_rows(df: DataFrame, ids: list[str], probs: str, labels: list[str]) -> DataFrame:
    """ids, and one column prob_<label> for each class."""
    return df.select(*ids, *[F.col(probs)[k].alias(f"prob_{n}") for k, n in enumerate(labels)])


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV or Parquet, by the path's end."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file of any file system Spark reaches; what is there is replaced."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(report: DataFrame, path: str) -> None:
    """A report of bounded size: a JSON list, or CSV with a header if the path ends so."""
    rows = report.collect()
    if path.endswith(".csv"):
        out = io.StringIO()
        lines = csv.writer(out, lineterminator="\n")
        lines.writerow(report.columns)
        lines.writerows(rows)
        text = out.getvalue()
    else:
        text = json.dumps([r.asDict(recursive=True) for r in rows], indent=1, default=str)
    put_text(report.sparkSession, path, text)


def append_records(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that the folder holds already, such as the steps of a run."""
    df.write.mode("append").json(path)


def write_vocabulary(spark: SparkSession, tokens: list[str], path: str) -> None:
    put_text(spark, path, "\n".join(tokens) + "\n")


def matrix(pairs: DataFrame, labels: list[str], value: str = "n") -> DataFrame:
    """A confusion table (true_label, pred_label, n, share) as one row for each true label, in the labels' order, and a column for each predicted one."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("true_label"))
    wide = pairs.groupBy("true_label").pivot("pred_label", labels).agg(F.first(value))
    return wide.where(place > 0).orderBy(place)


def write_metrics(folder: str, metrics: DataFrame, per_class: DataFrame, pairs: DataFrame, detection: DataFrame, labels: list[str]) -> None:
    """The exports of an evaluation: summary as JSON and CSV, figures by class, counts and shares of the confusion matrix, detection."""
    for name, table in (
        ("summary.json", metrics), ("summary.csv", metrics), ("per_class.csv", per_class), ("confusion.csv", matrix(pairs, labels)),
        ("confusion_normalized.csv", matrix(pairs, labels, "share")), ("detection.json", detection),
    ):
        write_report(table, f"{folder}/{name}")


def flat_columns(schema: StructType, within: str = "", name: str = "") -> list[Column]:
    """Columns of all fields of nested structs, named by the way to them, joined by underscores."""
    found = []
    for field in schema.fields:
        at, label = f"{within}`{field.name}`", f"{name}{field.name}"
        found += flat_columns(field.dataType, at + ".", label + "_") if isinstance(field.dataType, StructType) else [F.col(at).alias(label)]
    return found


def flat(df: DataFrame) -> DataFrame:
    """df with its structs' fields as columns of their own."""
    return df.select(*flat_columns(df.schema))
