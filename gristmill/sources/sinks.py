"""Outputs of a run: decision partitions, audit, splits, reports, model."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators.state import training_text, with_state


def met(records: DataFrame, narrow: DataFrame) -> DataFrame:
    """Records and the columns of ``narrow`` (none null, its lines unique) for the lines that both have, by ranges of lines.

    A join would shuffle the records by hash and their order would shuffle them again. Here rows of both sides go
    to their range of lines at once, and meet inside it.
    """
    names = [c for c in narrow.columns if c != "line"]
    both = records.withColumn("_record", F.lit(True)).unionByName(narrow, allowMissingColumns=True).repartitionByRange("line")
    rows = both.select("_record", *records.columns, *(F.max(n).over(Window.partitionBy("line")).alias(n) for n in names))
    return rows.where(F.col("_record") & F.col(names[0]).isNotNull()).drop("_record")


def write_partitions(records: DataFrame, decided: DataFrame, path: str) -> None:
    """Original records as JSON lines below ``decision=keep|review|reject``, in input order inside each file."""
    rows = met(records.select("line", "record"), decided.select("line", F.col("result.decision").alias("decision"))).sortWithinPartitions("decision", "line")
    rows.select("decision", "record").write.mode("overwrite").partitionBy("decision").text(path)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.repartitionByRange("line").sortWithinPartitions("line").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def _with_split_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for record, text, state, group in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            out.append(json.dumps(json.loads(record) | {"text": text, "_state": json.loads(state), "_split_group": group}, ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["split", "line", "value"])


def write_splits(records: DataFrame, split: DataFrame, path: str) -> None:
    """Original records with ``text, _state, _split_group`` as JSON lines below ``split=...``; existing output is an error.

    State and text are made of a record's fields where it is written: only record and fields are shuffled.
    """
    rows = with_state(met(records.select("line", "record", "fields"), split.select("line", "split", "component")))
    rows = rows.select("split", "line", "record", training_text().alias("text"), F.to_json("state").alias("state"), "component").mapInArrow(_with_split_fields, "split string, line long, value string")
    rows.sortWithinPartitions("split", "line").select("split", "value").write.mode("errorifexists").partitionBy("split").text(path)


def write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    """A small document, written beside and renamed into place."""
    jvm = spark.sparkContext._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"could not publish {path}")


def publish(spark: SparkSession, path: str, final: str) -> None:
    """Rename a finished folder to a place where nothing is yet, so that readers see all of it or nothing."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(final)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"could not publish {final}")


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def inside(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies below it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = lambda p: (w := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).makeQualified(w).toString().rstrip("/") + "/"
    return full(path).startswith(full(folder))


def artifacts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".json", ".txt", ".parquet")) -> list[str]:
    """Files below ``path`` with a known suffix, sorted, relative to it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files, root = [], fs.listFiles(where, True), fs.makeQualified(where).toString()
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(suffixes):
            found.append(name.removeprefix(root).lstrip("/"))
    return sorted(found)
