"""Runs and datasets as append-only events: the newest event of an item is the item.

A store is a folder of Parquet tables with ``kind, id, body (JSON), seq``, one to an event, so writers
never meet; every read is a query over the events. Logs are events of their own.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.sources.sinks import exists

EVENT = "kind string, id string, body string, seq long"
LOGS_KEPT, PAGE, LARGEST_PAGE = 200, 100, 500
UNFINISHED = ["queued", "running"]


def newest_items(events: DataFrame, keys: list[str], order: Column | str = "seq") -> DataFrame:
    """The last event of each item, by a partial aggregate."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def page(items: DataFrame, limit: int = PAGE, offset: int = 0, order: str = "seq") -> DataFrame:
    """Items by last write, newest first."""
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} items and begins at 0 or later")
    return items.orderBy(F.desc(order)).offset(offset).limit(limit)


def last_entries(entries: DataFrame, key: str, order: str, n: int = LOGS_KEPT) -> DataFrame:
    """The last n entries of each item; a window per item that Spark prunes to n rows a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return entries.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


class RunStore:
    """Items of some kinds below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _events(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(self.path).select("kind", "id", "body", "seq")

    def _append(self, kind: str, name: str, value: Any) -> None:
        body = json.dumps(value, ensure_ascii=False, allow_nan=False)
        self.spark.createDataFrame([(kind, name, body, time.time_ns())], EVENT).coalesce(1).write.parquet(f"{self.path}/event={uuid.uuid4().hex}")

    def put(self, kind: str, item: dict[str, Any]) -> dict[str, Any]:
        self._append(kind, item["id"], item)
        return item

    def get(self, kind: str, name: str) -> dict[str, Any] | None:
        row = newest_items(self._events().where((F.col("kind") == kind) & (F.col("id") == name)), ["kind", "id"]).first()
        return json.loads(row["body"]) if row else None

    def list(self, kind: str, limit: int = PAGE, offset: int = 0) -> list[dict[str, Any]]:
        items = newest_items(self._events().where(F.col("kind") == kind), ["kind", "id"])
        return [json.loads(r["body"]) for r in page(items, limit, offset).collect()]

    def update(self, name: str, **values: Any) -> dict[str, Any]:
        item = self.get("run", name)
        if item is None:
            raise ValueError("there is no such run")
        return self.put("run", item | values | {"updated_at": datetime.now(timezone.utc).isoformat()})

    def log(self, name: str, message: str) -> None:
        self._append("log", name, {"time": datetime.now(timezone.utc).isoformat(), "message": message})

    def logs(self, name: str) -> list[dict[str, Any]]:
        found = last_entries(self._events().where((F.col("kind") == "log") & (F.col("id") == name)), "id", "seq")
        return [json.loads(r["body"]) for r in found.orderBy("seq").collect()]

    def recover(self) -> int:
        """Runs that a lost driver left unfinished become failed; returns how many."""
        items = newest_items(self._events().where(F.col("kind") == "run"), ["kind", "id"])
        left = items.where(F.get_json_object("body", "$.status").isin(UNFINISHED)).select("id").collect()
        for r in left:
            self.update(r["id"], status="failed", error="The driver was lost; a retry replays the decisions made so far.")
        return len(left)
