"""A whole run: screen, report, split, train, evaluate, with gates between the stages."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.scratch import cut, remove_path
from gristmill.operators import bigram, report
from gristmill.operators.screening import DECISION, Scorer, audit, cacheable, newest, screen, with_records
from gristmill.operators.split import SPLITS, prepare
from gristmill.operators.state import with_state
from gristmill.sources import sinks, strict

CACHE = f"config_hash string, state_hash string, result {DECISION}, written long"


class Pipeline:
    """Stages over one output folder; a later run over the same folder replays cached decisions."""

    def __init__(self, spark: SparkSession, out: str, screening: dict[str, Any] | None = None, training: dict[str, Any] | None = None, scorer: Scorer | None = None, progress: Callable[[dict[str, Any]], None] | None = None):
        self.spark, self.out, self.scorer, self.progress = spark, out.rstrip("/"), scorer, progress or (lambda _: None)
        self.screening, self.training, self.splits = C.screening_config(screening or {}), C.training_config(training), "splits"

    def screen(self, raw: DataFrame, source: str | None = None, stored: bool = False) -> tuple[DataFrame, dict[str, Any]]:
        """Decide all records, write partitions, audit, cache and report. ``source``: the input's path, which must not lie in the output folder.
        ``stored``: ``raw`` is read from a table that stays as it is, so its records need not be written once more.

        The cache is only ever appended to; on reading, the newest result of a state wins, so a run that
        fails at any point loses none of it.
        """
        if source is not None and sinks.inside(self.spark, source, self.out):
            raise ValueError("the input lies in the output folder")
        self.progress({"stage": "screening"})
        raw = raw if stored else cut(raw, "raw")
        where = f"{self.out}/cache"
        cache = newest(self.spark.read.schema(CACHE).parquet(where)) if sinks.exists(self.spark, where) else None
        ledger = f"{self.out}/ledger"
        decided = cut(screen(raw, self.screening, cache, self.scorer, ledger=f"{ledger}/{C.config_hash(self.screening)}"), "decided")
        fresh = cacheable(decided).withColumn("written", F.lit(time.time_ns()))
        fresh.write.mode("append").partitionBy("config_hash").parquet(where)
        remove_path(self.spark, ledger)  # its answers are in the cache now; until here a run that stopped can be begun again
        sinks.write_partitions(raw, decided, f"{self.out}/decisions")
        fatal = not decided.where("input_fatal").isEmpty()
        result = report.data_report(decided, self.screening, exhausted=not fatal, input_fatal=fatal)
        sinks.write_audit(audit(decided, result["mode"]), f"{self.out}/audit")
        sinks.write_json(self.spark, f"{self.out}/data_report.json", result)
        self.progress({"stage": "data_evaluation", "counts": result["counts"], "processed": result["processed"]})
        return with_records(decided, raw), result

    def train(self, decided: DataFrame) -> dict[str, Any]:
        """Split, train and evaluate the kept records of what ``screen`` returned; outputs must not exist yet."""
        if sinks.exists(self.spark, f"{self.out}/{self.splits}"):
            raise ValueError("the output folder already has splits; use a new one")
        self.progress({"stage": "training"})
        kept, records = getattr(decided, "_apart", (decided, decided))
        split, groups = prepare(with_state(records), self.training, kept.where("result.decision = 'keep'"), self.training["max_seq_length"])
        rows = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
        if set(rows) != set(SPLITS):
            raise ValueError("every split must contain at least one record")
        sinks.write_splits(records, split, f"{self.out}/{self.splits}")
        result = bigram.train_and_evaluate(split, self.training, rows["train"]) | {"split_counts": rows, "group_counts": groups, "config": self.training}
        self.progress({"stage": "model_evaluation", "step": result["steps"]})
        model = result.pop("model")
        sinks.write_json(self.spark, f"{self.out}/model/byte_bigram.json", model)
        sinks.write_json(self.spark, f"{self.out}/training_report.json", result)
        sinks.write_json(self.spark, f"{self.out}/model_report.json", {k: v for k, v in result.items() if k != "loss_history"})
        return result

    def run(self, raw: DataFrame, source: str | None = None) -> dict[str, Any]:
        """Both stages; an incomplete or unready screening stops before training."""
        decided, data = self.screen(raw, source)
        if not data["complete"]:
            raise ValueError("screening is incomplete")
        if not data["training_ready"]:
            raise ValueError("too many records were not evaluated")
        out = {"data_report": data, "model_report": self.train(decided)}
        self.progress({"stage": "completed"})
        return out


def summary(result: dict[str, Any]) -> str:
    """Lines for a terminal."""
    d, m = result["data_report"], result["model_report"]
    c = d["counts"]
    return "\n".join([
        f"screened {c['total']}: keep {c['keep']}, review {c['review']}, reject {c['reject']} ({c['duplicates']} duplicates)",
        f"splits: {', '.join(f'{s} {m['split_counts'][s]}' for s in SPLITS)}",
        f"test loss {m['baseline_test_loss']:.4f} -> {m['trained_test_loss']:.4f} after {m['steps']} steps",
    ])


MAX_TRAINING_LINE = 8 << 20


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """Kept records from a file of JSON lines, for training alone: any fault of a line raises ValueError.

    Lines may have 8 MiB, and there is no review: a line that is no object, or whose content or ids do
    not fit, stops the run with its number.
    """
    rows = with_state(strict.read_records(spark, path, "jsonl", MAX_TRAINING_LINE))
    fault = F.coalesce("input_error", "content_error")
    if (first := rows.where(fault.isNotNull()).agg(F.min_by(F.struct("line", fault.alias("fault")), "line").alias("x")).first()["x"]) is not None:
        raise ValueError(f"line {first['line']}: {first['fault']}")
    return rows
