"""Runs in the background of a driver: a queue with one worker, cancel, progress, retry, stored state."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from gristmill.plans.pipeline import Pipeline
from gristmill.sources import sinks, strict
from gristmill.sources.store import RunStore

QUEUE, RETRIED, ERROR_CHARS, QUIET = 32, ("failed", "cancelled"), 500, 0.35


class Cancelled(Exception):
    """The run was asked to stop."""


def throttled(send: Callable[[dict[str, Any]], None], clock: Callable[[], float] = time.monotonic) -> Callable[[dict[str, Any]], None]:
    """Pass on updates that name a stage, and of the others at most one in QUIET seconds."""
    last = [float("-inf")]

    def update(values: dict[str, Any]) -> None:
        now = clock()
        if "stage" in values or now - last[0] >= QUIET:
            last[0] = now
            send(values)

    return update


def shown_error(error: BaseException) -> str:
    """What a user may see: texts of ValueErrors; of anything else only its kind, so no key or record leaks."""
    return str(error)[:ERROR_CHARS] if isinstance(error, ValueError) else f"The operation failed ({type(error).__name__})."


class Runs:
    """Submits, cancels and retries runs; at most QUEUE are unfinished. Spark jobs of a run form one job group."""

    def __init__(self, spark: SparkSession, root: str, pipeline: Callable[..., Pipeline] = Pipeline):
        self.spark, self.root, self.pipeline = spark, root.rstrip("/"), pipeline
        self.store = RunStore(spark, f"{self.root}/store")
        self.worker, self.stops, self.lock = ThreadPoolExecutor(1), {}, threading.Lock()

    def submit(self, path: str, screening: dict[str, Any] | None = None, training: dict[str, Any] | None = None, train: bool = True, run_id: str | None = None) -> dict[str, Any]:
        with self.lock:
            old = self.store.get("run", run_id) if run_id else None
            if len(self.stops) >= QUEUE:
                raise ValueError(f"{QUEUE} runs are waiting; try again later")
            if run_id in self.stops or (old and old["status"] not in RETRIED):
                raise ValueError("only a failed or cancelled run can be retried")
            name = run_id or uuid.uuid4().hex
            run = {"id": name, "path": path, "screening": screening or {}, "training": training or {}, "train": train, "status": "queued", "stage": "queued", "error": None, "attempt": (old or {}).get("attempt", 0) + 1, "progress": {}, "artifacts": []}
            self.store.put("run", run)
            stop = self.stops[name] = threading.Event()
            self.worker.submit(lambda: self._in_group(run, stop))
            return run

    def cancel(self, run_id: str) -> None:
        if stop := self.stops.get(run_id):
            stop.set()
            self.spark.sparkContext.cancelJobGroup(run_id)

    def wait(self) -> None:
        """Until every run submitted so far has ended."""
        self.worker.submit(lambda: None).result()

    def _in_group(self, run: dict[str, Any], stop: threading.Event) -> None:
        thread = InheritableThread(target=self._execute, args=(run, stop), session=self.spark)
        thread.start()
        thread.join()

    def _execute(self, run: dict[str, Any], stop: threading.Event) -> None:
        name = run["id"]
        self.spark.sparkContext.setJobGroup(name, f"run {name}", interruptOnCancel=True)
        out = f"{self.root}/runs/{name}"

        def progress(values: dict[str, Any]) -> None:
            if stop.is_set():
                raise Cancelled
            self.store.update(name, progress=values, **({"stage": values["stage"]} if "stage" in values else {}))
            if "stage" in values:
                self.store.log(name, f"stage {values['stage']}")

        try:
            self.store.update(name, status="running")
            p = self.pipeline(self.spark, out, run["screening"], run["training"], progress=throttled(progress))
            p.splits = f"splits-{run['attempt']}"
            raw = strict.read_records(self.spark, run["path"])
            result = p.run(raw, run["path"]) if run["train"] else {"data_report": p.screen(raw, run["path"])[1]}
            end = {"status": "completed", "stage": "completed", **result}
        except Exception as e:  # noqa: BLE001  a run's failure is its result
            end = {"status": "cancelled", "error": "cancelled; a retry is possible"} if stop.is_set() or isinstance(e, Cancelled) else {"status": "failed", "error": shown_error(e)}
        found = sinks.artifacts(self.spark, out) if sinks.exists(self.spark, out) else []
        with self.lock:
            self.store.update(name, artifacts=found, **end)
            self.stops.pop(name, None)
