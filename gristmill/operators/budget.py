"""Questions to a paid scorer within one request budget for a whole run.

A scorer of requests has ``open()``, called once in a task, which gives a function
``ask(state JSON, allowed, tried) -> (answer, failure, made)``: it makes at most ``allowed`` requests, after
``tried`` earlier ones for the same question, and counts those it ``made``. An answer and a failure are final;
neither means that it wants more requests than it was allowed. ``attempts`` is the most a question may take.

The budget is granted in rounds. A round writes to the ledger, a folder that all executors share, how many
requests every open state may make; together they never exceed what is left. Then tasks read the grants,
ask, and write answers and the requests made. What was not used is granted again in the next round: to
states that need another attempt, to malformed answers, which are asked for once more, and to states that
had no grant yet, in line order.

Nothing is spent twice. A task reads grants straight from a table, so only its own failure, a lost
executor or speculation makes another attempt of it; such an attempt cannot know what the first has spent, so it asks
nothing, and its grants count as spent in full. A run that begins with the ledger of one that stopped takes
its answers, and a round without answers counts as spent in full, too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, new_path
from gristmill.operators.gates import RESPONSE
from gristmill.sources.sinks import exists

Ask = Callable[[str, int, int], tuple[Any, str | None, int]]
ANSWERED = "state_hash string, line long, asking int, tried int, allowed int, answer string, failure string, made int, charged int"
_NAMES = [c.split()[0] for c in ANSWERED.split(", ")]


class RequestScorer(Protocol):
    attempts: int

    def open(self) -> Ask: ...


def first_lines(df: DataFrame, n: int, span: int = 1 << 16) -> DataFrame:
    """The n rows with the smallest lines; no task sorts more than the rows of ``span`` lines."""
    binned = df.withColumn("_bin", F.floor(F.col("line") / span))
    bins = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    ahead = bins.select("_bin", (F.sum("n").over(Window.orderBy("_bin")) - F.col("n")).alias("_ahead")).where(F.col("_ahead") < n)  # a row per span lines
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("line"))
    return binned.join(ahead, "_bin").withColumn("_place", place + F.col("_ahead")).where(F.col("_place") <= n).drop("_bin", "_ahead", "_place")


def _asked(scorer: RequestScorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = TaskContext.get().attemptNumber() > 0
        ask = None if again else scorer.open()
        for batch in batches:
            got = []
            for state, allowed, tried in zip(*(batch.column(i).to_pylist() for i in (5, 4, 3)), strict=True):
                if again:
                    got.append((None, None, 0, allowed, tried))
                    continue
                answer, failure, made = ask(state, allowed, tried)
                got.append((None if answer is None else json.dumps(answer), failure, made, made, tried + made))
            answer, failure, made, charged, tried = zip(*got, strict=True) if got else ((),) * 5
            plain = lambda x: pa.array(x, pa.int32())
            columns = [batch.column(0), batch.column(1), batch.column(2), plain(tried), batch.column(4), pa.array(answer, pa.string()), pa.array(failure, pa.string()), plain(made), plain(charged)]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


class Ledger:
    """Grants and answers of the rounds of a run, as tables ``<path>/<round>/granted`` and ``answered``."""

    def __init__(self, states: DataFrame, path: str | None = None):
        self.states, self.spark = states, states.sparkSession
        self.path = (path or new_path(self.spark, "ledger")).rstrip("/")

    def _table(self, n: int, name: str) -> str:
        return f"{self.path}/{n}/{name}"

    def _read(self, n: int, name: str) -> DataFrame | None:
        where = self._table(n, name)
        return self.spark.read.parquet(where) if exists(self.spark, f"{where}/_SUCCESS") else None

    def grant(self, n: int, open_: DataFrame, left: int, attempts: int, tasks: int) -> DataFrame:
        """Write what the states of ``open_(state_hash, line, asking, tried)`` may ask, ``left`` in all."""
        count = open_.count()
        chosen = first_lines(open_, left) if count > left else open_
        allowed = F.least(F.lit(attempts) - F.col("tried"), F.lit(max(1, left // max(1, count)))).cast("int")
        granted = chosen.select("state_hash", "line", "asking", "tried", allowed.alias("allowed")).join(self.states.select("state_hash", "state"), "state_hash")
        granted.repartition(tasks).write.parquet(self._table(n, "granted"))
        return self._read(n, "granted")

    def answer(self, n: int, granted: DataFrame, scorer: RequestScorer, tasks: int) -> DataFrame:
        asked = granted.select("state_hash", "line", "asking", "tried", "allowed", "state").coalesce(tasks)  # no shuffle: a stage that is never run again
        asked.mapInArrow(_asked(scorer), ANSWERED).write.mode("overwrite").parquet(self._table(n, "answered"))
        return self._read(n, "answered")


def ask_within(states: DataFrame, scorer: RequestScorer, judge: Callable[[DataFrame], DataFrame], budget: int, tasks: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ask about ``states(state_hash, state, line)``, each once, with at most ``budget`` requests in all.

    ``judge`` adds ``answer_error`` and the parts of a decision to rows with ``failure`` and the columns
    of a response. Returns the judged answers, a row per state that got one or failed, and
    ``(state_hash, requests)``, the requests made for each state. States without a row were not settled
    when the budget ended. ``path``: a folder for the ledger, which outlives a failed run.
    """
    ledger, n, spent, done, made = Ledger(states, path), 0, 0, None, None
    open_ = states.select("state_hash", "line", F.lit(1).alias("asking"), F.lit(0).alias("tried"))
    while True:
        granted = ledger._read(n, "granted")
        answered = None if granted is None else ledger._read(n, "answered")
        left = budget - spent
        if granted is None:
            if left <= 0 or open_.isEmpty():
                break
            granted = ledger.grant(n, open_, left, scorer.attempts, tasks)
            answered = ledger.answer(n, granted, scorer, tasks)
        if answered is None:  # an earlier run stopped here
            answered = granted.select("state_hash", "line", "asking", "tried", "allowed", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("failure"), F.lit(0).alias("made"), F.col("allowed").alias("charged"))
        spent += answered.agg(F.sum("charged")).first()[0] or 0
        full = answered.withColumn("response", F.from_json("answer", RESPONSE))
        waits = F.col("answer").isNull() & F.col("failure").isNull()
        judged = cut(judge(full.where(~waits).select("state_hash", "line", "asking", "failure", "response.*")), "answers")
        again = F.col("failure").isNull() & F.col("answer_error").isNotNull() & (F.col("asking") == 1)
        settled = judged.where(~again)
        done = settled if done is None else done.unionByName(settled)
        requests = answered.select("state_hash", "made")
        made = requests if made is None else made.unionByName(requests)
        later = open_.join(granted.select("state_hash"), "state_hash", "left_anti")
        later = later.unionByName(judged.where(again).select("state_hash", "line", F.lit(2).alias("asking"), F.lit(0).alias("tried")))
        open_ = cut(later.unionByName(answered.where(waits).select("state_hash", "line", "asking", "tried")), "open")
        n += 1
    if done is None:
        none = states.limit(0).select("state_hash", "line", F.lit(1).alias("asking"), F.lit(None).cast("string").alias("failure"), F.lit(None).cast(RESPONSE).alias("response"))
        done = judge(none.select("state_hash", "line", "asking", "failure", "response.*"))
        made = states.limit(0).select("state_hash", F.lit(0).alias("made"))
    return done.drop("line", "asking"), made.groupBy("state_hash").agg(F.sum("made").alias("requests"))


def spent_in(spark, path: str) -> int:
    """What the rounds of a ledger have spent; a round without answers in full."""
    n = total = 0
    while exists(spark, f"{path}/{n}/granted/_SUCCESS"):
        done = exists(spark, f"{path}/{n}/answered/_SUCCESS")
        table = spark.read.parquet(f"{path}/{n}/{'answered' if done else 'granted'}")
        total += table.agg(F.sum("charged" if done else "allowed")).first()[0] or 0
        n += 1
    return total
