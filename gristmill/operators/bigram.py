"""A byte-bigram model: counts, losses before each update, held-out evaluation.

Texts become transitions between byte tokens inside Arrow batches; a task hands on at most one row
per cell of the model (258 contexts, 257 tokens), and cells are summed by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config as C
from gristmill.functions.scratch import cut

ALPHA = 0.5
#: Tokens: bytes, then the end mark; the start mark is only ever a context. Fixed values.
EOS, BOS, VOCABULARY = 256, 257, 257
CELLS = (VOCABULARY + 1) * VOCABULARY
#: Steps whose losses one task finds: at most 128 x 32 texts of 4096 bytes, and 79 parts of 10,000 steps.
PART_STEPS = 128


def batches(train: DataFrame, config: dict[str, Any], rows: int | None = None) -> DataFrame:
    """The visits of training: ``step, epoch, line, text``, in batches of consecutive lines, epochs in turn.

    At most ``max_steps * batch_size`` lines take part; the one window over them holds only line numbers
    (320,000 at the greatest settings), and texts, cut to what the model reads, join them.
    ``rows``: the number of records, where the caller has it.
    """
    size, steps = config["batch_size"], config["max_steps"]
    rows = train.count() if rows is None else rows
    per_epoch = -(-rows // size)
    first = train.select("line").orderBy("line").limit(size * min(steps, max(per_epoch, 1)))
    numbered = first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("line")) - 1) / size))
    epochs = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(config["epochs"]))))
    visits = epochs.select("line", "epoch", ((F.col("epoch") - 1) * per_epoch + F.col("batch") + 1).cast("long").alias("step")).where(F.col("step") <= steps)
    return train.select("line", F.left("text", F.lit(config["max_seq_length"])).alias("text")).join(visits, "line").select("step", "epoch", "line", "text")


def tokens(column: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts (the first ``limit`` bytes and the end mark), and each text's number of tokens."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    size = np.minimum(np.diff(offsets), limit) + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if n else 0
    text = np.repeat(np.arange(n), size)
    place = np.arange(total) - np.repeat(ends - size, size)
    last = ends - 1
    token = np.full(total, EOS, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    token[inner] = data[(offsets[:-1][text] + place)[inner]]
    context = np.empty(total, np.int64)
    context[1:] = token[:-1]
    context[place == 0] = BOS
    return context, token, size


def counts(rows: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """Transitions of rows with ``text``: ``[by,] prev, token, n``; few values of ``by``, at most CELLS rows each."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in found:
            context, token, size = tokens(batch.column(1), limit)
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            cell = context * VOCABULARY + token
            group = np.repeat(which, size)
            for i, name in enumerate(names.tolist()):
                seen.setdefault(name, np.zeros(CELLS, np.int64))
                seen[name] += np.bincount(cell[group == i] if len(names) > 1 else cell, minlength=CELLS)
        for name, table in seen.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array((at // VOCABULARY).astype(np.int32)), pa.array((at % VOCABULARY).astype(np.int32)), pa.array(table[at])], ["by", "prev", "token", "n"])

    value = F.col(by).cast("string") if by else F.lit("")
    part = rows.select(value.alias("by"), "text").mapInArrow(run, "by string, prev int, token int, n long")
    keys = (["by"] if by else []) + ["prev", "token"]
    out = part.groupBy(*keys).agg(F.sum("n").alias("n"))
    return out.withColumnRenamed("by", by) if by else out


def token_sums(rows: DataFrame, limit: int) -> DataFrame:
    """``line, n_tokens, total``: how many tokens each text has and the sum of their numbers."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            _, token, size = tokens(batch.column(1), limit)
            sums = np.add.reduceat(token, np.cumsum(size) - size) if len(size) else size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(sums)], ["line", "n_tokens", "total"])

    return rows.select("line", "text").mapInArrow(run, "line long, n_tokens long, total long")


def totals(model: DataFrame) -> DataFrame:
    return model.groupBy("prev").agg(F.sum("n").alias("total"))


def part_counts(steps: DataFrame, limit: int) -> DataFrame:
    """``part, prev, token, n``: transitions of each part, PART_STEPS consecutive steps. Summed, they are the model."""
    return counts(steps.withColumn("part", _part()), limit, "part").withColumn("part", F.col("part").cast("long"))


def _part() -> Column:
    return F.floor((F.col("step") - 1) / PART_STEPS).cast("long")


def model_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def _standing(parts: DataFrame) -> DataFrame:
    """``part, prev, token, n``: for the cells and contexts (token null) that occur in a part, their count in all parts before it."""
    contexts = parts.groupBy("part", "prev").agg(F.lit(None).cast("int").alias("token"), F.sum("n").alias("n")).select(*parts.columns)
    earlier = Window.partitionBy("prev", "token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.unionByName(contexts).withColumn("n", F.sum("n").over(earlier)).where("n is not null")


def loss_history(steps: DataFrame, limit: int, parts: DataFrame | None = None) -> DataFrame:
    """``step, epoch, loss``: the mean loss of each step, each token scored with the counts before it.

    Parts of PART_STEPS steps are scored at once: what stood before a part is the running sum of the
    counts of earlier parts, and only within a part are steps followed in order. A task holds the visits of one
    part and one table of cells. ``parts``: the result of ``part_counts``, where the caller has it.
    """
    parts = part_counts(steps, limit) if parts is None else parts

    def before(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """How often each key stood earlier, in the table or in ``keys``."""
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.searchsorted(ordered, ordered)
        return table[keys] + rank

    def score(visits: pa.Table, standing: pa.Table) -> pa.Table:
        cells, contexts = np.zeros(CELLS, np.int64), np.zeros(VOCABULARY + 1, np.int64)
        whole = standing["token"].is_null().to_numpy()
        prev, token, n = (standing[c].fill_null(0).to_numpy() for c in ("prev", "token", "n"))
        cells[prev[~whole] * VOCABULARY + token[~whole]] = n[~whole]
        contexts[prev[whole]] = n[whole]
        visits = visits.sort_by([("step", "ascending"), ("line", "ascending")]).combine_chunks()
        context, token, size = tokens(pa.concat_arrays(visits["text"].chunks) if visits.num_rows else pa.array([], pa.string()), limit)
        seen, total = before(context * VOCABULARY + token, cells), before(context, contexts)
        loss = -np.log((seen + ALPHA) / (total + ALPHA * VOCABULARY))
        step, first = np.unique(visits["step"].to_numpy(), return_index=True)
        begins = (np.cumsum(size) - size)[first]
        sums = np.add.reduceat(loss, begins) if len(step) else loss
        long = np.diff(np.append(begins, len(loss)))
        return pa.table({"step": pa.array(step, pa.int64()), "epoch": pa.array(visits["epoch"].to_numpy()[first], pa.int32()), "loss": pa.array(sums / long, pa.float64())})

    visits = steps.select("step", "epoch", "line", "text", _part().alias("part"))
    return visits.groupBy("part").cogroup(_standing(parts).groupBy("part")).applyInArrow(score, "step long, epoch int, loss double")


def evaluate(df: DataFrame, model: DataFrame | None, limit: int, by: list[str] | None = None) -> DataFrame:
    """``tokens, loss`` of rows with ``text``: token-weighted mean; without a model it is uniform."""
    by = by or []
    rows = counts(df, limit, by[0] if by else None).withColumnRenamed("n", "w")
    if model is None:
        rows = rows.withColumn("n", F.lit(0)).withColumn("total", F.lit(0))
    else:  # the model has a fixed size: 258 contexts, 257 tokens
        rows = rows.join(F.broadcast(model), ["prev", "token"], "left").join(F.broadcast(totals(model)), "prev", "left")
    loss = -F.log((F.coalesce("n", F.lit(0)) + ALPHA) / (F.coalesce("total", F.lit(0)) + ALPHA * VOCABULARY))
    return rows.groupBy(*by).agg(F.sum("w").alias("tokens"), (F.sum(loss * F.col("w")) / F.sum("w")).alias("loss"))


def perplexity(loss: float | None) -> float | None:
    return math.exp(loss) if loss is not None and loss < 700 else None


def exported(table: np.ndarray, limit: int) -> dict[str, Any]:
    """The model as nested lists for export."""
    return {"model_type": "utf8_byte_bigram", "vocabulary_size": VOCABULARY, "bos": BOS, "eos": EOS, "smoothing_alpha": ALPHA, "counts": table.tolist(), "context_totals": table.sum(axis=1).tolist(), "max_seq_bytes": limit}


def train_and_evaluate(split: DataFrame, config: dict[str, Any] | None = None, train_rows: int | None = None) -> dict[str, Any]:
    """Model report of records with ``line, text, split``.

    ``train_rows``: the number of training records, from a caller whose ``split`` is a written table.
    """
    cfg = C.training_config(config)
    limit = cfg["max_seq_length"]
    if train_rows is None:
        split = cut(split.select("line", "text", "split"), "texts")
    steps = cut(batches(split.where("split = 'train'"), cfg, train_rows), "steps")
    parts = cut(part_counts(steps, limit), "parts")
    cells = model_of(parts).toArrow()  # at most CELLS rows
    table = np.zeros((VOCABULARY + 1, VOCABULARY), np.int64)
    table[cells["prev"].to_numpy(), cells["token"].to_numpy()] = cells["n"].to_numpy()
    model = F.broadcast(split.sparkSession.createDataFrame(cells))
    scored = counts(split.where("split != 'train'"), limit, "split").withColumnRenamed("n", "w")
    totals_of = F.broadcast(split.sparkSession.createDataFrame(pa.table({"prev": pa.array(np.arange(VOCABULARY + 1), pa.int32()), "total": table.sum(axis=1)})))
    scored = scored.join(model, ["prev", "token"], "left").join(totals_of, "prev")
    loss = lambda n, t: F.sum(-F.log((n + ALPHA) / (t + ALPHA * VOCABULARY)) * F.col("w")) / F.sum("w")
    none = F.lit(0)
    read = {r["split"]: r for r in scored.groupBy("split").agg(F.sum("w").alias("tokens"), loss(none, none).alias("before"), loss(F.coalesce("n", none), F.col("total")).alias("after")).collect()}
    history = [r.asDict() for r in loss_history(steps, limit, parts).orderBy("step").collect()]
    out: dict[str, Any] = {"steps": len(history), "training_record_visits": int(table[:, EOS].sum()), "loss_history": history, "evaluation_tokens": {s: r["tokens"] for s, r in read.items()}}
    for s in ("validation", "test"):
        a, b = read[s]["before"], read[s]["after"]
        out |= {f"baseline_{s}_loss": a, f"trained_{s}_loss": b, f"baseline_{s}_perplexity": perplexity(a), f"trained_{s}_perplexity": perplexity(b), f"delta_{s}_loss": b - a, f"{s}_tokens": read[s]["tokens"]}
    out["model"] = exported(table, limit)
    return out


def rate_at(step: Column, steps: Column, rate: float) -> Column:
    """Warm-up over a tenth of the steps, then linear decay; steps count from 0."""
    warm = F.greatest(F.lit(1), F.floor(steps / 10))
    return rate * F.when(step < warm, (step + 1) / warm).otherwise(F.greatest(F.lit(0.0), (steps - step) / F.greatest(F.lit(1), steps - warm)))
