"""Training texts as token ids, with the part that a loss on answers leaves out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODED = "line long, ids array<int>, masked int"
#: Bytes of text encoded at once: what a tokenizer returns takes some hundred times as much memory as the ids.
CHUNK = 1 << 19


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK bytes of text, a row at least."""
    first, size = 0, 0
    sizes = np.add(*(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False) for i in (1, 2)))
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > CHUNK:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if len(sizes) > first:
        yield batch.slice(first)


def encode(rows: DataFrame, tokenizer: str, eos: int, limit: int, answer_only: bool = True) -> DataFrame:
    """``line, ids, masked`` of rows with ``line`` and ``x``, their ``answer_split``.

    ``ids``: the first ``limit - 1`` tokens of the full text, then ``eos``. ``masked``: how many of them
    the loss leaves out, the prompt's tokens if those begin the text's and do not make up all of it,
    else 0. ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        for batch in (part for whole in batches for part in chunks(whole)):
            full = [x.ids for x in t.encode_batch_fast([s or "" for s in batch.column(1).to_pylist()], add_special_tokens=False)]
            prompts = [x.ids for x in t.encode_batch_fast([s or "" for s in batch.column(2).to_pylist()], add_special_tokens=False)]
            ids = [[*x[: limit - 1], eos] for x in full]
            masked = [len(p) if answer_only and p and len(p) < len(x) and x[: len(p)] == p else 0 for x, p in zip(ids, prompts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(masked, pa.int32())], ["line", "ids", "masked"])

    return rows.select("line", F.col("x.full").alias("full"), F.col("x.prompt").alias("prompt")).mapInArrow(run, ENCODED)


def masking_totals(encoded: DataFrame) -> DataFrame:
    """``masked_rows, prompt_tokens, learned_tokens`` of ``encode``'s result."""
    return encoded.agg(F.count_if(F.col("masked") > 0).alias("masked_rows"), F.sum("masked").cast("long").alias("prompt_tokens"), F.sum(F.size("ids") - F.col("masked")).cast("long").alias("learned_tokens"))
