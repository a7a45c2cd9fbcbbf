"""Exact dedup by a tree merge of sorted digest runs.

Every partition of the scan becomes a run: its digests, sorted, each standing once. Runs then meet in
binomial rounds: FAN_IN neighbouring runs cut their rows by digest prefix into the same ranges and
exchange them, and a task merges the pieces it gets of each run (they arrive sorted) into one run, in
which a digest again stands once with the smallest identifier and the summed size. At least one round
follows the first runs, whatever their number, and the last round leaves one run, so two equal
digests always meet, however the tables in between are split for reading. A digest held by a third
of all rows enters a round with a row for each run at most, so no task gets a hot key, and rounds
number the logarithm of the partitions. The tasks of a round follow from the rows that enter it.

Rows are the same only if SHA-256, byte length and an independent 64-bit hash agree; all three are
compared at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut
from gristmill.llm.semi import without

FAN_IN, TASK_ROWS = 16, 400_000
SPACES = r"[\x20\x09-\x0D]+"
RUN = "run int, digest binary, size long, check long, keep_id long, keep_row long, n long"
KEYS = ["digest", "size", "check"]
_NO_ID = np.iinfo(np.int64).max


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, " ")


class Run:
    """Rows of a run in ascending order of digest, size, check and identifier (null last), as columns."""

    def __init__(self, words: np.ndarray, rest: np.ndarray, known: np.ndarray):
        self.words, self.rest, self.known = words, rest, known  # digest as 4 integers; size, check, id, row, n; has an id

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table) -> Run:
        digest = batch["digest"].cast(pa.binary(32)) if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index("digest")).cast(pa.binary(32))
        if isinstance(digest, pa.ChunkedArray):
            digest = digest.combine_chunks()
        words = np.frombuffer(digest.buffers()[1], ">u8")[digest.offset * 4 : (digest.offset + len(digest)) * 4].astype(np.uint64).reshape(-1, 4)
        ids = batch["keep_id"]
        cols = [batch["size"], batch["check"], ids.fill_null(_NO_ID), batch["keep_row"], batch["n"]]
        return cls(words, np.stack([np.asarray(c, np.int64) for c in cols], axis=1), np.asarray(ids.is_valid()))

    def __len__(self) -> int:
        return len(self.words)

    def take(self, at: np.ndarray) -> Run:
        return Run(self.words[at], self.rest[at], self.known[at])

    def identity_starts(self) -> np.ndarray:
        """Where a new identity begins."""
        new = np.ones(len(self), bool)
        new[1:] = (self.words[1:] != self.words[:-1]).any(axis=1) | (self.rest[1:, :2] != self.rest[:-1, :2]).any(axis=1)
        return np.flatnonzero(new)

    def order(self) -> np.ndarray:
        keys = [self.rest[:, 3], self.rest[:, 2], ~self.known, self.rest[:, 1], self.rest[:, 0], *self.words.T[::-1]]
        return np.lexsort(keys)

    def sorted(self) -> Run:
        """In full order; most rows are placed by the first 8 bytes of their digests alone."""
        head = self.words[:, 0]
        if len(self) > 1 and not (head[1:] > head[:-1]).all():
            order = np.argsort(head, kind="stable")  # merges the ascending stretches it finds
            head = head[order]
            tied = np.zeros(len(head), bool)
            tied[1:] = head[1:] == head[:-1]
            tied[:-1] |= tied[1:]
            out = self.take(order)
            at = np.flatnonzero(tied)
            if len(at):
                part = out.take(at)
                order = np.arange(len(out))
                order[at] = at[part.order()]
                out = out.take(order)
            return out
        return self

    def distinct(self) -> Run:
        """Each identity once, with its smallest identifier and the sum of its sizes."""
        if not len(self):
            return self
        first = self.identity_starts()
        total = np.add.reduceat(self.rest[:, 4], first)
        out = self.take(first)
        out.rest[:, 4] = total
        return out

    def write(self, run: int) -> pa.RecordBatch:
        digest = pa.Array.from_buffers(pa.binary(32), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.words.astype(">u8")))]).cast(pa.binary())
        size, check, ids, row, n = self.rest.T
        columns = [pa.array(np.full(len(self), run, np.int32)), digest, pa.array(size), pa.array(check), pa.array(ids, mask=~self.known), pa.array(row), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["run", *KEYS, "keep_id", "keep_row", "n"])


def merge_two(a: Run, b: Run) -> Run:
    """One sorted run of two: places are found by binary search on the first 8 bytes, ties settled in full."""
    place = np.searchsorted(a.words[:, 0], b.words[:, 0], "right") + np.arange(len(b))
    order = np.empty(len(a) + len(b), np.int64)
    mine = np.ones(len(order), bool)
    mine[place] = False
    order[place], order[mine] = len(a) + np.arange(len(b)), np.arange(len(a))
    both = Run(np.concatenate([a.words, b.words]), np.concatenate([a.rest, b.rest]), np.concatenate([a.known, b.known]))
    return both.take(order).sorted()


def merge_runs(runs: list[Run]) -> Run:
    """The multiway merge, as a binomial tree; identities are merged at every level."""
    while len(runs) > 1:
        runs = [merge_two(runs[i], runs[i + 1]).distinct() if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0].distinct()


def _pieces(parts: list[pa.RecordBatch]) -> dict[int, list[Run]]:
    """Sorted pieces of what a task has got, by the run they now belong to."""
    out: dict[int, list[Run]] = {}
    table = pa.Table.from_batches(parts)
    runs = np.asarray(table["run"])
    for r in np.unique(runs):
        rows = Run.read(table.take(pa.array(np.flatnonzero(runs == r))))
        falls = np.flatnonzero(rows.words[1:, 0] < rows.words[:-1, 0]) + 1
        if len(falls) > 4096:  # the exchange has mixed the pieces: sort instead
            out[int(r)] = [rows.sorted()]
        else:
            edges = [0, *falls.tolist(), len(rows)]
            out[int(r)] = [rows.take(np.arange(s, e)).sorted() for s, e in zip(edges, edges[1:], strict=False)]
    return out


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches of a partition; equal digests of one stretch become one row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_ROWS:
            for r, runs in _pieces(held).items():
                yield merge_runs(runs).write(r)
            held = []
    if held:
        for r, runs in _pieces(held).items():
            yield merge_runs(runs).write(r)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow table of identities: run (partition of the scan), row, id, digest, size, check."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("text"))
    return text.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("check"),
    )


def _merge_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one range of some runs, a bounded number of rows, merged."""
    held = [b for b in batches if b.num_rows]
    if held:
        for r, runs in _pieces(held).items():
            yield merge_runs(runs).write(r)


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row for each distinct text of ``digests()``: digest, size, check, keep_id, keep_row, n."""
    spark = rows.sparkSession
    runs = rows.select("run", *KEYS, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n")).mapInArrow(_first_runs, RUN)
    seen = rows.agg(F.max("run").alias("last"), F.count("*").alias("n")).first()
    width, tasks = 1 + (seen["last"] or 0), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // task_rows))
    while True:
        width = -(-width // fan_in)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(tasks, "run", F.substring("digest", 1, 3)).mapInArrow(_merge_round, RUN)
        if width == 1:
            return runs.drop("run")


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = cut(digests(docs, id_col, text_col), "digests")
    groups = cut(merged_runs(rows).where("n > 1"), "groups")
    out = rows.join(groups, KEYS, "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space is replaced by one space; null
    counts as empty, and all empty texts are equal. Of equal texts the row with the smallest id
    stays; of rows that repeat that id exactly one stays. Null ids come after all others. Other
    columns are not read; an empty table gives an empty result.
    """
    out = _decided(docs, id_col, text_col)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = cut(digests(docs, id_col, text_col), "digests")
    groups = merged_runs(rows).where("n > 1").select(*KEYS, "keep_id", "keep_row")
    gone = cut(rows.join(cut(groups, "groups"), KEYS).where("row != keep_row").select("doc_id", "keep_id", "digest"), "gone")
    plain = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    if plain:
        return without(docs, F.col(id_col).cast("long"), gone.select("doc_id"))
    # Some id is null or repeated: rows are told apart by their texts too, and of rows that repeat an
    # id with its text one stays.
    digest = F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))
    tagged = docs.select(F.struct("*").alias("__gm_all"), F.col(id_col).cast("long").alias("__gm_id"), digest.alias("__gm_digest"))
    lost = gone.where("not (doc_id <=> keep_id)").select(F.col("doc_id").alias("__gm_gone"), F.col("digest").alias("__gm_lost")).distinct()
    left = tagged.join(lost, F.col("__gm_id").eqNullSafe(F.col("__gm_gone")) & (F.col("__gm_digest") == F.col("__gm_lost")), "left_anti")
    return left.dropDuplicates(["__gm_id", "__gm_digest"]).select("__gm_all.*")
