"""Vector codes: parts of vectors as indexes into learned codebooks, found through VA-file filtering.

Components become integers floor(1024 x) and a vector is cut into equal parts. Every part position has
a codebook, which starts as that part of the vectors with the smallest ids; a round assigns all parts
to their nearest entries and replaces an entry by the floored mean of its parts.

Nearest entries are found by a vector approximation file of the codebook: in every dimension the
entries' coordinates are quantised to 2**BITS cells of about equally many entries. For a part, a table per
dimension gives the least and the greatest squared distance to any coordinate of each cell; summed over
an entry's cells they bound its distance from below and above. Entries whose lower bound exceeds the
smallest upper bound are out, and only the others are compared, in integers.

A round reads the table once; a task hands on one row of sums for each entry, so the codebooks (at most
parts x entries rows) are all that the driver ever holds. Codes, errors and label sums stay in Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut

SCALE, PARTS, ENTRIES, ROUNDS, BITS, ROWS = 1024, 4, 256, 4, 4, 256


class Cells:
    """The approximation file of a codebook: a row per entry, of one part."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, width = entries.shape
        count = max(1, min(n, 1 << bits))
        self.entries = entries
        self.cell = np.empty((width, n), np.int64)  # the cell of each entry in each dimension
        self.low, self.high = np.empty((width, count), np.int64), np.empty((width, count), np.int64)
        edges = np.arange(count + 1) * n // count
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            self.cell[d, order] = np.repeat(np.arange(count), np.diff(edges))
            ranked = entries[order, d]
            self.low[d], self.high[d] = ranked[edges[:-1]], ranked[edges[1:] - 1]

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of parts (rows) to entries (columns)."""
        x = parts[:, :, None]
        under, over = self.low - x, x - self.high
        least = np.maximum(np.maximum(under, over), 0) ** 2
        most = np.maximum(-under, -over) ** 2
        lower, upper = np.zeros((len(parts), len(self.entries)), np.int64), np.zeros((len(parts), len(self.entries)), np.int64)
        for d, cell in enumerate(self.cell):
            lower += least[:, d].take(cell, axis=1)
            upper += most[:, d].take(cell, axis=1)
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part; the lower index of equally near ones."""
        if not self.entries.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # by row, then entry
        far = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        start = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(far, start)
        hits = np.flatnonzero(far == best[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(parts)))]], best


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an array column without nulls, all of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def _assigned(vectors: pa.Array, cells: list[Cells]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, their numbers by part, nearest entries and distances."""
    for lo in range(0, len(vectors), ROWS):
        x = whole_numbers(matrix(vectors.slice(lo, ROWS)))
        parts = x.reshape(len(x), len(cells), -1)
        near = [c.nearest(parts[:, i]) for i, c in enumerate(cells)]
        yield lo, parts, np.stack([a for a, _ in near], axis=1), np.stack([b for _, b in near], axis=1)


def _sums(codebooks: np.ndarray):
    """Per task: for each used entry its number of parts and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        cells = [Cells(c) for c in codebooks]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x, code, _ in _assigned(batch.column(0), cells):
                for i in range(parts):
                    np.add.at(n[i], code[:, i], 1)
                    np.add.at(total[i], code[:, i], x[:, i])
        part, entry = np.nonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), sums], ["part", "entry", "n", "sums"])

    return run


def _codes(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        for batch in batches:
            for lo, x, code, far in _assigned(batch.column(1), cells):
                text = pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(x)), batch.column(2).slice(lo, len(x)), text, pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def sound(vector: str) -> F.Column:
    """The vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def learn_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of ``rows(vec_id, v)`` whose vectors are sound; empty without rows."""
    size = F.size("v")
    seen = rows.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("peak")).first()
    if seen["most"] is None:
        return np.zeros((parts, 0, 0), np.int64)
    if seen["least"] != seen["most"] or seen["most"] % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; there are lengths {seen['least']} to {seen['most']}")
    if seen["most"] and (seen["peak"] or 0) * SCALE >= 2**29 / math.sqrt(seen["most"]):
        raise ValueError("squared distances of such large components do not fit a long")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    x = whole_numbers(np.array([r["v"] for r in first], np.float64).reshape(len(first), -1))
    books = x.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds if width else 0):
        sums = rows.select("v").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(exact(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")).collect():
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per sound vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are dropped. ``code``: two hexadecimal
    digits a part. ``error``: squared distances to the chosen entries, summed over parts, in the scaled
    integers. ``label_error``: the sum of errors over equal labels, nulls together. Each part is
    assigned to the entry of the smallest squared distance, the lower index on ties; entries start as the
    vectors of the smallest ids (null ids last, equal ids by vector) and there are fewer if there are
    fewer vectors. Repeated rows count as often as they stand. Other columns are not read; an empty table
    gives an empty result. Vectors of several lengths, of a length that ``parts`` does not divide, or so
    large that their distances do not fit a long raise ValueError; so do more than 256 entries.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits")
    element = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), element.alias("v"), F.col(label_col).alias("label")).where(sound("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double"))) if "double" not in dict(rows.dtypes)["v"] and "float" not in dict(rows.dtypes)["v"] else rows
    books = learn_codebooks(rows.select("vec_id", "v"), parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = cut(rows.select("vec_id", "v", "label").mapInArrow(_codes(books), f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long"), "codes")
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "__gm_label")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("__gm_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
