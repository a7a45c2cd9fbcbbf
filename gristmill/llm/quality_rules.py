"""Quality rules whose cutoffs keep the rate of false rejections below a limit.

Every document gets a few statistics in one pass. A rule rejects a document when a statistic reaches
a cutoff; a document goes when any rule rejects it. All rules tighten together along one fixed
sequence of steps, from lenient to strict. Labelled documents of each stratum (language) decide which
step is used: a step is certified while the exact binomial tail P(X <= errors | n, limit) of the good
documents that any rule rejects at it stays at or below the level, and the last certified step before
the first failure is used (fixed-sequence testing). The level is divided by the strata (Bonferroni),
so with probability 1 - LEVEL the rules together reject at most LIMIT of the good documents of every
stratum. A stratum with too few labels certifies nothing and rejects nothing by these rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut
from gristmill.llm.semi import keyed, row_key, without
from gristmill.llm.words import SPACE, U, Words, buffers, chunks, mix, span_hashes, window_hashes

LIMIT, LEVEL = 0.02, 0.05
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def _counts(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    at = offsets[lo : hi + 1] - offsets[lo]
    part, n = data[offsets[lo] : offsets[hi]], hi - lo
    words = Words(at, part)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[at[1:]] - total[at[:-1]]

    solid = ~SPACE[part]
    chars = per_doc(solid & ((part & 0xC0) != 0x80))
    # Lines: a document without bytes has none with a word, so it may be left out.
    breaks = part == 10
    is_start = np.zeros(len(part) + 1, bool)
    is_start[1:] = breaks
    is_start[at[:-1]] = True
    starts = np.flatnonzero(is_start[:-1]) if len(part) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(part)) if len(starts) else starts
    closed = np.zeros(len(starts), bool)
    closed[:] = breaks[ends - 1] if len(starts) else False
    ends = ends - (closed & (ends > starts))
    seen = np.concatenate(([0], np.cumsum(solid)))
    worded = seen[ends] > seen[starts]
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(at, starts, "right") - 1
    h = span_hashes(part, starts, ends) ^ mix(doc.astype(np.uint64) + U(1))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    dup_lines, lines = np.bincount(doc[again], minlength=n), np.bincount(doc, minlength=n)
    # Words in repeated three-word windows.
    wdoc = np.repeat(np.arange(n), words.counts)
    w = window_hashes(words.hashes(), 3)
    valid = wdoc[2:] == wdoc[:-2] if len(w) else np.zeros(0, bool)
    index = np.flatnonzero(valid)
    key = w[index] ^ mix(wdoc[index].astype(np.uint64) + U(7))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(wdoc), bool)
    hit = index[twice]
    for i in range(3):
        covered[hit + i] = True
    return [words.counts, chars, per_doc(_SYMBOL[part]), dup_lines, np.bincount(wdoc[covered], minlength=n), per_doc(_UPPER[part]), lines]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(batch.schema.get_field_index("text")))
        keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
        for lo, hi in chunks(offsets):
            part = batch.slice(lo, hi - lo)
            counts = [pa.array(c.astype(np.int64)) for c in _counts(data, offsets, lo, hi)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *counts], [*(batch.schema.field(i).name for i in keep), *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, __gm_row`` and the counts of each document's whole text; null text counts as empty."""
    text, stratum = F.col(text_col).cast("string"), F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    row = keyed(docs, id_col, text, stratum).select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), "__gm_row", text.alias("text"))
    return row.mapInArrow(_statistics, "doc_id long, stratum string, __gm_row long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))


#: Rules: statistic as a ratio of counts, and its cutoff at each step; a document fails at or above one. Fixed values.
GRIDS: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "word_chars", [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]),
    "upper": ("n_upper", "word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1]),
    "dup_lines": ("n_dup_lines", "n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words", "n_words", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.05]),
    "long_words": ("word_chars", "n_words", [60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0]),
}
STEPS = 12


def rules() -> dict[str, tuple[Column, list[float]]]:
    return {name: (_share(a, b), grid) for name, (a, b, grid) in GRIDS.items()}


def binomial_tail(errors: int, n: int, rate: float) -> float:
    """P(X <= errors) for X binomial (n, rate), exactly up to rounding."""
    if errors >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(errors + 1)]
    top = max(logs)
    return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)


def certified(rejected: list[int], n: int, limit: float, level: float) -> int:
    """Index of the strictest certified step, -1 for none. ``rejected``: good documents rejected at each step."""
    last = -1
    for i, errors in enumerate(rejected):
        if errors >= n * limit or binomial_tail(errors, n, limit) > level:
            break
        last = i
    return last


def cutoffs(counted: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """``stratum`` and one column per rule with its cutoff; strata without a certified step do not come back.

    ``counted`` has the statistics of the labelled good documents. Rows are at most the strata with
    enough good documents to certify an errorless step.
    """
    table = rules()
    sums = []
    for step in range(STEPS):
        hit = F.lit(False)
        for stat, grid in table.values():
            hit = hit | (stat >= grid[step])
        sums.append(F.count_if(hit).alias(f"step_{step}"))
    per = cut(counted.where(~base_failed()).groupBy("stratum").agg(F.count("*").alias("n"), *sums), "strata")
    share = level / max(1, per.count())
    least = math.ceil(math.log(share) / math.log1p(-limit))
    grids = {name: grid for name, (_, grid) in table.items()}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            picks = [certified([r[f"step_{i}"] for i in range(STEPS)], r["n"], limit, share) for r in rows]
            out = [(r["stratum"], *(grid[i] for grid in grids.values())) for r, i in zip(rows, picks, strict=True) if i >= 0]
            if out:
                columns = [pa.array(c, pa.float64() if k else pa.string()) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["stratum", *grids])

    return per.where(F.col("n") >= least).mapInArrow(choose, "stratum string, " + ", ".join(f"{n} double" for n in table))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """One row per input row: ``doc_id, n_words``, four counts, ``base_failed``, ``kept``.

    ``labels`` has ``doc_id, quality``; quality 1 marks good documents, the holdout of the tests.
    Null or empty text has counts of 0 and fails the base. A null stratum is the stratum "". Rows
    repeated with one id are judged each; a label repeated for one id counts once and as good only if
    every copy says so. A null id has no label. Other columns are not read; an empty table gives an
    empty result, and without labels only the base rejects.
    """
    out = _verdicts(docs, labels, id_col, text_col, stratum_col, limit, level)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; rows are told apart by id, text and stratum."""
    gone = _verdicts(docs, labels, id_col, text_col, stratum_col, limit, level).where(~F.col("kept")).select("__gm_row").distinct()
    text, stratum = F.col(text_col).cast("string"), F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    return without(docs, row_key(id_col, text, stratum), cut(gone, "rejected"))


def _verdicts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, limit: float, level: float) -> DataFrame:
    stats = cut(statistics(docs, id_col, text_col, stratum_col), "statistics")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    table = cut(cutoffs(stats.join(good, "doc_id", "left_semi"), limit, level), "cutoffs")
    joined = stats.join(table, "stratum", "left")  # Spark broadcasts it below its size threshold, else splits skewed strata
    failed = F.lit(False)
    for name, (stat, _) in rules().items():
        failed = failed | F.coalesce(stat >= F.col(name), F.lit(False))
    return joined.withColumn("kept", ~base_failed() & ~failed)
