"""Periodic runs: stretches of words that repeat with a smallest period, found by block matching.

For a scale B = 1, 2, 4, ... the aligned blocks of B words of a document are the keys of an
Aho-Corasick automaton over word numbers, which is run over the whole document. A run with a period q
between 2B - 1 and 4B - 2 holds an aligned block that occurs again q words later, so an occurrence is
a seed only at such a distance, and each occurrence has two aligned places to be compared with. Seeds
of one distance at neighbouring blocks are one stretch, which is extended to both sides by the blocks of
smaller scales, largest first: block numbers are equal exactly where words are. A stretch at least as
long as its distance makes a run; of runs with one extent the smallest period stays.

A block whose halves do not both occur twice has no second occurrence and is no key, so large scales
cost little in ordinary text. A document takes n log n steps and, at a time, the automaton of one scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from ahocorasick import KEY_SEQUENCE, STORE_INTS, Automaton
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import let
from gristmill.llm.words import Words, buffers, chunks

LEAST, TIMES = 12, 2
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Scale:
    """Blocks of ``size`` words: ``blocks[j]`` is the number of the aligned block j, ``at[x]`` of the one
    that begins at word x; -1 where a block is no key. ``twice[i]``: block i occurs more than once."""

    def __init__(self, size: int, blocks: np.ndarray, at: np.ndarray):
        self.size, self.blocks, self.at = size, blocks, at
        found = at[at >= 0]
        self.twice = np.bincount(found) > 1 if len(found) else np.zeros(0, bool)


def _next_scale(words: np.ndarray, sequence: tuple, last: _Scale) -> _Scale | None:
    """Blocks of twice the size; None where none can occur twice."""
    size = last.size * 2
    n = len(words) // size
    halves = last.blocks[: 2 * n].reshape(n, 2)
    keys = np.flatnonzero((halves >= 0).all(axis=1) & last.twice[halves].all(axis=1)) if len(last.twice) else ()
    if not len(keys):
        return None
    numbers: dict[tuple, int] = {}
    blocks = np.full(n, -1, np.int64)
    blocks[keys] = [numbers.setdefault(sequence[j * size : (j + 1) * size], len(numbers)) for j in keys.tolist()]
    automaton = Automaton(STORE_INTS, KEY_SEQUENCE)
    for key, number in numbers.items():
        automaton.add_word(key, number)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2)  # last word of an occurrence, block
    at = np.full(len(words), -1, np.int64)
    at[found[:, 0] - size + 1] = found[:, 1]
    return _Scale(size, blocks, at)


def _stretches(scale: _Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches ``first:end`` of aligned blocks whose words come again ``distance`` later, in the scale's distances."""
    size = scale.size
    x = np.flatnonzero(scale.at >= 0)
    x = x[scale.twice[scale.at[x]]]
    near = (x - 2 * size + 1) // size
    place, block = np.concatenate((x, x)), np.concatenate((near, near - 1))
    keep = block >= 0
    place, block = place[keep], block[keep]
    keep = scale.blocks[block] == scale.at[place]
    first, distance = block[keep] * size, place[keep] - block[keep] * size
    order = np.lexsort((first, distance))
    first, distance = first[order], distance[order]
    opens = np.ones(len(first), bool)
    opens[1:] = (distance[1:] != distance[:-1]) | (first[1:] != first[:-1] + size)
    lead = np.flatnonzero(opens)
    return first[lead], first[np.append(lead[1:], len(first)) - 1] + size if len(first) else first, distance[lead]


def _extended(scales: list[_Scale], first: np.ndarray, end: np.ndarray, distance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends of stretches of the last scale, moved out as far as the words agree."""
    for s in reversed(scales[:-1]):
        left = first - s.size
        ok = np.flatnonzero(left >= 0)
        block = s.blocks[left[ok] // s.size]
        ok = ok[(block >= 0) & (block == s.at[left[ok] + distance[ok]])]
        first[ok] -= s.size
        ok = np.flatnonzero(end + distance + s.size <= n)
        block = s.blocks[end[ok] // s.size]
        ok = ok[(block >= 0) & (block == s.at[end[ok] + distance[ok]])]
        end[ok] += s.size
    return first, end


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence of word numbers, by start, then period."""
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, 2):
        return none
    words = np.unique(words, return_inverse=True)[1].astype(np.int64)
    sequence = tuple(words.tolist())
    scales, found = [_Scale(1, words, words)], [none]
    while True:
        first, end, distance = _stretches(scales[-1])
        if len(first):
            first, end = _extended(scales, first, end, distance, n)
            length = end - first + distance
            keep = (length >= least) & (length >= times * distance)
            found.append(np.stack((first, length, distance), axis=1)[keep])
        scale = _next_scale(words, sequence, scales[-1]) if 4 * scales[-1].size - 1 <= n // 2 else None
        if scale is None:
            break
        scales.append(scale)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs) > 1:
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _search(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                words = Words(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
                codes, gone = words.codes(), np.zeros(len(words.starts) + 1, np.int64)
                parts, sizes = [], [0]
                for i in range(hi - lo):
                    at = words.first[i]
                    runs = find_runs(codes[at : words.first[i + 1]], least, times)
                    np.add.at(gone, at + runs[:, 0] + runs[:, 2], 1)
                    np.add.at(gone, at + runs[:, 0] + runs[:, 1], -1)
                    parts.append(runs)
                    sizes.append(sizes[-1] + len(runs))
                columns = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
                runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns.T], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), runs, _joined(words, np.cumsum(gone[:-1]) > 0)], ["doc_id", "runs", "collapsed"])

    return run


def _joined(words: Words, gone: np.ndarray) -> pa.Array:
    """Each document's words, joined by one space, without those that are gone."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.starts[gone]] += 1
    edge[words.ends[gone]] -= 1
    blanked = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(32), words.data)
    return Words(words.offsets, blanked).canonical().cast(pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per input row: ``doc_id, runs, collapsed``.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with smallest period q, of at least
    ``least`` words and ``times`` periods, that no neighbouring word extends; ``runs`` has all of them as
    (start, length, period) by start, then period. ``collapsed``: the words, joined by one space, without
    those that some run holds after its first period.

    Null and blank text: no runs, empty ``collapsed``. Repeated rows and null ids are rows like others.
    Whole texts are searched, however long. Other columns are not read; an empty table gives an empty
    result. ``times`` is 2 at least, since the search finds stretches that hold a period twice.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_search(least, times), f"doc_id {dict(rows.dtypes)['doc_id']}, runs {RUNS}, collapsed string")


def planted(id_col: Column, text: Column) -> Column:
    """``text`` with the words of every tenth document (by a CRC of its id) made periodic from some word on."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.expr("1L") + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        both = let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))))
        return F.when(n > 0, F.array_join(both, " ")).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), let(words, periodic)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = found.withColumn("best", best).withColumn("period", -F.col("best.p")).withColumn("length", F.col("best.l"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
