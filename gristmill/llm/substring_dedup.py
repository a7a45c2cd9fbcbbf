"""Removal of long passages that an earlier document has: a compacted de Bruijn graph of words.

Windows of k words are the edges of a de Bruijn graph whose nodes are (k-1)-word sequences. Only a
small part repeats, so paths are compacted before anything is shuffled:

1. Each window has a minimizer, the smallest hash of its m-word parts. A run of consecutive windows
   with one minimizer is a path without branches inside its document; it moves as one row with its
   source coordinates (document, position), its length and two 64-bit fingerprints of its words.
   Equal windows have equal minimizers wherever they stand, so a minimizer seen in one document
   only rules out all its windows.
2. Paths of repeated minimizers are joined to the smallest source coordinate of the same path
   (both fingerprints, length and minimizer agree): in every later document the whole path repeats.
3. Where one minimizer has several different paths the graph branches. The first occurrences of
   such paths are opened into their edges, and edges are joined to their smallest source.
4. Pieces that follow the same source on the same diagonal are compacted into maximal spans.
5. Fingerprints only propose. The words at the source coordinates are read once for each source,
   cut to each span and compared with the words of the span; a word goes only if a whole window
   around it agrees word by word.

A group of any size is only ever aggregated (with partial aggregation) and joined, never collected.
Texts are moved only for documents that give or lose a passage; the others are finished where they
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, drop
from gristmill.llm.semi import parted, perhaps_among
from gristmill.llm.words import Words, buffers, chunks, range_hashes, sliding_min, values_of, window_hashes

WINDOW, PART = 50, 12


def _paths(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                words = Words(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
                n = np.maximum(words.counts - k + 1, 0)
                if not n.sum():
                    continue
                h = words.hashes()
                least = sliding_min(window_hashes(h, m), k - m + 1)
                doc = np.repeat(np.arange(hi - lo), n)
                first = np.concatenate(([0], np.cumsum(n)))
                pos = np.arange(first[-1]) - first[:-1][doc]
                at = words.first[:-1][doc] + pos
                value = least[at]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(value)))
                s, e = at[begin], at[begin] + size + k - 1
                rows = pa.array(doc[begin] + lo)
                s1, s2 = range_hashes(h, s, e), range_hashes(words.hashes(1), s, e)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos[begin].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(value[begin].view(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))],
                    ["doc_id", "version", "pos", "n", "part", "s1", "s2"],
                )

    return run


def _edges(k: int):
    """Windows of requested paths: (doc_id, version, text, pos list, n list, part list) to a row for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                words = Words(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
                h = window_hashes(words.hashes(), k).view(np.int64)
                ask = [batch.column(c).slice(lo, hi - lo) for c in (3, 4, 5)]
                size = np.diff(ask[0].offsets.to_numpy())
                pos, n, part = (x.flatten() for x in ask)
                rows = np.repeat(np.arange(hi - lo), size)
                p, c = pos.to_numpy(), n.to_numpy().astype(np.int64)
                begin = words.first[:-1][rows] + p
                first = np.concatenate(([0], np.cumsum(c)))
                index = np.arange(first[-1]) - np.repeat(first[:-1] - begin, c)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h[index]))
                rows = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pos, part, lists], ["doc_id", "version", "pos", "part", "edges"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, source_version, text, starts, ends) to the words of each range, joined by a space."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        rows, at, out = [], [], []
        for i in range(batch.num_rows):
            words = texts[i].as_py().split()
            for s, e in zip(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), strict=True):
                rows.append(i)
                at.append(s)
                out.append(b" ".join(words[s:e]))
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(out, pa.binary())], ["source_id", "source_version", "island", "passage"])


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., skip, length, passage) to the span's own part of the passage, as ``words``."""
    for batch in batches:
        names = batch.schema.names
        held, split, out = None, [], []
        for skip, length, passage in zip(batch.column(names.index("skip")).to_pylist(), batch.column(names.index("length")).to_pylist(), batch.column(names.index("passage")), strict=True):
            passage = passage.as_py()
            if passage != held:
                held, split = passage, passage.split()
            out.append(b" ".join(split[skip : skip + length]))
        keep = [n for n in names if n not in ("skip", "passage")]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(out, pa.binary())], [*keep, "words"])


def agreeing(words: list[bytes], start: int, passage: list[bytes], k: int) -> list[tuple[int, int]]:
    """Ranges of ``words`` from ``start`` on that agree with the passage for k words or more."""
    own = words[start : start + len(passage)]
    if own == passage:
        return [(start, start + len(own))] if len(own) >= k else []
    out, run = [], 0
    for i, (x, y) in enumerate([*zip(own, passage, strict=False), (b"", None)]):
        if x == y:
            run += 1
            continue
        if run >= k:
            out.append((start + i - run, start + i))
        run = 0
    return out


def _verified(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(names.index(n)) for n in names}
            texts, rows, starts, lengths, at = col["text"].cast(pa.large_binary()), [], [], [], []
            held, split = None, []
            for i, (start, from_, passage) in enumerate(zip(col["start"].to_pylist(), col["source_start"].to_pylist(), col["words"].to_pylist(), strict=True)):
                key = (col["doc_id"][i].as_py(), col["version"][i].as_py())
                if key != held:
                    held, split = key, texts[i].as_py().split()
                for s, e in agreeing(split, start, passage.split(), k):
                    rows.append(i)
                    starts.append(s)
                    lengths.append(e - s)
                    at.append(from_ + s - start)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(rows), col["version"].take(rows), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), col["source_id"].take(rows), pa.array(at, pa.int32())], ["doc_id", "version", "start", "length", "source_id", "source_start"])

    return run


def _rebuild(k: int):
    """(doc_id, text, starts, words of passages) to counts, kept text's digest and kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                words = Words(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])
                texts, n_words = list(values_of(words.canonical())), words.counts
                n_removed, digests = np.zeros(hi - lo, np.int64), []
                for i in range(hi - lo):
                    starts = batch.column(2)[lo + i]
                    if not starts.is_valid or not len(starts):
                        digests.append(hashlib.sha256(texts[i]).hexdigest())
                        continue
                    all_, kept, last = texts[i].split(), [], 0
                    spans = [r for s, p in zip(starts.as_py(), batch.column(3)[lo + i].as_py(), strict=True) for r in agreeing(all_, s, p.split(), k)]
                    for s, e in sorted(spans):
                        if e > last:
                            kept += all_[last:s] if s > last else []
                            n_removed[i] += e - max(s, last)
                            last = e
                    digests.append(hashlib.sha256(b" ".join(kept + all_[last:])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n_removed), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _proposed(source: DataFrame, k: int, part: int) -> DataFrame:
    """Maximal spans by fingerprints: ``doc_id, version, start, length`` and the smallest source coordinate."""
    paths = source.where("doc_id is not null").mapInArrow(_paths(k, part), "doc_id long, version long, pos int, n int, part long, s1 long, s2 long")
    paths = cut(paths, "paths")
    parts = paths.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("s1").alias("c"), F.max("s1").alias("d"))
    parts = cut(parts.where("a != b").select("part", (F.col("c") != F.col("d")).alias("branching")), "parts")
    seen = cut(paths.join(parts, "part"), "seen")
    drop(paths, parts)
    own = seen.groupBy("part", "s1", "s2", "n").agg(F.min(F.struct("doc_id", "version", "pos")).alias("at"), F.max("doc_id").alias("last")).where("at.doc_id != last")
    own = cut(own.select("part", "s1", "s2", "n", F.col("at.doc_id").alias("source_id"), F.col("at.version").alias("source_version"), F.col("at.pos").alias("source_pos")), "sources")
    known = cut(seen.join(own, ["part", "s1", "s2", "n"], "left"), "known")
    whole = known.where("source_id < doc_id").select("doc_id", "version", F.col("pos").alias("start"), F.col("n").alias("windows"), "source_id", "source_version", F.col("source_pos").alias("source_start"))
    ask = known.where("branching and (source_id is null or source_id = doc_id)").groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "n", "part")).alias("x"))
    ask = cut(ask.select("doc_id", "version", F.col("x.pos").alias("pos"), F.col("x.n").alias("n"), F.col("x.part").alias("part")), "asked")
    opened = perhaps_among(source, "doc_id", ask, "doc_id").join(ask.hint("merge"), ["doc_id", "version"]).select("doc_id", "version", "text", "pos", "n", "part")
    opened = cut(opened.mapInArrow(_edges(k), "doc_id long, version long, pos int, part long, edges array<long>"), "opened")
    edges = opened.select("doc_id", "version", "pos", "part", F.posexplode("edges").alias("i", "edge"))
    first = edges.groupBy("part", "edge").agg(F.min(F.struct("doc_id", "version", (F.col("pos") + F.col("i")).alias("pos"))).alias("at"), F.max("doc_id").alias("last")).where("at.doc_id != last")
    first = cut(first.select("part", "edge", F.col("at.doc_id").alias("source_id"), F.col("at.version").alias("source_version"), F.col("at.pos").alias("source_start")), "edges")
    single = edges.join(first, ["part", "edge"]).where("source_id < doc_id").select("doc_id", "version", (F.col("pos") + F.col("i")).alias("start"), F.lit(1).alias("windows"), "source_id", "source_version", "source_start")
    pieces = cut(whole.unionByName(single), "pieces")
    drop(seen, own, known, ask, opened, first)
    line = Window.partitionBy("doc_id", "version", "source_id", "source_version", "diagonal").orderBy("start")
    runs = pieces.repartition("doc_id", "version").withColumn("diagonal", F.col("source_start") - F.col("start"))
    runs = runs.withColumn("end", F.col("start") + F.col("windows")).withColumn("reach", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("reach") < F.col("start")), 1).otherwise(0)).over(line))
    runs = runs.groupBy("doc_id", "version", "source_id", "source_version", "diagonal", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("source_start").alias("source_start"))
    spans = cut(runs.select("doc_id", "version", "start", (F.col("end") - F.col("start") + k - 1).cast("int").alias("length"), "source_id", "source_version", "source_start"), "spans")
    drop(pieces)
    return spans


def _with_words(spans: DataFrame, source: DataFrame) -> DataFrame:
    """``spans`` with the words at their source coordinates; a source is read once, whatever follows it."""
    key = ["source_id", "source_version"]
    want = spans.groupBy(*key, "source_start").agg((F.col("source_start") + F.max("length")).alias("end"))  # at most a row per word of a source
    line = Window.partitionBy(*key).orderBy("source_start")
    want = want.withColumn("reach", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    want = want.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("reach") < F.col("source_start")), 1).otherwise(0)).over(line))
    place = cut(want.withColumn("island", F.min("source_start").over(Window.partitionBy(*key, "run"))).select(*key, "source_start", "end", "island"), "islands")
    asked = place.groupBy(*key, "island").agg(F.max("end").alias("end")).groupBy(*key).agg(F.collect_list(F.struct("island", "end")).alias("x"))
    asked = cut(asked.select(*key, F.col("x.island").alias("starts"), F.col("x.end").alias("ends")), "asked")
    texts = source.select(F.col("doc_id").alias("source_id"), F.col("version").alias("source_version"), "text")
    texts = perhaps_among(texts, "source_id", asked, "source_id").join(asked.hint("merge"), key).dropDuplicates(key).select(*key, "text", "starts", "ends")
    passages = cut(texts.mapInArrow(_passages, "source_id long, source_version long, island int, passage binary"), "passages")
    full = spans.join(place.drop("end"), [*key, "source_start"]).join(passages, [*key, "island"])
    full = full.select("doc_id", "version", "start", "length", "source_id", "source_start", (F.col("source_start") - F.col("island")).alias("skip"), "passage")
    out = cut(full.mapInArrow(_cut_spans, "doc_id long, version long, start int, length int, source_id long, source_start int, words binary"), "span_words")
    drop(spans, place, asked, passages)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, part: int = PART) -> DataFrame:
    """Maximal spans of words covered by k-word windows that a document with a smaller id has too.

    Columns ``doc_id, version, start, length`` in words and ``source_id, source_start``, the smallest
    source coordinate, at which the same words stand. ``version`` tells apart rows that share an id.
    Spans of one document may overlap when they follow different sources. Null ids neither give nor
    lose passages.
    """
    source = _source(docs, id_col, text_col)
    spans = _with_words(_proposed(source, k, part), source)
    texts = perhaps_among(source, "doc_id", spans, "doc_id").dropDuplicates(["doc_id", "version"])
    return texts.join(spans.hint("merge"), ["doc_id", "version"]).mapInArrow(_verified(k), "doc_id long, version long, start int, length int, source_id long, source_start int")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, part: int = PART) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    Each word covered by a k-word window that also starts in a document with a smaller id goes.
    Null or empty text has no words and the digest of the empty string. Rows repeated with one id do
    not count against each other. A null id is neither smaller nor larger than any other: its row is
    returned whole. Other columns are not read; an empty table gives an empty result.
    """
    source = _source(docs, id_col, text_col)
    spans = _with_words(_proposed(source, k, part), source)
    spans = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "words")).alias("x"))  # at most a document's words and their overlaps
    spans = cut(spans.select("doc_id", "version", F.col("x.start").alias("starts"), F.col("x.words").alias("words")), "losses")
    some, others = parted(source, "doc_id", spans, "doc_id")
    some = some.join(spans.hint("merge"), ["doc_id", "version"], "left").select("doc_id", "text", "starts", "words")
    others = others.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<binary>").alias("words"))
    return some.unionByName(others).mapInArrow(_rebuild(k), "doc_id long, n_words long, n_removed long, kept_sha256 string")
