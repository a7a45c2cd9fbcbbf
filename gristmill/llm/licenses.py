"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Terms are runs of ASCII letters, digits and non-ASCII bytes, lower-cased, so line ends and comment
marks do not matter. Windows of a text that have as many terms as a template, or a sixteenth (one at
least) more or fewer, are compared to it with the document frequencies of all their terms:

1. Frequencies of the template terms are counted over all documents. By Cauchy and Schwarz a window
   cannot come closer to a template than the length of the template's unit vector on the terms that
   both have; places that may reach THRESHOLD are the contexts of a text.
2. Terms of contexts are counted over all documents, however often they stand there; a sieve of fixed
   size keeps other terms from being shuffled.
3. Contexts are joined with these frequencies and their windows are scored.

A text has the licence of its best window if that reaches THRESHOLD, holds the template's rarest term
and leads the best window of every other licence by MARGIN. Equal texts are scored once. A file named
like a licence file gives its directory the licence of its text; other files without a notice of
their own take that of the nearest directory above them that has one. Directories are joined as
distinct paths with their ancestors, never file by file. A text that only names a licence, even to
deny it, counts as having it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, drop
from gristmill.llm.licence_texts import templates
from gristmill.llm.semi import SLOTS, bits_of
from gristmill.llm.words import U, Words, buffers, chunks

THRESHOLD, MARGIN, FLUSH = 0.8, 0.002, 1 << 20
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
_TERM = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TERM[_b] = _b
for _b in range(65, 91):
    _TERM[_b] = _b + 32


def _terms(offsets: np.ndarray, data: np.ndarray) -> Words:
    return Words(offsets, _TERM[data])


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    offsets, data = buffers(column)
    for lo, hi in chunks(offsets):
        yield lo, hi, _terms(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]])


class Vocabulary:
    """Sorted hashes of the template terms, and the term counts of each template."""

    def __init__(self) -> None:
        found = templates()
        self.names = [i for i, _ in found]
        texts = [t.encode() for _, t in found]
        words = _terms(np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.frombuffer(b"".join(texts), np.uint8))
        h = words.hashes()
        self.terms = np.unique(h)
        self.counts = np.zeros((len(self.terms), len(texts)))
        np.add.at(self.counts, (np.searchsorted(self.terms, h), np.repeat(np.arange(len(texts)), words.counts)), 1)
        self.lengths = words.counts.tolist()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash among the template terms, and whether it is one."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return at, self.terms[at] == h

    def sizes(self, t: int) -> list[int]:
        n = self.lengths[t]
        slack = max(1, n // 16)
        return [max(1, n - slack), n, n + slack]


def idf(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequency)) + 1


class Weights:
    """Unit vectors of the templates."""

    def __init__(self, vocabulary: Vocabulary, frequency: np.ndarray, documents: int):
        self.vocabulary, self.documents = vocabulary, documents
        self.idf = idf(documents, frequency)
        unit = vocabulary.counts * self.idf[:, None]
        self.unit = unit / np.sqrt((unit**2).sum(axis=0))
        self.rarest = np.where(vocabulary.counts > 0, self.idf[:, None], 0).argmax(axis=0)


def _template_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = Vocabulary()
    n, total = len(v.terms), np.zeros(len(v.terms) + 1, np.int64)
    for batch in batches:
        total[-1] += batch.num_rows
        for _, _, words in _chunks(batch.column(0)):
            at, known = v.find(words.hashes())
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            total[:-1] += np.bincount(np.unique(doc[known] * n + at[known]) % n, minlength=n)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])


def _contexts(weights: Weights):
    """(k1, k2, text) to the places where a window may reach the threshold: their positions and terms."""
    least, square = THRESHOLD**2 - 1e-9, weights.unit**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = weights.vocabulary
        for batch in batches:
            for lo, _, words in _chunks(batch.column(2)):
                h = words.hashes()
                at, known = v.find(h)
                n = len(words.counts)
                present = np.zeros((n, len(v.terms)), np.float32)
                present[np.repeat(np.arange(n), words.counts)[known], at[known]] = 1
                may = present @ square.astype(np.float32) >= least - 1e-4
                rows, places, terms = [], [], []
                for i in np.flatnonzero(may.any(axis=1)):
                    s, e = words.first[i], words.first[i + 1]
                    edge = np.zeros(e - s + 1, np.int64)
                    for t in np.flatnonzero(may[i]):
                        size = min(v.sizes(t)[-1], e - s)
                        mass = np.concatenate(([0], np.cumsum(np.where(known[s:e], square[at[s:e], t], 0))))
                        ends = np.minimum(np.arange(e - s) + size, e - s)
                        begin = np.flatnonzero(mass[ends] - mass[:-1] >= least)
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, ends[begin], -1)
                    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    if len(inside):
                        rows.append(lo + int(i))
                        places.append(inside.astype(np.int32))
                        terms.append(h[s:e][inside].view(np.int64))
                if rows:
                    first = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32))
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.ListArray.from_arrays(first, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(first, pa.array(np.concatenate(terms)))], ["k1", "k2", "pos", "term"])

    return run


def _frequencies(sieve):
    """Documents that hold each term that passes the sieve, summed over stretches of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sieve.value
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            terms, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(times.astype(np.int64))], ["term", "n"])

        for batch in batches:
            for _, _, words in _chunks(batch.column(0)):
                codes, lanes = words.lanes()
                h = lanes[:, 0]
                slot = h & U(SLOTS - 1)
                wanted = (cells[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1
                here = np.flatnonzero(wanted[codes])
                doc = np.searchsorted(words.first, here, "right") - 1
                pairs = np.unique(doc * len(h) + codes[here])
                held.append(h[pairs % max(1, len(h))])
                n += len(pairs)
                if n > FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _scores(weights: Weights):
    """(k1, k2, pos, term, n) lists to the best window's licence and cosine."""
    v = weights.vocabulary
    ids = sorted(set(v.names))
    licence = np.array([ids.index(x) for x in v.names])

    def score(pos: np.ndarray, h: np.ndarray, n: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        best = np.zeros((n_docs, len(ids)))
        at, known = v.find(h)
        weight = idf(weights.documents, n)
        square = np.concatenate(([0], np.cumsum(weight**2)))
        for t in range(len(v.names)):
            product = np.where(known, weight * weights.unit[at, t], 0)
            dot = np.concatenate(([0], np.cumsum(product)))
            rare = np.concatenate(([0], np.cumsum(known & (at == weights.rarest[t]))))
            for size in sorted(set(v.sizes(t))):
                if size > len(h):
                    continue
                # A repeated term only makes the norm larger, so this cosine is an upper bound.
                bound = (THRESHOLD - 1e-6) * np.sqrt(square[size:] - square[:-size])
                fine = (dot[size:] - dot[:-size] >= bound) & (rare[size:] > rare[:-size])
                last = np.arange(size - 1, len(h))
                fine &= (doc[last] == doc[: len(last)]) & (pos[last] - pos[: len(last)] == size - 1)
                starts = np.flatnonzero(fine)
                step = max(1, (1 << 22) // size**2)
                for lo in range(0, len(starts), step):
                    begin = starts[lo : lo + step]
                    span = begin[:, None] + np.arange(size)
                    times = (h[span][:, :, None] == h[span][:, None, :]).sum(axis=2)
                    cosine = product[span].sum(axis=1) / np.sqrt((weight[span] ** 2 * times).sum(axis=1))
                    np.maximum.at(best, (doc[begin], np.full(len(begin), licence[t])), cosine)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(2).offsets.to_numpy()
            pos, term, n = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))
            first = first - first[0]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            best = score(pos, term.view(np.uint64), n, doc, batch.num_rows)
            order = np.argsort(-best, axis=1, kind="stable")
            rows = np.arange(batch.num_rows)
            top, second = best[rows, order[:, 0]], best[rows, order[:, 1]]
            sure = (top >= THRESHOLD - 1e-12) & (top - second >= MARGIN)
            names = [ids[i] if ok else None for i, ok in zip(order[:, 0], sure, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(top >= THRESHOLD - 1e-12, np.round(top, 6), 0.0))], ["k1", "k2", "license", "score"])

    return run


#: A term with more than this share of all words in contexts is joined by broadcast; there are fewer than 1 / SHARE such terms.
SHARE = 1e-3


def _with_counts(words: DataFrame, often: DataFrame) -> DataFrame:
    """``words`` with ``n``, the frequency of their term. No task meets all words of a frequent one: those few terms are broadcast."""
    uses = cut(words.groupBy("term").agg(F.count("*").alias("uses")).join(often, "term"), "terms")
    limit = SHARE * (uses.agg(F.sum("uses")).first()[0] or 0)
    frequent = F.broadcast(uses.where(F.col("uses") > limit).select("term", F.col("n").alias("known")))
    marked = words.join(frequent, "term", "left")
    rest = marked.where("known is null").drop("known").join(uses.where(F.col("uses") <= limit).select("term", "n"), "term")
    return marked.where("known is not null").withColumnRenamed("known", "n").unionByName(rest)


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """``doc_id, path, license, score``: the licence of each file's text; score 0 where no window reaches the threshold.

    A score with a null licence: windows of several licences are equally near.
    """
    spark = files.sparkSession
    text = F.col(text_col).cast("string")
    source = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))
    counted = source.select("text").mapInArrow(_template_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # template terms and one more
    v = Vocabulary()
    total = np.zeros(len(v.terms) + 1, np.int64)
    total[counted["term"].to_numpy()] = counted["n"].to_numpy()
    weights = Weights(v, total[:-1], int(total[-1]))
    found = source.select("k1", "k2", "text").mapInArrow(_contexts(weights), "k1 long, k2 long, pos array<int>, term array<long>")
    found = cut(found.groupBy("k1", "k2").agg(F.first(F.struct("pos", "term")).alias("x")).select("k1", "k2", "x.*"), "contexts")  # equal texts once
    words = found.select("k1", "k2", F.explode(F.arrays_zip("pos", "term")).alias("x")).select("k1", "k2", "x.pos", "x.term")
    cells = np.zeros(SLOTS // 64, np.uint64)  # 8 MB, whatever the input
    asked = bits_of(words.select("term"), F.pmod("term", F.lit(SLOTS))).toArrow()
    cells[asked["__gm_cell"].to_numpy()] = asked["__gm_bits"].to_numpy().view(np.uint64)
    sieve = spark.sparkContext.broadcast(cells)
    often = source.select("text").mapInArrow(_frequencies(sieve), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    full = _with_counts(words, often).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "n"))).alias("x"))  # at most a text's terms
    scored = cut(full.select("k1", "k2", F.col("x.pos").alias("pos"), F.col("x.term").alias("term"), F.col("x.n").alias("n")).mapInArrow(_scores(weights), "k1 long, k2 long, license string, score double"), "scores")
    drop(found)
    out = source.drop("text").join(scored, ["k1", "k2"], "left")
    return out.select("doc_id", "path", "license", F.coalesce("score", F.lit(0.0)).alias("score"))


def license_of_files(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row per input row: ``doc_id, path, license, score, effective_license, inherited_from``.

    Null or empty text has no licence and score 0; a null path inherits nothing. Of several licence
    files with a licence in one directory the first path, then the smallest id, counts. Rows repeated
    with one id or path are judged each. Other columns are not read; an empty table gives an empty
    result.
    """
    found = cut(scan(files, id_col, text_col, path_col), "scan")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    found = found.withColumn("folder", folder)
    named = F.element_at(F.split("path", "/", -1), -1).rlike(LICENCE_NAME)
    given = found.where(named & F.col("license").isNotNull()).groupBy("folder").agg(F.min(F.struct("path", "doc_id", "license")).alias("x")).select("folder", F.col("x.license").alias("given"), F.col("x.path").alias("from"))
    given = cut(given, "given")
    folders = found.where("path is not null").select("folder").distinct()
    parts = F.split("folder", "/", -1)
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"))), F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("folder"))))
    chain = folders.select(F.col("folder").alias("of"), F.explode(above).alias("a")).select("of", "a.depth", "a.folder")
    nearest = chain.join(given, "folder").groupBy("of").agg(F.max_by(F.struct("given", "from"), "depth").alias("x")).select(F.col("of").alias("folder"), "x.*")
    out = found.join(cut(nearest, "nearest"), "folder", "left")
    own = F.col("license").isNotNull()
    return out.select("doc_id", "path", "license", "score", F.coalesce("license", "given").alias("effective_license"), F.when(~own, F.col("from")).alias("inherited_from"))
