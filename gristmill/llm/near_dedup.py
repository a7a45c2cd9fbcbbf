"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

1. Each document's set of word shingles gives a fast similarity sketch: in round i every element is
   thrown into one of t bins with value (i, random); in rounds t..2t-1 all elements go to bin i-t. A
   bin keeps its smallest value and rounds stop once all bins are full, so each coordinate is filled
   for any nonempty set, and the share of equal coordinates concentrates around the similarity at
   least as well as for t independent minima.
2. Documents with one sequence of words collapse to one representative (SHA-256 of the sequence).
3. Bands of sketch rows give bucket keys. Buckets with one representative go. With 24 bands of 4
   rows a pair at similarity 0.85 shares no bucket with probability 2e-8, one at 0.8 with 4e-6.
4. Each member of a bucket is verified against the bucket's smallest member, and verified links are
   contracted into components. Every verification compares real shingles: words are numbered by a
   dictionary and shingles by their words' numbers, so no hash decides about a link.
5. Buckets that still hold several components have their members sieved by the prefix rule: with
   shingles ordered from rare to frequent, two linked sets share one of the first n - ceil(t n) + 1.
   A document without a shared shingle there has no link left to find and goes. Buckets are cut by
   size class (sizes of linked sets differ by the threshold at most). A bucket of one block is
   compared whole. Members of a larger one meet by each rare shingle of their prefix instead, in
   groups of the size of its frequency; only shingles that more than HOT members hold leave their
   holders in the bucket, dealt in blocks, and every pair of blocks is a task. A task counts shared
   shingles of all its members and returns a spanning forest of the links. No pair is skipped, and
   none becomes a row unless it is a link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, drop
from gristmill.llm.semi import keyed, perhaps_among, row_key, without
from gristmill.llm.words import PHI, U, Words, buffers, chunks, distinct_sorted, mix, shingle_codes, shingles, values_of
from gristmill.operators.components import connected_components

BANDS, ROWS, BLOCK_MEMBERS, BLOCK_BYTES, HOT, PAIRS = 24, 4, 192, 4 << 20, 384, 256
_NONE = U(0xFFFFFFFFFFFFFFFF)


def fast_sketch(flat: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, t columns, of the sets flat[first[i]:first[i+1]]; empty sets stay unfilled."""
    n = len(first) - 1
    sketch = np.full(n * t, _NONE)
    sizes = np.diff(first)
    open_ = sizes > 0
    h, base = flat, np.repeat(np.arange(n, dtype=np.int64) * t, sizes)
    for i in range(2 * t):
        if not len(h):
            break
        x = mix(h + U(int(PHI) * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        at = base + (((x >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else base + (i - t)
        np.minimum.at(sketch, at, (x & U(0xFFFFFFFF)) | U(i << 32))
        left = open_ & (sketch.reshape(n, t) == _NONE).any(axis=1)
        if i < 2 and not left.all() or i % 8 == 0 or not left.any():
            keep = left[base // t]
            h, base = h[keep], base[keep]
        # A full document that stays for some rounds only offers larger values: nothing changes.
    return sketch.reshape(n, t)


def _documents(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of about a chunk, and their words."""
    offsets, data = buffers(column)
    for lo, hi in chunks(offsets):
        yield lo, hi, Words(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]], lower)


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _documents(batch.column(1), True):
                flat, first = distinct_sorted(*shingles(words, k))
                whole = [hashlib.sha256(x).digest() for x in values_of(words.canonical())]
                sketch = fast_sketch(flat, first, bands * rows).reshape(hi - lo, bands, rows)
                keys = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * PHI + sketch[:, :, r])
                keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(whole, pa.binary()), lists], ["doc_id", "__gm_row", "n_shingles", "whole", "bands"])

    return run


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in _documents(batch.column(1), True):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), words.canonical().cast(pa.binary())], ["id", "words"])


def _items(k: int):
    """Distinct shingle hashes of canonical texts, for the prefix rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _documents(batch.column(1)):
                flat, first = distinct_sorted(*shingles(words, k))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["id", "items"])

    return run


def _confirm(k: int, percent: int):
    """Pairs (a, b, words of a, words of b) whose real shingle sets are similar enough."""

    def linked(x: pa.Array, y: pa.Array) -> np.ndarray:
        n = len(x)
        both = pa.concat_arrays([x, y]).take(pa.array(np.arange(2 * n).reshape(2, n).T.reshape(-1)))  # x0 y0 x1 y1 ...
        out = np.zeros(n, bool)
        offsets, data = buffers(both)
        for lo, hi in chunks(offsets[::2]):
            part = offsets[2 * lo : 2 * hi + 1]
            codes, first = shingle_codes(Words(part, data[part[0] : part[-1]]), k)
            codes = np.unique(codes, return_inverse=True)[1]
            doc = np.repeat(np.arange(2 * (hi - lo)), np.diff(first))
            own = np.unique(doc << 32 | codes)
            sizes = np.bincount(own >> 32, minlength=2 * (hi - lo))
            pair = np.sort((own >> 33) << 32 | (own & 0xFFFFFFFF))
            shared = np.bincount(pair[1:][pair[1:] == pair[:-1]] >> 32, minlength=hi - lo)
            out[lo:hi] = 100 * shared >= percent * (sizes[::2] + sizes[1::2] - shared)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):  # texts of some pairs are copied at a time
                part = batch.slice(lo, PAIRS)
                keep = linked(part.column(2).cast(pa.large_binary()), part.column(3).cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _forest(k: int, percent: int):
    """Links between members of two blocks of a group that lie in different components, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        block, high = table["block"].to_numpy(), table["high"].to_numpy(zero_copy_only=False)
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        codes, first = shingle_codes(Words(*buffers(table["words"])), k)
        codes = np.unique(codes, return_inverse=True)[1]
        own = np.unique(codes.astype(np.int64) << 32 | np.repeat(np.arange(len(ids)), np.diff(first)))
        member, column = own & 0xFFFFFFFF, own >> 32
        sizes = np.bincount(member, minlength=len(ids))
        up = {x: x for x in labels.tolist()}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        often = np.bincount(column, minlength=1) > 1  # an item of one member is shared by nobody
        keep = often[column]
        member, column = member[keep], (np.cumsum(often) - 1)[column[keep]]
        shared = np.zeros((len(ids), len(ids)), np.float32)
        width = max(256, (8 << 20) // max(1, 4 * len(ids)))
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, (lo, lo + width))
            dense = np.zeros((len(ids), width), np.float32)
            dense[member[s:e], column[s:e] - lo] = 1
            shared += dense @ dense.T
        inter = shared.astype(np.int64)
        linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
        linked &= (labels[:, None] != labels[None, :]) & (high[:, None] | high[None, :])
        if bi != bj:
            linked &= block[:, None] != block[None, :]
        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = top(labels[i].item()), top(labels[j].item())
            if x != y:
                up[max(x, y)] = min(x, y)
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _groups(member: DataFrame, keys: list[str], block_members: int) -> DataFrame:
    """Groups of ``member(keys, id, n, label, high)`` that may hide a link, and their number of blocks.

    Groups of the same members count once.
    """
    stats = member.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("high").alias("some"), F.count("*").alias("members"), F.sum("n").alias("size"), F.sum(F.xxhash64("id", "high").cast("decimal(38,0)")).alias("who"))
    stats = stats.where("lo != hi and some").groupBy("at", "members", "size", "who").agg(F.min(F.struct(*keys)).alias("k"))
    blocks = F.greatest(F.ceil(F.col("members") / block_members), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    return stats.select("k.*", blocks.alias("blocks"))


def _rest(cand: DataFrame, first: DataFrame, sets: DataFrame, k: int, percent: int, block_members: int, hot: int) -> DataFrame:
    """Links between members of one bucket that lie in different components of ``first``."""
    named = cand.select("key", "id", "n").join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("label"))
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    places = F.array(F.struct(own.alias("at"), F.lit(True).alias("high")), F.struct((own + 1).alias("at"), F.lit(False).alias("high")))
    split = named.select("key", "id", "n", "label", F.explode(places).alias("p")).select("key", "id", "n", "label", "p.at", "p.high")
    split = cut(split, "classes")
    mixed = cut(_groups(split, ["key", "at"], block_members), "mixed")
    split2 = cut(split.join(mixed.select("key", "at"), ["key", "at"], "left_semi"), "mixed_members")

    # The prefix rule over all members of mixed groups.
    some = cut(split2.groupBy("id").agg(F.min("n").alias("n")), "some")
    items = sets.join(some.select("id"), "id", "left_semi").mapInArrow(_items(k), "id long, items array<long>").select("id", F.explode("items").alias("item"))
    items = cut(items, "items")
    often = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    shared = items.join(often, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))  # at most a document's shingles
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")  # a linked set shares at least so many
    prefix = shared.join(some, "id").withColumn("q", F.size("items") - least + 1).where("q > 0").select("id", F.slice("items", F.lit(1), F.col("q")).alias("prefix"))
    prefix = cut(prefix, "prefix")
    member = cut(split2.join(prefix.select("id"), "id", "left_semi"), "sieved")
    groups = cut(_groups(member, ["key", "at"], block_members), "groups")
    small = member.join(groups.where("blocks = 1"), ["key", "at"]).select("key", "at", F.lit(0).cast("long").alias("item"), "id", "label", "high", "n")

    # Members of large groups: by rare shingles of the prefix, and by bucket where a shingle is hot.
    large = cut(member.join(groups.where("blocks > 1").select("key", "at"), ["key", "at"]), "large")
    heads = large.select("id", "at", "label", "high", "n").distinct().join(prefix, "id")
    rare = heads.select("at", "id", "label", "high", "n", F.explode(F.filter("prefix", lambda x: x["df"] <= hot)).alias("x")).select(F.lit(0).cast("long").alias("key"), "at", F.col("x.item").alias("item"), "id", "label", "high", "n")
    holder = prefix.where(F.exists("prefix", lambda x: x["df"] > hot)).select("id")
    often = large.join(holder, "id", "left_semi").select("key", "at", F.lit(0).cast("long").alias("item"), "id", "label", "high", "n")
    meet = cut(rare.unionByName(often), "meetings")
    met = _groups(meet, ["key", "at", "item"], block_members)
    todo = small.withColumn("blocks", F.lit(1)).unionByName(meet.join(cut(met, "met"), ["key", "at", "item"]).select("key", "at", "item", "id", "label", "high", "n", "blocks"))
    dealt = todo.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "at", "item", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "label", "high", "block")
    more = dealt.join(sets, "id").groupBy("key", "at", "item", "bi", "bj").applyInArrow(_forest(k, percent), "a long, b long")
    more = cut(more, "links2")
    drop(split, mixed, split2, some, items, prefix, member, groups, large, meet)
    return more


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block_members: int = BLOCK_MEMBERS, hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A n B| >= percent * |A u B|`` for their sets of lower-cased
    (A-Z) k-word shingles. ``component_id`` is the smallest id reachable over links.

    Null or blank text: no shingles, linked with nothing, kept. Rows repeated with one id and text:
    each is returned, with the same component. A null id: never a component's id; its row gets the
    component of the rows with the same words, or null, and is kept only when that is null. Rows that
    share an id but not a text are one node with the links of each. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    return _components(docs, id_col, text_col, k, percent, bands, rows, block_members, hot).drop("__gm_row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns; rows are told apart by id and text."""
    gone = _components(docs, id_col, text_col, **how).where(~F.col("kept")).select("__gm_row").distinct()
    return without(docs, row_key(id_col, F.col(text_col).cast("string")), cut(gone, "copies"))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block_members: int = BLOCK_MEMBERS, hot: int = HOT) -> DataFrame:
    text = F.col(text_col).cast("string")
    source = keyed(docs, id_col, text).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), "__gm_row")
    sig = cut(source.mapInArrow(_signatures(k, bands, rows), "doc_id long, __gm_row long, n_shingles long, whole binary, bands array<long>"), "signatures")
    reps = sig.where("n_shingles > 0 and doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = cut(reps, "representatives")
    member = reps.select(F.explode("bands").alias("key"), "id", "n")
    shared = member.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.min_by("n", "id").alias("hub_n")).where("hub != last").drop("last")
    shared = cut(shared, "buckets")
    cand = cut(member.join(shared, "key"), "members")
    close = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    pairs = cand.where((F.col("id") != F.col("hub")) & close).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = cut(pairs, "pairs")
    needed = cut(cand.select(F.col("id").alias("doc_id")).distinct(), "needed")
    texts = perhaps_among(source.drop("__gm_row"), "doc_id", needed, "doc_id").join(needed.hint("merge"), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_canonical, "id long, words binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_confirm(k, percent), "a long, b long"), "links")
    first = connected_components(links)
    more = _rest(cand, first, sets, k, percent, block_members, hot)
    drop(pairs, cand, shared, needed, sets)
    final = first if more.isEmpty() else connected_components(more.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = reps.select("whole", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("whole", F.coalesce("root", "id").alias("component"))
    out = sig.select("doc_id", "__gm_row", "n_shingles", "whole").join(cut(named, "named"), "whole", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "__gm_row", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
