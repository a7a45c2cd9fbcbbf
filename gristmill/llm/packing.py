"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's tokens are cut into pieces whose lengths are (nearly) reciprocals of the capacity C: a
length l is a class if C mod l is at most SLACK, and floor(C / l) pieces of it fill a bin. Whole
capacities come first; a rest that is no class gives up the largest reciprocal floor(C / j) it holds
and goes on with what remains. All pieces of a class have one length, so a bin is full after a fixed
count, the place of a piece follows from its rank in its class alone, and workers fill bins without
each other: a rank is the worker's own count plus the counts of the workers before it. The bins left
open at the end hold fewer than C * (1 + 1/2 + ... + 1/C) pieces over all classes, however large
the input; they are packed by first-fit decreasing.

Only piece coordinates and checksums move; texts and ids stay in the task that read them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut
from gristmill.llm.words import SPACE, buffers, chunks, values_of

CAPACITY, SLACK, TEXT_BYTES = 1024, 12, 1 << 20
@lru_cache(maxsize=4096)
def cut_lengths(rest: int, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[int, ...]:
    """How a rest shorter than the capacity is cut."""
    out = []
    while rest:
        piece = rest
        if capacity % rest > slack:
            piece = capacity // (capacity // rest + 1)
        out.append(piece)
        rest -= piece
    return tuple(out)


def _may_be_space(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character of Unicode white space, or look like it."""
    out = SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
    if len(data) > 1:
        before, last = data[:-1], data[1:]
        out[1:] |= (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        out[2:] |= ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    return out


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    Ids are those of ``tokenizers`` for the vocabulary at ``json_path``. Byte-level BPE never merges
    over a space that follows a solid character, so a chunk of texts is cut before such spaces, its
    pieces are dictionary encoded and each different piece is encoded once. Pieces go through the
    same vocabulary as ranks, joined to one text and told apart again by their lengths in bytes; that
    the ids are those of ``tokenizers`` is what the tests compare, text by text. Texts that spell a
    special token go to ``tokenizers`` whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]

    def _whole(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _alone(self, piece: bytes) -> np.ndarray:
        try:
            return np.array(self.fast.encode_ordinary(piece.decode()), "<u4")
        except Exception:  # noqa: BLE001  its pattern engine gives up on some very long runs
            return np.frombuffer(self._whole(piece.decode()), "<u4")

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, how many each has and where they begin."""
        offsets, data = buffers(pieces)
        head, tail = data[offsets[:-1]], _may_be_space(data)[offsets[1:] - 1]
        joined = (head == 32) & ~tail  # pieces that meet like this are cut apart by the pattern too
        parts: list[np.ndarray] = [np.zeros(0, "<u4")]
        size = np.zeros(len(pieces), np.int64)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        raw = pieces.take(pa.array(order[: joined.sum()]))
        try:
            ids = self.fast.encode_to_numpy(b"".join(values_of(raw)).decode(), disallowed_special=())
            ends = np.concatenate(([0], np.cumsum(self.bytes_of[ids])))
            edges = np.concatenate(([0], np.cumsum(np.diff(offsets)[joined])))
            size[joined] = np.diff(np.searchsorted(ends, edges))
            parts.append(ids)
            alone = order[joined.sum() :]
        except Exception:  # noqa: BLE001  as above
            alone = order
        for i in alone:
            parts.append(self._alone(pieces[int(i)].as_py()))
            size[i] = len(parts[-1])
        ordered = size[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(ordered) - ordered
        return np.concatenate(parts).astype("<u4"), size, place

    def encode(self, offsets: np.ndarray, data: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, ``end`` after each, and where each text's begin."""
        n, at = len(offsets) - 1, offsets - offsets[0]
        cuts = np.zeros(len(data) + 1, bool)
        if len(data):
            cuts[1:-1] = (data[1:] == 32) & ~_may_be_space(data)[:-1]
        cuts[at] = True
        edges = np.flatnonzero(cuts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        flat, size, place = self._pieces(pieces.dictionary)
        flat, place, size = np.append(flat, np.uint32(end)), np.append(place, len(flat)), np.append(size, 1)
        # An end id closes each text: it is the piece after the text's last.
        last = np.searchsorted(edges[:-1], at[1:])
        codes = np.insert(pieces.indices.to_numpy().astype(np.int64), last, len(size) - 1)
        long = size[codes]
        total = np.concatenate(([0], np.cumsum(long)))
        out = flat[np.arange(total[-1]) + np.repeat(place[codes] - total[:-1], long)]
        closing = last + np.arange(n)
        first = np.concatenate(([0], total[closing + 1]))
        raw = data.tobytes() if self.special else b""
        if any(s in raw for s in self.special):
            texts = [raw[at[i] : at[i + 1]] for i in range(n)]
            parts = [out[first[i] : first[i + 1]] for i in range(n)]
            for i, text in enumerate(texts):
                if any(s in text for s in self.special):
                    parts[i] = np.frombuffer(self._whole(text.decode()) + np.array([end], "<u4").tobytes(), "<u4")
            out, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out, first


_encoders: dict[tuple, Encoder] = {}


def _pieces(json_path: str, ranks_path: str, pattern: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (json_path, ranks_path, pattern)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for lo, hi in chunks(offsets, TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, first = _encoders[key].encode(offsets[lo : hi + 1], data[offsets[lo] : offsets[hi]], end_id)
                raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                row, start, length, crc, total = [], [], [], [], []
                for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    n, at = e - s, 0
                    lengths = (capacity,) * (n // capacity) + cut_lengths(n % capacity, capacity)
                    for size in lengths:
                        start.append(at)
                        crc.append(zlib.crc32(raw[4 * (s + at) : 4 * (s + at + size)]))
                        at += size
                    row += [i] * len(lengths)
                    length += lengths
                    total += [n] * len(lengths)
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                ordered = lengths[order]
                begin = np.searchsorted(ordered, ordered)
                rank = np.empty(len(lengths), np.int64)
                rank[order] = np.arange(len(lengths)) - begin + seen[ordered]
                seen += np.bincount(lengths, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "own_rank"],
                )

    return run


def _first_fit(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        length, rank = table["length"].to_pylist(), table["rank"].to_pylist()
        order = sorted(range(len(length)), key=lambda i: (-length[i], rank[i]))
        room: list[int] = []
        bins, offsets = [0] * len(length), [0] * len(length)
        for i in order:
            b = next((b for b, r in enumerate(room) if r >= length[i]), len(room))
            if b == len(room):
                room.append(capacity)
            bins[i], offsets[i] = b, capacity - room[b]
            room[b] -= length[i]
        return pa.table({"doc_id": table["doc_id"], "start": table["start"], "length": table["length"], "ids_crc32": table["ids_crc32"], "doc_tokens": table["doc_tokens"], "sequence_id": pa.array([table["base"][0].as_py() + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64())})

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are the end id alone. Rows repeated with one id are packed each on its own;
    a null id stays null. Texts of any length are encoded whole. Other columns are not read. An empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = source.mapInArrow(_pieces(json_path, ranks_path, pattern, end_id, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, own_rank long")
    made = cut(made, "pieces")
    counts = cut(made.groupBy("length", "worker").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("length", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.floor(F.col("n") / per_bin).alias("bins"))
    earlier = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per length
    classes = classes.select("length", "bins", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("base"), F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("all_bins"))
    ranked = made.join(cut(places.join(classes, "length"), "places"), ["length", "worker"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("own_rank")).withColumn("per_bin", per_bin)
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("rank < bins * per_bin").select(*kept, (F.col("base") + F.floor(F.col("rank") / F.col("per_bin"))).alias("sequence_id"), (F.pmod("rank", "per_bin") * F.col("length")).alias("offset"))
    rest = ranked.where("rank >= bins * per_bin").select(*kept, "rank", F.col("all_bins").alias("base"), F.lit(0).alias("all"))
    rest = rest.groupBy("all").applyInArrow(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(rest)
