"""Approximate nearest neighbours by largest inner product, in a forest of hash prefixes.

Each tree gives a vector a string of BITS sign bits of random projections, kept as a number, so sorting
numbers sorts strings and vectors that share a prefix stand together. Vectors are scaled to the longest
one and get the coordinate that completes them to a unit vector, which makes the largest inner product
the smallest angle; for a query that coordinate is 0.

A query descends every tree to the prefixes it shares with the index and then ascends in all trees at
once, a bit at a time, until the vectors below its prefixes, counted over trees, number ``want``. Numbers
below prefixes are counted in steps of STEP bits, deeper only where a prefix holds so many vectors that
a query could stay there. ``want`` is set by a bounded sample of queries, whose true neighbours are found
by comparing them with every vector in the same pass that counts their prefixes: it is the smallest
number at which the sample finds TARGET of its neighbours. No index or list of candidates is whole
in the driver or in a task.

Queries and vectors then meet by tree and prefix, in blocks of at most about BLOCK vectors and BLOCK
queries, so a crowded prefix is many tasks. Each block keeps, for each query, the KEEP best by exact inner
product; the best of all blocks are the answer. Equal vectors are one entry of the index, with the
smallest ids of its rows: further ones cannot be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut
from gristmill.llm.vector_codes import matrix, sound

TREES, BITS, STEP, BLOCK, SAMPLE, TARGET, SEED, ROWS = 20, 56, 8, 4096, 256, 0.95, 13, 1024
_SEEN = 32  # bits of a prefix told apart in the sample


def _planes(width: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, trees * bits)).astype(np.float32)


def hash_strings(vectors: np.ndarray, planes: np.ndarray, trees: int, longest: float | None) -> np.ndarray:
    """A row of ``trees`` strings of bits, as numbers, for each vector; ``longest`` is None for queries."""
    if longest is None:
        size = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        unit = np.hstack((vectors / np.maximum(size, 1e-300), np.zeros((len(vectors), 1))))
    else:
        unit = vectors / longest
        unit = np.hstack((unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))))
    bits = ((unit.astype(np.float32) @ planes) > 0).reshape(len(vectors), trees, -1)
    out = np.zeros(bits.shape[:2], np.int64)
    for i in range(bits.shape[2]):
        out = out << 1 | bits[:, :, i]
    return out


def _hashed(trees: int, bits: int, longest: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part.column(1))
                planes = _planes(x.shape[1], trees, bits) if planes is None else planes
                keys = hash_strings(x, planes, trees, longest).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * trees, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    return run


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components whatever the number of rows."""
    out = np.zeros(len(a))
    for column in np.ascontiguousarray((a * b).T):
        out += column
    return out


def _best(queries: np.ndarray, items: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its n items of the largest inner product, smaller ids first on ties: query, item, score."""
    rough = queries @ items.T
    if rough.shape[1] > n:
        slack = 1e-12 * np.sqrt((queries**2).sum(axis=1) * (items**2).sum(axis=1).max())
        limit = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - slack
        q, i = np.nonzero(rough >= limit[:, None])
    else:
        q, i = (x.reshape(-1) for x in np.indices(rough.shape))
    score = inner(queries[q], items[i])
    order = np.lexsort((ids[i], -score, q))
    q, i, score = q[order], i[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < n
    return q[keep], i[keep], score[keep]


def _measured(uids: np.ndarray, queries: np.ndarray, keys: np.ndarray, bits: int, n: int):
    """Per task and sample query: how many vectors share each number of bits, over trees (``of`` null), and its
    best n others with the bits they share in some tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros((len(uids), _SEEN + 1), np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, score, bits
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                uid, x = part.column(0).to_numpy(), matrix(part.column(1))
                own = part.column(3).flatten().to_numpy().reshape(len(uid), -1) >> (bits - _SEEN)
                most = np.zeros((len(uids), len(uid)), np.int64)
                for t in range(own.shape[1]):
                    same = _SEEN - np.frexp((keys[:, t, None] ^ own[None, :, t]).astype(np.float64))[1]
                    shared += np.stack([np.bincount(s, minlength=_SEEN + 1) for s in same])
                    np.maximum(most, same, out=most)
                q, i, score = _best(queries, x, uid, n + 1)
                other = uid[i] != uids[q]
                q, score, depth = (np.concatenate((a, b)) for a, b in zip(best, (q[other], score[other], most[q, i][other]), strict=True))
                order = np.lexsort((-score, q))
                keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < n]
                best = [q[keep], score[keep], depth[keep]]
        q, depth = np.indices(shared.shape)
        none = pa.nulls(q.size, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(q.reshape(-1)), none, pa.array(depth.reshape(-1)), pa.array(shared.reshape(-1))], ["query", "score", "bits", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array(np.ones(len(best[0]), np.int64))], ["query", "score", "bits", "n"])

    return run


def enough(units: DataFrame, asks: DataFrame, trees: int, bits: int, n: int, sample: int, target: float) -> int | None:
    """How many vectors below a query's prefixes, over trees, make the sample find ``target`` of its true n
    neighbours; None where only all vectors do."""
    few = asks.orderBy(F.xxhash64("first"), "uid").limit(sample).select("uid", "v", "keys").collect()  # a bounded number of queries
    queries = np.array([r["v"] for r in few], np.float64)
    keys = np.array([r["keys"] for r in few], np.int64) >> (bits - _SEEN)
    got = units.mapInArrow(_measured(np.array([r["uid"] for r in few]), queries, keys, bits, n), "query long, score double, bits long, n long")
    got = cut(got, "sample")
    shared = np.zeros((len(few), _SEEN + 1), np.int64)
    for r in got.where("score is null").groupBy("query", "bits").agg(F.sum("n").alias("n")).collect():
        shared[r["query"], r["bits"]] = r["n"]
    below = np.cumsum(shared[:, ::-1], axis=1)[:, ::-1]  # vectors that share at least so many bits
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "bits"))
    true = got.where("score is not null").withColumn("place", place).where(F.col("place") <= n).select("query", "bits").collect()  # n of a sample query
    q, depth = np.array([r["query"] for r in true], np.int64), np.array([r["bits"] for r in true], np.int64)
    want = (n + 1) * trees  # so one tree has n + 1 different vectors
    while len(q) and want < below[:, 0].max():
        stop = (below[:, 1:] >= want).sum(axis=1)
        if (depth >= stop[q]).mean() >= target:
            return want
        want += max(1, want // 8)
    return None


def _cells(keys: DataFrame, bits: int, depth: Column) -> DataFrame:
    """``keys(uid, tree, key)`` with the prefix of ``depth`` bits."""
    return keys.withColumn("depth", depth).withColumn("prefix", F.expr(f"shiftright(key, {bits} - depth)"))


def counted(keys: DataFrame, want: int, trees: int, bits: int, step: int) -> DataFrame:
    """``tree, depth, prefix, n``: vectors below prefixes, deeper only below prefixes that hold want / trees."""
    left, parts, depth = keys, None, 0
    while depth < bits:
        top = depth + step
        ends = cut(_cells(left, bits, F.lit(top)).groupBy("tree", "depth", "prefix").agg(F.count("*").alias("n")), "prefixes")
        up = ends.withColumn("level", F.explode(F.sequence(F.lit(depth + 1), F.lit(top))))
        up = up.select("tree", F.col("level").alias("depth"), F.expr(f"shiftright(prefix, {top} - level)").alias("prefix"), "n").groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("n"))
        parts = up if parts is None else parts.unionByName(up)
        heavy = ends.where(F.col("n") * trees >= want).select("tree", F.col("prefix").alias("above"))
        depth = top
        if depth >= bits or heavy.isEmpty():
            break
        left = left.withColumn("above", F.shiftright("key", bits - depth)).join(heavy, ["tree", "above"], "left_semi").drop("above")
    return cut(parts, "counts")


def _search(n: int):
    """Rows sorted by group, vectors (side 0) before queries (side 1): the best n vectors of each query in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, items = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            side, uid, first = (batch.column(i).to_numpy() for i in (5, 6, 7))
            edge = np.flatnonzero((group[1:] != group[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1
            out = []
            for lo, hi in zip([0, *edge], [*edge, len(side)], strict=True):
                if held is None or (group[lo] != held).any():
                    held, parts, items = group[lo].copy(), [], None
                if side[lo] == 0:
                    parts.append((matrix(batch.column(8).slice(lo, hi - lo)), uid[lo:hi].copy(), first[lo:hi].copy()))
                    continue
                if not parts and items is None:
                    continue
                if parts:
                    items, parts = [np.concatenate(x) for x in zip(*parts, strict=True)], []
                for at in range(lo, hi, ROWS):
                    end = min(hi, at + ROWS)
                    q, i, score = _best(matrix(batch.column(8).slice(at, end - at)), items[0], items[2], n)
                    out.append((uid[at:end][q], items[1][i], items[2][i], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "uid", "first", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", n: int = 20, trees: int = TREES, bits: int = BITS, sample: int = SAMPLE, target: float = TARGET, block: int = BLOCK, want: int | None = None) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the n vectors of the largest inner product found for each query.

    ``is_query``: which rows, by the column ``vec_id``, are queries; candidates are all rows but those of the
    query's own id. Scores are inner products in double precision of the vectors as they are, summed in the
    order of components; the largest is first, ties go to the smaller id. Vectors that are null, zero or hold
    null or non-finite components and rows without an id take no part, as queries or as candidates.
    Rows that repeat id and vector count once. Shorter vectors count as filled up with zeros. Fewer than n
    candidates: all are returned. Other columns are not read; an empty table gives an empty result.
    ``want``: candidates to ascend to; measured on the sample where it is None.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & sound("v") & F.exists("v", lambda x: x != 0))
    kind = "array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>"
    rows = rows.withColumn("v", F.col("v").cast(kind))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seen = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(size).alias("longest")).first()
    if seen["least"] != seen["most"]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind[6:-1]), F.lit(seen["most"]) - F.size("v"))))
    longest = float(seen["longest"] or 1.0) ** 0.5
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    units = rows.withColumn("place", place).where(F.col("place") <= n + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    units = units.select(F.monotonically_increasing_id().alias("uid"), "v", "ids")
    units = cut(units.mapInArrow(_hashed(trees, bits, longest), f"uid long, v {kind}, ids array<long>, keys array<long>"), "units")

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(units.select("uid", "v"), "v").select("query_id", "uid").distinct()
    asked = cut(asked, "asked")
    asks = units.select("uid", "v", F.get("ids", F.lit(0)).alias("first")).join(asked.select("uid").distinct(), "uid", "left_semi")
    asks = cut(asks.mapInArrow(_hashed(trees, bits, None), f"uid long, v {kind}, first long, keys array<long>"), "asks")
    if asks.isEmpty():
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    want = enough(units, asks, trees, bits, n, sample, target) if want is None else want

    keys = units.select("uid", F.posexplode("keys").alias("tree", "key"))
    own = asks.select("uid", F.posexplode("keys").alias("tree", "key"))
    if want is None:  # only the root of a tree holds enough
        stop, counts = asks.select("uid", F.lit(0).alias("depth")), None
    else:
        counts = counted(keys, want, trees, bits, STEP)
        levels = [r[0] for r in counts.select("depth").distinct().collect()]  # at most ``bits``
        seen_at = _cells(own, bits, F.explode(F.array(*map(F.lit, sorted(levels))))).join(counts, ["tree", "depth", "prefix"])
        stop = seen_at.groupBy("uid", "depth").agg(F.sum("n").alias("n")).where(F.col("n") >= want).groupBy("uid").agg(F.max("depth").alias("depth"))
        stop = cut(asks.select("uid").join(stop, "uid", "left").select("uid", F.coalesce("depth", F.lit(0)).alias("depth")), "stops")
    cell = ["tree", "depth", "prefix"]
    goes = cut(_cells(own.join(stop, "uid"), bits, F.col("depth")).where("depth > 0 or tree = 0").select("uid", *cell), "goes")
    total = units.agg(F.count("*").alias("n")).select(F.lit(0).alias("tree"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "n")
    full = total if counts is None else counts.unionByName(total)
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    needed = goes.groupBy(*cell).agg(F.count("*").alias("m")).join(full, cell).select(*cell, blocks("n").alias("of_items"), blocks("m").alias("of_queries"))
    needed = cut(needed, "needed")
    used = [r[0] for r in needed.select("depth").distinct().collect()]
    member = _cells(keys, bits, F.explode(F.array(*map(F.lit, sorted(used))))).where("depth > 0 or tree = 0").join(needed, cell)
    mine, every = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = member.withColumn("ib", mine("of_items")).withColumn("qb", every("of_queries"))
    asking = goes.join(needed, cell).withColumn("qb", mine("of_queries")).withColumn("ib", every("of_items"))
    group = [*cell, "ib", "qb"]
    plain = lambda df, side, of: df.select("uid", *group).join(of, "uid").select(*(F.col(c).cast("long").alias(c) for c in group), F.lit(side).cast("long").alias("side"), "uid", "first", "v")
    both = plain(member, 0, units.select("uid", "v", F.get("ids", F.lit(0)).alias("first"))).unionByName(plain(asking, 1, asks.select("uid", "v", "first")))
    both = both.repartition(*group).sortWithinPartitions(*group, "side")
    found = both.mapInArrow(_search(n + 1), "query long, uid long, first long, score double")

    # A vector found in several trees has one score, so it holds one place.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "uid")
    best = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= n + 1).dropDuplicates(["query", "uid"])
    best = cut(best.select("query", "uid", "score"), "best")
    listed = best.join(units.select("uid", "ids"), "uid").select("query", F.explode("ids").alias("vec_id"), (-F.col("score")).alias("minus"))
    listed = listed.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct("minus", "vec_id"))), 1, 2 * (n + 1)).alias("near"))  # of (n + 1)**2 at most
    out = asked.join(listed, asked["uid"] == listed["query"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, n).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "near"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.minus")).alias("score"))
