"""Temperature mixing of sources, with DataFrame functions only.

Source shares p of the token counts become weights p**e / sum(p**e). The exponent e in [0, 1] is the
smallest (flattest mix) with an entropy of at most the target and no source repeated more than the
limit; both fall as e grows, so e is bisected, GRID + 1 sections to a pass over the source table.

Weights turn into token quotas of the budget. A source's documents fall into at most MAX_BLOCKS
blocks by hash; one longer than a block is a block of its own (at most as many again). A quota is met by
whole passes over the source and a last, partial pass through a permutation of its blocks, the long
documents first, longest first: each block that fits the room left is taken and others are skipped. Then the
first skipped block of several documents, the edge, gives its shortest documents while they fit. So a
source falls short of its quota by less than the shortest document that its edge leaves out or, where
all ordinary blocks are in, by less than the shortest long document left out. A block has a turn, its
place in that permutation; ``mix(ordered=True)`` puts the rows of every pass out in the order of its
own permutation. No window or list ever holds more than the blocks of a source or the narrow rows of
one block (a source's tokens over MAX_BLOCKS).

A source cannot be repeated less than the budget share on average, so a limit below it is refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS, MAX_BLOCKS, GRID, PASSES = 65_536, 4096, 31, 7
SEED = "mix"


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens`` (words of the whole text; null text has none; a null source is "")."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def exponent(sources: DataFrame, budget_share: float, entropy_share: float | None, max_repeat: float | None) -> float:
    """The exponent for ``sources(source, tokens)``, to six decimals.

    ``entropy_share`` places the target entropy between that of the shares (0) and log K (1).
    """
    if max_repeat is not None and budget_share > max_repeat + 1e-12:
        raise ValueError(f"a budget of {budget_share} times all tokens repeats some source more than {max_repeat} times")
    live = sources.where("tokens > 0")
    first = live.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.count("*").alias("k")).first()
    if not first["k"] or first["k"] == 1:
        return 1.0
    shares = live.select((F.col("tokens") / F.lit(float(first["t"]))).alias("p"))
    least, target = first["least"] / first["t"], None

    def measure(grid: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent."""
        sums = [f(F.pow("p", F.lit(e)) * g).alias(f"{n}{i}") for i, e in enumerate(grid) for n, f, g in (("z", F.sum, F.lit(1.0)), ("s", F.sum, F.log("p")))]
        got = shares.agg(*sums).first()
        return [(math.log(got[f"z{i}"]) - e * got[f"s{i}"] / got[f"z{i}"], budget_share * least ** (e - 1) / got[f"z{i}"]) for i, e in enumerate(grid)]

    if entropy_share is not None:
        base = measure([1.0])[0][0]
        target = base + entropy_share * (math.log(first["k"]) - base)

    def fits(entropy: float, repeat: float) -> bool:
        return (target is None or entropy <= target + 1e-12) and (max_repeat is None or repeat <= max_repeat + 1e-12)

    lo, hi = 0.0, 1.0
    if fits(*measure([0.0])[0]):
        return 0.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / (GRID + 1) for i in range(1, GRID + 1)]
        good = [fits(*m) for m in measure(grid)]
        n = good.index(True) if True in good else GRID
        lo, hi = (grid[n - 1] if n else lo), (grid[n] if n < GRID else hi)
    return round(hi, 6)


class Plan:
    """``sources``: their number of hashed blocks; ``blocks``: source, block, copies, turn; ``special``: documents
    that are a block of their own (``own``) or taken once more from the edge (``more``)."""

    def __init__(self, sources: DataFrame, blocks: DataFrame, special: DataFrame, e: float):
        self.sources, self.blocks, self.special, self.exponent = sources, blocks, special, e

    def copies(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
        """``__gm_all`` (a row of ``docs``), ``copies`` (how often the mix holds it), ``block``, ``turn``, ``source``, ``key`` (its id)."""
        source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
        key = F.col(id_col).cast("long")
        keyed = docs.select(F.struct("*").alias("__gm_all"), source.alias("source"), key.alias("key"), _number(_hash(key)).alias("number"))
        keyed = keyed.join(self.sources.select("source", "n_blocks"), "source")
        special = self.special.select(F.col("source").alias("s"), F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("doc_id").isNull().alias("none"), "own", "more")
        same = (F.col("source") == F.col("s")) & (F.coalesce("key", F.lit(-1)) == F.col("k")) & (F.col("key").isNull() == F.col("none"))
        keyed = keyed.join(special, same, "left").withColumn("block", F.coalesce("own", F.pmod("number", "n_blocks")))
        keyed = keyed.join(self.blocks.select("source", "block", F.col("copies").alias("whole"), "turn"), ["source", "block"])
        return keyed.select("__gm_all", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"), "block", "turn", "source", "key")


def _filled(blocks: Column, rest: Column) -> Column:
    """The blocks (turn, block, tokens) that fit one after the other into ``rest``, and the ``room`` they leave."""
    start = F.struct(rest.alias("room"), F.array().cast("array<long>").alias("taken"))
    take = lambda at, b: F.struct((at["room"] - b["tokens"]).alias("room"), F.concat(at["taken"], F.array(b["block"])).alias("taken"))
    return F.aggregate(blocks, start, lambda at, b: F.when(b["tokens"] <= at["room"], take(at, b)).otherwise(at))


def plan(sized: DataFrame, budget_share: float = 1.0, entropy_share: float | None = 0.5, max_repeat: float | None = 4.0) -> Plan:
    """Plan the mix of ``sized`` (output of ``sizes``, cut) for a budget of that share of all its tokens."""
    sources = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    e = exponent(sources, budget_share, entropy_share, max_repeat)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(e))).otherwise(0.0)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("total", F.lit(max(total, 1))).withColumn("power", power)
    z = shares.agg(F.sum("power")).first()[0] or 1.0
    quota = F.floor(F.col("power") / F.lit(z) * F.lit(budget_share * total) + 0.5)
    shares = shares.withColumn("quota", quota).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long"))
    shares = shares.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    shares = shares.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long"))
    shares = shares.withColumn("length", F.greatest(F.lit(BLOCK_TOKENS), F.ceil(F.col("tokens") / MAX_BLOCKS)).cast("long"))
    shares = cut(shares.select("source", "tokens", "quota", "passes", "rest", "n_blocks", "length"), "quotas")
    rows = sized.join(shares.select("source", "n_blocks", "length"), "source")
    long = rows.where(F.col("n_tokens") > F.col("length")).groupBy("source", "doc_id", "n_blocks").agg(F.sum("n_tokens").alias("tokens"))  # at most MAX_BLOCKS of a source
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("tokens"), _hash(F.col("doc_id")), "doc_id"))
    long = cut(long.select("source", "doc_id", (F.col("n_blocks") + rank - 1).alias("own")), "long")
    alone = long.select(F.col("source").alias("s"), F.col("doc_id").alias("k"), "own")
    member = rows.join(alone, (F.col("source") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("k")), "left")
    member = member.select("source", "doc_id", "n_tokens", F.coalesce("own", F.pmod(_number(_hash(F.col("doc_id"))), "n_blocks")).alias("block"), F.col("own").isNotNull().alias("single"))
    blocks = member.groupBy("source", "block", "single").agg(F.sum("n_tokens").alias("tokens")).join(shares.select("source", "passes", "rest"), "source")
    turns = Window.partitionBy("source").orderBy(F.desc("single"), F.when(F.col("single"), F.col("block")), _hash(F.col("source"), F.col("passes"), F.col("block")), "block")
    blocks = cut(blocks.withColumn("turn", (F.row_number().over(turns) - 1).cast("long")), "blocks")
    filled = blocks.groupBy("source", "rest").agg(F.sort_array(F.collect_list(F.struct("turn", "block", "tokens"))).alias("blocks"))
    filled = cut(filled.select("source", _filled(F.col("blocks"), F.col("rest")).alias("x")).select("source", "x.room", "x.taken"), "filled")
    taken = filled.select("source", F.explode("taken").alias("block"), F.lit(1).alias("once"))
    blocks = blocks.join(taken, ["source", "block"], "left").select("source", "block", "turn", "single", "once", (F.col("passes") + F.coalesce("once", F.lit(0))).alias("copies"))
    blocks = cut(blocks, "turns")
    edge = blocks.where("once is null and not single").groupBy("source").agg(F.min_by("block", "turn").alias("block")).join(filled.select("source", "room"), "source").where("room > 0")
    inside = Window.partitionBy("source", "block").orderBy("tokens", _hash(F.col("doc_id")), "doc_id")
    units = member.join(edge, ["source", "block"]).groupBy("source", "block", "room", "doc_id").agg(F.sum("n_tokens").alias("tokens"))  # rows that repeat an id are taken together
    more = units.withColumn("sum", F.sum("tokens").over(inside)).where("sum <= room").select("source", "doc_id", F.lit(None).cast("long").alias("own"), F.lit(1).alias("more"))
    special = long.select("source", "doc_id", "own", F.lit(0).alias("more")).unionByName(more)
    return Plan(shares, blocks, cut(special, "special"), e)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per input row: ``doc_id, source, n_tokens, copies, block, turn``.

    ``copies``: how often the mix holds the row (0: not at all); ``block``: its block of the source;
    ``turn``: the block's place in the permutation of the last pass.

    Null text has no tokens and a null source is the source "". Rows repeated with one id and source
    share their copies. Null ids count as one id. Other columns are not read; an empty table gives an
    empty result, and sources without tokens get nothing. A repetition limit below ``budget_share``
    raises ValueError.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col), "sizes")
    return plan(sized, **how).copies(sized).select("__gm_all.doc_id", "__gm_all.source", "__gm_all.n_tokens", "copies", "block", "turn")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = False, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix holds it, with their columns.

    ``ordered``: in the order of the passes and, in each pass, of its permutation of blocks.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col), "sizes")
    out = plan(sized, **how).copies(docs, id_col, source_col).where("copies > 0")
    out = out.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    if ordered:
        order = ["pass", "place", "block", "number", "key"]
        out = out.withColumn("place", _hash(F.col("source"), F.col("pass"), F.col("block"))).withColumn("number", _hash(F.col("key"))).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select("__gm_all.*")
