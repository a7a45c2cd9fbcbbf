"""Removal of lines that stand on many sites, with DataFrame functions only.

A line (white space at its ends trimmed) is known by two 64-bit hashes. Lines met fewer times than
the limit cannot be on that many sites and leave by a plain count. For the others, HyperLogLog
sketches of the sites merge by aggregation. Lines whose estimate is far above the limit are
boilerplate, those far below are not, and those within the error band get exact distinct counts.
Boilerplate lines are removed from every document; hashes and positions move, and each text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut

LEAST_SITES, LG_K, BAND = 5, 10, 0.15
ENDS = " \t\r\x0b\x0c"


def spread_lines(lines: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """Keys ``k1, k2`` of the lines on at least that many sites; ``lines`` has ``k1, k2, site``."""
    sketched = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    sketched = cut(sketched.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("about")), "estimates")
    lo, hi = least_sites * (1 - BAND) - 1, least_sites * (1 + BAND) + 1
    near = sketched.where(F.col("about").between(lo, hi)).select("k1", "k2")
    exact = lines.join(near, ["k1", "k2"], "left_semi").groupBy("k1", "k2", "site").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("sites"))
    return sketched.where(F.col("about") > hi).select("k1", "k2").unionByName(exact.where(F.col("sites") >= least_sites).select("k1", "k2"))


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, kept_text``.

    A line is a piece between newlines; ``n_lines`` counts those that are not blank, and only those can
    go. Null text is empty; a null site is the site "". Rows repeated with one id are handled each; a
    null id stays null. Texts of any length are read whole. Other columns are not read; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"))
    line = F.btrim("line", F.lit(ENDS))
    lines = source.select("doc_id", "version", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", line).where("line != ''")
    lines = lines.select("doc_id", "version", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2"))
    often = cut(lines.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= least_sites).select("k1", "k2"), "often")
    candidates = cut(lines.join(often, ["k1", "k2"]), "candidates")
    gone = cut(spread_lines(candidates, least_sites), "spread")
    bit = F.expr("shiftleft(1L, pos % 64)")
    marks = candidates.join(gone, ["k1", "k2"]).groupBy("doc_id", "version", F.floor(F.col("pos") / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits"))
    marks = marks.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("cell", "bits"))).alias("cells"), F.max("cell").alias("last"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(0).cast("long"))).alias("bits"))
    full = source.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    full = full.withColumn("parts", F.split("text", "\n", -1))
    marked = lambda x, i: F.col("bits").isNotNull() & (F.coalesce(F.getbit(F.coalesce(F.get("bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long")), F.pmod(i, F.lit(64)).cast("int")), F.lit(0)) == 1)
    blank = lambda x: F.btrim(x, F.lit(ENDS)) == ""
    full = full.withColumn("kept", F.when(F.col("bits").isNull(), F.col("parts")).otherwise(F.filter("parts", lambda x, i: ~marked(x, i))))
    return full.select("doc_id", F.size(F.filter("parts", lambda x: ~blank(x))).cast("long").alias("n_lines"), (F.size("parts") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
